"""Sharding against a plain heap, one group at a time."""

import heapq
import random
import zlib
from collections import defaultdict

from quern.llm import sharding


def plain_deal(classes, shards):
    heap = [(0, i) for i in range(shards)]
    out = {}
    for size, count in sorted(classes, reverse=True):
        out[size] = [0] * shards
        for _ in range(count):
            x, i = heap[0]
            out[size][i] += 1
            heapq.heapreplace(heap, (x + size, i))
    return out


def test_deal_equals_a_plain_heap():
    rng = random.Random(3)
    for _ in range(60):
        classes = [(s, rng.choice([1, 2, 7, 300])) for s in rng.sample(range(1, 500), rng.randint(0, 12))]
        assert sharding.deal(classes, 5) == plain_deal(classes, 5)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op9_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    shard_of, slots, load, group = {}, defaultdict(list), defaultdict(int), defaultdict(int)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        assert shard_of.setdefault(docs[r.doc_id], r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        group[docs[r.doc_id]] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = [0] * 16
    for size in sorted(group.values(), reverse=True):
        want[want.index(min(want))] += size
    assert max(load.values()) <= max(want) * 1.02 + 20 and set(load) <= set(range(16))


def test_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "aé"), (4, "aé"), (5, "b" * 70_000), (6, "b" * 70_000)]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, shard string, slot int")
    got = sharding.assign(df, shards=3).collect()
    assert len(got) == 7
    by = defaultdict(set)
    for r in got:
        by[r.text].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    assert {r.size for r in got if r.text is None} == {1}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(df.limit(0)).count() == 0


def test_null_ids_and_empty_shards(spark):
    rows = [(None, "a"), (None, "a"), (None, None), (7, "bb")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    assert sorted((r.text or "-", r.size) for r in got) == [("-", 1), ("a", 2), ("a", 2), ("bb", 3)]
    assert {r.shard for r in got} == {0, 1, 2} and all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(5))
