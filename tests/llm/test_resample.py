"""Resampling against plain code over all rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from quern.llm import resample

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["few", "many"])
def blocks(request, spark):
    """Ranges as Spark joins them, and all ranges apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param == "few").lower())
    spark.conf.set("spark.sql.shuffle.partitions", "4" if request.param == "few" else "9")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20):
    """Sorted (id, features, weight, score, rank) of (id, text) rows, each row by its place."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in docs:
        for f in plain_features(text):
            s[bucket(f)] += 1
    for text in target:
        for f in plain_features(text):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10000) / ((int(a) + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for id, text in docs:
        found = plain_features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        rows.append([id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)) >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_features_of_odd_texts():
    texts = [None, "", " .,", "One", "one two", "ONE\x00two\x7fthree four", "Ä ßx 9", "x" * 63 + " " + "y" * 64 + " " + "z" * 5000 + " end", "a b " * 3000]
    count, bucket, owner = resample.features(texts, resample._Words(), 10000)
    for k, text in enumerate(texts):
        assert count[k] == len(plain_words(text))
        assert sorted(bucket[owner == k].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in plain_features(text))


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(resample, "REMEMBER", 3)
    memory = resample._Words()
    for text in ("a b c d e", "c d e f", "a", "a b c d e"):
        _, bucket, _ = resample.features([text], memory, 10000)
        assert sorted(bucket.tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in plain_features(text))


def test_whole_table(spark, blocks):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = rows_of(resample.op12_resample(spark, SF))
    assert found == plain(docs, target)
    assert any(r[4] for r in found)


def test_ties_repeated_rows_nulls_and_extra_columns(spark, blocks):
    long, short = " ".join(f"w{i % 7}" for i in range(40)), "too short"
    rows = [(i % 5, long) for i in range(60)] + [(None, long), (None, None), (7, ""), (8, short), (9, long + " more")]
    docs = spark.createDataFrame([(i, t, 1, "x", i) for i, t in rows], "doc_id long, text string, score int, block string, rank long").repartition(7)
    target = spark.createDataFrame([(1, "w1 w2 w3 target", 5)], "item_id long, text string, n int")
    for percent in (1, 50, 100):
        assert rows_of(resample.resample(docs, target, percent=percent)) == plain(rows, ["w1 w2 w3 target"], percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(resample.resample(docs, target)) == []
    some = [(i, " ".join(f"a{i + k}" for k in range(25))) for i in range(40)]
    assert rows_of(resample.resample(spark.createDataFrame(some, "doc_id long, text string"), target)) == plain(some, [])


@pytest.mark.parametrize("draw", [1, 7, 35, 36])
def test_offsets_span_blocks(spark, blocks, draw):
    counts = {s: s % 4 + 1 for s in range(-7, 8)}
    found = resample.offsets(spark.createDataFrame(list(counts.items()), "score long, n long"), draw)
    assert {r.score: r.above for r in found.collect()} == {s: a for s in counts if (a := sum(n for x, n in counts.items() if x > s)) < draw}
