"""Sealed shards and pauses against queues that take one record at a time."""

import datetime as dt
import random

import pytest

from quern.operators import queues

T0 = dt.datetime(2024, 1, 1)


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


def one_by_one(rows, seconds, records, most_bytes):
    """{(queue, id): number of the shard's first record} of (queue, id, time, size) rows."""
    out, state, number = {}, {}, {}
    for q, id, at, size in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        n = number[q] = number.get(q, -1) + 1
        size = size or 0
        held = state.get(q)
        if held is None or held["n"] == records or held["bytes"] + size > most_bytes or (at - held["at"]).total_seconds() >= seconds:
            held = state[q] = {"n": 0, "bytes": 0, "at": at, "first": n}
        held["n"] += 1
        held["bytes"] += size
        out[q, id] = held["first"]
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    at = T0
    rows = []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 0, 1, 5, 30, 400]))
        size = rng.choice([0, 1, 10, 40, 60, 99, 100, 101, 250, None])
        rows.append((rng.choice(["a", "a", "a", "b", None]), i, at, size))
    return rows + [("a", n + 1, None, 5)]


@pytest.mark.parametrize("seed, block", [(1, 4), (3, 64), (4, 65_536)])
def test_shards_are_those_of_a_one_by_one_queue(spark, blocks, seed, block):
    rows = random_rows(seed, 700)
    arrivals = spark.createDataFrame(rows, "q string, id long, at timestamp, size int").repartition(3)
    for seconds, records, most in ((300, 4, 100), (10_000_000, 4, 250)):
        placed = queues.sealed(arrivals, ["q"], "at", "id", "size", seconds, records, most, block)
        assert {(r.q, r.id): r.shard for r in placed.collect()} == one_by_one(rows, seconds, records, most)
        for r in queues.shards(placed, ["q"], "at", "size").collect():
            assert r.records <= records and (r.bytes <= most or r.records == 1) and (r.closed - r.opened).total_seconds() < seconds


def test_the_bounds_that_halves_broke(spark):
    rows = [("x", 1, T0, 40), ("x", 2, T0, 90), ("y", 1, T0, 40), ("y", 2, T0, 250), ("y", 3, T0, 100)]
    placed = queues.sealed(spark.createDataFrame(rows, "q string, id long, at timestamp, size int"), ["q"], "at", "id", "size", most_bytes=100)
    assert sorted(r.bytes for r in queues.shards(placed, ["q"], "at", "size").collect()) == [40, 40, 90, 100, 250]


def test_no_records(spark):
    empty = spark.createDataFrame([], "q string, id long, at timestamp, size int")
    assert queues.sealed(empty, ["q"], "at", "id", "size").collect() == []
    with pytest.raises(ValueError):
        queues.sealed(empty, ["q"], "at", "id", "size", records=9, block=8)


def test_a_queue_at_its_low_mark_stays_paused(spark):
    levels = [("a", i, v) for i, v in enumerate([1.0, 9.9, 10.0, 7.0, 5.0, 4.9, 5.0, 10.1, 5.0, 4.0])]
    got = queues.paused(spark.createDataFrame(levels, "q string, n int, level double"), "q", ["n"], "level", 10.0, 5.0)
    assert [r.paused for r in got.orderBy("n").collect()] == [False, False, True, True, True, False, False, True, True, False]
