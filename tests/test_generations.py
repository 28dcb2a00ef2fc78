"""The generation queue against a dictionary, with replays, failures and restarts between batches."""

import datetime as dt

import pytest

from quern.streaming import generations

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, h string, at timestamp"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def plain(rows):
    """(key, digest, version) of each content that is new to its key."""
    seen, out = {}, []
    for k, h, _ in rows:
        own = seen.setdefault(k, [])
        if h not in own:
            own.append(h)
            out.append((k, h, len(own)))
    return sorted(out, key=str)


def rows_of(sealed):
    return sorted(((r.k, r.h, r.version) for r in sealed.read().collect()), key=str)


def test_replays_failures_and_restarts_give_the_same_rows(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    batches = [
        [("a", "1", T0), ("a", "2", T0 + dt.timedelta(seconds=1)), ("b", "1", T0), (None, "1", T0), ("a", None, T0 + dt.timedelta(seconds=2))],
        [("a", "1", T0 + dt.timedelta(days=1)), ("b", "2", T0 + dt.timedelta(days=1)), ("a", None, T0 + dt.timedelta(days=1))],
        [("b", "1", T0 + dt.timedelta(days=2)), ("a", "3", T0 + dt.timedelta(days=2)), (None, "2", T0 + dt.timedelta(days=2)), ("c", "null", T0)],
    ]
    stream = lambda s: s.readStream.schema(SCHEMA).parquet(source)
    take = lambda fault=None: generations.run_queue(stream, spark, folder, "k", "h", "at", fault=fault)

    put(spark, source, batches[0])
    sealed = take()
    assert rows_of(sealed) == plain(batches[0])

    put(spark, source, batches[1])
    for step in ("rows_written", "before_manifest"):  # it fails with rows in the folder, but without their manifest
        def fail(at, step=step):
            if at == step:
                raise RuntimeError(step)

        with pytest.raises(Exception, match=step):
            take(fail)
        assert rows_of(sealed) == plain(batches[0])
    take()
    assert rows_of(sealed) == plain(batches[0] + batches[1])

    put(spark, source, batches[2])
    take()
    take()  # nothing is left
    assert rows_of(sealed) == plain(sum(batches, []))
    found = sealed.manifests().orderBy("generation").collect()
    assert [r.linked for r in found] == [True] * 3 and [r.records for r in found] == [5, 1, 3]

    # a batch run twice by hand changes nothing, other rows under its number are refused
    again = spark.read.parquet(f"{folder}/data/1")
    sealed.write(again, 1)
    assert rows_of(sealed) == plain(sum(batches, []))
    with pytest.raises(ValueError, match="other rows"):
        sealed.write(again.limit(0), 1)
    with pytest.raises(ValueError, match="not sealed"):
        sealed.write(again, 9)
    assert {(r.k, r.version) for r in generations.latest(sealed.read(), "k").collect()} == {("a", 4), ("b", 2), (None, 2), ("c", 1)}


def test_a_broken_chain_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    sealed = generations.Sealed(spark, folder)
    for n in range(3):
        sealed.write(spark.createDataFrame([("a", str(n), T0)], SCHEMA).selectExpr("*", f"{n + 1} AS version"), n)
    assert len(rows_of(sealed)) == 3
    path = tmp_path / "out/manifests/1.json"
    path.write_text(path.read_text().replace('"records": 1', '"records": 2'))
    (tmp_path / "out/manifests/.1.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="broken"):
        sealed.read()
