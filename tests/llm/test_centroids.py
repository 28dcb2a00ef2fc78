"""Delta Lloyd against Lloyd's algorithm in plain code."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from quern.llm import centroids

SF = "/root/testdata/sf0.001"


def plain(rows, dimensions=64, clusters=40, rounds=5):
    """Sorted (id, cluster, distance, cluster inertia, inertia, digest) of (id, vector) rows."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    c = [v for _, v in sorted((digest(f"2:{'' if i is None else i}"), v) for i, v in kept)[:clusters]]
    if not c:
        return []
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((dist(v, x), k) for k, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for k in range(len(c)):
            mine = [v for (_, v), (_, o) in zip(kept, own) if o == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    total = sum(d for d, _ in own)
    return sorted(((i, k, d, sum(e for e, o in own if o == k), total, digest(",".join(map(str, c[k])))) for (i, _), (d, k) in zip(kept, own)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    con.execute(centroids.op11_sql())
    found = rows_of(centroids.op11_centroids(spark, SF))
    assert found == sorted(con.fetchall(), key=str)
    assert len({r[1] for r in found}) > 5


def some_rows(seed, n, dimensions):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (6, dimensions))
    return [(i, (base[i % 6] + rng.normal(0, 0.4, dimensions)).tolist()) for i in range(n)]


def test_odd_rows_ties_and_clashing_columns(spark):
    rows = some_rows(1, 90, 4)
    rows += [(3, rows[3][1])] * 5 + [(None, rows[7][1]), (None, [0.0, 0.5, -0.5, 1.0])] + [(400 + i, [0.0] * 4) for i in range(9)]
    rows += [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0] * 5), (504, [1.0, None, 1.0, 1.0]), (505, [float("nan")] + [0.0] * 3), (506, [float("inf")] + [0.0] * 3)]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, owner int, distance int, v string").repartition(5)
    for clusters, rounds in ((7, 5), (40, 3), (200, 2), (1, 1), (3, 30)):
        found, centres = centroids.cluster(table, dimensions=4, clusters=clusters, rounds=rounds)
        assert rows_of(centroids.with_inertia(found, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) == plain(rows, 4, clusters, rounds)


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, centres = centroids.cluster(table)
    assert rows_of(centroids.with_inertia(found, centres)) == []


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [float((-1) ** i * (400_000 - 1000 * i)), float(i)]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, centres = centroids.cluster(table, dimensions=2, clusters=4)
    assert rows_of(centroids.with_inertia(found, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) == plain(rows, 2, 4)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimensions=2)


def test_a_round_compares_with_what_moved_only(monkeypatch):
    rng = np.random.default_rng(3)
    v, now = rng.integers(-99, 99, (500, 8)), rng.integers(-99, 99, (9, 8))
    owner, least = centroids.nearest(v, None, None, now)
    assert (owner == centroids.distances(v, now).argmin(axis=1)).all()
    moved = now.copy()
    moved[2] += 5
    seen = []
    full = centroids.distances
    monkeypatch.setattr(centroids, "distances", lambda a, b: seen.append((len(a), len(b))) or full(a, b))
    found, d = centroids.nearest(v, owner, now, moved)
    assert (found == full(v, moved).argmin(axis=1)).all() and (d == full(v, moved).min(axis=1)).all()
    assert sum(a * b for a, b in seen) < 500 * 9 / 2
    same, _ = centroids.nearest(v, owner, now, now)
    assert (same == owner).all()
