"""Centroid clustering by delta Lloyd.

Each round of Lloyd's algorithm assigns every vector to its nearest centroid and moves each centroid
to the mean of its vectors. Here a round touches only what can have changed. The owner of each vector
is kept, and the sum and count of each cluster. A vector is compared with the centroids that moved; only
if its own moved away from it is it compared with all. Vectors that change their owner send their
components, with a minus to the old and a plus to the new cluster, and these transfers alone are
added up: at most two rows for each cluster leave a task, and the driver holds one sum for each cluster.

Components are integers, so distances and means are exact and do not depend on the order of rows.

Defined cases: a null vector, one of another length, and one with a null or non-finite component is
dropped; a component must be within ``RANGE`` once it is an integer, for a distance must fit a long,
and a table that has a larger one is refused; null ids count as an empty text in the draw of the first
centroids; repeated rows are vectors of their own, and equal first centroids stay apart, of which
the lower number owns the vectors; a cluster without vectors keeps its centroid; fewer vectors than
clusters are a centroid each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import discard, give_back, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest integer component, either sign: squares of differences, ``DIMENSIONS`` of them, then fit a long.
RANGE = 1 << 27
#: Vectors that a task compares at once.
PART = 8_192


def vectors(table: DataFrame, id: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that are kept, as integers."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(whole, lambda x: F.abs(x) <= RANGE)
    checked = F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for an exact distance")))
    return table.where((F.size(v) == dimensions) & F.forall(v, finite)).select(F.col(id).alias(id), checked.alias("v"))


def first_centroids(kept: DataFrame, id: str, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest digests; of equal ids the smaller vector comes first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``v`` to all centroids, exact."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * max(1, v.shape[1]) < 1 << 53:  # then products and sums are whole numbers in doubles too
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1) if len(centroids) else np.empty((len(v), 0), np.int64)


def own_distance(v: np.ndarray, centroids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return ((v - centroids[owner]) ** 2).sum(axis=1)


def nearest(v: np.ndarray, owner: np.ndarray | None, before: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of each vector; of equal distances the smaller number.

    ``owner`` are the owners under the centroids ``before``. A centroid that stayed can only win a vector
    whose own centroid is now farther away; all others are compared with the moved ones alone.
    """
    if owner is None:
        d = distances(v, now)
        best = d.argmin(axis=1) if len(v) else np.empty(0, np.int64)
        return best, d[np.arange(len(v)), best]
    changed = np.flatnonzero((before != now).any(axis=1))
    best, least = owner.copy(), own_distance(v, now, owner)
    away = least > own_distance(v, before, owner)
    for rows, against in ((np.flatnonzero(away), np.arange(len(now))), (np.flatnonzero(~away), changed)):
        if len(rows) and len(against):
            d = distances(v[rows], now[against])
            place = d.argmin(axis=1)
            found, number = d[np.arange(len(rows)), place], against[place]
            better = (found < least[rows]) | ((found == least[rows]) & (number < best[rows]))
            best[rows[better]], least[rows[better]] = number[better], found[better]
    return best, least


def assigned(state: DataFrame, id: str, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """``state`` (id, v, owner) with the owners under ``now``, their ``distance`` and ``left``, the owner that a vector had (null: none)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vs, owners in batches:
            best, least = [], []
            for at in range(0, len(vs), PART):
                v = vs.slice(at, PART).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, now.shape[1])
                old = None if before is None else owners.slice(at, PART).to_numpy(zero_copy_only=False).astype(np.int64)
                b, d = nearest(v, old, before, now)
                best.append(b)
                least.append(d)
            flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(flat(best).astype(np.int32)), pa.array(flat(least), pa.int64())], names=["owner", "distance"])
        give_back()

    found = F.arrow_udf(run, "owner int, distance long").asNondeterministic()("v", "owner")
    return state.withColumn("_found", found).select(id, "v", F.col("_found.owner").alias("owner"), F.col("_found.distance").alias("distance"), F.col("owner").alias("left"))


def transfers(state: DataFrame, dimensions: int = DIMENSIONS) -> list:
    """For each cluster the signed sums of the vectors that came and left: (cluster, n, v). The driver gets a row for each cluster."""
    sign = lambda cluster, s: F.struct(F.col(cluster).alias("cluster"), F.lit(s).cast("long").alias("sign"))
    moved = state.where(~F.col("owner").eqNullSafe(F.col("left")))
    ends = F.array(sign("owner", 1), sign("left", -1))
    sent = moved.select("v", F.explode(ends).alias("e")).where("e.cluster IS NOT NULL")
    sums = [F.sum(F.col("e.sign") * F.col("v")[i]).alias(f"v{i}") for i in range(dimensions)]
    rows = sent.groupBy("e.cluster").agg(F.sum("e.sign").alias("n"), *sums).collect()
    return [(r[0], r[1], np.array(r[2:], np.int64)) for r in rows]


def cluster(
    table: DataFrame, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of each kept vector, the final centroids). Rounds end early if no centroid moves."""
    kept = written(vectors(table, id, vector, dimensions, scale))
    now = first_centroids(kept, id, clusters, seed)
    if not len(now):
        return kept.select(id, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state, before = kept.withColumn("owner", F.lit(None).cast("int")), None
    sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
    held = kept
    for _ in range(rounds):
        state = written(assigned(state.select(id, "v", "owner"), id, before, now))
        discard(held)  # what the new owners were computed from
        held = state
        for number, n, v in transfers(state, dimensions):
            counts[number] += n
            sums[number] += v
        before, now = now, np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], now)
        if (before == now).all():
            break
    last = written(assigned(state.select(id, "v", "owner"), id, before, now).select(id, F.col("owner").alias("cluster"), "distance"))
    discard(held)
    return last, now


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the distances summed over each cluster and over all, and the digest of each centroid."""
    sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row for each cluster
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(k, sums[k], sum(sums.values()), digest(c)) for k, c in enumerate(centroids) if k in sums]
    of_cluster = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster, its distance, the inertias and the digest of its centroid."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql() -> str:
    """Lloyd's algorithm in full: all vectors against all centroids in each round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) ORDER BY h, v LIMIT {CLUSTERS})",
    ]
    near = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    mean = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"  # rounded down, also below zero
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, min({{'d': d, 'k': k}}) AS best FROM (SELECT r, k, {near} AS d FROM kept, c{t}) GROUP BY r)")
        if t < ROUNDS:
            steps.append(f"s{t} AS (SELECT k, i, {mean} AS m FROM (SELECT best.k AS k, unnest(v) AS x, unnest(range(1, {DIMENSIONS + 1})) AS i FROM kept JOIN a{t} USING (r)) GROUP BY k, i)")
            steps.append(f"m{t} AS (SELECT k, list(m ORDER BY i) AS c FROM s{t} GROUP BY k)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN m{t} m USING (k))")
    steps.append(f"f AS (SELECT vec_id, best.k AS k, best.d AS d FROM kept JOIN a{ROUNDS} USING (r))")
    return f"WITH {', '.join(steps)} SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} USING (k)"
