"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.joins import joined_hot
from quern.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of its component.

    Large-star and small-star steps alternate until the edges are stars. Each round is written to
    the shared folder, so neither the lineage nor any task grows with the number of rounds, and hubs are
    dealt over many tasks. Rounds grow with the square of the logarithm of the nodes at most; ``rounds``
    only guards against a fault.
    """
    e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = joined_hot(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        e = written(joined_hot(large, least, "a", "b").select(moved.alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError("components did not settle")
