"""Ordered-group operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_versions(df: DataFrame, item: str, content: str, *order: str) -> DataFrame:
    """``version``: contents of an item numbered by first appearance; a content that returns keeps its number."""
    first = df.groupBy(item, content).agg(F.min(F.struct(*order)).alias("_first"))
    numbered = first.withColumn("version", F.dense_rank().over(Window.partitionBy(item).orderBy("_first"))).drop("_first")
    return df.join(numbered, [item, content])


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``island``: numbers of runs of equal neighbouring values within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def running_offset(df: DataFrame, keys: list[str], order: str, size: Column, gap: int = 0) -> DataFrame:
    """``start``: where each piece begins when the pieces of a key are joined with ``gap`` characters between them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(size + gap).over(w), F.lit(0)).cast("long"))


def neighbours(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``before`` and ``after``: the value of the rows next to each row."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def best_k(df: DataFrame, keys: list[str], score: Column, id: str, k: int) -> DataFrame:
    """The best ``k`` of each key; ``certain`` is false where a tie at the boundary leaves the membership open."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.rank().over(w.orderBy(score))).withColumn("_from_end", F.count(F.lit(1)).over(w.orderBy(score).rangeBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("_rank") <= k).withColumn("certain", F.col("_from_end") <= k).drop("_rank", "_from_end")


def first_crossing(df: DataFrame, keys: list[str], order: str, value: str, target: float, upward: bool = True) -> DataFrame:
    """The first row of each key that reaches ``target``, with the value before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    hit = F.col(value) >= target if upward else F.col(value) <= target
    marked = df.withColumn("before", F.lag(value).over(w)).where(hit)
    return marked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def budget(df: DataFrame, keys: list[str], forced: Column, score: str, id: str, size: int) -> DataFrame:
    """At most ``size`` rows of each key: forced ones first, then by score, then by id."""
    w = Window.partitionBy(*keys).orderBy(forced.desc(), F.col(score).desc_nulls_last(), F.col(id).asc())
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)


def rotation(df: DataFrame, keys: list[str], id: str, last: int, size: int) -> DataFrame:
    """The next ``size`` rows of each key after id ``last``, wrapping round."""
    w = Window.partitionBy(*keys).orderBy((F.col(id) <= last).cast("int"), F.col(id))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)


def covered_first(df: DataFrame, keys: list[str], people: str, statements: str, at: str, name: str) -> DataFrame:
    """``place`` of each row of a key by coverage: people, statements, latest time, then name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(people), F.desc(statements), F.desc(at), F.asc(name))
    return df.withColumn("place", F.row_number().over(w))
