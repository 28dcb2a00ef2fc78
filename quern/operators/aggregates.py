"""Aggregations beyond the plain built-ins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.scratch import written


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def distinct_where(column: str, condition: Column) -> Column:
    return F.countDistinct(F.when(condition, F.col(column)))


def counts_by_type(df: DataFrame, entity: str, kind: str) -> DataFrame:
    """Per entity a map of counts by kind, as sorted entries, and their total."""
    two = df.groupBy(entity, kind).agg(F.count(F.lit(1)).alias("n"))
    return two.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(kind, "n"))).alias("by_type"), F.sum("n").alias("total"))


def last_per_key(df: DataFrame, entity: str, key: str, value: str, *order: str) -> DataFrame:
    """Cumulative corrections: for each entity and key the value that was set last."""
    return df.groupBy(entity, key).agg(F.max_by(value, F.struct(*order)).alias(value))


def nearest_ranks(df: DataFrame, groups: list[str], column: str, **shares: float) -> DataFrame:
    """(groups, one column for each share, n): exact nearest-rank percentiles of the values of each group, and their number.

    Equal values are counted first. The counts are dealt by ranges of (group, value), and a range's running
    sum starts at the sum of the group's ranges before it, so a task holds one range of values, however many
    a group has. Null values do not count; a group of nulls has null percentiles.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange(*groups, column).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*groups, "_part").agg(F.sum("_n").alias("_sum"))
    own = Window.partitionBy(*groups)
    start = sums.select(*groups, "_part", (F.sum("_sum").over(own.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(own).alias("_total"))
    keys = [*groups, "_part"]
    other = lambda rows, names: rows.withColumnsRenamed({k: f"_of_{k}" for k in names})
    same = lambda names: [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names]
    placed = dealt.join(other(start, keys), same(keys)).select(*keys, column, "_n", "_before", "_total")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys).orderBy(column))
    ranked = placed.withColumn("_upto", upto)
    # a decimal share, for 0.55 * 100 is more than 55 in doubles
    first = [F.min(F.when(F.col("_upto") >= F.lit(Decimal(str(share))) * F.col("_total"), F.col(column))).alias(name) for name, share in shares.items()]
    found = ranked.groupBy(*groups).agg(*first)
    every = df.groupBy(*groups).agg(F.count(column).alias("n"))
    return every.join(other(found, groups), same(groups), "left").select(*groups, *shares, "n")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` rounded half to even; null for a zero whole."""
    return F.when(whole != 0, F.bround(part / whole, digits))


def best_state(column: str, order: list[str]) -> Column:
    """The state that comes first in ``order`` among a group's states."""
    rank = F.coalesce(*[F.when(F.col(column) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    return F.min_by(column, rank)


def tally(df: DataFrame, *columns: str) -> DataFrame:
    """Counts for each value of each column, long: (dimension, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def change_mark(df: DataFrame, *columns: str) -> DataFrame:
    """(n, mark): a row count and an order-free fingerprint (60 bits of a digest per row) that changes with any cell."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")), F.lit(0)).alias("mark"))
