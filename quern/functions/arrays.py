"""Array functions that Spark lacks, as column expressions, and columns that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)``, with ``c`` computed once however often ``use`` names it; also within a lambda."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def running_sums(a: Column) -> Column:
    """For each number of an array the sum of those up to it, as longs.

    Each round adds to every number the one that stands 1, 2, 4 ... places before it, so an array costs its
    length times the logarithm of its length. The rounds are an aggregate, for its accumulator is not computed anew.
    """

    def add(acc: Column, k: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int")), acc)
        return F.slice(F.zip_with(acc, moved, lambda x, y: F.coalesce(x, F.lit(0)) + y), F.lit(1), F.size(acc))

    def summed(numbers: Column) -> Column:
        # the logarithm's next whole number
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int"))
        return F.when(F.size(numbers) > 1, F.aggregate(rounds, numbers, add)).otherwise(numbers)

    return once(F.transform(a, lambda x: x.cast("long")), summed)


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern: array of (start, stop, text), in characters, stop exclusive. The pattern must not match nothing.

    Most texts have none, and are read once then.
    """

    def placed(z: Column) -> Column:
        # gap and match together end where the match does
        lengths = F.zip_with(F.slice(z["gaps"], F.lit(1), F.size(z["hits"])), z["hits"], lambda gap, hit: F.length(gap) + F.length(hit))
        return F.zip_with(z["hits"], running_sums(lengths), lambda hit, stop: F.struct((stop - F.length(hit)).cast("int").alias("start"), stop.cast("int").alias("stop"), hit.alias("text")))

    found = once(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)
    return F.when(~text.rlike(pattern), F.array().cast("array<struct<start:int,stop:int,text:string>>")).otherwise(found)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once: Spark does not merge a generator's input into what reads it."""
    rows = df.select("*", F.explode(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))).alias("_held"))
    return rows.select(*df.columns, *[F.col(f"_held.{n}").alias(n) for n in columns])
