"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, the largest first, to the least-loaded shard.
The heap does not see single groups but classes of groups of one size: from a heap of the shards'
loads, ``c`` groups of size ``s`` take the ``c`` smallest of all values ``load + j * s``, so a class
is dealt in one step with the result that ``c`` pushes and pops would have. Sizes keep their 10
leading bits, which bounds the classes at 55,000 whatever the input; sizes up to 1,024 are exact,
larger ones are ordered within 0.1 %. Ranks of groups within a class and slots within a shard are
running counts over blocks of rows, so no window holds more than a block.

Defined cases: a null text has no bytes and size 1, and all null texts are one group, apart from
empty texts; long texts count whole; ties of load go to the smaller shard, ties of size to the
group key; repeated rows each get a slot; rows with a null id are placed like others; with fewer
groups than shards the last shards stay empty; an empty table gives an empty table; extra columns pass
through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.llm.common import written

SHARDS = 16
SALTS = 64
#: Rows of a block of running counts.
BLOCK = 50_000


def size_class(size: Column) -> Column:
    """``size`` with all but its 10 leading bits cleared."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(size)) - 11))
    return (F.floor(size / step) * step).cast("long")


def deal(classes: list[tuple[int, int]], shards: int = SHARDS) -> dict[int, list[int]]:
    """For each class (size, number of groups) how many groups each shard takes; largest sizes first."""
    loads = [(0, i) for i in range(shards)]
    heapq.heapify(loads)
    out: dict[int, list[int]] = {}
    for size, count in sorted(classes, reverse=True):
        taken = [0] * shards
        if count > 4 * shards:  # all but the last few at once: the level that most of the pops stay under
            low, high = loads[0][0], loads[0][0] + size * count
            under = lambda level: sum(max(0, (level - x) // size) for x, _ in loads)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if under(mid) <= count - shards else (low, mid - 1)
            held = []
            for x, i in loads:
                n = max(0, (low - x) // size)
                taken[i] = n
                held.append((x + n * size, i))
            loads = held
            heapq.heapify(loads)
            count -= sum(taken)
        for _ in range(count):
            x, i = loads[0]
            taken[i] += 1
            heapq.heapreplace(loads, (x + size, i))
        out[size] = taken
    return out


def running(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int | None = None) -> DataFrame:
    """Add ``out``, a gapless number from 0 within each value of ``keys``.

    Rows are numbered within blocks by the hash of ``order``, and each block starts where the
    blocks before it end.
    """
    blocks = max(1, -(-(df.count() if rows is None else rows) // BLOCK))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    own = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return dealt.withColumn(out, F.row_number().over(own) - 1).join(starts, [*keys, "_block"]).withColumn(out, (F.col(out) + F.col("_start")).cast("long")).drop("_block", "_start")


def assign(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """Add ``size``, ``group_key``, ``shard`` and ``slot`` to each row; ``keep``: the columns to carry along, all if None."""
    t = F.col(text).cast("string")
    rows = docs.select(
        *[c for c in (docs.columns if keep is None else keep) if c not in ("size", "group_key", "shard", "slot")],
        F.coalesce(F.octet_length(t) + 1, F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.sha2(t, 256), F.lit("")).alias("group_key"),
    )
    salt = F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int").alias("_salt")
    own = rows.select("group_key", "size", salt).groupBy("group_key", "_salt").agg(F.sum("size").alias("size"))
    groups = written(own.groupBy("group_key").agg(F.sum("size").alias("size")).withColumn("size_class", size_class(F.col("size"))))
    table = [(r.size_class, r.n) for r in groups.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()]
    ends = []
    for c, taken in deal(table, shards).items():
        total, bounds = 0, []
        for n in taken:
            total += n
            bounds.append(total)
        ends.append((c, bounds))
    spark = docs.sparkSession
    dealt = spark.createDataFrame(ends, T.StructType([T.StructField("size_class", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    ranked = running(groups, ["size_class"], ["group_key"], "rank", sum(n for _, n in table))
    # a shard takes the ranks of a class up to its end; the table of classes has at most 55,000 rows
    placed = ranked.join(F.broadcast(dealt), "size_class").select("group_key", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int").alias("shard"))
    # a group that many rows share is dealt over salts: first (group, salt) learns its shard, then its rows do
    of_salt = own.select("group_key", "_salt").join(placed, "group_key")
    named = written(rows.withColumn("_salt", salt).join(of_salt, ["group_key", "_salt"]).drop("_salt"))
    return running(named, ["shard"], [id, "group_key"], "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs.select("doc_id", "text", F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32")), keep=["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
