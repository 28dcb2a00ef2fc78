"""Queues cut into sealed shards, as one that takes record by record would cut them.

A shard takes records in order until the next one would pass its bound of records or bytes, or comes
``seconds`` or more after the shard's first; that record opens the next shard. Where a shard ends
depends on where it began, so a running sum does not tell. What is known for each record without
looking back is where a shard that began *there* would end: its next cut. A queue's shards are the
cuts that are reached from its first record.

The queue is dealt into blocks of neighbouring records. A block follows its next cuts from each record where
a shard may enter it, which is one of its first ``records``, to the first cut behind it. These pointers, a few
thousand a block, are doubled until each queue's way through its blocks is known, in a number of rounds
that grows with the logarithm of the blocks. Then each block walks its own cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.scratch import written

#: Records of a block.
BLOCK = 65_536


def numbered(arrivals: DataFrame, queue: list[str], time: str, id: str, size: str) -> DataFrame:
    """(q, pos, at, id, size): the records of each queue ``q`` numbered from 0 in the order (time, id), time in microseconds."""
    rows = arrivals.where(F.col(time).isNotNull()).select(
        F.to_json(F.struct(*queue)).alias("q"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(id).alias("id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")
    )
    order = ["at", "id", "size"]
    # one queue may hold all records: ranges of it are numbered apart, after the sizes of the ranges before
    dealt = written(rows.repartitionByRange("q", *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("q", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("q", "part", (F.sum("n").over(Window.partitionBy("q").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("q", "part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(before, ["q", "part"]).select("q", (F.col("before") + F.col("place")).alias("pos"), *order)


def next_cuts(pos: np.ndarray, at: np.ndarray, size: np.ndarray, seconds: float, records: int, most_bytes: int) -> np.ndarray:
    """For each record the place (not ``pos``) of the one that ends a shard begun with it; ``len(pos)`` if none here does."""
    i = np.arange(len(pos))
    total = np.append(0, np.cumsum(size))
    full = np.searchsorted(total, total[:-1] + most_bytes, "right") - 1  # the first whose bytes pass the bound
    late = np.searchsorted(at, at + round(seconds * 1_000_000), "left")
    return np.maximum(i + 1, np.minimum(np.minimum(i + records, full), np.minimum(late, len(pos))))


def sealed(arrivals: DataFrame, queue: list[str], time: str, id: str, size: str, seconds: float = 300, records: int = 4096, most_bytes: int = 64 << 20, block: int = BLOCK) -> DataFrame:
    """(queue, id, time, size, shard): each record with its shard, named by the number of the shard's first record in its queue.

    No shard holds more than ``records`` or ``most_bytes`` or spans ``seconds``, but for a record that is
    larger than ``most_bytes`` by itself, which is a shard of its own. A null size counts as 0, records
    without a time are left out, and of equal times the smaller id comes first.
    """
    if not 1 <= records <= block:
        raise ValueError("a block holds at least the records of one shard")
    rows = written(numbered(arrivals, queue, time, id, size).withColumn("block", F.floor(F.col("pos") / block)))
    # a shard that begins in a block ends within the first ``records`` of the next one
    also = F.when((F.col("pos") % block < records) & (F.col("block") > 0), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    seen = rows.withColumn("block", F.explode(also))
    kind = arrivals.schema[id].dataType.simpleString()

    def sorted_block(group: Iterator[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(list(group)).sort_by("pos")

    def cuts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        pos, at, n = (table.column(c).to_numpy() for c in ("pos", "at", "size"))
        end = (table.column("block")[0].as_py() + 1) * block
        return pos, np.append(next_cuts(pos, at, n, seconds, records, most_bytes), len(pos)), int(np.searchsorted(pos, end))

    def ways(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted_block(group)
        pos, cut, own = cuts(table)
        to = cut[: min(own, records) if pos[0] else 1]
        while len(inside := np.flatnonzero(to < own)):
            to[inside] = cut[to[inside]]
        entry, goal = pos[: len(to)], pos[0] + to
        on = goal >= (key[1].as_py() + 1) * block  # else the queue ends in this block
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * int(on.sum()), pa.string()), pa.array(entry[on]), pa.array(goal[on])], names=["q", "pos", "goal"])

    def walk(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted_block(group)
        pos, cut, own = cuts(table)
        starts = [table.column("entry")[0].as_py() - int(pos[0])]
        while starts[-1] < own:
            starts.append(int(cut[starts[-1]]))
        mine = table.slice(starts[0], starts[-1] - starts[0])
        shard = np.repeat(pos[0] + np.array(starts[:-1], np.int64), np.diff(starts))
        out = mine.select(["q", "id", "at", "size"]).append_column("shard", pa.array(shard, pa.int64()))
        yield from out.combine_chunks().to_batches()

    jump = written(seen.groupBy("q", "block").applyInArrow(ways, "q string, pos long, goal long"))
    reached = rows.where("pos = 0").select("q", "pos")
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    for _ in range((blocks - 1).bit_length()):
        more = reached.join(jump, ["q", "pos"]).select("q", F.col("goal").alias("pos"))
        reached = written(reached.unionByName(more))
        on = jump.select("q", F.col("pos").alias("goal"), F.col("goal").alias("_goal"))
        jump = written(jump.join(on, ["q", "goal"]).select("q", "pos", F.col("_goal").alias("goal")))
    entries = reached.select("q", F.floor(F.col("pos") / block).alias("block"), F.col("pos").alias("entry"))
    placed = seen.join(entries, ["q", "block"]).groupBy("q", "block").applyInArrow(walk, f"q string, id {kind}, at long, size long, shard long")
    named = arrivals.select(*queue).schema
    return placed.withColumn("_q", F.from_json("q", named)).select(*[F.col(f"_q.{c}").alias(c) for c in queue], F.col("id").alias(id), F.timestamp_micros("at").alias(time), F.col("size").alias(size), "shard")


def shards(records: DataFrame, queue: list[str], time: str, size: str) -> DataFrame:
    """(queue, shard, records, bytes, opened, closed) of records that ``sealed`` has placed."""
    return records.groupBy(*queue, "shard").agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"), F.min(time).alias("opened"), F.max(time).alias("closed"))


def paused(levels: DataFrame, queue: str, order: list[str], level: str, high: float, low: float) -> DataFrame:
    """Add ``paused``: a queue stops at ``high`` or more and goes on below ``low``; at ``low`` and in between it keeps its state."""
    w = Window.partitionBy(queue).orderBy(*order)
    mark = F.when(F.col(level) >= high, True).when(F.col(level) < low, False)
    return levels.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))
