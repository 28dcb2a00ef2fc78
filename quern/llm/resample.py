"""Importance resampling towards a target: draw the documents that look most like it, with noise.

Features are runs of one to three words, hashed into buckets. How much more often the target has a
bucket than the corpus is the bucket's gain, and a document weighs the sum of the gains of all its
features: one array of gains scores every document. Gumbel noise makes the highest scores a sample
without replacement in proportion to the weights.

The draw sorts nothing as a whole. A histogram counts documents by score; its counts, summed from
the highest score down, are the rank before each score's first document, and the last score whose
offset lies below the number to draw is the cutoff. Histogram and survivors are dealt by ranges, so
a running sum or a row number only ever runs within one range: what lies before a range is the sum of
the ranges' totals, one number for each partition.

A feature's crc32 is put together from those of its words, for a checksum is linear: that of a
joined text is the first part's, moved on by the length of the second, XOR the second part's.

Defined cases: null and empty texts have no features, weigh 0 and are never drawn; long texts are
read whole; ties of score go to the smaller id, rows without an id last, then to fewer features;
wholly equal rows take neighbouring ranks; with fewer than ``least_words`` words a document is scored,
not drawn; an empty table gives an empty table, and an empty target is one without features; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import documents, give_back, small_batches, written

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Texts that a task works off at once, and words whose checksums it remembers.
PART, REMEMBER = 256, 100_000
_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 0x80 or b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _zeros(values: np.ndarray) -> np.ndarray:
    """Checksums moved on by one byte."""
    return (values >> np.uint32(8)) ^ _BYTE[values & np.uint32(255)]


def _tables(steps: list[int]) -> np.ndarray:
    """For each number of bytes, what each byte of a checksum adds when it is moved on by them."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out, at = [], 0
    for step in steps:
        while at < step:
            values, at = _zeros(values), at + 1
        out.append(values)
    return np.array(out)


_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE = np.where(_BYTE & np.uint32(1), (_BYTE >> np.uint32(1)) ^ np.uint32(0xEDB88320), _BYTE >> np.uint32(1))
NEAR = 64
_SHORT = _tables(list(range(NEAR)))


def _twice(table: np.ndarray) -> np.ndarray:
    return _moved_by(table, table)


def _moved_by(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    return table[0][values & np.uint32(255)] ^ table[1][(values >> np.uint32(8)) & np.uint32(255)] ^ table[2][(values >> np.uint32(16)) & np.uint32(255)] ^ table[3][values >> np.uint32(24)]


#: Moves by 64, 128, 256 ... bytes.
_LONG = [_twice(_SHORT[NEAR // 2])]
while len(_LONG) < 26:
    _LONG.append(_twice(_LONG[-1]))


def moved(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each checksum moved on by its number of bytes."""
    short = by & (NEAR - 1)
    out = np.bitwise_xor.reduce([_SHORT[short, k, (values >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)])
    rest = by >> 6
    for table in _LONG:
        if not rest.any():
            break
        own = np.flatnonzero(rest & 1)
        out[own] = _moved_by(table, out[own])
        rest = rest >> 1
    return out


class _Words(dict):
    """A number for each word, with its checksum, that of a space and the word, and the bytes of the two."""

    def __init__(self):
        self.alone, self.after, self.size = array("I"), array("I"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.alone)
        self.alone.append(zlib.crc32(word))
        self.after.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        return found

    def empty(self) -> None:
        self.clear()
        self.__init__()


def features(texts: list[str | None], memory: _Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each feature, number of the text of each feature)."""
    found = [list(map(memory.__getitem__, (t or "").encode().translate(_FOLD).split())) for t in texts]
    count = np.array([len(x) for x in found], np.int64)
    words = np.fromiter((i for x in found for i in x), np.int64, int(count.sum()))
    text = np.repeat(np.arange(len(found)), count)
    alone, after, size = (np.array(x) for x in (memory.alone, memory.after, memory.size))
    if len(memory) > REMEMBER:
        memory.empty()
    sums, owners = [alone[words].astype(np.uint32)] if len(words) else [np.empty(0, np.uint32)], [text]
    for run in (1, 2):
        if len(words) <= run:
            break
        last = words[run:]
        # where a run passes into the next text it is made too, and dropped
        sums.append(moved(sums[-1][: len(last)], size[last]) ^ after[last].astype(np.uint32))
        owners.append(np.where(text[run:] == text[: len(last)], text[run:], -1))
    owner = np.concatenate(owners)
    bucket = (np.concatenate(sums) % np.uint32(buckets)).astype(np.int64)
    return count, bucket[owner >= 0], owner[owner >= 0]


def totals(table: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; the driver gets a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, sums = _Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                _, bucket, _ = features(batch.column(0).slice(at, PART).to_pylist(), memory, buckets)
                sums += np.bincount(bucket, minlength=buckets)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(sums[own])], names=["bucket", "n"])
        memory.empty()
        give_back()

    small_batches(table.sparkSession)
    found = table.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target has each bucket, both smoothed by one."""
    ours, theirs, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([floor(1000 * log(((t + 1) * (ours + n)) / ((s + 1) * (theirs + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``_w``: its words, its features and the sum of their gains."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _Words()
        for texts in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for at in range(0, len(texts), PART):
                part = texts.slice(at, PART).to_pylist()
                count, bucket, owner = features(part, memory, len(gain))
                columns[0].append(count)
                columns[1].append(np.bincount(owner, minlength=len(part)))
                weight = np.zeros(len(part), np.int64)
                np.add.at(weight, owner, gain[bucket])
                columns[2].append(weight)
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in columns]
            yield pa.StructArray.from_arrays(arrays, names=["words", "features", "weight"])
        memory.empty()
        give_back()

    small_batches(docs.sparkSession)
    return docs.withColumn("_w", F.arrow_udf(run, "words long, features long, weight long").asNondeterministic()(F.col(text).cast("string")))


def noise(id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, drawn by the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _dealt(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt by ranges of ``order``, with ``block``, the number of a row's range, in the shared folder."""
    return written(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))


def offsets(histogram: DataFrame, draw: int) -> DataFrame:
    """(score, above) for all scores of which a document is drawn: ``above`` documents have a higher score."""
    spark = histogram.sparkSession
    blocks = _dealt(histogram, F.desc("score"))
    sums = {r.block: r.n for r in blocks.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    before, at = [], 0
    for block in sorted(sums):
        before.append((block, at))
        at += sums[block]
    start = spark.createDataFrame(before, "block int, start long")
    running = F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")))
    return blocks.join(F.broadcast(start), "block").select("score", (F.col("start") + running - F.col("n")).alias("above")).where(F.col("above") < draw)


def resample(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; ``rank`` is null for what is not drawn."""
    gain = gains(totals(docs, text, buckets), totals(target, target_text, buckets))
    rows = weighed(docs.select(F.col(id).cast("long").alias(id), F.col(text).alias("text")), gain)
    weight = F.col("_w.weight")
    scored = written(
        rows.select(
            id, F.col("_w.features").alias("n_features"), weight.alias("weight"), (weight + noise(F.col(id), seed)).alias("score"),
            (F.col("_w.words") >= least_words).alias("_long"), F.monotonically_increasing_id().alias("_row"),
        )
    )
    draw = percent * scored.where("_long").count() // 100
    shown = [id, "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select(*shown, none)

    above = written(offsets(scored.where("_long").groupBy("score").agg(F.count(F.lit(1)).alias("n")), draw))
    cutoff = above.agg(F.min("score")).first()[0]
    # rows of one score lie in neighbouring blocks, in the order of their ids
    order = [F.asc_nulls_last(id), F.asc("n_features"), F.asc("_row")]
    survivors = _dealt(scored.where(F.col("_long") & (F.col("score") >= cutoff)), F.desc("score"), *order)
    parts = survivors.groupBy("score", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("score").orderBy("block")) - F.col("n")
    start = parts.withColumn("before", before).join(above, "score").select("score", "block", (F.col("above") + F.col("before")).alias("start"))
    place = F.row_number().over(Window.partitionBy("score", "block").orderBy(*order))
    ranked = survivors.withColumn("_place", place).join(start, ["score", "block"]).withColumn("rank", F.col("start") + F.col("_place"))
    drawn = ranked.select(*shown, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    rest = scored.where(~F.col("_long") | (F.col("score") < cutoff)).select(*shown, none)
    return drawn.unionByName(rest)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's texts, and the ranks of the drawn twentieth."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
