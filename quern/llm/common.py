"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: it cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` gave as ``df``; nothing may read it afterwards."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def joined_hot(big: DataFrame, small: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, of which ``small`` has one row each.

    A key's rows in ``big`` are dealt over ``salts`` by column ``by``; ``small`` is repeated for just
    the salts that a key has, so one key never lands in one task as a whole.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    wanted = dealt.select(key, "_salt").distinct().join(small, key)
    return dealt.join(wanted, [key, "_salt"]).drop("_salt")


#: Rows of an Arrow batch between Spark and Python. Texts may be long, and both sides hold a batch in memory.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have at most ``BATCH_ROWS`` rows, unless the session has a number of its own."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, str(BATCH_ROWS))


def give_back() -> None:
    """Return what a task has freed to the system, as its Python worker waits for other tasks with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
