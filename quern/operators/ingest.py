"""Versioned, idempotent ingest and set-based merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_keeping_first(old: DataFrame, new: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """All keys of both sides; on a key that both have the old row stays and ``conflict`` tells whether owners differ."""
    n = new.select(*keys, F.col(owner).alias("_new"))
    joined = old.join(n, keys, "full_outer")
    return joined.select(*keys, F.coalesce(owner, "_new").alias(owner), F.coalesce(F.col(owner) != F.col("_new"), F.lit(False)).alias("conflict"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; a key of ``new`` replaces the whole row."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def version_history(observations: DataFrame, item: str, content: str, at: str, tiebreak: str) -> DataFrame:
    """Batch form of versioned ingest.

    In the order (``at``, ``tiebreak``) each observation of an item gets the version of its content and
    a status: ``new`` for the first of an item, ``version_changed`` for a content not seen before,
    ``unchanged`` for a known one. ``is_current`` marks the content that was seen last.
    """
    order = [F.col(at), F.col(tiebreak)]
    first = observations.groupBy(item, content).agg(F.min(F.struct(at, tiebreak)).alias("_first"))
    numbered = first.withColumn("version", F.dense_rank().over(Window.partitionBy(item).orderBy("_first")))
    w = Window.partitionBy(item)
    rows = observations.join(numbered, [item, content])
    own = F.struct(at, tiebreak) == F.col("_first")
    status = F.when(own & (F.col("version") == 1), "new").when(own, "version_changed").otherwise("unchanged")
    last = F.last(content).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("status", status).withColumn("is_current", F.col(content) == last).drop("_first")


def carried_forward(previous: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    """Items of ``previous`` that this pass did not visit, as unchanged."""
    return previous.join(visited.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("unchanged"))


def run_outcome(total: Column, failed: Column) -> Column:
    return F.when(failed == 0, "succeeded").when(failed < total, "partial").otherwise("failed")


def backoff_seconds(failures: Column, cap: int = 60) -> Column:
    """Seconds to wait after that many failures in a row: doubling, bounded."""
    return F.least(F.lit(float(cap)), F.pow(F.lit(2.0), F.least(failures, F.lit(5)))).cast("int")


def as_of(df: DataFrame, event: str, known: str, reviewed: str, cutoff: Column) -> DataFrame:
    """Bitemporal cutoff: ``current`` if the event, its capture and its review all lie at or before ``cutoff``."""
    late = lambda c: F.col(c).isNull() | (F.col(c) > cutoff)
    status = F.when(F.col(event).isNull(), "undated").when(F.col(event) > cutoff, "after_cutoff").when(late(known), "not_yet_known").when(late(reviewed), "not_yet_reviewed").otherwise("current")
    return df.withColumn("history_status", status)


def generations(arrivals: DataFrame, key: str, digest: str, *order: str) -> DataFrame:
    """Each new content of a key once, with its ``version``: a queue that takes the same record any number of times.

    A record whose digest the key has had before is no new generation, also after others came between.
    """
    first = arrivals.groupBy(key, digest).agg(F.min(F.struct(*order)).alias("_at"))
    return first.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).select(key, digest, "version", *[F.col(f"_at.{c}").alias(c) for c in order])


def checkpoints(runs: DataFrame, source: str, order: list[str], ok: str, *carried: str) -> DataFrame:
    """Per source what its last good run left in ``carried``, the failures since then, and the seconds to wait."""
    at = F.struct(*order)
    last = runs.groupBy(source).agg(F.max(F.when(F.col(ok), at)).alias("_good"), *[F.max_by(c, F.when(F.col(ok), at)).alias(c) for c in carried])
    since = runs.join(last.select(source, "_good"), source).groupBy(source).agg(F.count(F.when(F.col("_good").isNull() | (at > F.col("_good")), 1)).alias("failures"))
    return last.drop("_good").join(since, source).withColumn("wait", F.when(F.col("failures") > 0, backoff_seconds(F.col("failures"))).otherwise(0))


def retained(rows: DataFrame, admitted: DataFrame, source: str, evidence: str, *withheld: str) -> DataFrame:
    """Rows of admitted sources only; the ``withheld`` columns stay where the source's ``evidence`` may be kept."""
    kept = rows.join(admitted.select(source, F.col(evidence).alias("_evidence")), source)
    return kept.withColumns({c: F.when(F.col("_evidence"), F.col(c)) for c in withheld}).drop("_evidence")


def failure_counts(runs: DataFrame, adapter: str, status: str, classes: dict[str, str]) -> DataFrame:
    """(adapter, class, runs): runs by failure class; ``classes`` has a pattern of the status for each class, in order."""
    found = F.coalesce(*[F.when(F.col(status).rlike(p), F.lit(c)) for c, p in classes.items()], F.lit("other"))
    return runs.groupBy(F.col(adapter).alias("adapter"), found.alias("class")).agg(F.count(F.lit(1)).alias("runs"))
