"""Freshness, integrity, coverage funnels, service levels and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days up to which a source counts as current, and as ageing.
CURRENT_DAYS, AGING_DAYS = 14, 90


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def freshness(at: Column, as_of: Column) -> Column:
    """never_checked, current (also in the future), aging or stale; bounds belong to the fresher class."""
    age = age_days(at, as_of)
    return F.when(at.isNull(), "never_checked").when(age <= CURRENT_DAYS, "current").when(age <= AGING_DAYS, "aging").otherwise("stale")


def time_relation(published: Column, observed: Column) -> Column:
    gap = age_days(published, observed)
    return F.when(published.isNull() | observed.isNull(), "unknown").when(F.abs(gap) <= 1, "same_day").when(gap > 0, "observed_later").otherwise("observed_earlier")


def public_status(current: Column, aging: Column, enabled: Column) -> Column:
    """The state of the whole set: 80 % of the sources decide."""
    return F.when(enabled == 0, "unknown").when(current / enabled >= 0.8, "current").when((current + aging) / enabled >= 0.8, "aging").otherwise("stale")


def cadence(df: DataFrame, kind: str, last: str, as_of: Column, days: dict[str, int], default: int) -> DataFrame:
    """Add ``cadence_met``: whether the last success is no older than its kind allows."""
    allowed = F.lit(default)
    for name, n in days.items():
        allowed = F.when(F.col(kind) == name, n).otherwise(allowed)
    age = age_days(F.col(last), as_of)
    return df.withColumn("cadence_met", F.coalesce(age <= allowed, F.lit(False)))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Add ``stage``: the furthest stage that a row reached; ``stages`` go from the furthest to the first."""
    out = F.lit("none")
    for name, reached in reversed(stages):
        out = F.when(reached, name).otherwise(out)
    return df.withColumn("stage", out)


def first_gap(gaps: list[tuple[str, Column]]) -> Column:
    """The first gap that applies."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in gaps])


def missingness(*columns: str, unknown: str = "unknown") -> list[Column]:
    """present, unknown or missing for each column."""
    return [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), "missing").when(F.col(c).cast("string") == unknown, "unknown").otherwise("present").alias(f"{c}_state") for c in columns]


def priority(df: DataFrame, points: list[tuple[Column, int]]) -> DataFrame:
    """Add ``score``: points of all conditions that hold."""
    return df.withColumn("score", sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0)))


def review_priority(verified_elsewhere: Column, numeric: Column, related: Column, recent: Column) -> Column:
    """1 (first) to 5."""
    return F.when(related & numeric, 1).when(numeric & recent, 2).when(numeric, 3).when(verified_elsewhere, 4).otherwise(5)


def findings(snapshot: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per rule that a one-row snapshot breaks: (code, severity)."""
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]))
    return snapshot.select(F.explode(rows).alias("f")).select("f.code", "f.severity")


def slo(good: Column, total: Column, target: float) -> Column:
    """struct(ratio, met); an empty total has no ratio and counts as met."""
    ratio = F.when(total > 0, good / total)
    return F.struct(F.round(ratio, 4).alias("ratio"), F.coalesce(ratio >= target, F.lit(True)).alias("met"))


def drop_exceeds(now: Column, before: Column, share: float) -> Column:
    """Whether a count fell by more than ``share`` since the baseline."""
    return (before > 0) & ((before - now) / before > share)


def prometheus(df: DataFrame, metric: str, value: str, *labels: str) -> DataFrame:
    """Exposition lines ``metric{label="value"} number``."""
    pairs = [F.concat(F.lit(f'{x}="'), F.replace(F.replace(F.col(x).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for x in labels]
    body = F.concat(F.lit(metric + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string"))
    return df.select(body.alias("line"))


def integrity_counts(**broken: DataFrame) -> DataFrame:
    """(code, n): how many rows each table of broken rows has; a table without rows counts zero."""
    lines = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n") for code, df in broken.items()]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out


def identity_band(confirmed: Column, sources: Column, ambiguous: Column) -> Column:
    """How sure a person's identity is: ambiguous, confirmed, likely or none."""
    return F.when(F.coalesce(ambiguous, F.lit(False)), "ambiguous").when(confirmed > 0, "confirmed").when(sources > 0, "likely").otherwise("none")


def coverage_shape(channels: Column) -> Column:
    """single, paired or broad, by the number of channels in which a person is seen; none without any."""
    return F.when(channels <= 0, "none").when(channels == 1, "single").when(channels == 2, "paired").otherwise("broad")


def recency(last: Column, as_of: Column, days: list[tuple[str, int]], older: str = "older") -> Column:
    """The first bucket that the age in whole days fits in; never for a null time."""
    age = F.datediff(as_of, last)
    return F.when(last.isNull(), "never").otherwise(F.coalesce(*[F.when(age <= n, F.lit(name)) for name, n in days], F.lit(older)))
