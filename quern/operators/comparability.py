"""When two forecasts answer the same question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phrase(column: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def deadline(start: Column, end: Column, horizon: Column) -> Column:
    """struct(kind, start, end): ``deadline``, ``absent`` or ``ambiguous``, from structured dates and years in text."""
    years = F.array_distinct(F.regexp_extract_all(F.coalesce(horizon, F.lit("")), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)))
    n = F.size(years)
    dated = start.isNotNull() | end.isNotNull()
    said = F.coalesce(F.year(end), F.year(start)).cast("string")
    conflict = (dated & (n > 0) & ((n > 1) | (F.get(years, F.lit(0)) != said))) | (~dated & (n > 1)) | (start > end)
    single = F.make_date(F.get(years, F.lit(0)).cast("int"), F.lit(12), F.lit(31))
    kind = F.when(conflict, "ambiguous").when(dated | (n == 1), "deadline").otherwise("absent")
    open_ = F.coalesce(conflict, F.lit(False))
    return F.struct(kind.alias("kind"), F.when(~open_, start).alias("start"), F.when(~open_, F.when(dated, end).otherwise(F.when(n == 1, single))).alias("end"))


def semantics(kind: Column, unit: Column) -> Column:
    """What a forecast's value means, from its kind and unit."""
    return F.when(kind == "qualitative", "qualitative").when(unit == "probability", "probability").when(unit == "year", "timeline").when(unit.isNotNull(), "quantity")


def outcome_conflict(text: Column, outcome: Column, patterns: dict[str, str]) -> Column:
    """Whether a text names other outcomes than ``outcome`` and not this one.

    ``patterns``: a regular expression per outcome. A text that names the own outcome too, or none, is no conflict.
    """
    said = F.coalesce(text, F.lit(""))
    own = F.coalesce(*[F.when(outcome == k, said.rlike(p)) for k, p in patterns.items()], F.lit(False))
    other = F.lit(False)
    for k, p in patterns.items():
        other = other | (said.rlike(p) & ~outcome.eqNullSafe(F.lit(k)))
    return (said != "") & ~own & other


def split_outcome(text: Column, patterns: dict[str, str]) -> Column:
    """The outcome of a question that holds several: the one whose pattern alone fits ``text``; else null."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def comparison(found: Column, target: Column) -> Column:
    """struct(match, reason): whether a classified forecast answers the target question, and else the first reason why not.

    ``found``: exact_id, poolable, reason, stored_id (a stored exact key or null), family, outcome, deadline,
    conditional, unit. ``target``: exact_id, family, outcome, deadline (null if it is not part of the question),
    conditional, unit.
    """
    both = lambda f: found[f].isNotNull() & target[f].isNotNull() & (found[f] != target[f])
    match = F.coalesce(found["poolable"], F.lit(False)) & found["exact_id"].eqNullSafe(target["exact_id"])
    reason = (
        F.when(match, F.lit(None).cast("string"))
        .when(found["stored_id"] != target["exact_id"], "different_question")
        .when(~found["family"].eqNullSafe(target["family"]), "different_question")
        .when(found["reason"].isNotNull(), found["reason"])
        .when(~found["outcome"].eqNullSafe(target["outcome"]), "definition_mismatch")
        .when(both("deadline"), "deadline_mismatch")
        .when(found["conditional"] & ~target["conditional"], "condition_mismatch")
        .when(both("unit"), "unit_mismatch")
        .otherwise("insufficient_agreement")
    )
    return F.struct(match.alias("match"), reason.alias("reason"))


def bound_phrase(text: Column) -> Column:
    """A value that only bounds: "at least 10"."""
    return F.coalesce(text.rlike(r"(?i)^\s*(?:at least|at most|more than|less than|over|under|no more than|no less than|>=?|<=?|≥|≤)"), F.lit(False))


def classify(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``poolable``, ``exact_id`` and ``reason``.

    ``rows``: id, family, semantics, unit, condition, deadline_kind, deadline. ``registry``: exact_id,
    family, semantics, unit, conditional, deadline (null: any). Exactly one registered question of
    the family may fit; a family without registered questions pools under an identity of its own.
    """
    # one row per family, so rows are neither multiplied nor grouped again
    r = registry.groupBy("family").agg(F.collect_list(F.struct("exact_id", "semantics", "unit", "conditional", "deadline")).alias("_questions"))

    def fits(q: Column) -> Column:
        return (
            (F.col("semantics") == q.semantics)
            & F.col("unit").eqNullSafe(q.unit)
            & (F.col("condition").isNotNull() == q.conditional)
            & (q.deadline.isNull() | F.col("deadline").eqNullSafe(q.deadline))
        )

    held = F.coalesce(F.col("_questions"), F.array().cast(r.schema["_questions"].dataType))
    found = rows.join(r, "family", "left").withColumn("_registered", F.size(held)).withColumn("_found", F.filter(held, fits)).drop("_questions")
    found = found.withColumn("_fits", F.size("_found")).withColumn("_one", F.array_min(F.transform("_found", lambda q: q.exact_id))).drop("_found")
    own = F.concat_ws("|", "family", "semantics", F.coalesce("unit", F.lit("")), F.when(F.col("condition").isNull(), "unconditional").otherwise(F.concat(F.lit("if "), phrase(F.col("condition")))), F.coalesce(F.col("deadline").cast("string"), F.lit("open")))
    timed = F.col("semantics") == "probability"
    reason = (
        F.when(F.col("family").isNull() | F.col("semantics").isNull() | (F.col("unit").isNull() & (F.col("semantics") != "qualitative")), "insufficient_agreement")
        .when(timed & (F.col("deadline_kind") == "ambiguous"), "ambiguous_horizon")
        .when(timed & (F.col("_registered") > 0) & (F.col("deadline_kind") == "absent"), "ambiguous_horizon")
        .when(F.col("_fits") > 1, "insufficient_agreement")
    )
    named = found.withColumn("reason", reason).withColumn("poolable", F.col("reason").isNull())
    return named.withColumn("exact_id", F.when(F.col("poolable"), F.coalesce("_one", own))).drop("_registered", "_fits", "_one")


def resolution_gaps(**checks: Column) -> Column:
    """Names of the checks that fail, in the order given."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
