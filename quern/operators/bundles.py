"""Rules of an evidence bundle that look across records: snapshots and their closure, translations, aggregates, answers, resolutions.

Records are rows keyed by (id, revision); references are rows (id, revision, to_id, to_revision), a revision's
predecessor among them. Every rule is a join or a column, and gives rows (..., code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import written

KEY = ["id", "revision"]
#: Kinds of values (fixed values).
NUMERIC = ("point", "interval", "quantiles", "lower_bound", "upper_bound")
INEXACT = ("quantiles", "date_quantiles", "lower_bound", "upper_bound", "interval")
CURRENCIES = ("currency_nominal", "currency_constant")


def _codes(rules: dict[str, Column]) -> Column:
    """The codes of the rules that are broken, in order; a rule that is null is not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()]))


def _rows(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    return df.select(*keys, F.explode(_codes(rules)).alias("code"))


def digest(c: Column) -> Column:
    """A digest as bytes, half as long as in hexadecimal; different texts have different bytes, whatever they are."""
    return F.when(c.rlike(r"^(?:[0-9a-f]{2})*\z"), F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8")))


def closure(seeds: DataFrame, references: DataFrame, records: DataFrame, bundle: str, cutoff: Column) -> DataFrame:
    """(bundle, id, revision, depth): what each bundle's seeds (bundle, id, revision) need, directly or through others.

    Revisions that were not known at ``cutoff``, or that are not there at all, are neither taken nor followed.
    Each round joins only what the round before has found first, so a record is expanded once in a
    bundle, and a reference back into it ends there; rounds are as many as the longest way and are written
    to the shared folder.
    """
    known = records.where(F.col("known_at") <= cutoff).select(*KEY).distinct()
    steps = references.join(known.withColumnsRenamed({"id": "to_id", "revision": "to_revision"}), ["to_id", "to_revision"]).select(*KEY, "to_id", "to_revision").distinct()
    new = written(seeds.select(bundle, *KEY).distinct().join(known, KEY).select(bundle, *KEY, F.lit(0).alias("depth")))
    found = new
    while not new.isEmpty():
        ahead = new.join(steps, KEY).select(bundle, F.col("to_id").alias("id"), F.col("to_revision").alias("revision"), (F.col("depth") + 1).alias("depth")).distinct()
        new = written(ahead.join(found, [bundle, *KEY], "left_anti"))
        found = found.unionByName(new)
    return found


def snapshot_errors(snapshots: DataFrame, members: DataFrame, records: DataFrame, references: DataFrame) -> DataFrame:
    """(snapshot, id, revision, code) of each rule that a snapshot (null member) or one of its members breaks.

    ``snapshots``: snapshot, as_known, cutoff, created_at, known_at; ``members``: snapshot, id, revision, sha256;
    ``records``: id, revision, kind, known_at, reviewed_at, latest (the last time a forecast may be of), sha256.
    A member that is no record is a missing reference, and told by that rule.
    """
    none = [F.lit(None).cast(members.schema[c].dataType).alias(c) for c in KEY]
    times = (F.col("cutoff") > F.col("created_at")) | (F.col("created_at") > F.col("known_at"))
    whole = _rows(snapshots.select("snapshot", *none, "cutoff", "created_at", "known_at"), ["snapshot", *KEY], {"snapshot_time": times})
    # one shuffle by record serves counts of members and what they need
    held = members.select("snapshot", *KEY).repartition(*KEY)
    twice = held.groupBy("snapshot", *KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("snapshot").distinct().select("snapshot", *none, F.lit("snapshot_duplicate").alias("code"))

    there = records.select(*KEY, (F.col("kind") == "forecast").alias("_forecast"), F.col("known_at").alias("_known"), "reviewed_at", "latest", digest(F.col("sha256")).alias("_digest"))
    compared = members.select("snapshot", *KEY, digest(F.col("sha256")).alias("_own")).join(there, KEY).withColumn("_differs", F.col("_own") != F.col("_digest")).drop("_own", "_digest")
    met = compared.join(snapshots.select("snapshot", "as_known", "cutoff"), "snapshot")
    cut = F.col("cutoff")
    rules = {
        "snapshot_hash": F.col("_differs"),
        "snapshot_cutoff": F.col("_known") > cut,
        "snapshot_forecast_time": F.col("as_known") & F.col("_forecast") & (F.col("latest").isNull() | (F.col("latest") > cut)),
        "snapshot_review": F.col("as_known") & (F.col("reviewed_at") > cut),
    }
    own = _rows(met, ["snapshot", *KEY], rules)
    needs = held.distinct().join(records.select(*KEY), KEY, "left_semi").join(references.select(*KEY, "to_id", "to_revision"), KEY)
    there_too = members.select("snapshot", F.col("id").alias("to_id"), F.col("revision").alias("to_revision"))
    open_ = needs.join(there_too, ["snapshot", "to_id", "to_revision"], "left_anti").select("snapshot", *KEY).distinct().withColumn("code", F.lit("snapshot_closure"))
    return whole.unionByName(twice).unionByName(own).unionByName(open_)


def translation_errors(artifacts: DataFrame, statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, revision, code) of translations that lead to another translation or to themselves, and of statements that cite past them.

    ``artifacts``: id, revision, original_id, original_revision (null: no translation); ``statements``: id,
    revision, translation_id, translation_revision; ``evidence``: id, revision, source_id, source_revision.
    What refers to no artifact is a missing reference, and told by that rule.
    """
    is_translation = artifacts.select(F.col("id").alias("_id"), F.col("revision").alias("_revision"), F.col("original_id").alias("_original"), F.col("original_revision").alias("_original_revision"))
    first = artifacts.where(F.col("original_id").isNotNull()).join(is_translation, (F.col("original_id") == F.col("_id")) & (F.col("original_revision") == F.col("_revision")))
    lineage = _rows(first, KEY, {"translation_lineage": (F.col("_id") == F.col("id")) | F.col("_original").isNotNull()})

    met = statements.where(F.col("translation_id").isNotNull()).join(is_translation, (F.col("translation_id") == F.col("_id")) & (F.col("translation_revision") == F.col("_revision")))
    kind = _rows(met, KEY, {"translation_type": F.col("_original").isNull()})
    cited = evidence.select(*KEY, F.col("source_id").alias("_original"), F.col("source_revision").alias("_original_revision"))
    past = met.where(F.col("_original").isNotNull()).join(cited, [*KEY, "_original", "_original_revision"], "left_anti")
    return lineage.unionByName(kind).unionByName(past.select(*KEY, F.lit("translation_evidence").alias("code")))


def aggregate_errors(forecasts: DataFrame, forecasters: DataFrame, actors: DataFrame) -> DataFrame:
    """(id, revision, code) of forecasts that mix up a population with who publishes its answers.

    ``forecasts``: id, revision, aggregation, method, population_id, population_revision, aggregator_id,
    aggregator_revision; ``forecasters``: id, revision, actor_id, actor_revision; ``actors``: id, revision, actor_kind.
    """
    kind = lambda name: actors.select(F.col("id").alias(f"{name}_id"), F.col("revision").alias(f"{name}_revision"), F.col("actor_kind").alias(f"{name}_kind"))
    on = lambda name: [f"{name}_id", f"{name}_revision"]
    named = forecasters.join(kind("actor"), on("actor"), "left")
    # of a forecast's forecasters: how many, how many collective ones, and the one if there is one
    who = named.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("actor_kind") == "collective"), F.lit(False)).alias("collective"), F.min(F.struct("actor_id", "actor_revision")).alias("one"))
    met = forecasts.join(who, KEY, "left").join(kind("population"), on("population"), "left").join(kind("aggregator"), on("aggregator"), "left")
    c = F.col
    source = c("aggregation") == "source_aggregate"
    context = c("population_id").isNotNull() | c("aggregator_id").isNotNull()
    with_context = source & context
    alone = (F.coalesce(c("n"), F.lit(0)) == 1) & (c("one.actor_id") == c("population_id")) & (c("one.actor_revision") == c("population_revision"))
    rules = {
        "aggregation_method": (c("aggregation") != "none") != c("method").isNotNull(),
        "collective_aggregate": c("collective") & ~source,
        "aggregate_context": source != context,
        "aggregate_population": with_context & ~F.coalesce(c("population_kind") == "collective", F.lit(False)),
        "aggregate_publisher": with_context & ~c("aggregator_kind").isin("person", "organization"),
        "aggregate_attribution": with_context & (~F.coalesce(alone, F.lit(False)) | ((c("population_id") == c("aggregator_id")) & (c("population_revision") == c("aggregator_revision")))),
    }
    return _rows(met, KEY, rules)


def resolution_errors(status: Column, outcome_kind: Column, resolved_at: Column, adjudicators: Column, review_state: Column, known_at: Column, domain: Column) -> Column:
    """Codes of the rules that a resolution breaks; ``adjudicators`` is their number, ``domain`` the question's."""
    resolved, has_outcome, has_time = status == "resolved", outcome_kind.isNotNull(), resolved_at.isNotNull()
    rules = {
        "resolution_state": F.when(resolved, ~(has_outcome & has_time)).otherwise(has_outcome | has_time),
        "resolution_review": resolved & ((adjudicators == 0) | (review_state != "human_verified")),
        "resolution_time": resolved & (resolved_at > known_at),
        "resolution_outcome": resolved & ((outcome_kind == "missing") | outcome_kind.isin(*INEXACT) | ((domain == "probability") & (outcome_kind != "boolean"))),
    }
    return _codes(rules)


def answer_errors(domain: Column, question_unit: Column, kind: Column, unit: Column, origin: Column, earliest: Column, known_at: Column) -> Column:
    """Codes of the rules that a forecast's answer breaks; ``earliest`` is the first time that it may be of, if known."""
    given, numeric = kind != "missing", kind.isin(*NUMERIC)
    dated = kind.isin("date_point", "date_quantiles") | (numeric & (unit == "calendar_year"))
    fits = F.when(domain.isin("probability", "quantity"), numeric & unit.eqNullSafe(question_unit)).when(domain == "date", F.coalesce(dated, F.lit(False))).when(domain == "qualitative", kind == "category").otherwise(True)
    rules = {
        "answer_domain": given & ~fits,
        "forecast_time": earliest > known_at,
        "invented_precision": (origin == "explicit_qualitative") & ~kind.isin("category", "missing"),
        "forecast_origin": (origin == "explicit_numeric") & kind.isin("category", "boolean"),
    }
    return _codes(rules)


def measurement_errors(kind: Column, unit: Column, numbers: Column, inclusive: Column, metric_unit: Column, low: Column, high: Column) -> Column:
    """Codes of the rules that a measurement breaks against its metric: type, unit, and the scale ``low`` to ``high``."""
    bound = F.get(numbers, F.lit(0))
    outside = F.exists(numbers, lambda n: F.coalesce(n < low, F.lit(False)) | F.coalesce(n > high, F.lit(False)))
    rules = {
        "measurement_type": ~kind.isin(*NUMERIC, "missing"),
        "metric_unit": unit != metric_unit,
        "empty_bound": ~inclusive & (((kind == "upper_bound") & (bound <= low)) | ((kind == "lower_bound") & (bound >= high))),
        "metric_scale": F.coalesce(low > high, F.lit(False)) | F.coalesce(outside, F.lit(False)),
    }
    return _codes(rules)


def kind_errors(kind: Column, domain: Column, answer_unit: Column, actor_kind: Column, has_population: Column, unit: Column, price_basis: Column, base_year: Column, evaluated: Column, full: Column, threshold_kind: Column, threshold_unit: Column) -> Column:
    """Codes of the rules that belong to one kind of record: questions, actors, resources, runs and safety evaluations."""
    money = unit.isin(*CURRENCIES)
    expected = F.when(unit == "currency_constant", "constant").otherwise("nominal")
    rules = {
        "question_unit": (kind == "forecast_question") & ((domain.isin("probability", "quantity") != answer_unit.isNotNull()) | ((domain == "probability") & ~answer_unit.eqNullSafe(F.lit("probability")))),
        "collective_identity": (kind == "actor") & ((actor_kind == "collective") != has_population),
        "currency_basis": (kind == "resource_observation") & ((money != price_basis.isNotNull()) | (money & ((price_basis != expected) | ((expected == "constant") & base_year.isNull())))),
        "evaluation_time": kind.isin("benchmark_run", "safety_evaluation") & evaluated.isNull() & full,
        "threshold_unit": (kind == "safety_evaluation") & threshold_kind.isNotNull() & (~threshold_kind.isin(*NUMERIC) | ~threshold_unit.eqNullSafe(unit)),
    }
    return _codes(rules)
