"""Trend reducers: latest view per person, gated summaries and revision chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_POINTS = 3


def latest_per_key(df: DataFrame, keys: list[str], at: Column, tiebreak: str) -> DataFrame:
    """The newest row of each key; rows without a time come last and the smaller ``tiebreak`` wins a tie."""
    w = Window.partitionBy(*keys).orderBy(at.desc_nulls_last(), F.col(tiebreak).asc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def gated_summary(df: DataFrame, keys: list[str], value: str, least: int = MIN_POINTS) -> DataFrame:
    """People, points and, from ``least`` points on, the smallest, largest and median value."""
    v = F.col(value)
    shown = F.count(v) >= least
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("people"),
        F.count(v).alias("points"),
        F.when(shown, F.min(v)).alias("low"),
        F.when(shown, F.max(v)).alias("high"),
        F.when(shown, F.median(v)).alias("middle"),
        F.when(F.count(v) == 0, "empty").when(~shown, "sparse").otherwise("comparable").alias("density"),
    )


def cross_section(df: DataFrame, question: str, person: str, value: str, at: Column, tiebreak: str) -> DataFrame:
    """One row per question: the latest value of each person, summarised."""
    return gated_summary(latest_per_key(df, [question, person], at, tiebreak), [question], value)


def exclusion_reason(key_matches: Column, comparable: Column, topic_fits: Column, explicit: Column, verified: Column, forecast_verified: Column, has_key: Column, condition_fits: Column, unit_fits: Column, horizon_fits: Column, other_question: Column, decision_reason: Column, bound: Column, has_value: Column) -> Column:
    """Why a row in scope is not used, the first reason that holds; null if it is used."""
    filters = F.when(~condition_fits, "conditionality_mismatch").when(~unit_fits, "unit_mismatch").when(~horizon_fits, "missing_horizon")
    agreement = F.when(~comparable & other_question, "question_key_mismatch").when(~comparable, F.coalesce(decision_reason, F.lit("insufficient_agreement")))
    return F.coalesce(
        F.when(~key_matches & ~comparable & ~topic_fits, "topic_not_target"),
        F.when(~explicit, "statement_type"),
        F.when(~verified, "review_state"),
        F.when(~forecast_verified, "review_state"),
        F.when(~has_key, "missing_forecast"),
        F.when(key_matches, filters),
        agreement,
        F.when(~key_matches, filters),
        F.when(bound, "value_type_not_point"),
        F.when(~has_value, "value_type_not_point"),
    )


def in_scope(key_matches: Column, comparable: Column, topic_fits: Column, sibling_topic: Column) -> Column:
    """Rows outside are neither used nor excluded."""
    return key_matches | comparable | topic_fits | sibling_topic


def forward_edges(edges: DataFrame, rows: DataFrame, id: str, person: str, question: str, at: str, state: str) -> DataFrame:
    """Edges (from_id, to_id, type, state) with both ends joined: ``same_person`` and ``reviewed_forward``.

    An edge counts as reviewed and forward if it and its target are verified and its target is later.
    """
    f = rows.select(F.col(id).alias("from_id"), F.col(person).alias("_from_person"), F.col(question).alias("question"), F.col(at).alias("_from_at"))
    t = rows.select(F.col(id).alias("to_id"), F.col(person).alias("_to_person"), F.col(at).alias("_to_at"), F.col(state).alias("_to_state"))
    joined = edges.join(f, "from_id").join(t, "to_id")
    forward = (F.col("state") == "human_verified") & (F.col("_to_state") == "human_verified") & F.coalesce(F.col("_to_at") > F.col("_from_at"), F.lit(False))
    return joined.select("from_id", "to_id", "type", "question", (F.col("_from_person") == F.col("_to_person")).alias("same_person"), forward.alias("reviewed_forward"))


def reduce_latest(eligible: DataFrame, edges: DataFrame, id: str, person: str, question: str, at: str, value: str) -> DataFrame:
    """Eligible rows with ``outcome``: included, or why dropped.

    Per question and person the latest row is picked first and dropped if it is withdrawn; an
    older value does not come back. ``edges`` come from ``forward_edges``.
    """
    alive = eligible.select(F.col(id).alias("to_id"), F.lit(True).alias("_alive"))
    good = edges.where("same_person and reviewed_forward").join(alive, "to_id", "left")
    flags = good.groupBy(F.col("from_id").alias(id)).agg(
        F.max((F.col("type") == "withdraws") | ((F.col("type") == "retracts") & F.col("_alive").isNull())).alias("_withdrawn"),
        F.max(F.col("type").isin("updates", "retracts") & F.col("_alive").isNotNull()).alias("_replaced"),
    )
    w = Window.partitionBy(question, person)
    order = w.orderBy(F.col(at).desc_nulls_last(), F.col(id).asc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = eligible.join(flags, id, "left").withColumn("_withdrawn", F.coalesce("_withdrawn", F.lit(False))).withColumn("_replaced", F.coalesce("_replaced", F.lit(False)))
    rows = rows.select("*", F.row_number().over(order).alias("_n"), F.first(at).over(whole).alias("_pick_at"), F.first(value).over(whole).alias("_pick_value"), F.first("_withdrawn").over(whole).alias("_pick_withdrawn"))
    same = F.col(at).eqNullSafe(F.col("_pick_at")) & F.col(value).eqNullSafe(F.col("_pick_value"))
    outcome = F.when(F.col("_withdrawn"), "withdrawn").when(F.col("_n") == 1, "included").when(~F.col("_pick_withdrawn") & same, "duplicate_statement").when(F.col("_replaced"), "superseded").otherwise("not_latest")
    return rows.withColumn("outcome", outcome).drop("_n", "_pick_at", "_pick_value", "_pick_withdrawn", "_withdrawn", "_replaced")


def coverage(included: DataFrame, question: str, person: str, at: str, cohort_size: int) -> DataFrame:
    """People, members without a row, and the time window of each question."""
    return included.groupBy(question).agg(F.countDistinct(person).alias("people"), F.greatest(F.lit(0), F.lit(cohort_size) - F.countDistinct(person)).alias("missing"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def revision_edges(edges: DataFrame, eligible: DataFrame, id: str, changes: tuple[str, ...] = ("updates", "retracts", "clarifies"), withdrawals: bool = True) -> DataFrame:
    """Edges of ``forward_edges`` (which need ``verified``) as link, withdrawal or repeat, or the reason why not."""
    a = eligible.select(F.col(id).alias("from_id"), F.lit(True).alias("_from"))
    b = eligible.select(F.col(id).alias("to_id"), F.lit(True).alias("_to"))
    e = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    from_ok, to_ok, kind = F.col("_from").isNotNull(), F.col("_to").isNotNull(), F.col("type")
    relevant = kind.isin(*changes, "withdraws", "repeats")
    gone = kind.isin("withdraws", "retracts") & F.lit(withdrawals) & from_ok & ((kind == "withdraws") | ~to_ok)
    outcome = (
        F.when(relevant & ~F.col("reviewed_forward"), "not_reviewed_forward")
        .when(gone & F.col("same_person"), "withdrawal")
        .when(gone, "different_person")
        .when(kind == "repeats", F.when(from_ok & to_ok & F.col("same_person"), "repeat").otherwise("ignored"))
        .when(~kind.isin(*changes), "relationship_not_a_revision")
        .when(from_ok & to_ok & F.col("same_person"), "link")
        .when(from_ok & to_ok, "different_person")
        .otherwise("ignored")
    )
    return e.withColumn("outcome", outcome).drop("_from", "_to")


def chains(links: DataFrame) -> DataFrame:
    """Components of links (from_id, to_id): (node, root, size)."""
    from quern.operators.components import components
    from quern.operators.joins import joined_hot

    found = components(links, "from_id", "to_id")
    # sizes meet their nodes in a join, so a large chain is no window of one task
    return joined_hot(found, found.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root", "node").select("node", "root", "size")


def volume(rows: DataFrame, at: str, statement: str, person: str, *by: str) -> DataFrame:
    """Statements and people per UTC quarter and group; undated rows are left out."""
    q = F.format_string("%d-Q%d", F.year(at), F.quarter(at))
    return rows.where(F.col(at).isNotNull()).groupBy(q.alias("quarter"), *by).agg(F.countDistinct(statement).alias("statements"), F.countDistinct(person).alias("people"))


def discover_questions(rows: DataFrame, key: str, person: str, statement: str, taken: list[str], least: int = MIN_POINTS) -> DataFrame:
    """Questions with enough people that no prepared method covers; the sample is the smallest statement."""
    found = rows.where(~F.col(key).isin(taken)).groupBy(key).agg(F.countDistinct(person).alias("people"), F.count(F.lit(1)).alias("statements"), F.min(statement).alias("sample"))
    return found.where(F.col("people") >= least)


def unique_exclusions(items: DataFrame, slug: str, reason: str) -> DataFrame:
    """Each (slug, reason) once, however often a row was excluded for it."""
    return items.dropDuplicates([slug, reason])
