"""Trend, comparability and review-state queries over the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import comparability, semantics, trends
from quern.plans.registry import query
from quern.session import table


@query(
    "tr_cross_section",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC NULLS LAST, event_id) AS rn FROM events)
SELECT event_type AS question, count(*) AS people, count(value) AS points,
       CASE WHEN count(value) >= 3 THEN min(value) END AS low,
       CASE WHEN count(value) >= 3 THEN max(value) END AS high,
       CASE WHEN count(value) >= 3 THEN median(value) END AS middle,
       CASE WHEN count(value) = 0 THEN 'empty' WHEN count(value) < 3 THEN 'sparse' ELSE 'comparable' END AS density
FROM r WHERE rn = 1 GROUP BY 1""",
)
def tr_cross_section(spark, sf):
    events = table(spark, sf, "events")
    return trends.cross_section(events, question="event_type", person="user_id", value="value", at=F.col("ts"), tiebreak="event_id").withColumnRenamed("event_type", "question")


@query(
    "sem_effective_state",
    """
WITH s AS (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 0 THEN 'human_verified' WHEN 1 THEN 'machine_validated' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'rejected' ELSE 'unreviewed' END AS stored FROM documents),
l AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'human_verified' ELSE 'needs_review' END AS result, CASE WHEN l.doc_id % 3 = 0 THEN n_chars ELSE n_chars + 1 END AS accepted, row_number() OVER (PARTITION BY l.doc_id ORDER BY quality DESC, toxic DESC) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT s.doc_id, CASE WHEN l.doc_id IS NOT NULL AND (result <> 'human_verified' OR accepted = n_chars) THEN result WHEN l.doc_id IS NOT NULL AND stored = 'human_verified' THEN 'needs_review' ELSE stored END AS effective_state
FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND l.n = 1""",
)
def sem_effective_state(spark, sf):
    return _effective(spark, sf).select("doc_id", "effective_state")


def _effective(spark, sf):
    names = ["human_verified", "machine_validated", "needs_review", "rejected", "unreviewed"]
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("claim"), F.element_at(F.lit(names).cast("array<string>"), (F.col("doc_id") % 5 + 1).cast("int")).alias("stored"))
    result = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "human_verified").otherwise("needs_review")
    accepted = F.when(F.col("doc_id") % 3 == 0, F.col("claim")).otherwise(F.col("claim") + 1)
    decisions = table(spark, sf, "labels").join(d.select("doc_id", "claim"), "doc_id").select("doc_id", "quality", "toxic", result.alias("result"), accepted.alias("accepted"))
    return semantics.effective_states(d, decisions, "doc_id", "stored", "claim", "quality", "toxic", "result", "accepted")


@query(
    "sem_visibility",
    """
WITH e AS (WITH s AS (SELECT doc_id, source, n_chars, CASE doc_id % 5 WHEN 0 THEN 'human_verified' WHEN 1 THEN 'machine_validated' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'rejected' ELSE 'unreviewed' END AS stored FROM documents),
l AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'human_verified' ELSE 'needs_review' END AS result, CASE WHEN l.doc_id % 3 = 0 THEN n_chars ELSE n_chars + 1 END AS accepted, row_number() OVER (PARTITION BY l.doc_id ORDER BY quality DESC, toxic DESC) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT s.doc_id, source, CASE WHEN l.doc_id IS NOT NULL AND (result <> 'human_verified' OR accepted = n_chars) THEN result WHEN l.doc_id IS NOT NULL AND stored = 'human_verified' THEN 'needs_review' ELSE stored END AS st FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND l.n = 1)
SELECT source, count(*) FILTER (WHERE st IN ('needs_review','machine_validated','human_verified')) AS on_site, count(*) FILTER (WHERE st IN ('machine_validated','human_verified')) AS in_research, count(*) AS all_rows FROM e GROUP BY 1""",
)
def sem_visibility(spark, sf):
    e = _effective(spark, sf).withColumn("source_state", F.lit("human_verified"))
    yes = F.lit(True)
    count = lambda c: F.count(F.when(c, 1))
    return e.groupBy("source").agg(count(semantics.on_site("effective_state", "source_state", yes)).alias("on_site"), count(semantics.in_research("effective_state", "source_state", yes)).alias("in_research"), F.count(F.lit(1)).alias("all_rows"))


# ---- candidates from events: a user states a value for an event type

_CANDIDATES = """
c AS (SELECT event_id, user_id, event_type, value, ts, CASE WHEN event_id % 11 = 0 THEN 'qualitative' ELSE 'explicit_numeric' END AS type,
  CASE WHEN event_id % 7 = 0 THEN 'needs_review' ELSE 'human_verified' END AS state, CASE WHEN event_id % 13 = 0 THEN 'percent' ELSE 'year' END AS unit,
  CASE WHEN event_id % 17 = 0 THEN 'if so' END AS condition, CASE WHEN event_id % 19 <> 0 THEN event_type END AS key FROM events)"""


def _candidates(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "ts",
        F.when(i % 11 == 0, "qualitative").otherwise("explicit_numeric").alias("type"),
        F.when(i % 7 == 0, "needs_review").otherwise("human_verified").alias("state"),
        F.when(i % 13 == 0, "percent").otherwise("year").alias("unit"),
        F.when(i % 17 == 0, "if so").alias("condition"),
        F.when(i % 19 != 0, F.col("event_type")).alias("key"),
    )


_REASON = """
CASE WHEN type <> 'explicit_numeric' THEN 'statement_type' WHEN state <> 'human_verified' THEN 'review_state' WHEN key IS NULL THEN 'missing_forecast'
 WHEN condition IS NOT NULL THEN 'conditionality_mismatch' WHEN unit <> 'year' THEN 'unit_mismatch' WHEN value IS NULL THEN 'value_type_not_point' END"""


def _partitioned(spark, sf):
    yes, no = F.lit(True), F.lit(False)
    has_key = F.col("key").isNotNull()
    reason = trends.exclusion_reason(
        key_matches=has_key, comparable=has_key, topic_fits=yes, explicit=F.col("type") == "explicit_numeric", verified=F.col("state") == "human_verified", forecast_verified=yes, has_key=has_key,
        condition_fits=F.col("condition").isNull(), unit_fits=F.col("unit") == "year", horizon_fits=yes, other_question=no, decision_reason=F.lit(None).cast("string"), bound=no, has_value=F.col("value").isNotNull(),
    )
    return _candidates(spark, sf).withColumn("reason", reason)


@query("tr_exclusions", f"WITH {_CANDIDATES} SELECT event_type AS question, coalesce({_REASON}, 'eligible') AS reason, count(*) AS n FROM c GROUP BY 1, 2")
def tr_exclusions(spark, sf):
    return _partitioned(spark, sf).groupBy(F.col("event_type").alias("question"), F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_EDGES = """
p AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM c),
g AS (SELECT prev AS from_id, event_id AS to_id, CASE event_id % 4 WHEN 0 THEN 'updates' WHEN 1 THEN 'retracts' WHEN 2 THEN 'withdraws' ELSE 'repeats' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'machine_validated' ELSE 'human_verified' END AS estate FROM p WHERE prev IS NOT NULL),
f AS (SELECT g.*, a.user_id = b.user_id AS same_person, estate = 'human_verified' AND b.state = 'human_verified' AND b.ts > a.ts AS fwd FROM g JOIN c a ON a.event_id = from_id JOIN c b ON b.event_id = to_id)"""


def _edges(spark, sf):
    c = _candidates(spark, sf)
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    kinds = F.lit(["updates", "retracts", "withdraws", "repeats"]).cast("array<string>")
    e = c.select(F.lag("event_id").over(w).alias("from_id"), F.col("event_id").alias("to_id")).where("from_id is not null")
    e = e.select("from_id", "to_id", F.element_at(kinds, (F.col("to_id") % 4 + 1).cast("int")).alias("type"), F.when(F.col("to_id") % 5 == 0, "machine_validated").otherwise("human_verified").alias("state"))
    return trends.forward_edges(e, c, "event_id", "user_id", "event_type", "ts", "state")


_REDUCED = f"""
e AS (SELECT * FROM c WHERE {_REASON} IS NULL),
m AS (SELECT from_id AS event_id, bool_or(kind = 'withdraws' OR (kind = 'retracts' AND e.event_id IS NULL)) AS withdrawn, bool_or(kind IN ('updates','retracts') AND e.event_id IS NOT NULL) AS replaced FROM f LEFT JOIN e ON e.event_id = f.to_id WHERE same_person AND fwd GROUP BY 1),
r AS (SELECT e.*, coalesce(withdrawn, false) AS withdrawn, coalesce(replaced, false) AS replaced FROM e LEFT JOIN m ON m.event_id = e.event_id),
o AS (SELECT *, row_number() OVER w AS n, first_value(ts) OVER w AS pts, first_value(value) OVER w AS pv, first_value(withdrawn) OVER w AS pw FROM r WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts DESC NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, CASE WHEN withdrawn THEN 'withdrawn' WHEN n = 1 THEN 'included' WHEN NOT pw AND ts IS NOT DISTINCT FROM pts AND value IS NOT DISTINCT FROM pv THEN 'duplicate_statement' WHEN replaced THEN 'superseded' ELSE 'not_latest' END AS outcome FROM o)"""


def _reduced(spark, sf):
    eligible = _partitioned(spark, sf).where("reason is null")
    return trends.reduce_latest(eligible, _edges(spark, sf), "event_id", "user_id", "event_type", "ts", "value")


@query("tr_reduction", f"WITH {_CANDIDATES}, {_EDGES}, {_REDUCED} SELECT event_id, outcome FROM x")
def tr_reduction(spark, sf):
    return _reduced(spark, sf).select("event_id", "outcome")


@query("tr_numeric_result", f"WITH {_CANDIDATES}, {_EDGES}, {_REDUCED} SELECT event_type AS question, count(*) AS people, count(value) AS points, CASE WHEN count(value) >= 3 THEN min(value) END AS low, CASE WHEN count(value) >= 3 THEN max(value) END AS high, CASE WHEN count(value) >= 3 THEN median(value) END AS middle, CASE WHEN count(value) = 0 THEN 'empty' WHEN count(value) < 3 THEN 'sparse' ELSE 'comparable' END AS density FROM x WHERE outcome = 'included' GROUP BY 1")
def tr_numeric_result(spark, sf):
    return trends.gated_summary(_reduced(spark, sf).where("outcome = 'included'"), ["event_type"], "value").withColumnRenamed("event_type", "question")


@query("tr_coverage", f"WITH {_CANDIDATES}, {_EDGES}, {_REDUCED} SELECT event_type AS question, count(DISTINCT user_id) AS people, greatest(0, 5000 - count(DISTINCT user_id)) AS missing, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM x WHERE outcome = 'included' GROUP BY 1")
def tr_coverage(spark, sf):
    found = trends.coverage(_reduced(spark, sf).where("outcome = 'included'"), "event_type", "user_id", "ts", 5000)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select(F.col("event_type").alias("question"), "people", "missing", day("first_at").alias("first_day"), day("last_at").alias("last_day"))


_REVISIONS = f"""
e AS (SELECT event_id FROM c WHERE {_REASON} IS NULL),
v AS (SELECT f.*, a.event_id IS NOT NULL AS fo, b.event_id IS NOT NULL AS bo FROM f LEFT JOIN e a ON a.event_id = from_id LEFT JOIN e b ON b.event_id = to_id),
z AS (SELECT *, CASE WHEN NOT fwd THEN 'not_reviewed_forward' WHEN kind IN ('withdraws','retracts') AND fo AND (kind = 'withdraws' OR NOT bo) THEN 'withdrawal' WHEN kind = 'repeats' THEN CASE WHEN fo AND bo THEN 'repeat' ELSE 'ignored' END WHEN kind = 'withdraws' THEN 'relationship_not_a_revision' WHEN fo AND bo THEN 'link' ELSE 'ignored' END AS outcome FROM v)"""


@query("tr_revision_edges", f"WITH {_CANDIDATES}, {_EDGES}, {_REVISIONS} SELECT from_id, to_id, kind AS type, outcome FROM z")
def tr_revision_edges(spark, sf):
    eligible = _partitioned(spark, sf).where("reason is null")
    return trends.revision_edges(_edges(spark, sf), eligible, "event_id").select("from_id", "to_id", "type", "outcome")


@query(
    "tr_revision_chains",
    f"""
WITH RECURSIVE {_CANDIDATES}, {_EDGES}, {_REVISIONS},
l AS (SELECT from_id AS a, to_id AS b FROM z WHERE outcome = 'link' UNION SELECT to_id, from_id FROM z WHERE outcome = 'link'),
reach(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
q AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)
SELECT node, root, count(*) OVER (PARTITION BY root) AS size FROM q""",
)
def tr_revision_chains(spark, sf):
    eligible = _partitioned(spark, sf).where("reason is null")
    return trends.chains(trends.revision_edges(_edges(spark, sf), eligible, "event_id").where("outcome = 'link'"))


@query("tr_volume", "SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, o_orderpriority, o_orderstatus, count(DISTINCT o_orderkey) AS statements, count(DISTINCT o_custkey) AS people FROM orders GROUP BY 1, 2, 3")
def tr_volume(spark, sf):
    return trends.volume(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


@query("tr_discovery", f"WITH {_CANDIDATES} SELECT event_type || ':' || unit AS key, count(DISTINCT user_id) AS people, count(*) AS statements, min(event_id) AS sample FROM c WHERE type = 'explicit_numeric' AND state = 'human_verified' AND event_type <> 'click' GROUP BY 1 HAVING count(DISTINCT user_id) >= 3")
def tr_discovery(spark, sf):
    rows = _candidates(spark, sf).where("type = 'explicit_numeric' and state = 'human_verified'").withColumn("key", F.concat_ws(":", "event_type", "unit"))
    return trends.discover_questions(rows, "key", "user_id", "event_id", ["click:year", "click:percent"])


@query("tr_qualitative_groups", f"WITH {_CANDIDATES} SELECT event_type AS question, event_id // 1000 AS block, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS members FROM c WHERE type = 'qualitative' GROUP BY 1, 2")
def tr_qualitative_groups(spark, sf):
    # members come in blocks of at most 1,000 ids, so no group is one array
    q = _candidates(spark, sf).where("type = 'qualitative'")
    return q.groupBy(F.col("event_type").alias("question"), F.floor(F.col("event_id") / 1000).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("members"))


# ---- comparability

_FACTS = """
f AS (SELECT o_orderkey AS id, o_orderpriority AS family, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate::DATE END AS d_start, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderdate + INTERVAL 30 DAY)::DATE END AS d_end,
  CASE o_orderkey % 5 WHEN 0 THEN 'by ' || year(o_orderdate) WHEN 1 THEN 'between ' || year(o_orderdate) || ' and ' || (year(o_orderdate) + 1) WHEN 2 THEN 'soon' END AS horizon FROM orders)"""


def _facts(spark, sf):
    i, y = F.col("o_orderkey"), F.year("o_orderdate")
    horizon = F.when(i % 5 == 0, F.concat(F.lit("by "), y)).when(i % 5 == 1, F.concat(F.lit("between "), y, F.lit(" and "), y + 1)).when(i % 5 == 2, "soon")
    return table(spark, sf, "orders").select(i.alias("id"), F.col("o_orderpriority").alias("family"), F.when(i % 6 == 0, F.to_date("o_orderdate")).alias("d_start"), F.when(i % 3 == 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("d_end"), horizon.alias("horizon"))


_DEADLINE = f"""
{_FACTS}, y AS (SELECT *, list_distinct(regexp_extract_all(coalesce(horizon, ''), '\\b((?:19|20)[0-9]{{2}})\\b', 1)) AS years FROM f),
k AS (SELECT *, len(years) AS n, d_start IS NOT NULL OR d_end IS NOT NULL AS dated, coalesce(year(d_end), year(d_start))::VARCHAR AS said FROM y),
d AS (SELECT *, CASE WHEN coalesce((dated AND n > 0 AND (n > 1 OR years[1] <> said)) OR (NOT dated AND n > 1) OR d_start > d_end, false) THEN 'ambiguous' WHEN dated OR n = 1 THEN 'deadline' ELSE 'absent' END AS kind FROM k),
t AS (SELECT *, CASE WHEN kind <> 'ambiguous' THEN d_start END AS s, CASE WHEN kind <> 'ambiguous' THEN CASE WHEN dated THEN d_end WHEN n = 1 THEN make_date(years[1]::INT, 12, 31) END END AS e FROM d)"""


@query("cp_deadline", f"WITH {_DEADLINE} SELECT id, kind, s::VARCHAR AS start_day, e::VARCHAR AS end_day FROM t")
def cp_deadline(spark, sf):
    d = comparability.deadline(F.col("d_start"), F.col("d_end"), F.col("horizon"))
    return _facts(spark, sf).select("id", d.alias("d")).select("id", F.col("d.kind").alias("kind"), F.col("d.start").cast("string").alias("start_day"), F.col("d.end").cast("string").alias("end_day"))


@query(
    "cp_classify",
    f"""
WITH {_DEADLINE}, g AS (SELECT id, family, CASE WHEN id % 2 = 0 THEN 'probability' ELSE 'timeline' END AS sem, CASE WHEN id % 9 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'probability' ELSE 'year' END END AS unit, CASE WHEN id % 8 = 0 THEN 'If X, then' END AS cond, kind, e FROM t),
r(exact_id, rf, rs, ru, rc, rd) AS (VALUES ('urgent-p', '1-URGENT', 'probability', 'probability', false, NULL::DATE), ('urgent-t', '1-URGENT', 'timeline', 'year', false, NULL), ('high-a', '2-HIGH', 'probability', 'probability', false, NULL), ('high-b', '2-HIGH', 'probability', 'probability', false, DATE '1995-12-31')),
h AS (SELECT g.*, (SELECT count(*) FROM r WHERE rf = family) AS reg, (SELECT count(*) FROM r WHERE rf = family AND rs = sem AND ru IS NOT DISTINCT FROM unit AND (cond IS NOT NULL) = rc AND (rd IS NULL OR rd = e)) AS fits, (SELECT min(exact_id) FROM r WHERE rf = family AND rs = sem AND ru IS NOT DISTINCT FROM unit AND (cond IS NOT NULL) = rc AND (rd IS NULL OR rd = e)) AS one FROM g),
w AS (SELECT *, CASE WHEN unit IS NULL THEN 'insufficient_agreement' WHEN sem = 'probability' AND kind = 'ambiguous' THEN 'ambiguous_horizon' WHEN sem = 'probability' AND reg > 0 AND kind = 'absent' THEN 'ambiguous_horizon' WHEN fits > 1 THEN 'insufficient_agreement' END AS reason FROM h)
SELECT id, reason, reason IS NULL AS poolable, CASE WHEN reason IS NULL THEN coalesce(one, family || '|' || sem || '|' || coalesce(unit, '') || '|' || CASE WHEN cond IS NULL THEN 'unconditional' ELSE 'if ' || trim(regexp_replace(lower(cond), '[^a-z0-9]+', ' ', 'g')) END || '|' || coalesce(e::VARCHAR, 'open')) END AS exact_id FROM w""",
)
def cp_classify(spark, sf):
    d = comparability.deadline(F.col("d_start"), F.col("d_end"), F.col("horizon"))
    i = F.col("id")
    unit = F.when(i % 9 != 0, F.when(i % 2 == 0, "probability").otherwise("year"))
    rows = _facts(spark, sf).select("id", "family", F.when(i % 2 == 0, "probability").otherwise("timeline").alias("semantics"), unit.alias("unit"), F.when(i % 8 == 0, "If X, then").alias("condition"), d.alias("d"))
    rows = rows.select("id", "family", "semantics", "unit", "condition", F.col("d.kind").alias("deadline_kind"), F.col("d.end").alias("deadline"))
    registry = spark.sql("select * from values ('urgent-p', '1-URGENT', 'probability', 'probability', false, null), ('urgent-t', '1-URGENT', 'timeline', 'year', false, null), ('high-a', '2-HIGH', 'probability', 'probability', false, null), ('high-b', '2-HIGH', 'probability', 'probability', false, date'1995-12-31') as t(exact_id, family, semantics, unit, conditional, deadline)")
    return comparability.classify(rows, registry).select("id", "reason", "poolable", "exact_id")


@query("cp_bound_phrase", "SELECT p_partkey, (CASE p_size % 4 WHEN 0 THEN 'at least ' WHEN 1 THEN 'About ' WHEN 2 THEN '>= ' ELSE '' END || p_size) AS shown, p_size % 4 IN (0, 2) AS is_bound FROM part")
def cp_bound_phrase(spark, sf):
    k = F.col("p_size") % 4
    shown = F.concat(F.when(k == 0, "at least ").when(k == 1, "About ").when(k == 2, ">= ").otherwise(""), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", shown.alias("shown"), comparability.bound_phrase(shown).alias("is_bound"))


@query("cp_resolution_gaps", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'not_final' END, CASE WHEN o_totalprice <= 100000 THEN 'too_small' END], lambda x: x IS NOT NULL), ',') AS gaps FROM orders")
def cp_resolution_gaps(spark, sf):
    gaps = comparability.resolution_gaps(not_final=F.col("o_orderstatus") == "F", too_small=F.col("o_totalprice") > 100000)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(gaps, ",").alias("gaps"))
