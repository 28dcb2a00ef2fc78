"""Queries of sentence rules, collection policies, rankings and ledgers over the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import policy
from quern.operators import evidence, rules
from quern.plans.registry import query
from quern.session import table


@query(
    "ex_timeline",
    """
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) + 110 AS y FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 4) THEN 'point' WHEN k <> 5 THEN 'range' END AS form, CASE k WHEN 2 THEN 2037 WHEN 3 THEN 5 WHEN 5 THEN NULL ELSE y END::INT AS low,
 CASE k WHEN 1 THEN y + 3 WHEN 2 THEN 2039 WHEN 3 THEN 10 WHEN 5 THEN NULL ELSE y END::INT AS high, CASE WHEN k = 3 THEN 'years_ahead' WHEN k <> 5 THEN 'year' END AS unit FROM o""",
)
def ex_timeline(spark, sf):
    k, y = F.col("o_orderkey") % 6, (F.year("o_orderdate") + 110).cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("I expect it by "), y, F.lit(".")))
        .when(k == 1, F.concat(F.lit("Probably between "), y, F.lit(" and "), (F.year("o_orderdate") + 113).cast("string")))
        .when(k == 2, "In the late 2030s, I would say")
        .when(k == 3, "We will see it within 5 to 10 years")
        .when(k == 4, F.concat(F.lit("My median is around "), y))
        .otherwise(F.concat(F.lit("A 10% chance by "), y))
    )
    return table(spark, sf, "orders").select("o_orderkey", rules.timeline(said).alias("t")).select("o_orderkey", "t.form", "t.low", "t.high", "t.unit")


@query("ex_quantity", "SELECT p_partkey, CASE WHEN p_size % 3 <> 2 THEN p_size * CASE p_size % 3 WHEN 0 THEN 1e6::DOUBLE ELSE 1::DOUBLE END END AS value, CASE p_size % 3 WHEN 0 THEN 'jobs' WHEN 1 THEN 'dollars' END AS unit FROM part")
def ex_quantity(spark, sf):
    k, n = F.col("p_size") % 3, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit("about "), n, F.lit(" million jobs are at stake"))).when(k == 1, F.concat(F.lit("it costs "), n, F.lit(" Dollars"))).otherwise(F.concat(F.lit("chapter "), n))
    return table(spark, sf, "part").select("p_partkey", rules.quantity(said, ["jobs", "dollars"]).alias("q")).select("p_partkey", "q.value", "q.unit")


@query("ex_stance", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(i|my|we|our)\\b') THEN CASE WHEN regexp_matches(text, 'n''t|not') THEN 'doubt' WHEN regexp_matches(text, 'will|can') THEN 'hope' END END AS stance FROM conversations")
def ex_stance(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.stance(F.col("text"), [("doubt", "n't|not"), ("hope", "will|can")]).alias("stance"))


@query(
    "fn_policy",
    """
WITH s AS (SELECT c_custkey, c_acctbal > 0 AS enabled, CASE WHEN c_nationkey > 5 THEN 'notes' END AS notes, c_mktsegment <> 'BUILDING' AS own, c_nationkey <> 3 AS adm, CASE WHEN c_mktsegment = 'MACHINERY' THEN false END AS ev, CASE WHEN c_nationkey < 4 THEN 'cc-by-nc' WHEN c_nationkey < 8 THEN 'cc-by' WHEN c_nationkey < 15 THEN 'cc-by-nd' WHEN c_nationkey < 18 THEN 'mit' WHEN c_nationkey < 20 THEN 'cc0' WHEN c_nationkey < 22 THEN 'gpl' ELSE 'reserved' END AS family FROM customer),
a AS (SELECT *, enabled AND CASE WHEN own THEN adm ELSE notes IS NOT NULL END AS admitted FROM s)
SELECT c_custkey, admitted, admitted AND coalesce(NOT own OR coalesce(ev, true), true) AS evidence, admitted AND coalesce(NOT own OR coalesce(ev, true), true) AS extraction, CASE WHEN admitted AND own AND family IN ('cc-by-nd', 'cc-by', 'cc0', 'cc-by-sa') THEN '2030-01-01' END AS raw_until FROM a""",
)
def fn_policy(spark, sf):
    own = F.struct((F.col("c_nationkey") != 3).alias("admitted"), F.lit("basis").alias("rights_basis"), F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(False)).alias("evidence"), F.lit(None).cast("boolean").alias("extraction"), F.lit("2030-01-01").cast("timestamp_ntz").alias("expires_at"))
    p = policy.collection_policy(
        F.col("c_acctbal") > 0,
        F.when(F.col("c_nationkey") > 5, "notes"),
        F.when(F.col("c_mktsegment") != "BUILDING", own),
        F.when(F.col("c_nationkey") < 4, "cc-by-nc").when(F.col("c_nationkey") < 8, "cc-by").when(F.col("c_nationkey") < 15, "cc-by-nd").when(F.col("c_nationkey") < 18, "mit").when(F.col("c_nationkey") < 20, "cc0").when(F.col("c_nationkey") < 22, "gpl").otherwise("reserved"),
        F.lit("2026-01-01").cast("timestamp_ntz"),
    )
    return table(spark, sf, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.admitted", "p.evidence", "p.extraction", F.date_format("p.raw_until", "yyyy-MM-dd").alias("raw_until"))


@query("fn_prefixed_id", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'part-' || p_partkey END AS slug FROM part")
def fn_prefixed_id(spark, sf):
    id = F.concat(F.when(F.col("p_size") % 2 == 0, "item:part-").otherwise("item:Part "), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", policy.prefixed_id(id, "item").alias("slug"))


@query("fn_robots", "SELECT p_partkey, p_size % 2 = 0 OR p_size < 10 AS allowed FROM part")
def fn_robots(spark, sf):
    body = F.lit("User-agent: *\nDisallow: /odd/\nAllow: /odd/small*\n\nUser-agent: other\nDisallow: /\n")
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "/even/").otherwise("/odd/"), F.when(F.col("p_size") < 10, "small").otherwise("large"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", policy.robots_allows(body, path, "reader").alias("allowed"))


@query("ql_labels", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN replace(lower(o_orderpriority), '-', '_') ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1")
def ql_labels(spark, sf):
    return table(spark, sf, "orders").groupBy(policy.bounded_label(F.col("o_orderpriority"), ["1_urgent", "5_low"]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sr_rank_questions",
    "WITH q AS (SELECT p_brand AS slug, p_type AS name, count(DISTINCT o_custkey) AS people, count(*) AS statements, max(o_orderdate) AS seen FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT slug, name, people, statements, row_number() OVER (PARTITION BY slug ORDER BY people DESC, statements DESC, seen DESC, name)::INT AS place FROM q",
)
def sr_rank_questions(spark, sf):
    from quern.operators.windows import covered_first

    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    q = j.groupBy(F.col("p_brand").alias("slug"), F.col("p_type").alias("name")).agg(F.countDistinct("o_custkey").alias("people"), F.count(F.lit(1)).alias("statements"), F.max("o_orderdate").alias("at"))
    return covered_first(q, ["slug"], "people", "statements", "at", "name").select("slug", "name", "people", "statements", "place")


@query(
    "ev_interval_ledger",
    "WITH r AS (SELECT user_id, event_type, min(value) AS lower, avg(value) AS estimate, max(value) AS upper FROM events GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN lower <= 0 THEN 'not_positive' WHEN estimate > 80 THEN 'implausible' END AS problem FROM r",
)
def ev_interval_ledger(spark, sf):
    r = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("value").alias("lower"), F.avg("value").alias("estimate"), F.max("value").alias("upper"))
    return r.select("user_id", "event_type", evidence.interval_problem(F.col("lower"), F.col("estimate"), F.col("upper"), 80.0).alias("problem"))


@query(
    "ev_cycles",
    "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 5) % 17 AS b FROM nation UNION SELECT s_suppkey::INT + 1000, s_nationkey + 100 FROM supplier UNION SELECT n_nationkey + 100, n_regionkey + 300 FROM nation), r(x, y) AS (SELECT a, b FROM e WHERE a < 100 UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), c AS (SELECT DISTINCT x FROM r WHERE x = y), d AS (SELECT x FROM c UNION SELECT r.y FROM r JOIN c ON c.x = r.x) SELECT a, b FROM e WHERE a IN (SELECT x FROM d)",
)
def ev_cycles(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 5) % 17).alias("b"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).cast("int").alias("a"), (F.col("s_nationkey") + 100).alias("b"))
    up = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).alias("a"), (F.col("n_regionkey") + 300).alias("b"))
    return evidence.cyclic_edges(n.union(s).union(up))
