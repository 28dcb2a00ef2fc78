"""Queries of read models, comparisons, readers, queues and curation over the fixed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx
from quern.operators import comparability, evidence, extract, filters, ingest, paging, queues, read_models, review, trends
from quern.plans.registry import query
from quern.scratch import shared_folder
from quern.session import table
from quern.sources import artifacts, sinks
from quern.streaming import generations

# ---- read models


@query(
    "rd_sources",
    "SELECT s_suppkey, n_name AS owner, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance, count(l_orderkey) AS items FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY 1, 2, s_acctbal",
)
def rd_sources(spark, sf):
    s = table(spark, sf, "supplier").withColumn("balance", F.col("s_acctbal"))
    owners = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("owner"))
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return read_models.sources(s, owners, items, "s_suppkey", "s_nationkey", F.col("s_acctbal") > 0, ["balance"]).select("s_suppkey", "owner", "balance", "items")


@query(
    "rd_source_item",
    "WITH v AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F') SELECT o_orderkey AS item, 'person' AS kind, l_suppkey AS id FROM orders JOIN v ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_orderkey, 'evidence', l_partkey FROM lineitem WHERE (l_orderkey, l_partkey) IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_linestatus = 'F')",
)
def rd_source_item(spark, sf):
    """Suppliers of an order that have a finished line there, and parts that a finished line cites."""
    lines = table(spark, sf, "lineitem")
    visible = lines.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("id"), F.concat_ws("/", "l_orderkey", "l_partkey").alias("cited"))
    everyone = lines.select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("id")).distinct()
    cited = lines.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("id"), F.concat_ws("/", "l_orderkey", "l_partkey").alias("cited")).distinct()
    people = read_models.item_people(everyone, visible, "item", "id").select("item", F.lit("person").alias("kind"), "id")
    return people.unionByName(read_models.item_evidence(cited, visible, "cited").select("item", F.lit("evidence").alias("kind"), "id"))


@query(
    "rd_overview",
    "SELECT 'recent' AS section, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey::VARCHAR)::INT AS place, o_orderkey::VARCHAR AS id FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 8) UNION ALL SELECT 'revisions', row_number() OVER (ORDER BY ts DESC, event_id::VARCHAR)::INT, event_id::VARCHAR FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id::VARCHAR LIMIT 5)",
)
def rd_overview(spark, sf):
    recent = read_models.latest(table(spark, sf, "orders"), "recent", "o_orderdate", "o_orderkey", 8)
    return recent.unionByName(read_models.latest(table(spark, sf, "events").where("event_type = 'error'"), "revisions", "ts", "event_id", 5))


@query("rd_catalog", "SELECT 'events' AS name, count(*) AS records, strftime(max(ts), '%Y-%m-%d') AS last FROM events UNION ALL SELECT 'orders', count(*), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'region', count(*), NULL FROM region")
def rd_catalog(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return read_models.catalog({"orders": (table(spark, sf, "orders"), day("o_orderdate")), "events": (table(spark, sf, "events"), day("ts")), "region": (table(spark, sf, "region"), None)})


@query("rd_export", "SELECT 'nations' AS name, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) UNION ALL SELECT 'regions', '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' FROM region")
def rd_export(spark, sf):
    visible = {"nations": table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))}
    bundle = read_models.export_bundle({"regions": (table(spark, sf, "region"), "r_regionkey"), "nations": (table(spark, sf, "nation"), "n_nationkey")}, visible)
    parts = [sinks.json_rows(df).select(F.lit(name).alias("name"), "json") for name, df in bundle.items()]
    return parts[0].unionByName(parts[1])


@query("rd_discovery", "SELECT 'https://x.example/parts/' || p_partkey AS url, NULL::DATE AS changed FROM part UNION ALL SELECT 'https://x.example/statements/' || o_orderkey, o_orderdate::DATE FROM orders WHERE o_orderstatus = 'F'")
def rd_discovery(spark, sf):
    shown = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return read_models.discovery({"statements": (shown, "o_orderkey", F.to_date("o_orderdate")), "parts": (table(spark, sf, "part"), "p_partkey", F.lit(None).cast("date"))}, "https://x.example")


@query("tr_research_view", "SELECT o_custkey AS trend, count(*) FILTER (WHERE seen) AS shown, count(*) FILTER (WHERE NOT seen) AS omitted, min(o_orderkey) FILTER (WHERE seen) AS first FROM (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AS seen FROM orders) GROUP BY 1")
def tr_research_view(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("trend"), F.col("o_orderkey").alias("id"))
    visible = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    return read_models.research_view(rows, visible, "trend", "id")


@query("tr_scope", "SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0 OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') OR o_orderpriority IN ('2-HIGH', '5-LOW')")
def tr_scope(spark, sf):
    """Rows with the question's key, a comparable one, its topic or one of its sibling topics."""
    topics = F.array("o_orderpriority")
    fits = trends.in_scope(F.col("o_custkey") % 7 == 0, (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), F.array_contains(topics, "2-HIGH"), F.arrays_overlap(topics, F.array(F.lit("5-LOW"), F.lit("none"))))
    return table(spark, sf, "orders").where(fits).select("o_orderkey")


@query("tr_unique_exclusions", "SELECT DISTINCT l_orderkey AS slug, CASE WHEN l_quantity > 40 THEN 'bound' WHEN l_discount > 0.05 THEN 'unit' END AS reason FROM lineitem WHERE l_quantity > 40 OR l_discount > 0.05")
def tr_unique_exclusions(spark, sf):
    reason = F.when(F.col("l_quantity") > 40, "bound").when(F.col("l_discount") > 0.05, "unit")
    return trends.unique_exclusions(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slug"), reason.alias("reason")).where("reason is not null"), "slug", "reason")


@query("cv_cohort", "SELECT l_returnflag AS namespace, count(DISTINCT o_custkey) AS people, round_even(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 4) AS share FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 48 GROUP BY 1")
def cv_cohort(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("person"))
    facts = table(spark, sf, "lineitem").where("l_quantity > 48").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("person"), F.col("l_returnflag").alias("namespace"))
    return read_models.cohort_report(people, facts, "person", "namespace")


@query("flt_public_state", "SELECT o_orderkey, 'asked' AS kind FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'any' FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 400000")
def flt_public_state(spark, sf):
    o, public = table(spark, sf, "orders"), ("F", "P")
    pick = lambda df, asked, kind: filters.where_all(df, filters.public_state("o_orderstatus", asked, public)).select("o_orderkey", F.lit(kind).alias("kind"))
    return pick(o, "P", "asked").unionByName(pick(o, "O", "hidden")).unionByName(pick(o.where("o_totalprice > 400000"), None, "any"))


@query("sr_cursor", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-04' OR (o_orderdate = TIMESTAMP '1996-03-04' AND o_orderkey < 7000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def sr_cursor(spark, sf):
    """A page behind a cursor that went out and came back as opaque text."""
    opaque = paging.Cursor("1996-03-04 00:00:00", 7000).encode("orders")
    cursor = paging.Cursor.decode(opaque, "orders")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return o.where(paging.behind("o_orderdate", "o_orderkey", cursor, True)).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(25)


@query("sr_collation", "WITH n AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name ELSE upper(n_name[1]) || lower(n_name[2:]) END AS name FROM nation) SELECT n_nationkey, row_number() OVER (ORDER BY name, n_nationkey)::INT AS by_bytes, row_number() OVER (ORDER BY lower(name), n_nationkey)::INT AS by_letters FROM n")
def sr_collation(spark, sf):
    """Order by code points, and by letters whatever their case."""
    k = F.col("n_nationkey") % 3
    n = table(spark, sf, "nation").select("n_nationkey", F.when(k == 0, F.lower("n_name")).when(k == 1, F.col("n_name")).otherwise(F.initcap("n_name")).alias("name"))
    w = Window.partitionBy(F.lit(0))  # 25 rows
    return n.select("n_nationkey", F.row_number().over(w.orderBy("name", "n_nationkey")).alias("by_bytes"), F.row_number().over(w.orderBy(F.lower(F.collate("name", "UTF8_LCASE")), "n_nationkey")).alias("by_letters"))


# ---- comparisons and curation

_OUTCOMES = {"urgent": "urgent", "low": r"\blow\b", "high": "high"}


@query(
    "cp_outcome",
    "WITH f AS (SELECT o_orderkey, lower(o_orderpriority) AS said, CASE o_orderkey % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS own FROM orders) SELECT o_orderkey, (regexp_matches(said, 'urgent|low|high') AND NOT contains(said, own)) OR (own = 'medium' AND regexp_matches(said, 'urgent|low|high')) AS conflict, CASE WHEN contains(said, 'urgent') THEN 'urgent' WHEN contains(said, 'low') THEN 'low' WHEN contains(said, 'high') THEN 'high' END AS split FROM f",
)
def cp_outcome(spark, sf):
    k = F.col("o_orderkey") % 4
    own, said = F.when(k == 0, "urgent").when(k == 1, "low").when(k == 2, "high").otherwise("medium"), F.lower("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", comparability.outcome_conflict(said, own, _OUTCOMES).alias("conflict"), comparability.split_outcome(said, _OUTCOMES).alias("split"))


@query(
    "cp_comparison",
    """
WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS poolable, 'q' || l_linenumber % 3 AS exact, CASE WHEN l_suppkey % 5 = 0 THEN 'q' || l_partkey % 2 END AS stored, 'f' || l_suppkey % 3 AS family, CASE WHEN l_partkey % 11 = 0 THEN 'ambiguous_horizon' END AS reason, 'o' || l_partkey % 2 AS outcome, CASE WHEN l_partkey % 3 = 0 THEN DATE '2030-12-31' WHEN l_partkey % 3 = 1 THEN DATE '2040-12-31' END AS d, l_returnflag = 'R' AS cond, CASE WHEN l_linestatus = 'F' THEN 'year' END AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, poolable AND exact = 'q1' AS match, CASE WHEN poolable AND exact = 'q1' THEN NULL WHEN stored <> 'q1' THEN 'different_question' WHEN family <> 'f1' THEN 'different_question' WHEN reason IS NOT NULL THEN reason WHEN outcome <> 'o1' THEN 'definition_mismatch' WHEN d <> DATE '2030-12-31' THEN 'deadline_mismatch' WHEN cond THEN 'condition_mismatch' WHEN unit <> 'probability' THEN 'unit_mismatch' ELSE 'insufficient_agreement' END AS reason FROM f""",
)
def cp_comparison(spark, sf):
    text = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    k = F.col("l_partkey") % 3
    found = F.struct(
        (F.col("l_suppkey") % 2 == 0).alias("poolable"),
        text("q", "l_linenumber", 3).alias("exact_id"),
        F.when(F.col("l_suppkey") % 5 == 0, text("q", "l_partkey", 2)).alias("stored_id"),
        text("f", "l_suppkey", 3).alias("family"),
        F.when(F.col("l_partkey") % 11 == 0, "ambiguous_horizon").alias("reason"),
        text("o", "l_partkey", 2).alias("outcome"),
        F.when(k == 0, "2030-12-31").when(k == 1, "2040-12-31").cast("date").alias("deadline"),
        (F.col("l_returnflag") == "R").alias("conditional"),
        F.when(F.col("l_linestatus") == "F", "year").alias("unit"),
    )
    target = F.struct(F.lit("q1").alias("exact_id"), F.lit("f1").alias("family"), F.lit("o1").alias("outcome"), F.lit("2030-12-31").cast("date").alias("deadline"), F.lit(False).alias("conditional"), F.lit("probability").alias("unit"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", comparability.comparison(found, target).alias("c")).select("l_orderkey", "l_linenumber", "c.match", "c.reason")


@query("cp_repeated_rows", "SELECT o_orderpriority AS family, count(*) AS n, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS poolable FROM (SELECT o_orderpriority FROM orders UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1")
def cp_repeated_rows(spark, sf):
    """Rows that stand twice stay two; a family with two fitting questions has no agreement."""
    o = table(spark, sf, "orders").select(F.lit(1).alias("id"), F.col("o_orderpriority").alias("family"), F.lit("quantity").alias("semantics"), F.lit("usd").alias("unit"), F.lit(None).cast("string").alias("condition"), F.lit("absent").alias("deadline_kind"), F.lit(None).cast("date").alias("deadline"))
    registry = spark.createDataFrame([("a", "5-LOW", "quantity", "usd", False, None), ("b", "5-LOW", "quantity", "usd", False, None), ("c", "2-HIGH", "quantity", "usd", False, None)], "exact_id string, family string, semantics string, unit string, conditional boolean, deadline date")
    return comparability.classify(o.unionAll(o), registry).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("poolable"), 1)).alias("poolable"))


@query("ex_topic_signal", "WITH t AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations), s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(low, '\\b(the|der)\\b') THEN list_filter([CASE WHEN regexp_matches(low, '\\bof\\b|\\bin\\b') THEN 'place' END, CASE WHEN regexp_matches(low, '\\band\\b|\\bund\\b') THEN 'joint' END], lambda x: x IS NOT NULL) END AS topics FROM t) SELECT conv_id, turn, CASE WHEN len(topics) > 0 THEN array_to_string(topics, ',') END AS topics FROM s")
def ex_topic_signal(spark, sf):
    topics = extract.topic_signal(F.col("text"), r"(?i)(?<!\w)(?:the|der)(?!\w)", {"place": ["of", "in"], "joint": ["and", "und"]})
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(topics, ",").alias("topics"))


@query("ex_preferred", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM a WHERE p = 1) SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber FROM b WHERE q <= 2")
def ex_preferred(spark, sf):
    order = [F.desc("l_discount"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")]
    return extract.preferred(table(spark, sf, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], order, 2).select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")


@query("ex_summary", "SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n, count(DISTINCT o_custkey) AS people FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 2 UNION ALL SELECT 'repeated_people', NULL, sum(n)::BIGINT, count(*) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def ex_summary(spark, sf):
    return extract.summary(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query("ex_warnings", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END], lambda x: x IS NOT NULL), ',') AS warnings, array_to_string(list_filter([CASE WHEN contains(o_orderpriority, '1-') AND contains(o_orderpriority, 'URG') THEN 'q-urgent' END, CASE WHEN contains(o_orderpriority, 'O') THEN 'q-o' END], lambda x: x IS NOT NULL), ',') AS keys FROM orders")
def ex_warnings(spark, sf):
    warnings = extract.review_warnings(large=F.col("o_totalprice") > 300000, pending=F.col("o_orderstatus") == "P", unknown=F.lit(None).cast("boolean"))
    keys = extract.suggested_keys(F.col("o_orderpriority"), {"q-urgent": ["1-", "URG"], "q-o": ["O"]})
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(warnings, ",").alias("warnings"), F.array_join(keys, ",").alias("keys"))


@query(
    "id_linked_profile",
    "SELECT c_custkey, c_custkey % 5 = 1 AND c_nationkey < 12 AS accepted, CASE c_custkey % 5 WHEN 0 THEN 'empty_profile_name' WHEN 1 THEN CASE WHEN c_nationkey < 12 THEN 'name_match_and_corroborating_link' ELSE 'no_corroborating_link' END WHEN 2 THEN 'name_similar_not_equal' ELSE 'name_mismatch' END AS reason FROM customer",
)
def id_linked_profile(spark, sf):
    k = F.col("c_custkey") % 5
    names = F.when(k == 0, F.array(F.lit(" "), F.lit(None))).when(k == 1, F.array(F.lit("x"), F.col("c_name"))).when(k == 2, F.array(F.lit("Customer Other"))).otherwise(F.array(F.lit("Someone Else")))
    keyed = F.transform(names, lambda n: tx.phrase(n))
    accepted = F.array(tx.phrase(F.col("c_name")))
    decision = extract.linked_profile(keyed, accepted, F.col("c_nationkey") < 6, F.when(F.col("c_nationkey") < 12, "https://a.example/").otherwise("https://b.example"), F.array(F.lit("https://a.example")))
    return table(spark, sf, "customer").select("c_custkey", decision.alias("d")).select("c_custkey", "d.accepted", "d.reason")


@query("id_profile_links", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'orcid' WHEN 1 THEN 'github' WHEN 2 THEN 'mastodon' END AS kind, CASE p_size % 4 WHEN 0 THEN '0000-0002-1825-009X' WHEN 1 THEN 'user-' || p_partkey WHEN 2 THEN 'u' || p_partkey END AS handle FROM part")
def id_profile_links(spark, sf):
    k, n = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    url = F.when(k == 0, "https://ORCID.org/0000-0002-1825-009X").when(k == 1, F.concat(F.lit("https://github.com/user-"), n, F.lit("/"))).when(k == 2, F.concat(F.lit("https://social.example/@u"), n)).otherwise(F.concat(F.lit("https://github.com/a/"), n))
    return table(spark, sf, "part").select("p_partkey", tx.profile_link(url).alias("l")).select("p_partkey", "l.kind", "l.handle")


@query("id_attribution", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'byline' WHEN o_orderpriority = '1-URGENT' THEN 'author' WHEN o_totalprice > 400000 THEN 'host' END AS method, CASE WHEN o_orderstatus = 'F' THEN o_custkey WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 1 WHEN o_totalprice > 400000 THEN o_custkey + 2 END::VARCHAR AS person FROM orders")
def id_attribution(spark, sf):
    c = F.col("o_custkey")
    found = extract.attribution(byline=F.when(F.col("o_orderstatus") == "F", c), author=F.when(F.col("o_orderpriority") == "1-URGENT", c + 1), host=F.when(F.col("o_totalprice") > 400000, c + 2))
    return table(spark, sf, "orders").select("o_orderkey", found.alias("a")).select("o_orderkey", "a.method", "a.person")


@query("ev_security_outcome", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'not_applicable_clean' WHEN l_returnflag = 'R' THEN 'error_flag_not_observed_outcome' WHEN l_partkey % 4 = 0 THEN 'dos_nonutility_predicate_not_target_goal' WHEN l_linestatus = 'O' THEN 'unverified_historical_predicate' ELSE 'verified_target_goal_predicate' END AS status, CASE WHEN l_suppkey % 3 <> 0 AND l_returnflag <> 'R' AND l_partkey % 4 <> 0 AND l_linestatus <> 'O' THEN l_quantity > 25 END AS success FROM lineitem")
def ev_security_outcome(spark, sf):
    outcome = evidence.security_outcome(F.when(F.col("l_suppkey") % 3 != 0, "injection"), F.col("l_returnflag") == "R", F.when(F.col("l_partkey") % 4 == 0, "dos").otherwise("important"), F.col("l_quantity") > 25, F.col("l_linestatus") != "O")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", outcome.alias("o")).select("l_orderkey", "l_linenumber", "o.status", "o.success")


@query("fn_decision_key", "SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"note\":null}') AS key FROM orders")
def fn_decision_key(spark, sf):
    return table(spark, sf, "orders").withColumn("note", F.lit(None).cast("string")).select("o_orderkey", review.decision_key("o_orderkey", "o_orderstatus", "note").alias("key"))


@query("fn_json_equal", "SELECT event_id, event_id % 3 <> 1 AS same, sha256('{\"a\":{\"x\":1,\"y\":[2,1]},\"b\":' || event_id || '}') AS hash FROM events")
def fn_json_equal(spark, sf):
    n = F.col("event_id").cast("string")
    one = F.concat(F.lit('{"b": '), n, F.lit(', "a": {"y": [2, 1], "x": 1}}'))
    other = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a":{"x":1,"y":[1,2]},"b":'), n, F.lit("}"))).otherwise(F.concat(F.lit('{"a":{"x":1,"y":[2,1]},"b":'), n, F.lit("}")))
    return table(spark, sf, "events").select("event_id", tx.json_equal(one, other).alias("same"), F.sha2(tx.canonical_json(one), 256).alias("hash"))


# ---- queues


@query("sm_generations", "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS seen FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen)::INT AS version FROM f")
def sm_generations(spark, sf):
    return ingest.generations(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "event_type", "version")


@query(
    "sm_generation_queue",
    "WITH f AS (SELECT user_id, event_type, min((ts, event_type)) AS seen FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen)::INT AS version, 0 AS generation, true AS linked FROM f",
)
def sm_generation_queue(spark, sf):
    """The events as a stream, through the queue's state into its sealed folder, and from there; one batch takes them all."""
    # a stream reads a folder; the pattern lets the table be a file as well
    schema = table(spark, sf, "events").schema
    folder = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    sealed = generations.run_queue(lambda own: own.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"), spark, folder, "user_id", "event_type", "ts")
    return sealed.read().join(F.broadcast(sealed.manifests().select("generation", "linked")), "generation").select("user_id", "event_type", "version", F.col("generation").cast("int").alias("generation"), "linked")


@query(
    "sm_sealed_shards",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, epoch_us(ts) AS t, length(props) AS b FROM events),
    one_by_one AS (SELECT event_type, n, n AS first, t AS opened, b AS held FROM e WHERE n = 1
        UNION ALL
        SELECT event_type, n, CASE WHEN cut THEN n ELSE first END, CASE WHEN cut THEN t ELSE opened END, CASE WHEN cut THEN b ELSE held + b END
        FROM (SELECT e.*, o.first, o.opened, o.held, e.n - o.first >= 45 OR o.held + e.b > 400 OR e.t - o.opened >= 43200000000 AS cut FROM one_by_one o JOIN e ON e.event_type = o.event_type AND e.n = o.n + 1))
    SELECT event_type, first - 1 AS shard, count(*) AS records, sum(b)::BIGINT AS bytes, min(t) AS opened, max(t) AS closed FROM one_by_one JOIN e USING (event_type, n) GROUP BY 1, 2""",
)
def sm_sealed_shards(spark, sf):
    e = table(spark, sf, "events").withColumn("size", F.length("props"))
    placed = queues.sealed(e, ["event_type"], "ts", "event_id", "size", 43200, 45, 400)
    return queues.shards(placed, ["event_type"], "ts", "size").select("event_type", "shard", "records", "bytes", F.unix_micros("opened").alias("opened"), F.unix_micros("closed").alias("closed"))


@query(
    "sm_paused",
    """WITH m AS (SELECT event_id, user_id, ts, value, sum((value >= 40 OR value < 5)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
    SELECT event_id, coalesce(max(value) FILTER (WHERE value >= 40 OR value < 5) OVER (PARTITION BY user_id, run) >= 40, false) AS paused FROM m""",
)
def sm_paused(spark, sf):
    return queues.paused(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 40.0, 5.0).select("event_id", "paused")


@query(
    "sm_checkpoints",
    "WITH g AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE value > 10) AS good, arg_max(props, (ts, event_id)) FILTER (WHERE value > 10) AS etag FROM events GROUP BY 1), f AS (SELECT g.user_id, g.etag, count(*) FILTER (WHERE g.good IS NULL OR (e.ts, e.event_id) > g.good) AS failures FROM g JOIN events e ON e.user_id = g.user_id GROUP BY 1, 2) SELECT user_id, etag, failures, CASE WHEN failures > 0 THEN least(60, 2 ** least(failures, 5)) ELSE 0 END::INT AS wait FROM f",
)
def sm_checkpoints(spark, sf):
    runs = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") > 10).alias("ok"), F.col("props").alias("etag"))
    return ingest.checkpoints(runs, "user_id", ["ts", "event_id"], "ok", "etag").select("user_id", "etag", "failures", "wait")


# ---- readers and sinks


def _written_text(spark, df, name, **options):
    """``df``, one text column, as a new folder of text files, for readers to read."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).text(path)
    return path


@query("src_json_lines", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderkey % 9 = 0 AS corrupt FROM (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS k, * FROM orders) WHERE k IS NOT NULL UNION ALL SELECT NULL, NULL, true FROM orders WHERE o_orderkey % 9 = 0")
def src_json_lines(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    line = F.when(F.col("o_orderkey") % 9 == 0, "{broken").otherwise(F.to_json(F.struct("o_orderkey", "o_orderstatus")))
    read = artifacts.json_lines(spark, _written_text(spark, o.select(line.alias("value")), "lines"), "o_orderkey long, o_orderstatus string")
    return read.select("o_orderkey", "o_orderstatus", F.col("_corrupt").isNotNull().alias("corrupt"))


@query("src_gzip_rows", "SELECT md5(doc_id || ':' || coalesce(n_chars, 0)) AS line FROM documents")
def src_gzip_rows(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.concat_ws(":", "doc_id", F.coalesce("n_chars", F.lit(0)))).alias("value"))
    return artifacts.text_rows(spark, _written_text(spark, d, "rows", compression="gzip"))


@query("src_csv_pair", "SELECT s_suppkey::VARCHAR AS supplier, s_nationkey::VARCHAR AS code, CASE WHEN s_nationkey < 20 THEN n_name || ', \"n\"' END AS label FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def src_csv_pair(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat_ws(",", "s_suppkey", "s_nationkey").alias("value"))
    n = table(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit(', ""n"""')).alias("value"))
    head = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    data = _written_text(spark, head("supplier,code").unionAll(s).coalesce(1), "csv")
    labels = _written_text(spark, head("code,label").unionAll(n).coalesce(1), "csv")
    return artifacts.csv_pair(spark, data, labels, "code").select("supplier", "code", "label")


@query(
    "src_json_stat",
    """SELECT o_orderkey, ['a', 'b'][i // 3 + 1] AS x, ['p', 'q', 'r'][i % 3 + 1] AS y, CASE WHEN i NOT IN (2, 4) THEN (o_orderkey * 10 + i)::DOUBLE END AS value, CASE WHEN i = 1 THEN 'e' END AS status,
        CASE WHEN i = 4 THEN 'explicit_null' WHEN i <> 2 THEN 'observed' WHEN o_orderkey % 2 = 0 THEN 'explicit_null' ELSE 'absent' END AS state FROM orders, (SELECT unnest(range(6)) AS i) WHERE o_orderkey % 5 > 0""",
)
def src_json_stat(spark, sf):
    """Cubes with lists (even orders) and with objects (odd ones); every fifth has a place beyond its cells, or one value too few."""
    k = F.col("o_orderkey")
    value = lambda i: F.lit("null") if i == 4 else (k * 10 + i).cast("string")
    dense = F.concat(F.lit("["), F.concat_ws(",", *[F.lit("null") if i == 2 else value(i) for i in range(6)]), F.lit("]"))
    sparse = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{i}":'), value(i)) for i in (5, 4, 3, 1, 0)]), F.lit("}"))
    lists, objects = '{"dimension":{"x":{"category":{"index":["a","b"]}},"y":{"category":{"index":["p","q","r"]}}},', '{"dimension":{"x":{"category":{"index":{"b":1,"a":0}}},"y":{"category":{"index":{"r":2,"p":0,"q":1}}}},'
    even = F.concat(F.lit(lists + '"status":[null,"e",null,null,null,null],"value":'), dense, F.lit("}"))
    odd = F.concat(F.lit(objects + '"status":{"1":"e"},"value":'), sparse, F.lit("}"))
    broken = F.when(k % 2 == 0, F.lit(lists + '"value":[1,2,3,4,5]}')).otherwise(F.replace(odd, F.lit('"5":'), F.lit('"6":')))
    cube = F.when(k % 5 == 0, broken).when(k % 2 == 0, even).otherwise(odd)
    return artifacts.json_stat(table(spark, sf, "orders").select("o_orderkey", cube.alias("cube")), "cube", ["x", "y"], "o_orderkey")


@query("src_yaml_pairs", "SELECT n_nationkey, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'note', 'it''s # fine' FROM nation UNION ALL SELECT n_nationkey, 'none', NULL FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation")
def src_yaml_pairs(spark, sf):
    text = F.concat(F.lit("# head\nname: "), F.col("n_name"), F.lit("  # a name\nnote: 'it''s # fine'\nnone: ~\n  nested: x\nregion:   "), F.col("n_regionkey").cast("string"), F.lit("\n"))
    return artifacts.yaml_pairs(table(spark, sf, "nation").select("n_nationkey", text.alias("text")), "text", "n_nationkey").select("n_nationkey", "key", "value")


@query("src_graph_edges", "SELECT n_nationkey, 'r' AS source, 'n' || n_nationkey AS target, 'has' AS kind, false AS dangling FROM nation UNION ALL SELECT n_nationkey, 'n' || n_nationkey, 'lost', 'of', true FROM nation WHERE n_nationkey % 2 = 0")
def src_graph_edges(spark, sf):
    n = F.concat(F.lit('"n'), F.col("n_nationkey").cast("string"), F.lit('"'))
    more = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(',{"source":'), n, F.lit(',"target":"lost","kind":"of"}'))).otherwise("")
    graph = F.concat(F.lit('{"nodes":[{"id":"r"},{"id":'), n, F.lit('}],"edges":[{"source":"r","target":'), n, F.lit(',"kind":"has"}'), more, F.lit("]}"))
    return artifacts.graph_edges(table(spark, sf, "nation").select("n_nationkey", graph.alias("g")), "g", "n_nationkey")


@query("snk_markdown", "WITH r AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT 4 + row_number() OVER (ORDER BY status) - 1 AS line, '| ' || status || ' | ' || n || ' |' AS text FROM r) SELECT line::INT AS line, text FROM t UNION ALL SELECT 0, '# Orders' UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| status | n |' UNION ALL SELECT 3, '| --- | --- |'")
def snk_markdown(spark, sf):
    return sinks.markdown_rows(table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")), ["status"], "Orders")


@query("snk_sitemap", "SELECT '<url><loc>https://x.example/?a=1&amp;o=' || o_orderkey || '</loc><lastmod>' || strftime(o_orderdate, '%Y-%m-%d') || '</lastmod></url>' AS entry FROM orders")
def snk_sitemap(spark, sf):
    pages = table(spark, sf, "orders").select(F.concat(F.lit("https://x.example/?a=1&o="), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderdate").alias("changed"))
    return sinks.sitemap_rows(pages, "url", "changed")
