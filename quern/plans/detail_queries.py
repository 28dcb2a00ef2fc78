"""Queries of details, gates, integrity and further readers over the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import bundles, evidence, extract, filters, ingest, joins, paging, quality, read_models
from quern.plans.registry import query
from quern.scratch import shared_folder
from quern.session import table
from quern.sources import feeds, records


@query("jn_dimension_chain", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey")
def jn_dimension_chain(spark, sf):
    links = table(spark, sf, "nation").withColumn("s_nationkey", F.col("n_nationkey")).withColumn("r_regionkey", F.col("n_regionkey"))
    return read_models.dimension_chain(table(spark, sf, "supplier"), links, table(spark, sf, "region"), "s_nationkey", "r_regionkey", F.col("n_nationkey") < 20).select("s_suppkey", "n_name", "r_name")


@query("jn_current_version", "SELECT event_id, current_version FROM events LEFT JOIN (SELECT user_id, event_type, max(event_id) AS current_version FROM events GROUP BY 1, 2 HAVING max(event_id) % 2 = 0) USING (user_id, event_type)")
def jn_current_version(spark, sf):
    e = table(spark, sf, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    marked = e.join(last, ["user_id", "event_type"])
    return read_models.current_version(marked, ["user_id", "event_type"], "event_id", (F.col("event_id") == F.col("last")) & (F.col("last") % 2 == 0)).select("event_id", "current_version")


@query("jn_current_document", "SELECT o_orderkey, r_name AS document FROM orders CROSS JOIN (SELECT r_name FROM region WHERE r_regionkey = 2)")
def jn_current_document(spark, sf):
    return read_models.joined_single(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "region").where("r_regionkey = 2").select(F.col("r_name").alias("document")))


@query(
    "jn_name_variants",
    "WITH v AS (SELECT c_custkey AS owner, unnest([lower(c_name), 'variant ' || c_custkey % 900]) AS key FROM customer), k AS (SELECT key, min(owner) AS owner FROM v GROUP BY 1 HAVING count(DISTINCT owner) = 1) SELECT o_orderkey, owner FROM orders JOIN k ON key = CASE WHEN o_orderkey % 2 = 0 THEN 'customer#' || lpad(o_custkey::VARCHAR, 9, '0') ELSE 'variant ' || o_custkey % 900 END",
)
def jn_name_variants(spark, sf):
    """People are found by their name or a variant of it, where only one of them has it."""
    variants = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), F.explode(F.array(F.lower("c_name"), F.concat(F.lit("variant "), (F.col("c_custkey") % 900).cast("string")))).alias("key"))
    said = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("customer#%09d", F.col("o_custkey"))).otherwise(F.concat(F.lit("variant "), (F.col("o_custkey") % 900).cast("string")))
    return joins.unique_owner(table(spark, sf, "orders").select("o_orderkey", said.alias("key")), variants, "key", "owner").select("o_orderkey", "owner")


_PAGE = "SELECT o_orderkey AS id, '{\"o_custkey\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' AS person, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS topics FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1997-05-05' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30) JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_custkey, c_name"


@query("rd_statement_page", _PAGE)
def rd_statement_page(spark, sf):
    """A filtered page behind a cursor, each statement with its person as an object and its topics."""
    o = filters.where_all(table(spark, sf, "orders"), filters.equals("o_orderstatus", "F"))
    page = o.where(paging.behind("o_orderdate", "o_orderkey", paging.Cursor("1997-05-05 00:00:00", 2**60), True)).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30)
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    topics = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    found = read_models.statement_page(page, people, topics, "o_custkey", "o_orderkey", "l_returnflag")
    return found.select(F.col("o_orderkey").alias("id"), F.to_json("person").alias("person"), F.array_join("topics", ",").alias("topics"))


@query("rd_statement_detail", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = 7) AS evidence, (SELECT count(*) FROM lineitem WHERE l_orderkey = 7 AND l_returnflag = 'R') AS relations FROM orders WHERE o_orderkey = 7")
def rd_statement_detail(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = read_models.statement_detail(table(spark, sf, "orders"), lines.select("o_orderkey", "l_linenumber", "l_partkey"), lines.where("l_returnflag = 'R'").select("o_orderkey", "l_suppkey", "l_linenumber", "l_partkey"), "o_orderkey", 7)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select("o_orderkey", F.greatest(F.lit(0), size("evidence")).alias("evidence"), F.greatest(F.lit(0), size("relations")).alias("relations"))


@query("rd_person_parts", "SELECT c_custkey, (SELECT string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = 5) AS statements, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS affiliation FROM customer WHERE c_custkey = 5")
def rd_person_parts(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    homes = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    found = read_models.person_detail(c.select("c_custkey"), {"statements": orders, "affiliations": homes}, "c_custkey", 5)
    shown = F.array_join(F.transform("statements", lambda s: F.concat_ws(":", s.o_orderkey, s.o_orderstatus)), ",")
    return found.select("c_custkey", shown.alias("statements"), F.get(F.col("affiliations.n_name"), F.lit(0)).alias("affiliation"))


@query("rd_freshness_histogram", "SELECT c_mktsegment AS kind, CASE WHEN c_acctbal > 5000 THEN 'current' WHEN c_acctbal > 0 THEN 'aging' ELSE 'stale' END AS state, count(*) AS sources, count(*) FILTER (WHERE c_nationkey = 3) AS failing FROM customer GROUP BY 1, 2")
def rd_freshness_histogram(spark, sf):
    state = F.when(F.col("c_acctbal") > 5000, "current").when(F.col("c_acctbal") > 0, "aging").otherwise("stale")
    return read_models.freshness_histogram(table(spark, sf, "customer"), "c_mktsegment", state, F.col("c_nationkey") == 3)


@query("sr_capped", "SELECT p_partkey, (SELECT count(*) FROM part) > 50 AS truncated FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def sr_capped(spark, sf):
    return read_models.capped(table(spark, sf, "part"), 50, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_partkey", "truncated")


@query("fn_sentence_spans", "SELECT item_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS joined FROM benchmark")
def fn_sentence_spans(spark, sf):
    """Sentences cut out of the text again by their offsets."""
    spans = tx.sentence_spans(F.col("text"))
    cut = F.transform(spans, lambda s: F.substring(F.col("text"), s.start + 1, s.stop - s.start))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(cut, "|").alias("joined"))


@query("fn_document_spans", "SELECT doc_id, true AS same, n FROM (SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM documents)")
def fn_document_spans(spark, sf):
    """On whole documents: offsets cut out just the sentences."""
    spans = tx.sentence_spans(F.col("text"))
    same = F.transform(spans, lambda s: F.substring(F.col("text"), s.start + 1, s.stop - s.start)) == tx.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", same.alias("same"), F.size(spans).cast("long").alias("n"))


@query("fn_blocked_ipv6", "SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN NULL WHEN 7 THEN true END AS blocked FROM nation")
def fn_blocked_ipv6(spark, sf):
    known = ["::1", "fe80::1", "fd00:1::2", "2606:4700::1111", "::ffff:10.0.0.1", "2001:4860:4860::8888", "1::2::3", "ff02::fb"]
    known[4] = "::ffff:a00:1"
    ip = F.element_at(F.lit(known).cast("array<string>"), (F.col("n_nationkey") % 8 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", tx.blocked_ipv6(ip).alias("blocked"))


@query("fn_mapped", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS state FROM orders")
def fn_mapped(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.mapped({"F": "final", "O": "open", "P": "pending"}, F.col("o_orderstatus")).alias("state"))


@query("sm_retained", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN o_totalprice END AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def sm_retained(spark, sf):
    admitted = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").alias("evidence"))
    return ingest.retained(table(spark, sf, "orders"), admitted, "o_custkey", "evidence", "o_totalprice").select("o_orderkey", "o_totalprice")


@query("ql_failures", "SELECT event_type AS adapter, CASE WHEN value < 5 THEN 'rate_limit' WHEN value < 20 THEN 'timeout' ELSE 'other' END AS class, count(*) AS runs FROM events GROUP BY 1, 2")
def ql_failures(spark, sf):
    status = F.when(F.col("value") < 5, "HTTP 429 too many").when(F.col("value") < 20, "read timed out").otherwise("odd")
    return ingest.failure_counts(table(spark, sf, "events").withColumn("status", status), "event_type", "status", {"rate_limit": r"\b429\b", "timeout": r"timed? ?out"})


@query(
    "ql_integrity_counts",
    "SELECT 'duplicate_identity' AS code, count(*) AS n FROM (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'several_current', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing_evidence', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT 'numeric_without_digit', count(*) FROM documents WHERE NOT regexp_matches(text, '[0-9]') UNION ALL SELECT 'impossible_probability', count(*) FROM events WHERE value NOT BETWEEN 0 AND 90 UNION ALL SELECT 'unavailable_source', count(*) FROM supplier WHERE s_acctbal < 0",
)
def ql_integrity_counts(spark, sf):
    t = lambda name: table(spark, sf, name)
    shown = t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return quality.integrity_counts(
        duplicate_identity=t("lineitem").groupBy("l_orderkey", "l_suppkey").count().where("count > 1"),
        several_current=t("orders").where("o_orderstatus = 'O'").groupBy("o_custkey").count().where("count > 1"),
        missing_evidence=t("customer").join(shown, "c_custkey", "left_anti"),
        numeric_without_digit=t("documents").where(~F.col("text").rlike("[0-9]")),
        impossible_probability=t("events").where(~F.col("value").between(0, 90)),
        unavailable_source=t("supplier").where("s_acctbal < 0"),
    )


@query(
    "cv_bands",
    "WITH p AS (SELECT c_custkey, c_nationkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS confirmed, count(o_orderkey) AS n, count(DISTINCT o_orderpriority) AS channels, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 420000 GROUP BY 1, 2) SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'ambiguous' WHEN confirmed > 0 THEN 'confirmed' WHEN n > 0 THEN 'likely' ELSE 'none' END AS band, CASE WHEN channels = 0 THEN 'none' WHEN channels = 1 THEN 'single' WHEN channels = 2 THEN 'paired' ELSE 'broad' END AS shape, CASE WHEN last IS NULL THEN 'never' WHEN date_diff('day', last::DATE, DATE '1998-08-02') <= 100 THEN 'fresh' WHEN date_diff('day', last::DATE, DATE '1998-08-02') <= 500 THEN 'known' ELSE 'older' END AS recency FROM p",
)
def cv_bands(spark, sf):
    seen = table(spark, sf, "orders").where("o_totalprice > 420000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("confirmed"), F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("channels"), F.max("o_orderdate").alias("last"))
    p = table(spark, sf, "customer").join(seen, "c_custkey", "left").fillna(0, ["confirmed", "n", "channels"])
    return p.select("c_custkey", quality.identity_band(F.col("confirmed"), F.col("n"), F.col("c_nationkey") == 7).alias("band"), quality.coverage_shape(F.col("channels")).alias("shape"), quality.recency(F.col("last"), F.lit("1998-08-02").cast("date"), [("fresh", 100), ("known", 500)]).alias("recency"))


@query("ex_initial_state", "SELECT o_orderkey, CASE WHEN o_totalprice <= 300000 AND o_orderkey % 3 <> 0 THEN 'machine_validated' ELSE 'needs_review' END AS state FROM orders")
def ex_initial_state(spark, sf):
    """Statements whose value stands in their evidence, and those of a longer number that only holds it."""
    n = F.col("o_orderkey").cast("string")
    said = F.concat(F.lit("It is "), F.when(F.col("o_orderkey") % 3 == 0, F.concat(n, F.lit("0.5"))).otherwise(n), F.lit(", they say"))
    flags = extract.review_flags(large=F.col("o_totalprice") > 300000)
    return table(spark, sf, "orders").select("o_orderkey", extract.initial_state(flags, extract.evidence_gate(said, n, F.lit(None).cast("string"))).alias("state"))


@query("src_episodes", "SELECT p_partkey, 'g' || p_partkey AS guid, CASE WHEN p_size % 2 = 0 THEN p_name END AS title, CASE p_size % 3 WHEN 0 THEN 3600 + p_size * 60 + 5 WHEN 1 THEN p_size END::INT AS seconds, CASE WHEN p_size % 5 <> 0 THEN 'https://a.example/' || p_partkey || '.mp3' END AS audio, CASE WHEN p_size % 5 <> 0 THEN true END AS is_audio FROM part")
def src_episodes(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_size") % 3
    length = F.when(k == 0, F.concat(F.lit("1:"), F.col("p_size").cast("string"), F.lit(":05"))).when(k == 1, F.col("p_size").cast("string")).otherwise("soon")
    audio = F.when(F.col("p_size") % 5 != 0, F.struct(F.concat(F.lit("https://a.example/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("url"), F.lit("audio/mpeg").alias("type")))
    episode = F.struct(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("guid"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ").alias("title"), length.alias("duration"), audio.alias("enclosure"))
    payload = F.to_json(F.struct(F.lit("f").alias("feed"), F.array(episode).alias("episodes")))
    return feeds.episodes(p.select("p_partkey", payload.alias("payload")), "payload", "p_partkey")


def _nested(path: str, leaf):
    """A struct expression that holds ``leaf`` at a JSON path such as ``$.a.b[0].c``."""
    import re

    out = leaf
    for step in reversed(re.findall(r"[^.\[\]$]+|\[0\]", path)):
        out = F.array(out) if step == "[0]" else F.struct(out.alias(step))
    return out


@query("src_all_records", "SELECT p_partkey, s AS source, 't' || p_partkey AS title, CASE WHEN s IN (" + ", ".join(f"'{k}'" for k, v in sorted(records.SPECS.items()) if "title" in v.required) + ") THEN 'missing_record_id' ELSE 'missing_record_id' END AS failure FROM part, (SELECT unnest([" + ", ".join(f"'{k}'" for k in sorted(records.SPECS) if records.SPECS[k].paths["title"] != records.SPECS[k].paths["record_id"]) + "]) AS s) WHERE p_partkey % 5 = 0")
def src_all_records(spark, sf):
    """Every record format on a payload that holds a title at that format's path, and no id."""
    p = table(spark, sf, "part").where("p_partkey % 5 = 0")
    title = F.concat(F.lit("t"), F.col("p_partkey").cast("string"))
    rows = F.array(*[F.struct(F.lit(k).alias("source"), F.to_json(_nested(s.paths["title"], title)).alias("payload")) for k, s in sorted(records.SPECS.items()) if s.paths["title"] != s.paths["record_id"]])
    found = records.read_records(p.select("p_partkey", F.explode(rows).alias("r")).select("p_partkey", "r.source", "r.payload"))
    return found.select("p_partkey", "source", "title", "failure")


@query("snk_files", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def snk_files(spark, sf):
    """A folder of JSON lines written twice: the second writing replaces the first as a whole."""
    import uuid

    from quern.sources import artifacts, sinks

    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_snapshot({"orders": o}, path)
    sinks.write_snapshot({"orders": o.where("o_orderstatus = 'F'")}, path)
    return artifacts.json_lines(spark, f"{path}/orders", "o_orderkey long, o_orderstatus string").select("o_orderkey", "o_orderstatus")


@query(
    "ev_record_errors",
    "WITH r AS (SELECT o_orderkey, o_orderkey % 50 = 0 AS synth, o_orderdate AS known, o_orderdate + INTERVAL 1 DAY * (o_custkey % 3 - 2) AS got, CASE WHEN o_custkey % 4 > 0 THEN o_orderdate + INTERVAL 30 DAY END AS rev, CASE o_custkey % 5 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'machine_validated' ELSE 'human_verified' END AS state, o_custkey % 6 <> 0 AS who, o_orderstatus = 'F' AS elig, CASE o_custkey % 7 WHEN 0 THEN 'restricted' WHEN 1 THEN 'metadata_only' ELSE 'redistribution_allowed' END AS rights, o_orderpriority = '1-URGENT' AS stmt, o_custkey % 2 = 0 AS excerpt FROM orders) SELECT o_orderkey, array_to_string(list_filter([CASE WHEN synth THEN 'mixed_synthetic' END, CASE WHEN got > known OR known > TIMESTAMP '1998-07-01' OR coalesce(rev > TIMESTAMP '1998-07-01', false) THEN 'time_order' END, CASE WHEN state <> 'unreviewed' AND rev IS NULL THEN 'review_timestamp' END, CASE WHEN state = 'human_verified' AND NOT who THEN 'human_reviewer' END, CASE WHEN elig AND (state <> 'human_verified' OR rights = 'restricted') THEN 'publication_gate' END, CASE WHEN elig AND (excerpt OR stmt) AND rights <> 'redistribution_allowed' THEN 'content_rights' END], lambda x: x IS NOT NULL), ',') AS codes FROM r",
)
def ev_record_errors(spark, sf):
    k = F.col("o_custkey")
    r = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 50 == 0).alias("is_synthetic"),
        F.col("o_orderdate").alias("known_at"),
        (F.col("o_orderdate") + F.make_dt_interval((k % 3 - 2).cast("int"))).alias("retrieved_at"),
        F.when(k % 4 > 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("reviewed_at"),
        F.when(k % 5 == 0, "unreviewed").when(k % 5 == 1, "machine_validated").otherwise("human_verified").alias("review_state"),
        F.when(k % 6 != 0, "someone").alias("reviewer"),
        F.when(F.col("o_orderstatus") == "F", "eligible").otherwise("held").alias("publication_state"),
        F.when(k % 7 == 0, "restricted").when(k % 7 == 1, "metadata_only").otherwise("redistribution_allowed").alias("rights_state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "statement").otherwise("source").alias("record_type"),
        (k % 2 == 0).alias("has_excerpt"),
    )
    codes = evidence.record_errors(F.lit("1998-07-01").cast("timestamp_ntz"), F.lit(False))
    return r.select("o_orderkey", F.array_join(codes, ",").alias("codes"))


@query(
    "ev_value_errors",
    "WITH v AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS k, l_partkey % 5 AS u, l_quantity AS a, l_quantity + (l_partkey % 3 - 1) * 10 AS b, l_discount AS d FROM lineitem) SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN k = 0 AND a > b THEN 'value_range' END, CASE WHEN k = 0 AND ((d > 0.03) <> (d > 0.05)) THEN 'interval_level' END, CASE WHEN k = 1 AND d >= 0.05 THEN 'quantile_order' END, CASE WHEN k = 1 AND a > b THEN 'quantile_monotonicity' END, CASE WHEN k = 2 AND u = 4 AND a <= 1 THEN 'empty_bound' WHEN k = 3 AND u IN (0) AND a >= 1 THEN 'empty_bound' WHEN k = 3 AND u = 1 AND a >= 100 THEN 'empty_bound' END, CASE WHEN (u IN (0, 1, 2) AND (a < 0 OR (k < 2 AND b < 0))) OR (u = 4 AND (a < 1 OR (k < 2 AND b < 1))) THEN 'unit_range' END, CASE WHEN u = 0 AND (a > 1 OR (k < 2 AND b > 1)) THEN 'probability_range' END], lambda x: x IS NOT NULL), ',') AS codes FROM v",
)
def ev_value_errors(spark, sf):
    """Intervals, quantiles and bounds of all units, some with numbers out of order or out of their unit's range."""
    k, u, a, d = F.col("l_suppkey") % 4, F.col("l_partkey") % 5, F.col("l_quantity"), F.col("l_discount")
    b = a + (F.col("l_partkey") % 3 - 1) * 10
    kind = F.when(k == 0, "interval").when(k == 1, "quantiles").when(k == 2, "upper_bound").otherwise("lower_bound")
    unit = F.when(u == 0, "probability").when(u == 1, "percent").when(u == 2, "people").when(u == 3, "dollars").otherwise("calendar_year")
    codes = evidence.value_errors(kind, unit, F.when(k < 2, F.array(a, b)).otherwise(F.array(a)), F.when(d > 0.05, 0.9), F.array(d, F.lit(0.05)), F.when(d > 0.03, "credible").otherwise("range"), F.lit(False))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(codes, ",").alias("codes"))


@query("ev_decode_code", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 32 & 3 END AS a, CASE WHEN l_partkey % 7 <> 0 THEN (l_partkey % 32 >> 2) & 7 END AS b FROM lineitem")
def ev_decode_code(spark, sf):
    code = F.when(F.col("l_partkey") % 7 == 0, " ").otherwise((F.col("l_partkey") % 32).cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", evidence.decode_code(code, {"a": 2, "b": 3}).alias("c")).select("l_orderkey", "l_linenumber", "c.a", "c.b")


@query(
    "ev_graph_problems",
    """WITH g AS (SELECT o_orderkey AS g, o_orderkey % 8 + 3 AS nodes FROM orders), e AS (SELECT l_orderkey AS g, l_partkey % 7 AS s, l_suppkey % 5 - CASE WHEN l_partkey % 50 = 0 THEN 9 ELSE 0 END AS t FROM lineitem)
    SELECT g, any_value(nodes) AS nodes, count(s) AS edges, CASE WHEN any_value(nodes) > 9 THEN 'too_many_nodes' WHEN count(s) > 5 THEN 'too_many_edges' WHEN max(greatest(s, t)) >= any_value(nodes) OR min(least(s, t)) < 0 THEN 'out_of_bounds' END AS problem, substring(sha256('g' || g), 1, 12) || ':7' AS local FROM g LEFT JOIN e USING (g) GROUP BY g""",
)
def ev_graph_problems(spark, sf):
    graphs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("g"), (F.col("o_orderkey") % 8 + 3).alias("n"))
    part = F.col("l_partkey")
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), (part % 7).alias("s"), (F.col("l_suppkey") % 5 - F.when(part % 50 == 0, 9).otherwise(0)).alias("t"))
    found = evidence.graph_problems(graphs, e, "g", "n", "s", "t", 9, 5)
    return found.withColumn("local", evidence.local_ids(F.lit(7), F.concat(F.lit("g"), F.col("g").cast("string"))))


@query(
    "src_paged",
    "WITH p AS (SELECT o_custkey AS feed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, o_orderkey, o_orderstatus <> 'P' AS more FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT *, coalesce(lag(more) OVER (PARTITION BY feed ORDER BY page), true) AS led FROM p), c AS (SELECT *, NOT bool_and(led) OVER (PARTITION BY feed ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM b) SELECT feed, page::BIGINT AS page, i::INT AS place, 'i' || o_orderkey || '/' || i AS item, broken FROM c, (SELECT unnest(range(2)) AS i)",
)
def src_paged(spark, sf):
    from pyspark.sql.window import Window

    o = table(spark, sf, "orders").where("o_orderkey % 3 <> 0")
    page = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    item = lambda i: F.concat(F.lit("i"), F.col("o_orderkey").cast("string"), F.lit(f"/{i}"))
    payload = F.to_json(F.struct(F.array(item(0), item(1)).alias("feed"), F.when(F.col("o_orderstatus") != "P", "next").alias("cursor")))
    pages = o.select(F.col("o_custkey").alias("feed"), page.alias("page"), payload.alias("payload"))
    return feeds.paged(pages, "feed", "page", "payload", "$.feed", "$.cursor")


# ---- bundles


def _orders_as_records(spark, sf):
    """Orders as records; each needs the one before it of the same customer, and every 16th one far back too."""
    from pyspark.sql.window import Window

    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    known = F.col("o_orderdate").cast("date")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "forecast").otherwise("statement")
    records = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"), kind.alias("kind"), known.alias("known_at"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(known, 30)).alias("reviewed_at"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(known, 10)).alias("latest"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    lags = o.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("a"), F.lag("o_orderkey", 5).over(w).alias("b"))
    before = lags.select("id", F.explode(F.array("a", F.when(F.col("id") % 16 == 0, F.col("b")))).alias("to_id")).where("to_id IS NOT NULL")
    return o, records, before.select("id", F.lit(1).alias("revision"), "to_id", F.lit(1).alias("to_revision"))


@query(
    "ev_closure",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS known_at, lag(o_orderkey) OVER w AS a, CASE WHEN o_orderkey % 16 = 0 THEN lag(o_orderkey, 5) OVER w END AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    e AS (SELECT o_orderkey AS id, a AS to_id FROM o WHERE a IS NOT NULL UNION SELECT o_orderkey, b FROM o WHERE b IS NOT NULL), k AS (SELECT o_orderkey AS id FROM o WHERE known_at <= DATE '1997-01-01'),
    r(bundle, id, depth) AS (SELECT o_custkey, o_orderkey, 0 FROM o WHERE o_orderkey % 7 = 0 AND o_orderkey IN (SELECT id FROM k) UNION SELECT bundle, e.to_id, depth + 1 FROM r JOIN e ON e.id = r.id WHERE e.to_id IN (SELECT id FROM k))
    SELECT bundle, id, min(depth) AS depth FROM r GROUP BY 1, 2""",
)
def ev_closure(spark, sf):
    """All that every seventh order needs, of what was known at a day."""
    o, records, references = _orders_as_records(spark, sf)
    seeds = o.where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"))
    return bundles.closure(seeds, references, records, "bundle", F.lit("1997-01-01").cast("date")).select("bundle", "id", "depth")


@query(
    "ev_snapshot_errors",
    """WITH o AS (SELECT o_custkey AS s, o_orderkey AS k, o_orderdate::DATE AS d, lag(o_orderkey) OVER w AS a, CASE WHEN o_orderkey % 16 = 0 THEN lag(o_orderkey, 5) OVER w END AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    m AS (SELECT * FROM o WHERE k % 6 <> 0), c AS (SELECT DATE '1996-06-01' AS cut)
    SELECT DISTINCT s AS snapshot, NULL::BIGINT AS id, 'snapshot_time' AS code FROM o WHERE s % 10 = 0
    UNION ALL SELECT DISTINCT s, NULL, 'snapshot_duplicate' FROM m WHERE k % 11 = 0
    UNION ALL SELECT DISTINCT s, k, 'snapshot_hash' FROM m WHERE k % 13 = 0
    UNION ALL SELECT s, k, 'snapshot_cutoff' FROM m, c, range(2) WHERE d > cut AND (range = 0 OR k % 11 = 0)
    UNION ALL SELECT s, k, 'snapshot_forecast_time' FROM m, c, range(2) WHERE s % 4 > 0 AND k % 2 = 0 AND (k % 5 = 0 OR d + 10 > cut) AND (range = 0 OR k % 11 = 0)
    UNION ALL SELECT s, k, 'snapshot_review' FROM m, c, range(2) WHERE s % 4 > 0 AND k % 3 = 0 AND d + 30 > cut AND (range = 0 OR k % 11 = 0)
    UNION ALL SELECT s, k, 'snapshot_closure' FROM m WHERE a % 6 = 0 OR b % 6 = 0""",
)
def ev_snapshot_errors(spark, sf):
    """A snapshot of each customer's orders: every sixth is left out, every 11th stands twice, every 13th has another digest in one of its rows."""
    o, records, references = _orders_as_records(spark, sf)
    cut = F.lit("1996-06-01").cast("date")
    s = F.col("o_custkey")
    snapshots = o.select(s.alias("snapshot"), (s % 4 > 0).alias("as_known"), cut.alias("cutoff"), F.when(s % 10 == 0, F.date_add(cut, -1)).otherwise(cut).alias("created_at"), F.date_add(cut, 1).alias("known_at")).distinct()
    k = F.col("o_orderkey")
    rows = o.where("o_orderkey % 6 <> 0").withColumn("i", F.explode(F.when(k % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    wrong = (k % 13 == 0) & (F.col("i") == 0)
    members = rows.select(s.alias("snapshot"), k.alias("id"), F.lit(1).alias("revision"), F.when(wrong, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"))
    return bundles.snapshot_errors(snapshots, members, records, references).select("snapshot", "id", "code")
