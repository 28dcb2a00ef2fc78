"""Review, export, identity and further evidence queries over the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx
from quern.operators import aggregates, comparability, evidence, ingest, mentions, quality, review, trends
from quern.plans.registry import query
from quern.session import table


@query(
    "rv_checked_decisions",
    """
WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'needs_changes' ELSE 'shrug' END AS decision, CASE WHEN o_orderkey % 12 = 0 THEN 50 ELSE 0 END AS start, 40 AS stop, CASE WHEN o_orderkey % 16 = 0 THEN -1.0 ELSE o_custkey END AS value, CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE o_orderstatus END AS h, o_orderstatus AS s FROM orders)
SELECT id, CASE WHEN decision = 'shrug' THEN 'unknown_decision' WHEN h <> s THEN 'source_changed' WHEN decision = 'approve' AND start = 50 THEN 'span_outside_text' WHEN decision = 'approve' AND value < 0 THEN 'number_not_in_evidence' END AS problem,
 CASE WHEN decision = 'shrug' OR h <> s OR (decision = 'approve' AND (start = 50 OR value < 0)) THEN NULL WHEN decision = 'approve' THEN 'human_verified' WHEN decision = 'reject' THEN 'rejected' ELSE 'needs_review' END AS state FROM d""",
)
def rv_checked_decisions(spark, sf):
    o, i = table(spark, sf, "orders"), F.col("o_orderkey")
    text = F.rpad(F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" said")), 45, " ")
    s = o.select(i.alias("id"), text.alias("text"), F.col("o_orderstatus").alias("content_hash"))
    d = o.select(
        i.alias("id"),
        F.when(i % 4 == 0, "approve").when(i % 4 == 1, "reject").when(i % 4 == 2, "needs_changes").otherwise("shrug").alias("decision"),
        F.when(i % 12 == 0, 50).otherwise(0).alias("start"),
        F.lit(40).alias("stop"),
        F.when(i % 16 == 0, -1.0).otherwise(F.col("o_custkey").cast("double")).alias("value"),
        F.when(i % 9 == 0, "x").otherwise(F.col("o_orderstatus")).alias("content_hash"),
    )
    return review.checked(d, s, "id").select("id", "problem", "state")


@query("rv_replay", "SELECT o_orderkey AS decision_key, 'log' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def rv_replay(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey").alias("decision_key")
    new = o.where("o_orderpriority = '1-URGENT'").select(key, F.lit("new").alias("origin"))
    return review.replay(o.where("o_orderstatus = 'F'").select(key, F.lit("log").alias("origin")), new.union(new))


@query(
    "rv_restored",
    "WITH c AS (SELECT user_id % 100 + 1 AS id, event_type, value, row_number() OVER (PARTITION BY user_id % 100 + 1, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('click', 'view')) SELECT p_partkey AS id, coalesce(a.value::VARCHAR, p_name) AS click, coalesce(b.value, p_retailprice) AS view FROM part LEFT JOIN c a ON a.id = p_partkey AND a.event_type = 'click' AND a.n = 1 LEFT JOIN c b ON b.id = p_partkey AND b.event_type = 'view' AND b.n = 1",
)
def rv_restored(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("click"), F.col("p_retailprice").alias("view"))
    c = table(spark, sf, "events").select((F.col("user_id") % 100 + 1).alias("id"), "ts", "event_id", F.create_map("event_type", F.col("value").cast("string")).alias("fields"))
    return review.restored(p, c, "id", "ts", "event_id")


@query("rv_staged", "SELECT l_partkey AS k, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1")
def rv_staged(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return review.staged(c, table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")), "k")


@query("rv_supported_numbers", "SELECT o_orderkey, o_orderkey % 3 <> 2 AS ok FROM orders")
def rv_supported_numbers(spark, sf):
    k = F.col("o_orderkey") % 3
    n = F.col("o_custkey").cast("double") + 200
    said = F.when(k == 0, F.concat(F.lit("about "), (F.col("o_custkey") + 200).cast("string"), F.lit("."))).when(k == 1, F.concat((F.col("o_custkey") + 200).cast("string"), F.lit("%"))).otherwise("no number 7")
    return table(spark, sf, "orders").select("o_orderkey", review.supported(F.when(k == 1, n / 100).otherwise(n), said).alias("ok"))


@query("xp_publication", "SELECT user_id, arg_max(event_type, event_id) AS last, CASE WHEN arg_max(event_type, event_id) IN ('succeeded','partial') THEN 'publish' ELSE 'hold' END AS decision FROM events GROUP BY 1")
def xp_publication(spark, sf):
    return review.publication_state(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("xp_membership_diff", "SELECT k, 'joined' AS change FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey >= 10 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT k, 'left' FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey >= 10)")
def xp_membership_diff(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_acctbal")
    return review.membership_diff(c.where("c_acctbal > 0"), c.where("c_nationkey >= 10"), "k")


@query("xp_vocabulary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS state, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN o_orderstatus END AS unmapped FROM orders")
def xp_vocabulary(spark, sf):
    return review.mapped(table(spark, sf, "orders"), "o_orderstatus", {"F": "final", "O": "open"}, "state").select("o_orderkey", "state", "unmapped")


@query("xp_versions", "SELECT user_id AS item, event_type AS content, 'item-' || substring(sha256(user_id || chr(10) || event_type), 1, 20) AS slug, count(*) AS seen FROM events GROUP BY 1, 2")
def xp_versions(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("content")).agg(F.count(F.lit(1)).alias("seen"))
    return e.select("item", "content", tx.prefixed_key("item", tx.content_key(F.col("item"), F.col("content"))).alias("slug"), "seen")


@query(
    "id_participants",
    "WITH a AS (SELECT o_orderkey AS item, c_custkey AS person FROM orders JOIN customer ON c_custkey = o_custkey), b AS (SELECT o_orderkey AS item, c_custkey AS person FROM orders JOIN customer ON c_custkey = o_custkey + 1) SELECT item, person, 'author' AS role FROM a UNION ALL SELECT item, person, 'mentioned' FROM b WHERE (item, person) NOT IN (SELECT (item, person) FROM a)",
)
def id_participants(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("display"))
    authors = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.format_string("Customer#%09d", F.col("o_custkey")).alias("name"))
    bodies = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.format_string("as customer#%09d said", F.col("o_custkey") + 1).alias("body"))
    return review.participants(authors, bodies, people, "item", "name", "body", "person", "display")


@query("cv_report_delta", "WITH b AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), a AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderpriority <> '5-LOW' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, b.v AS before, a.v AS after, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta FROM b FULL JOIN a ON a.k = b.k")
def cv_report_delta(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "k")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    n = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("v"))
    return review.merged_runs(n(o.where(F.col("o_orderdate") < cut)), n(o.where((F.col("o_orderdate") >= cut) & (F.col("k") != "5-LOW"))), "k", "v")


@query("ql_gaps", "SELECT c_custkey, CASE WHEN n IS NULL AND c_acctbal < 0 THEN 'no_known_source' WHEN n IS NULL THEN 'not_attempted' WHEN f = 0 THEN 'awaiting_review' END AS gap FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def ql_gaps(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), aggregates.count_where(F.col("o_orderstatus") == "F").alias("f"))
    none = F.col("n").isNull()
    gap = quality.first_gap([("no_known_source", none & (F.col("c_acctbal") < 0)), ("not_attempted", none), ("awaiting_review", F.col("f") == 0)])
    return table(spark, sf, "customer").join(n, "c_custkey", "left").select("c_custkey", gap.alias("gap"))


@query("ql_time_relation", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'same_day' WHEN 2 THEN 'observed_later' ELSE 'observed_earlier' END AS relation FROM orders")
def ql_time_relation(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    seen = F.when(k == 1, d + F.expr("interval 20 hours")).when(k == 2, d + F.expr("interval 30 hours")).when(k == 3, d - F.expr("interval 3 days"))
    return table(spark, sf, "orders").select("o_orderkey", quality.time_relation(d, seen).alias("relation"))


@query("sm_source_slice", "SELECT s_suppkey, place FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey <= 4)::INT, s_suppkey)::INT AS place FROM supplier) WHERE place <= 2")
def sm_source_slice(spark, sf):
    from quern.operators.windows import rotation

    return rotation(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", 4, 2).select("s_suppkey", "place")


@query("sm_retention", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN o_totalprice END AS kept_price FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def sm_retention(spark, sf):
    admitted = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").alias("evidence"))
    return table(spark, sf, "orders").join(admitted, "o_custkey").select("o_orderkey", F.when(F.col("evidence"), F.col("o_totalprice")).alias("kept_price"))


@query(
    "sm_provenance",
    "SELECT event_id, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY first)::INT AS revision FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type, props) AS first FROM events)",
)
def sm_provenance(spark, sf):
    from quern.operators.windows import content_versions

    e = table(spark, sf, "events").withColumn("item", F.concat_ws("|", "user_id", "event_type"))
    return content_versions(e, "item", "props", "event_id").select("event_id", F.col("version").alias("revision"))


@query("tr_unpooled", "SELECT o_orderpriority AS family, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'")
def tr_unpooled(spark, sf):
    o = table(spark, sf, "orders").withColumn("poolable", F.col("o_orderstatus") != "P")
    taken = spark.createDataFrame([("1-URGENT",)], "o_orderpriority string")
    return o.where("not poolable").join(F.broadcast(taken), "o_orderpriority", "left_anti").select(F.col("o_orderpriority").alias("family"), "o_orderkey")


@query(
    "tr_method_resolution",
    "WITH m AS (SELECT o_orderpriority AS kind, o_orderstatus AS exact_id, 'published' AS source, 1 AS rank, min(o_orderkey) AS slug FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, o_orderstatus, 'prepared', 2, min(o_orderkey) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, o_orderstatus, 'discovered', 3, min(o_orderkey) FROM orders GROUP BY 1, 2) SELECT kind, exact_id, arg_min(source, rank) AS source, arg_min(slug, rank) AS slug FROM m GROUP BY 1, 2",
)
def tr_method_resolution(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("exact_id"), "o_orderkey")
    part = lambda df, name, rank: df.groupBy("kind", "exact_id").agg(F.min("o_orderkey").alias("slug")).select("*", F.lit(name).alias("source"), F.lit(rank).alias("rank"))
    m = part(o.where("exact_id = 'P'"), "published", 1).unionByName(part(o.where("kind in ('1-URGENT', '2-HIGH')"), "prepared", 2)).unionByName(part(o, "discovered", 3))
    w = Window.partitionBy("kind", "exact_id").orderBy("rank")
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").select("kind", "exact_id", "source", "slug")


@query("tr_timeline", "WITH r AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_orderpriority, count(*) AS people, count(y) AS points, min(y) AS low, max(y) AS high, median(y) AS middle, 'comparable' AS density FROM r WHERE n = 1 GROUP BY 1")
def tr_timeline(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return trends.cross_section(o, "o_orderpriority", "o_custkey", "y", F.col("o_orderdate"), "o_orderkey")


@query("cp_semantics", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'qualitative' WHEN 1 THEN 'probability' WHEN 2 THEN 'timeline' WHEN 3 THEN 'quantity' END AS meaning FROM part")
def cp_semantics(spark, sf):
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "qualitative").otherwise("point")
    unit = F.when(k == 1, "probability").when(k == 2, "year").when(k == 3, "tons")
    return table(spark, sf, "part").select("p_partkey", comparability.semantics(kind, unit).alias("meaning"))


@query("fn_json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events")
def fn_json_access(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.array_contains(F.json_object_keys("props"), "k"), F.lit(False)).alias("has_k"), F.coalesce(F.array_contains(F.json_object_keys("props"), "z"), F.lit(False)).alias("has_z"))


@query("fn_ordinality", "SELECT p_partkey, w AS word, n::INT AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS n FROM part)")
def fn_ordinality(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("n", "word")).select("p_partkey", "word", (F.col("n") + 1).alias("place"))


@query("fn_word_sequence", "SELECT p_partkey, contains(' ' || lower(p_name) || ' ', ' ' || split_part(lower(p_name), ' ', 2) || ' ') AS has_second, contains(' ' || lower(p_name) || ' ', ' blue ') AS has_blue FROM part")
def fn_word_sequence(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", tx.contains_words(name, F.split_part(name, F.lit(" "), F.lit(2))).alias("has_second"), tx.contains_words(name, F.lit("Blue")).alias("has_blue"))


@query("fn_mentions", "SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') AS named FROM documents")
def fn_mentions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.mentions(F.col("text"), "The").alias("named"))


@query("ev_grouped_decisions", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_partkey & 1)::BIGINT AS yes FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def ev_grouped_decisions(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", *evidence.decode_bits(F.col("l_partkey"), {"yes": 1}))  # noqa: E741
    return l.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("yes").alias("yes"))


@query("ev_partition_sums", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) = count(*) AS adds_up FROM orders GROUP BY 1")
def ev_partition_sums(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "o_orderpriority").select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), (F.col("F") + F.col("O") + F.col("P") == F.col("n")).alias("adds_up"))


@query("ev_quantile_order", "SELECT event_type, quantile_disc(value, 0.25) <= median(value) AND median(value) <= quantile_disc(value, 0.75) AS ordered FROM events GROUP BY 1")
def ev_quantile_order(spark, sf):
    g = aggregates.nearest_ranks(table(spark, sf, "events"), ["event_type"], "value", a=0.25, b=0.5, c=0.75)
    return g.select("event_type", evidence.values_in_order(F.col("a"), F.col("b"), F.col("c")).alias("ordered"))


@query("sm_outcomes_by_source", "SELECT s, outcome, count(*) AS runs, sum(n)::BIGINT AS rows FROM (SELECT event_type AS s, user_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE value < 20) = 0 THEN 'succeeded' WHEN count(*) FILTER (WHERE value < 20) < count(*) THEN 'partial' ELSE 'failed' END AS outcome FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def sm_outcomes_by_source(spark, sf):
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"), aggregates.count_where(F.col("value") < 20).alias("bad"))
    r = r.withColumn("outcome", ingest.run_outcome(F.col("n"), F.col("bad")))
    return r.groupBy("s", "outcome").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("rows"))


@query(
    "id_mentions",
    r"""WITH p AS (SELECT item_id AS person, regexp_extract(text, '^(\S+ \S+)', 1) AS name FROM benchmark),
    c AS MATERIALIZED (SELECT doc_id, person, text, name FROM documents, p WHERE name <> '' AND contains(lower(text), lower(name))),
    m AS (SELECT doc_id, person FROM c WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(name) || '($|[^\p{L}\p{N}_])'))
    SELECT doc_id, doc_id % 50 AS person, 'author' AS role FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, person, 'mentioned' FROM m WHERE doc_id % 3 <> 0 OR person <> doc_id % 50""",
)
def id_mentions(spark, sf):
    """People named like the first two words of a benchmark item, in all documents; every third document has an author."""
    docs = table(spark, sf, "documents")
    people = table(spark, sf, "benchmark").select(F.col("item_id").alias("person"), F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("name"))
    authors = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 50).alias("person"))
    return mentions.participants(docs, "doc_id", "text", authors, people, "person", "name")
