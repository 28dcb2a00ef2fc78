"""Filter, projection, join, aggregation, window, paging and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import aggregates, filters, joins, paging, windows
from quern.plans.registry import query
from quern.session import table

# ---- filters and projections


@query(
    "flt_optional_conjunction",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31 23:59:59.999' AND o_orderpriority IN ('1-URGENT','2-HIGH')",
)
def flt_optional_conjunction(spark, sf):
    orders = table(spark, sf, "orders")
    found = filters.where_all(orders, filters.equals("o_orderstatus", "F"), filters.equals("o_custkey", None), filters.day_range("o_orderdate", "1995-01-01", "1996-12-31"), filters.one_of("o_orderpriority", ["1-URGENT", "2-HIGH"]))
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("flt_day_range_end", "SELECT count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 23:59:59.999'")
def flt_day_range_end(spark, sf):
    return filters.where_all(table(spark, sf, "events"), filters.day_range("ts", None, "2024-01-15")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_none_matches", "SELECT count(*) FILTER (WHERE kind = 'none') AS no_value, count(*) FILTER (WHERE kind = 'all') AS no_filter FROM (SELECT 'all' AS kind FROM orders UNION ALL SELECT 'none' FROM orders WHERE o_orderstatus IN (SELECT o_orderstatus FROM orders WHERE false))")
def flt_none_matches(spark, sf):
    orders = table(spark, sf, "orders")
    kinds = filters.where_all(orders, filters.one_of("o_orderstatus", [])).select(F.lit("none").alias("kind")).unionByName(filters.where_all(orders, filters.one_of("o_orderstatus", None)).select(F.lit("all").alias("kind")))
    return kinds.agg(F.count(F.when(F.col("kind") == "none", 1)).alias("no_value"), F.count(F.when(F.col("kind") == "all", 1)).alias("no_filter"))


@query("flt_distinct_from", "SELECT event_id, event_type, lag_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_type FROM events) WHERE event_type IS DISTINCT FROM lag_type")
def flt_distinct_from(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", "event_type", F.lag("event_type").over(w).alias("lag_type"))
    return e.where(~F.col("event_type").eqNullSafe(F.col("lag_type")))


@query("flt_like_escape", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a!_%' ESCAPE '!' OR p_name LIKE 'b%' OR contains(lower(p_name), 'an')")
def flt_like_escape(spark, sf):
    p = table(spark, sf, "part")
    pattern = f"%{filters.escape_like('a_')}%"
    return p.where(F.expr(f"p_name ilike '{pattern}' escape '!'") | p.p_name.startswith("b") | filters.contains_text("p_name", "AN")).select("p_partkey", "p_name")


@query("flt_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-9]*[13579]$')")
def flt_regex(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").rlike("[0-9]*[13579]$")).select("c_custkey")


@query(
    "flt_or_exists",
    "SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000) OR EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n_regionkey = 2)",
)
def flt_or_exists(spark, sf):
    c = table(spark, sf, "customer")
    rich = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("rich", F.lit(True))
    near = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey")).withColumn("near", F.lit(True))
    return c.join(rich, "c_custkey", "left").join(near, "c_nationkey", "left").where("c_acctbal < 0 or rich or near").select("c_custkey")


@query(
    "prj_gated_values",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS shown_price, CASE WHEN o_orderstatus = 'F' THEN 'explicit' ELSE 'none' END AS value_type, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN o_orderstatus ELSE o_orderpriority END AS state FROM orders",
)
def prj_gated_values(spark, sf):
    explicit = F.col("o_orderstatus") == "F"
    top = filters.downgraded(F.col("o_orderpriority"), F.when(explicit, F.lit("1-URGENT")).otherwise(F.col("o_orderstatus")), "1-URGENT")
    return table(spark, sf, "orders").select("o_orderkey", filters.gated(explicit, "o_totalprice").alias("shown_price"), F.when(explicit, "explicit").otherwise("none").alias("value_type"), top.alias("state"))


@query("prj_excerpt", "SELECT doc_id, substring(text, 1, 80) AS excerpt, length(text) > 80 AS truncated FROM documents")
def prj_excerpt(spark, sf):
    x = filters.excerpt("text", 80)
    return table(spark, sf, "documents").select("doc_id", x["text"].alias("excerpt"), x["truncated"].alias("truncated"))


@query("prj_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def prj_iso_time(spark, sf):
    return table(spark, sf, "events").select("event_id", filters.iso_micros("ts").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


# ---- joins


@query(
    "jn_star",
    "SELECT r_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def jn_star(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("jn_left_on_predicate", "SELECT c_custkey, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1")
def jn_left_on_predicate(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.left_with(table(spark, sf, "customer"), orders, "c_custkey", F.col("o_orderstatus") == "O").groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_orders"))


@query(
    "jn_lateral_aggregate",
    "SELECT c_custkey, coalesce(x.n, 0) AS n, x.statuses FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1) x ON x.o_custkey = c_custkey",
)
def jn_lateral_aggregate(spark, sf):
    x = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses"))
    return table(spark, sf, "customer").select("c_custkey").join(x, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "statuses")


@query(
    "jn_lateral_top_one",
    "SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o ON true",
)
def jn_lateral_top_one(spark, sf):
    best = joins.top_one(table(spark, sf, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return table(spark, sf, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query("jn_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jn_semi(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("jn_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 450000)")
def jn_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("jn_parameters", "SELECT e.event_id, e.value FROM events e CROSS JOIN (SELECT avg(value) AS mean FROM events) p WHERE e.value > p.mean")
def jn_parameters(spark, sf):
    e = table(spark, sf, "events")
    return e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("mean")))).where("value > mean").select("event_id", "value")  # one row on the right


@query("jn_json_entries", "SELECT k AS key, count(*) AS n, sum(v) AS total FROM (SELECT unnest(json_keys(props)) AS k, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS BIGINT) AS v FROM events) GROUP BY 1")
def jn_json_entries(spark, sf):
    entries = table(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(
    "jn_edges_both_ends",
    "WITH e AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) SELECT e.event_id AS to_id, e.prev AS from_id, a.value AS from_value, b.value AS to_value FROM e JOIN events a ON a.event_id = e.prev JOIN events b ON b.event_id = e.event_id WHERE a.value IS NOT NULL AND b.value > a.value",
)
def jn_edges_both_ends(spark, sf):
    e = table(spark, sf, "events")
    edges = joins.previous_row(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id"]).select(F.col("event_id").alias("to_id"), F.col("previous_event_id").alias("from_id"))
    a, b = e.select(F.col("event_id").alias("from_id"), F.col("value").alias("from_value")), e.select(F.col("event_id").alias("to_id"), F.col("value").alias("to_value"))
    return edges.join(a, "from_id").join(b, "to_id").where("from_value is not null and to_value > from_value")


@query("jn_self_parent", "SELECT n.n_nationkey, n.n_name, p.n_name AS parent FROM nation n LEFT JOIN nation p ON p.n_nationkey = n.n_nationkey % 5 AND p.n_nationkey <> n.n_nationkey")
def jn_self_parent(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") % 5).alias("up"))
    p = n.select(F.col("n_nationkey").alias("up"), F.col("n_name").alias("parent_name"))
    return n.join(p, "up", "left").select("n_nationkey", "n_name", F.when(F.col("up") != F.col("n_nationkey"), F.col("parent_name")).alias("parent"))


@query("jn_cohort_scope", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS members, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def jn_cohort_scope(spark, sf):
    cohort = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(cohort, "o_custkey").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("members"), F.count(F.lit(1)).alias("orders"))


@query("jn_tuple_compare", "SELECT count(*) AS n FROM events e, (SELECT ts, event_id FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 100) c WHERE (e.ts, e.event_id) <= (c.ts, c.event_id)")
def jn_tuple_compare(spark, sf):
    e = table(spark, sf, "events")
    cut = e.orderBy("ts", "event_id").offset(100).limit(1).select(F.struct("ts", "event_id").alias("cut"))
    return e.crossJoin(F.broadcast(cut)).where(F.struct("ts", "event_id") <= F.col("cut")).agg(F.count(F.lit(1)).alias("n"))  # one row on the right


@query(
    "jn_containing_span",
    """
WITH s AS (SELECT o_custkey AS k, o_orderkey AS span, o_totalprice AS lo, o_totalprice + 20000 AS hi FROM orders),
p AS (SELECT o_orderkey, o_custkey AS k, o_totalprice - 5000 AS x FROM orders),
j AS (SELECT p.o_orderkey, s.span, row_number() OVER (PARTITION BY p.o_orderkey ORDER BY s.lo NULLS LAST, s.span NULLS LAST) AS n FROM p LEFT JOIN s ON s.k = p.k AND p.x >= s.lo AND p.x < s.hi)
SELECT o_orderkey, span FROM j WHERE n = 1""",
)
def jn_containing_span(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    spans = o.select("k", F.col("o_orderkey").alias("span"), F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 20000).alias("hi"))
    points = o.select("o_orderkey", "k", (F.col("o_totalprice") - 5000).alias("x"), F.col("o_orderkey").alias("_row"))
    return joins.containing_span(points, spans, ["k"], "x", "lo", "hi", F.asc_nulls_last("lo"), F.asc_nulls_last("span")).select("o_orderkey", "span")


@query("jn_previous_view", "SELECT event_id, previous_value, value - previous_value AS delta FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous_value FROM events)")
def jn_previous_view(spark, sf):
    return joins.previous_row(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["value"]).select("event_id", "previous_value", (F.col("value") - F.col("previous_value")).alias("delta"))


@query(
    "jn_unique_owner",
    "WITH k AS (SELECT substring(c_name, length(c_name) - 2, 3) AS key, min(c_custkey) AS owner FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1) SELECT s_suppkey, owner FROM supplier JOIN k ON k.key = substring(s_name, length(s_name) - 2, 3)",
)
def jn_unique_owner(spark, sf):
    key = lambda c: F.substring(c, -3, 3)
    keys = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(key("c_name").alias("key"), F.col("c_custkey").alias("owner"))
    names = table(spark, sf, "supplier").select("s_suppkey", key("s_name").alias("key"))
    return joins.unique_owner(names, keys, "key", "owner").select("s_suppkey", "owner")


@query(
    "jn_key_diff",
    """
WITH b AS (SELECT l_partkey AS k, count(*) AS v FROM lineitem WHERE year(l_shipdate) = 1994 AND l_returnflag = 'R' GROUP BY 1), a AS (SELECT l_partkey AS k, count(*) AS v FROM lineitem WHERE year(l_shipdate) = 1995 AND l_returnflag = 'A' GROUP BY 1)
SELECT coalesce(b.k, a.k) AS k, b.v AS before, a.v AS after, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'aligned' END AS change FROM b FULL JOIN a ON a.k = b.k""",
)
def jn_key_diff(spark, sf):
    l = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "k")  # noqa: E741
    b = l.where("year(l_shipdate) = 1994 and l_returnflag = 'R'").groupBy("k").agg(F.count(F.lit(1)).alias("v"))
    a = l.where("year(l_shipdate) = 1995 and l_returnflag = 'A'").groupBy("k").agg(F.count(F.lit(1)).alias("v"))
    return joins.key_diff(b, a, "k", "v")


# ---- aggregations


@query(
    "ag_filtered_counts",
    "SELECT o_orderstatus, count(*)::INT AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS large, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_customers, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 150000) AS large_customers FROM orders GROUP BY 1",
)
def ag_filtered_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        aggregates.count_where(F.col("o_totalprice") > 150000).alias("large"),
        aggregates.distinct_where("o_custkey", F.col("o_orderpriority") == "1-URGENT").alias("urgent_customers"),
        aggregates.distinct_where("o_custkey", F.col("o_totalprice") > 150000).alias("large_customers"),
    )


@query("ag_duplicates", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ag_duplicates(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "ag_counts_by_type",
    "SELECT o_custkey, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS by_type, sum(n)::BIGINT AS total FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def ag_counts_by_type(spark, sf):
    found = aggregates.counts_by_type(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")
    return found.select("o_custkey", F.array_join(F.transform("by_type", lambda e: F.concat(e["o_orderstatus"], F.lit("="), e["n"].cast("string"))), ",").alias("by_type"), "total")


@query(
    "ag_last_wins",
    "SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def ag_last_wins(spark, sf):
    return aggregates.last_per_key(table(spark, sf, "events"), "user_id", "event_type", "value", "ts", "event_id")


@query("ag_extremes", "SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, strftime(max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END), '%Y-%m-%d') AS last_final FROM orders GROUP BY 1")
def ag_extremes(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"), day(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))).alias("last_final"))


@query("ag_sum_or_zero", "SELECT c_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0)::BIGINT AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def ag_sum_or_zero(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf, "customer").join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", 1)), F.lit(0)).alias("pending"))


@query("ag_change_mark", "SELECT count(*) AS n, bit_xor(('0x' || substring(md5(o_orderkey::VARCHAR || chr(31) || o_orderstatus || chr(31) || o_custkey::VARCHAR), 1, 15))::BIGINT) AS mark FROM orders")
def ag_change_mark(spark, sf):
    return aggregates.change_mark(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", "o_custkey")


@query("ag_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(value) AS n FROM events GROUP BY 1")
def ag_percentiles(spark, sf):
    return aggregates.nearest_ranks(table(spark, sf, "events"), ["event_type"], "value", p50=0.5, p95=0.95)


@query("ag_tally", "SELECT 'status' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def ag_tally(spark, sf):
    return aggregates.tally(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), "status", "priority")


@query("ag_best_state", "SELECT o_custkey, arg_min(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS state FROM orders GROUP BY 1")
def ag_best_state(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(aggregates.best_state("o_orderstatus", ["F", "O", "P"]).alias("state"))


@query("ag_ratios", "SELECT o_orderpriority, CASE WHEN count(*) = 0 THEN NULL ELSE round_even(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 4) END AS final_share FROM orders GROUP BY 1")
def ag_ratios(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(aggregates.ratio(aggregates.count_where(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("final_share"))


@query("ag_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (1, 2)")
def ag_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ag_people_once", "SELECT p_brand, count(DISTINCT o_custkey) AS people FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def ag_people_once(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("p_brand").agg(F.countDistinct("o_custkey").alias("people"))


# ---- windows


@query(
    "wn_content_versions",
    "WITH c AS (SELECT event_id, user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY first)::INT AS version FROM c",
)
def wn_content_versions(spark, sf):
    return windows.content_versions(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("event_id", "version")


@query(
    "wn_islands",
    "WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c) SELECT conv_id, island::BIGINT AS island, min(role) AS role, count(*) AS turns, min(turn) AS first_turn FROM i GROUP BY 1, 2",
)
def wn_islands(spark, sf):
    return windows.islands(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"))


@query("wn_offsets", "SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def wn_offsets(spark, sf):
    return windows.running_offset(table(spark, sf, "conversations"), ["conv_id"], "turn", F.length("text"), 1).select("conv_id", "turn", "start")


@query("wn_neighbours", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def wn_neighbours(spark, sf):
    return windows.neighbours(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "before", "after")


@query(
    "wn_best_three",
    "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, rank() OVER w AS r, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity DESC)) SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, c <= 3 AS certain FROM r WHERE r <= 3",
)
def wn_best_three(spark, sf):
    return windows.best_k(table(spark, sf, "lineitem"), ["l_suppkey"], F.desc("l_quantity"), "l_orderkey", 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "certain")


@query(
    "wn_first_crossing",
    "WITH v AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM v WHERE value >= 90) SELECT user_id, event_id, value, before FROM h WHERE n = 1",
)
def wn_first_crossing(spark, sf):
    return windows.first_crossing(table(spark, sf, "events"), ["user_id"], "event_id", "value", 90).select("user_id", "event_id", "value", "before")


@query(
    "wn_budget",
    "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC NULLS LAST, o_orderkey)::INT AS place FROM orders) WHERE place <= 4",
)
def wn_budget(spark, sf):
    return windows.budget(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT", "o_totalprice", "o_orderkey", 4).select("o_custkey", "o_orderkey", "place")


@query(
    "wn_rotation",
    "SELECT * FROM (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY (n_nationkey <= 12)::INT, n_nationkey)::INT AS place FROM nation) WHERE place <= 3",
)
def wn_rotation(spark, sf):
    return windows.rotation(table(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", 12, 3).select("n_regionkey", "n_nationkey", "place")


@query("wn_dense_sequence", "SELECT l_orderkey, l_partkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey)::INT AS seq FROM lineitem")
def wn_dense_sequence(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")).alias("seq"))


@query("wn_recent_errors", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS recent FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 8 GROUP BY 1")
def wn_recent_errors(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    kept = table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 8")
    return kept.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("recent"))


# ---- sorting and paging


def _timed_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("at"))


_TIMED = "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS seen FROM orders)"


@query("sr_first_page", f"{_TIMED} SELECT o_orderkey, strftime(seen, '%Y-%m-%d') AS day, (SELECT count(*) FROM t) > 20 AS more FROM t ORDER BY seen DESC NULLS LAST, o_orderkey DESC LIMIT 20")
def sr_first_page(spark, sf):
    return paging.page(_timed_orders(spark, sf), "at", "o_orderkey", 20).select("o_orderkey", F.date_format("at", "yyyy-MM-dd").alias("day"), "more")


@query(
    "sr_next_page",
    f"{_TIMED} SELECT o_orderkey, strftime(seen, '%Y-%m-%d') AS day FROM t WHERE seen < TIMESTAMP '1996-06-01' OR (seen = TIMESTAMP '1996-06-01' AND o_orderkey < 700) OR seen IS NULL ORDER BY seen DESC NULLS LAST, o_orderkey DESC LIMIT 15",
)
def sr_next_page(spark, sf):
    return paging.page(_timed_orders(spark, sf), "at", "o_orderkey", 15, paging.Cursor("1996-06-01", 700)).select("o_orderkey", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query(
    "sr_previous_page",
    f"{_TIMED} SELECT o_orderkey, strftime(seen, '%Y-%m-%d') AS day FROM t WHERE seen > TIMESTAMP '1996-06-01' OR (seen = TIMESTAMP '1996-06-01' AND o_orderkey > 700) ORDER BY seen ASC, o_orderkey ASC LIMIT 15",
)
def sr_previous_page(spark, sf):
    return paging.page(_timed_orders(spark, sf), "at", "o_orderkey", 15, paging.Cursor("1996-06-01", 700, backward=True)).select("o_orderkey", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("sr_page_of_undated", f"{_TIMED} SELECT o_orderkey FROM t WHERE seen IS NULL AND o_orderkey < 600 ORDER BY o_orderkey DESC LIMIT 10")
def sr_page_of_undated(spark, sf):
    return paging.page(_timed_orders(spark, sf), "at", "o_orderkey", 10, paging.Cursor(None, 600)).select("o_orderkey")


@query("sr_name_page", "SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000040' ORDER BY c_name, c_custkey LIMIT 25")
def sr_name_page(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name") > "Customer#000000040").orderBy("c_name", "c_custkey").limit(25).select("c_custkey", "c_name")


@query(
    "sr_ranked_page",
    "WITH r AS (SELECT p_partkey, p_name, p_size % 5 AS rank FROM part) SELECT p_partkey, p_name, rank FROM r WHERE rank < 3 OR (rank = 3 AND (p_name > 'm' OR (p_name = 'm' AND p_partkey > 10))) ORDER BY rank DESC, p_name, p_partkey LIMIT 30",
)
def sr_ranked_page(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_size") % 5).alias("rank"))
    return r.where(paging.ranked_behind("rank", "p_name", "p_partkey", (3, "m", 10))).orderBy(F.desc("rank"), "p_name", "p_partkey").limit(30)


@query("sr_offset_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def sr_offset_page(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


# ---- sets


@query("st_union_all", "SELECT 'nation' AS kind, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'region', r_regionkey::BIGINT FROM region")
def st_union_all(spark, sf):
    kinds = (("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("region", "r_regionkey"))
    frames = [table(spark, sf, k).select(F.lit(k).alias("kind"), F.col(c).cast("long").alias("id")) for k, c in kinds]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("st_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def st_union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("st_except_intersect", "SELECT 'only' AS side, k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', k FROM (SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier)")
def st_except_intersect(spark, sf):
    n, s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return n.subtract(s).select(F.lit("only").alias("side"), "k").union(n.intersect(s).select(F.lit("both"), "k"))


@query("st_exclusive_ids", "SELECT l_partkey AS id, min(l_suppkey) AS owner FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def st_exclusive_ids(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("owner"), F.countDistinct("l_suppkey").alias("n")).where("n = 1").drop("n")


@query(
    "st_merge_conflicts",
    "WITH old AS (SELECT o_orderkey AS k, o_custkey AS owner FROM orders WHERE o_orderstatus <> 'O'), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS owner FROM orders WHERE o_orderpriority = '1-URGENT') SELECT coalesce(old.k, new.k) AS k, coalesce(old.owner, new.owner) AS owner, coalesce(old.owner <> new.owner, false) AS conflict FROM old FULL JOIN new ON old.k = new.k",
)
def st_merge_conflicts(spark, sf):
    from quern.operators.ingest import merge_keeping_first

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("owner"), "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderpriority = '1-URGENT'").withColumn("owner", F.when(F.col("o_orderstatus") == "P", F.col("owner") + 1).otherwise(F.col("owner")))
    return merge_keeping_first(o.where("o_orderstatus <> 'O'"), new, ["k"], "owner")
