"""Source, sink, extraction and evidence queries over the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import evidence, extract, forecasts, identity
from quern.plans.registry import query
from quern.session import table
from quern.sources import feeds, pages, records, sinks


@query("src_page_text")
def src_page_text(spark, sf):
    p = pages.parse_pages(table(spark, sf, "pages"))
    return p.select("page_id", "title", F.length("text").alias("chars"), "language", F.size("links").alias("links"))


@query("src_page_catalog")
def src_page_catalog(spark, sf):
    return pages.catalog(table(spark, sf, "pages"), [pages.Publisher("Net", ("blog.tionsh.example.net", "blog.ththan.example.net")), pages.Publisher("Org", ("thther.example.org",), "/en")])


@query("src_page_feeds", "SELECT page_id, 'https://p' || page_id || '.example/' || CASE page_id % 3 WHEN 0 THEN 'feed.xml' WHEN 1 THEN 'news/rss' END AS url FROM pages WHERE page_id % 3 < 2 UNION ALL SELECT page_id, 'https://p' || page_id || '.example/all' FROM pages WHERE page_id % 3 = 0")
def src_page_feeds(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id") % 3
    link = F.when(k == 0, '<link rel="alternate" type="application/rss+xml" href="/all"><link rel="alternate" href="/feed.xml">').when(k == 1, '<a href="/news/rss">news</a>').otherwise('<a href="/feeding">x</a>')
    made = p.select("page_id", F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example/start")).alias("url"), F.concat(F.lit("<html><head>"), F.when(k == 0, link).otherwise(""), F.lit("</head><body>"), F.when(k != 0, link).otherwise(""), F.regexp_extract("html", r"(?s)<body>(.*)", 1)).alias("html"))
    return pages.feeds_of(pages.parse_pages(made))


@query(
    "src_records",
    "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'zenodo' ELSE 'crossref' END AS source, p_partkey::VARCHAR AS record_id, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS title, p_size::VARCHAR AS published, CASE WHEN p_partkey % 2 = 0 THEN 'cc-by' END AS license, CASE WHEN p_partkey % 7 = 0 THEN 'missing_title' END AS failure, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'A ' || p_brand END AS authors FROM part",
)
def src_records(spark, sf):
    p = table(spark, sf, "part")
    title = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    zenodo = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.struct(title.alias("title"), F.col("p_size").cast("string").alias("publication_date"), F.struct(F.lit("cc-by").alias("id")).alias("license"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("creators")).alias("metadata")))
    crossref = F.to_json(F.struct(F.struct(F.col("p_partkey").cast("string").alias("DOI"), F.array_compact(F.array(title)).alias("title"), F.struct(F.array(F.array("p_size")).alias("date-parts")).alias("issued"), F.array(F.struct(F.lit("A").alias("given"), F.col("p_brand").alias("family"))).alias("author")).alias("message")))
    even = F.col("p_partkey") % 2 == 0
    rows = p.select(F.when(even, "zenodo").otherwise("crossref").alias("source"), F.when(even, zenodo).otherwise(crossref).alias("payload"))
    found = records.read_records(rows)
    return found.select("source", "record_id", "title", "published", "license", "failure", F.array_join("authors", ";").alias("authors"))


@query(
    "src_feed_items",
    "SELECT o_custkey::VARCHAR AS feed_url, o_orderkey::VARCHAR AS upstream_id, 'https://x.example/' || o_orderkey AS canonical_url, 'Order & ' || o_orderstatus AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS published FROM orders",
)
def src_feed_items(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit("<item><guid>"), key, F.lit("</guid><link>https://x.example/"), key, F.lit("</link><title>Order &amp; "), F.col("o_orderstatus"), F.lit("</title><dc:creator>n</dc:creator><pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    body = F.concat(F.lit('<rss version="2.0" xmlns:dc="d"><channel><title>t</title>'), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>"))
    # a feed comes in blocks of at most 1,000 order keys, so no body grows with a customer's orders
    block = F.floor(F.col("o_orderkey") / 1000).alias("block")
    found = feeds.items(o.groupBy(F.col("o_custkey").cast("string").alias("feed_url"), block).agg(body.alias("body")), most=None)
    return found.select("feed_url", "upstream_id", "canonical_url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


@query("snk_json_rows", "SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def snk_json_rows(spark, sf):
    return sinks.json_rows(table(spark, sf, "nation"))


@query("snk_csv_rows", "SELECT conv_id || ',' || turn || ',' || role || ',' || CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS csv FROM (SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '^[=+@\\t\\r]') OR regexp_matches(text, '^-[^0-9.]') THEN chr(39) || text ELSE text END AS text FROM conversations)")
def snk_csv_rows(spark, sf):
    return sinks.csv_rows(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


@query("snk_manifest")
def snk_manifest(spark, sf):
    return sinks.manifest({n: table(spark, sf, n) for n in ("nation", "orders", "region")})


@query("snk_atom", "SELECT '<entry><id>' || p_partkey || '</id><title>' || replace(replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;') || '</title><link href=\"' || p_brand || '\"/><updated>2024-01-02T00:00:00Z</updated></entry>' AS entry FROM part")
def snk_atom(spark, sf):
    return feeds.atom(table(spark, sf, "part").withColumn("at", F.lit("2024-01-02").cast("timestamp_ntz")), "p_partkey", "p_name", "p_brand", "at")


@query("ex_probabilities", "SELECT o_orderkey, 0::INT AS sentence_index, 'point' AS form, (o_orderkey % 100) / 100.0::DOUBLE AS low, (o_orderkey % 100) / 100.0::DOUBLE AS high, make_date(year(o_orderdate) + 110, 12, 31) AS horizon_end FROM orders")
def ex_probabilities(spark, sf):
    o = table(spark, sf, "orders")
    said = F.format_string("I think the probability is %d%% by %d. Critics say the chance is 3%%. Is the risk 5%%?", F.col("o_orderkey") % 100, F.year("o_orderdate") + 110)
    return forecasts.numbers_stated(o.select("o_orderkey", said.alias("text")), "o_orderkey", "text").select("o_orderkey", "sentence_index", "form", "low", "high", "horizon_end")


@query("ex_documents", "SELECT doc_id, 'My odds are ' || doc_id % 10 || ' in 10.' AS sentence, 'point' AS form, (doc_id % 10) / 10.0::DOUBLE AS low, (doc_id % 10) / 10.0::DOUBLE AS high FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, 'Chances are between 20 to ' || 30 + doc_id % 10 || '% here.', 'range', 0.2::DOUBLE, (30 + doc_id % 10) / 100.0::DOUBLE FROM documents WHERE doc_id % 4 = 1")
def ex_documents(spark, sf):
    """Whole documents with a claim set at their start, and one more at the end of some."""
    k, d = F.col("doc_id") % 4, (F.col("doc_id") % 10).cast("string")
    claim = F.when(k != 3, F.concat(F.lit("My odds are "), d, F.lit(" in 10.\n"))).otherwise("Others say the odds are 1 in 10.\n")
    more = F.when(k == 1, F.concat(F.lit("\nChances are between 20 to "), (30 + F.col("doc_id") % 10).cast("string"), F.lit("% here."))).when(k == 2, "\nIs the chance 4%?").otherwise("")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(claim, F.col("text"), more).alias("text"))
    return forecasts.numbers_stated(docs, "doc_id", "text").select("doc_id", "sentence", "form", "low", "high")


#: A case for each rest of doc_id by ten: p a percentage, q one more, y a year.
STATED = (
    "There is a {p}% chance of human extinction by {y}.",
    "The chance of extinction is {p}% and the chance of takeover is 5%.",
    "By {y} much will change. The chance of extinction is {p}%.",
    "I put the probability at {p}%. By that I mean extinction by {y}.",
    "The probability of AGI is hard to say. {p}% probability by {y}.",
    "What about extinction this century? I'll give a probability of {p}% for that.",
    "My probability of AGI is {p}% by {y} and 0.25 by 2090.",
    "The chance of a takeover is -{p}%.",
    "My credence is 1-{q}% for catastrophic harm by {y}.",
    "The chance of extinction is 1 in {q}.",
)


def _with_case(spark, sf, cases):
    """Whole documents, each with a case behind it; ``at`` is where the case starts."""
    p, y = F.col("doc_id") % 90 + 1, 2030 + F.col("doc_id") % 50
    said = F.get(F.array(*[F.lit(x) for x in cases]), (F.col("doc_id") % len(cases)).cast("int"))
    for mark, value in (("{p}", p), ("{q}", p + 1), ("{y}", y)):
        said = F.replace(said, F.lit(mark), value.cast("string"))
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.concat(text, F.lit("\n"), said).alias("text"), (F.length(text) + 1).alias("at"), F.length(said).alias("n"))


@query(
    "ex_statements",
    """WITH d AS (SELECT doc_id, doc_id % 10 AS k, doc_id % 90 + 1 AS p, 'by ' || 2030 + doc_id % 50 AS y FROM documents)
    SELECT doc_id, CASE k WHEN 2 THEN 'horizon_before' WHEN 3 THEN 'that_means' WHEN 4 THEN 'list_item' WHEN 5 THEN 'for_that' ELSE 'sentence' END AS rule,
        CASE k WHEN 4 THEN 'agi' WHEN 6 THEN 'agi' WHEN 8 THEN 'catastrophe' ELSE 'extinction' END AS outcome, CASE k WHEN 8 THEN 'range' ELSE 'point' END AS kind,
        CASE k WHEN 8 THEN 0.01 WHEN 9 THEN 1 / (p + 1)::DOUBLE ELSE p / 100::DOUBLE END AS low, CASE k WHEN 8 THEN (p + 1) / 100::DOUBLE WHEN 9 THEN 1 / (p + 1)::DOUBLE ELSE p / 100::DOUBLE END AS high,
        CASE WHEN k IN (5, 9) THEN NULL ELSE y END AS horizon, true AS whole FROM d WHERE k NOT IN (1, 7)
    UNION ALL SELECT doc_id, 'sentence', 'agi', 'point', 0.25, 0.25, 'by 2090', true FROM d WHERE k = 6""",
)
def ex_statements(spark, sf):
    """Statements within a sentence and across sentences; ``whole``: they start where the case does and end with the text."""
    docs = _with_case(spark, sf, STATED)
    found = forecasts.statements(docs, "doc_id", "text").join(docs.select("doc_id", "at", "n"), "doc_id")
    whole = (F.col("start") == F.col("at")) & (F.col("stop") == F.col("at") + F.col("n"))
    return found.select("doc_id", "rule", "outcome", "kind", "low", "high", "horizon", whole.alias("whole"))


@query(
    "ex_nearest_outcomes",
    """WITH d AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 90 + 1 AS p FROM documents)
    SELECT doc_id, CASE k WHEN 3 THEN 'takeover' ELSE 'extinction' END AS outcome, p / 100::DOUBLE AS low FROM d WHERE k <> 1
    UNION ALL SELECT doc_id, 'agi', (p + 1) / 100::DOUBLE FROM d WHERE k = 0 UNION ALL SELECT doc_id, 'takeover', 0.05 FROM d WHERE k = 2""",
)
def ex_nearest_outcomes(spark, sf):
    """Numbers of sentences with several outcomes, each bound to the nearest in its clause; a tie binds to none."""
    cases = ("The odds of extinction are {p}%, the odds of AGI {q}%.", "Extinction {p}% takeover is my probability.", "There is a {p}% chance of extinction and a 5% chance of takeover.", "The probability of AGI or takeover is {p}%.")
    found = forecasts.statements(_with_case(spark, sf, cases), "doc_id", "text", by_nearest=True)
    return found.select("doc_id", "outcome", "low")


@query(
    "ex_duplicates",
    "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN count(*) OVER (PARTITION BY user_id, event_type) - 1 ELSE 0 END AS duplicate_count FROM events",
)
def ex_duplicates(spark, sf):
    return extract.mark_duplicates(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "duplicate_count")


@query("ex_turns", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS turn, upper(role[1]) || role[2:] AS speaker, md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''")
def ex_turns(spark, sf):
    c = table(spark, sf, "conversations").where("trim(text) <> ''")
    line = F.concat(F.initcap("role"), F.lit(" (00:01:02): "), F.regexp_replace(F.trim("text"), r"\s+", " "))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return extract.speaker_turns(whole, "conv_id", "text").select("conv_id", "turn", "speaker", F.md5("text").alias("text"))


@query(
    "ex_review_flags",
    "SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL)), ',') AS flags FROM orders",
)
def ex_review_flags(spark, sf):
    flags = extract.review_flags(large=F.col("o_totalprice") > 200000, pending=F.col("o_orderstatus") == "P", urgent=F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(flags, ",").alias("flags"))


@query(
    "ex_evaluation",
    "WITH e AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN -1 ELSE o_custkey END AS v FROM orders WHERE o_orderpriority = '1-URGENT') SELECT CASE WHEN e.k IS NULL THEN 'spurious' WHEN a.k IS NULL THEN 'missed' WHEN e.v = a.v THEN 'correct' ELSE 'wrong_value' END AS outcome, count(*) AS n FROM e FULL JOIN a ON a.k = e.k GROUP BY 1",
)
def ex_evaluation(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    found = o.where("o_orderpriority = '1-URGENT'").withColumn("v", F.when(F.col("o_totalprice") > 200000, -1).otherwise(F.col("v")))
    return extract.evaluate(o.where("o_orderstatus = 'F'"), found, ["k"], "v").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "id_resolve_authors",
    """
WITH c AS (SELECT o_custkey AS person, o_orderkey AS record, o_orderpriority = '1-URGENT' AS cor, o_orderkey % 3 AS orcid, trunc(o_totalprice / 5000)::INT AS works, o_orderstatus = 'F' AS exact, o_custkey % 2 = 0 AS dist FROM orders),
r AS (SELECT *, row_number() OVER w AS n, lead(works) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY person ORDER BY cor DESC, works DESC, record)),
g AS (SELECT person, count(*) FILTER (WHERE cor) AS cs, count(DISTINCT orcid) FILTER (WHERE cor) AS ids, count(*) FILTER (WHERE exact) AS exacts, max(record) FILTER (WHERE n = 1) AS top, max(works) FILTER (WHERE n = 1) AS w, max(nxt) FILTER (WHERE n = 1) AS nxt, bool_or(dist) AS dist FROM r GROUP BY 1),
d AS (SELECT person, top, CASE WHEN cs = 1 THEN 'accept_high' WHEN cs > 1 AND ids > 1 THEN 'ambiguous' WHEN cs > 1 THEN CASE WHEN dist AND w >= 25 AND w >= 3 * coalesce(nxt, 0) THEN 'accept_medium' ELSE 'ambiguous' END WHEN exacts > 1 THEN 'ambiguous' WHEN exacts = 1 AND dist AND w >= 3 THEN 'accept_medium' ELSE 'not_found' END AS decision FROM g)
SELECT person, decision, CASE WHEN starts_with(decision, 'accept') THEN top END AS chosen FROM d""",
)
def id_resolve_authors(spark, sf):
    o = table(spark, sf, "orders")
    c = o.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("record"), (F.col("o_orderpriority") == "1-URGENT").alias("corroborated"), (F.col("o_orderkey") % 3).cast("string").alias("orcid"), (F.col("o_totalprice") / 5000).cast("int").alias("works"), (F.col("o_orderstatus") == "F").alias("exact"), (F.col("o_custkey") % 2 == 0).alias("distinctive"))
    return extract.resolve_author(c, "person")


@query(
    "id_name_matches",
    """WITH p AS (SELECT c_custkey AS person, c_custkey % 60 AS f, c_custkey % 3 AS i FROM customer),
    r AS (SELECT o_orderkey AS record, o_orderkey % 70 AS f, o_orderkey % 4 AS i, CASE WHEN o_orderkey % 5 > 0 THEN 'o' || o_orderkey % 2 END AS orcid FROM orders WHERE o_orderkey % 11 = 0),
    m AS (SELECT person, record, orcid, p.i = r.i AS exact FROM p JOIN r ON p.f = r.f WHERE p.i = 0 OR r.i = 0 OR p.i = r.i),
    g AS (SELECT person, count(*) FILTER (WHERE exact) AS n, count(DISTINCT orcid) FILTER (WHERE exact) AS ids, count(*) FILTER (WHERE exact AND orcid IS NULL) AS bare, min(orcid) FILTER (WHERE exact) AS one FROM m GROUP BY 1)
    SELECT person, record, exact, exact OR coalesce(orcid IS NOT NULL AND (n = 0 OR (ids = 1 AND bare = 0 AND orcid = one)), false) AS eligible FROM m JOIN g USING (person)""",
)
def id_name_matches(spark, sf):
    """Customers and orders with names whose first initial is none, B., C. or D."""
    named = lambda f, i: F.concat(F.lit("Éva "), F.get(F.array(F.lit(""), F.lit("B. "), F.lit("C. "), F.lit("D. ")), i.cast("int")), F.lit("O'Neil-"), f.cast("string"), F.lit("x"))
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    people = table(spark, sf, "customer").select(c.alias("person"), named(c % 60, c % 3).alias("name"))
    records_ = table(spark, sf, "orders").where("o_orderkey % 11 = 0").select(k.alias("record"), F.upper(named(k % 70, k % 4)).alias("name"), F.when(k % 5 > 0, F.concat(F.lit("o"), (k % 2).cast("string"))).alias("orcid"))
    return identity.name_matches(people, records_)


@query("ev_decode_bits", "SELECT l_orderkey, l_linenumber, (l_partkey & 3)::BIGINT AS a, ((l_partkey >> 2) & 1)::BIGINT AS b, ((l_partkey >> 3) & 3)::BIGINT AS c FROM lineitem")
def ev_decode_bits(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *evidence.decode_bits(F.col("l_partkey"), {"a": 2, "b": 1, "c": 2}))


@query(
    "ev_reconcile",
    "WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS part FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(part) OVER (PARTITION BY p)::BIGINT AS total FROM g) SELECT p, s, part, total, abs(round(part * 100.0 / total) * total - part * 100) <= 0.3 * total AS ok FROM t",
)
def ev_reconcile(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("part"))
    t = g.withColumn("total", F.sum("part").over(Window.partitionBy("p")))
    return t.select("p", "s", "part", "total", evidence.reconciles(F.col("part"), F.col("total"), F.round(F.col("part") * 100.0 / F.col("total")), 0.3).alias("ok"))


@query("ev_missing_cells", "SELECT p, n FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT n_nationkey AS n FROM nation) WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = p AND c_nationkey = n AND o_totalprice > 495000)")
def ev_missing_cells(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 495000").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderpriority").alias("p"), F.col("c_nationkey").alias("n"))
    priorities = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p")).distinct()
    nations = table(spark, sf, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ns"))  # a fixed list of nations
    grid = priorities.crossJoin(F.broadcast(nations)).select("p", F.explode("ns").alias("n"))
    return evidence.missing_cells(o, grid, ["p", "n"])


@query(
    "ev_correction_chain",
    "WITH c AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt, ts FROM events), k AS (SELECT * FROM c WHERE pt IS NULL OR pt <> event_type) SELECT event_id, (row_number() OVER w)::INT AS revision, lag(event_id) OVER w AS supersedes FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def ev_correction_chain(spark, sf):
    return evidence.correction_chain(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "revision", "supersedes")


@query(
    "ev_bundle_errors",
    """
WITH r AS (SELECT o_custkey AS id, o_orderkey % 4 + 1 AS revision, o_orderstatus AS kind, o_orderdate AS created, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS supersedes FROM orders),
g AS (SELECT id, revision, count(*) AS n, min(kind) AS kind, min(created) AS created, min(supersedes) AS supersedes FROM r GROUP BY 1, 2),
x AS (SELECT o_custkey AS id, o_orderkey % 4 + 1 AS revision, o_custkey + 1 AS to_id, 1 AS to_revision, 'O' AS to_kind FROM orders),
j AS (SELECT x.*, g.created, t.kind AS tkind, t.created AS tcreated FROM x JOIN g USING (id, revision) LEFT JOIN g t ON t.id = x.to_id AND t.revision = x.to_revision)
SELECT id, revision, 'duplicate_revision' AS code FROM g WHERE n > 1 UNION ALL SELECT id, revision, 'missing_reference' FROM j WHERE tkind IS NULL UNION ALL SELECT id, revision, 'wrong_kind' FROM j WHERE tkind <> to_kind UNION ALL SELECT id, revision, 'future_reference' FROM j WHERE tcreated > created
UNION ALL SELECT g.id, g.revision, 'broken_lineage' FROM g LEFT JOIN g o ON o.id = g.id AND o.revision = g.supersedes WHERE (g.revision > 1 OR g.supersedes IS NOT NULL) AND (o.id IS NULL OR g.supersedes <> g.revision - 1)""",
)
def ev_bundle_errors(spark, sf):
    o = table(spark, sf, "orders")
    revision = F.col("o_orderkey") % 4 + 1
    r = o.select(F.col("o_custkey").alias("id"), revision.alias("revision"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("created"), F.when(revision > 1, revision - 1).alias("supersedes"))
    x = o.select(F.col("o_custkey").alias("id"), revision.alias("revision"), (F.col("o_custkey") + 1).alias("to_id"), F.lit(1).cast("long").alias("to_revision"), F.lit("O").alias("to_kind"))
    return evidence.bundle_errors(r, x)


@query("ev_growth", "SELECT o_custkey, round(b / a - 1, 6) AS change, CASE WHEN b > a THEN round(3 * ln(2.0) / ln(b / a), 6) END AS doubling, round(power(b / a, 1 / 3.0) - 1, 6) AS yearly FROM (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS a, arg_max(o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1)")
def ev_growth(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("a"), F.max_by("o_totalprice", "o_orderkey").alias("b"))
    a, b, years = F.col("a"), F.col("b"), F.lit(3.0)
    return g.select("o_custkey", F.round(evidence.relative_change(a, b), 6).alias("change"), F.round(evidence.doubling_time(a, b, years), 6).alias("doubling"), F.round(evidence.annualised(a, b, years), 6).alias("yearly"))


@query("ev_brier", "SELECT event_type, round(avg(power(value / 100 - (event_id % 2), 2)), 6) AS loss FROM events GROUP BY 1")
def ev_brier(spark, sf):
    e = table(spark, sf, "events").withColumn("f", F.col("value") / 100).withColumn("o", (F.col("event_id") % 2).cast("double"))
    return e.groupBy("event_type").agg(F.round(evidence.brier("f", "o"), 6).alias("loss"))


@query("ev_scores", "SELECT p_partkey, p_brand AS system, (p_size / 4.0)::DECIMAL(38,18)::VARCHAR AS score FROM part WHERE p_size % 3 <> 0")
def ev_scores(spark, sf):
    p = table(spark, sf, "part")
    line = F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit("   "), F.col("p_brand"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("\t"), F.format_string("%.2f", F.col("p_size") / 4.0))).otherwise(""))
    rows = evidence.score_rows(p.select(line.alias("line")), "line", ["p_partkey", "system", "score"])
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "system", evidence.exact_decimal(F.col("score")).cast("string").alias("score"))


@query("ev_time_bounds", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' WHEN 2 THEN '2020-01-01 00:00:00' END AS lower_at, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59' WHEN 2 THEN '2021-06-30 12:00:00' END AS upper_at FROM orders")
def ev_time_bounds(spark, sf):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "instant").when(k == 1, "date").when(k == 2, "range").otherwise("unknown")
    b = evidence.time_bounds(kind, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("2020-01-01 00:00:00"), F.lit("2021-06-30 12:00:00"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", b.alias("b")).select("o_orderkey", fmt("b.lower").alias("lower_at"), fmt("b.upper").alias("upper_at"))


# ---- read models: the shapes that lists and details return


@query(
    "rd_statement_list",
    "SELECT o_orderkey, c_name, n_name, coalesce(t.topics, '') AS topics FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS topics FROM lineitem GROUP BY 1) t ON t.l_orderkey = o_orderkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50",
)
def rd_statement_list(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    page = o.orderBy(F.col("o_orderdate").desc_nulls_last(), F.desc("o_orderkey")).limit(50)
    topics = table(spark, sf, "lineitem").join(page.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("topics"))
    j = page.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(topics, "o_orderkey", "left")
    return j.select("o_orderkey", "c_name", "n_name", F.coalesce("topics", F.lit("")).alias("topics"))


@query(
    "rd_person_detail",
    "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS statements, (SELECT count(DISTINCT l_suppkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS sources FROM customer",
)
def rd_person_detail(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    n = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("statements"))
    s = o.join(table(spark, sf, "lineitem"), "l_orderkey").groupBy("c_custkey").agg(F.countDistinct("l_suppkey").alias("sources"))
    return c.join(n, "c_custkey", "left").join(s, "c_custkey", "left").fillna(0, ["statements", "sources"])


@query("rd_topic_counts", "SELECT p_brand, p_type, count(*) AS n, count(DISTINCT l_suppkey) AS people FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def rd_topic_counts(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("people"))


@query("rd_relationships", "SELECT id, string_agg(other::VARCHAR, ',' ORDER BY other) AS related FROM (SELECT l_orderkey AS id, l_partkey AS other FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1")
def rd_relationships(spark, sf):
    e = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.explode(F.array(F.struct(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("other")), F.struct(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("other")))).alias("e")).select("e.*")
    return e.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other")).cast("array<string>"), ",").alias("related"))


@query(
    "rd_review_queue",
    "WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_totalprice > 100000 THEN 1 WHEN o_totalprice > 100000 AND o_orderdate > TIMESTAMP '1996-01-01' THEN 2 WHEN o_totalprice > 100000 THEN 3 WHEN o_orderstatus = 'F' THEN 4 ELSE 5 END AS priority, o_orderdate FROM orders) SELECT o_orderkey, priority FROM q ORDER BY priority, o_orderdate DESC, o_orderkey LIMIT 200",
)
def rd_review_queue(spark, sf):
    from quern.operators.quality import review_priority

    numeric = F.col("o_totalprice") > 100000
    p = review_priority(F.col("o_orderstatus") == "F", numeric, F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    return table(spark, sf, "orders").withColumn("priority", p).orderBy("priority", F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "priority")


@query("rd_coverage", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS members, count(DISTINCT CASE WHEN o_orderkey IS NOT NULL THEN c_custkey END) AS with_statement, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN c_custkey END) AS verified FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rd_coverage(spark, sf):
    from quern.operators.aggregates import distinct_where

    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    j = table(spark, sf, "customer").join(o, "c_custkey", "left")
    return j.groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("members"), distinct_where("c_custkey", F.col("o_orderkey").isNotNull()).alias("with_statement"), distinct_where("c_custkey", F.col("o_orderstatus") == "F").alias("verified"))


@query("rd_fingerprint", "SELECT c_custkey, c_name || '|' || c_mktsegment || '|' || count(o_orderkey) AS mark FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment")
def rd_fingerprint(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    n = table(spark, sf, "customer").join(o, "c_custkey", "left").groupBy("c_custkey", "c_name", "c_mktsegment").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", F.concat_ws("|", "c_name", "c_mktsegment", F.col("n").cast("string")).alias("mark"))


@query("sm_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def sm_windows(spark, sf):
    from quern.streaming.windows import windowed

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(e, "ts", "1 day", None, "1 hour", ["event_type"], "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))
