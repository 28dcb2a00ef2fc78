"""Operators on small tables whose results are worked out by hand."""

import random

import pytest
import unicodedata

from pyspark.sql import functions as F

from quern.functions import policy
from quern.functions import text as tx
from quern.operators import aggregates, components, evidence, extract, forecasts, paging, rules, search, trends


def test_pages_cover_all_rows_both_ways(spark):
    rows = [(i, None if i % 4 == 0 else f"2024-01-{1 + i % 5:02d} 00:00:00") for i in range(23)]
    df = spark.createDataFrame(rows, "id long, at string").withColumn("at", F.col("at").cast("timestamp_ntz")).repartition(5)
    want = [r.id for r in df.orderBy(F.col("at").desc_nulls_last(), F.desc("id")).collect()]
    for size in (1, 4, 7):
        seen, cursor, more = [], None, True
        while more:
            page = paging.page(df, "at", "id", size, cursor).collect()
            seen += [r.id for r in page]
            more = page[-1].more
            cursor = paging.Cursor(page[-1].at and str(page[-1].at), page[-1].id)
        assert seen == want
        last = next(r for r in df.collect() if r.id == want[12])
        back = paging.page(df, "at", "id", size, paging.Cursor(last.at and str(last.at), last.id, backward=True)).collect()
        assert [r.id for r in back] == want[12 - size : 12]


def test_cursor_is_bound_to_its_query():
    text = paging.Cursor("2024-01-01", 5).encode("q1")
    assert paging.Cursor.decode(text, "q1") == paging.Cursor("2024-01-01", 5)
    for bad, binding in ((text, "q2"), ("???", "q1"), ("", "")):
        with pytest.raises(ValueError):
            paging.Cursor.decode(bad, binding)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    assert {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_withdrawn_pick_does_not_bring_back_an_older_value(spark):
    rows = spark.createDataFrame([(1, "p", "q", 1, 10.0, "human_verified"), (2, "p", "q", 2, 20.0, "human_verified"), (3, "p", "q", 3, None, "human_verified"), (4, "r", "q", 1, 5.0, "human_verified"), (5, "r", "q", 1, 5.0, "human_verified")], "id long, person string, question string, at int, value double, state string")
    edges = trends.forward_edges(spark.createDataFrame([(2, 3, "withdraws", "human_verified")], "from_id long, to_id long, type string, state string"), rows, "id", "person", "question", "at", "state")
    got = {r.id: r.outcome for r in trends.reduce_latest(rows.where("value is not null"), edges, "id", "person", "question", "at", "value").collect()}
    assert got == {1: "not_latest", 2: "withdrawn", 4: "included", 5: "duplicate_statement"}


@pytest.mark.parametrize("sentence,want", [("The probability is 10-20% by 2030", [(0.1, 0.2)]), ("I put the chance at 1 in 20.", [(0.05, 0.05)]), ("odds 0.3 or 40 percent", [(0.3, 0.3), (0.4, 0.4)]), ("Growth is 10%", []), ("risk -5%", []), ("chance 150%", []), ("probability " + "5% " * 7, []), (None, [])])
def test_probabilities(spark, sentence, want):
    docs = spark.createDataFrame([(1, sentence)], "id int, text string")
    assert [(round(r.low, 6), round(r.high, 6)) for r in forecasts.numbers_stated(docs, "id", "text", most=6).orderBy("start").collect()] == want


def test_abstention_and_turns(spark):
    said = ["Is the chance 5%?", "He says the risk is 5%.", "Suppose the odds are 5%.", "I do not think the chance is 5%.", "The chance is 5%."]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r.a for r in df.orderBy("i").select(extract.abstain(F.col("s")).alias("a")).collect()] == ["question", "third_party", "hypothetical", "negated", None]
    t = spark.createDataFrame([(1, "intro\nAnn Lee (00:01:02): one\ntwo\nBo: three")], "id int, text string")
    assert [(r.turn, r.speaker, r["at"], r.text) for r in extract.speaker_turns(t, "id", "text").orderBy("turn").collect()] == [(0, None, None, "intro"), (1, "Ann Lee", "00:01:02", "one two"), (2, "Bo", None, "three")]


def test_search_ranks(spark):
    names = ["Ann Lee", "Ann Leeds", "José Müller", "Lee", "Mary-Ann Lee", "Zed"]
    df = spark.createDataFrame([(i, n, n.split()[-1]) for i, n in enumerate(names)], "id int, name string, family string")

    def ranks(q):
        return {r.name: r.r for r in df.select("name", search.name_rank(F.col("name"), F.col("family"), search.prepare(q)).alias("r")).where("r > 0").collect()}

    assert ranks("ANN  lee") == {"Ann Lee": 400, "Ann Leeds": 180, "Mary-Ann Lee": 180}
    assert ranks("lee") == {"Ann Lee": 320, "Ann Leeds": 180, "Lee": 400, "Mary-Ann Lee": 320}
    assert ranks("mueller") == {"José Müller": 180} and ranks("jose") == {"José Müller": 240}
    assert search.prepare("​ ").reason == "empty" and search.prepare("a !").reason == "no_tokens"


def test_text_functions(spark):
    urls = ["HTTPS://Ex.org:443/a/?utm_source=x&b=2&a=1#f", "http://ex.org", "nonsense", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.c for r in df.select(tx.canonical_url(F.col("u")).alias("c")).collect()] == ["https://ex.org/a?a=1&b=2", "http://ex.org", None, None]


def plain_name_key(name):
    apart = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c)).lower().replace("'", "")
    return " ".join(w for w in "".join(c if c.isalnum() else " " for c in apart).split() if len(w) > 1)


def test_name_keys_of_any_script(spark):
    names = ["Dr. José  O'Neil-Smith J.", "Łukasz Dąbrowski", "A/B Cde", "Иван  Ёлкин", "王小明", "नरेन्द्र मोदी", "Ǆemal Øre", "ﬁne ½ ④④", "محمد علي", "İpek ŞİŞLİ", "ó ​xy zz", "", None, "'", "山"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r.k for r in df.orderBy("i").select(tx.name_keys(F.col("n")).alias("k")).collect()] == [plain_name_key(n) for n in names]
    assert plain_name_key(names[0]) == "dr jose oneil smith"


def test_sentence_rules(spark):
    said = ["by 2030", "before the end", "between 2031 and 2030", "the early 2040s", "within 3 years", "3 to 5 years ago it was over 2 years", "over the next 5-10 years", "a 10% chance by 2030", "1 in 20 by 2030", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r.t and tuple(r.t) for r in df.orderBy("i").select(rules.timeline(F.col("s")).alias("t")).collect()]
    assert got == [("point", 2030, 2030, "year"), None, None, ("range", 2040, 2043, "year"), ("point", 3, 3, "years_ahead"), None, ("range", 5, 10, "years_ahead"), None, None, None]
    q = spark.createDataFrame([("costs 1,250.5 million euros",), ("12.5.3 euros",), ("euros 5",), (None,)], "s string")
    assert [r.q and tuple(r.q) for r in q.select(rules.quantity(F.col("s"), ["euros"]).alias("q")).collect()] == [(1250.5e6, "euros"), None, None, None]


def test_robots():
    body = "User-agent: a\nUser-agent: b # two\nDisallow: /x\nAllow: /x/y$\n\nUser-agent: *\nDisallow: /*.pdf\nDisallow:\n"
    cases = [("a/1.0", "/x/z", False), ("b", "/x/y", True), ("b", "/x/yz", False), ("b", "/f.pdf", True), ("c", "/d/f.pdf", False), ("c", "/x", True)]
    for agent, path, want in cases:
        assert policy.robots_allow(body, path, agent) is want
    assert policy.robots_allow(None, "/", "a") and policy.robots_allow("nonsense", "/", "a")


def test_cyclic_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (8, 9)], "a int, b int")
    assert {tuple(r) for r in evidence.cyclic_edges(edges).collect()} == {(2, 3), (3, 2), (3, 4)}
    assert evidence.cyclic_edges(edges.where("a <> 3")).count() == 0 and evidence.cyclic_edges(edges.limit(0)).count() == 0


@pytest.mark.parametrize("joined", ["true", "false"])
def test_nearest_ranks_against_sorted_lists(spark, joined):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, 2.0, rng.random(), rng.random()])) for _ in range(997)] + [("nulls", None)] + [("hundred", float(i)) for i in range(1, 101)]
    shares = {"p0": 0.0, "p50": 0.5, "p55": 0.55, "p95": 0.95, "p100": 1.0}
    want = {}
    for g in {g for g, _ in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = (*[values[max(0, -(-round(share * 100) * len(values) // 100) - 1)] if values else None for share in shares.values()], len(values))
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: tuple(r)[1:] for r in aggregates.nearest_ranks(df, ["g"], "v", **shares).collect()}
    assert got == want
    assert aggregates.nearest_ranks(df.limit(0), ["g"], "v", p50=0.5).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
