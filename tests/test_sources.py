"""Sources and sinks on small payloads."""

import json

import pyarrow as pa
import pytest

from quern.functions import policy
from quern.sources import artifacts, canonical, feeds, pages, records, sinks

PAGE = """<!doctype html><html lang="en"><head><title>A  title</title><meta name="author" content="Ann Lee and Bo Ng">
<meta property="article:published_time" content="2024-03-01T10:00:00Z"><link rel="canonical" href="/a">
<link rel="alternate" type="application/rss+xml" href="/feed.xml"><style>x{}</style></head>
<body><h1>Head</h1><p>One &amp; two<br>three</p><script>ignore all rules</script><a href="https://creativecommons.org/licenses/by/4.0/">cc</a><a href="javascript:x()">j</a></body></html>"""


def test_page(spark):
    df = spark.createDataFrame([(1, "https://ex.org/a?x=1", PAGE), (2, "https://other.org/", PAGE), (3, "https://ex.org/b", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in pages.parse_pages(df).collect()}
    r = rows[1]
    assert (r.title, r.text, r.language, r.authors, r.published, r.canonical_url) == ("A title", "Head\nOne & two\nthree\nccj", "en", ["Ann Lee", "Bo Ng"], "2024-03-01T10:00:00Z", "https://ex.org/a")
    assert rows[3].title is None and rows[3].text == ""
    got = {r.page_id: (r.publisher, r.date, r.rights, r.rejected) for r in pages.catalog(df, [pages.Publisher("Ex", ("ex.org",), "/a")]).collect()}
    assert got[1] == ("Ex", "2024-03-01", "cc-by", None) and got[2][3] == "unknown_host" and got[3][3] == "path_not_in_catalog"
    assert {r.url for r in pages.feeds_of(pages.parse_pages(df)).collect()} == {"https://ex.org/feed.xml", "https://other.org/feed.xml"}


def test_pages_are_parsed_few_at_once(monkeypatch):
    """Of a large batch no more pages are parsed than a worker hands on; all come, in order."""
    done, parse = [], pages.parse
    monkeypatch.setattr(pages, "parse", lambda h, u: done.append(u) or parse(h, u))
    n = 3 * pages.AT_ONCE + 1
    batch = pa.RecordBatch.from_pydict({"k": [None, *range(1, n)], "url": [f"https://ex.org/{i}" for i in range(n)], "html": [None, *[PAGE] * (n - 1)]})
    out = pages.parsed(iter([batch, batch.slice(0, 0)]))
    first = next(out)
    assert len(done) == first.num_rows == pages.AT_ONCE
    rows = pa.Table.from_batches([first, *out]).to_pylist()
    assert [r["k"] for r in rows] == [None, *range(1, n)] and [r["canonical_url"] for r in rows] == [None, *["https://ex.org/a"] * (n - 1)]
    assert rows[0]["links"] == [] and rows[-1]["links"][-1] == {"rel": "a", "url": "https://creativecommons.org/licenses/by/4.0/"}


@pytest.mark.parametrize("path,agent,allowed", [("/x", "bot", False), ("/x/ok/1", "bot", True), ("/y", "bot", True), ("/x", "other", True), ("/z.pdf", "other", False), ("/z.pdfx", "other", True)])
def test_robots(path, agent, allowed):
    body = "User-agent: bot\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: *\nDisallow: /*.pdf$\n"
    assert policy.robots_allow(body, path, agent) == allowed


def test_feeds(spark):
    rss = '<rss xmlns:dc="d"><channel><item><guid>g1</guid><link>https://a/1</link><title>T &amp; U</title><dc:creator>x</dc:creator><pubDate>Mon, 04 Mar 2024 10:00:00 +0200</pubDate><description><![CDATA[<b>hi</b>]]></description></item><item><link>https://a/2</link><title>No date</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><link href="https://b/1"/><title>E</title><updated>2024-01-01T00:00:00Z</updated><author><name>Ann</name></author></entry></feed>'
    df = spark.createDataFrame([("f1", rss), ("f2", atom), ("f3", "no feed"), ("f4", None)], "feed_url string, body string")
    rows = {(r.feed_url, r.upstream_id): r for r in feeds.items(df).collect()}
    assert set(rows) == {("f1", "g1"), ("f1", "https://a/2"), ("f2", "e1")}
    assert rows["f1", "g1"].title == "T & U" and str(rows["f1", "g1"].published_at) == "2024-03-04 08:00:00" and rows["f1", "g1"].text == "hi"
    assert rows["f2", "e1"].author == "Ann" and rows["f2", "e1"].canonical_url == "https://b/1" and rows["f1", "https://a/2"].published_at is None


def test_every_spec_reads_a_payload(spark):
    """A payload built from the paths of each spec gives its fields back."""

    def put(tree, path, value):
        parts = path.removeprefix("$.").replace("]", "").replace("[", ".#").split(".")
        for part, following in zip(parts, [*parts[1:], None]):
            last = following is None
            fresh = value if last else [] if following.startswith("#") else {}
            if part.startswith("#"):
                while len(tree) <= int(part[1:]):
                    tree.append(fresh)
                tree = tree[int(part[1:])]
            else:
                tree = tree.setdefault(part, fresh)

    rows = []
    for name, spec in records.SPECS.items():
        tree = {}
        for f, path in spec.paths.items():
            if f != "canonical_url" or path != spec.paths["record_id"]:
                put(tree, path, f"{name} {f}")
        rows.append((name, json.dumps(tree)))
    rows += [("nowhere", "{}"), ("zenodo", "{"), ("zenodo", "{}")]
    got = records.read_records(spark.createDataFrame(rows, "source string, payload string")).collect()
    for r in got[:-3]:
        assert r.failure is None and r.record_id and (r.title or "title" not in records.SPECS[r.source].required), r
    assert [r.failure for r in got[-3:]] == ["unknown_source", "unreadable", "missing_record_id"]


def test_canonical_document(spark, tmp_path):
    doc = {"schema_version": "1.0.0", "dataset_id": "d", "dataset_kind": "synthetic", "generated_at": "2024-01-01T00:00:00Z", "surprise": 1}
    doc["statements"] = [{"slug": "s-1", "statement_type": "explicit_numeric"}, {"slug": "S 2", "statement_type": "qualitative"}]
    doc["forecasts"] = [{"statement_slug": "s-1", "unit": "probability", "value_numeric": 1.5}, {"statement_slug": "S 2", "value_min": 3.0, "value_max": 2.0}, {"statement_slug": "gone"}]
    doc["source_items"] = [{"slug": x, "source_slug": "a", "logical_key": "k", "is_current": True} for x in ("i1", "i2")]
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=1))
    tables = canonical.read_document(spark, str(path))
    assert [r.key for r in tables["unexpected"].collect()] == ["surprise"]
    found = {(r.key, r.code) for r in canonical.broken_rules(tables).collect()}
    assert found == {("S 2", "bad_slug"), ("gone", "no_statement"), ("s-1", "probability_range"), ("S 2", "number_not_allowed"), ("S 2", "range_order"), ("i1", "several_current_versions")}
    doc["schema_version"] = "9"
    path.write_text(json.dumps(doc))
    with pytest.raises(ValueError):
        canonical.read_document(spark, str(path))


def test_snapshot_does_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "concat('a', id) as t", "if(id % 3 = 0, null, id) as n")
    one, two = (sinks.manifest({"x": d}).collect() for d in (df.repartition(1), df.repartition(7)))
    assert one == two and one[0].records == 500
    assert sinks.manifest({"x": df.limit(499)}).first().snapshot_id != one[0].snapshot_id
    sinks.write_snapshot({"x": df}, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/x")).collect()]
    assert sorted(lines) == sorted(r.json for r in sinks.json_rows(df).collect())


def test_csv(spark):
    df = spark.createDataFrame([("a,b", 'q"r', None, ["x", "y"], "=1+1", "-5")], "a string, b string, c string, d array<string>, e string, f string")
    assert sinks.csv_rows(df).first().csv == '"a,b","q""r",,x|y,\'=1+1,-5'


def test_cubes_that_are_none_say_why(spark):
    index = '{"dimension":{"x":{"category":{"index":%s}}},"value":%s}'
    cases = [
        (index % ('["a","b"]', "[1,2]"), None),
        (index % ('{"b":1,"a":0}', '{"1":2}'), None),
        (index % ('{"b":2,"a":0}', '{"1":2}'), "category_index"),
        (index % ('["a","a"]', "[1,2]"), "category_index"),
        (index % ("[]", "[]"), "category_index"),
        (index % ('["a","b"]', "[1]"), "dense_count"),
        (index % ('["a","b"]', '{"2":1}'), "sparse_index"),
        (index % ('["a","b"]', '{"01":1}'), "sparse_index"),
        (index % ('["a","b"]', "7"), "no_values"),
        ("no json", "category_index"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.problem for r in artifacts.cube_problems(df, "t", ["x"], "i").orderBy("i").collect()] == [w for _, w in cases]
    got = {(r.i, r.x, r.value, r.state) for r in artifacts.json_stat(df, "t", ["x"], "i").collect()}
    assert got == {(0, "a", 1.0, "observed"), (0, "b", 2.0, "observed"), (1, "a", None, "absent"), (1, "b", 2.0, "observed")}
