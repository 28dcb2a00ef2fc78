"""Every registered query with SQL gives the rows that DuckDB gives."""

import hashlib
import json
import math
import re
from urllib.parse import urlsplit

import duckdb
import pytest

import __spark_entry__ as entry
from quern.functions import text as tx
from quern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6g}"
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    theirs = rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert canonical(ours) == canonical(theirs)


def rows_of(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_every_query_has_sql_or_a_test_here():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"fn_canonical_url", "snk_manifest", "src_page_catalog", "src_page_text"}


def test_canonical_urls(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = rows_of(spark, "fn_canonical_url")
    assert len(rows) == len(pages)
    for r in rows:
        u = urlsplit(pages[r.page_id])
        kept = sorted(p for p in u.query.split("&") if p and p.split("=")[0] not in tx.TRACKING)
        assert r.url == f"{u.scheme.lower()}://{u.netloc.lower()}{u.path.rstrip('/')}" + (f"?{'&'.join(kept)}" if kept else "")


def test_manifest(spark):
    rows = {r.name: r for r in rows_of(spark, "snk_manifest")}
    for name in ("region", "nation"):
        lines = [json.dumps(dict(sorted(r.asDict().items())), separators=(",", ":"), ensure_ascii=False) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
        groups = {}
        for h in sorted(hashlib.sha256(x.encode()).hexdigest() for x in lines):
            groups.setdefault(h[:4], []).append(h)
        whole = hashlib.sha256("".join(hashlib.sha256("".join(hs).encode()).hexdigest() for _, hs in sorted(groups.items())).encode()).hexdigest()
        assert (rows[name].records, rows[name].bytes, rows[name].sha256) == (len(lines), sum(len(x.encode()) for x in lines), whole)
    text = "\n".join(sorted(f"{n}\t{r.sha256}\t{r.bytes}" for n, r in rows.items()))
    assert {r.snapshot_id for r in rows.values()} == {hashlib.sha256(text.encode()).hexdigest()}


def test_page_texts_and_catalog(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    texts = {r.page_id: r for r in rows_of(spark, "src_page_text")}
    assert set(texts) == set(pages)
    for i, (_, html) in pages.items():
        title = re.search("<title>(.*?)</title>", html or "", re.S)
        if title and "&" not in title[1] and "<" not in title[1]:
            assert texts[i].title == re.sub(r"\s+", " ", title[1]).strip()
        lang = re.search('<html lang="([a-z]+)"', html or "")
        assert texts[i].language == (lang[1] if lang else texts[i].language)
    assert sum(r.chars > 200 for r in texts.values()) > len(pages) / 2
    known = {"blog.tionsh.example.net", "blog.ththan.example.net", "thther.example.org"}
    for r in rows_of(spark, "src_page_catalog"):
        assert (r.rejected == "unknown_host") == ((urlsplit(pages[r.page_id][0]).hostname or "") not in known)
