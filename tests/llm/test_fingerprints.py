"""Canonical digests against unicodedata, and edited texts against plain code."""

import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from quern.llm import fingerprints as fp

SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def plain(text):
    n = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return SPACE.sub(" ", n).strip(" ")


CASES = [None, "", " ", "A  b\n", "a B", "Ｆｕｌｌ ﬁ ①", "É é é", "STRASSE straße", "x\x1cy", "x\x85y", "ΑΣ ας", "🙂 ½", "a　b", "ſ"]


def test_canonical(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", fp.canonical(F.coalesce("t", F.lit(""))).alias("c")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(CASES)}
    prints = {r.i: r.fingerprint for r in fp.fingerprints(df, "t").collect()}
    for i in range(len(CASES)):
        for j in range(len(CASES)):
            assert (prints[i] == prints[j]) == (got[i] == got[j])
    assert fp.fingerprints(df.limit(0), "t").count() == 0


def test_collided_digests_are_told_apart(spark):
    df = spark.createDataFrame([("d", "a", 1), ("d", "b", 2), ("d", "a", 3), ("e", "c", 4)], "digest string, form string, k int")
    hit = fp.collisions(df.select("digest", "form"))
    got = {r.k: r.digest for r in fp.with_ordinal(df, "digest", "form", hit).collect()}
    assert got == {1: "d", 2: "d-1", 3: "d", 4: "e"}


def check(rows, docs):
    order = sorted(docs, key=lambda d: (-d[0], d[1] or ""))
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + nxt[:third]
        want.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), float(plain(e) == plain(t)), float(plain(nxt) == plain(t))))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.near_edited, r.near_next))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_query(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = fp.op4_fingerprints(spark, sf).collect()
    check(rows, docs)
    by = {}
    for r in rows:
        assert by.setdefault(plain(dict(docs)[r.doc_id]), r.fingerprint) == r.fingerprint
    assert len(set(by.values())) == len(by)


def test_blocks_and_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 3)
    docs = [(i, f"text number {i} é") for i in [*range(0, 40), 5_000, 5_001, 10**15, -7]] + [(3, "again"), (9, None), (41, "")]
    for rows, name in ((docs, "many"), (docs[:1], "one"), ([], "none")):
        path = str(tmp_path / name)
        spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").write.parquet(f"{path}/documents.parquet")
        found = fp.op4_fingerprints(spark, path).collect()
        check(found, rows) if rows else None
        assert len(found) == len(rows)


def test_blocks_follow_an_outlier(spark, monkeypatch):
    """An id far from all others does not draw its neighbours into one block, and long texts are read whole."""
    monkeypatch.setattr(fp, "BLOCK", 50)
    ids = spark.range(2_000).selectExpr("id as doc_id").union(spark.createDataFrame([(10**17,), (-(10**17),)], "doc_id long"))
    sizes = [r["count"] for r in ids.groupBy(fp.blocks_of(ids, "doc_id").alias("b")).count().collect()]
    assert max(sizes) < 120 and len(sizes) > 30
    after = {r["_block"]: r["_after"] for r in fp.blocks_before(spark.range(0, 20_000, 7).selectExpr("id as _block")).collect()}
    assert all(b == a + 7 for b, a in after.items() if b) and after[0] == max(after)
    long = "Wört " * 50_000
    df = spark.createDataFrame([(1, long), (2, long.upper()), (3, None)], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    assert prints[1] == prints[2] != prints[3]
