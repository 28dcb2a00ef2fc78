"""The pipeline's stages against plain code, and its run as a whole."""

import hashlib
import re

from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import bpe, language
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_near_copies import plain_kept


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = plain_kept([(i, d.text) for i, d in docs.items() if re.search(r"[^\W\d_]", d.text)])
    bad = {d for d, _, _ in plain_leaks([(i, docs[i].text) for i in kept], items)}
    kept = [i for i in kept if i not in bad]
    t = Tokenizer.from_file(bpe.default_vocabulary())
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(rows) == kept and bad
    for i in kept:
        r = rows[i]
        assert r.round_trip and r.n_tokens == len(r.token_ids)
        if not plain_spans(docs[i].text) and not re.search("[0-9a-f]{32}|at[)\\]]|Mr|Dr|Frau|Herr|[0-9]{2}[ ./-][0-9]{2}", docs[i].text):
            ids = t.encode(docs[i].text, add_special_tokens=False).ids
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_columns_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (docs.limit(0), spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word a@b.cd", "en", None, 11), (3, "word a@b.cd", "en", None, 11)], docs.schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).count() == rows.count()
    out = corpus_pipeline.redact(spark, rows, sf).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.text)[-1] == (3, "word [EMAIL]")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, rows, sf).collect()} == {3}
    assert language.UNKNOWN == "und"


def test_stages_on_long_texts_ties_and_extra_columns(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, long, "en", "s", 1, "x"), (2, long.upper(), "en", "s", 1, None), (3, "short one here", "fr", None, 1, "x"), (3, "short one here", "fr", None, 1, "y"), (None, "no id but text", None, None, None, "x"), (4, "call +1 (555) 555-1234 " + "now " * 30_000, None, "s", 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert "score" in df.columns, name
    got = sorted((r.doc_id or 0, r.text[:10], r.score) for r in df.collect())
    assert [g[0] for g in got] == [0, 1, 3, 4] and got[1][1] == long[:10] and got[3][1] == "call [PHON"
    out = corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()
    assert len(out) == 4 and all(r.round_trip for r in out)
