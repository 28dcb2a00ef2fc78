"""The encoder against the tokenizers library, and the exact round trip."""

import hashlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(bpe.Vocabulary(open(bpe.default_vocabulary(), encoding="utf-8").read()))


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


CASES = ["", " ", "a", "aaaaaaaaaaaaa", "a" * 5001, "ab" * 3000, "  two  spaces \n\n x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftex", "it's we'll 'S", "é́ ñ ß 漢字 🙂🙂", "\x1c\x1d x\x85y z w", "123 456²Ⅳ", "\t\t\n  \r\n tail   "]


@pytest.mark.parametrize("text", CASES)
def test_cases(ours, theirs, text):
    assert array("i", ours.encode([text])[0]).tolist() == theirs.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(ours, theirs, text):
    got = array("i", ours.encode([text])[0]).tolist()
    assert got == theirs.encode(text, add_special_tokens=False).ids
    assert b"".join(ours.vocabulary.bytes_of[i] for i in got).decode("utf-8", "replace") == text


def test_query(spark, theirs):
    rows = {r.doc_id: r for r in bpe.op8_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = theirs.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    long = "word " * 40_000 + "é" * 60_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hi hi", None), (3, "hi hi", None), (4, long, "z")], "doc_id long, text string, token_ids string")
    for both in (bpe.decode(bpe.encode(df)), bpe.round_trip(df)):
        rows = both.orderBy("doc_id").collect()
        assert [list(r.token_ids) for r in rows][:2] == [[], []]
        assert [r.decoded for r in rows] == ["", "", "hi hi", "hi hi", long]
        assert len(rows[-1].token_ids) == len(bpe.Encoder(bpe.Vocabulary(open(bpe.default_vocabulary(), encoding="utf-8").read())).encode([long])[0]) // 4
    assert bpe.decode(bpe.encode(df.limit(0))).count() == bpe.round_trip(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, [0, 188]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert [r.decoded for r in bpe.decode(broken).orderBy("doc_id").collect()][1:] == ["", ""]


def test_memory_is_bounded_and_changes_nothing(ours, monkeypatch):
    texts = [f"w{i} " * 3 + "x" * i for i in range(300)]
    want = ours.encode(texts)
    monkeypatch.setattr(bpe, "REMEMBER", 20)
    monkeypatch.setattr(bpe, "REMEMBER_CHARS", 400)
    small = bpe.Encoder(ours.vocabulary)
    assert [small.encode([t])[0] for t in texts] == want and len(small.known) < 60
