"""Counts after edits against encoding whole texts again."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe
from quern.llm import token_counts as tc


@pytest.fixture(scope="module")
def encoder():
    return bpe.Counter(bpe.Vocabulary(open(bpe.default_vocabulary(), encoding="utf-8").read()))


def test_edits_of_random_texts(encoder, monkeypatch):
    monkeypatch.setattr(tc, "LEAF", 4)
    rng = random.Random(11)
    bits = ["a", "word", " ", "  ", "\n", "'", "'s", "re", "12", "é", "漢", "!", "...", "🙂", "x" * 30]
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
        (chars, tokens), = tc.build(encoder, [text])
        for _ in range(4):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 5, 60])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 80])))
            if rng.random() < 0.02:
                new += "<|endoftext|>"
            want = text[:a] + new + text[min(b, len(text)) :]
            ((text, chars, tokens, _),) = tc.edit(encoder, [(text, chars, tokens, a, b, new)])
            assert text == want
            assert chars[1] == len(text) and tokens[1] == sum(encoder.look_up([encoder.vocabulary.pieces(text)])[0])
            assert np.array_equal(chars, tc.tree_of(chars[len(chars) // 2 :]))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(bpe.default_vocabulary())
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = tc.op5_token_counts(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    reread = 0
    for r in rows:
        x = docs[r.doc_id]
        a, b = len(x) // 3, min(len(x), len(x) // 3 + 40)
        e = x[:a] + x[a:b][::-1] + " (edited)" + x[b:]
        assert (r.n_tokens, r.edited_tokens, r.edited_chars) == (len(t.encode(x, add_special_tokens=False).ids), len(t.encode(e, add_special_tokens=False).ids), len(e))
        reread += r.reread_chars
    assert reread < 0.6 * sum(map(len, docs.values()))


def test_edges(spark):
    rows = [(1, None, 0, 0, "new"), (2, "", None, 1, "x"), (3, "some text", 2, 99, ""), (3, "some text", 2, 99, ""), (4, "long " * 60_000, 5, 6, "é")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start int, stop int, put_in string, n_tokens int")
    got = sorted((r.doc_id, r.text[:9], r.n_tokens) for r in tc.apply_edits(tc.count(df)).collect())
    t = Tokenizer.from_file(bpe.default_vocabulary())
    long = "long " + "é" + ("long " * 60_000)[6:]
    assert got == [(1, "new", 1), (2, "", 0), (3, "so", 1), (3, "so", 1), (4, long[:9], len(t.encode(long).ids))]
    assert tc.count(df.limit(0)).count() == 0
    both = sorted((r.doc_id, r.text[:9], r.tokens_before, r.n_tokens) for r in tc.count_and_edit(df).collect())
    assert [(i, x, n) for i, x, _, n in both] == got and [b[2] for b in both][:3] == [0, 0, len(t.encode("some text").ids)]
    nulls = spark.createDataFrame([(1, None, None, 1, "x"), (2, "ab", 0, None, "x"), (3, "ab", 0, 1, None), (None, "ab", None, None, None), (5, "ab", 1, 1, "c")], "doc_id long, text string, start int, stop int, put_in string")
    found = sorted((r.doc_id or 0, r.text, r.reread_chars > 0) for r in tc.apply_edits(tc.count(nulls)).collect())
    assert found == [(0, "ab", False), (1, None, False), (2, "ab", False), (3, "ab", False), (5, "acb", True)]
