"""Language identification: held-out accuracy, splits and defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from quern.llm import language


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op2_language(spark, sf).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in own]) > 0.97


def test_backoff_takes_the_longest_known_grams():
    m = language.Model(["a", "b"], [], ["^th", "e", "e$"], np.array([0, 1, 2, 3]), np.array([0, 1, 1], np.int32), np.array([10.0, 9.0, 13.0]), np.array([-9.0, -9.0]))
    lang, gain, size = m.backoff(["the", "z", "ee"])
    assert (lang.tolist(), gain.tolist(), size.tolist()) == ([0, 1, 1], [5.0, 6.5, 22 / 3], [2, 0, 1])


def plain_model(rows, words, grams, longest=5):
    """Log frequencies per entry and language, learned from (lang, text), as plain dictionaries."""
    langs = sorted({lang for lang, _ in rows})
    counts = {x: Counter() for x in langs}
    for lang, text in set(rows):
        counts[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    pieces = {x: Counter() for x in langs}
    for x in langs:
        for w, n in counts[x].items():
            p = f"^{w}$"
            for g in {p[i : i + k] for k in range(1, longest + 1) for i in range(len(p) - k + 1)}:
                pieces[x][g] += n
    total = {x: sum(counts[x].values()) + 1 for x in langs}

    def kept(table, bound, least):
        names = {e for x in langs for e, n in sorted(((e, n) for e, n in table[x].items() if n > least), key=lambda p: (-p[1], p[0].encode()))[:bound]}
        return {e: {x: math.log(((table[x][e] if table[x][e] > least else 0) + 0.1) / total[x]) for x in langs} for e in names}

    return langs, kept(counts, words, 1), kept(pieces, grams, 0), {x: math.log(0.1 / total[x]) for x in langs}


def plain_language(text, model, longest=5):
    langs, words, grams, floor = model
    total = dict.fromkeys(langs, 0.0)
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    for w in found:
        if w in words:
            for x in langs:
                total[x] += words[w][x]
            continue
        p, at, own = f"^{w}$", 0, []
        while at < len(p):
            size = next(k for k in range(min(longest, len(p) - at), 0, -1) if p[at : at + k] in grams or k == 1)
            own.append(grams.get(p[at : at + size], floor))
            at += size
        for x in langs:
            total[x] += sum(o[x] for o in own) / len(own)
    return max(langs, key=lambda x: total[x]) if found else "und", total


def test_query_against_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    model = plain_model([(d.lang, d.text) for d in docs if d.lang and d.text is not None and not held(d.doc_id)], language.WORDS, language.GRAMS)
    got = {r.doc_id: r.lang_pred for r in language.op2_language(spark, sf).collect()}
    assert got == {d.doc_id: plain_language(d.text, model)[0] for d in docs}
    # a small model: words are cut off by the bounds, and ties of equal counts by the name of the entry
    few = spark.read.parquet(f"{sf}/documents.parquet")
    m = language.train(few, words=40, grams=60)
    plain = plain_model([(d.lang, d.text) for d in docs if d.lang and d.text is not None], 40, 60)
    assert sorted(m.words) == sorted(plain[1]) and sorted(m.grams) == sorted(plain[2])
    scores = language.Scores(m)
    for d in docs:
        words = Counter(language.LETTERS.findall((d.text or "").lower()))
        scores.learn_all([words])
        assert scores.text(words)[0] == plain_language(d.text, plain)[0]


def test_model_grows_with_the_languages_alone(spark):
    """1,200 languages of few rows each: all are learned, and entries are kept only where they stand."""
    own = ["".join("abcdefghij"[int(d)] for d in f"{i:04}") for i in range(1200)]
    rows = [(i, f"{w} {w} common word", f"l{i:04}") for i, w in enumerate(own)]
    m = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=3, grams=5)
    assert len(m.languages) == 1200 and len(m.words) == 1200 and len(m.lang) < 1200 * 60
    assert language.predict(spark.createDataFrame([(own[777],)], "text string"), m).first().lang_pred == "l0777"


def test_memory_of_unseen_words_is_bounded(monkeypatch):
    m = language.Model(["a", "b"], ["w"], ["^th", "e"], np.array([0, 1, 2, 4]), np.array([0, 0, 0, 1], np.int32), np.array([1.0, 10.0, 9.0, 3.0]), np.array([-9.0, -9.0]))
    want = language.Scores(m)
    texts = [Counter(["w", *(f"the{k}" for k in range(n))]) for n in (3, 9, 30, 2)]
    monkeypatch.setattr(language, "REMEMBER", 10)
    small = language.Scores(m)
    for t in texts:
        want.learn_all([t])
        small.learn_all([t])
        assert len(small.row) <= 11 and np.allclose(want.text(t)[1], small.text(t)[1]) and want.text(t)[0] == small.text(t)[0]


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "12 34 !!", "fr", "x"), (6, "le le le", None, "x"), (6, "le le le", None, "x"), (7, "dog " * 50_000, None, "x"), (None, "the cat", None, "x")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, lang string, score string, lang_pred string")
    m = language.train(df)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.predict(df, m).collect())
    assert got == [(0, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "fr"), (6, "fr"), (7, "en")]
    none = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}
    assert language.predict(df.limit(0), m).count() == 0
