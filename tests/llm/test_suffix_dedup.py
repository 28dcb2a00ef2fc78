"""Removal of repeated strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np

from quern.llm import suffix_dedup as sd


def plain(rows, length):
    """rows: (id, bytes). For each row (removed spans, kept)."""
    least = {}
    for i, t in rows:
        for a in range(len(t) - length + 1):
            s = t[a : a + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if least[t[a : a + length]] < i:
                gone[a : a + length] = True
        edge = np.flatnonzero(np.diff(np.append(False, gone).astype(int)))
        out.append((i, [tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return out


def test_blind_trie():
    rng = random.Random(1)
    for _ in range(300):
        strings = list({bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(rng.randint(1, 60))})
        assert [strings[i] for i in sd.blind_trie_order(strings)] == sorted(strings)


def test_deep_shallow():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4):
        text = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
        text[1000:1400] = text[200:600]
        starts = np.arange(len(text) - 29)
        for shallow in (8, 16, 32):
            order, group = sd.deep_shallow(text, starts, 30, shallow)
            strings = [text[s : s + 30].tobytes() for s in starts[order]]
            assert strings == sorted(strings)
            assert all((group[k] == group[k + 1]) == (strings[k] == strings[k + 1]) for k in range(len(strings) - 1))


def test_against_all_strings(spark):
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcd é") for _ in range(n)) for n in (49, 50, 51, 120, 400)]
    texts = []
    for _ in range(120):
        t = "".join(rng.choice([rng.choice(shared), "x" * rng.randint(0, 90), "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 80)))]) for _ in range(rng.randint(0, 5)))
        texts.append(t)
    rows = [(rng.randint(0, 100), t) for t in texts] + [(200, texts[3]), (200, texts[3]), (201, None), (202, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, bucket string")
    want = sorted(plain([(i, (t or "").encode()) for i, t in rows], 50))
    for size, hot in ((600, 64), (600, 2), (100_000, 64)):
        got = sorted((r.doc_id, [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in sd.remove_repeats(df, bucket_bytes=size, hot=hot).collect())
        assert got == want
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_hot_anchor_is_dealt_over_parts(spark):
    """A phrase with the smallest anchor that stands in every bucket with changing neighbours does not meet in one part."""
    rng = random.Random(6)
    words = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase = words(30)
    rows = [(i, words(60) + phrase + words(60) + (words(0) if i % 7 else "the tail that some of the documents have in common, word for word")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(plain([(i, t.encode()) for i, t in rows], 50))
    for hot in (2, 10**9):
        got = sorted((r.doc_id, [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in sd.remove_repeats(df, bucket_bytes=900, hot=hot).collect())
        assert got == want
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    anchor, _, first, stop = sd.segments(data, np.cumsum([len(t) for _, t in rows]), 50)
    hot = max(set(anchor.tolist()), key=anchor.tolist().count)
    own = np.flatnonzero(anchor == hot)
    keys = set(sd.finer(data, anchor[own], first[own], stop[own], 50)[1].tolist())
    assert len(own) > 100 and len(keys) > 100


def test_text_longer_than_a_bucket(spark):
    long = "".join(random.Random(7).choice("abcdefgh") for _ in range(60_000))
    rows = [(1, "x" + long), (2, long[:30_000]), (3, None), (4, "short")]
    got = {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.removed)) for r in sd.remove_repeats(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, removed int"), bucket_bytes=5_000).collect()}
    assert got == {1: (60_001, 0), 2: (30_000, 30_000), 3: (0, 0), 4: (5, 0)}


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {i: (sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, s, k in plain([(d.doc_id, d.text.encode()) for d in docs], 50)}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
