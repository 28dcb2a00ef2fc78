"""MinHash components against brute force over all pairs."""

import random
import re

import duckdb
import numpy as np

from quern.llm import minhash

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def plain(rows):
    """Sorted (id, set size, component) of (id, text) rows with an id."""
    rows = [(i, plain_set(t)) for i, t in rows if i is not None]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            both = len(a & b)
            if both and 100 * both >= 85 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (id, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, id), id)
    return sorted((id, len(s), least[find(i)]) for i, (id, s) in enumerate(rows))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    con.execute(minhash.op13_sql())
    found = rows_of(minhash.op13_minhash(spark, SF))
    assert found == sorted(con.fetchall())
    assert any(not r[3] for r in found)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def family_rows(seed):
    """Near copies of a text, texts that are alike but not alike enough, chains, and odd rows."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 + i, edited(rng, base, rng.choice([0, 1, 1, 2, 3]))) for i in range(60)]
    other = [f"v{i}" for i in range(90)]
    rows += [(2000 + i, edited(rng, other, rng.choice([4, 5, 6]))) for i in range(50)]
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):  # each is near the one before it only
        rows.append((3000 - k, " ".join(chain)))
        chain[k * 5] = f"d{k}"
        chain[k * 5 + 3] = f"f{k}"
    rows += [(10, None), (11, ""), (12, " \t\n"), (13, "one"), (14, "ONE"), (15, "one two"), (16, "one two three"), (17, "one two three four"), (None, "one two"), (18, "Ä ä Ö"), (19, "ä ä ö")]
    rows += [(20, "same id " * 9), (20, "another text of the same id as the row before it"), (21, "same id " * 9)] + [(22, "x " * 3000)] * 4
    rng.shuffle(rows)
    return rows


def test_families_chains_and_odd_rows(spark, monkeypatch):
    rows = family_rows(4)
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, point string, n int").repartition(6)
    assert rows_of(minhash.near_duplicates(docs)) == plain(rows)
    # blocks and groups of other sizes change nothing
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP", 10)
    monkeypatch.setattr(minhash, "FIRST", 1)
    assert rows_of(minhash.near_duplicates(docs)) == plain(rows)


def test_empty_table(spark):
    assert rows_of(minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_sketches_fill_and_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 60, 5000):
        sets = []
        for _ in range(40):
            both = rng.integers(0, 2**63, size, np.int64).astype(np.uint64)
            more = rng.integers(0, 2**63, size, np.int64).astype(np.uint64)
            sets += [np.unique(both), np.unique(np.append(both, more))]  # similarity one half
        found = minhash.sketches(sets)
        assert (found < minhash._EMPTY).all()
        share = (found[::2] == found[1::2]).mean(axis=1)
        assert abs(share.mean() - 0.5) < 0.02 and share.std() < 0.045
        # each set alone has the same sketch as beside others
        assert (minhash.sketches(sets[:1])[0] == found[0]).all()
    assert (minhash.sketches([np.empty(0, np.uint64)]) == minhash._EMPTY).all()


def test_long_sets_need_few_rounds(monkeypatch):
    rounds = []
    real = minhash.mixed
    monkeypatch.setattr(minhash, "mixed", lambda h: rounds.append(len(h)) or real(h))
    minhash.sketches([np.arange(20_000, dtype=np.uint64)])
    assert sum(rounds) <= 4 * 20_000
