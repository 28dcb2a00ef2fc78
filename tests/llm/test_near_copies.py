"""The near-copy stage against brute force over all pairs of five-word shingle sets."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import near_copies


def plain_kept(rows, words=5, least=0.8):
    """The smallest id of each component, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(i for i in sets if find(i) == i)


def test_stage_finds_copies_at_the_threshold(spark):
    rng = random.Random(3)
    rows = [(1000, None), (1001, ""), (1002, "short text"), (1003, "Short  TEXT")]
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((8, 60, 300)))]
        for k in range(6):
            copy = [f"x{rng.randrange(5000)}" if rng.random() < 0.006 * k else w for w in base]
            rows.append((g * 10 + k, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == plain_kept(rows) and len(got) < 150


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want


def test_large_groups(spark):
    """A group of many near copies is one component, also where its texts are alike only through one of them."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(60)]
    star = [f"s{i}" for i in range(400)]
    rows.append((500, " ".join(star)))
    for k in range(60):  # each at about 0.86 to the middle and 0.75 to one another
        own = list(star)
        for p in rng.sample(range(0, 400, 5), 6):
            own[p] = f"x{k}_{p}"
        rows.append((600 + k, " ".join(own)))
    want = plain_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert want == [0, 500] and sorted(r.doc_id for r in near_copies.kept(docs).collect()) == want


def test_many_points_take_cells(spark, monkeypatch):
    """Beyond WIDE_POINTS fingerprints travel to the cells of each table, with the same result."""
    rng = random.Random(5)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [(g * 10 + k, " ".join(f"x{rng.randrange(5000)}" if rng.random() < 0.006 * k else w for w in base)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    monkeypatch.setattr(near_copies, "WIDE_POINTS", 10)
    monkeypatch.setattr(near_copies, "TASK_POINTS", 100)
    assert sorted(r.doc_id for r in near_copies.kept(docs).collect()) == want


def test_majority_and_shingles():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (50, 3, 2), np.int64).astype(np.uint64)
    count = np.array([50, 37, 2])
    for i, c in enumerate(count):
        words[c:, i] = 0
    got = near_copies.majority(words, count)
    for i, c in enumerate(count):
        for k in range(2):
            assert int(got[i, k]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in words[:c, i, k]) + (1 - c % 2) * (int(words[0, i, k]) >> b & 1) > c)
    assert len(near_copies.shingles("a b c d e f a b c d e f")) == 6 and len(near_copies.shingles("a b")) == 1
    assert near_copies.shingles("A  b").tolist() == near_copies.shingles("a b").tolist() != near_copies.shingles("b a").tolist()


def test_crossings_are_all_pairs_of_different_roots():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, 30, np.int64).astype(np.uint64)
    values = np.concatenate([base, base ^ np.uint64(1), base[:10] ^ np.uint64(6), base[:5]])
    roots = rng.integers(0, 3, len(values))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if roots[i] != roots[j] and int(values[i] ^ values[j]).bit_count() <= 2}
    for cells in (1, 4):
        codes = near_copies.syndromes(cells.bit_length() - 1)[:32]
        for size in (4_000_000, 100):
            got = set()
            for cell in range(cells):
                for owner, first in near_copies.meetings(values, codes, cell, size):
                    assert len(owner) == 0 or first[0] == 0
                for a, b in near_copies.crossings(values, roots, codes, cell, most=5):
                    got |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
            assert got == want


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(2, "a b c", "x"), (2, "a b c", "x"), (2, "A b  c", "y"), (None, "a b c", "x"), (None, "other words", "x"), (None, None, None), (9, "", "x"), (8, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp string")
    got = near_copies.kept(docs).collect()
    assert sorted((r.doc_id or 0, r.text[:1]) for r in got) == [(0, "o"), (2, got[[r.doc_id for r in got].index(2)].text[0]), (8, " ")]
    assert near_copies.kept(docs.limit(0)).count() == 0


def test_a_family_below_the_threshold_makes_no_table_of_pairs(spark, monkeypatch):
    """Texts of about 0.75 to one another meet with the square of their number; rows grow with the number alone."""
    monkeypatch.setattr(near_copies, "BLOCK", 40)
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(300)], []
    for k in range(150):
        own = list(base)
        for p in rng.sample(range(0, 300, 5), 6 if k % 3 else 3):
            own[p] = f"x{k}_{p}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    points = near_copies.prints(docs, "text", 5).select("doc_id", "text", F.col("_fp").alias("fp"), F.col("_fp").alias("root"), F.col("_sketch").alias("sketch")).localCheckpoint()
    stars = near_copies.met(points, 150, True).localCheckpoint()
    assert 0 < stars.count() <= 150 * near_copies.TABLES // near_copies.TOGETHER
    members = near_copies.families(stars).join(points, "fp")
    links = near_copies.family_links(members, 5, 0.8).collect()
    roots = {r.fp: r.doc_id for r in points.select("fp", "doc_id").collect()}
    want, low = plain_kept(rows), {}
    for a, b in ((roots[r.a], roots[r.b]) for r in links):
        low.setdefault(a, set()).add(b), low.setdefault(b, set()).add(a)
    seen, heads = set(), []
    for i in range(150):
        if i not in seen:
            heads.append(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += low.get(x, ())
    assert heads == want and 1 < len(want) < 150


def test_short_texts_lose_no_copy(spark):
    """Fingerprints of few shingles scatter: of 8 and 9 words, or 13 with two more, a fifth to a quarter of the copies at 0.8 were kept."""
    rng, rows = random.Random(7), []
    for g in range(120):
        n = (8, 12, 20, 22)[g % 4]
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        more = (1, 2, 4, 2)[g % 4]
        own = [f"v{rng.randrange(10**6)}" for _ in range(more)]
        rows += [(2 * g, " ".join(base if g % 4 < 3 else [*base, "x", "y"])), (2 * g + 1, " ".join([*base, *own]))]
    want = plain_kept(rows)
    assert len(want) == 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.kept(docs).collect()) == want
    assert len(near_copies.kept(docs, short=0).collect()) > 120


def test_short_texts_with_a_common_line(spark):
    """A line that all share ties no texts whose own shingles are rarer; those beyond the cells' switch are found too."""
    rng, rows, line = random.Random(8), [], [f"l{i}" for i in range(30)]
    for g in range(40):
        base = [*line, *[f"w{rng.randrange(10**6)}" for _ in range(30)]]
        rows += [(10 * g + k, " ".join([*base, *[f"v{rng.randrange(10**6)}" for _ in range(13 if k else 0)]])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert 40 <= len(want) < 120
    points = near_copies.prints(docs, "text", 5, 125).select(F.col("_fp").alias("fp"), F.col("_fp").alias("root"), F.col("_short").alias("short"))
    assert near_copies.short_families(points, 0.8).agg(F.max("n")).first()[0] == 3
    assert sorted(r.doc_id for r in near_copies.kept(docs).collect()) == want


def test_families_are_compared_on_their_sets(spark):
    """Two texts of 13 and 9 words more than FAR bits apart are linked where they are members of one family."""
    rng = random.Random(9)
    pairs = []
    while len(pairs) < 5:
        base = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        a, b = near_copies.sketches([near_copies.shingles(" ".join(t)) for t in (base[:8], base)])
        if np.bitwise_count(a ^ b).sum() > near_copies.FAR:
            pairs.append((" ".join(base[:8]), " ".join(base)))
    rows = [(g, 2, 2 * g + k, 2 * g + k, t) for g, both in enumerate(pairs) for k, t in enumerate(both)]
    sketch = [near_copies.sketches([near_copies.shingles(r[-1])])[0].view(np.int64).tolist() for r in rows]
    members = spark.createDataFrame([(*r, s) for r, s in zip(rows, sketch)], "fam long, n long, fp long, root long, text string, sketch array<long>")
    got = {tuple(sorted((r.a, r.b))) for r in near_copies.family_links(members, 5, 0.8).collect()}
    assert got == {(2 * g, 2 * g + 1) for g in range(5)}


def test_alike_sets_counts_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, np.int64).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(base, rng.integers(40, 60), replace=False)) for _ in range(30)] + [base[:0], base[:1]]
    same = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    for hashes, columns in ((2_000_000, 4_096), (100, 7)):
        monkeypatch.setattr(near_copies, "HASHES", hashes)
        monkeypatch.setattr(near_copies, "COLUMNS", columns)
        a, b = near_copies.alike_sets(sets, None, 0.8)
        want = {(i, j) for i in range(32) for j in range(i + 1, 32) if same(sets[i], sets[j])}
        assert set(zip(a.tolist(), b.tolist())) == want and 0 < len(want) < 400
        a, b = near_copies.alike_sets(sets[:12], sets[12:], 0.8)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j - 12) for i, j in want if i < 12 <= j}
