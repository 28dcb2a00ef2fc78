"""SimHash components against brute force over all pairs."""

import re

import numpy as np
import xxhash

from quern.llm import simhash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
            a, b = find(i), find(int(j))
            if a != b:
                parent[a] = b
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprint_cases():
    for t in [None, "", " \t\n", "A", "Ä b C d", "a b c d e f a b c d", "x\x1cy z w v u", "a\x85b c d e f g", "w " * 5000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_ties_cover_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, np.int64).astype(np.uint64)
    kin = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, d, replace=False))) for b in base for d in (0, 1, 2, 3, 4, 4, 5, 6)]
    points = np.unique(np.concatenate([base, np.array(kin, np.uint64)]))
    for cells, size in ((4, 4_000_000), (128, 50), (512, 4_000_000)):
        label = np.arange(len(points))
        for cell in range(cells):
            a, b = simhash.ties(points, cell, cells, slice_size=size)
            label = simhash._join(label, np.searchsorted(points, b), np.searchsorted(points, a))
        assert [int(points[x]) for x in label] == plain_components([int(p) for p in points], points.tolist())


def test_cells_bound_a_task_share():
    """Fingerprints per cell, by arithmetic, stay under the bound at any number of fingerprints."""
    for n in (10**5, 8 * 10**6, 128 * 10**6, 10**9, 64 * 10**9):
        cells = simhash.cells_for(n)
        share = n * len(simhash.reach_of(cells)) / cells
        print(n, cells, share)
        assert share <= simhash.TASK_POINTS or (cells == simhash.CELLS and n <= simhash.TASK_POINTS)


def test_components_with_a_hub(spark):
    edges = [(i, 0) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 3000)} == {0} and {got[i] for i in range(5001, 5301)} == {5000}


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    want = {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, plain_components([d.doc_id for d in docs], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_edges(spark):
    rows = [(7, None, "x"), (3, "", "x"), (5, "  ", "x"), (9, "same text here now", "x"), (8, "Same  text here NOW", "x"), (None, "lost", "x"), (8, "Same  text here NOW", "x"), (20, "w " * 200_000, "x"), (21, "W " * 199_990, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(3, 3), (5, 3), (7, 3), (8, 8), (8, 8), (9, 8), (20, 20), (21, 20)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
