"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits; two texts link at ``2 * HALF`` or fewer differing bits. Each
fingerprint has a ball: all values at ``HALF`` or fewer flipped bits. Two fingerprints link
exactly if their balls share a value, and all fingerprints whose balls hold one value link with
one another, so a value's fingerprints need only be tied to the smallest of them.

The variants are shuffled by a linear code: value ``v`` belongs to cell ``H v``, the XOR of the
numbers 1 to 64 of its set bits. The flips that lead a fingerprint into a cell follow from the
cell alone, so a fingerprint travels once to each cell that its ball touches (8 bytes) and its
variants there are written out on arrival. There are so many cells that none gets more than
``TASK_POINTS`` fingerprints on average (``cells_for``), whatever their number, and a cell is worked
off in slices by a second code, so memory is bounded. For large tables that means all 2,081 cells
of a ball, the volume of the method itself: about 17 kB a fingerprint.

Defined cases: null and empty texts have no words and the fingerprint zero; texts of fewer words
than a shingle have their whole word sequence as the only shingle; long texts are read whole; equal
fingerprints are one point, so copies never multiply; ties go to the smallest id; an empty table gives an empty
table; extra columns are ignored; rows with a null id are dropped, for they cannot be named.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import joined_hot, small_batches, written

WORDS = 4
HALF = 2
CELLS = 128
#: Variants written out at once in a task.
SLICE = 4_000_000
#: Fingerprints that a cell, and so a task, gets at most on average.
TASK_POINTS = 4_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of one text, as an unsigned number."""
    data = (text or "").encode().lower()  # bytes.lower changes A-Z only
    parts = data.split()  # of bytes: at space and U+0009 to U+000D
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = np.append(0, ends[:-1])[: len(parts) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed long, for each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([fingerprint(texts[i].as_py(), words) for i in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id, "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias(id), F.col(text).cast("string").alias(text)).where(F.col(id).isNotNull())
    return rows.mapInArrow(run, f"`{id}` long, fp long")


def syndromes(bits: int, shift: int = 0) -> np.ndarray:
    """The code of each of the 64 bits, ``bits`` wide."""
    codes = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) if shift else np.arange(1, 65, dtype=np.uint64)
    return ((codes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def ball(half: int = HALF) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """All flips of at most ``half`` bits, and the bits of each."""
    sets = [c for k in range(half + 1) for c in combinations(range(64), k)]
    return np.array([sum(1 << b for b in c) for c in sets], np.uint64), sets


def code_of(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """XOR of the codes of each value's set bits."""
    out = np.zeros(len(values), np.int64)
    for bit in range(len(codes)):
        out ^= np.where((values >> np.uint64(bit)) & np.uint64(1), codes[bit], 0)
    return out


def cell_codes(cells: int) -> np.ndarray:
    bits = cells.bit_length() - 1
    return syndromes(bits) if bits <= 7 else syndromes(bits, 64 - bits)


def reach_of(cells: int, half: int = HALF, width: int = 64) -> np.ndarray:
    """The codes of all flips: a fingerprint of code ``c`` is sent to the cells ``c ^ reach``."""
    codes = cell_codes(cells)[:width]
    return np.unique([np.bitwise_xor.reduce(codes[list(c)]) if c else 0 for k in range(half + 1) for c in combinations(range(width), k)])


def cells_for(points: int, most: int = TASK_POINTS, least: int = CELLS, width: int = 64, half: int = HALF) -> int:
    """The smallest power of two, at least ``least``, of cells that get at most ``most`` fingerprints each on average."""
    cells = least
    while points * len(reach_of(cells, half, width)) > most * cells and cells < 1 << 40:
        cells *= 2
    return cells


def ties(points: np.ndarray, cell: int, cells: int, half: int = HALF, slice_size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Within one cell, each fingerprint's smallest kin: pairs (fingerprint, smaller one it is tied to).

    The pairs form a forest that joins just those fingerprints whose balls meet in this cell.
    """
    points = np.unique(points)
    flips, sets = ball(half)
    codes = cell_codes(cells)
    flip_code = np.array([np.bitwise_xor.reduce(codes[list(s)]) if s else 0 for s in sets], np.int64)
    want = code_of(points, codes) ^ cell
    label = np.arange(len(points))
    order = np.argsort(flip_code, kind="stable")
    low, high = np.searchsorted(flip_code[order], want, "left"), np.searchsorted(flip_code[order], want, "right")
    total = int((high - low).sum())
    bits = 0
    while total >> bits > slice_size and bits < 16:
        bits += 1
    fine = syndromes(bits, 17) if bits else np.zeros(64, np.int64)
    fine_flip = np.array([np.bitwise_xor.reduce(fine[list(s)]) if s else 0 for s in sets], np.int64)
    fine_point = code_of(points, fine) if bits else np.zeros(len(points), np.int64)
    by_both = np.lexsort((fine_flip, flip_code))
    both = flip_code[by_both] * (1 << bits) + fine_flip[by_both]
    for part in range(1 << bits):
        goal = want * (1 << bits) + (fine_point ^ part)
        low, high = np.searchsorted(both, goal, "left"), np.searchsorted(both, goal, "right")
        n = high - low
        owner = np.repeat(np.arange(len(points)), n)
        flip = by_both[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        value = points[owner] ^ flips[flip]
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        same = value[1:] == value[:-1]
        shared = np.append(False, same) | np.append(same, False)
        value, owner = value[shared], owner[shared]
        if not len(value):
            continue
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        bucket = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(value))))
        # the smallest of a bucket (stable sort: owners ascend within a value) and its kin, verified
        head = owner[first][bucket]
        near = np.bitwise_count(points[head] ^ points[owner]) <= 2 * half
        if not near.all():
            raise AssertionError("fingerprints of one variant must lie within the radius")
        a, b = np.minimum(head, owner), np.maximum(head, owner)
        pair = np.unique(a[a != b] * len(points) + b[a != b])
        label = _join(label, pair // len(points), pair % len(points))
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of ``a[i]`` and ``b[i]``; a class is named by its smallest member."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        new = label.copy()
        np.minimum.at(new, high[apart], low[apart])
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        label = new


def links(points: DataFrame, half: int = HALF, cells: int = CELLS) -> DataFrame:
    """Pairs (``a``, ``b``), ``b`` the smaller, that tie all fingerprints ``fp`` whose balls meet."""
    wide = cell_codes(cells)
    reach = reach_of(cells, half)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell that a batch's fingerprints reach, with those fingerprints as bytes."""
        for part in (batch.slice(at, 2048) for batch in batches for at in range(0, batch.num_rows, 2048)):
            fps = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = code_of(fps, wide)
            order = np.argsort(own, kind="stable")
            own, fps = own[order], fps[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, int)
            parts = np.split(fps, first[1:]) if len(own) else []
            goal: dict[int, list[bytes]] = {}
            for code, part in zip(own[first].tolist(), parts):
                for cell in (reach ^ code).tolist():
                    goal.setdefault(cell, []).append(part.tobytes())
            keys = sorted(goal)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([b"".join(goal[k]) for k in keys], pa.binary())], names=["cell", "fps"])

    def meet(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), np.uint64) for b in group for x in b.column("fps")]
        # fingerprints compare as signed numbers outside, so they do here
        a, b = ties(np.concatenate(held), key[0].as_py(), cells, half)
        a, b = a.view(np.int64), b.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sent = points.select("fp").mapInArrow(send, "cell long, fps binary")
    return sent.groupBy("cell").applyInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, root), root the smallest node of each.

    Alternates large-star and small-star steps; both keep the components and shorten all paths.
    Each round is written to the shared folder; when the edges stay the same, they are stars. The
    number of rounds grows with the square of the logarithm of the nodes at most, so ``rounds`` is only a
    guard against a fault.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = joined_hot(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = joined_hot(large, low, "a", "b").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = written(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, half: int = HALF, cells: int | None = None) -> DataFrame:
    """``id``, ``fp`` and ``component_id``, the smallest id that links lead to, for each row."""
    prints = written(fingerprints(docs, id, text, words))
    points = written(prints.groupBy("fp").agg(F.min(id).alias("least")))
    cells = cells or cells_for(points.count())
    roots = components(links(points, half, cells))
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = joined_hot(named.select("fp", "root"), least, "root", "fp").select("fp", "component_id")
    return joined_hot(prints, of_point, "fp", id).select(id, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
