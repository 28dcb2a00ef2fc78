"""Near copies at a similarity: SimHash ball hashing over texts whose shingle sets are alike.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8
or more. The 64-bit fingerprints of such texts differ by about 10 bits, too many for the ball of one
fingerprint, so a text has ``TABLES`` independent SimHash fingerprints of 32 bits each. In each table
every fingerprint has a ball, all values at one or no flipped bit; texts whose balls share a value
(two or fewer differing bits) are candidates. A pair at 0.8 is a candidate in at least one table with
probability 0.9975, at 0.85 with 0.99998. Candidates are compared on all their fingerprints first
(``FAR``) and then on the shingle sets themselves, so no link is false. Fingerprints of few shingles
scatter more (of 4 and 5 shingles a quarter of the pairs are lost), so texts of up to ``SHORT`` shingles
also meet by the shingles themselves, and of those no pair is lost.

Groups are not compared in all pairs. A first round, on ``FIRST`` tables, compares each text with the
smallest one of its class in a table and with the class's centre, the text nearest to the majority of
its bits; what is alike becomes one component. A second round, on all tables, takes all pairs that
meet in a ball and still lie in different components. Texts that such pairs
tie together are a family, as are short texts that share a shingle; each two members of a family are
compared on their sets, in blocks where they stand, so no table of pairs is
made (beyond ``WIDE_POINTS`` texts one still is, of pairs of balls). Work on a group of near copies grows with its size; only a family
of texts that meet without being alike costs comparisons with the square of its size.

Texts with one shingle set are one point from the start. Sets are held as 64-bit hashes.

Defined cases: words are those of ``simhash``; null and empty texts have the empty shingle and are
copies of one another; texts of fewer words than a shingle have their whole word sequence as the
only shingle; long texts are read whole; of a component the row with the smallest id stays, rows
without an id last, and of rows with one id the one with the smallest digest of all columns; wholly
equal rows stay once; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import parts
from quern.llm.common import give_back, joined_hot, small_batches, written
from quern.llm.simhash import _join, cells_for, code_of, components, syndromes

WORDS = 5
LEAST = 0.8
TABLES, BITS = 48, 32
#: Tables of the first round.
FIRST = 8
#: Differing bits, of the 64 of two further tables, beyond which texts do not meet: at similarity 0.8 10 are expected, and more than this with probability 1e-4.
NEAR = 21
#: Differing bits, of TABLES * BITS, beyond which a pair is no candidate: at similarity 0.8 233 are expected, and more than this with probability 1e-6.
FAR = 300
#: Variants that a task writes out at once, and fingerprints of one table that it takes at most.
SLICE = 1_500_000
TASK_POINTS = 4_000_000
#: Up to so many points a task takes ``TOGETHER`` tables, with all fingerprints of each point.
WIDE_POINTS, TOGETHER = 1_000_000, 8
#: Members of a family that are compared with one another, or with as many others, in one task.
BLOCK = 512
#: Shingles of a text up to which its copies are found by shared shingles too. Of pairs at just 0.8 fingerprints lose up to 27 % below, and under 0.5 % above (measured).
SHORT = 100
#: Shingles of a family's sets that are counted at once, and those of them that several sets have.
HASHES, COLUMNS = 2_000_000, 4_096
_FLIPS = np.append(np.uint64(0), np.uint64(1) << np.arange(BITS, dtype=np.uint64))
_ODD = np.random.default_rng(11).integers(0, 2**63, (2, TABLES * BITS // 64), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """Hashes of words, computed once; the memory is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = found
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS, memory: dict | None = None) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    parts = (text or "").encode().lower().split()
    memory = _WordHashes() if memory is None else memory
    own = np.fromiter(map(memory.__getitem__, parts), np.uint64, len(parts))
    size = max(1, len(own) - words + 1)
    out = np.full(size, len(parts) if len(parts) < words else words, np.uint64)
    for k in range(min(words, len(own))):
        out = mixed(out) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + size]
    return np.unique(mixed(out))


def majority(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of ``words`` (rows, texts, 64-bit words) the bits that are set in over half of each text's ``count`` rows.

    Where just half of the rows have a bit, the first row decides. Rows are added up bit by bit with
    carries, in binary, so a row costs a few operations per word.
    """
    planes, level = [], words
    while len(level):
        carries = []
        while len(level) > 1:
            third = len(level) // 3
            if not third:
                carries.append((level[:1] & level[1:2]))
                level = level[:1] ^ level[1:2]
                break
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            both = a ^ b
            carries.append((a & b) | (both & c))
            level = np.concatenate([both ^ c, level[3 * third :]])
        planes.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    more = np.zeros(words.shape[1:], np.uint64)
    same = ~more
    half = (count // 2)[:, None]
    for k in range(max(len(planes), int(half.max()).bit_length()) - 1, -1, -1):
        plane = planes[k] if k < len(planes) else np.zeros_like(more)
        bit = -((half >> k) & 1).astype(np.int64).view(np.uint64)
        more |= same & plane & ~bit
        same &= ~(plane ^ bit)
    even = -(1 - (count & 1)).astype(np.int64)[:, None].view(np.uint64)
    return more | (same & even & words[0])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of each shingle set: a row of ``TABLES`` numbers of 32 bits."""
    out = np.zeros((len(sets), TABLES * BITS // 64), np.uint64)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # texts of like size are added up together, the shorter ones filled up with zeros
        most = max(8, int(sizes[order[at]] * 1.2))
        stop = min(int(np.searchsorted(sizes[order], most, "right")), at + max(1, 40_000 // most))
        part = order[at:stop]
        rows = int(sizes[part].max())
        padded = np.zeros((rows, len(part)), np.uint64)
        for k, i in enumerate(part.tolist()):
            padded[: sizes[i], k] = sets[i]
        words = mixed((padded[:, :, None] ^ _ODD[0]) * _ODD[1])
        words[np.arange(rows)[:, None] >= sizes[part]] = 0
        out[part] = majority(words, sizes[part])
        at = stop
    return out


def prints(docs: DataFrame, text: str, words: int, short: int = 0) -> DataFrame:
    """``docs`` with ``_fp``, the digest of the shingle set, ``_sketch``, its fingerprints two to a number, and ``_short``, the set itself if it has ``short`` members or fewer."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _WordHashes()
        for texts in parts(batches):
            sets = [shingles(t, words, memory) for t in texts.to_pylist()]
            fps = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            flat = sketches(sets).view(np.int64).ravel()
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * (TABLES * BITS // 64)
            few = pa.array([s.view(np.int64) if len(s) <= short else None for s in sets], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), few], names=["fp", "sketch", "short"])
        memory.clear()
        give_back()

    small_batches(docs.sparkSession)
    found = F.arrow_udf(run, "fp long, sketch array<long>, short array<long>").asNondeterministic()(F.col(text).cast("string"))
    return docs.withColumn("_found", found).withColumns({"_fp": F.col("_found.fp"), "_sketch": F.col("_found.sketch"), "_short": F.col("_found.short")}).drop("_found")


def meetings(values: np.ndarray, codes: np.ndarray, cell: int, slice_size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members (places in ``values``) of all balls' values in a cell that have several, and the first place of each value among them."""
    slices = 1 + len(values) * len(_FLIPS) // slice_size
    for part in range(slices):
        found, owners = [], []
        for flip in _FLIPS:
            v = values ^ flip
            keep = np.ones(len(v), bool) if slices == 1 else mixed(v) % np.uint64(slices) == part
            if codes.any():
                keep &= code_of(v, codes) == cell
            own = np.flatnonzero(keep)
            found.append(v[own])
            owners.append(own)
        value, owner = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        same = value[1:] == value[:-1]
        shared = np.append(False, same) | np.append(same, False)
        value, owner = value[shared[: len(value)]], owner[shared[: len(value)]]
        yield owner, np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])


def centres(values: np.ndarray, points: np.ndarray, codes: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs: each member of a class of a cell with its smallest point and with the one nearest to its majority."""
    label = np.arange(len(values))
    for owner, first in meetings(values, codes, cell):
        size = np.diff(np.append(first, len(owner)))
        head = np.repeat(owner[first], size)
        apart = head != owner
        label = _join(label, head[apart], owner[apart])
    order = np.lexsort((points, label))
    own = label[order]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    size = np.diff(np.append(start, len(own)))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = order[np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
    begin = np.cumsum(size) - size
    far = np.zeros(len(row), np.int64)
    for bit in range(BITS):
        ones = ((values[row] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        common = 2 * np.add.reduceat(ones, begin) > size
        far += ones != np.repeat(common, size)
    place = np.lexsort((points[row], far, np.repeat(np.arange(len(size)), size)))
    a, b = np.append(row, row), np.append(np.repeat(row[place[begin]], size), np.repeat(row[begin], size))
    return a[a != b], b[a != b]


def crossings(values: np.ndarray, roots: np.ndarray, codes: np.ndarray, cell: int, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs that meet in a cell and have different ``roots``."""
    for owner, first in meetings(values, codes, cell):
        size = np.diff(np.append(first, len(owner)))
        ball = np.repeat(np.arange(len(first)), size)
        order = np.lexsort((roots[owner], ball))
        owner = owner[order]
        root = roots[owner]
        change = np.append(True, (root[1:] != root[:-1]) | (ball[1:] != ball[:-1]))[: len(owner)]
        group = np.cumsum(change) - 1
        group_stop = np.append(np.flatnonzero(change)[1:], len(owner))[group] if len(owner) else owner
        n = np.repeat(first + size, size) - group_stop
        at = 0
        total = np.cumsum(n)
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            m = n[at:stop]
            if m.any():
                left = np.repeat(np.arange(at, stop), m)
                right = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(group_stop[at:stop], m)
                yield owner[left], owner[right]
            at = stop


def alike_prints(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows differ in ``FAR`` bits or fewer."""
    near = np.flatnonzero(np.bitwise_count(sketch[a, 0] ^ sketch[b, 0]) <= NEAR)
    out = np.zeros(len(a), bool)
    for part in np.array_split(near, 1 + len(near) // 50_000):
        out[part] = np.bitwise_count(sketch[a[part]] ^ sketch[b[part]]).sum(axis=1, dtype=np.int64) <= FAR
    return out


def met(points: DataFrame, n: int, rooted: bool) -> DataFrame:
    """Candidate pairs (a, b), the larger point first, among ``points`` (fp, sketch and, if ``rooted``, root).

    Up to ``WIDE_POINTS`` points, all fingerprints of a point travel together, once for every
    ``TOGETHER`` tables, and decide in place; if ``rooted``, a point comes with the smallest one that pairs lead to
    instead of with all its partners, for ``family_links``. Beyond, a fingerprint travels once to each cell of a table
    that its ball touches, together with its point and the fingerprints of the two next tables, by which
    texts that met by chance are told apart; ``close`` decides on the rest.
    """
    wide = n <= WIDE_POINTS
    stars = wide and rooted
    cells = 1 if wide else cells_for(n, TASK_POINTS, 1, BITS, 1)
    codes = syndromes(cells.bit_length() - 1)[:BITS]
    reach = np.unique(np.append(0, codes))
    used = TABLES if rooted else FIRST
    head = 2 if rooted else 1
    width = head + (TABLES * BITS // 64 if wide else 2)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, 2048) for batch in batches for at in range(0, batch.num_rows, 2048)):
            own = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in ((0, 2) if rooted else (0,))], axis=1)
            sketch = part.column(1).flatten().to_numpy().reshape(len(own), -1)
            if wide:
                held = np.concatenate([own, sketch], axis=1).tobytes()
                goal = {(t, 0): [held] for t in range(0, used, TOGETHER)}
            else:
                tables, goal = sketch.view(np.uint32).reshape(len(own), TABLES).astype(np.uint64), {}
                for t in range(used):
                    value = tables[:, t]
                    more = (tables[:, (t + 1) % TABLES] << np.uint64(32)) | tables[:, (t + 2) % TABLES]
                    rows = np.concatenate([own, np.stack([more, value], axis=1).view(np.int64)], axis=1)
                    code = code_of(value, codes)
                    for c in np.unique(code).tolist():
                        sent = rows[code == c].tobytes()
                        for cell in (reach ^ c).tolist():
                            goal.setdefault((t, cell), []).append(sent)
            keys = sorted(goal)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int64()), pa.array([b"".join(goal[k]) for k in keys], pa.binary())], names=["table", "cell", "rows"])

    def meet(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.frombuffer(x.as_py(), np.int64) for b in group for x in b.column("rows")]).reshape(-1, width)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        fps, prints, table, cell = rows[:, 0], np.ascontiguousarray(rows[:, head:]).view(np.uint64), key[0].as_py(), key[1].as_py()
        columns = prints.view(np.uint32).reshape(len(rows), -1)[:, table : table + TOGETHER].T if wide else prints[:, 1:].T
        label = np.arange(len(rows))
        for values in columns.astype(np.uint64):
            for a, b in crossings(values, rows[:, 1], codes, cell) if rooted else [centres(values, fps, codes, cell)]:
                near = alike_prints(prints, a, b) if wide else np.bitwise_count(prints[a, 0] ^ prints[b, 0]) <= NEAR
                if stars:
                    label = _join(label, a[near], b[near])
                    continue
                x, y = fps[a[near]], fps[b[near]]
                pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
        if stars:
            own = np.flatnonzero(label != np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[label[own]])], names=["a", "b"])
        del rows, fps, prints, columns, label
        give_back()

    sent = points.select("fp", "sketch", *(["root"] if rooted else [])).mapInArrow(send, "table int, cell long, rows binary")
    found = sent.groupBy("table", "cell").applyInArrow(meet, "a long, b long").distinct()
    return found if wide else close(found, points)


def close(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs whose fingerprints differ in ``FAR`` bits or fewer over all tables."""
    side = lambda name: points.select(F.col("fp").alias(name), F.col("sketch").alias(f"sketch_{name}"))
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return joined_hot(pairs, side("b"), "b", "a").join(side("a"), "a").where(bits <= FAR).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike by ``least``; ``texts`` holds (fp, text)."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        memory = _WordHashes()
        last: dict[str, tuple] = {"a": (None, None), "b": (None, None)}
        for a, b, text_a, text_b in batches:
            keep = []
            for i in range(len(a)):
                for side, fp, text in (("a", a[i].as_py(), text_a), ("b", b[i].as_py(), text_b)):
                    if last[side][0] != fp:
                        last[side] = fp, shingles(text[i].as_py(), words, memory)
                x, y = last["a"][1], last["b"][1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.array(keep, pa.bool_())
        memory.clear()
        give_back()

    side = lambda name: texts.select(F.col("fp").alias(name), F.col("text").alias(f"text_{name}"))
    met = joined_hot(pairs, side("b"), "b", "a").join(side("a"), "a")
    return met.withColumn("_alike", F.arrow_udf(run, "boolean").asNondeterministic()("a", "b", "text_a", "text_b")).where("_alike").select("a", "b")


def families(stars: DataFrame) -> DataFrame:
    """(fam, fp, n) of the points that ``stars`` (a, b) tie together; n points have one ``fam``."""
    roots = components(stars)
    members = written(roots.select(F.col("root").alias("fam"), F.col("node").alias("fp")).unionByName(roots.select(F.col("root").alias("fam"), F.col("root").alias("fp")).distinct()))
    return joined_hot(members, members.groupBy("fam").agg(F.count(F.lit(1)).alias("n")), "fam", "fp")


def short_families(points: DataFrame, least: float) -> DataFrame:
    """(fam, fp, n): the points of one ``fam`` have a shingle in common, and not all have one root; ``points``: fp, root, short.

    Two sets that are alike by ``least`` share one of the first ``size - least * size + 1`` shingles of each, in
    any order of all shingles. Here the rarest come first, so what many texts have ties few together.
    """
    own = points.where("short IS NOT NULL").select("fp", "root", F.size("short").alias("size"), F.explode("short").alias("h"))
    several = own.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    seen = joined_hot(own, several, "h", "fp").groupBy("fp", "root", "size").agg(F.array_sort(F.collect_list(F.struct("texts", "h"))).alias("shared"))
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    here = F.greatest(F.lit(0), first - (F.col("size") - F.size("shared"))).cast("int")  # a set's other shingles are in no other set
    held = written(seen.select("fp", "root", F.explode(F.slice("shared", F.lit(1), here)["h"]).alias("h")))
    tied = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("root") != F.max("root")).alias("apart")).where("apart")
    return joined_hot(held, tied, "h", "fp").select(F.xxhash64(F.lit("short"), "h").alias("fam"), "fp", "n")


def alike_sets(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` of all pairs of sets that are alike by ``least``; without ``right``, each two of ``left``, once."""
    sets = [*left, *(right or [])]
    sizes, cut = np.array([len(s) for s in sets]), len(left)
    common = np.zeros((cut, len(sets) - cut if right is not None else cut), np.float32)
    slices = 1 + int(sizes.sum()) // HASHES
    ends = [np.searchsorted(s, np.array([2**64 * k // slices for k in range(1, slices)], np.uint64)) for s in sets]
    for k in range(slices):
        parts = [s[e[k - 1] if k else 0 : e[k] if k < slices - 1 else len(s)] for s, e in zip(sets, ends)]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in parts])
        values, column, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = count > 1
        keep = np.flatnonzero(several[column])
        column, owner = (np.cumsum(several) - 1)[column[keep]], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for start in range(0, int(several.sum()), COLUMNS):
            at, stop = np.searchsorted(column, (start, start + COLUMNS))
            has = np.zeros((len(sets), int(column[stop - 1]) - start + 1), np.float32)
            has[owner[at:stop], column[at:stop] - start] = 1
            common += has[:cut] @ (has[cut:] if right is not None else has).T
    both = common.astype(np.float64)
    alike = both >= least * (sizes[:cut, None] + sizes[None, cut:] - both if right is not None else sizes[:, None] + sizes[None, :] - both)
    return np.nonzero(alike if right is not None else np.triu(alike, 1))


def family_links(members: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) between the roots of points of one family whose shingle sets are alike by ``least``.

    ``members``: fam, n, fp, root, text. Each two members of different roots are compared on their sets,
    and no pair leaves its task: a family is dealt into blocks of about ``BLOCK``, and each
    two blocks meet in one task; small families share tasks. Of a task only links that join its roots come.
    """
    points = members.count()
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = F.col("n") > BLOCK
    bin = F.when(many, F.col("fam")).otherwise(F.pmod(F.xxhash64("fam"), F.lit(1 + points // BLOCK)))
    dealt = own.select(many.alias("many"), bin.alias("bin"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "fam", "block", "root", "text")

    def run(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group))
        fam, block, root = (table.column(c).to_numpy() for c in ("fam", "block", "root"))
        text, memory = table.column("text"), _WordHashes()
        names, place = np.unique(root, return_inverse=True)
        label, left, right = np.arange(len(names)), key[2].as_py(), key[3].as_py()
        order = np.argsort(fam, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(fam[order])) + 1):
            if len(np.unique(label[place[rows]])) == 1:  # all lead to one root already
                continue
            near, far = rows[block[rows] == left], rows[block[rows] == right]
            sets = [[shingles(text[i].as_py(), words, memory) for i in side.tolist()] for side in ((near,) if left == right else (near, far))]
            a, b = alike_sets(sets[0], None if left == right else sets[1], least)
            label = _join(label, place[near[a]], place[far[b]])
            del sets
        memory.clear()
        own = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[label[own]])], names=["a", "b"])
        del table
        give_back()

    return dealt.groupBy("many", "bin", "left", "right").applyInArrow(run, "a long, b long")


def kept(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, short: int = SHORT) -> DataFrame:
    """``docs`` with one row of each component of near copies; of texts of up to ``short`` shingles no pair is lost."""
    rows = docs.withColumn("_row", F.xxhash64(*docs.columns))
    order = F.struct(F.col(id).isNull().alias("last"), F.col(id).cast("long").alias("id"), F.col("_row").alias("row"))
    found = written(prints(rows, text, words, int(short / least)).select(order.alias("first"), F.col("_fp").alias("fp"), F.col("_sketch").alias("sketch"), F.col("_short").alias("short")))
    points = written(found.groupBy("fp").agg(F.min("first").alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("short").alias("short")))
    n = points.count()

    def texts(fps: DataFrame) -> DataFrame:
        one = points.join(fps, "fp").select("fp", F.col("first.row").alias("_row"))
        return written(rows.select("_row", F.col(text).cast("string").alias("text")).join(one, "_row").groupBy("fp").agg(F.any_value("text").alias("text")))

    def alike(pairs: DataFrame) -> DataFrame:
        return written(verified(pairs, texts(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), words, least))

    first = written(met(points, n, False))
    sure = alike(first)
    rooted = written(points.join(components(sure), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node"))
    second = met(rooted, n, True)
    members = short_families(rooted, least)
    if n <= WIDE_POINTS:
        members = members.unionByName(families(second))
    else:
        sure = sure.unionByName(alike(written(second.join(first, ["a", "b"], "left_anti"))))
    members = written(members)
    whole = written(members.join(rooted.select("fp", "root"), "fp").join(texts(members.select("fp").distinct()), "fp"))
    more = written(family_links(whole, words, least))
    roots = components(sure.unionByName(more))

    named = points.join(roots, points.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)
