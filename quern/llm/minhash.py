"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

A sketch has ``SIZE`` coordinates. In round ``i`` every shingle is hashed anew and placed into one
of them with the value (i, hash); a coordinate keeps its smallest value, so what an earlier round
placed stays. After ``SIZE`` rounds with random places, round ``SIZE + j`` places all shingles into
coordinate ``j``, so every coordinate is filled after ``2 * SIZE`` rounds at the latest, and two sets
agree in a coordinate with a probability equal to their similarity, as concentrated as with independent
hashes. A set of n shingles is done after about SIZE * ln(SIZE) / n rounds instead of hashing each
shingle ``SIZE`` times.

``BANDS`` bands of ``ROWS`` coordinates name buckets. Two sets at the threshold of 0.85 share a
bucket with probability 1 - 2e-7 (computed: 1 - (1 - 0.85^7)^40), and the sketches' own estimate
(``AGREE`` coordinates) lets such a pair pass with 1 - 2e-9. Every link is verified on the sets.

Texts with one set are one point, so copies never multiply. A
group is not compared in all pairs: components need only links that join. Two rounds of stars compare
one member of each component in a bucket with one member of the bucket's largest component; after
them, the members of a bucket that still lie in different components are compared (``crossings``), in blocks
of bounded size, and of those pairs none is left out: first by sketches, then on the sets of those in
doubt. No pair leaves a task unless it is a link. The largest component of a bucket is not compared
with itself, so work on a group of near copies grows with its size; only texts that are
like one another but not alike enough cost pairs, a comparison of two sketches each.

Defined cases: null and empty texts and texts without words have the empty set and are linked with
nothing; fewer words than a shingle make one shingle; long texts are read whole; repeated rows are
linked through their common set; rows that share an id are documents of their own; rows with a null id
are dropped, for they cannot be named; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, give_back, joined_hot, small_batches, written
from quern.llm.near_copies import _WordHashes, mixed, shingles
from quern.llm.simhash import components

WORDS = 3
#: Least similarity, in hundredths.
LEAST = 85
SIZE, ROWS, BANDS = 280, 7, 40
#: Coordinates, of SIZE, in which the sketches of candidates agree at least: at similarity 0.85 238 are expected.
AGREE = 196
#: Bands of the first round of stars.
FIRST = 8
#: Members of a bucket that are compared in one group, from either side.
BLOCK = 1_024
#: Rows, of several buckets, that a group holds on average, unless one block has more.
GROUP = 20_000
#: Texts, and shingles, that a task sketches at once.
PART, PART_SHINGLES = 512, 400_000
_ODD = np.random.default_rng(13).integers(0, 2**63, (2, 2 * SIZE), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(2**64 - 1)


def word_set(text: str | None, memory: dict | None = None) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending; none for a text without words."""
    return shingles(text, WORDS, memory) if text and text.encode().split() else np.empty(0, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SIZE`` values for each set; the empty set's coordinates stay at the largest number."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * SIZE, _EMPTY)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)) * SIZE, size)
    missing = np.full(len(sets), SIZE)
    for i in range(2 * SIZE):
        if not len(element):
            break
        h = mixed((element ^ _ODD[0, i]) * _ODD[1, i])
        place = owner + (((h >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)).astype(np.int64) if i < SIZE else owner + (i - SIZE)
        value = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        new = out[place] == _EMPTY  # what an earlier round placed is smaller
        place, value = place[new], value[new]
        np.minimum.at(out, place, value)
        # filled coordinates, each once
        hit = np.unique(place) // SIZE
        missing -= np.bincount(hit, minlength=len(sets))
        if i % 4 == 3 or i < 4 or i >= SIZE:
            going = missing[owner // SIZE] > 0
            if not going.all():
                element, owner = element[going], owner[going]
    return out.reshape(len(sets), SIZE)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A number for each band of each sketch."""
    out = np.zeros((len(sketch), BANDS), np.uint64)
    for row in range(ROWS):
        out = mixed((out ^ sketch[:, row * BANDS : (row + 1) * BANDS]) * _ODD[1, row])
    return out ^ np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD[0, ROWS]


def prints(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``_p``: the size of its set, the set's digest, its bands' keys as bytes and a byte of each coordinate."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _WordHashes()
        for texts in batches:
            done: list[list] = [[], [], [], []]

            def flush(sets: list[np.ndarray]) -> None:
                sketch = sketches(sets)
                done[0].append(np.array([len(s) for s in sets], np.int64))
                done[1] += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                done[2] += [row.tobytes() for row in band_keys(sketch)]
                done[3] += [row.tobytes() for row in (sketch & np.uint64(255)).astype(np.uint8)]

            sets, held = [], 0
            for i in range(len(texts)):
                sets.append(word_set(texts[i].as_py(), memory))
                held += len(sets[-1])
                if len(sets) == PART or held >= PART_SHINGLES:
                    flush(sets)
                    sets, held = [], 0
            flush(sets)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(done[0])), *(pa.array(x, pa.binary()) for x in done[1:])], names=["n", "set", "bands", "sketch"])
        memory.clear()
        give_back()

    small_batches(docs.sparkSession)
    return docs.withColumn("_p", F.arrow_udf(run, "n long, set binary, bands binary, sketch binary").asNondeterministic()("text"))


def keys_of(points: DataFrame) -> DataFrame:
    """(point, band, key): a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys)], names=["point", "band", "key"])

    return points.select("point", "bands").mapInArrow(run, "point long, band int, key long")


def sets_of(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``_s``: the hashes of its shingles, and their digest."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _WordHashes()
        for texts in batches:
            sets = [word_set(t, memory).view(np.int64) for t in texts.to_pylist()]
            offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.StructArray.from_arrays([hashes, pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())], names=["hashes", "set"])
        memory.clear()
        give_back()

    return docs.withColumn("_s", F.arrow_udf(run, "hashes array<long>, set binary").asNondeterministic()("text"))


def stars(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs (a, b): of each component in a bucket one member with one of the bucket's largest component.

    ``members``: (key, point); ``roots``: (node, root), where a point that is missing is its own root.
    """
    own = members.withColumn("root", F.col("point")) if roots is None else rooted(members, roots)
    # the member that stands for a component differs from bucket to bucket
    order = F.struct(F.xxhash64("key", "point").alias("h"), F.col("point").alias("point"))
    reps = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("rep")).select("key", "root", "n", F.col("rep.point").alias("point"))
    best = F.max(F.struct("n", "point", "root"))
    centre = reps.groupBy("key").agg(best.alias("c"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", F.col("c.point").alias("centre"))
    found = joined_hot(reps, centre, "key", "root").where("point <> centre")
    return found.select(F.greatest("point", "centre").alias("a"), F.least("point", "centre").alias("b")).distinct()


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))


def open_rows(members: DataFrame, points: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (group, key, left, right, side, small, point, root): all members of a bucket that holds several components, as blocks meet.

    Of a bucket's largest component no member is compared with another of it. The others (``small``) are the
    left side (0), all are the right side (1); both are dealt into blocks of about ``BLOCK``, and each left
    block meets each right one. Small buckets share a group.
    """
    own = rooted(members, roots)
    of_root = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    of_key = of_root.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("big"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rest = F.col("all") - F.col("big.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = written(of_key.select("key", F.col("big.root").alias("big"), blocks(rest).alias("lefts"), blocks(F.col("all")).alias("rights"), rest.alias("rest"), "all"))
    sent = plan.agg(F.sum(F.col("all") * F.col("lefts") + F.col("rest") * F.col("rights"))).first()[0] or 0

    open_ = joined_hot(own.select("key", "point", "root"), plan.select("key", "big", "lefts", "rights"), "key", "point").withColumn("small", F.col("root") != F.col("big"))
    block = lambda n: F.pmod(F.xxhash64("point", "key"), n).cast("int")
    left = open_.where("small").withColumn("left", block(F.col("lefts"))).withColumn("right", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("side", F.lit(0))
    right = open_.withColumn("right", block(F.col("rights"))).withColumn("left", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("side", F.lit(1))
    shown = [F.pmod(F.xxhash64("key", "left", "right"), F.lit(1 + sent // GROUP)).alias("group"), "key", "left", "right", "side", "small", "point", "root"]
    return left.select(shown).unionByName(right.select(shown))


class _Block:
    """The rows of a group, and the pairs in it that may be alike."""

    def __init__(self, group: Iterator[pa.RecordBatch], least: int):
        self.table, self.least = pa.Table.from_batches(list(group)), least
        number = lambda name: self.table.column(name).to_numpy()
        self.key, self.left, self.right, self.side, self.point, self.root, self.n = map(number, ("key", "left", "right", "side", "point", "root", "n"))
        self.small = self.table.column("small").to_numpy(zero_copy_only=False)
        self.keys = np.frombuffer(b"".join(self.table.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
        self.sketch = np.frombuffer(b"".join(self.table.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE)

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, rows, agreement): each left row with the right rows that it may be alike to, each pair once and in the first bucket that it shares."""
        order = np.lexsort((self.side, self.right, self.left, self.key))
        ends = [np.diff(x[order]) != 0 for x in (self.key, self.left, self.right)]
        for rows in np.split(order, np.flatnonzero(ends[0] | ends[1] | ends[2]) + 1):
            cut = int(np.searchsorted(self.side[rows], 1))
            others = rows[cut:]
            for i in rows[:cut].tolist():
                j = others[self.root[others] != self.root[i]]
                j = j[~self.small[j] | (self.point[j] < self.point[i])]  # of two small ones either could be the left
                j = j[100 * np.minimum(self.n[i], self.n[j]) >= self.least * np.maximum(self.n[i], self.n[j])]
                agree = (self.sketch[j] == self.sketch[i]).sum(axis=1)
                j, agree = j[agree >= AGREE], agree[agree >= AGREE]
                first = (self.keys[j] == self.keys[i]).argmax(axis=1)
                here = first == int((self.keys[i] == self.key[i]).argmax())
                if here.any():
                    yield i, j[here], agree[here]


def in_doubt(rows: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """Those of ``rows`` that take part in a pair whose sketches are alike."""
    kinds = {x.name: x.dataType for x in rows.schema.fields}

    def take_part(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(group, least)
        marked = np.zeros(len(block.point), bool)
        for i, j, _ in block.candidates():
            marked[i] = True
            marked[j] = True
        yield from block.table.select(list(kinds)).filter(pa.array(marked)).combine_chunks().to_batches()

    schema = ", ".join(f"`{k}` {v.simpleString()}" for k, v in kinds.items())
    return rows.join(points.select("point", "n", "bands", "sketch"), "point").groupBy("group").applyInArrow(take_part, schema)


def crossings(members: DataFrame, points: DataFrame, roots: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """Links (a, b) that join the members of a bucket that lie in different components, verified on the sets.

    Only rows in doubt get their sets. A link joins two components within its group, and pairs of what is
    joined are not compared any more; all others in doubt are.
    """
    rows = in_doubt(open_rows(members, points, roots), points, least)
    whole = written(rows).join(points.select("point", "n", "bands", "sketch"), "point").join(sets, "point")

    def compare(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(group, least)
        column = block.table.column("set").combine_chunks()
        flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()  # unsigned, they ascend
        joined: dict[int, int] = {}

        def find(root: int) -> int:
            while root in joined:
                root = joined[root]
            return root

        a, b = [], []
        for i, j, agree in block.candidates():
            j = j[np.argsort(-agree, kind="stable")]
            own = flat[ends[i] : ends[i + 1]]
            size = 8
            while len(j):
                here = find(int(block.root[i]))
                part = [x for x in j[:size].tolist() if find(int(block.root[x])) != here]
                j, size = j[size:], 256
                if not part:
                    continue
                other = np.concatenate([flat[ends[x] : ends[x + 1]] for x in part])
                hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                n = block.n[part]
                both = np.add.reduceat(hit, np.append(0, np.cumsum(n)[:-1]), dtype=np.int64)
                for x in np.array(part)[100 * both >= least * (len(own) + n - both)].tolist():
                    p, q = find(int(block.root[i])), find(int(block.root[x]))
                    if p != q:
                        joined[max(p, q)] = min(p, q)
                        a.append(max(block.point[i], block.point[x]))
                        b.append(min(block.point[i], block.point[x]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return whole.groupBy("group").applyInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) whose sets, ``sets`` (point, set), are alike; both are compared by the JVM."""
    side = lambda name: sets.select(F.col("point").alias(name), F.col("set").alias(f"set_{name}"))
    met = joined_hot(joined_hot(pairs, side("b"), "b", "a"), side("a"), "a", "b")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return met.where(100 * both >= least * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_shingles, component_id) of each row with an id; ``component_id`` is the smallest id that links lead to."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull())
    found = written(prints(rows).select("id", "_p.*"))
    sets_seen = found.where("n > 0").groupBy("set").agg(F.min("id").alias("least"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    points = written(sets_seen.withColumn("point", F.monotonically_increasing_id()))

    spread = keys_of(points)
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = written(spread.join(shared, "key", "left_semi"))
    # the sets of all points that share a bucket, read from the text of their smallest id
    wanted = points.join(members.select("point").distinct(), "point", "left_semi").select("point", "set", F.col("least").alias("id"))
    texts = rows.join(wanted.select("id"), "id", "left_semi")
    hashes = sets_of(texts).select("id", F.col("_s.set").alias("set"), F.col("_s.hashes").alias("hashes"))
    sets = written(hashes.join(wanted, ["id", "set"]).groupBy("point").agg(F.any_value("hashes").alias("set")))

    def sure(pairs: DataFrame) -> DataFrame:
        return written(verified(pairs, sets, least))

    tested = written(stars(members.where(F.col("band") < FIRST), None))
    edges = sure(tested)
    roots = written(components(edges))
    more = written(stars(members, roots).join(tested, ["a", "b"], "left_anti"))
    edges = edges.unionByName(sure(more))
    roots = written(components(edges))
    last = written(crossings(members, points, roots, sets, least))
    roots = components(edges.unionByName(last))

    named = written(points.join(roots.withColumnRenamed("node", "point"), "point", "left").select("set", "least", F.coalesce("root", "point").alias("root")))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = joined_hot(named.select("set", "root"), of_root, "root", "set").select("set", "component_id")
    linked = joined_hot(found.where("n > 0").select("id", "n", "set"), of_set, "set", "id").select("id", "n", "component_id")
    alone = found.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, its component, and whether it is the one that stays."""
    return near_duplicates(documents(spark, sf_dir)).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_sql() -> str:
    """All pairs that share a shingle, compared on their sets, and their components by recursion."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x20\x09-\x0D]+')"
    shingled = "CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents WHERE doc_id IS NOT NULL),
    s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE {shingled} END AS shingles FROM d),
    x AS MATERIALIZED (SELECT r, unnest(shingles) AS shingle FROM s),
    p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM x a JOIN x b ON a.shingle = b.shingle AND a.r < b.r GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN s u ON u.r = a JOIN s v ON v.r = b WHERE 100 * n >= 85 * (len(u.shingles) + len(v.shingles) - n)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT r, r FROM s),
    reach AS (SELECT a AS node, b AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other),
    c AS (SELECT node AS r, min(t.doc_id) AS component_id FROM reach JOIN s t ON t.r = other GROUP BY 1)
    SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (r)"""
