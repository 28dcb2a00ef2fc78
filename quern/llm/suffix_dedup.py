"""Removal of byte strings that also start in a document with a smaller id, by suffix arrays.

A string of ``length`` bytes is judged by its anchor, the smallest hash of its ``GRAM``-byte
grams: equal strings have equal anchors. Runs of neighbouring strings with one anchor make a
segment. The texts are dealt once into buckets of about ``BUCKET`` bytes, and then

1. each bucket sends its distinct anchors, hashed into parts; a part answers each bucket which
   of them other buckets have too, and which stand in ``HOT`` buckets or more (two bits each);
2. each bucket sends the segments of shared anchors, each distinct one once and from its smallest
   document; later copies within the bucket are removed on the spot;
3. each part drops segments that a smaller document has whole, and sorts the suffixes of the
   others (their strings) by deep-shallow sorting: multikey sorting by eight-byte digits to a
   shallow depth, then blind tries for groups that are still tied. Equal strings lie together;
   all but those of the smallest document are removed;
4. each bucket gathers the spans of its documents.

The text shuffle is written once and read by steps 1, 2 and 4. A hot string is sent once per
bucket, not once per document. The segments of a hot anchor are cut further, and dealt over the parts,
by the bytes beside the anchor that each string holds: a phrase that stands everywhere with changing
neighbours then meets its like only.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` stay whole; very long
texts, also longer than a bucket, are read whole by one task; rows of one id never remove from one
another; an empty table gives an empty table; extra columns are ignored, also those with the names of
outputs; rows with a null id are dropped, for they have no order.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 50
GRAM = 16
#: Bytes of text in a bucket, about.
BUCKET = 6_000_000
#: Bytes hashed at once, and strings sorted at once.
PIECE = 2_000_000
SORT = 2_000_000
#: Buckets with one anchor from which it is dealt further.
HOT = 64
#: Depth of the shallow sort, in bytes.
SHALLOW = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, by doubling."""
    step, width = data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        factor = np.uint64(pow(int(_ODD), width, 1 << 64))
        if size & width:
            out = step if out is None else out[: len(out) - width] * factor + step[done : done + len(out) - width]
            done += width
        if done == size:
            break
        step = step[: len(step) - width] * factor + step[width:]
        width *= 2
    out = out[: len(data) - size + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(text: bytes | np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first, stop) of each segment of documents that lie end to end.

    Its strings start at ``first`` to ``stop`` - 1, counted from the start of ``text``.
    """
    data = np.frombuffer(text, np.uint8)
    gram = min(GRAM, length)
    out: list[tuple] = []
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[at : at + PIECE + length - 1]
        anchor = sliding_min(gram_hashes(part, gram), length - gram + 1)
        start = np.arange(at, at + len(anchor))
        doc = np.searchsorted(ends, start, "right")
        good = start + length <= ends[doc]
        anchor, start, doc = anchor[good], start[good], doc[good]
        if not len(start):
            continue
        head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
        tail = np.append(head[1:], len(start)) - 1
        out.append((anchor[head], doc[head], start[head], start[tail] + 1))
    if not out:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def finer(data: np.ndarray, anchor: np.ndarray, first: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, key, first, stop) of the pieces of segments whose strings have the same bytes beside their anchor.

    The anchor is the leftmost one of a string, and the bytes are those of its longer side, so equal
    strings have equal keys.
    """
    gram = min(GRAM, length)
    side = (length - gram) // 2
    if not side or not len(first):
        return np.arange(len(first)), anchor, first, stop
    size = stop - first
    owner = np.repeat(np.arange(len(first)), size)
    start = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    grams, beside = gram_hashes(data, gram), gram_hashes(data, side)
    place, open_ = np.zeros(len(start), np.int64), np.arange(len(start))
    for offset in range(length - gram + 1):
        hit = grams[start[open_] + offset] == anchor[owner[open_]]
        place[open_[hit]] = start[open_[hit]] + offset
        open_ = open_[~hit]
    behind = place - start <= length - gram - side
    key = (beside[np.where(behind, place + gram, place - side)] ^ anchor[owner]) * _ODD + behind.astype(np.uint64)
    key ^= key >> np.uint64(29)
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
    tail = np.append(head[1:], len(key)) - 1
    return owner[head], key[head], start[head], start[tail] + 1


def part_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    return (((anchor * _ODD) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length by a blind trie.

    Inner nodes hold the place where their strings first differ and a child for each byte there.
    A string goes down blindly, meets one leaf, is compared with it once, and then branches off at
    the place of that first difference.
    """
    root: int | list = 0
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):
            node = node[1][s[node[0]]] if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = strings[node]
        depth = next(d for d in range(len(s)) if s[d] != other[d])
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = i
        else:
            new = [depth, {other[depth]: node, s[depth]: i}]
            if above is None:
                root = new
            else:
                above[1][s[above[0]]] = new
    order: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            order.append(node)
    return order


def deep_shallow(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` in the order of their first ``length`` bytes, and for each, in that
    order, the number of its class of equal strings."""
    n = len(starts)
    width = -(-length // 8) * 8
    view = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(width, np.uint8)), width)
    order, group = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # places in the order that are not alone in their group
    depth = 0
    while depth < shallow and len(tied):
        digit = np.ascontiguousarray(view[starts[order[tied]], depth : depth + 8]).view(">u8").ravel().astype(np.uint64)
        if depth + 8 > length:
            digit &= np.uint64((1 << 64) - (1 << (8 * (depth + 8 - length))))
        by = np.lexsort((digit, group[tied])) if depth else np.argsort(digit, kind="stable")
        order[tied] = order[tied[by]]
        g, digit = group[tied], digit[by]
        new = np.append(True, (g[1:] != g[:-1]) | (digit[1:] != digit[:-1]))
        head = np.flatnonzero(new)
        group[tied] = tied[head][np.cumsum(new) - 1]  # a group is named by the place of its first suffix
        size = np.diff(np.append(head, len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        depth += 8
    if len(tied) and depth < length:
        rest = np.ascontiguousarray(view[starts[order[tied]], depth:length])
        g = group[tied]
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        first = np.repeat(head, np.diff(np.append(head, len(g))))
        odd = (rest != rest[first]).any(axis=1)
        for h, stop in zip(head.tolist(), np.append(head[1:], len(g)).tolist()):
            if not odd[h:stop].any():
                continue
            members: dict[bytes, list[int]] = {}
            for k in range(h, stop):
                members.setdefault(rest[k].tobytes(), []).append(int(order[tied[k]]))
            strings = list(members)
            at = h
            for i in blind_trie_order(strings):
                same = members[strings[i]]
                order[tied[at : at + len(same)]] = same
                group[tied[at : at + len(same)]] = tied[at]
                at += len(same)
    return order, group


def pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(struct.pack("<cQ", a.dtype.char.encode(), a.nbytes) + a.tobytes() for a in arrays)
    return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], decompressed_size=struct.unpack("<Q", blob[:8])[0], codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(body):
        kind, size = struct.unpack_from("<cQ", body, at)
        out.append(np.frombuffer(body, np.dtype(kind.decode()), size // np.dtype(kind.decode()).itemsize, at + 9))
        at += 9 + size
    return out


def _texts(docs: pa.Table) -> tuple[list[int], list[bytes], np.ndarray]:
    """Ids, texts and text ends of a bucket, in an order that does not depend on the shuffle."""
    rows = sorted(zip(docs.column("_id").to_pylist(), docs.column("_text").cast(pa.binary()).to_pylist()))
    texts = [t for _, t in rows]
    return [i for i, _ in rows], texts, np.cumsum([len(t) for t in texts])


def _anchors_out(parts: int, length: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        _, texts, ends = _texts(docs)
        anchor = np.unique(segments(b"".join(texts), ends, length)[0])
        part = part_of(anchor, parts)
        order = np.argsort(part, kind="stable")
        anchor, part = anchor[order], part[order]
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, int)
        blobs = [pack(x) for x in np.split(anchor, head[1:])] if len(part) else []
        return pa.table({"part": pa.array(part[head], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _shared_back(hot: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        buckets = rows.column("bucket").to_pylist()
        lists = [unpack(b)[0] for b in rows.column("blob").to_pylist()]
        every, times = np.unique(np.concatenate(lists), return_counts=True)
        out = []
        for b, own in zip(buckets, lists):
            n = times[np.searchsorted(every, own)]
            if (n > 1).any():
                out.append((b, np.packbits(n > 1).tobytes() + np.packbits(n >= hot).tobytes()))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "part": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    return run


def _segments_out(parts: int, length: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "local": pa.array([], pa.bool_()), "blob": pa.array([], pa.binary())})
        if not docs.num_rows:
            return empty
        bucket = docs.column("bucket")[0].as_py()
        ids, texts, ends = _texts(docs)
        text = b"".join(texts)
        starts = ends - [len(t) for t in texts]
        anchor, doc, first, stop = segments(text, ends, length)
        if not len(anchor):
            return empty
        number = np.array(ids, np.int64)[doc]
        distinct, index = np.unique(anchor, return_inverse=True)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, index, number)
        np.maximum.at(high, index, number)
        wanted = low != high
        hot = np.zeros(len(distinct), bool)
        by_part = part_of(distinct, parts)
        order = np.argsort(by_part, kind="stable")
        edges = np.searchsorted(by_part[order], np.arange(parts + 1))
        for p, bits in zip(answers.column("part").to_pylist(), answers.column("blob").to_pylist()):
            own = order[edges[p] : edges[p + 1]]
            both = np.frombuffer(bits, np.uint8).reshape(2, -1)
            for mark, answer in ((wanted, both[0]), (hot, both[1])):
                mark[own[np.unpackbits(answer, count=len(own)).astype(bool)]] = True
        keep = np.flatnonzero(wanted[index])
        warm = keep[hot[index[keep]]]
        keep = keep[~hot[index[keep]]]
        own, key, begin, end = finer(np.frombuffer(text, np.uint8), anchor[warm], first[warm], stop[warm], length)
        anchor, doc, first, stop = (np.append(calm[keep], cut) for calm, cut in zip((anchor, doc, first, stop), (key, doc[warm][own], begin, end)))
        keep = np.argsort(first, kind="stable")
        number = np.array(ids, np.int64)[doc]
        # documents come by ascending id, so the first segment of a content is from its smallest
        owner: dict[bytes, int] = {}
        gone_doc, gone_first, gone_stop = [], [], []
        sent = []
        for k, d, a, b in zip(keep.tolist(), doc[keep].tolist(), first[keep].tolist(), (stop[keep] + length - 1).tolist()):
            had = owner.setdefault(text[a:b], k)
            if had == k or number[had] == number[k]:
                sent.append(k)
            else:
                gone_doc.append(d)
                gone_first.append(a - starts[d])
                gone_stop.append(b - starts[d])
        sent = np.array(sent, np.int64)
        part = part_of(anchor[sent], parts)
        order = np.argsort(part, kind="stable")
        sent, part = sent[order], part[order]
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, int)
        blobs = []
        for own in np.split(sent, head[1:]) if len(sent) else []:
            size = (stop[own] - first[own] + length - 1).astype(np.int32)
            body = np.frombuffer(b"".join([text[a : a + n] for a, n in zip(first[own].tolist(), size.tolist())]), np.uint8)
            blobs.append(pack(anchor[own], number[own], doc[own].astype(np.int32), (first[own] - starts[doc[own]]).astype(np.int32), size, body))
        where = part[head].tolist()
        local = [False] * len(blobs)
        if gone_doc:
            blobs.append(pack(np.array(gone_doc, np.int32), np.array(gone_first, np.int32), np.array(gone_stop, np.int32)))
            where.append(bucket % parts)
            local.append(True)
        return pa.table({"part": pa.array(where, pa.int32()), "bucket": pa.array([bucket] * len(blobs), pa.int32()), "local": pa.array(local, pa.bool_()), "blob": pa.array(blobs, pa.binary())})

    return run


def repeated_strings(body: np.ndarray, ends: np.ndarray, number: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, stop) of each span of ``body`` whose strings a smaller document has too."""
    begin = np.append(0, ends[:-1])
    count = ends - begin - length + 1
    seg = np.repeat(np.arange(len(ends)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[seg]
    order, group = deep_shallow(body, start, length)
    owner = number[seg[order]]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, int)
    least = np.minimum.reduceat(owner, head) if len(head) else owner
    later = owner > np.repeat(least, np.diff(np.append(head, len(group))))
    hit = np.sort(order[later])
    if not len(hit):
        return (np.empty(0, np.int64),) * 3
    s, at = seg[hit], start[hit]
    head = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (at[1:] != at[:-1] + 1)))
    tail = np.append(head[1:], len(hit)) - 1
    return s[head], at[head] - begin[s[head]], at[tail] - begin[s[head]] + length


def _spans_out(length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out: dict[int, list[tuple[np.ndarray, ...]]] = {}
        anchors, contents, numbers, docs, firsts, buckets = [], [], [], [], [], []
        for bucket, local, blob in zip(rows.column("bucket").to_pylist(), rows.column("local").to_pylist(), rows.column("blob").to_pylist()):
            if local:
                out.setdefault(bucket, []).append(tuple(unpack(blob)))
                continue
            anchor, number, doc, first, size, body = unpack(blob)
            cut = np.append(0, np.cumsum(size)).tolist()
            raw = body.tobytes()
            contents += [raw[a:b] for a, b in zip(cut, cut[1:])]
            anchors.append(anchor)
            numbers.append(number)
            docs.append(doc)
            firsts.append(first)
            buckets.append(np.full(len(size), bucket, np.int32))
        if anchors:
            anchor, number, doc, first, bucket = map(np.concatenate, (anchors, numbers, docs, firsts, buckets))
            size = np.array([len(c) for c in contents], np.int64)
            owner: dict[bytes, int] = {}
            whole = np.zeros(len(contents), bool)
            for k in np.argsort(number, kind="stable").tolist():
                had = owner.setdefault(contents[k], k)
                whole[k] = number[had] < number[k]
            found = [(np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64), size[whole])]
            rest = np.flatnonzero(~whole)
            rest = rest[np.argsort(anchor[rest], kind="stable")]
            head = np.flatnonzero(np.append(True, anchor[rest][1:] != anchor[rest][:-1])) if len(rest) else np.empty(0, int)
            n = np.diff(np.append(head, len(rest)))
            several = np.repeat(n > 1, n)
            rest = rest[several]
            # anchors are sorted together up to SORT strings
            strings = np.cumsum(size[rest] - length + 1)
            at = 0
            while at < len(rest):
                stop = max(at + 1, int(np.searchsorted(strings, (strings[at - 1] if at else 0) + SORT)))
                while stop < len(rest) and anchor[rest[stop]] == anchor[rest[stop - 1]]:
                    stop += 1
                own = rest[at:stop]
                body = np.frombuffer(b"".join([contents[k] for k in own.tolist()]), np.uint8)
                s, a, b = repeated_strings(body, np.cumsum(size[own]), number[own], length)
                found.append((own[s], a, b))
                at = stop
            k, a, b = map(np.concatenate, zip(*found))
            order = np.argsort(bucket[k], kind="stable")
            k, a, b = k[order], a[order], b[order]
            head = np.flatnonzero(np.append(True, bucket[k][1:] != bucket[k][:-1])) if len(k) else np.empty(0, int)
            for i, j in zip(head.tolist(), np.append(head[1:], len(k)).tolist()):
                own = k[i:j]
                out.setdefault(int(bucket[own[0]]), []).append((doc[own], first[own] + a[i:j].astype(np.int32), first[own] + b[i:j].astype(np.int32)))
        blobs = {b: pack(*map(np.concatenate, zip(*x))) for b, x in out.items()}
        return pa.table({"bucket": pa.array(list(blobs), pa.int32()), "blob": pa.array(list(blobs.values()), pa.binary())})

    return run


def _removed(id: str):
    def run(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        ids, texts, _ = _texts(docs)
        found = [unpack(b) for b in spans.column("blob").to_pylist()]
        doc, first, stop = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int32),) * 3
        order = np.lexsort((first, doc))
        doc, first, stop = doc[order], first[order], stop[order]
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        runs, kept = [], []
        for k, t in enumerate(texts):
            a, b = first[cut[k] : cut[k + 1]], stop[cut[k] : cut[k + 1]]
            if not len(a):
                runs.append([])
                kept.append(t)
                continue
            reach = np.maximum.accumulate(b)
            head = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
            a, b = a[head].tolist(), reach[np.append(head[1:], len(a)) - 1].tolist()
            runs.append([{"start": x, "stop": y} for x, y in zip(a, b)])
            kept.append(b"".join([t[x:y] for x, y in zip([0, *b], [*a, len(t)])]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({id: pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "removed": pa.array(runs, kind), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET, hot: int = HOT) -> DataFrame:
    """``id``, ``n_bytes``, ``removed`` (spans of bytes) and ``kept`` (the other bytes) for each row."""
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).where("_id is not null")
    total = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // bucket_bytes))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    own = dealt.groupBy("bucket")
    sent = own.applyInArrow(_anchors_out(parts, length), "part int, bucket int, blob binary")
    answers = sent.groupBy("part").applyInArrow(_shared_back(hot), "bucket int, part int, blob binary")
    found = own.cogroup(answers.groupBy("bucket")).applyInArrow(_segments_out(parts, length), "part int, bucket int, local boolean, blob binary")
    spans = found.groupBy("part").applyInArrow(_spans_out(length), "bucket int, blob binary")
    return own.cogroup(spans.groupBy("bucket")).applyInArrow(_removed(id), f"`{id}` long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 50 bytes, as counts and a digest."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
