"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units and names are typed placeholders, all other words their
lower-case form. A name is a capitalised word that does not begin a sentence; a unit is a known
word after a number, or a currency or percent sign. Words are runs of letters, and all characters
beyond ASCII are letters but for general, Latin-1 and CJK punctuation. Windows of five template words of documents and benchmark items meet in a hash
join. An item leaks into a document if at least 0.8 of its distinct windows stand there, and if
its slots are filled consistently: along one alignment, each value of the item stands for one value
of the document. That is any alignment which holds 0.8 of the windows by itself, or else the one
with most windows. So a question with other numbers or names is found, and a
mere likeness of phrasing with slots filled at random is not.

Whether a word is a name depends on what stands before it and on its case, so each item is also
looked for with its names as plain words; either form shows a leak. A verbatim passage set into
running text and a copy in lower case are found by the second form.

Only windows whose hash falls on a set bit of a bitmap of ``BITS`` bits leave the scan of the
documents. The bitmap has a fixed size; it spares work and never decides a match.

Items of fewer than five words are one window, their whole text; they leak where that stands with
just their own words and values.

Defined cases: null and empty texts have no words and never match; long texts are read whole;
repeated rows give their pair once; of alignments with equally many windows the one nearer to the
item's own place counts, and then the earlier one; an empty table on either side gives an empty result; extra columns are ignored in ``leaks``
and pass through ``clean``, also those named like ids or places here; rows with a null id are kept by ``clean`` and never match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import give_back, small_batches

WINDOW = 5
LEAST = 0.8
BITS = 1 << 24
#: Bytes of text read at once.
CHUNK = 400_000

UNITS = "mm cm m km g kg mg t l ml s sec min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year miles mile feet foot inches inch pounds pound ounces ounce dollars dollar cents cent euros euro percent mph kmh liters liter litres litre meters meter metres metre grams gram kilograms degrees".split()
WORD, NUMBER, UNIT, NAME, END = 0, 1, 2, 3, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)

# byte classes: 0 other, 1 letter, 2 digit, 3 end of a sentence, 4 symbol
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[list(b".!?:\n")] = 3
_CLASS[list(b"$%")] = 4


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(30))


def run_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; runs ascend and do not overlap."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = stop - start
    power = np.ones(int(size.max()) + 1, np.uint64)
    power[1:] = _ODD
    power = np.cumprod(power)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = (data[np.repeat(start, size) + offset].astype(np.uint64) + np.uint64(1)) * power[offset]
    return mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * _ODD)


_UNIT_HASHES = np.sort(run_hashes(np.frombuffer("".join(UNITS).encode(), np.uint8), np.cumsum([0, *map(len, UNITS[:-1])]), np.cumsum([*map(len, UNITS)])))


def lower_bytes(text: str) -> tuple[bytes, bytes]:
    """A text and its lower-case form, of the same length in bytes."""
    raw, low = text.encode(), text.lower().encode()
    if len(raw) != len(low):
        low = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text).encode()
    return raw, low


class Template:
    """The words of some texts: text number, template hash, slot kind, and place in ``low``.

    Without ``names`` a name is a word like others.
    """

    def __init__(self, texts: list[str], names: bool = True):
        pairs = [lower_bytes(t) for t in texts]
        raw, self.low = (b"".join([x + b"\n" for x in side]) for side in zip(*pairs))
        data, low = np.frombuffer(raw, np.uint8), np.frombuffer(self.low, np.uint8)
        ends = np.cumsum([len(r) + 1 for r, _ in pairs])
        kind = _CLASS[data]
        lead = np.flatnonzero(data >= 0xC2)
        lead = lead[lead + 2 < len(data)]
        first, second = data[lead], data[lead + 1]
        for at, size in ((lead[first == 0xC2], 2), (lead[(first == 0xE2) & ((second == 0x80) | (second == 0x81))], 3), (lead[(first == 0xE3) & (second == 0x80)], 3)):
            for k in range(size):
                kind[at + k] = 0
        kind[lead[(first == 0xC2) & (second == 0xA3)]] = 4  # pound sign
        euro = lead[(first == 0xE2) & (second == 0x82) & (data[lead + 2] == 0xAC)]
        kind[euro], kind[euro + 1], kind[euro + 2] = 4, 0, 0
        joint = np.flatnonzero((data == 44) | (data == 46))
        joint = joint[(joint > 0) & (joint + 1 < len(data))]
        kind[joint[(kind[joint - 1] == 2) & (kind[joint + 1] == 2)]] = 2
        begin = (kind > 0) & np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] > 2))
        start = np.flatnonzero(begin)
        change = np.flatnonzero(np.append(kind[1:] != kind[:-1], True) | (kind > 2)) + 1
        stop = change[np.searchsorted(change, start, "right")] if len(start) else start
        of = kind[start]
        hashes = run_hashes(low, start, stop)
        found = np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)
        before = np.append(3, of[:-1])[: len(of)]
        size = stop - start
        slot = np.zeros(len(start), np.int8)
        slot[(of == 1) & (data[start] != low[start]) & (before != 3) & (size > 1)] = NAME
        wide = (data[start] >= 0xC2) & (start + 1 < len(data))  # a letter of two bytes differs in its second
        slot[wide & (of == 1) & (data[np.minimum(start + 1, len(data) - 1)] != low[np.minimum(start + 1, len(data) - 1)]) & (before != 3)] = NAME
        slot[(of == 4) | ((_UNIT_HASHES[found] == hashes) & (before == 2) & (of == 1))] = UNIT
        slot[of == 2] = NUMBER
        if not names:
            slot[slot == NAME] = WORD
        word = of != 3
        self.start, self.stop, self.slot = start[word], stop[word], slot[word]
        self.hash = np.where(self.slot == WORD, hashes[word], self.slot.astype(np.uint64))
        self.text = np.searchsorted(ends, self.start, "right")

    def value(self, word: int) -> str:
        """What fills a slot, led by its kind, so values of different kinds never mix."""
        return f"{self.slot[word]}{self.low[self.start[word] : self.stop[word]].decode('utf-8', 'replace')}"


def windows(template: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A hash of each run of ``size`` template words."""
    if len(template) < size:
        return np.empty(0, np.uint64)
    out = template[: len(template) - size + 1].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * _ODD + template[k : len(template) - size + 1 + k]
    return mixed(out)


def template_windows(rows: DataFrame, id: str, text: str, size: int = WINDOW, bitmap: Broadcast | None = None, names: bool = True) -> DataFrame:
    """(id, place, window, slots, total): each window, the values in its slots, and the distinct windows of its text.

    With a bitmap only windows on its set bits come, and ``total`` is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").astype(bool) if bitmap is not None else None
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at = 0
            while at < batch.num_rows:
                part, chars = [], 0
                while at + len(part) < batch.num_rows and (not part or chars < CHUNK):
                    part.append(texts[at + len(part)].as_py() or "")
                    chars += len(part[-1])
                t = Template(part, names)
                found = windows(t.hash, size)
                own = t.text[: len(found)]
                whole = own == t.text[size - 1 :] if len(found) else np.zeros(0, bool)
                hit = np.flatnonzero(whole & bits[found & np.uint64(BITS - 1)] if bits is not None else whole)
                first = np.searchsorted(t.text, np.arange(len(part)))
                total = None
                if bits is None:
                    pairs = np.unique(np.stack([own[hit].astype(np.uint64), found[hit]]), axis=1)[0].astype(np.int64)
                    total = pa.array(np.bincount(pairs, minlength=len(part))[own[hit]], pa.int32())
                slots = [[t.value(p) for p in range(h, h + size) if t.slot[p]] for h in hit.tolist()]
                columns = [pa.array(ids[at + own[hit]], pa.int64()), pa.array(hit - first[own[hit]], pa.int32()), pa.array(found[hit].view(np.int64)), pa.array(slots, pa.list_(pa.string())), pa.nulls(len(hit), pa.int32()) if total is None else total]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "place", "window", "slots", "total"])
                at += len(part)
        del bits
        give_back()

    small_batches(rows.sparkSession)
    picked = rows.select(F.col(id).cast("long").alias(id), F.col(text).cast("string").alias("_text")).where(F.col(id).isNotNull())
    return picked.mapInArrow(run, f"`{id}` long, place int, window long, slots array<string>, total int")


def bitmap_of(found: DataFrame) -> bytes:
    """Bits of all windows; Spark makes the bitmap, and at most ``BITS`` bits reach the driver."""
    bits = np.zeros(BITS // 8, np.uint8)
    place = F.col("window").bitwiseAND(BITS - 1) + 1
    for r in found.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        part = np.frombuffer(r.bits, np.uint8)
        bits[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return bits.tobytes()


def short_items(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, text, words) of the items of fewer than ``size`` words, but for those without any."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.bincount(Template([t or "" for t in texts.to_pylist()]).text, minlength=len(texts)), pa.int32())

    rows = items.select(F.col(item).cast("long").alias(item), F.col(text).cast("string").alias("_text")).where(F.col(item).isNotNull())
    return rows.withColumn("words", F.arrow_udf(run, "int")("_text")).where(F.col("words").between(1, size - 1))


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(id, item, contained, exact): items that leak into a document; ``exact`` if all slots hold the item's own values."""
    forms = [leaks_of_form(docs, items, id, text, item, item_text, size, least, names) for names in (True, False)]
    short = short_items(items, item, item_text, size)
    for words in sorted(r.words for r in short.select("words").distinct().collect()):
        forms.append(leaks_of_form(docs, short.where(F.col("words") == words), id, text, item, "_text", words, 1.0, False).where("exact"))
    found = forms[0]
    for form in forms[1:]:
        found = found.unionByName(form)
    return found.groupBy(id, item).agg(F.max("contained").alias("contained"), F.max("exact").alias("exact"))


def leaks_of_form(docs: DataFrame, items: DataFrame, id: str, text: str, item: str, item_text: str, size: int, least: float, names: bool) -> DataFrame:
    """``leaks`` by windows of one form: names as slots, or as plain words."""
    wanted = template_windows(items, item, item_text, size, names=names)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted))
    have = template_windows(docs, id, text, size, sent, names).select(id, F.col("place").alias("at"), "window", F.col("slots").alias("own"))
    met = have.join(wanted, "window")
    pairs = F.arrays_zip(F.col("slots").alias("a"), F.col("own").alias("b"))
    lines = met.groupBy(id, item, "total", (F.col("at") - F.col("place")).alias("line")).agg(F.collect_set("window").alias("found"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    lines = lines.withColumn("consistent", F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p.a))))
    # a copy that is consistent and long enough by itself shows the leak, whatever else the document holds
    alone = F.col("consistent") & (F.size("found") / F.col("total") >= least)
    best = F.struct(alone, F.size("found"), -F.abs("line"), "line")
    both = lines.groupBy(id, item, "total").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"), F.max_by(F.struct("pairs", "consistent"), best).alias("best"))
    both = both.select(id, item, "total", "found", "best.*")
    contained = F.size("found") / F.col("total")
    exact = F.forall("pairs", lambda p: p.a == p.b)
    if not names:
        exact = exact & (contained == 1)  # a name that differs is seen only as a missing window
    return both.where((contained >= least) & F.col("consistent")).groupBy(id, item).agg(F.max(contained).alias("contained"), F.max(exact).alias("exact"))


def clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that an item leaks into."""
    return docs.join(leaks(docs, items, id=id, **options).select(id).distinct(), id, "left_anti").select(docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that leaks into it."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
