"""Byte-pair encoding and decoding with a pair occurrence index.

The words that a task meets for the first time are merged together. Their symbols lie in one
array; an index maps the rank of each mergeable pair to all its positions. The active ranks
leave a heap in ascending order, all occurrences of a rank are merged at once, and the pairs
that arise beside them are added to the lists of their ranks.

Only the text goes to Python, and only ids and decoded text come back; all else stays in Spark.

Defined cases: null and empty texts have no tokens and decode to an empty text, and so do null
lists of ids; very long texts are encoded whole; a special token written in a text is one token,
as the vocabulary file says; of overlapping pairs the left one is merged first; repeated rows are
encoded alike; an empty table gives an empty table; extra columns pass through, and a column that
has the name of an output is replaced.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import give_back, small_batches

#: The pattern that splits text before merges (fixed value of byte-level vocabularies).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text whose words are merged together.
CHUNK = 4_000_000
#: Words of one generation of an encoder's memory, and their characters.
REMEMBER, REMEMBER_CHARS = 120_000, 2_400_000
#: Texts that a task encodes and hands back at once.
PART = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class Vocabulary:
    """Ranks, bytes and special tokens of a byte-level vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("this is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        of_letter = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.byte_table = pa.array(self.bytes_of, pa.large_binary())
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = self.left.astype(np.int64) * self.size + self.right
        order = np.argsort(key, kind="stable")
        self._keys, self._ranks = key[order], order
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.words = regex.compile(PRE_TOKEN)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens in order."""
        if self.cut is None or not any(s in text for s in self.specials):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.specials else self.words.findall(part)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each non-empty word, as bytes of 32-bit numbers."""
        ends = np.cumsum([len(w) for w in words])
        n = int(ends[-1]) if words else 0
        if not n:
            return []
        sym = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], -2)
        nxt = np.arange(1, n + 2)
        nxt[ends - 1] = n
        prv = np.arange(-1, n)
        prv[np.append(0, ends[:-1])] = n
        prv = np.append(prv, n)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            live = rank >= 0
            if not live.any():
                return
            rank, at = rank[live], at[live]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for r, part in zip(rank[first].tolist(), np.split(at, first[1:])):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        start = np.flatnonzero(nxt[:n] < n)
        add(start)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            a, b = self.left[r], self.right[r]
            to = nxt[at]
            good = (sym[at] == a) & (sym[to] == b)
            at, to = at[good], to[good]
            if a == b and len(at) > 1:  # of overlapping pairs every other one, from the left
                head = np.append(True, at[1:] != to[:-1])
                run = np.flatnonzero(head)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at, to = at[place % 2 == 0], to[place % 2 == 0]
            if not len(at):
                continue
            sym[at], sym[to] = self.merged[r], -1
            after = nxt[to]
            nxt[at] = after
            inner = after < n
            prv[after[inner]] = at[inner]
            before = prv[at]
            add(np.unique(np.concatenate([before[before < n], at[inner]])))
        alive = np.flatnonzero(sym[:n] >= 0)
        ids = sym[alive].astype(np.int32).tobytes()
        cuts = (4 * np.searchsorted(alive, ends)).tolist()
        return [ids[i:j] for i, j in zip([0, *cuts[:-1]], cuts)]


class Encoder:
    """Encodes texts and remembers the words it has merged, as the bytes of their ids.

    The memory has two generations, each bounded in words and characters. When the young one is full
    it becomes the old one; words that are met again come back from there without being merged.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.fixed = dict(zip(vocabulary.specials, self.kept([array("i", [i]).tobytes() for i in vocabulary.specials.values()])))
        self.known, self.old, self.chars = dict(self.fixed), {}, 0

    def kept(self, ids: list[bytes]) -> list:
        """What is remembered of words with these ids."""
        return ids

    def learn(self, words: set[str]) -> None:
        """Remember words that are not known yet."""
        chars = sum(map(len, words))
        if len(self.known) + len(words) > REMEMBER or self.chars + chars > REMEMBER_CHARS:
            self.known, self.old, self.chars = dict(self.fixed), self.known, 0
        self.chars += chars
        new = []
        for w in words:
            if w in self.old:
                self.known[w] = self.old[w]
            elif w not in self.known:
                new.append(w)
        self.known.update(zip(new, self.kept(self.vocabulary.merge([w.encode() for w in new]))))

    def look_up(self, texts: list[list[str]]) -> list[list]:
        """What is remembered of each word of each text; each word is looked up once, and once more if it was new."""
        get, gaps, new = self.known.get, [], set()
        found = [list(map(get, words)) for words in texts]
        for words, ids in zip(texts, found):
            gaps.append([i for i, x in enumerate(ids) if x is None] if None in ids else [])
            new.update([words[i] for i in gaps[-1]])
        if new:
            self.learn(new)
            for words, ids, gap in zip(texts, found, gaps):
                for i in gap:
                    ids[i] = self.known[words[i]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The token ids of each text, as bytes of 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            pieces, chars = [], 0
            while at < len(texts) and (not pieces or chars < CHUNK):
                pieces.append(self.vocabulary.pieces(texts[at]))
                chars += len(texts[at])
                at += 1
            out += map(b"".join, self.look_up(pieces))
        return out


class Counter(Encoder):
    """Like an encoder, but it remembers only how many tokens a word has."""

    def kept(self, ids: list[bytes]) -> list:
        return [len(x) >> 2 for x in ids]


def encoder_of(sent: Broadcast, kind: type[Encoder] = Encoder) -> Encoder:
    """An encoder of a broadcast vocabulary; its words are forgotten when the task ends."""
    return kind(Vocabulary(sent.value))


def send_vocabulary(spark, path: str | None = None) -> Broadcast:
    """Broadcast a vocabulary file; its size does not depend on the data."""
    small_batches(spark)
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    """The token ids of each text of an Arrow column without nulls."""
    found = encoder.encode(texts.to_pylist())
    offsets = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))


def decoded(vocabulary: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
    pieces = vocabulary.byte_table.take(ids.flatten())
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    whole = pieces.buffers()[2].to_pybytes() if len(pieces) else b""
    places = ends[np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))].tolist()
    return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(places, places[1:])], pa.string())


def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same rows in smaller arrays."""
    return (batch.slice(at, PART) for batch in batches for at in range(0, len(batch), PART))


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` as ``ids`` (array of int)."""
    sent = send_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(sent)
        for texts in parts(batches):
            yield encoded(encoder, texts)
        del encoder
        give_back()

    return docs.withColumn(ids, F.arrow_udf(run, "array<int>").asNondeterministic()(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def decode(tokens: DataFrame, ids: str = "token_ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add the text of ``ids`` as ``text``; bytes that are no UTF-8 become U+FFFD."""
    sent = send_vocabulary(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = encoder_of(sent).vocabulary
        for lists in parts(batches):
            yield decoded(vocabulary, lists)
        del vocabulary
        give_back()

    return tokens.withColumn(text, F.arrow_udf(run, "string").asNondeterministic()(ids))


def round_trip(docs: DataFrame, text: str = "text", ids: str = "token_ids", back: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one passage through Python: adds ``ids`` and ``back``."""
    sent = send_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(sent)
        lists = None
        for texts in parts(batches):
            lists = encoded(encoder, texts)
            yield pa.StructArray.from_arrays([lists, decoded(encoder.vocabulary, lists)], names=["ids", "back"])
        del encoder, lists
        give_back()

    both = F.arrow_udf(run, "ids array<int>, back string").asNondeterministic()(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.withColumn("_both", both).withColumns({ids: F.col("_both.ids"), back: F.col("_both.back")}).drop("_both")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again, as digests."""
    both = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
