"""Token counts that follow edits without encoding a document again.

A document's pre-tokens are dealt into leaves of ``LEAF``; a segment tree over the leaves holds
sums of characters and tokens (heap order: node 1 is the root, node i has the children 2 i and
2 i + 1). An edit finds its leaves by going down the tree, cuts the text into pre-tokens again from
one leaf before the edit until a boundary of an old leaf behind the edit is met, encodes those
pre-tokens, and updates the sums from the touched leaves to the root.

Defined cases: a null text counts as empty, with no token and one empty leaf; an edit that is
null in any column changes nothing; bounds beyond the text are cut to it; very long texts have
many leaves; an edit at the bound of two leaves belongs to the left one; rows with a null id are
counted like others; repeated rows are counted alike; an empty table gives an empty table; extra
columns pass through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import CHUNK, PART, Counter, Vocabulary, encoder_of, parts, send_vocabulary
from quern.llm.common import give_back

LEAF = 32


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order over the leaves, padded to a power of two; node 0 is unused."""
    width = 1 << max(0, len(leaves) - 1).bit_length()
    tree = np.zeros(2 * width, np.int32)
    tree[width : width + len(leaves)] = leaves
    while width > 1:
        half = width // 2
        tree[half:width] = tree[width : 2 * width : 2] + tree[width + 1 : 2 * width : 2]
        width = half
    return tree


def leaf_at(chars: np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that holds character ``place`` and the character at which it starts."""
    node, start, width = 1, 0, len(chars) // 2
    while node < width:
        node *= 2
        if place >= start + chars[node]:
            start += int(chars[node])
            node += 1
    return node - width, start


def sums(words: list[str], counts: list[int], cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the words between consecutive ``cuts``."""
    spans = list(zip(cuts, cuts[1:]))
    return np.array([len("".join(words[a:b])) for a, b in spans], np.int32), np.array([sum(counts[a:b]) for a, b in spans], np.int32)


def cuts_of(words: list[str]) -> list[int]:
    """Where leaves of ``LEAF`` pre-tokens begin and end; at least one leaf."""
    return [*range(0, max(1, len(words)), LEAF), len(words)]


def update(tree: np.ndarray, leaf: int, values: np.ndarray) -> None:
    """Put ``values`` on the leaves from ``leaf`` on and renew the sums above them."""
    width = len(tree) // 2
    low, high = width + leaf, width + leaf + len(values) - 1
    tree[low : high + 1] = values
    while low > 1:
        low, high = low // 2, high // 2
        for node in range(low, high + 1):
            tree[node] = tree[2 * node] + tree[2 * node + 1]


def build(encoder: Counter, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trees of characters and tokens of each text."""
    out = []
    at = 0
    while at < len(texts):
        pieces, chars = [], 0
        while at < len(texts) and (not pieces or chars < CHUNK):
            pieces.append(encoder.vocabulary.pieces(texts[at]))
            chars += len(texts[at])
            at += 1
        for words, counts in zip(pieces, encoder.look_up(pieces)):
            out.append(tuple(map(tree_of, sums(words, counts, cuts_of(words)))))
    return out


def touched(vocabulary: Vocabulary, text: str, chars: np.ndarray, start: int, stop: int, put_in: str) -> tuple[str, int, int, list[str]]:
    """The edited text, the leaves [first, last) that the edit touches, and the pre-tokens that take their place."""
    n = len(text)
    start = min(max(start, 0), n)
    stop = min(max(stop, start), n)
    edited = text[:start] + put_in + text[stop:]
    shift = len(put_in) - (stop - start)
    width = len(chars) // 2
    if any(s in text or s in edited for s in vocabulary.specials):  # special tokens reach over pre-tokens
        return edited, 0, width, vocabulary.pieces(edited)
    first, begin = leaf_at(chars, max(0, start - 1))
    if first:
        first -= 1
        begin -= int(chars[width + first])
    last, end = leaf_at(chars, max(0, stop - 1))
    end += int(chars[width + last])
    last += 1
    words = []
    for m in vocabulary.words.finditer(edited, begin):
        words.append(m[0])
        while last < width and end + shift < m.end():
            end += int(chars[width + last])
            last += 1
        if m.end() == end + shift and end >= stop:
            return edited, first, last, words
    return edited, first, width, words


def replaced(tree: np.ndarray, first: int, last: int, values: np.ndarray) -> np.ndarray:
    """The tree with ``values`` in place of the leaves [first, last)."""
    width = len(tree) // 2
    if len(values) == last - first:
        tree = tree.copy()
        update(tree, first, values)
        return tree
    return tree_of(np.concatenate([tree[width : width + first], values, tree[width + last :]]))


def edit(encoder: Counter, rows: list[tuple[str, np.ndarray, np.ndarray, int, int, str]]) -> list[tuple[str, np.ndarray, np.ndarray, int]]:
    """For each (text, characters, tokens, start, stop, put_in) the edited text, its trees, and how many
    characters were cut into pre-tokens again. The new words of all rows are merged together."""
    plans = [touched(encoder.vocabulary, text, chars, a, b, p) for text, chars, _, a, b, p in rows]
    out = []
    for (_, chars, tokens, *_), (edited, first, last, words), counts in zip(rows, plans, encoder.look_up([w for *_, w in plans])):
        # the leaves keep their number, so that only sums above them change, unless they would grow too long
        grown = len(words) > 4 * LEAF * (last - first)
        cuts = cuts_of(words) if grown else np.linspace(0, len(words), last - first + 1).astype(np.int64).tolist()
        new_chars, new_tokens = sums(words, counts, cuts)
        out.append((edited, replaced(chars, first, last, new_chars), replaced(tokens, first, last, new_tokens), int(new_chars.sum())))
    return out


_NAMES = ["n_tokens", "char_tree", "token_tree", "reread_chars"]


def _lists(trees: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, trees)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(trees or [np.zeros(0)]).astype(np.int32)))


_COUNTED = "n_tokens long, char_tree array<int>, token_tree array<int>"


def counted_texts(encoder: Counter, texts: list[str]) -> list[pa.Array]:
    """``n_tokens``, ``char_tree`` and ``token_tree`` of each text."""
    trees = build(encoder, texts)
    return [pa.array([int(t[1]) for _, t in trees], pa.int64()), _lists([c for c, _ in trees]), _lists([t for _, t in trees])]


def edited_texts(encoder: Counter, rows: list[tuple]) -> list[pa.Array]:
    """The text, counts, trees and ``reread_chars`` of rows (text, characters, tokens, start, stop, put_in) after their edits."""
    changed = iter(edit(encoder, [(t or "", *rest) for t, *rest in rows if all(x is not None for x in rest[2:])]))
    # a null edit leaves a null text null
    done = [(t, chars, tokens, 0) if any(x is None for x in edits) else next(changed) for t, chars, tokens, *edits in rows]
    texts, chars, tokens, read = zip(*done) if done else ((), (), (), ())
    return [pa.array(texts, pa.string()), pa.array([int(k[1]) for k in tokens], pa.int64()), _lists(chars), _lists(tokens), pa.array(read, pa.int64())]


def rows_of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    """The same rows in smaller arrays."""
    return (tuple(c.slice(at, PART) for c in batch) for batch in batches for at in range(0, len(batch[0]), PART))


def _trees(lists: pa.ListArray) -> list[np.ndarray]:
    return np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []


def count(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add ``n_tokens`` and the trees ``char_tree`` and ``token_tree``."""
    sent = send_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(sent, Counter)
        for texts in parts(batches):
            yield pa.StructArray.from_arrays(counted_texts(encoder, texts.to_pylist()), names=_NAMES[:3])
        del encoder
        give_back()

    found = F.arrow_udf(run, _COUNTED).asNondeterministic()(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.withColumn("_found", found).withColumns({n: F.col(f"_found.{n}") for n in _NAMES[:3]}).drop("_found")


def apply_edits(counted: DataFrame, text: str = "text", start: str = "start", stop: str = "stop", put_in: str = "put_in", vocabulary: str | None = None) -> DataFrame:
    """Apply one edit per row of ``counted``: renew text, trees and ``n_tokens``, and add ``reread_chars``."""
    sent = send_vocabulary(counted.sparkSession, vocabulary)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        encoder = encoder_of(sent, Counter)
        for texts, chars, tokens, *edits in rows_of(batches):
            rows = list(zip(texts.to_pylist(), _trees(chars), _trees(tokens), *(e.to_pylist() for e in edits)))
            yield pa.StructArray.from_arrays(edited_texts(encoder, rows), names=["text", *_NAMES])
        del encoder
        give_back()

    found = F.arrow_udf(run, f"text string, {_COUNTED}, reread_chars long").asNondeterministic()(F.col(text).cast("string"), "char_tree", "token_tree", F.col(start).cast("int"), F.col(stop).cast("int"), F.col(put_in).cast("string"))
    return counted.withColumn("_found", found).withColumns({text: F.col("_found.text")} | {n: F.col(f"_found.{n}") for n in _NAMES}).drop("_found")


def count_and_edit(docs: DataFrame, text: str = "text", start: str = "start", stop: str = "stop", put_in: str = "put_in", vocabulary: str | None = None) -> DataFrame:
    """``count`` and then ``apply_edits`` in one passage through Python; the count before is ``tokens_before``."""
    sent = send_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        encoder = encoder_of(sent, Counter)
        for texts, *edits in rows_of(batches):
            texts = texts.to_pylist()
            before, chars, tokens = counted_texts(encoder, [t or "" for t in texts])
            rows = list(zip(texts, _trees(chars), _trees(tokens), *(e.to_pylist() for e in edits)))
            yield pa.StructArray.from_arrays([before, *edited_texts(encoder, rows)], names=["tokens_before", "text", *_NAMES])
        del encoder
        give_back()

    found = F.arrow_udf(run, f"tokens_before long, text string, {_COUNTED}, reread_chars long").asNondeterministic()(F.col(text).cast("string"), F.col(start).cast("int"), F.col(stop).cast("int"), F.col(put_in).cast("string"))
    return docs.withColumn("_found", found).withColumns({text: F.col("_found.text")} | {n: F.col(f"_found.{n}") for n in ("tokens_before", *_NAMES)}).drop("_found")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and again after an edit in its middle: up to 40 characters are turned round and marked."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    start = F.floor(n / 3).cast("int")
    stop = F.least(n, start + 40)
    piece = F.substring("text", start + 1, stop - start)
    edits = docs.select("*", start.alias("start"), stop.alias("stop"), F.concat(F.reverse(piece), F.lit(" (edited)")).alias("put_in"))
    return count_and_edit(edits).select("doc_id", F.col("tokens_before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), F.length("text").cast("long").alias("edited_chars"), "reread_chars")
