"""Language identification by word-first backoff.

A model holds, for each language, log frequencies of known words and of character n-grams. A word
that the model knows adds its log frequency in each language; an unseen word is cut, from the
left, into the longest n-grams that the model knows, down to single letters. Copies of a text
count once in training, so that a text copied often does not outvote others.

Training reads a bounded sample: ``sample`` labelled rows per language at most in expectation,
drawn by a hash of the id. The model keeps each language's ``words`` and ``grams`` most frequent
entries, and of every kept entry the counts in just those languages where it stands, so what is
sent to the tasks grows in proportion to the languages and not with the rows.

Defined cases: a null text, an empty one and one without a letter are ``und`` with score 0; long
texts are read whole; rows without a language label are predicted but not learned from; rows with
a null id are predicted and learned from like others, and ``held_out`` is null for them; ties go
to the language that comes first by name, and of equally frequent entries the one that comes first
is kept; without any labelled row all texts are ``und``; repeated rows have the same prediction; an
empty table gives an empty table; extra columns pass through, and a column that has the name of an
output is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.bpe import parts
from quern.llm.common import give_back, small_batches, written

UNKNOWN = "und"
#: Labelled rows per language that training draws, in expectation.
SAMPLE = 4_000
#: Entries of the model per language.
WORDS = 25_000
GRAMS = 15_000
LONGEST = 5
#: Words that score a text fully; fewer words give a less certain score.
CERTAIN = 8
#: A word of letters, in Python and in Spark.
LETTERS = regex.compile(r"\p{L}+")
#: Unseen words that a task remembers at most.
REMEMBER = 150_000


def held_out(id: str = "doc_id") -> Column:
    """Rows that are kept out of training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(id).cast("string")) % 3 == 1


def training_sample(docs: DataFrame, id: str, lang: str, sample: int) -> DataFrame:
    """About ``sample`` rows per language; which ones depends on a hash of the id alone."""
    sizes = docs.groupBy(lang).agg(F.count(F.lit(1)).alias("_rows"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), id), F.lit(1 << 30))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("_rows")) * (1 << 30)
    # one row per language, of which the model itself has tens of thousands of entries
    return docs.join(F.broadcast(sizes), lang).where(draw < share).drop("_rows")


class Model:
    """Log frequencies of words and n-grams above a language's ``floor``.

    Entry ``i`` has its values at ``start[i]`` to ``start[i + 1]`` of ``lang`` and ``gain``: the
    language's number, and the log frequency less the floor. ``lang`` ascends within an entry.
    """

    def __init__(self, languages: list[str], words: list[str], grams: list[str], start: np.ndarray, lang: np.ndarray, gain: np.ndarray, floor: np.ndarray):
        self.languages, self.words, self.grams, self.start, self.lang, self.gain, self.floor = languages, words, grams, start, lang, gain, floor
        self.word_row = {w: i for i, w in enumerate(words)}
        self.gram_row = {g: len(words) + i for i, g in enumerate(grams)}

    def parts(self) -> tuple:
        return self.languages, self.words, self.grams, self.start, self.lang, self.gain, self.floor

    def entry(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The languages that have an entry, and by how much it is above their floors."""
        a, b = self.start[row], self.start[row + 1]
        return self.lang[a:b], self.gain[a:b]

    def pieces(self, word: str) -> tuple[list[int], int]:
        """The rows of a word's longest known n-grams, from the left, and how many pieces it has in all."""
        padded, at, n = f"^{word}$", 0, 0
        rows = []
        while at < len(padded):
            for size in range(min(LONGEST, len(padded) - at), 0, -1):
                row = self.gram_row.get(padded[at : at + size])
                if row is not None or size == 1:
                    if row is not None:
                        rows.append(row)
                    n += 1
                    at += size
                    break
        return rows, n

    def backoff(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Languages and gains of words that are not known, the mean over their pieces, and how many each has."""
        found = [self.pieces(w) for w in words]
        rows = np.fromiter((r for x, _ in found for r in x), np.int64)
        size = self.start[rows + 1] - self.start[rows]
        at = np.arange(int(size.sum())) + np.repeat(self.start[rows] - np.cumsum(size) + size, size)
        owner = np.repeat(np.repeat(np.arange(len(words)), [len(x) for x, _ in found]), size)
        key, place = np.unique(owner * len(self.languages) + self.lang[at], return_inverse=True)
        owner = key // len(self.languages)
        gain = np.bincount(place, self.gain[at], len(key)) / np.array([n for _, n in found], float)[owner]
        return (key % len(self.languages)).astype(np.int32), gain, np.bincount(owner, minlength=len(words))


class Scores:
    """Gains of words: those of the model, and a memory of unseen words that is bounded in words and in gains."""

    def __init__(self, model: Model):
        self.model = model
        words = len(model.words)
        self.start = np.append(model.start[: words + 1], np.zeros(REMEMBER, np.int64))
        held = int(self.start[words])
        self.lang = np.append(model.lang[:held], np.zeros(8 * REMEMBER, np.int32))
        self.gain = np.append(model.gain[:held], np.zeros(8 * REMEMBER))
        self.forget()

    def forget(self) -> None:
        self.row = dict(self.model.word_row)

    def learn(self, words: list[str]) -> bool:
        """Remember new words; False if they are more than there is room for, and then nothing is remembered."""
        n, used = len(self.row), int(self.start[len(self.row)])
        if n + len(words) >= len(self.start):
            return False
        lang, gain, size = self.model.backoff(words)
        if used + len(lang) > len(self.lang):
            return False
        self.start[n + 1 : n + 1 + len(words)] = used + np.cumsum(size)
        self.lang[used : used + len(lang)], self.gain[used : used + len(lang)] = lang, gain
        self.row.update(zip(words, range(n, n + len(words))))
        return True

    def learn_all(self, texts: list[Counter]) -> None:
        """Make room for the new words of ``texts`` and remember them as far as there is room."""
        new = lambda: list({w for words in texts for w in words if w not in self.row})
        if not self.learn(new()):
            self.forget()
            self.learn(new())

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Languages and gains of the words, and how many each has."""
        row = np.fromiter((self.row.get(w, -1) for w in words), np.int64, len(words))
        known = row >= 0
        if not known.all():  # more new words than there is room for: these stay unremembered
            a, b = self.of([w for w, k in zip(words, known) if k]), self.model.backoff([w for w, k in zip(words, known) if not k])
            order = np.argsort(np.append(np.flatnonzero(known).repeat(a[2]), np.flatnonzero(~known).repeat(b[2])), kind="stable")
            size = np.zeros(len(words), np.int64)
            size[known], size[~known] = a[2], b[2]
            return np.append(a[0], b[0])[order], np.append(a[1], b[1])[order], size
        size = self.start[row + 1] - self.start[row]
        at = np.arange(int(size.sum())) + np.repeat(self.start[row] - np.cumsum(size) + size, size)
        return self.lang[at], self.gain[at], size

    def text(self, words: Counter) -> tuple[str, float]:
        """The language of a text's words and a score from 0 to 1."""
        model = self.model
        if not words or not model.languages:
            return UNKNOWN, 0.0
        n = np.fromiter(words.values(), float, len(words))
        lang, gain, size = self.of(list(words))
        total = np.bincount(lang, gain * np.repeat(n, size), len(model.languages)) + n.sum() * model.floor
        # the posterior of an average word, sharpened by the number of words up to CERTAIN
        shown = total / n.sum() * min(n.sum(), CERTAIN)
        odds = np.exp(shown - shown.max())
        best = int(np.argmax(total))
        return model.languages[best], float(odds[best] / odds.sum())


def top_entries(counts: DataFrame, bound: int) -> DataFrame:
    """(entry, lang, n) of the entries that are among the ``bound`` most frequent of some language."""
    own = Window.partitionBy("lang").orderBy(F.desc("n"), "entry")
    # ranks within blocks first, so that no task sorts all entries of a language
    block = Window.partitionBy("lang", F.pmod(F.xxhash64("entry"), F.lit(64))).orderBy(F.desc("n"), "entry")
    few = counts.withColumn("_r", F.row_number().over(block)).where(F.col("_r") <= bound).drop("_r")
    kept = few.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= bound).select("entry").distinct()
    return counts.join(kept, "entry").select("entry", "lang", "n")


def grams_of(word: Column) -> Column:
    """The distinct pieces of at most ``LONGEST`` characters of a word between ``^`` and ``$``."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    # an array of one binds the padded word once
    cut = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(p))), lambda k: F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substring(p, i, k))))
    return F.array_distinct(F.get(F.transform(F.array(padded), cut), F.lit(0)))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Fit a model on the labelled rows of ``docs``."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    drawn = training_sample(rows, "id", "lang", sample).dropDuplicates(["lang", "text"])
    tokens = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("entry"))
    counts = written(tokens.groupBy("lang", "entry").agg(F.count(F.lit(1)).alias("n")))
    gram_counts = written(counts.select("lang", "n", F.explode(grams_of(F.col("entry"))).alias("entry")).groupBy("lang", "entry").agg(F.sum("n").alias("n")))

    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    number = {x: i for i, x in enumerate(languages)}
    floor = np.log(0.1 / (np.array([sizes[x] for x in languages], float) + 1))

    names, start, lang_of, gain_of = [], [0], [], []
    for table, bound in ((counts.where("n > 1"), words), (gram_counts, grams)):
        kept = top_entries(table, bound).toArrow().sort_by([("entry", "ascending"), ("lang", "ascending")])
        entry = kept.column("entry").to_pylist()
        own = [i for i, e in enumerate(entry) if not i or e != entry[i - 1]]
        names.append([entry[i] for i in own])
        base = start[-1]
        start += [base + stop for stop in [*own[1:], len(entry)][: len(own)]]
        lang_of += [number[x] for x in kept.column("lang").to_pylist()]
        gain_of.append(np.log((kept.column("n").to_numpy() + 0.1) / 0.1))
    return Model(languages, names[0], names[1], np.array(start, np.int64), np.array(lang_of, np.int32), np.concatenate(gain_of), floor)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) from ``text`` alone."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = Scores(Model(*sent.value))
        for texts in parts(batches):
            words = [Counter(LETTERS.findall((t or "").lower())) for t in texts.to_pylist()]
            if scores.model.languages:
                scores.learn_all(words)
            found = list(map(scores.text, words))
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang", "score"])
        del scores
        give_back()

    # Spark would run a deterministic function again for a filter on what it found
    found = F.arrow_udf(run, "lang string, score double").asNondeterministic()(F.col(text).cast("string"))
    return docs.withColumn("_found", found).withColumns({"lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learned from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
