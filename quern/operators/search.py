"""Ranked search over several kinds of records."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx

#: Ranks of the ways in which a record can match (fixed values).
EXACT_TEXT, EXACT_NAME, PHRASE, FAMILY_NAME, NAME_PREFIX, TOKEN_PREFIX, ALL_TOKENS, ROLE = 460, 400, 380, 320, 240, 180, 100, 60


@dataclass(frozen=True)
class Prepared:
    """A search text made ready: ``reason`` is ok, empty or no_tokens."""

    text: str
    tokens: tuple[str, ...]
    reason: str


def prepare(raw: str) -> Prepared:
    """NFKC, no controls, single spaces, lower case, at most 200 characters and 8 tokens of 2 to 48 characters."""
    plain = unicodedata.normalize("NFKC", raw or "")
    plain = "".join(" " if c.isspace() else c for c in plain if c.isspace() or unicodedata.category(c) not in ("Cc", "Cf"))
    plain = " ".join(plain.split()).lower()[:200]
    found = dict.fromkeys(t[:48] for t in re.split(r"[\W_]+", plain) if len(t) >= 2)
    tokens = tuple(found)[:8]
    return Prepared(plain, tokens, "empty" if not plain else "ok" if tokens else "no_tokens")


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def every_token_begins_a_word(line: Column, tokens: tuple[str, ...]) -> Column:
    """``line`` has its words between blanks, so a token is looked for as text, without an array of words."""
    # as the one element of an array the line is made once for all tokens
    return F.exists(F.array(line), lambda x: _all([F.contains(x, F.lit(f" {t}")) for t in tokens]))


def every_token_is_a_word(line: Column, tokens: tuple[str, ...]) -> Column:
    return F.exists(F.array(line), lambda x: _all([F.contains(x, F.lit(f" {t} ")) for t in tokens]))


def name_rank(name: Column, family: Column, query: Prepared, role: Column | None = None) -> Column:
    """How well a name matches, 0 if not at all."""
    folded = tx.collapse(tx.fold_accents(name))
    words = tx.name_line(name)
    rank = F.when(folded == query.text, EXACT_NAME)
    if len(query.tokens) == 1:
        rank = rank.when(tx.fold_accents(family) == query.tokens[0], FAMILY_NAME)
    rank = rank.when(F.startswith(folded, F.lit(query.text + " ")), NAME_PREFIX).when(every_token_begins_a_word(words, query.tokens), TOKEN_PREFIX)
    if role is not None:
        rank = rank.when(every_token_begins_a_word(tx.name_line(role), query.tokens), ROLE)
    return rank.otherwise(0)


def text_rank(text: Column, query: Prepared) -> Column:
    """How well a statement's text matches: all tokens must begin a word."""
    lower = F.lower(tx.collapse(text))
    hit = every_token_begins_a_word(tx.word_line(text), query.tokens)
    return F.when(~hit, 0).when(lower == query.text, EXACT_TEXT).when(F.contains(lower, F.lit(query.text)), PHRASE).otherwise(ALL_TOKENS)


def search(df: DataFrame, kind: str, id: str, label: str, rank: Column, limit: int) -> DataFrame:
    """The best ``limit`` records of a kind, with the number of all matches."""
    found = df.select(F.lit(kind).alias("kind"), F.col(id).cast("string").alias("id"), F.col(label).alias("label"), rank.alias("rank")).where("rank > 0")
    total = found.agg(F.count(F.lit(1)).alias("total"))  # one row
    return found.orderBy(F.desc("rank"), "label", "id").limit(limit).crossJoin(F.broadcast(total))


def best_of(found: DataFrame, limit: int) -> DataFrame:
    """Per kind the first ``limit`` matches by rank, label and id, and the number of all.

    Each task keeps the first ``limit`` of a kind before anything is shuffled, and counts are added up in part.
    """
    counts = found.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))  # a row for each kind
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("rank"), "label", "id"))
    few = found.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    return few.join(F.broadcast(counts), "kind")


def grouped(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Kinds of records, and for each filter the kinds that it can narrow (fixed values).
KINDS = ("person", "organization", "topic", "source", "statement", "source_item")
NARROWS = {"date": ("statement", "source_item"), "topic": ("topic", "statement"), "person": ("person", "statement", "source_item"), "statement_type": ("statement",), "source_kind": ("source", "source_item")}
#: Rows of each kind in a list of suggestions (fixed values), and of a page.
SUGGESTED = dict(zip(KINDS, (2, 1, 2, 1, 1, 1)))
DEFAULT_LIMIT, MOST_LIMIT = 8, 20


def kinds_for(filters: dict[str, object], asked: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """The kinds to search: those asked for that every filter given can narrow.

    A filter that fits none of the kinds asked for is refused, and so is an unknown filter or kind, and a
    range of dates that ends before it starts.
    """
    given = {k: v for k, v in filters.items() if v is not None}
    unknown = [k for k in given if k not in NARROWS] + [k for k in asked or () if k not in KINDS]
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    if "date" in given and given["date"][0] is not None and given["date"][1] is not None and given["date"][0] > given["date"][1]:
        raise ValueError("a range of dates ends before it starts")
    for k in given:
        if asked and not set(asked) & set(NARROWS[k]):
            raise ValueError(f"{k} narrows none of {', '.join(asked)}")
    return tuple(k for k in asked or KINDS if all(k in NARROWS[f] for f in given))


def page_limit(asked: int | None) -> int:
    return min(MOST_LIMIT, max(1, asked)) if asked is not None else DEFAULT_LIMIT


def visible_matches(matched: DataFrame, visible: DataFrame, id: str) -> DataFrame:
    """Matches first, then visibility: only ids that matched are looked up among the visible ones."""
    return matched.join(visible.select(id), id, "left_semi")


def research(raw: str, people: DataFrame, statements: DataFrame, topics: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows (kind, id, label) of each table whose label holds the text, whatever its case."""
    q = prepare(raw).text
    pattern = "%" + re.sub(r"([\\%_])", r"\\\1", q) + "%"
    parts = [df.where(F.col("label").ilike(pattern)).orderBy("label", "id").limit(limit) for df in (people, statements, topics)]
    return grouped(*parts)


def suggestions(found: DataFrame) -> DataFrame:
    """Per kind as many of the best matches as a list of suggestions holds."""
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in SUGGESTED.items()], F.lit(1))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("rank"), "label", "id"))
    return best_of(found, max(SUGGESTED.values())).withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
