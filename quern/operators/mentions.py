"""Which of many names stand in which of many texts, as whole words.

A name is looked for by one of its words only: the one that the fewest texts hold. Texts give their
different words once; those that no name has are dropped first, and (text, name) pairs arise only where
a text holds the chosen word. Each pair is then verified on the text itself, so neither all names meet all texts
nor does a frequent given name make candidates of its own.

Defined cases: null and empty texts mention nobody; a name without a letter or digit, or null, is
never mentioned; names are compared whatever their case, other signs as they are; two people of one name
are both mentioned; rows with a null id are dropped; an empty table on either side gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import written

#: What parts words. Both sides are folded alike, so that a word of a name is a word of the text.
_GAP = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """The different words of a text, lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), _GAP)), lambda w: w != "")


def stands_in(text: Column, name: Column) -> Column:
    """Whether a name, a column too, stands in a text as whole words."""
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_like(text, quoted)


def mentioned(docs: DataFrame, id: str, text: str, people: DataFrame, person: str, name: str) -> DataFrame:
    """(id, person) of each person whose name stands in a text."""
    named = people.select(person, F.col(name).alias("_name"), words(F.col(name)).alias("_words")).where(F.col(person).isNotNull() & (F.size("_words") > 0))
    of_name = written(named.select(person, "_name", F.explode("_words").alias("word")))
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("_doc"), F.explode(words(F.col(text))).alias("word"))
    held = written(rows.join(of_name.select("word").distinct(), "word", "left_semi"))
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a name with a word that no text holds is in none
    rated = of_name.join(counts, "word", "left").groupBy(person, "_name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("w")).where("w.n > 0")
    chosen = rated.select(F.col("w.word").alias("word"), person, "_name")
    pairs = held.join(chosen, "word").select("_doc", person, "_name")
    met = pairs.join(docs.select(F.col(id).alias("_doc"), F.col(text).alias("_text")), "_doc")
    return met.where(stands_in(F.col("_text"), F.col("_name"))).select(F.col("_doc").alias(id), person).distinct()


def participants(docs: DataFrame, id: str, text: str, authors: DataFrame, people: DataFrame, person: str, name: str) -> DataFrame:
    """(id, person, role): a text's authors (id, person) and, of all others, those whom it mentions."""
    own = authors.select(id, person).distinct()
    others = mentioned(docs, id, text, people, person, name).join(own, [id, person], "left_anti")
    return own.withColumn("role", F.lit("author")).unionByName(others.withColumn("role", F.lit("mentioned")))
