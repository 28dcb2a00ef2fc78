"""Text functions on texts where an easy reading of the rule goes wrong."""

import duckdb
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import extract


def test_sentences_keep_the_digits_at_their_ends(spark):
    df = spark.createDataFrame([(0, "0 a 0. 1 b 1. 2 c 2.\n33"), (1, None)], "i int, s string").orderBy("i")
    rows = df.select(tx.sentences(F.col("s")).alias("a"), tx.sentence_spans(F.col("s")).alias("b")).collect()
    assert rows[0].a == ["0 a 0.", "1 b 1.", "2 c 2.", "33"] == [x.text for x in rows[0].b]
    assert rows[1].a is None


def test_topics_have_the_word_boundaries_of_sql(spark):
    said = ["die réäder in ü", "der éin und", "the ofß", "the_ of", "the İN", "xthe of", None]
    df = spark.createDataFrame(list(enumerate(said)), "i int, s string").orderBy("i")
    got = df.select(extract.topic_signal(F.col("s"), r"(?i)(?<!\w)(?:the|der)(?!\w)", {"place": ["of", "in"], "joint": ["and", "und"]}).alias("t")).collect()
    con = duckdb.connect()
    has = lambda s, words: s is not None and con.execute("SELECT regexp_matches(lower(?), ?)", [s, rf"\b({words})\b"]).fetchall()[0][0]
    want = [[t for t, w in (("place", "of|in"), ("joint", "and|und")) if has(s, w)] or None if has(s, "the|der") else None for s in said]
    assert [r.t for r in got] == want == [["place"], ["place", "joint"], ["place"], None, ["place"], None, None]


def test_licences_that_running_text_names(spark):
    said = ["token acc0f727", "under CC0.", "CC BY-SA", "cc-by-nc", "émit license", "MİT LICENSE", "xmit license", "see licenses/mit", None]
    df = spark.createDataFrame(list(enumerate(said)), "i int, s string").orderBy("i")
    rows = df.select(tx.licence_family(F.col("s")).alias("a"), tx.licence_family(F.col("s"), tx.NAMED_LICENCES).alias("b")).collect()
    assert [r.a for r in rows] == [None, "cc0", "cc-by-sa", "cc-by-nc", "mit", "mit", None, "mit", None]
    assert [r.b for r in rows] == [None, None, None, "cc-by-nc", "mit", "mit", None, None, None]
