"""Canonical exact digests of documents, with DataFrame functions only.

A text's canonical form is its NFKC form, case-folded and normalised again, with each run of white
space as one space and none at its ends. Its digest is 128 bits wide, two xxHash64 values with
different seeds. Rows of one digest are then compared byte by byte: digests are counted first, and the
forms of those that stand more than once are grouped by digest and form, in which copies meet before
the shuffle; digests with more than one form get an ordinal, so equal fingerprints mean equal
canonical forms. The likeness of two such fingerprints is 1 if they are equal, else 0.

Only forms whose digest falls on a set bit of a bitmap of ``BITS`` bits are grouped. The bitmap has a
fixed size; it spares the shuffle of texts that stand alone and never decides a match.

Defined cases: a null text counts as empty; long texts are read whole; repeated rows share a
fingerprint; among rows of one id the order of the texts decides; a single row is its own next one;
an empty table gives an empty table; extra columns pass through ``fingerprints``, and a column that
has the name of an output is replaced; rows with a null id are dropped by ``next_documents``, for
they have no order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import written

#: Unicode's White_Space characters (fixed values).
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Rows of a block in which documents find the next one.
BLOCK = 2_000
#: Quantiles of the ids that the blocks follow, at most.
QUANTILES = 8_192
BITS = 1 << 24


def canonical(text: Column) -> Column:
    """The canonical form of a text; of ASCII it is the lower-case form with folded white space."""

    def normal(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(normal(folded))
    return F.trim(F.regexp_replace(plain, WHITE, " "))


def digest(form: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), form)), 16, "0")))


def shared(forms: DataFrame) -> DataFrame:
    """The rows whose digest may stand more than once: those on a set bit of the bitmap of such digests."""
    place = lambda d: F.pmod(F.xxhash64(d), F.lit(BITS)) + 1
    often = forms.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(place("digest").alias("place"))
    # at most 512 rows of 4 kB
    bitmap = written(often.groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits")))
    bit = F.bitmap_bit_position(place("digest"))
    byte = F.conv(F.hex(F.substring("_bits", F.call_function("div", bit, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = forms.join(F.broadcast(bitmap), F.bitmap_bucket_number(place("digest")) == F.col("_bucket"))
    return met.where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1).select(*forms.columns)


def collisions(forms: DataFrame) -> DataFrame | None:
    """Digests that more than one canonical form has: (digest, form, ordinal), or None if there are none.

    Expects columns ``digest`` and ``form``. Copies meet within a task, so a hot form is shuffled once per task.
    """
    distinct = shared(forms).groupBy("digest", "form").agg(F.count(F.lit(1)).alias("n"))
    several = written(distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1"))
    if several.isEmpty():
        return None
    w = Window.partitionBy("digest").orderBy("form")
    return written(several.join(distinct, "digest").select("digest", "form", (F.row_number().over(w) - 1).alias("ordinal")))


def with_ordinal(rows: DataFrame, digest_column: str, form_column: str, collided: DataFrame | None) -> DataFrame:
    """``rows`` with the ordinal of its form after each digest that several forms share."""
    if collided is None:
        return rows
    c = collided.select(F.col("digest").alias("_digest"), F.col("form").alias("_form"), F.col("ordinal").alias("_ordinal"))
    joined = rows.join(c, (rows[digest_column] == c._digest) & (rows[form_column] == c._form), "left")
    return joined.withColumn(digest_column, F.when(F.col("_ordinal") > 0, F.concat_ws("-", digest_column, F.col("_ordinal").cast("string"))).otherwise(F.col(digest_column))).drop("_digest", "_form", "_ordinal")


def digested(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the canonical form of ``text`` as ``_canonical`` and its digest as ``out``."""
    rest = [c for c in docs.columns if c != out]
    return docs.select(*rest, canonical(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_canonical")).withColumn(out, digest(F.col("_canonical")))


def collisions_of(docs: DataFrame, text: str = "text") -> DataFrame | None:
    """``collisions`` of the texts of ``docs``."""
    return collisions(digested(docs, text, "digest").select("digest", F.col("_canonical").alias("form")))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``text`` to each row."""
    return with_ordinal(digested(docs, text, out), out, "_canonical", collisions_of(docs, text)).drop("_canonical")


def blocks_of(ids: DataFrame, id: str) -> Column:
    """The block of an id: blocks follow the quantiles of the ids and, in very large tables, equal slices between them."""
    n = ids.count()
    quantiles = min(QUANTILES, n // BLOCK)
    low, high, knots = ids.agg(F.min(id), F.max(id), F.percentile_approx(id, [i / (quantiles + 1) for i in range(1, quantiles + 1)] or [0.5], 100_000)).first()
    low, high = low or 0, high or 0
    edges = sorted({low, *(knots or [])} - {high} | {low})
    tops = [*edges[1:], high + 1]
    within = max(1, -(-n // (BLOCK * len(edges))))
    array = lambda xs: F.lit(xs).cast("array<long>")
    # first among every 64th edge, then among 64
    coarse = F.size(F.filter(array(edges[64::64]), lambda e: e <= F.col(id)))
    part = coarse * 64 + F.size(F.filter(F.slice(array(edges), coarse * 64 + 1, 64), lambda e: e <= F.col(id)))
    a, b = F.element_at(array(edges), part), F.element_at(array(tops), part)
    return (part * within + F.least(F.lit(within - 1), F.floor((F.col(id) - a) / (b - a) * within))).cast("long")


def blocks_before(blocks: DataFrame) -> DataFrame:
    """(_block, _after): the next lower block, and for the lowest one the highest; ``blocks`` has a row per block."""
    groups = blocks.withColumn("_group", F.floor(F.col("_block") / 4096))
    tops = groups.groupBy("_group").agg(F.max("_block").alias("_top"))
    ring = Window.orderBy("_group")  # a row per 4,096 blocks
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("_group", F.coalesce(F.lag("_top").over(ring), F.max("_top").over(whole)).alias("_top"))
    own = Window.partitionBy("_group").orderBy("_block")
    return groups.withColumn("_lower", F.lag("_block").over(own)).join(F.broadcast(tops), "_group").select("_block", F.coalesce("_lower", "_top").alias("_after"))


def next_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", dress: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by descending id; the first follows the last.

    ``dress`` adds columns from a row's own. Rows are dealt into blocks of neighbouring ids, and the first
    row of the block after it closes each block, so texts are shuffled once.
    """
    rows = docs.where(F.col(id).isNotNull())
    block = blocks_of(rows.select(id), id)
    dealt = rows.withColumn("_block", block)
    heads = dealt.groupBy("_block").agg(F.max(id).alias("_head"))
    heads = written(heads.join(blocks_before(heads.select("_block")).withColumnsRenamed({"_block": "_to", "_after": "_block"}), "_block"))
    first = dealt.join(heads.select("_head", "_to"), F.col(id) == F.col("_head")).drop("_head", "_block")
    best = first.groupBy("_to").agg(F.min_by(F.struct(*rows.columns), F.struct(text)).alias("_row")).select("_row.*", F.col("_to").alias("_block"))
    both = dress(dealt).withColumn("_last", F.lit(False)).unionByName(dress(best).withColumn("_last", F.lit(True)))
    names = [c for c in both.columns if c not in ("_block", "_last")]
    w = Window.partitionBy("_block").orderBy("_last", F.desc(id), text)
    seen = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in names])
    return seen.where("not _last").drop("_block", "_last")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    collided = collisions_of(docs)
    pairs = next_documents(docs, dress=lambda df: with_ordinal(digested(df, "text", "fingerprint"), "fingerprint", "_canonical", collided).drop("_canonical"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)))
    return fingerprints_of_edits(edited).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.when(F.col("edited_fingerprint") == F.col("fingerprint"), 1.0).otherwise(0.0).alias("near_edited"),
        F.when(F.col("next_fingerprint") == F.col("fingerprint"), 1.0).otherwise(0.0).alias("near_next"),
    )


def fingerprints_of_edits(edited: DataFrame) -> DataFrame:
    """Add ``edited_fingerprint``. It equals ``fingerprint`` only if the canonical forms are equal byte by byte."""
    both = edited.select("*", canonical(F.col("edited")).alias("_edited"), canonical(F.col("text")).alias("_own"))
    d = digest(F.col("_edited"))
    same = F.col("_edited") == F.col("_own")
    return both.withColumn("edited_fingerprint", F.when(same, F.col("fingerprint")).when(d == F.col("fingerprint"), F.concat(d, F.lit("-x"))).otherwise(d)).drop("_edited", "_own")
