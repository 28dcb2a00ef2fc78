"""Review decisions: checks, transitions, replay, restore and staging, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx

#: State that a decision leads to (fixed values).
RESULT = {"approve": "human_verified", "needs_changes": "needs_review", "reject": "rejected"}


def resulting_state(decision: Column) -> Column:
    out = F.lit(None).cast("string")
    for d, s in RESULT.items():
        out = F.when(decision == d, s).otherwise(out)
    return out


def decision_key(*fields: str) -> Column:
    """The digest that names a decision command; the command's own key is not among ``fields``."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def numbers_in(c: Column) -> Column:
    """All numbers that a text shows, percentages as fractions too."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)\s*(%?)"), F.lit(0))
    plain = F.transform(found, lambda x: F.regexp_replace(x, r"[%\s]", "").cast("double"))
    return F.array_distinct(F.concat(plain, F.transform(F.filter(found, lambda x: F.contains(x, F.lit("%"))), lambda x: F.regexp_replace(x, r"[%\s]", "").cast("double") / 100)))


def supported(value: Column, evidence: Column, tolerance: float = 1e-9) -> Column:
    """Whether ``value`` stands in the evidence, as it is, as a percentage or as a fraction."""
    return value.isNull() | F.exists(numbers_in(evidence), lambda n: (F.abs(n - value) <= tolerance) | (F.abs(n - value * 100) <= tolerance * 100))


def checked(decisions: DataFrame, statements: DataFrame, id: str) -> DataFrame:
    """Decisions with ``state`` they lead to, or ``problem``.

    ``decisions``: id, decision, start, stop, value, content_hash. ``statements``: id, text, content_hash.
    """
    s = statements.select(id, F.col("text").alias("_text"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_known"))
    span = F.substring(F.col("_text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    approve = F.col("decision") == "approve"
    problem = (
        F.when(F.col("_known").isNull(), "unknown_statement")
        .when(resulting_state(F.col("decision")).isNull(), "unknown_decision")
        .when(~F.col("content_hash").eqNullSafe(F.col("_hash")), "source_changed")
        .when(approve & ((F.col("start") < 0) | (F.col("stop") > F.length("_text")) | (F.col("start") >= F.col("stop"))), "span_outside_text")
        .when(approve & ~supported(F.col("value"), span), "number_not_in_evidence")
    )
    return decisions.join(s, id, "left").select(*decisions.columns, F.when(problem.isNull(), resulting_state(F.col("decision"))).alias("state"), problem.alias("problem"))


def replay(log: DataFrame, incoming: DataFrame, key: str = "decision_key") -> DataFrame:
    """The log with the decisions it does not hold yet; a second replay changes nothing."""
    fresh = incoming.dropDuplicates([key]).join(log.select(key), key, "left_anti")
    return log.unionByName(fresh)


def restored(statements: DataFrame, corrections: DataFrame, id: str, at: str, key: str) -> DataFrame:
    """Statements with the cumulative corrections of their decisions: of each field the value set last.

    ``corrections``: id, at, key and a map column ``fields``.
    """
    each = corrections.select(id, at, key, F.explode("fields").alias("field", "value"))
    last = each.groupBy(id, "field").agg(F.max_by("value", F.struct(at, key)).alias("value"))
    merged = last.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_fields"))
    out = statements.join(merged, id, "left")
    return out.select(*[c if c == id else F.coalesce(F.try_element_at("_fields", F.lit(c)), F.col(c).cast("string")).cast(t).alias(c) for c, t in statements.dtypes])


def staged(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates that are not known under their key yet, each key once (the first by place)."""
    w = Window.partitionBy(key).orderBy("place")
    first = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(known.select(key), key, "left_anti")


def candidate_key(*fields: str) -> Column:
    """The identity of a candidate: its fields, numbers as plain as they can be."""
    return tx.content_key(*[F.col(f) for f in fields])


def publication_state(runs: DataFrame, dataset: str, position: str, status: str) -> DataFrame:
    """Whether each dataset may be published: its last run must have succeeded, wholly or in part."""
    last = runs.groupBy(dataset).agg(F.max_by(status, position).alias("last"))
    return last.select(dataset, "last", F.when(F.col("last").isin("succeeded", "partial"), "publish").otherwise("hold").alias("decision"))


def membership_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Members that joined and left between two versions of a cohort."""
    joined = after.select(key).join(before.select(key), key, "left_anti").withColumn("change", F.lit("joined"))
    return joined.unionByName(before.select(key).join(after.select(key), key, "left_anti").withColumn("change", F.lit("left")))


def mapped(df: DataFrame, column: str, vocabulary: dict[str, str], out: str) -> DataFrame:
    """Add ``out`` by a fixed vocabulary and ``unmapped``, the values it lacks."""
    to = F.lit(None).cast("string")
    for a, b in vocabulary.items():
        to = F.when(F.col(column) == a, b).otherwise(to)
    return df.withColumn(out, to).withColumn("unmapped", F.when(to.isNull() & F.col(column).isNotNull(), F.col(column)))


def participants(authors: DataFrame, bodies: DataFrame, people: DataFrame, item: str, name: str, body: str, person: str, display: str) -> DataFrame:
    """(item, person, role): authors whose name fits one person only, and people whom the body names.

    Names meet by word: each person's rarest word is looked up among the words of a body, and the
    whole name is then checked, so bodies and people are never all paired.
    """
    key = tx.phrase(F.col(display))
    unique = people.groupBy(key.alias("_key")).agg(F.countDistinct(person).alias("n"), F.min(person).alias(person)).where("n = 1").drop("n")
    wrote = authors.select(item, tx.phrase(F.col(name)).alias("_key")).join(unique, "_key").select(item, person, F.lit("author").alias("role")).distinct()
    words = people.select(person, key.alias("_key"), F.explode(F.array_distinct(F.split(key, " "))).alias("_word"))
    spread = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_spread"))
    rare = words.join(spread, "_word").groupBy(person, "_key").agg(F.min_by("_word", F.struct("_spread", "_word")).alias("_word"))
    seen = bodies.select(item, tx.phrase(F.col(body)).alias("_body")).select(item, "_body", F.explode(F.array_distinct(F.split("_body", " "))).alias("_word"))
    named = seen.join(rare, "_word").where(F.contains(F.concat(F.lit(" "), "_body", F.lit(" ")), F.concat(F.lit(" "), "_key", F.lit(" ")))).select(item, person, F.lit("mentioned").alias("role")).distinct()
    return wrote.unionByName(named.join(wrote.select(item, person), [item, person], "left_anti"))


def merged_runs(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Before and after values of a report's rows and their difference."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full_outer").select(key, "before", "after", (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))
