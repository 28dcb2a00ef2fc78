"""Read models over reviewed records: what the public sees of sources, items, trends and tables.

Visibility is a semi join on the ids of visible statements, so hidden records never widen a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sources(table: DataFrame, owners: DataFrame, items: DataFrame, source: str, owner: str, public: Column, audit: list[str]) -> DataFrame:
    """Each source with its owner, the number of its items, and audit columns for the public ones only."""
    counts = items.groupBy(source).agg(F.count(F.lit(1)).alias("items"))
    hidden = {c: F.when(public, F.col(c)) for c in audit}
    return table.withColumns(hidden).join(owners, owner, "left").join(counts, source, "left").fillna(0, ["items"])


def item_people(participants: DataFrame, visible: DataFrame, item: str, person: str) -> DataFrame:
    """Participants of items that have a visible statement of their own there."""
    return participants.join(visible.select(item, person), [item, person], "left_semi")


def item_evidence(evidence: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Evidence that a visible statement cites."""
    return evidence.join(visible.select(key), key, "left_semi")


def latest(df: DataFrame, section: str, time: str, id: str, most: int) -> DataFrame:
    """(section, place, id) of the last ``most`` rows by time, undated ones last."""
    best = df.select(F.col(id).cast("string").alias("id"), F.col(time).alias("_t")).orderBy(F.desc_nulls_last("_t"), "id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("_t"), "id"))  # over at most ``most`` rows
    return best.select(F.lit(section).alias("section"), place.alias("place"), "id")


def catalog(tables: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """(name, records, last): rows of each table and the last time of its rows, each table read once."""
    lines = [df.agg(F.count(F.lit(1)).alias("records"), F.max(time).cast("string").alias("last") if time is not None else F.lit(None).cast("string").alias("last")).select(F.lit(name).alias("name"), "records", "last") for name, (df, time) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, lines)


def export_bundle(tables: dict[str, tuple[DataFrame, str]], visible: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The public rows of each table, ordered by its slug; ``visible`` holds the slugs of tables that are not all public."""
    return {name: (df.join(visible[name].select(slug), slug, "left_semi") if name in visible else df).orderBy(slug) for name, (df, slug) in tables.items()}


def discovery(parts: dict[str, tuple[DataFrame, str, Column]], base: str) -> DataFrame:
    """(url, changed): the address of each public record and when it last changed, for site maps and feeds."""
    return reduce(DataFrame.unionByName, [df.select(F.concat(F.lit(f"{base}/{kind}/"), F.col(slug).cast("string")).alias("url"), changed.alias("changed")) for kind, (df, slug, changed) in sorted(parts.items())])


def research_view(rows: DataFrame, visible: DataFrame, trend: str, id: str) -> DataFrame:
    """Per trend the rows that research may see and how many are left out."""
    marked = rows.join(visible.select(F.col(id), F.lit(True).alias("_seen")).distinct(), id, "left")
    return marked.groupBy(trend).agg(F.count("_seen").alias("shown"), F.count(F.when(F.col("_seen").isNull(), 1)).alias("omitted"), F.min(F.when(F.col("_seen"), F.col(id))).alias("first"))


def cohort_report(people: DataFrame, facts: DataFrame, person: str, namespace: str) -> DataFrame:
    """(namespace, people, share): how many of a cohort have a fact of each namespace, over the whole cohort."""
    n = people.agg(F.count(F.lit(1)).alias("_all"))
    have = facts.join(people.select(person), person, "left_semi").groupBy(namespace).agg(F.countDistinct(person).alias("people"))
    return have.crossJoin(F.broadcast(n)).select(namespace, "people", F.bround(F.col("people") / F.col("_all"), 4).alias("share"))  # one row on the right


def statement_page(statements: DataFrame, people: DataFrame, topics: DataFrame, person: str, id: str, topic: str) -> DataFrame:
    """Statements with their person as a nested object and their topics as a sorted list."""
    names = people.select(F.col(person), F.struct(*people.columns).alias("person"))
    held = topics.groupBy(id).agg(F.array_sort(F.collect_set(topic)).alias("topics"))
    return statements.join(names, person, "left").join(held, id, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def statement_detail(statements: DataFrame, evidence: DataFrame, edges: DataFrame, id: str, value) -> DataFrame:
    """One statement with its evidence and its relations, each as a sorted list."""
    one = statements.where(F.col(id) == value)
    own = lambda df, name: df.where(F.col(id) == value).groupBy(id).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != id]))).alias(name))
    return one.join(own(evidence, "evidence"), id, "left").join(own(edges, "relations"), id, "left")


def person_detail(people: DataFrame, parts: dict[str, DataFrame], person: str, value) -> DataFrame:
    """One person with each part (affiliations, identities, sources, statements) as a sorted list."""
    out = people.where(F.col(person) == value)
    for name, df in parts.items():
        own = df.where(F.col(person) == value).groupBy(person).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != person]))).alias(name))
        out = out.join(own, person, "left")
    return out


def freshness_histogram(sources: DataFrame, kind: str, state: Column, failing: Column) -> DataFrame:
    """(kind, state, sources, failing) of all sources."""
    return sources.groupBy(F.col(kind).alias("kind"), state.alias("state")).agg(F.count(F.lit(1)).alias("sources"), F.count(F.when(failing, 1)).alias("failing"))


def capped(df: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows and whether there are more."""
    rows = df.orderBy(*order).limit(most + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over at most ``most`` + 1 rows
    n = F.count(F.lit(1)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_place", place).withColumn("truncated", n > most).where(F.col("_place") <= most).drop("_place")


def dimension_chain(facts: DataFrame, links: DataFrame, dimension: DataFrame, key: str, link: str, states: Column) -> DataFrame:
    """Facts with a dimension two steps away; links outside of ``states`` count as absent, and facts always stay."""
    return facts.join(links.where(states), key, "left").join(dimension, link, "left")


def current_version(items: DataFrame, keys: list[str], version: str, current: Column) -> DataFrame:
    """Each item with the version that is current for its logical key, null without one."""
    now = items.where(current).select(*keys, F.col(version).alias("current_version"))
    return items.join(now, keys, "left")


def joined_single(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the only row of ``one``, such as the current document; without it there are no rows."""
    return rows.crossJoin(F.broadcast(one.limit(1)))  # one row on the right
