"""Deterministic snapshots: JSON rows, CSV text and a manifest with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row with its keys in order; nulls are kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def csv_field(c: Column) -> Column:
    """A field by RFC 4180; null is empty, formulas are defused by a quote mark in front."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(t.rlike("^[=+@\\t\\r]") | t.rlike("^-[^0-9.]"), F.concat(F.lit("'"), t)).otherwise(t)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(F.array_join(c, "|") if t.startswith("array") else F.col(c)) for c, t in df.dtypes]).alias("csv"))


def table_digest(df: DataFrame) -> DataFrame:
    """(records, bytes, sha256) of a table's JSON rows, whatever their order.

    Rows are hashed one by one; 65,536 groups of row digests are hashed in order, and then the
    groups, so neither a task nor the driver holds the rows.
    """
    rows = json_rows(df).select(F.sha2("json", 256).alias("h"), F.octet_length("json").cast("long").alias("n"))
    groups = rows.groupBy(F.substring("h", 1, 4).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count(F.lit(1)).alias("records"), F.sum("n").alias("bytes"))
    return groups.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, records, bytes, sha256) of each table and ``snapshot_id``, the digest of all lines."""
    out: DataFrame | None = None
    for name, df in sorted(tables.items()):
        line = table_digest(df).select(F.lit(name).alias("name"), "records", "bytes", "sha256")
        out = line if out is None else out.unionByName(line)
    text = F.concat_ws("\t", "name", "sha256", F.col("bytes").cast("string"))
    whole = out.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("snapshot_id"))
    return out.crossJoin(F.broadcast(whole))  # one row on the right


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as sorted JSON lines, and the manifest."""
    for name, df in tables.items():
        json_rows(df).orderBy("json").write.mode("overwrite").text(f"{path}/{name}")
    manifest(tables).orderBy("name").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def markdown_rows(df: DataFrame, order: list[str], title: str) -> DataFrame:
    """(line, text) of a small report table as Markdown: heading, header, rule, rows in order."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    columns = df.columns
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    rows = df.select(F.struct(*order).alias("_o"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("text"))
    # a report is small: its rows are put in order as one array
    held = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "text"))), lambda r: r["text"]).alias("rows"))
    return held.select(F.posexplode(F.concat(F.array(*map(F.lit, head)), "rows")).alias("line", "text"))


def sitemap_rows(pages: DataFrame, url: str, changed: str) -> DataFrame:
    """A ``url`` element of a site map per page."""
    from quern.functions.text import escape_xml

    return pages.select(F.concat(F.lit("<url><loc>"), escape_xml(F.col(url)), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format(changed, "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>")).alias("entry"))
