"""Readers of fixed artifacts: JSON lines, gzip rows, pairs of CSV files, JSON-stat cubes, flat YAML, JSON graphs.

Files are read by Spark, never on the driver; texts inside a column are taken apart by expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrays import held


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line; a line that is no JSON has its text in ``_corrupt`` and null elsewhere."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files; those that end in ``.gz`` are unpacked."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def csv_pair(spark: SparkSession, data: str, labels: str, key: str) -> DataFrame:
    """A CSV table with the columns of a second one that explains its ``key``."""
    read = lambda p: spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(p)
    return read(data).join(read(labels), key, "left")


def _read_cubes(cubes: DataFrame, cube: str, dimensions: list[str]) -> DataFrame:
    """``cubes`` with the categories ``_<dimension>`` in order, the cells as ``_dense`` list or ``_sparse`` object by place, and ``problem``.

    An index of categories is a list or an object of places; categories are null if they repeat or have gaps.
    """
    c = F.col
    index = {f"_index_{d}": F.get_json_object(c(cube), f"$.dimension.{d}.category.index") for d in dimensions}
    rows = held(cubes, **index, _value=F.get_json_object(c(cube), "$.value"), _status=F.get_json_object(c(cube), "$.status"))
    listed = lambda t, kind: F.when(c(t).startswith("["), F.from_json(c(t), f"array<{kind}>"))
    placed = lambda t, kind: F.when(c(t).startswith("{"), F.from_json(c(t), f"map<string,{kind}>"))
    pairs = {f"_placed_{d}": F.array_sort(F.transform(F.map_entries(placed(f"_index_{d}", "int")), lambda e: F.struct(e["value"].alias("at"), e["key"].alias("code")))) for d in dimensions}
    rows = held(
        rows, **pairs, **{f"_listed_{d}": listed(f"_index_{d}", "string") for d in dimensions},
        _dense=listed("_value", "double"), _sparse=placed("_value", "double"), _flags=listed("_status", "string"), _flag_of=placed("_status", "string"),
    )

    def names(d: str) -> Column:
        p = c(f"_placed_{d}")
        whole = F.when(F.size(p) > 0, F.transform(p, lambda e: e["at"]) == F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0))))
        return F.coalesce(c(f"_listed_{d}"), F.when(whole, F.transform(p, lambda e: e["code"])))

    rows = held(rows, **{f"_{d}": names(d) for d in dimensions})
    good = lambda d: (F.size(c(f"_{d}")) > 0) & (F.size(F.array_distinct(c(f"_{d}"))) == F.size(c(f"_{d}"))) & ~F.exists(c(f"_{d}"), lambda n: n.isNull())
    total = reduce(lambda a, b: a * b, [F.size(c(f"_{d}")).cast("long") for d in dimensions])
    rows = held(rows, _good=F.coalesce(reduce(lambda a, b: a & b, [good(d) for d in dimensions]), F.lit(False)), _total=total)
    off = F.exists(F.map_keys("_sparse"), lambda k: ~k.rlike("^(?:0|[1-9][0-9]*)$") | F.coalesce(k.try_cast("long") >= c("_total"), F.lit(True)))
    wrong = F.when(~c("_good"), "category_index").when(c("_dense").isNull() & c("_sparse").isNull(), "no_values").when(c("_dense").isNotNull() & (F.size("_dense") != c("_total")), "dense_count")
    return held(rows, problem=F.coalesce(wrong, F.when(F.coalesce(off, F.lit(False)), "sparse_index")))


def cube_problems(cubes: DataFrame, cube: str, dimensions: list[str], *keep: str) -> DataFrame:
    """Why each JSON-stat text is no cube: category_index, no_values, dense_count or sparse_index; null if it is one."""
    return _read_cubes(cubes, cube, dimensions).select(*keep, "problem")


def json_stat(cubes: DataFrame, cube: str, dimensions: list[str], *keep: str) -> DataFrame:
    """A row per cell of JSON-stat cubes: the category of each dimension, ``value``, ``status`` and ``state``.

    Cells are in row-major order. An index of categories is a list or an object of places, values and
    statuses are a list or an object by place; all forms give the same cells. ``state``: observed, explicit_null
    or absent (an object of values has no such place). A text with a problem gives no rows.
    """
    rows = _read_cubes(cubes, cube, dimensions).where("problem IS NULL")
    cells = rows.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_total").cast("int") - 1)))
    width: Column = F.lit(1)
    out = []
    for d in reversed(dimensions):
        out.append(F.get(F.col(f"_{d}"), (F.floor(F.col("_cell") / width) % F.size(f"_{d}")).cast("int")).alias(d))
        width = width * F.size(f"_{d}")
    place = F.col("_cell").cast("string")
    value = F.coalesce(F.get("_dense", F.col("_cell")), F.try_element_at("_sparse", place))
    there = F.col("_dense").isNotNull() | F.map_contains_key("_sparse", place)
    state = F.when(value.isNotNull(), "observed").when(there, "explicit_null").otherwise("absent")
    status = F.coalesce(F.get("_flags", F.col("_cell")), F.try_element_at("_flag_of", place))
    return cells.select(*keep, *reversed(out), value.alias("value"), status.alias("status"), state.alias("state"))


def yaml_pairs(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(key, value) of each ``key: value`` line of flat YAML; comments, quotes and null values as in YAML."""
    lines = texts.select(*keep, F.posexplode(F.split(text, r"\r?\n")).alias("line", "_raw"))
    form = r"^([A-Za-z_][A-Za-z0-9_.-]*):(?:\s+(.*?))?\s*$"
    value = F.regexp_extract("_raw", form, 2)
    bare = F.regexp_replace(value, r"\s+#.*$", "")
    plain = F.when(value.rlike("^'.*'$"), F.replace(F.regexp_extract(value, "^'(.*)'$", 1), F.lit("''"), F.lit("'"))).when(value.rlike('^".*"$'), F.regexp_extract(value, '^"(.*)"$', 1)).when(~bare.isin("", "null", "~"), bare)
    return lines.where(F.col("_raw").rlike(form)).select(*keep, "line", F.regexp_extract("_raw", form, 1).alias("key"), plain.alias("value"))


def graph_edges(graphs: DataFrame, graph: str, *keep: str) -> DataFrame:
    """(source, target, kind) of JSON graphs {nodes: [{id}], edges: [{source, target, kind}]}, ends that are no node marked ``dangling``."""
    schema = T.StructType.fromDDL("nodes array<struct<id:string>>, edges array<struct<source:string,target:string,kind:string>>")
    g = graphs.select(*keep, F.from_json(graph, schema).alias("g")).select(*keep, F.col("g.nodes.id").alias("_ids"), F.explode("g.edges").alias("e"))
    known = reduce(lambda a, b: a & b, [F.array_contains("_ids", F.col(f"e.{c}")) for c in ("source", "target")])
    return g.select(*keep, "e.source", "e.target", "e.kind", (~known).alias("dangling"))
