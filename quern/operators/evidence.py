"""Checks and derivations for evidence bundles and published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.scratch import written


def coordinates(index: Column, sizes: dict[str, int]) -> list[Column]:
    """The coordinates of a flat cell index, the last dimension running fastest."""
    stride, out = 1, []
    for name, size in reversed(sizes.items()):
        out.append((F.floor(index / stride) % size).cast("long").alias(name))
        stride *= size
    return out[::-1]


def decode_bits(code: Column, fields: dict[str, int]) -> list[Column]:
    """Fields of a bit code, the first in the lowest bits; a null code stays null, zero is a value."""
    out, at = [], 0
    for name, width in fields.items():
        out.append(F.shiftright(code, at).bitwiseAND((1 << width) - 1).alias(name))
        at += width
    return out


def time_bounds(kind: Column, at: Column, start: Column, end: Column) -> Column:
    """struct(lower, upper) of an instant, a date, a range or an unknown time, from ISO texts."""
    day = F.to_timestamp(F.substring(at, 1, 10))
    lower = F.when(kind == "instant", F.try_to_timestamp(at)).when(kind == "date", day).when(kind == "range", F.try_to_timestamp(start))
    upper = F.when(kind == "instant", F.try_to_timestamp(at)).when(kind == "date", day + F.expr("interval '23:59:59.999999' hour to second")).when(kind == "range", F.try_to_timestamp(end))
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def exact_decimal(token: Column, digits: int = 20) -> Column:
    """A token as an exact decimal, null if it is none."""
    return F.when(token.rlike(rf"^-?[0-9]{{1,{digits}}}(?:\.[0-9]{{1,18}})?$"), token.try_cast("decimal(38,18)"))


def score_rows(lines: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """White-space separated rows with as many parts as ``fields``; other lines are left out."""
    parts = F.split(F.trim(column), r"\s+")
    return lines.where(F.size(parts) == len(fields)).select(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)])


def reconciles(part: Column, total: Column, percent: Column, tolerance: float) -> Column:
    """Whether a published percentage agrees with its counts, by cross-multiplication."""
    return F.abs(percent * total - part * 100) <= tolerance * total


def missing_cells(df: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a complete grid that ``df`` lacks."""
    return grid.join(df.select(*keys).distinct(), keys, "left_anti")


def correction_chain(captures: DataFrame, key: str, content: str, at: str, tiebreak: str) -> DataFrame:
    """Append-only replay: repeated contents in a row count once; each revision names the one before."""
    w = Window.partitionBy(key).orderBy(at, tiebreak)
    changed = captures.withColumn("_same", F.coalesce(F.lag(content).over(w) == F.col(content), F.lit(False))).where("not _same").drop("_same")
    return changed.withColumn("revision", F.row_number().over(w)).withColumn("supersedes", F.lag(tiebreak).over(w))


def bundle_errors(records: DataFrame, references: DataFrame) -> DataFrame:
    """(id, revision, code) of each broken rule.

    ``records``: id, revision, kind, created, supersedes. ``references``: id, revision, to_id,
    to_revision, to_kind. Rules: duplicate_revision, missing_reference, wrong_kind,
    future_reference, broken_lineage.
    """
    r = records.groupBy("id", "revision").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.min("created").alias("created"), F.min("supersedes").alias("supersedes"))
    error = lambda df, code: df.select("id", "revision", F.lit(code).alias("code"))
    target = r.select(F.col("id").alias("to_id"), F.col("revision").alias("to_revision"), F.col("kind").alias("_kind"), F.col("created").alias("_created"))
    refs = references.join(r.select("id", "revision", "created"), ["id", "revision"]).join(target, ["to_id", "to_revision"], "left")
    older = r.select("id", F.col("revision").alias("supersedes"), F.lit(True).alias("_older"))
    lineage = r.where((F.col("revision") > 1) | F.col("supersedes").isNotNull()).join(older, ["id", "supersedes"], "left").where("_older is null or supersedes <> revision - 1")
    return (
        error(r.where("n > 1"), "duplicate_revision")
        .unionByName(error(refs.where("_kind is null"), "missing_reference"))
        .unionByName(error(refs.where("_kind <> to_kind"), "wrong_kind"))
        .unionByName(error(refs.where("_created > created"), "future_reference"))
        .unionByName(error(lineage, "broken_lineage"))
    )


def values_in_order(*values: Column) -> Column:
    """Whether quantiles ascend."""
    ok = F.lit(True)
    for a, b in zip(values, values[1:]):
        ok = ok & (a <= b)
    return ok


def relative_change(before: Column, after: Column) -> Column:
    """Change relative to the start; null for a zero start."""
    return F.when(before != 0, after / before - 1)


def doubling_time(before: Column, after: Column, years: Column) -> Column:
    """Years that a steady growth from ``before`` to ``after`` takes to double."""
    return F.when((before > 0) & (after > before), years * F.log(F.lit(2.0)) / F.log(after / before))


def annualised(before: Column, after: Column, years: Column) -> Column:
    return F.when((before > 0) & (years > 0), F.pow(after / before, 1 / years) - 1)


def brier(forecast: str, outcome: str) -> Column:
    """Mean Brier loss of a group."""
    return F.avg(F.pow(F.col(forecast) - F.col(outcome), F.lit(2.0)))


def interval_problem(lower: Column, estimate: Column, upper: Column, most: float) -> Column:
    """What is wrong with a ratio and its interval: not_positive, not_in_order or implausible (beyond ``most``); null if nothing."""
    return F.when(lower <= 0, "not_positive").when(~values_in_order(lower, estimate, upper), "not_in_order").when(estimate > most, "implausible")


def cyclic_edges(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """Edges on cycles or behind them; none if the graph is acyclic.

    Each round takes away the edges of nodes that nothing leads to, so it needs as many rounds as
    the longest path before a cycle has nodes; a number of ``rounds`` refuses deeper graphs. Rounds are
    written to the shared folder.
    """
    left = written(edges.distinct())
    n = left.count()
    done = 0
    while rounds is None or done < rounds:
        done += 1
        left = written(left.join(left.select(F.col(b).alias(a)).distinct(), a, "left_semi"))
        before, n = n, left.count()
        if n in (0, before):
            return left.select(a, b)
    raise RuntimeError("the graph is deeper than the number of rounds")


def security_outcome(injection: Column, error: Column, attack: Column, goal: Column, applicable: Column) -> Column:
    """struct(status, success) of an attack run: only an applicable target predicate says whether the attacker won.

    ``goal`` is what the publisher reports of the attacker's goal; it is never read as safety.
    """
    status = (
        F.when(injection.isNull(), "not_applicable_clean")
        .when(error, "error_flag_not_observed_outcome")
        .when(attack.isin("dos", "denial_of_service"), "dos_nonutility_predicate_not_target_goal")
        .when(~F.coalesce(applicable, F.lit(False)), "unverified_historical_predicate")
        .otherwise("verified_target_goal_predicate")
    )
    return F.struct(status.alias("status"), F.when(status == "verified_target_goal_predicate", goal).alias("success"))


def record_errors(exported: Column, synthetic: Column) -> Column:
    """Codes of the rules that one record breaks, from its columns; ``exported``, ``synthetic``: of the bundle.

    Columns: is_synthetic, retrieved_at, known_at, reviewed_at, review_state, reviewer, publication_state,
    rights_state, record_type, has_excerpt.
    """
    c = F.col
    late = lambda a, b: F.coalesce(a > b, F.lit(False))
    verified, eligible = c("review_state") == "human_verified", c("publication_state") == "eligible"
    rules = {
        "mixed_synthetic": c("is_synthetic") != synthetic,
        "time_order": late(c("retrieved_at"), c("known_at")) | late(c("known_at"), exported) | late(c("reviewed_at"), exported),
        "review_timestamp": c("review_state").isin("machine_validated", "human_verified") & c("reviewed_at").isNull(),
        "human_reviewer": verified & c("reviewer").isNull(),
        "publication_gate": eligible & (~verified | ~c("rights_state").isin("metadata_only", "redistribution_allowed")),
        "content_rights": eligible & (c("has_excerpt") | (c("record_type") == "statement")) & (c("rights_state") != "redistribution_allowed"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()]))


#: Units without negative values, and units of whole numbers (fixed values).
NONNEGATIVE = ("probability", "percent", "people", "jobs", "years", "hours", "count")
WHOLE = ("people", "jobs", "count", "calendar_year")


def value_errors(kind: Column, unit: Column, numbers: Column, level: Column, shares: Column, interval_kind: Column, inclusive: Column) -> Column:
    """Codes of the rules that one value breaks.

    ``numbers``: its numbers in order (of an interval the lower and the upper one, of quantiles the values),
    ``shares``: the shares of quantiles, ``level``: the coverage of an interval.
    """
    ascends = lambda xs, strict: F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(xs) - 1)), lambda i: F.coalesce((F.get(xs, i - 1) < F.get(xs, i)) if strict else (F.get(xs, i - 1) <= F.get(xs, i)), F.lit(True)))
    interval, quantiles = kind == "interval", kind.isin("quantiles", "date_quantiles")
    statistical = interval_kind.isin("confidence", "credible")
    most = F.when(unit == "probability", 1.0).when(unit == "percent", 100.0).when(unit == "calendar_year", 9999.0)
    least = F.when(unit == "calendar_year", 1.0).when(unit.isin(*NONNEGATIVE), 0.0)
    bound = F.get(numbers, F.lit(0))
    rules = {
        "value_range": interval & (F.get(numbers, F.lit(0)) > F.get(numbers, F.lit(1))),
        "interval_level": interval & ((F.coalesce(statistical, F.lit(False)) != level.isNotNull()) | (level <= 0) | (level >= 1)),
        "quantile_order": quantiles & (F.exists(shares, lambda q: (q < 0) | (q > 1)) | ~ascends(shares, True)),
        "quantile_monotonicity": quantiles & ~ascends(numbers, False),
        "empty_bound": ~inclusive & (((kind == "upper_bound") & (bound <= least)) | ((kind == "lower_bound") & (bound >= most))),
        "unit_range": F.exists(numbers, lambda n: n < least) | (unit.isin("percent", "calendar_year") & F.exists(numbers, lambda n: n > most)),
        "probability_range": (unit == "probability") & F.exists(numbers, lambda n: n > 1),
        "integer_unit": unit.isin(*WHOLE) & F.exists(numbers, lambda n: n != F.floor(n)),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()]))


def decode_code(code: Column, fields: dict[str, int]) -> Column:
    """struct of the fields that a code given as text packs, lowest bits first; blank is missing, and 0 is a code like others."""
    plain = F.trim(code)
    number = F.when(plain.rlike("^[0-9]+$"), plain.try_cast("long"))
    out, at = [], 0
    for name, bits in fields.items():
        out.append(F.when(number < (1 << sum(fields.values())), F.call_function("shiftright", number, F.lit(at)).bitwiseAND((1 << bits) - 1)).alias(name))
        at += bits
    return F.struct(*out)


def graph_problems(graphs: DataFrame, edges: DataFrame, graph: str, nodes: str, source: str, target: str, most_nodes: int, most_edges: int) -> DataFrame:
    """(graph, nodes, edges, problem) of each graph: too_many_nodes, too_many_edges, out_of_bounds, or null.

    ``graphs`` has the number of ``nodes`` of each graph, ``edges`` the indexes of both ends. An index is out of
    bounds if it is null, negative or not below that number. Cycles, self edges and repeated edges are what
    a graph may have; graphs without edges are judged too.
    """
    beyond = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) >= F.col(nodes)), F.lit(True))
    met = edges.select(graph, source, target).join(graphs.select(graph, nodes), graph)
    counts = met.groupBy(graph).agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(beyond(source) | beyond(target), 1)).alias("_out"))
    all_ = graphs.select(graph, F.col(nodes).alias("nodes")).join(counts, graph, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    problem = F.when(F.col("nodes") > most_nodes, "too_many_nodes").when(F.col("edges") > most_edges, "too_many_edges").when(F.col("_out") > 0, "out_of_bounds")
    return all_.select(graph, "nodes", "edges", problem.alias("problem"))


def local_ids(ids: Column, artifact: Column, size: int = 12) -> Column:
    """Ids of nodes that hold within one artifact only, named by the artifact's digest."""
    return F.concat_ws(":", F.substring(F.sha2(artifact, 256), 1, size), ids.cast("string"))
