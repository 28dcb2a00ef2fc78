"""Bundle rules: each code has a record that breaks it and one that does not."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.operators import bundles

D = dt.date


def codes(df):
    return {(r.id, r.code) for r in df.collect()}


def test_closure_with_a_cycle_a_gap_and_a_late_revision(spark):
    refs = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 3, 1), (3, 1, 1, 1), (3, 1, 4, 1), (4, 1, 9, 1), (2, 1, 5, 2), (7, 1, 7, 1)], "id int, revision int, to_id int, to_revision int")
    records = spark.createDataFrame([(i, 1, D(2024, 1, 1)) for i in (1, 2, 3, 4, 7)] + [(5, 2, D(2025, 1, 1))], "id int, revision int, known_at date")
    seeds = spark.createDataFrame([("x", 1, 1), ("y", 3, 1), ("z", 7, 1), ("z", 8, 1), ("w", 5, 2)], "b string, id int, revision int")
    got = {(r.b, r.id, r.depth) for r in bundles.closure(seeds, refs, records, "b", F.lit(D(2024, 6, 1))).collect()}
    assert got == {("x", 1, 0), ("x", 2, 1), ("x", 3, 2), ("x", 4, 3), ("y", 3, 0), ("y", 1, 1), ("y", 4, 1), ("y", 2, 2), ("z", 7, 0)}
    assert bundles.closure(seeds.limit(0), refs, records, "b", F.lit(D(2024, 6, 1))).count() == 0


def test_translations(spark):
    artifacts = spark.createDataFrame([(1, 1, None, None), (2, 1, 1, 1), (3, 1, 2, 1), (4, 2, 4, 1), (4, 1, None, None), (5, 1, 99, 1)], "id int, revision int, original_id int, original_revision int")
    statements = spark.createDataFrame([(10, 1, 2, 1), (11, 1, 1, 1), (12, 1, 2, 1), (13, 1, None, None)], "id int, revision int, translation_id int, translation_revision int")
    evidence = spark.createDataFrame([(10, 1, 1, 1), (12, 1, 3, 1)], "id int, revision int, source_id int, source_revision int")
    assert codes(bundles.translation_errors(artifacts, statements, evidence)) == {(3, "translation_lineage"), (4, "translation_lineage"), (11, "translation_type"), (12, "translation_evidence")}


def test_aggregates(spark):
    actors = spark.createDataFrame([(1, 1, "collective"), (2, 1, "organization"), (3, 1, "person")], "id int, revision int, actor_kind string")
    rows = [
        (10, "source_aggregate", "median", 1, 2, [1]),  # right
        (11, "source_aggregate", None, 1, 2, [1]),
        (12, "none", "mean", None, None, [3]),
        (13, "none", None, None, None, [1]),
        (14, "source_aggregate", "median", None, None, [3]),
        (15, "mean", "mean", 1, 2, [3]),
        (16, "source_aggregate", "median", 3, 2, [3]),
        (17, "source_aggregate", "median", 1, 1, [1]),
        (18, "source_aggregate", "median", 1, 2, [1, 3]),
        (19, "none", None, None, None, [3]),  # right
    ]
    one = lambda x: None if x is None else 1
    forecasts = spark.createDataFrame([(i, 1, a, m, p, one(p), g, one(g)) for i, a, m, p, g, _ in rows], "id int, revision int, aggregation string, method string, population_id int, population_revision int, aggregator_id int, aggregator_revision int")
    forecasters = spark.createDataFrame([(r[0], 1, x, 1) for r in rows for x in r[5]], "id int, revision int, actor_id int, actor_revision int")
    assert codes(bundles.aggregate_errors(forecasts, forecasters, actors)) == {
        (11, "aggregation_method"), (12, "aggregation_method"), (13, "collective_aggregate"), (14, "aggregate_context"), (15, "aggregate_context"), (16, "aggregate_population"),
        (17, "aggregate_publisher"), (17, "aggregate_attribution"), (18, "aggregate_attribution"),
    }


def one_row(spark, rule, schema, values):
    df = spark.createDataFrame(values, schema)
    return [r.c for r in df.coalesce(1).select(rule(*[F.col(c) for c in df.columns]).alias("c")).collect()]


@pytest.mark.parametrize(
    "values,want",
    [
        (("resolved", "boolean", D(2024, 1, 1), 1, "human_verified", D(2024, 2, 1), "probability"), []),
        (("resolved", None, D(2024, 1, 1), 1, "human_verified", D(2024, 2, 1), "date"), ["resolution_state"]),
        (("open", "boolean", None, 0, "draft", D(2024, 2, 1), "probability"), ["resolution_state"]),
        (("void", None, None, 0, "draft", D(2024, 2, 1), "probability"), []),
        (("resolved", "boolean", D(2024, 1, 1), 0, "human_verified", D(2024, 2, 1), "probability"), ["resolution_review"]),
        (("resolved", "boolean", D(2024, 3, 1), 1, "draft", D(2024, 2, 1), "probability"), ["resolution_review", "resolution_time"]),
        (("resolved", "point", D(2024, 1, 1), 1, "human_verified", D(2024, 2, 1), "probability"), ["resolution_outcome"]),
        (("resolved", "interval", D(2024, 1, 1), 1, "human_verified", D(2024, 2, 1), "quantity"), ["resolution_outcome"]),
        (("resolved", "missing", D(2024, 1, 1), 1, "human_verified", D(2024, 2, 1), "date"), ["resolution_outcome"]),
    ],
)
def test_resolutions(spark, values, want):
    assert one_row(spark, bundles.resolution_errors, "a string, b string, c date, d int, e string, f date, g string", [values]) == [want]


def test_answers(spark):
    day, later = D(2024, 1, 1), D(2024, 5, 1)
    cases = [
        (("probability", "probability", "point", "probability", "explicit_numeric", day, later), []),
        (("probability", "probability", "point", "percent", "explicit_numeric", day, later), ["answer_domain"]),
        (("quantity", None, "point", None, "explicit_numeric", None, later), []),
        (("date", None, "date_point", None, "explicit_numeric", later, day), ["forecast_time"]),
        (("date", None, "point", "years", "explicit_numeric", day, later), ["answer_domain"]),
        (("date", None, "point", None, "explicit_numeric", day, later), ["answer_domain"]),
        (("date", None, "point", "calendar_year", "explicit_qualitative", day, later), ["invented_precision"]),
        (("qualitative", None, "category", None, "explicit_numeric", day, later), ["forecast_origin"]),
        (("qualitative", None, "point", None, "other", day, later), ["answer_domain"]),
        (("date", None, "missing", None, "explicit_qualitative", day, later), []),
    ]
    got = one_row(spark, bundles.answer_errors, "a string, b string, c string, d string, e string, f date, g date", [v for v, _ in cases])
    assert got == [w for _, w in cases]


def test_measurements_and_kinds(spark):
    cases = [
        (("point", "hours", [5.0], None, "hours", 0.0, 10.0), []),
        (("category", "hours", None, None, "hours", 0.0, 10.0), ["measurement_type"]),
        (("point", "days", [5.0], None, "hours", None, None), ["metric_unit"]),
        (("upper_bound", "hours", [0.0], False, "hours", 0.0, 10.0), ["empty_bound"]),
        (("interval", "hours", [5.0, 11.0], None, "hours", 0.0, 10.0), ["metric_scale"]),
        (("missing", None, None, None, "hours", 9.0, 1.0), ["metric_scale"]),
    ]
    got = one_row(spark, bundles.measurement_errors, "a string, b string, c array<double>, d boolean, e string, f double, g double", [v for v, _ in cases])
    assert got == [w for _, w in cases]
    n = None
    cases = [
        (("forecast_question", "probability", "probability", n, n, n, n, n, n, n, n, n), []),
        (("forecast_question", "date", "years", n, n, n, n, n, n, n, n, n), ["question_unit"]),
        (("forecast_question", "probability", "percent", n, n, n, n, n, n, n, n, n), ["question_unit"]),
        (("actor", n, n, "person", True, n, n, n, n, n, n, n), ["collective_identity"]),
        (("actor", n, n, "collective", True, n, n, n, n, n, n, n), []),
        (("resource_observation", n, n, n, n, "currency_constant", "constant", n, n, n, n, n), ["currency_basis"]),
        (("resource_observation", n, n, n, n, "currency_nominal", "nominal", n, n, n, n, n), []),
        (("resource_observation", n, n, n, n, "hours", "nominal", n, n, n, n, n), ["currency_basis"]),
        (("benchmark_run", n, n, n, n, n, n, n, n, True, n, n), ["evaluation_time"]),
        (("safety_evaluation", n, n, n, n, "hours", n, n, D(2024, 1, 1), True, "point", "days"), ["threshold_unit"]),
        (("safety_evaluation", n, n, n, n, "hours", n, n, n, False, "point", "hours"), []),
    ]
    got = one_row(spark, bundles.kind_errors, "a string, b string, c string, d string, e boolean, f string, g string, h int, i date, j boolean, k string, l string", [v for v, _ in cases])
    assert got == [w for _, w in cases]


def test_digests_in_bytes(spark):
    """Bytes are equal just where the texts are, and those of a hexadecimal digest are short."""
    texts = ["", "ab", "AB", "abc", "ab\n", "x", "\u0001", "\u0000", "é", "00", "0001", "a" * 64, "a" * 63 + "b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", bundles.digest(F.col("t")).alias("d"))
    got = [r.d if r.d is None else bytes(r.d) for r in df.orderBy("i").collect()]
    assert got[-1] is None and len(set(got)) == len(texts) and len(got[11]) == 33


def test_snapshot_digests_travel_once(spark):
    """Digests of any text are told apart, a null one breaks no rule, and none is shuffled to the snapshots."""
    day = D(2024, 1, 1)
    snapshots = spark.createDataFrame([(1, True, day, day, day)], "snapshot int, as_known boolean, cutoff date, created_at date, known_at date")
    names = [("AB", "ab"), ("ab", "ab"), ("x", "y"), ("x", "x"), (None, "ab"), ("abc", None)]
    members = spark.createDataFrame([(1, i, 1, m) for i, (m, _) in enumerate(names)] + [(1, 1, 1, "ab"), (1, 99, 1, "ab")], "snapshot int, id int, revision int, sha256 string")
    records = spark.createDataFrame([(i, 1, "statement", day, None, None, r) for i, (_, r) in enumerate(names)], "id int, revision int, kind string, known_at date, reviewed_at date, latest date, sha256 string")
    references = spark.createDataFrame([(0, 1, 1, 1), (2, 1, 77, 1), (99, 1, 77, 1)], "id int, revision int, to_id int, to_revision int")
    out = bundles.snapshot_errors(snapshots, members, records, references)
    assert sorted((r.id if r.id is not None else -1, r.code) for r in out.collect()) == [(-1, "snapshot_duplicate"), (0, "snapshot_hash"), (2, "snapshot_closure"), (2, "snapshot_hash")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    compared = [line.split("Project [")[1].split(", ") for line in plan.splitlines() if "Project [" in line and " AS _differs" in line]
    assert compared and not any(c.startswith(("_own#", "_digest#", "sha256#")) for columns in compared for c in columns)
