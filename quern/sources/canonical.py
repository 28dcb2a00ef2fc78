"""The canonical interchange document: one strict JSON object with an array per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TS, _D = "timestamp", "date"
#: Columns of each array (fixed format).
ARRAYS = {
    "organizations": "slug string, name string, organization_type string, canonical_url string",
    "people": "slug string, display_name string, given_name string, family_name string, bio_short string, inclusion_reason string, cohort_tags array<string>, status string",
    "affiliations": f"person_slug string, organization_slug string, role string, start_date {_D}, end_date {_D}, source_slug string, confidence_level string, verification_detail string, review_state string, is_current boolean",
    "external_identities": f"person_slug string, namespace string, external_id string, canonical_url string, handle string, verification_method string, verification_detail string, confidence_level string, review_state string, verified_at {_TS}, source_slug string",
    "sources": f"slug string, source_type string, name string, canonical_url string, platform string, owner_person_slug string, owner_organization_slug string, collection_method string, collection_adapter string, rights_notes string, enabled boolean, review_state string, last_checked_at {_TS}, last_success_at {_TS}",
    "source_items": f"slug string, source_slug string, upstream_id string, logical_key string, canonical_url string, title string, published_at {_TS}, published_timezone string, observed_at {_TS}, updated_at_source {_TS}, language string, content_hash string, content_hash_input string, content_version int, content_reference string, metadata map<string,string>, collection_status string, availability string, is_current boolean, ingestion_run_slug string",
    "participants": "source_item_slug string, person_slug string, organization_slug string, role string, attribution_method string, attribution_detail string, confidence_level string",
    "evidence_segments": "slug string, source_item_slug string, segment_kind string, sequence int, start_char int, end_char int, start_ms int, end_ms int, text string, context_text string",
    "topics": "slug string, name string, definition string, parent_slug string, version string",
    "statements": f"slug string, person_slug string, source_item_slug string, statement_type string, normalized_text string, event_time {_TS}, evidence_slug string, extractor_version string, confidence double, review_state string, extraction_run_slug string, topic_slugs array<string>, topic_method string, topic_confidence double",
    "forecasts": f"statement_slug string, forecast_kind string, question_key string, question_text string, definition_text string, condition_text string, target_date_start {_D}, target_date_end {_D}, horizon_text string, value_type string, value_text string, value_numeric double, value_min double, value_max double, unit string, distribution map<string,string>, resolution_criteria string, review_state string",
    "relationships": "from_statement_slug string, to_statement_slug string, relationship_type string, method string, confidence double, review_state string",
    "cohorts": "slug string, version string, name string, definition string, member_slugs array<string>",
    "ingestion_runs": f"slug string, collector string, source_slug string, started_at {_TS}, completed_at {_TS}, status string, cursor_before string, cursor_after string, observed_count int, new_count int, changed_count int, unchanged_count int, skipped_count int, failed_count int, error_summary string",
    "extraction_runs": f"slug string, source_item_slug string, extractor_name string, extractor_version string, model_provider string, model_name string, prompt_contract_version string, started_at {_TS}, completed_at {_TS}, status string, input_hash string, output_hash string",
    "trend_definitions": "slug string, name string, topic_slug string, method_version string, cohort_slug string, cohort_version string, cohort_definition string, aggregation map<string,string>, published boolean",
}
HEADER = "schema_version string, dataset_id string, dataset_kind string, generated_at timestamp, notice string, producer struct<name:string,version:string>"
SCHEMA_VERSION = "1.0.0"


def schema() -> StructType:
    body = ", ".join(f"{n} array<struct<{', '.join(f'{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}' for c in _columns(s))}>>" for n, s in ARRAYS.items())
    return StructType.fromDDL(f"{HEADER}, {body}")


def _columns(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a document. Unreadable values and wrong versions fail; unknown keys are listed in ``unexpected``."""
    doc = spark.read.schema(schema()).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if (n := doc.where(F.col("schema_version") != SCHEMA_VERSION).limit(1).count()) > 0:
        raise ValueError(f"{n} document has another schema version")
    tables = {n: doc.select(F.explode(n).alias("r")).select("r.*") for n in ARRAYS}
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.json_object_keys("value")).alias("key"))
    tables["unexpected"] = raw.where(~F.col("key").isin([f.name for f in schema().fields]))
    return tables


def broken_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, key, code) of each row that breaks a rule of the format."""
    s, f, i = tables["statements"], tables["forecasts"], tables["source_items"]

    def row(df: DataFrame, table: str, key: str, code: str) -> DataFrame:
        return df.select(F.lit(table).alias("table"), F.col(key).alias("key"), F.lit(code).alias("code"))

    numbers = F.col("value_numeric").isNotNull() | F.col("value_min").isNotNull() | F.col("value_max").isNotNull()
    typed = f.join(s.select(F.col("slug").alias("statement_slug"), "statement_type"), "statement_slug", "left")
    explicit = F.col("statement_type") == "explicit_numeric"
    probability = F.col("unit") == "probability"
    outside = F.exists(F.array("value_numeric", "value_min", "value_max"), lambda v: (v < 0) | (v > 1))
    current = i.where("is_current").groupBy("source_slug", "logical_key").agg(F.count(F.lit(1)).alias("n"), F.min("slug").alias("slug")).where("n > 1")
    slugs = s.where(~F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") | (F.length("slug") > 80))
    parts = [
        row(slugs, "statements", "slug", "bad_slug"),
        row(typed.where("statement_type is null"), "forecasts", "statement_slug", "no_statement"),
        row(typed.where(explicit & ~numbers), "forecasts", "statement_slug", "number_missing"),
        row(typed.where(~explicit & numbers), "forecasts", "statement_slug", "number_not_allowed"),
        row(f.where("value_min > value_max"), "forecasts", "statement_slug", "range_order"),
        row(f.where(probability & outside), "forecasts", "statement_slug", "probability_range"),
        row(current, "source_items", "slug", "several_current_versions"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
