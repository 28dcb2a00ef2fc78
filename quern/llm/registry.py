"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quern.llm import bpe, centroids, decontaminate, fingerprints, language, licenses, minhash, pii, resample, sharding, simhash, suffix_dedup, token_counts


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_licenses": licenses.op1_licenses,
        "op2_language": language.op2_language,
        "op3_pii": pii.op3_pii,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_sharding": sharding.op9_sharding,
        "op10_simhash": simhash.op10_simhash,
        "op11_centroids": centroids.op11_centroids,
        "op12_resample": resample.op12_resample,
        "op13_minhash": minhash.op13_minhash,
    }


def oracle_sql():
    found = {"op1_licenses": licenses.op1_sql(), "op11_centroids": centroids.op11_sql(), "op13_minhash": minhash.op13_sql()}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
