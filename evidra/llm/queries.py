"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_PLACES = {
    "op1_top_k": "topk",
    "op2_near_duplicates": "near_duplicates",
    "op3_best_fit_packing": "packing",
    "op4_license_scan": "licenses",
    "op5_toxicity": "toxicity",
    "op6_fingerprints": "fingerprints",
    "op7_quality_classifier": "quality",
    "op8_token_counts": "token_counts",
    "op9_site_style": "site_style",
    "op10_byte_bpe": "bpe",
    "op11_source_mix": "mixing",
    "op12_spelling_variants": "spelling",
    "op13_embedding_whitening": "whitening",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"evidra.llm.{place}"), name) for name, place in _PLACES.items()}


def oracle_sql() -> dict[str, str]:
    from evidra.llm import licenses, mixing, topk

    return {"op1_top_k": topk.SQL, "op4_license_scan": licenses.SQL, "op11_source_mix": mixing.SQL}
