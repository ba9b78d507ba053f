"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "license_scan",
    "minhash_forest",
    "rare_digest",
    "arc_convert",
    "lattice_lm",
    "window_packing",
    "byte_cnn",
    "line_rules",
    "merge_prefix",
    "token_store",
    "collocations",
    "source_audit",
    "fm_dedup",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= import_module(f"{__package__}.{m}").QUERIES
    import corpus_pipeline

    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), "ORACLE", {})
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
