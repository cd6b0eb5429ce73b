"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("centroid_clustering", "decontamination", "importance_resampling", "licenses", "mixing", "ngram_join", "pii", "quality_classifier", "quality_rules", "simhash_dedup", "token_output", "toxicity", "url_filters")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"lanternfish.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"lanternfish.llm.{m}").ORACLE_SQL.items()}
