"""All registered queries of the audit engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternfish.plans import crawl_queries, golden_queries, page_queries, score_queries

MODULES = (page_queries, score_queries, golden_queries, crawl_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all sites by page rules: one pass over the pages, then one fold."""
    return page_queries.crawl_issues(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
