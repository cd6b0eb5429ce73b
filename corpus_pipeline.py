"""Corpus pipeline: toxicity, near copies, benchmark passages, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import decontamination, mixing, ngram_join, token_output, toxicity
from lanternfish.llm.common import fold_of, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the nearest labelled examples call toxic; learns from the same labels as the query of operator 5."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold_of("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, index)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies."""
    return ngram_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth or more."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: a document stands in the result as often as the mix takes it."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token files and returns what is read back from them."""
    return token_output.encoded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: The first stage is a learned model and the last a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + "".join(c for c in name if c.isalnum()))
    return STAGES[-1][1](spark, docs, sf_dir)
