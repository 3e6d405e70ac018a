"""A corpus pipeline of five stages, each one an operator of ``lamina.llm`` over all its predecessor kept.

The first four return the columns of documents; the last returns the token table's documents. A
mixed document stands as many times as it is taken. SQL cannot express the stages, so the pipeline
is tested against a brute-force version, ``tests/llm/test_pipeline.py``.

Rows with null ids, null or empty texts, ties, repeated rows, very long texts, empty tables and
extra columns of any name are treated as each stage's operator says. Extra columns stay as they
are up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, jaccard, mixing, quality, queries, token_table
from lamina.llm.common import cleared, dropped, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.kept_documents(docs, queries.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's target asks."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table, read back."""
    return token_table.tokens_round_trip(docs, queries.tokenizer_path(), queries.END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_weights),
    ("token-ID / binary output", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again; what a stage has used up is deleted."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with cleared():
            docs = written(stage(spark, docs, sf_dir), f"stage-{i}", keep=True)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
