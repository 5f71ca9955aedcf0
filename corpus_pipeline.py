"""The corpus pipeline: five stages over ``documents``, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each result to the shared
folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, jaccard, mixing, quality, toxicity
from orrery.llm.common import DOC_COLUMNS, read_table, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not too high for their language."""
    judged = quality.classify(docs, read_table(spark, sf_dir, "labels"), carry=DOC_COLUMNS)
    return judged.filter("keep").select("carried.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic."""
    judged = toxicity.flag(docs, read_table(spark, sf_dir, "labels"), carry=DOC_COLUMNS)
    return judged.filter("not is_toxic").select("carried.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs.select(*DOC_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out so that any prefix holds the sources by their weights."""
    return mixing.mixed(docs.select(*DOC_COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and decoded bytes."""
    return bpe.digests(bpe.decode(bpe.encode(docs, "doc_id", "text"), "doc_id"), "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", jaccard_join),
    ("mixing_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Trained models, sketches and merges are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
