"""Five stages from raw documents to packed sequences.

Each stage takes all rows that the one before kept and writes them to the shared folder; an executor
that is lost costs the tasks of one stage at most. Rows with nulls, empty texts or repeated ids go
through every stage by the rules of its operator, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vivabank.llm import mixing, quality, simhash, toxicity
from vivabank.llm.queries import pieces_with_crc, table
from vivabank.sources.durable import durable
from vivabank.sources.shipping import ship_package

#: Documents go from this toxicity on, and below this quality. The second is low: a stage keeps what is not clearly bad.
TOXIC_FROM, QUALITY_BELOW = 0.3, 0.3
#: Documents are near copies when the fingerprints of their three-word shingles differ in at most so many bits.
SHINGLE_WORDS, MOST_BITS = 3, 3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below TOXIC_FROM; a null or empty text has the model's prior."""
    ship_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, accept=lambda score: score < TOXIC_FROM)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores from QUALITY_BELOW on; without labels of both classes all stay or all go."""
    ship_package(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, accept=lambda score: score >= QUALITY_BELOW)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id; texts without words are copies of each other."""
    ship_package(spark)
    return simhash.keep_one(docs, distance=MOST_BITS, words=SHINGLE_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, perhaps never."""
    ship_package(spark)
    return mixing.emit(mixing.mix(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as op5_packing gives them; an empty text is its end mark alone."""
    ship_package(spark)
    return pieces_with_crc(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers cannot be written in SQL; tests/llm/test_pipeline.py holds every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
