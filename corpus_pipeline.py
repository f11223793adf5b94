"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Every stage takes the columns of `documents` and, but for the last, returns them.  ORACLE_SQL is None: trained scores,
near copies and tokens have no SQL; tests/llm compares the stages with plain versions on small data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hiresift.llm import decontaminate, near_dedup, packing, quality, toxicity
from hiresift.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model rejects go; it is trained on all labels of the documents at hand."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the ranking's threshold go."""
    return quality.reject_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows that hold the sources in proportion."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack_mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
