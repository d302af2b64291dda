"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor wrote: quality rules drop repetitive texts,
exact and near duplicates go down to one document each, sources are mixed to their
target weights (a document may come twice), and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm.dart_minhash import drop_near_duplicates
from trendloom.llm.exact_dedup import drop_duplicates
from trendloom.llm.pareto_mix import mixed_documents
from trendloom.llm.repetition import good_documents
from trendloom.llm.variable_packing import packed_documents
from trendloom.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: SQL can't express near duplicates by signatures, nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs
