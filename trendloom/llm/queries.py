"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trendloom.llm import (
    credential_links,
    dart_minhash,
    exact_dedup,
    hard_negatives,
    pareto_mix,
    rank_order_language,
    ranked_search,
    repetition,
    suffix_dedup,
    token_counts,
    token_packing,
    toxicity_neighbours,
    variable_packing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_order_language.identify(documents(spark, sf_dir))


@query
def op4_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.digests(token_packing.write_packed(documents(spark, sf_dir)))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity_neighbours.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_neighbours.score(docs, model).select(
        "doc_id", rank_order_language.held_out().alias("held_out"), "score", "predicted",
        "evidence_ids", "evidence_similarity",
    )


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(documents(spark, sf_dir))


@query
def op7_variable_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variable_packing.packed_documents(documents(spark, sf_dir))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(documents(spark, sf_dir)).drop("node")


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.cut_repeats(documents(spark, sf_dir)))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector gets a wrong label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(
        F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.whole_numbers("embedding").alias("vector")
    )
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_links.digests(credential_links.credentials(documents(spark, sf_dir)))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
