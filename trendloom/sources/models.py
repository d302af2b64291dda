"""Fitted models as plain tables: vocabulary, singular values, factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trendloom.operators import block_svd, kmeans
from trendloom.operators.clustering import collect_centers
from trendloom.operators.svd import SvdModel
from trendloom.operators.tfidf import TERMS, Analyzer, TfidfModel


def save_tfidf(spark: SparkSession, model: TfidfModel, path: str) -> None:
    model.vocabulary(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
    size = spark.createDataFrame([(model.n_docs,)], "n_docs long")
    size.write.mode("overwrite").parquet(f"{path}/size")


def load_tfidf(spark: SparkSession, path: str, analyzer: Analyzer = TERMS) -> TfidfModel:
    """The analyzer is code, not data: pass the one the model was fitted with."""
    table = spark.read.parquet(f"{path}/vocabulary")
    n_docs = spark.read.parquet(f"{path}/size").first()["n_docs"]
    return TfidfModel(table, table.count(), n_docs, analyzer)


def save_svd(spark: SparkSession, model: SvdModel | block_svd.BlockModel, path: str) -> None:
    model.factors(spark).write.mode("overwrite").parquet(f"{path}/factors")
    model.singular_values(spark).write.mode("overwrite").parquet(f"{path}/singular_values")


def load_svd(spark: SparkSession, path: str) -> SvdModel | block_svd.BlockModel:
    """Factors that are small come as a matrix, others stay a table of blocks."""
    values = spark.read.parquet(f"{path}/singular_values").orderBy("component").toArrow()
    s = values.column("singular_value").to_numpy()
    factors = spark.read.parquet(f"{path}/factors")
    n_terms = factors.agg(F.count("*")).first()[0]
    if 8 * n_terms * len(s) > block_svd.SMALL_BYTES:
        return block_svd.from_factors(factors, s, n_terms)
    v = np.zeros((n_terms, len(s)))
    table = factors.toArrow()
    flat = table.column("v").combine_chunks().flatten().to_numpy()
    v[table.column("term_id").to_numpy()] = flat.reshape(-1, len(s))
    return SvdModel(v, s)


def save_kmeans(spark: SparkSession, model: kmeans.Model, path: str) -> None:
    kmeans.centers_frame(spark, model).write.mode("overwrite").parquet(path)


def load_kmeans(spark: SparkSession, path: str) -> kmeans.Model:
    return kmeans.Model(collect_centers(spark.read.parquet(path).orderBy("cluster"))[1])
