"""Name clusters after the nearest candidate topic in embedding space."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.fixed_values import CANDIDATE_TOPICS
from trendloom.functions.vectors import normalize_rows
from trendloom.operators import svd
from trendloom.operators.clustering import centroids
from trendloom.operators.tfidf import TfidfModel


def candidate_names(spark: SparkSession, names=CANDIDATE_TOPICS) -> DataFrame:
    numbers = pa.array(range(len(names)), pa.int32())
    return spark.createDataFrame(pa.table({"cand_id": numbers, "name": list(names)}))


def embed_names(
    names: DataFrame, tfidf: TfidfModel, factors: svd.SvdModel, whiten: bool = False
) -> DataFrame:
    """(cand_id, name, embedding): unit vectors of the names in document space.

    Names are projected without whitening unless asked for, although documents
    are whitened.
    """
    rows = tfidf.transform(names, "cand_id", "name")
    if whiten:
        placed = svd.whitened(rows, "cand_id", factors)
    else:
        placed = factors.project(rows, "cand_id")
    return names.join(normalize_rows(placed, "embedding"), "cand_id")


def unit_centroids(docs: DataFrame, vector: str, cluster: str) -> DataFrame:
    """(cluster, n, center): mean of the unit rows; clusters without rows are absent."""
    return centroids(normalize_rows(docs, vector), vector, cluster)


def similarity(centers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cluster, cand_id, similarity): cosine of every centre with every candidate.

    Both sides are scaled to length one and multiplied component by component,
    as a join on the component; a zero vector is similar to nothing.
    """
    left = normalize_rows(centers.select("cluster", "center"), "center").select(
        "cluster", F.posexplode("center").alias("component", "a")
    )
    right = normalize_rows(candidates.select("cand_id", "embedding"), "embedding").select(
        "cand_id", F.posexplode("embedding").alias("component", "b")
    )
    return (
        left.join(right, "component")
        .groupBy("cluster", "cand_id")
        .agg(F.sum(F.col("a") * F.col("b")).alias("similarity"))
    )


def zero_shot_labels(similarities: DataFrame, names: DataFrame, alternatives: int = 3) -> DataFrame:
    """(cluster, label_auto, label_alt): best name and the best three.

    Similarities count to nine decimals, equal ones go by candidate order.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("s"), "cand_id")
    best = (
        similarities.withColumn("s", F.round("similarity", 9))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= alternatives)
        .join(names.select("cand_id", "name"), "cand_id")
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "name")))
    return best.groupBy("cluster").agg(listed.alias("l")).select(
        "cluster",
        F.col("l")[0]["name"].alias("label_auto"),
        F.array_join(F.col("l.name"), ", ").alias("label_alt"),
    )
