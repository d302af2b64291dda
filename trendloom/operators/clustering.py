"""K-means on unit rows, choice of K by cosine silhouette, cluster reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.vectors import nearest_row, normalize_rows, products, stacked
from trendloom.operators import kmeans
from trendloom.operators.sampling import hash_sample

SWEEP_GRID = (40, 50, 60, 80)
SCOUT_GRID = (70, 80, 90, 100, 120, 140, 160)
SCOUT_ROWS = 300_000
RESTARTS = 10
# Starts compared by their cost before the one run of a sweep or a scout.
STARTS = 10
TOP_TERMS = 12


def as_features(unit: DataFrame, vector: str = "embedding") -> DataFrame:
    return unit.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_kmeans(features: DataFrame, k: int, seed: int = 0, max_iter: int = 300) -> KMeansModel:
    """Lloyd's algorithm from a k-means|| start, Euclidean distance on unit rows.

    The cosine variant would rescale the centres to length one; the means of
    unit rows are wanted as they are.
    """
    return KMeans(
        k=k, seed=seed, maxIter=max_iter, tol=1e-4, distanceMeasure="euclidean"
    ).fit(features)


def collect_centers(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and matrix of a (cluster, center) table: model state, K rows."""
    table = centers.select("cluster", F.col("center").cast("array<double>")).toArrow()
    if table.num_rows == 0:
        raise ValueError("no cluster centres")
    return (
        table.column("cluster").to_numpy().astype(np.int32),
        np.array(table.column("center").to_pylist(), dtype=np.float64),
    )


def assign_nearest(df: DataFrame, vector: str, centers: DataFrame) -> DataFrame:
    """Add (cluster, distance) of the nearest given centre, squared distance."""
    keys, matrix = collect_centers(centers)
    found = df.withColumn("_near", nearest_row(F.col(vector), keys, matrix))
    return found.select(
        *df.columns,
        F.col("_near.key").alias("cluster"),
        F.col("_near.distance").alias("distance"),
    )


def centroids(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """(cluster, n, center): the mean row of every cluster.

    One vector accumulator per cluster and task, merged in the shuffle: a
    cluster with a third of the rows costs nothing extra.
    """
    rows = df.select(
        F.col(cluster).alias("cluster"),
        array_to_vector(F.col(vector).cast("array<double>")).alias("_v"),
    )
    return (
        rows.groupBy("cluster")
        .agg(F.count("*").alias("n"), Summarizer.mean(F.col("_v")).alias("_mean"))
        .select("cluster", "n", vector_to_array("_mean").alias("center"))
    )


def lloyd_step(df: DataFrame, vector: str, centers: DataFrame) -> DataFrame:
    """New centres after assigning every row to its nearest given centre."""
    return centroids(assign_nearest(df, vector, centers), vector, "cluster")


def silhouettes(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Add the exact cosine silhouette of every row.

    For unit rows the mean cosine distance to a cluster follows from the sum of
    its rows, so each row needs K products instead of one per other row.
    """
    unit = normalize_rows(df, vector)
    sums = centroids(unit, vector, cluster).withColumn(
        "center", F.transform("center", lambda x: x * F.col("n"))
    )
    table = sums.toArrow()
    if table.num_rows < 2:
        raise ValueError("silhouettes need at least two clusters")
    total = np.array(table.column("center").to_pylist(), dtype=np.float64)
    size = table.column("n").to_numpy().astype(np.float64)
    keys = table.column("cluster").to_pylist()
    place = {key: i for i, key in enumerate(keys)}

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, own in batches:
            x = stacked(rows, total.shape[1])
            at = own.map(place).to_numpy(dtype=np.int64)
            each = np.arange(len(x))
            distance = size - x @ total.T
            others = size[at] - 1.0
            inside = distance[each, at] - (1.0 - (x * x).sum(axis=1))
            inside = inside / np.maximum(others, 1.0)
            distance = distance / size
            distance[each, at] = np.inf
            outside = distance.min(axis=1)
            larger = np.maximum(inside, outside)
            value = np.where(larger > 0, (outside - inside) / np.where(larger > 0, larger, 1), 0)
            yield pd.Series(np.where(others > 0, value, 0.0))

    return unit.withColumn("silhouette", score(F.col(vector), F.col(cluster)))


def silhouette_score(df: DataFrame, vector: str, cluster: str) -> float:
    """Mean silhouette over all rows; a zero row is at distance one from every row."""
    return silhouettes(df, vector, cluster).agg(F.avg("silhouette")).first()[0]


@dataclass
class Sweep:
    """Silhouette per K and the model of the best K; the first K wins a tie."""

    scores: list[tuple[int, float]]
    model: kmeans.Model
    k: int

    def frame(self, spark) -> DataFrame:
        rows = [(k, score, k == self.k) for k, score in self.scores]
        return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


def choose_k(unit: DataFrame, vector: str, models: dict[int, kmeans.Model]) -> Sweep:
    """Score every model on all rows, keep the one with the best silhouette."""
    scores = []
    for k, model in models.items():
        clustered = kmeans.assign(unit.select(vector), vector, model)
        scores.append((k, silhouette_score(clustered, vector, "cluster")))
    best = max(scores, key=lambda score: (score[1], -scores.index(score)))[0]
    return Sweep(scores, models[best], best)


def sweep_k(
    unit: DataFrame,
    id_column: str,
    vector: str = "embedding",
    grid=SWEEP_GRID,
    starts: int = STARTS,
    seed: int = 0,
    max_iter: int = kmeans.MAX_ITER,
) -> Sweep:
    """Fit every K on all rows, from the cheapest of several starts, and choose by silhouette.

    One scan compares the starts of all K, and one scan per step moves the models of all K.
    """
    best = kmeans.best_starts(unit, vector, kmeans.starts_for(unit, id_column, vector, grid, starts, seed))
    fitted = kmeans.lloyd(unit, vector, [best[k].centers for k in grid], max_iter)
    return choose_k(unit, vector, dict(zip(grid, fitted)))


def scout_k(
    unit: DataFrame,
    id_column: str,
    vector: str = "embedding",
    grid=SCOUT_GRID,
    rows: int = SCOUT_ROWS,
    seed: int = 0,
    batch_rows: int = kmeans.BATCH_ROWS,
    epochs: int = kmeans.EPOCHS,
) -> Sweep:
    """A quick look at a K grid on a uniform sample of rows, by mini-batches."""
    picked = hash_sample(unit.select(id_column, vector), id_column, rows, seed)
    picked = picked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = kmeans.best_starts(picked, vector, kmeans.starts_for(picked, id_column, vector, grid, STARTS, seed))
        models = kmeans.minibatch(
            picked, id_column, vector, [best[k].centers for k in grid], batch_rows, epochs, seed=seed
        )
        return choose_k(picked, vector, dict(zip(grid, models)))
    finally:
        picked.unpersist()


def cluster_sizes(df: DataFrame, cluster: str = "cluster", top: int | None = 10) -> DataFrame:
    """(cluster, n), largest first; equal sizes by cluster id."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n")).orderBy(F.desc("n"), cluster)
    return sizes if top is None else sizes.limit(top)


def term_weights(factors: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster, term_id, weight): centres mapped back to term space.

    The factor table stays where it is; each of its rows meets the K centres.
    """
    keys, matrix = collect_centers(centers)
    weighted = factors.select("term_id", products(F.col("v"), matrix).alias("_w"))
    ids = F.array(*[F.lit(int(key)) for key in keys])
    pairs = F.arrays_zip(ids.alias("cluster"), F.col("_w").alias("weight"))
    return weighted.select("term_id", F.inline(pairs).alias("cluster", "weight")).select(
        "cluster", "term_id", "weight"
    )


def top_terms(weights: DataFrame, vocabulary: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(cluster, top_terms): the heaviest terms of each cluster, comma-joined.

    Weights count to nine decimals, equal ones go by term id, which is the
    alphabetical order.  Names are looked up for the chosen terms only.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("w"), "term_id")
    best = (
        weights.withColumn("w", F.round("weight", 9))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)
        .join(vocabulary.select("term_id", "term"), "term_id")
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "term")))
    return best.groupBy("cluster").agg(listed.alias("l")).select(
        "cluster", F.array_join(F.col("l.term"), ", ").alias("top_terms")
    )
