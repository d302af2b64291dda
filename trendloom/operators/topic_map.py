"""A two-dimensional map of documents, or of a sample of them.

Nearest neighbours by cosine, the fuzzy neighbour graph of McInnes, Healy and
Melville (2018), and a spectral layout of that graph, which ``layout`` refines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.vectors import normalize_rows
from trendloom.operators import cells, layout, svd
from trendloom.operators.cells import NEIGHBORS
from trendloom.operators.sampling import hash_sample
from trendloom.session import materialize

# A sample for a chart, where one is wanted.
SAMPLE_ROWS = 200_000
# A bound for exact neighbours, where they are not wanted for any number of rows.
EXACT_ROWS = 50_000
LEGEND_TOP = 12
PALETTE = 20
INDEX_BUCKETS = 256


def nearest_neighbors(
    df: DataFrame, id_column: str, vector: str, k: int = NEIGHBORS, block_rows: int = cells.HELD_ROWS
) -> DataFrame:
    """(id, neighbor, distance, place): the k nearest other rows by cosine distance, exact.

    Rows are hashed into blocks of bounded size; a task holds a block while a share of all
    rows goes by, and passes on only the k best per row.  Distances count to nine
    decimals, equal ones go by id.
    """
    unit = normalize_rows(df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")), "v")
    return cells.k_nearest(cells.nearest_of_all(unit, unit, k, block_rows), k)


def _memberships(distances: np.ndarray, target: float) -> np.ndarray:
    """Membership of each neighbour: exp(-(d - rho) / sigma), rows sum to ``target``.

    ``distances`` is padded with infinity.  Sigma is found by bisection for all
    rows of the batch at once.
    """
    known = np.isfinite(distances)
    positive = np.where(known & (distances > 0), distances, np.inf)
    rho = positive.min(axis=1)
    rho[~np.isfinite(rho)] = 0.0
    beyond = np.where(known, np.maximum(distances - rho[:, None], 0.0), np.inf)
    low, high = np.zeros(len(rho)), np.full(len(rho), np.inf)
    sigma = np.ones(len(rho))
    for _ in range(64):
        total = np.exp(-beyond / sigma[:, None]).sum(axis=1)
        above = total > target
        high = np.where(above, sigma, high)
        low = np.where(above, low, sigma)
        doubled = np.isinf(high)
        sigma = np.where(doubled, sigma * 2, (low + np.where(doubled, 0, high)) / 2)
        sigma = np.clip(sigma, 1e-12, 1e12)
    mean = np.where(known, distances, 0.0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    sigma = np.maximum(sigma, 1e-3 * np.maximum(mean, 1e-12))
    return np.exp(-beyond / sigma[:, None])


def fuzzy_graph(neighbors: DataFrame, k: int = NEIGHBORS) -> DataFrame:
    """(src, dst, weight), symmetric: the union a + b - ab of both directions."""
    id_type = neighbors.schema["id"].dataType.simpleString()
    listed = F.sort_array(F.collect_list(F.struct("place", "neighbor", "distance")))
    rows = neighbors.groupBy("id").agg(listed.alias("l")).select(
        "id", F.col("l.neighbor").alias("n"), F.col("l.distance").alias("d")
    )
    target = math.log2(k)

    @F.pandas_udf("array<double>")
    def memberships(batch: pd.Series) -> pd.Series:
        lengths = [len(d) for d in batch]
        padded = np.full((len(batch), max(lengths, default=0)), np.inf)
        for i, d in enumerate(batch):
            padded[i, : len(d)] = d
        values = _memberships(padded, target) if len(batch) else padded
        return pd.Series([v[:n] for v, n in zip(values, lengths)])

    rows = rows.withColumn("w", memberships("d"))
    pairs = rows.select("id", F.inline(F.arrays_zip("n", "w")).alias("other", "w"))
    pairs = pairs.filter(F.col("w") > 0)
    both = pairs.select(F.col("id").alias("src"), F.col("other").alias("dst"), "w").unionByName(
        pairs.select(
            F.col("other").cast(id_type).alias("src"), F.col("id").alias("dst"), "w"
        )
    )
    once = F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(F.lit(0.0))
    return both.groupBy("src", "dst").agg((F.sum("w") - once).alias("weight"))


def dense_index(ids: DataFrame, id_column: str) -> DataFrame:
    """(id, index): numbers 0..n-1, counted bucket by bucket instead of in one task."""
    bucket = F.pmod(F.xxhash64(F.col(id_column)), F.lit(INDEX_BUCKETS)).cast("int")
    keyed = ids.select(id_column, bucket.alias("_bucket"))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_bucket")) - F.col("_n")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(id_column)) - 1
    return (
        keyed.withColumn("_place", place)
        .join(sizes.select("_bucket", before.alias("_before")), "_bucket")
        .select(id_column, (F.col("_place") + F.col("_before")).cast("int").alias("index"))
    )


def spectral_layout(graph: DataFrame, seed: int = 0, n_iter: int = 20) -> DataFrame:
    """(id, x, y): the two leading non-trivial eigenvectors of the normalised graph.

    The identity is added so that all eigenvalues are non-negative; the sparse
    SVD then finds the eigenvectors.  The largest coordinate is scaled to 10.
    """
    index = materialize(dense_index(graph.select(F.col("src").alias("id")).distinct(), "id"), "index")
    degree = graph.groupBy("src").agg(F.sum("weight").alias("degree"))
    place = index.join(degree, F.col("id") == F.col("src")).select("id", "index", "degree")
    source = place.select(F.col("id").alias("src"), F.col("degree").alias("src_degree"))
    target = place.select(
        F.col("id").alias("dst"), F.col("index").alias("term_id"), F.col("degree").alias("dst_degree")
    )
    scaled = graph.join(source, "src").join(target, "dst").select(
        F.col("src").alias("id"),
        "term_id",
        (F.col("weight") / F.sqrt(F.col("src_degree") * F.col("dst_degree"))).alias("weight"),
    )
    diagonal = index.select("id", F.col("index").alias("term_id"), F.lit(1.0).alias("weight"))
    listed = F.sort_array(F.collect_list(F.struct("term_id", "weight")))
    rows = (
        scaled.unionByName(diagonal)
        .groupBy("id")
        .agg(listed.alias("l"))
        .select("id", F.col("l.term_id").alias("term_ids"), F.col("l.weight").alias("weights"))
    )
    rows = materialize(rows, "graph")
    model = svd.truncated_svd(rows, index.count(), 3, n_iter, seed)
    axes = model.v[:, 1:3]
    scale = 10.0 / max(np.abs(axes).max(initial=0.0), 1e-300)
    placed = svd.project(rows, "id", axes, scale / np.maximum(model.s[1:3], 1e-300))
    return placed.select(
        "id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y")
    )


def largest_clusters(
    sample: DataFrame, labels: DataFrame | None = None, top: int = LEGEND_TOP
) -> DataFrame:
    """(cluster, n, label): the largest clusters of the sample, named ``id: label``."""
    sizes = (
        sample.groupBy("cluster")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "cluster")
        .limit(top)
    )
    identity = F.col("cluster").cast("string")
    if labels is None:
        return sizes.withColumn("label", F.concat(identity, F.lit(": "), identity))
    named = sizes.join(labels.select("cluster", "label_auto"), "cluster", "left")
    label = F.concat(identity, F.lit(": "), F.coalesce("label_auto", identity))
    return named.select("cluster", "n", label.alias("label"))


def cluster_colors(meta: DataFrame) -> DataFrame:
    """(cluster, color): position of the id among all cluster ids, cycling."""
    ids = meta.select("cluster").filter(F.col("cluster").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("cluster")) - 1
    return ids.select("cluster", (place % PALETTE).alias("color"))


def topic_map(
    docs: DataFrame,
    id_column: str,
    vector: str,
    labels: DataFrame | None = None,
    sample_rows: int | None = None,
    k: int = NEIGHBORS,
    seed: int = 0,
    steps: int = 0,
    exact_rows: int | None = None,
) -> DataFrame:
    """(id, x, y, cluster, label, color) of all ``docs``, or of a uniform sample of them.

    The spectral layout, refined by so many ``steps``.  Neighbours are exact however many
    rows there are, unless ``exact_rows`` is given: more rows than that look into near cells.
    """
    sample = docs.select(id_column, vector, "cluster")
    if sample_rows is not None:
        sample = hash_sample(sample, id_column, sample_rows, seed)
    sample = materialize(sample.withColumnRenamed(id_column, "id"), "map-sample")
    if exact_rows is None or sample.count() <= exact_rows:
        near = nearest_neighbors(sample, "id", vector, k)
    else:
        near = cells.neighbors_by_cells(sample, "id", vector, k, seed=seed)
    graph = fuzzy_graph(near, k)
    graph = materialize(graph, "fuzzy-graph")
    places = spectral_layout(graph, seed)
    if steps:
        places = layout.refine(graph, places, steps)
    table = sample.select("id", "cluster").join(places, "id", "left")
    table = table.join(cluster_colors(docs), "cluster", "left")
    identity = F.col("cluster").cast("string")
    if labels is None:
        table = table.withColumn("label", identity)
    else:
        named = labels.select("cluster", F.col("label_auto").alias("label"))
        table = table.join(named, "cluster", "left")
        table = table.withColumn("label", F.coalesce("label", identity))
    return table.select("id", "x", "y", "cluster", "label", "color").withColumnRenamed(
        "id", id_column
    )
