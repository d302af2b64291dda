"""K-means of several models at once: every scan of the rows moves all of them.

A model is a matrix of centres, small against the rows.  A task adds up, for each model,
the rows nearest to each centre; sums of all tasks meet by model and centre.  So ten
restarts, or a whole grid of K, cost one scan per step.  Models that have converged leave.

Mini-batches are rows dealt out by the hash of their ids, written as one folder each, so
a step reads its own batch only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.vectors import nearest_row
from trendloom.operators.sampling import hash_sample, random_order
from trendloom.session import materialize, scratch_path

MAX_ITER, TOL = 300, 1e-4
#: Starts are drawn from so many rows, the smallest hashes of their ids.
START_ROWS = 10_000
#: Centres moved in one scan, all models together; more take more scans.
MODEL_BYTES = 64 << 20
#: Rows of a mini-batch, batches without a better cost before a model stops, and of all passes.
BATCH_ROWS, PATIENCE, EPOCHS = 50_000, 50, 100
#: Rows compared at once.
SLICE_ROWS = 4096


@dataclass
class Model:
    """Centres, the number of rows that each has seen, and the cost over the rows."""

    centers: np.ndarray
    counts: np.ndarray | None = None
    cost: float = math.nan
    steps: int = 0

    @property
    def k(self) -> int:
        return len(self.centers)


def centers_frame(spark, model: Model) -> DataFrame:
    """(cluster, center) of a model."""
    rows = [(i, [float(x) for x in center]) for i, center in enumerate(model.centers)]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(np.float64)


@dataclass
class Sums:
    """What one scan finds for one model: sums and numbers of the rows of each centre, and the cost."""

    sums: np.ndarray
    counts: np.ndarray
    cost: float


def _groups(models: list[np.ndarray]) -> Iterator[list[int]]:
    """Models that are moved in one scan."""
    group, size = [], 0
    for i, centers in enumerate(models):
        if group and size + centers.nbytes > MODEL_BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += centers.nbytes
    if group:
        yield group


def scan(unit: DataFrame, vector: str, models: list[np.ndarray]) -> list[Sums]:
    """One look at all rows for all models; rows go to the nearest centre, ties to the first."""
    found: dict[int, Sums] = {}
    for group in _groups(models):
        found.update(zip(group, _scan(unit, vector, [models[i] for i in group])))
    return [found[i] for i in range(len(models))]


def _scan(unit: DataFrame, vector: str, models: list[np.ndarray]) -> list[Sums]:
    squares = [(c * c).sum(axis=1) for c in models]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(c.shape) for c in models], [np.zeros(len(c), np.int64) for c in models]
        costs = [np.zeros(len(c)) for c in models]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                x = _matrix(batch.column("v").slice(start, SLICE_ROWS))
                own = (x * x).sum(axis=1)
                for i, centers in enumerate(models):
                    gap = squares[i] - 2.0 * (x @ centers.T)
                    best = gap.argmin(axis=1)
                    taken = np.zeros(gap.shape)
                    taken[np.arange(len(x)), best] = 1.0
                    sums[i] += taken.T @ x
                    counts[i] += np.bincount(best, minlength=len(centers))
                    cost = np.maximum(gap[np.arange(len(x)), best] + own, 0.0)
                    costs[i] += np.bincount(best, cost, minlength=len(centers))
        for i in range(len(models)):
            seen = np.flatnonzero(counts[i])
            lists = pa.array(list(sums[i][seen]), pa.list_(pa.float64()))
            columns = [np.full(len(seen), i, np.int32), seen.astype(np.int32), counts[i][seen]]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), lists, pa.array(costs[i][seen])], ["model", "cluster", "n", "sums", "cost"]
            )

    rows = unit.select(F.col(vector).cast("array<double>").alias("v"))
    parts = rows.mapInArrow(add, "model int, cluster int, n long, sums array<double>, cost double")
    merged = parts.groupBy("model", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"),
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"),
    )
    # Model state: a row for each centre.
    results = [Sums(np.zeros(c.shape), np.zeros(len(c), np.int64), 0.0) for c in models]
    for row in merged.toArrow().to_pylist():
        result = results[row["model"]]
        result.sums[row["cluster"]], result.counts[row["cluster"]] = row["sums"], row["n"]
        result.cost += row["cost"]
    return results


def _moved(centers: np.ndarray, found: Sums) -> np.ndarray:
    """Means of the rows; a centre without rows stays."""
    some = found.counts > 0
    moved = centers.copy()
    moved[some] = found.sums[some] / found.counts[some, None]
    return moved


def lloyd(
    unit: DataFrame, vector: str, starts: list[np.ndarray], max_iter: int = MAX_ITER, tol: float = TOL
) -> list[Model]:
    """Lloyd's algorithm from every start, one scan per step for all that still move.

    A model stops when no centre moves farther than ``tol``.  Costs are those of the
    centres returned, found in one more scan.
    """
    models = [Model(np.asarray(start, np.float64)) for start in starts]
    moving = models
    for _ in range(max_iter):
        if not moving:
            break
        still = []
        for model, found in zip(moving, scan(unit, vector, [m.centers for m in moving])):
            moved = _moved(model.centers, found)
            far = ((moved - model.centers) ** 2).sum(axis=1).max(initial=0.0) > tol * tol
            model.centers, model.steps = moved, model.steps + 1
            if far:
                still.append(model)
        moving = still
    return with_costs(unit, vector, models)


def with_costs(unit: DataFrame, vector: str, models: list[Model]) -> list[Model]:
    """The models with their costs and counts over all rows, by one scan."""
    for model, found in zip(models, scan(unit, vector, [m.centers for m in models])):
        model.cost, model.counts = found.cost, found.counts
    return models


def start_rows(unit: DataFrame, id_column: str, vector: str, seed: int = 0) -> np.ndarray:
    """At most ``START_ROWS`` rows, in the order of their hashes."""
    sample = hash_sample(unit.select(id_column, vector), id_column, START_ROWS, seed)
    ordered = sample.orderBy(random_order(id_column, seed)).select(F.col(vector).cast("array<double>").alias("v"))
    table = ordered.toArrow().combine_chunks()
    return _matrix(table.column("v").combine_chunks())


def plus_plus(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the rows, each drawn with a chance in proportion to its squared distance to those before.

    Fewer if there are fewer distinct rows.
    """
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(rows)))]
    gap = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.max() > 0:
        place = np.searchsorted(np.cumsum(gap), draw.random() * gap.sum(), side="right")
        chosen.append(int(min(place, len(rows) - 1)))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def starts_for(unit: DataFrame, id_column: str, vector: str, grid, starts: int, seed: int = 0) -> dict[int, list[np.ndarray]]:
    """For each K several starts, drawn from one sample."""
    rows = start_rows(unit, id_column, vector, seed)
    if not len(rows):
        raise ValueError("no rows to cluster")
    return {k: [plus_plus(rows, k, seed + i) for i in range(starts)] for k in grid}


def best_starts(unit: DataFrame, vector: str, candidates: dict[int, list[np.ndarray]]) -> dict[int, Model]:
    """The start with the lowest cost over all rows for each K; one scan compares all of them."""
    named = [(k, start) for k, starts in candidates.items() for start in starts]
    costs = [found.cost for found in scan(unit, vector, [start for _, start in named])]
    best: dict[int, Model] = {}
    for (k, start), cost in zip(named, costs):
        if k not in best or cost < best[k].cost:
            best[k] = Model(start, cost=cost)
    return best


def best_restart(
    unit: DataFrame, id_column: str, vector: str, k: int, restarts: int = 10, seed: int = 0, max_iter: int = MAX_ITER
) -> tuple[Model, list[float]]:
    """The model with the lowest cost out of several whole runs, and all costs."""
    models = lloyd(unit, vector, starts_for(unit, id_column, vector, [k], restarts, seed)[k], max_iter)
    costs = [model.cost for model in models]
    return models[int(np.argmin(costs))], costs


# ---- mini-batches ------------------------------------------------------------


def batch_number(id_column: str, batches: int, seed: int = 0) -> Column:
    """The batch of a row, from the first eight digits of its hash."""
    return (F.conv(F.substring(random_order(id_column, seed), 1, 8), 16, 10).cast("long") % batches).cast("int")


def minibatch_step(batch: DataFrame, vector: str, models: list[Model]) -> list[float]:
    """Move all models by one batch; the mean cost of a row before the move for each.

    A centre moves towards the mean of its rows by their share in all it has seen.
    """
    costs = []
    for model, found in zip(models, scan(batch, vector, [m.centers for m in models])):
        if model.counts is None:
            model.counts = np.zeros(model.k, np.int64)
        model.counts = model.counts + found.counts
        some = found.counts > 0
        step = found.sums[some] - found.counts[some, None] * model.centers[some]
        model.centers = model.centers.copy()
        model.centers[some] += step / model.counts[some, None]
        model.steps += 1
        costs.append(found.cost / max(int(found.counts.sum()), 1))
    return costs


def minibatch(
    unit: DataFrame,
    id_column: str,
    vector: str,
    starts: list[np.ndarray],
    batch_rows: int = BATCH_ROWS,
    epochs: int = EPOCHS,
    patience: int = PATIENCE,
    seed: int = 0,
) -> list[Model]:
    """Mini-batch k-means of several models at once, batch after batch in the order of their numbers.

    A model stops after ``patience`` batches in which the smoothed cost of a row was
    never lower than before.  Centres without rows stay where they are.
    """
    n = unit.count()
    batches = max(1, math.ceil(n / batch_rows))
    numbered = unit.select(vector, batch_number(id_column, batches, seed).alias("batch"))
    stored = _by_batch(numbered, batches)
    weight = min(1.0, 2.0 * batch_rows / (n + 1))
    models = [Model(np.asarray(start, np.float64)) for start in starts]
    moving = [(model, math.nan, math.inf, 0) for model in models]
    for step in range(epochs * batches):
        if not moving:
            break
        batch = stored.filter(F.col("batch") == step % batches)
        costs = minibatch_step(batch, vector, [model for model, *_ in moving])
        after = []
        for (model, smooth, least, idle), cost in zip(moving, costs):
            smooth = cost if math.isnan(smooth) else smooth + weight * (cost - smooth)
            idle = 0 if smooth < least else idle + 1
            if idle < patience:
                after.append((model, smooth, min(least, smooth), idle))
        moving = after
    return with_costs(unit, vector, models)


def _by_batch(numbered: DataFrame, batches: int) -> DataFrame:
    """Written in one folder per batch, so that a batch is read by itself."""
    if batches == 1:
        return materialize(numbered, "batches")
    spark = numbered.sparkSession
    path = scratch_path(spark, "batches")
    numbered.repartition("batch").write.partitionBy("batch").parquet(path)
    return spark.read.parquet(path)


def assign(df: DataFrame, vector: str, model: Model) -> DataFrame:
    """Add the cluster of each row, in place of one that is already there."""
    near = nearest_row(F.col(vector), np.arange(model.k, dtype=np.int32), model.centers)
    return df.drop("cluster").withColumn("cluster", near.getField("key"))
