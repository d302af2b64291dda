"""Refining a two-dimensional layout: edges attract, everything else repels by grid cells.

The forces are those of McInnes, Healy and Melville (2018), with the repulsion of their
random negatives replaced by its expectation over all rows.  It comes from a tree of
grids: cells that are far away act by their number and middle.  On each level a row meets
the cells under its parent's neighbours that are not its own neighbours, and on the last
level its neighbours too.  The tables of cells are bounded by the depth of the tree.

A step is two aggregations: attraction over the edges, which stay where they are, and
the sums of the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import discard, materialize

MIN_DIST, SPREAD = 0.05, 1.0
#: Negatives per edge whose expectation repels, and the limit of a move's coordinate.
NEGATIVES, LONGEST = 5.0, 4.0
#: The last level has 4 ** DEPTH cells.
DEPTH = 6
STEPS = 30
EPSILON = 0.001


def curve(min_dist: float = MIN_DIST, spread: float = SPREAD) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^(2b)) is nearest to 1 up to ``min_dist``, then exp(-(d - min_dist) / spread)."""
    d = np.linspace(0, spread * 3, 301)[1:]
    target = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    log_a, b, damping = 0.0, 1.0, 1e-2
    error = lambda la, b: 1.0 / (1.0 + np.exp(la) * d ** (2 * b)) - target
    for _ in range(200):
        p = np.exp(log_a) * d ** (2 * b)
        common = -p / (1.0 + p) ** 2
        slopes = np.c_[common, common * 2 * np.log(d)]
        r = error(log_a, b)
        step = np.linalg.solve(slopes.T @ slopes + damping * np.eye(2), -slopes.T @ r)
        if (error(log_a + step[0], b + step[1]) ** 2).sum() < (r * r).sum():
            log_a, b, damping = log_a + step[0], b + step[1], damping / 3
        else:
            damping *= 4
    return float(np.exp(log_a)), float(b)


def _extent(places: DataFrame) -> tuple[float, float, float]:
    """The lower corner and the side of the square around all rows."""
    low_x, low_y, high_x, high_y = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if low_x is None:
        return 0.0, 0.0, 1.0
    return low_x, low_y, max(high_x - low_x, high_y - low_y, 1e-12) * (1 + 1e-9)


def _cell(column: str, low: float, side: float, level: int):
    return F.floor((F.col(column) - low) / side * (1 << level)).cast("int")


def cell_sums(places: DataFrame, low_x: float, low_y: float, side: float, depth: int) -> list[np.ndarray]:
    """For each level the number of rows and the sums of x and y, as a (cells, cells, 3) array.

    One aggregation on the last level; the levels above add up theirs.
    """
    cells = places.groupBy(_cell("x", low_x, side, depth).alias("cx"), _cell("y", low_y, side, depth).alias("cy"))
    table = cells.agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).toArrow()
    last = np.zeros((1 << depth, 1 << depth, 3))
    at = table.column("cx").to_numpy(), table.column("cy").to_numpy()
    last[at] = np.c_[tuple(table.column(name).to_numpy() for name in ("n", "sx", "sy"))]
    levels = [last]
    while len(levels[0]) > 1:
        finer = levels[0]
        levels.insert(0, finer.reshape(len(finer) // 2, 2, len(finer) // 2, 2, 3).sum(axis=(1, 3)))
    return levels


def _pushes(xy: np.ndarray, levels: list[np.ndarray], low: np.ndarray, side: float, a: float, b: float) -> np.ndarray:
    """The sum over all other rows of the repulsion on each row."""
    total = np.zeros(xy.shape)
    depth = len(levels) - 1

    def push(cx: np.ndarray, cy: np.ndarray, some: np.ndarray, level: int, own: np.ndarray | None) -> None:
        n, sx, sy = levels[level][cx, cy].T
        if own is not None:  # a row does not repel itself
            n, sx, sy = n - own, sx - own * xy[some, 0], sy - own * xy[some, 1]
        full = n > 0.5
        gap = xy[some] - np.c_[sx, sy] / np.where(full, n, 1.0)[:, None]
        square = (gap * gap).sum(axis=1)
        strength = np.where(full, n * 2 * b / ((EPSILON + square) * (1 + a * square**b)), 0.0)
        total[some] += strength[:, None] * gap

    for level in range(1, depth + 1):
        cells = 1 << level
        own = np.clip(np.floor((xy - low) / side * cells).astype(np.int64), 0, cells - 1)
        start = (own // 2 - 1) * 2
        # The children of the parent's neighbours: six by six cells.
        for i in range(6):
            for j in range(6):
                c = start + (i, j)
                inside = ((c >= 0) & (c < cells)).all(axis=1)
                near = (np.abs(c - own) <= 1).all(axis=1)
                some = np.flatnonzero(inside & (~near | (level == depth)))
                if len(some):
                    same = (c[some] == own[some]).all(axis=1).astype(float) if level == depth else None
                    push(c[some, 0], c[some, 1], some, level, same)
    return total


def layout_step(
    edges: DataFrame, places: DataFrame, rate: float, a: float, b: float, depth: int = DEPTH, negatives: float = NEGATIVES
) -> DataFrame:
    """(id, x, y) after one move along the forces, times ``rate``.

    ``edges`` (src, dst, weight) hold both directions; ``places`` is a written table.
    """
    low_x, low_y, side = _extent(places)
    levels = cell_sums(places, low_x, low_y, side, depth)
    n = float(levels[0][0, 0, 0])
    kind = places.schema["id"].dataType.simpleString()
    low = np.array([low_x, low_y])

    def repel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.c_[batch.column("x").to_numpy(), batch.column("y").to_numpy()]
            away = _pushes(xy, levels, low, side, a, b)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(away[:, 0]), pa.array(away[:, 1])], ["id", "x", "y", "rx", "ry"]
            )

    repelled = places.select("id", "x", "y").mapInArrow(repel, f"id {kind}, x double, y double, rx double, ry double")
    source = places.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    target = places.select(F.col("id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    pairs = edges.join(source, "src").join(target, "dst")
    square = (F.col("sx") - F.col("dx")) ** 2 + (F.col("sy") - F.col("dy")) ** 2
    pull = F.when(
        F.col("square") > 0,
        F.col("weight") * (-2 * a * b) * F.pow("square", F.lit(b - 1)) / (1 + a * F.pow("square", F.lit(b))),
    ).otherwise(0.0)
    pulls = pairs.withColumn("square", square).withColumn("pull", pull).groupBy(F.col("src").alias("id")).agg(
        F.sum("weight").alias("degree"),
        F.sum(F.col("pull") * (F.col("sx") - F.col("dx"))).alias("ax"),
        F.sum(F.col("pull") * (F.col("sy") - F.col("dy"))).alias("ay"),
    )
    share = F.col("degree") * (negatives / max(n, 1.0))

    def moved(place: str, attraction: str, repulsion: str):
        force = F.coalesce(F.col(attraction) + share * F.col(repulsion), F.lit(0.0))
        return (F.col(place) + rate * F.greatest(F.least(force, F.lit(LONGEST)), F.lit(-LONGEST))).alias(place)

    return repelled.join(pulls, "id", "left").select("id", moved("x", "ax", "rx"), moved("y", "ay", "ry"))


def refine(
    edges: DataFrame, places: DataFrame, steps: int = STEPS, rate: float = 1.0, min_dist: float = MIN_DIST, depth: int = DEPTH
) -> DataFrame:
    """(id, x, y) after ``steps`` moves with a falling rate.  ``edges`` is a written table."""
    a, b = curve(min_dist)
    places = materialize(places.select("id", "x", "y"), "layout")
    for step in range(steps):
        after = materialize(layout_step(edges, places, rate * (1 - step / steps), a, b, depth), "layout")
        discard(places)
        places = after
    return places


def stretch(edges: DataFrame, places: DataFrame) -> DataFrame:
    """One row: the mean squared length of the edges, by weight, against that of all pairs.

    Small where neighbours lie together.
    """
    source = places.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    target = places.select(F.col("id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    square = (F.col("sx") - F.col("dx")) ** 2 + (F.col("sy") - F.col("dy")) ** 2
    along = edges.join(source, "src").join(target, "dst").agg((F.sum(F.col("weight") * square) / F.sum("weight")).alias("edge"))
    pairs = places.agg((2 * (F.var_pop("x") + F.var_pop("y"))).alias("pair"))
    return along.crossJoin(pairs).select((F.col("edge") / F.col("pair")).alias("stretch"))
