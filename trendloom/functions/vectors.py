"""Array columns against a small fixed matrix: Arrow batches and one product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A matrix sent along with a task stays below this; larger ones go in parts.
PART_BYTES = 64 << 20


def stacked(series: pd.Series, width: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, width))
    return np.stack(series.to_numpy()).astype(np.float64)


def parts(matrix: np.ndarray) -> list[slice]:
    """Row ranges of the matrix that stay under ``PART_BYTES``."""
    rows = max(1, PART_BYTES // (8 * max(matrix.shape[1], 1)))
    return [slice(i, i + rows) for i in range(0, len(matrix), rows)]


def normalize_rows(df: DataFrame, column: str) -> DataFrame:
    """Scale every array to length one; zero arrays stay zero."""
    vectors = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    unit = Normalizer(p=2.0, inputCol="_v", outputCol="_unit").transform(vectors)
    return unit.withColumn(column, vector_to_array("_unit")).drop("_v", "_unit")


def nearest_row(column: Column, keys: np.ndarray, matrix: np.ndarray) -> Column:
    """struct(distance, key) of the matrix row nearest to the array, squared distance.

    Ties go to the lowest key.
    """
    order = np.argsort(keys, kind="stable")
    keys, matrix = keys[order], matrix[order]
    found = [_nearest(keys[p], matrix[p])(column) for p in parts(matrix)]
    return found[0] if len(found) == 1 else F.least(*found)


def _nearest(keys: np.ndarray, matrix: np.ndarray):
    square = (matrix * matrix).sum(axis=1)

    @F.pandas_udf("distance double, key int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = stacked(batch, matrix.shape[1])
            gap = square - 2.0 * (rows @ matrix.T)
            best = gap.argmin(axis=1)
            distance = gap[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
            yield pd.DataFrame({"distance": np.maximum(distance, 0.0), "key": keys[best]})

    return nearest


def products(column: Column, matrix: np.ndarray) -> Column:
    """Array of the products with every row of the matrix."""
    found = [_products(matrix[p])(column) for p in parts(matrix)]
    return found[0] if len(found) == 1 else F.concat(*found)


def _products(matrix: np.ndarray):
    @F.pandas_udf("array<double>")
    def multiply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(stacked(batch, matrix.shape[1]) @ matrix.T))

    return multiply


def k_best(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest finite entries of each row, ties by column."""
    last = min(k, distance.shape[1]) - 1
    limit = np.partition(distance, last, axis=1)[:, last][:, None]
    nearer = distance < limit
    tied = (distance == limit) & np.isfinite(distance)
    room = last + 1 - nearer.sum(axis=1, keepdims=True)
    return np.nonzero(nearer | (tied & (np.cumsum(tied, axis=1) <= room)))
