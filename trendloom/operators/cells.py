"""Nearest neighbours by inverted cells, for more rows than can all meet each other.

Rows belong to the cell of their nearest centre.  A row looks for its neighbours in its
own cell and the next nearest ones; how many of these it takes for a wanted recall is
measured beforehand, on a sample of rows compared with all rows.  Cells with more than
``part_rows`` rows are split by id, and a row that looks into such a cell visits all
its parts, so a task holds one part and sees the rows that ask go by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.vectors import k_best, normalize_rows, products
from trendloom.operators import clustering, kmeans
from trendloom.operators.sampling import hash_sample
from trendloom.session import materialize

NEIGHBORS = 30
#: Rows compared at once.
SLICE_ROWS = 512
#: Rows that a task holds while others go by, those that go by in one task, and at once.
HELD_ROWS, PASSING_ROWS, CHUNK_ROWS = 16_384, 65_536, 4096
#: Asking rows sent to every task; more of them are held in blocks.
SENT_ROWS = 1024
#: Rows of a cell's part.
PART_ROWS = 4096
#: Centres are sent to the tasks: never more than so many.
MOST_CELLS = 4096
#: Rows that the centres are fitted on, and rows whose recall is measured.
FIT_ROWS, RECALL_ROWS = 100_000, 256
PROBES = 4
RECALL = 0.9


def cell_centers(unit: DataFrame, id_column: str, vector: str, n_cells: int, seed: int = 0) -> DataFrame:
    """(cluster, center): k-means centres of a sample of at most ``FIT_ROWS`` rows."""
    sample = hash_sample(unit.select(id_column, vector), id_column, FIT_ROWS, seed)
    sample = materialize(sample, "cell-sample")
    starts = kmeans.starts_for(sample, id_column, vector, [n_cells], 1, seed)[n_cells]
    (model,) = kmeans.lloyd(sample, vector, starts, max_iter=20)
    return materialize(kmeans.centers_frame(unit.sparkSession, model), "cell-centers")


def with_cells(unit: DataFrame, vector: str, centers: DataFrame, probes: int | None = None) -> DataFrame:
    """Add ``cells``, the keys of the nearest centres, the own cell first; all of them by default.

    Distances count to nine decimals, equal ones go by key.
    """
    keys, matrix = clustering.collect_centers(centers)
    order = np.argsort(keys)
    keys, matrix = keys[order], matrix[order]
    pairs = F.arrays_zip(
        products(F.col(vector), -2.0 * matrix).alias("p"),
        F.array(*[F.lit(float(x)) for x in (matrix * matrix).sum(axis=1)]).alias("s"),
        F.array(*[F.lit(int(x)) for x in keys]).alias("key"),
    )
    near = F.sort_array(F.transform(pairs, lambda x: F.struct(F.round(x["s"] + x["p"], 9).alias("d"), x["key"].alias("key"))))
    if probes is not None:
        near = F.slice(near, 1, probes)
    return unit.withColumn("cells", F.transform(near, lambda x: x["key"]))


def nearest_in_cells(
    df: DataFrame,
    id_column: str,
    vector: str,
    centers: DataFrame,
    k: int = NEIGHBORS,
    probes: int = PROBES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(id, neighbor, distance, place): the k nearest other rows in the nearest cells.

    As in ``nearest_neighbors``, distances count to nine decimals and equal ones go by id.
    """
    unit = normalize_rows(df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")), "v")
    rows = materialize(with_cells(unit, "v", centers, probes), "cell-rows")
    own = F.get("cells", F.lit(0)).alias("cell")
    # One row per cell, of which there are at most MOST_CELLS.
    parts = F.broadcast(
        rows.groupBy(own).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    )
    held = rows.select("id", "v", own).join(parts, "cell").select(
        "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("asks"), "id", "v"
    )
    asking = rows.select("id", "v", F.explode("cells").alias("cell")).join(parts, "cell")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asking = asking.select("cell", every_part.alias("part"), F.lit(1).alias("asks"), "id", "v")
    dealt = held.unionByName(asking).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks", "id")
    kind = df.schema[id_column].dataType.simpleString()
    found = dealt.mapInArrow(_nearest_in_part(k), f"id {kind}, neighbor {kind}, distance double")
    return k_nearest(found, k)


def k_nearest(found: DataFrame, k: int) -> DataFrame:
    """(id, neighbor, distance, place): the ``k`` nearest of what several tasks found for an id."""
    order = Window.partitionBy("id").orderBy("distance", "neighbor")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def nearest_of_all(asking: DataFrame, rows: DataFrame, k: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """(id, neighbor, distance): the k nearest other rows of each asking row, per task that looked.

    Exact.  A task holds one block of the asking rows with their k best so far, and a share
    of the rows goes by in the order of their ids; so a row moves once per block, and what
    is passed on are k rows per asking row and share.  Both tables are (id, v) of unit length.
    """
    n_asking, n_rows = asking.count(), rows.count()
    blocks = max(1, math.ceil(n_asking / held_rows))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Enough tasks for all cores, but no share of a few rows only.
    shares = max(1, math.ceil(n_rows / PASSING_ROWS), min(math.ceil(cores / blocks), n_rows // CHUNK_ROWS))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, asks: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select("id", "v", mine, every, F.lit(asks).alias("passes")).select("block", "share", "passes", "id", "v")

    held = dealt(asking, "block", blocks, "share", shares, 0)
    both = held.unionByName(dealt(rows, "share", shares, "block", blocks, 1))
    both = both.repartition("block", "share").sortWithinPartitions("block", "share", "passes", "id")
    kind = rows.schema["id"].dataType.simpleString()
    return both.mapInArrow(_nearest_that_pass(k), f"id {kind}, neighbor {kind}, distance double")


class _Held:
    """A block of asking rows, and the k nearest of the rows that went by."""

    def __init__(self, ids: list[pa.Array], vectors: list[np.ndarray], k: int):
        self.ids, self.vectors, self.k = pa.concat_arrays(ids), np.concatenate(vectors), k
        self.names = self.ids.to_numpy(zero_copy_only=False)
        self.rough = self.vectors.astype(np.float32)
        # What a product of unit rows in single precision may be off by, twice over.
        self.slack = 2 * np.finfo(np.float32).eps * (self.vectors.shape[1] + 2)
        self.distance = np.full((len(self.names), k), np.inf)
        self.place = np.zeros((len(self.names), k), np.int64)
        self.passed: list[pa.Array] = []
        self.n_passed = 0

    def meet(self, ids: pa.Array, vectors: np.ndarray) -> None:
        """Rows that go by, in the order of their ids: an equal distance does not replace one before."""
        others = ids.to_numpy(zero_copy_only=False)
        rough = np.ascontiguousarray(vectors.T, np.float32)
        for start in range(0, len(self.names), SLICE_ROWS):
            where = slice(start, start + SLICE_ROWS)
            names, limit = self.names[where], self.distance[where, -1]
            # Single precision finds what may be near; only that is measured.
            near = self.rough[where] @ rough > (1.0 - limit - 1e-9 - self.slack).astype(np.float32)[:, None]
            places = np.flatnonzero(near)
            if len(places) > 4 * self.k * len(names):
                gap = np.round(1.0 - self.vectors[where] @ vectors.T, 9)
                gap[(gap >= limit[:, None]) | (names[:, None] == others)] = np.inf
                row, column = k_best(gap, self.k)
                found = gap[row, column]
            else:
                row, column = np.divmod(places, len(others))
                found = np.round(1.0 - np.einsum("ij,ij->i", self.vectors[where][row], vectors[column]), 9)
                good = (found < limit[row]) & (names[row] != others[column])
                row, column, found = row[good], column[good], found[good]
            if len(row):
                self._merge(start, row, column, found)
        self.passed.append(ids)
        self.n_passed += len(ids)

    def _merge(self, start: int, row: np.ndarray, column: np.ndarray, found: np.ndarray) -> None:
        touched, line, counts = np.unique(row, return_inverse=True, return_counts=True)
        at = self.k + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        distance = np.full((len(touched), self.k + counts.max()), np.inf)
        place = np.zeros(distance.shape, np.int64)
        touched = touched + start
        distance[:, : self.k], place[:, : self.k] = self.distance[touched], self.place[touched]
        distance[line, at], place[line, at] = found, column + self.n_passed
        order = np.argsort(distance, axis=1, kind="stable")[:, : self.k]
        self.distance[touched] = np.take_along_axis(distance, order, axis=1)
        self.place[touched] = np.take_along_axis(place, order, axis=1)

    def nearest(self) -> Iterator[pa.RecordBatch]:
        passed = pa.concat_arrays(self.passed) if self.passed else self.ids.slice(0, 0)
        for start in range(0, len(self.names), SLICE_ROWS):
            distance = self.distance[start : start + SLICE_ROWS]
            row, column = np.nonzero(np.isfinite(distance))
            columns = [
                self.ids.take(pa.array(row + start)),
                passed.take(pa.array(self.place[row + start, column])),
                pa.array(np.maximum(distance[row, column], 0.0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "neighbor", "distance"])


def _nearest_that_pass(k: int):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, held = None, [], [], None
        for batch in batches:
            blocks, shares, passes = (batch.column(name).to_numpy() for name in ("block", "share", "passes"))
            changes = (np.diff(blocks) != 0) | (np.diff(shares) != 0) | (np.diff(passes) != 0)
            cuts = np.r_[0, np.flatnonzero(changes) + 1, len(blocks)]
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                some = batch.slice(start, stop - start)
                if start < stop and (blocks[start], shares[start]) != key:
                    if held is not None:
                        yield from held.nearest()
                    key, ids, vectors, held = (blocks[start], shares[start]), [], [], None
                for first in range(0, some.num_rows, CHUNK_ROWS):
                    part = some.slice(first, CHUNK_ROWS)
                    if not passes[start]:
                        ids.append(part.column("id"))
                        vectors.append(_vectors(part.column("v")))
                    elif ids:
                        held = held or _Held(ids, vectors, k)
                        held.meet(part.column("id"), _vectors(part.column("v")))
        if held is not None:
            yield from held.nearest()

    return nearest


def _vectors(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _nearest_in_part(k: int):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []
        for batch in batches:
            cells, parts, asks = (batch.column(name).to_numpy() for name in ("cell", "part", "asks"))
            changes = (np.diff(cells) != 0) | (np.diff(parts) != 0) | (np.diff(asks) != 0)
            cuts = np.r_[0, np.flatnonzero(changes) + 1, len(cells)]
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                some = batch.slice(start, stop - start)
                if (cells[start], parts[start]) != key:
                    key, ids, vectors = (cells[start], parts[start]), [], []
                if not asks[start]:
                    ids.append(some.column("id"))
                    vectors.append(_vectors(some.column("v")))
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vectors = [pa.concat_arrays(ids)], [np.concatenate(vectors)]
                names = ids[0].to_numpy(zero_copy_only=False)
                for first in range(0, some.num_rows, SLICE_ROWS):
                    part = some.slice(first, SLICE_ROWS)
                    own = part.column("id")
                    distance = np.round(1.0 - _vectors(part.column("v")) @ vectors[0].T, 9)
                    distance[own.to_numpy(zero_copy_only=False)[:, None] == names] = np.inf
                    row, column = k_best(distance, k)
                    columns = [
                        own.take(pa.array(row)),
                        ids[0].take(pa.array(column)),
                        pa.array(np.maximum(distance[row, column], 0.0)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "neighbor", "distance"])

    return nearest


def recall_by_probes(
    df: DataFrame, id_column: str, vector: str, centers: DataFrame, k: int = NEIGHBORS, rows: int = RECALL_ROWS, seed: int = 0
) -> DataFrame:
    """(probes, recall): the share of true neighbours in the nearest so many cells.

    Measured on ``rows`` rows, the smallest hashes, whose true neighbours are found among
    all rows.  A few sampled rows are dealt to all tasks, others stay where they are; many
    are held in blocks that all rows pass.
    """
    unit = normalize_rows(df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")), "v")
    rows_of = materialize(with_cells(unit, "v", centers), "recall-rows")
    sample = hash_sample(rows_of.select("id", "v", "cells"), "id", rows, seed)
    asking, others = sample.select("id", "v"), rows_of.select("id", "v")
    if rows <= SENT_ROWS:
        near = _nearest_of(asking, others, k)
    else:
        near = k_nearest(nearest_of_all(asking, others, k), k).select("id", "neighbor")
    near = materialize(near, "recall-neighbors")
    cell = rows_of.select(F.col("id").alias("neighbor"), F.get("cells", F.lit(0)).alias("cell"))
    met = near.join(cell, "neighbor").join(sample.select("id", "cells"), "id")
    counts = met.groupBy(F.array_position("cells", F.col("cell")).alias("probes")).agg(F.count("*").alias("n"))
    every = rows_of.select(F.explode(F.sequence(F.lit(1), F.size("cells"))).alias("probes")).distinct()
    listed = every.join(counts.withColumn("probes", F.col("probes").cast("int")), "probes", "left").fillna(0, ["n"])
    # As many rows as cells.
    upto = F.sum("n").over(Window.orderBy("probes")) / F.sum("n").over(Window.partitionBy())
    return listed.select("probes", upto.alias("recall"))


def _nearest_of(asking: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, neighbor): the k nearest other rows of a bounded number of rows, by one pass."""
    table = asking.toArrow().combine_chunks()
    ids, matrix = table.column("id").combine_chunks(), _vectors(table.column("v").combine_chunks())
    names = ids.to_numpy(zero_copy_only=False)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                others = part.column("id")
                distance = np.round(1.0 - matrix @ _vectors(part.column("v")).T, 9)
                distance[names[:, None] == others.to_numpy(zero_copy_only=False)] = np.inf
                row, column = k_best(distance, k)
                columns = [ids.take(pa.array(row)), others.take(pa.array(column)), pa.array(distance[row, column])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "neighbor", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(nearest, f"id {kind}, neighbor {kind}, distance double")
    return k_nearest(found, k).select("id", "neighbor")


def probes_for(recalls: DataFrame, recall: float = RECALL) -> int:
    """The least number of cells with the wanted recall."""
    return recalls.filter(F.col("recall") >= recall).agg(F.min("probes")).first()[0] or PROBES


def neighbors_by_cells(
    df: DataFrame, id_column: str, vector: str, k: int = NEIGHBORS, recall: float = RECALL, seed: int = 0
) -> DataFrame:
    """Cells fitted on a sample, as many of them visited as the wanted recall takes."""
    n = df.count()
    n_cells = max(2, min(MOST_CELLS, math.ceil(n / PART_ROWS)))
    unit = normalize_rows(df.select(id_column, vector), vector)
    centers = cell_centers(unit, id_column, vector, n_cells, seed)
    probes = probes_for(recall_by_probes(df, id_column, vector, centers, k, seed=seed), recall)
    return nearest_in_cells(df, id_column, vector, centers, k, probes)
