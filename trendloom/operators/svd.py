"""Truncated SVD of sparse rows by randomised subspace iteration.

Halko, Martinsson and Tropp (2011): start from random vectors over the terms,
multiply by XᵀX a fixed number of times with re-orthonormalisation, then solve
the small projected eigenproblem.  Each multiplication is one narrow pass over
the documents followed by an aggregation on blocks of terms.  Vectors over the terms
are model state (capped vocabulary times components); they are sent to the
tasks in column blocks of a checked size, so that no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_COMPONENTS = 300
N_ITER = 7
OVERSAMPLE = 10
# Size of one column block of term vectors sent to the tasks: 310 columns over
# 200,000 terms in single precision fit one.  Set it to what the executors can hold.
BLOCK_BYTES = 256 << 20
# Documents multiplied at once inside a task, and rows handed on at once.
DOCS_AT_ONCE, ROWS_AT_ONCE = 64, 4096
# Size of a row of sums, which holds as many neighbouring terms as fit.
ROW_BYTES = 64 << 10
BLOCK_SUMS = "block int, term_ids array<int>, sums array<double>"


@dataclass
class SvdModel:
    """Right singular vectors (terms × components) and singular values."""

    v: np.ndarray
    s: np.ndarray

    @property
    def n_components(self) -> int:
        return len(self.s)

    def project(self, rows: DataFrame, id_column: str, scale: np.ndarray | None = None) -> DataFrame:
        """(id, embedding): the rows times the vectors, each component times ``scale``."""
        return project(rows, id_column, self.v, scale)

    def factors(self, spark: SparkSession) -> DataFrame:
        """(term_id, v array<double>)."""
        flat = pa.array(np.ascontiguousarray(self.v).ravel())
        offsets = pa.array(np.arange(len(self.v) + 1) * self.v.shape[1], pa.int32())
        table = pa.table(
            {
                "term_id": pa.array(np.arange(len(self.v)), pa.int32()),
                "v": pa.ListArray.from_arrays(offsets, flat),
            }
        )
        return spark.createDataFrame(table)

    def singular_values(self, spark: SparkSession) -> DataFrame:
        """(component, singular_value)."""
        table = pa.table(
            {
                "component": pa.array(np.arange(len(self.s)), pa.int32()),
                "singular_value": pa.array(self.s, pa.float64()),
            }
        )
        return spark.createDataFrame(table)


def column_blocks(n_rows: int, n_columns: int) -> list[slice]:
    """Column ranges whose dense blocks stay under ``BLOCK_BYTES``."""
    width = max(1, BLOCK_BYTES // (4 * max(n_rows, 1)))
    return [slice(i, min(i + width, n_columns)) for i in range(0, n_columns, width)]


def _dense_slices(term_ids, weights):
    """Slices of a batch as (where, terms, dense matrix over those terms).

    A few documents share enough terms that a dense product over the terms
    they use beats sums over single entries.
    """
    for first in range(0, len(term_ids), DOCS_AT_ONCE):
        ids = term_ids[first : first + DOCS_AT_ONCE]
        flat = np.concatenate(ids)
        if len(flat) == 0:
            continue
        terms, place = np.unique(flat, return_inverse=True)
        dense = np.zeros((len(ids), len(terms)))
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        dense[row, place] = np.concatenate(weights[first : first + DOCS_AT_ONCE])
        yield slice(first, first + len(ids)), terms, dense


def partial_sums(rows: DataFrame, shared, terms_at_once: int) -> DataFrame:
    """(block, term_ids, sums): XᵀX of each task's own documents times the shared vectors.

    Neighbouring terms are one row, so a task makes few rows however many terms there are.
    """

    def multiply(batches):
        vectors = shared.value
        total = np.zeros(vectors.shape)
        touched = np.zeros(len(vectors), bool)
        for batch in batches:
            for _, terms, dense in _dense_slices(*_lists(batch)):
                total[terms] += dense.T @ (dense @ vectors[terms].astype(np.float64))
                touched[terms] = True
        keys = np.flatnonzero(touched).astype(np.int32)
        yield from _block_sums(keys, total[keys], terms_at_once)

    return rows.select("term_ids", "weights").mapInArrow(multiply, BLOCK_SUMS)


def _gram_block(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """XᵀX times one block of term vectors."""
    n_terms, width = block.shape
    terms_at_once = max(1, ROW_BYTES // (8 * width))
    shared = rows.sparkSession.sparkContext.broadcast(block.astype(np.float32))
    # The sums of all tasks meet by block of terms; a task holds the sums of one block at a time.
    together = partial_sums(rows, shared, terms_at_once).repartition("block").sortWithinPartitions("block")
    table = together.mapInArrow(_added(terms_at_once, width), BLOCK_SUMS).select("term_ids", "sums").toArrow()
    shared.unpersist()
    result = np.zeros((n_terms, width))
    for batch in table.to_batches():
        terms = batch.column("term_ids").flatten().to_numpy()
        result[terms] = batch.column("sums").flatten().to_numpy().reshape(-1, width)
    return result


def _block_sums(keys: np.ndarray, sums: np.ndarray, terms_at_once: int) -> Iterator[pa.RecordBatch]:
    """Sums of ascending terms, one row for each block of terms that has any."""
    cuts = np.flatnonzero(np.diff(keys // terms_at_once)) + 1
    for some, part in zip(np.split(keys, cuts), np.split(sums, cuts)):
        if len(some):
            columns = [[int(some[0]) // terms_at_once], [some], [part.ravel()]]
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.record_batch([pa.array(*x) for x in zip(columns, kinds)], names=["block", "term_ids", "sums"])


def _added(terms_at_once: int, width: int):
    """The rows of each block of terms added up; they come one after the other."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, touched = None, np.zeros((terms_at_once, width)), np.zeros(terms_at_once, bool)

        def done() -> Iterator[pa.RecordBatch]:
            places = np.flatnonzero(touched)
            yield from _block_sums((block * terms_at_once + places).astype(np.int32), total[places], terms_at_once)

        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                if number != block:
                    if block is not None:
                        yield from done()
                    block = number
                    total[:], touched[:] = 0.0, False
                places = batch.column("term_ids")[i].values.to_numpy() - block * terms_at_once
                total[places] += batch.column("sums")[i].values.to_numpy().reshape(-1, width)
                touched[places] = True
        if block is not None:
            yield from done()

    return add


def _lists(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Term numbers and weights of each row of an Arrow batch."""
    found = []
    for name in ("term_ids", "weights"):
        lists = batch.column(name)
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        found.append(np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1]))
    return tuple(found)


def gram_times(rows: DataFrame, vectors: np.ndarray) -> np.ndarray:
    """XᵀX times term vectors, block by block."""
    blocks = column_blocks(*vectors.shape)
    return np.hstack([_gram_block(rows, np.ascontiguousarray(vectors[:, b])) for b in blocks])


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Make the largest entry of every column positive."""
    top = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(top < 0, -1.0, 1.0)


def _rounded(vectors: np.ndarray) -> np.ndarray:
    """An orthonormal basis in single precision, as doubles."""
    return np.linalg.qr(vectors)[0].astype(np.float32).astype(np.float64)


def truncated_svd(
    rows: DataFrame,
    n_terms: int,
    n_components: int = N_COMPONENTS,
    n_iter: int = N_ITER,
    seed: int = 0,
) -> SvdModel:
    """Leading singular triplets of the sparse rows, without centring.

    ``rows`` is read ``n_iter + 1`` times for each column block, of which there is one
    as long as terms times columns fit ``BLOCK_BYTES``: pass a written table.  The basis
    is rounded to single precision, so the last step allows for one that is not quite
    orthonormal.
    """
    width = min(n_terms, n_components + OVERSAMPLE)
    basis = _rounded(np.random.default_rng(seed).standard_normal((n_terms, width)))
    for _ in range(n_iter):
        basis = _rounded(gram_times(rows, basis))
    small = basis.T @ gram_times(rows, basis)
    whole = np.linalg.inv(np.linalg.cholesky(basis.T @ basis))
    values, vectors = np.linalg.eigh(whole @ ((small + small.T) / 2) @ whole.T)
    order = np.argsort(values)[::-1][: min(n_components, width)]
    v = fix_signs(basis @ (whole.T @ vectors[:, order]))
    return SvdModel(v, np.sqrt(np.maximum(values[order], 0.0)))


def project(
    rows: DataFrame, id_column: str, v: np.ndarray, scale: np.ndarray | None = None
) -> DataFrame:
    """(id, embedding): the rows times ``v``, each component times ``scale``.

    Narrow, one pass: a task applies the column blocks of ``v`` in turn to each batch.
    """
    if scale is not None:
        v = v * scale
    context = rows.sparkSession.sparkContext
    blocks = column_blocks(*v.shape)
    shared = [context.broadcast(np.ascontiguousarray(v[:, block])) for block in blocks]
    width = v.shape[1]

    def apply(batches):
        for batch in batches:
            images = np.zeros((batch.num_rows, width))
            for where, terms, dense in _dense_slices(*_lists(batch)):
                for block, part in zip(blocks, shared):
                    images[where, block] = dense @ part.value[terms]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(images.ravel()), width)
            yield pa.record_batch(
                [batch.column(id_column), lists.cast(pa.list_(pa.float64()))], names=[id_column, "embedding"]
            )

    kind = rows.schema[id_column].dataType.simpleString()
    picked = rows.select(id_column, "term_ids", "weights")
    return picked.mapInArrow(apply, f"{id_column} {kind}, embedding array<double>")


def whitened(rows: DataFrame, id_column: str, model: SvdModel) -> DataFrame:
    """(id, embedding) with each component divided by its singular value.

    A component whose singular value vanishes stays zero; singular values are roots, so
    they are known to half the digits of a double.
    """
    tiny = model.s.max(initial=0.0) * 1e-7
    scale = np.array([1.0 / s if s > tiny else 0.0 for s in model.s])
    return model.project(rows, id_column, scale)


def unwhitened(stored: DataFrame, s: np.ndarray) -> DataFrame:
    """Stored whitened embeddings with each component times its singular value again."""
    scale = F.array(*[F.lit(float(x)) for x in s])
    image = F.zip_with("embedding", scale, lambda x, factor: x.cast("double") * factor)
    return stored.select(image.alias("embedding"))


def component_variance(projected: DataFrame) -> DataFrame:
    """One row: the summed population variance of the embedding columns."""
    vectors = projected.select(array_to_vector("embedding").alias("x"))
    moments = vectors.agg(
        Summarizer.metrics("variance", "count").summary(F.col("x")).alias("m")
    ).select(_vector_total(F.col("m.variance")).alias("v"), F.col("m.count").alias("n"))
    population = F.col("v") * (F.col("n") - 1) / F.greatest(F.col("n"), F.lit(1))
    return moments.select(population.alias("component_variance"))


def _vector_total(vector):
    return F.aggregate(vector_to_array(vector), F.lit(0.0), lambda total, x: total + x)
