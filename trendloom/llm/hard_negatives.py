"""Hard negatives: for an anchor and a positive, the best rows of another label below the positive.

Scores are exact inner products of whole-number vectors.  Rows are dealt out evenly
into shards of bounded size; a task that gets a shard builds a cover tree over its
rows and then sees the queries go by, one at a time, so it holds one shard only.

1. Each anchor finds the best rows of its own label in every shard; the best of these
   over all shards are its positives.
2. With the scores of its positives an anchor has as many windows of scores.  One
   best-first descent of each shard's tree fills them all; nodes whose bounds lie
   outside every window, or below what the windows have, are skipped, and the rows of
   the other leaves are verified exactly.

A shard answers with at most ``k`` rows per window, and answers are merged by a
ranked window, which Spark limits before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.cover_tree import Best, CoverTree, best_first
from trendloom.session import materialize

#: Rows of a shard; with 64 components a shard holds one megabyte of vectors.
SHARD_ROWS = 2048
#: Queries looked up in one matrix product.
TOGETHER = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these parts of its positive's.
LEAST, MOST = Fraction(3, 10), Fraction(9, 10)


def whole_numbers(vector: str | Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null if a component is null or not finite."""
    column = F.col(vector) if isinstance(vector, str) else vector
    values = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(column.isNotNull() & ~bad, F.transform(values, lambda x: F.floor(x * factor)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, short ones filled up with zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(sizes), width), np.int64)
    rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows


class _Shard:
    """The rows of one shard as they arrive, in the order of their ids; then their tree."""

    def __init__(self, number: int, width: int):
        self.number, self.width, self.parts, self.tree = number, width, [], None

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part.select(["row", "id", "label", "vector"]))

    def close(self) -> None:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.ids = table.column("id").combine_chunks()
        self.tree = CoverTree(_matrix(table.column("vector").combine_chunks(), self.width))
        self.rows, self.labels = (table.column(name).to_numpy()[self.tree.order] for name in ("row", "label"))

    def answers(self, queries: pa.RecordBatch, same: bool, k: int) -> Iterator[tuple]:
        """(anchor, place, row in the shard, score) of a batch of queries."""
        vectors = _matrix(queries.column("vector"), self.width)
        least, most = self.tree.bounds(vectors)
        anchors, labels = (queries.column(name).to_numpy(zero_copy_only=False) for name in ("row", "label"))
        for i, lows in enumerate(queries.column("low").to_pylist()):
            usable = (self.labels == labels[i]) == same
            if same:
                usable &= self.rows != anchors[i]
                windows = [Best(None, None, k)]
            else:
                windows = [Best(a, b, k) for a, b in zip(lows, queries.column("high")[i].as_py())]
            open_windows = [w for w in windows if w.low <= w.high]
            best_first(self.tree, vectors[i], least[i], most[i], usable, open_windows)
            for place, window in enumerate(windows):
                for score, row in window.found():
                    yield anchors[i], place, row, score


def _search(rows: DataFrame, queries: DataFrame, shards: int, width: int, same: bool, k: int) -> DataFrame:
    """anchor, place, id, score: the best ``k`` of every shard for each query and window.

    ``rows`` has row, id, label, vector; ``queries`` row, label, vector, low, high.
    Rows and queries of a shard go to one task, the rows first, sorted by Spark.
    """
    kind = rows.schema["id"].dataType.simpleString()
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    candidates = rows.select(
        shard.alias("shard"), F.lit(0).alias("part"), "row", "id", "label", "vector",
        F.lit(None).cast("array<bigint>").alias("low"), F.lit(None).cast("array<bigint>").alias("high"),
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(
        everywhere.alias("shard"), F.lit(1).alias("part"), "row", F.lit(None).cast(kind).alias("id"),
        "label", "vector", "low", "high",
    )
    dealt = candidates.unionByName(asked).repartition(shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", "part", F.asc_nulls_last("id"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            keys = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("part").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if start == stop:
                    continue
                number, part = divmod(int(keys[start]), 2)
                some = batch.slice(start, stop - start)
                if current is None or current.number != number:
                    current = _Shard(number, width)
                if part == 0:
                    current.add(some)
                    continue
                if current.tree is None:
                    if not current.parts:
                        continue  # no rows fell to this shard
                    current.close()
                for first in range(0, some.num_rows, TOGETHER):
                    found = list(current.answers(some.slice(first, TOGETHER), same, k))
                    anchor, place, row, score = zip(*found) if found else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor, pa.int64()),
                            pa.array(place, pa.int32()),
                            current.ids.take(pa.array(row, pa.int64())),
                            pa.array(score, pa.int64()),
                        ],
                        ["anchor", "place", "id", "score"],
                    )

    return dealt.mapInArrow(run, f"anchor long, place int, id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor and place, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: Fraction = LEAST,
    most: Fraction = MOST,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has id (of any ordered type), label and vector (array<bigint>), and
    ``anchors`` is a condition on these columns that marks the anchors.  Rows without
    label or vector take no part.  Vectors of different lengths count as filled up with
    zeros.  Scores beyond 64 bits are an error.  Equal scores go to the smaller id, null
    ids last; rows that repeat an id are rows of their own, so such an anchor comes once
    for each row, and another row with the anchor's id can be its positive.  A positive
    without any row in its window gives no row, nor does a negative positive score.
    """
    kept = vectors.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).select("id", "label", "vector")
    rows = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "negative-rows")
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(width or 0, 1)
    shards = max(1, math.ceil(n / shard_rows))
    kind = rows.schema["id"].dataType.simpleString()
    of_anchors = rows.filter(F.coalesce(anchors, F.lit(False)))
    nothing = F.lit(None).cast("array<bigint>")
    asked = of_anchors.select("row", "label", "vector", nothing.alias("low"), nothing.alias("high"))
    best = _ranked(_search(rows, asked, shards, width, True, positives), positives)
    found = materialize(best.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def part(p: Fraction, up: bool) -> Column:
        """That part of the positive's score, rounded up or down to a whole number."""
        size = F.lit(p.denominator).cast("bigint")
        product = F.col("positive_score") * (-p.numerator if up else p.numerator)
        down = F.call_function("div", product - F.pmod(product, size), size)
        return -down if up else down

    windows = found.withColumns({"low": part(least, True), "high": part(most, False)})
    listed = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    asked = of_anchors.join(listed, F.col("row") == F.col("anchor")).select(
        "row", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high")
    )
    below = _ranked(_search(rows, asked, shards, width, False, negatives), negatives)
    named = found.join(of_anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    pairs = named.withColumn("place", F.col("rank") - 1).drop("rank")
    return below.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
