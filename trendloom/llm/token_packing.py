"""Token ids of documents, packed into rows of one length by best-fit decreasing.

Each task encodes the documents it reads and packs them in shards of a bounded
number of tokens, so no token is shuffled.  A document longer than a row is split
into whole rows and a rest, and nothing is lost.  Rests are placed from the longest
on, each in the open row with the least room that takes it (a segment tree over
free capacities finds it).  Rows are written as a Parquet table: a matrix of ids
with one row of the matrix in each row of the table, little-endian and padded,
the cumulative lengths of its segments, and where positions start again at 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.byte_bpe import ID_TYPE, VOCABULARY, PieceIds
from trendloom.llm.capacity_tree import CapacityTree
from trendloom.llm.text import byte_slices, texts_of
from trendloom.session import materialize

ROW_TOKENS = 2048
#: A shard is packed when it has so many tokens or documents.
SHARD_TOKENS, SHARD_DOCUMENTS = 4_000_000, 200_000
PAD = 0
WRITTEN_ROWS = 512

SCHEMA = (
    "shard string, row int, ids binary, n_tokens int, lengths array<int>, resets array<int>, "
    "doc_ids array<{id}>, offsets array<long>"
)


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; equal sizes are placed in order."""
    open_bins, bins = CapacityTree(capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_bins.take(sizes[item])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        free, number = found
        bins[number].append(item)
        open_bins.put(free - sizes[item], number)
    return bins


def split(size: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; an empty one has one empty piece."""
    return [(start, min(most, size - start)) for start in range(0, max(size, 1), most)]


class _Shard:
    """Documents that wait to be packed together."""

    def __init__(self, row_tokens: int):
        self.row_tokens = row_tokens
        self.clear()

    def clear(self) -> None:
        self.tokens, self.documents = 0, 0
        self.pieces: list[tuple[object, int, np.ndarray]] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        self.documents += 1
        for start, length in split(len(ids), self.row_tokens):
            self.pieces.append((doc_id, start, ids[start : start + length]))

    def full(self) -> bool:
        return self.tokens >= SHARD_TOKENS or self.documents >= SHARD_DOCUMENTS

    def rows(self, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        packed = best_fit_decreasing([len(ids) for _, _, ids in self.pieces], self.row_tokens)
        for first in range(0, len(packed), WRITTEN_ROWS):
            rows = [
                self._row(name, number, [self.pieces[i] for i in packed[number]])
                for number in range(first, min(first + WRITTEN_ROWS, len(packed)))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)
        self.clear()

    def _row(self, name: str, number: int, pieces: list[tuple[object, int, np.ndarray]]) -> dict:
        lengths = [len(ids) for _, _, ids in pieces]
        ends = list(accumulate(lengths, initial=0))
        row = np.full(self.row_tokens, PAD, ID_TYPE)
        row[: ends[-1]] = np.concatenate([ids for _, _, ids in pieces])
        return {
            "shard": name,
            "row": number,
            "ids": row.tobytes(),
            "n_tokens": ends[-1],
            "lengths": ends,
            "resets": [start for start, length in zip(ends, lengths) if length],
            "doc_ids": [doc_id for doc_id, _, _ in pieces],
            "offsets": [start for _, start, _ in pieces],
        }


def packed_rows(
    docs: DataFrame, row_tokens: int = ROW_TOKENS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """The packed rows of ``docs`` (doc_id, text).

    ``lengths`` are cumulative, from 0; segment i of a row is of document
    ``doc_ids[i]`` and begins at its token ``offsets[i]``.  ``resets`` are the
    places at which positions start at 0 again.  Null texts count as empty; a
    document without tokens is an empty segment of some row, so each document is
    in the result.  Copies and repeated ids are packed each by itself.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = SCHEMA.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, number = PieceIds(vocabulary), _Shard(row_tokens), 0
        task = TaskContext.get().partitionId()
        for part in byte_slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                shard.add(doc_id, pieces.ids(text))
                if shard.full():
                    yield from shard.rows(f"{task}-{number}", schema)
                    number += 1
        yield from shard.rows(f"{task}-{number}", schema)

    selected = docs.select("doc_id", "text")
    schema = to_arrow_schema(selected.sparkSession.createDataFrame([], ddl).schema)
    return selected.mapInArrow(run, ddl)


def write_packed(docs: DataFrame, **settings) -> DataFrame:
    """Write the packed rows to a table in the shared folder and return it."""
    return materialize(packed_rows(docs, **settings), "packed-ids")


def unpacked(packed: DataFrame) -> DataFrame:
    """doc_id, offset and ids (array) of every segment, the way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"doc_id": [], "offset": [], "ids": []}
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], ID_TYPE)
                for i, doc_id in enumerate(row["doc_ids"]):
                    found["doc_id"].append(doc_id)
                    found["offset"].append(row["offsets"][i])
                    found["ids"].append(ids[row["lengths"][i] : row["lengths"][i + 1]].astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                found,
                pa.schema([("doc_id", batch.schema.field("doc_ids").type.value_type), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]),
            )

    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()
    columns = packed.select("ids", "lengths", "doc_ids", "offsets")
    return columns.mapInArrow(run, f"doc_id {kind}, offset long, ids array<int>")


def digests(packed: DataFrame) -> DataFrame:
    """The packed rows with the SHA-256 of their ids in place of the ids."""
    return packed.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
