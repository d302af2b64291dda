"""Best-fit packing with several permitted lengths of a sequence.

Items are placed from the longest on, in the open bin, of whatever length, with
the least room that takes them.  If none does, a bin is opened: for each length that
holds the item it is tried out how far the items still to be placed would fill it, and
the length with the least cost for a token that it would carry is taken.  The cost of a
length has a fixed part, a part for each token and one for attention, which grows with
the square; so the lengths compete, and which one wins depends on what is left.  At
the end each bin is given the shortest length that holds its content.

The same is done with one length preferred wherever it holds the item, for each length,
and the cheapest of these packings is the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trendloom.llm.byte_bpe import VOCABULARY, PieceIds
from trendloom.llm.capacity_tree import CapacityTree
from trendloom.llm.text import byte_slices, texts_of
from trendloom.llm.token_packing import split

#: Documents packed together by a task.
SHARD_DOCUMENTS = 100_000


@dataclass(frozen=True)
class Lengths:
    """Permitted lengths and what a sequence costs: fixed + length + length ** 2 / attention."""

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    fixed: float = 256.0
    attention: float = 16384.0

    def cost(self, length: int) -> float:
        return self.fixed + length + length**2 / self.attention


def filled(ordered: list[int], start: int, room: int) -> int:
    """Tokens of the items from ``start`` on that go into the room, the longest that fits each time.

    ``ordered`` has the sizes as negative numbers, the longest first.
    """
    used = 0
    while (start := bisect_left(ordered, used - room, start)) < len(ordered) and ordered[start]:
        used -= ordered[start]
        start += 1
    return used


def _packed(
    sizes: list[int], order: list[int], lengths: Lengths, preferred: int | None
) -> tuple[float, list[tuple[int, list[int]]]]:
    """Cost and bins; without a preferred length each bin's is chosen by what is left to place.

    ``order`` has the numbers of the items, the longest first.
    """
    permitted = sorted(lengths.permitted)
    open_bins = CapacityTree(permitted[-1])
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # length and what is free of it
    ordered = [-sizes[i] for i in order]
    for place, item in enumerate(order):
        size = sizes[item]
        found = open_bins.take(size)
        if found is None:
            holding = permitted[bisect_left(permitted, max(size, preferred or 0)) :] or permitted[-1:]
            length = holding[0]
            if preferred is None:
                carried = {n: size + filled(ordered, place + 1, n - size) for n in holding}
                length = min(holding, key=lambda n: (lengths.cost(n) / max(1, carried[n]), n))
            found = length, len(bins)
            bins.append([])
            rooms.append((length, length))
        free, number = found
        bins[number].append(item)
        rooms[number] = rooms[number][0], free - size
        open_bins.put(free - size, number)
    sized = [(permitted[bisect_left(permitted, length - free)], items) for (length, free), items in zip(rooms, bins)]
    cost = {length: lengths.cost(length) for length in permitted}
    return sum(cost[length] for length, _ in sized), sized


def pack(sizes: list[int], lengths: Lengths) -> list[tuple[int, list[int]]]:
    """Bins as their length and the numbers of their items; no item is longer than the longest."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    tried = [_packed(sizes, order, lengths, preferred) for preferred in (None, *sorted(lengths.permitted))]
    return min(tried, key=lambda found: found[0])[1]


SCHEMA = "doc_id {id}, piece int, n_tokens int, bin string, start int, capacity int, used int"


def packed_documents(
    docs: DataFrame, lengths: Lengths = Lengths(), vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per piece of a document: its bin, where it starts there, the bin's length and use.

    Lengths are token counts of whole texts.  A document longer than the longest
    permitted length is split into pieces of that length and a rest.  Null and
    empty texts are one empty piece.  Copies and repeated ids are packed each by
    itself.  Tasks pack what they read, in shards of a bounded number of
    documents; nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    longest = max(lengths.permitted)

    def rows(name: str, ids: list, sizes: list[int], id_type: pa.DataType) -> pa.RecordBatch:
        pieces = [
            (doc, number, length)
            for doc, size in enumerate(sizes)
            for number, (_, length) in enumerate(split(size, longest))
        ]
        found = {name: [] for name in ("doc_id", "piece", "n_tokens", "bin", "start", "capacity", "used")}
        for number, (capacity, items) in enumerate(pack([p[2] for p in pieces], lengths)):
            inside = [pieces[i] for i in items]
            ends = np.cumsum([length for _, _, length in inside])
            found["doc_id"] += [ids[doc] for doc, _, _ in inside]
            found["piece"] += [piece for _, piece, _ in inside]
            found["n_tokens"] += [length for _, _, length in inside]
            found["bin"] += [f"{name}-{number}"] * len(inside)
            found["start"] += [int(end) - p[2] for end, p in zip(ends, inside)]
            found["capacity"] += [capacity] * len(inside)
            found["used"] += [int(ends[-1])] * len(inside)
        types = dict.fromkeys(found, pa.int32()) | {"doc_id": id_type, "bin": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in found.items()], list(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, shard = PieceIds(vocabulary), TaskContext.get().partitionId(), 0
        ids, sizes = [], []
        for part in byte_slices(batches, "text"):
            ids += part.column("doc_id").to_pylist()
            sizes += tokens.count(texts_of(part))
            if len(ids) >= SHARD_DOCUMENTS:
                yield rows(f"{task}-{shard}", ids, sizes, part.schema.field("doc_id").type)
                ids, sizes, shard = [], [], shard + 1
            kind_of_id = part.schema.field("doc_id").type
        if ids:
            yield rows(f"{task}-{shard}", ids, sizes, kind_of_id)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=kind))
