"""Removing byte passages that an earlier document holds, by suffix sorting.

A byte goes if a string of ``length`` bytes covers it that also starts in a
document with a smaller id.  Every such string (a window) has an anchor, the
20 bytes in it with the smallest hash, so equal windows have equal anchors.

1. Documents are dealt into even batches, in one bucketed table that all later jobs
   read without moving texts again.
2. Batches list their anchors; an anchor that occurs in one document only can't
   be in a repeated window and is forgotten.
3. For each other anchor a batch cuts out the runs of windows that have it (the
   slices), equal ones once, with the smallest id, and sends them to the shard of
   the anchor.  What one batch sends for an anchor does not grow with the copies it has.
4. Where all slices of an anchor are equal, the smallest id owns all of their windows.
   A shard lays the slices of the other anchors into one file and sorts all suffixes by
   external induced sorting (``induced_sorting``).  Neighbours with a common prefix of
   ``length`` bytes hold equal windows; the smallest id of such a group owns the window.
5. One bit per window goes back to the batch: whether it belongs to a smaller id.
   The batch unites the spans of its documents and cuts them out.

All decisions are made on the input texts; matches never cross documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.induced_sorting import Queue, Text, prefixes, sorted_suffixes
from trendloom.llm.induced_sorting import places as positions
from trendloom.llm.text import mixed
from trendloom.session import materialize, scratch_path

LENGTH = 50
ANCHOR = 20
#: Bytes of text for each batch, and for each shard of slices; both may get more.
BATCH_BYTES, SHARD_BYTES = 2 << 20, 3 << 20
#: Digests of slices a shard remembers, and bytes of slices that wait for a different one.
REMEMBERED, WAITING = 500_000, 64 << 20

SPREAD = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xD6E8FEB86659FD93)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ANCHOR bytes from each place on."""
    n = len(data) - ANCHOR + 1
    words = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,)).copy()
    found = words[:n] * SPREAD
    for start, shift in ((8, 29), (ANCHOR - 8, 32)):
        found ^= found >> np.uint64(shift)
        found += words[start : start + n]
        found *= OTHER
    found ^= found >> np.uint64(31)
    return found


def slices_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor: text, first window, windows, anchor's hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    least, step, wanted = _hashes(data), 1, length - ANCHOR + 1
    while 2 * step <= wanted:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wanted > step:
        least = np.minimum(least[: len(least) - (wanted - step)], least[wanted - step :])
    # A window starts at every byte of a text but the last ones; a run ends with them.
    sizes = np.array([len(text) for text in texts])
    begin = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    inside = np.zeros(len(data) + 1, np.int8)
    some = np.flatnonzero(windows)
    inside[begin[some]] += 1
    inside[begin[some] + windows[some]] -= 1
    inside = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
    new = np.r_[True, least[1:] != least[:-1]]
    new[begin[some]] = True
    first = np.flatnonzero(new & inside)
    # Up to the next run, or to the last window of its text.
    text = np.searchsorted(begin[some], first, side="right") - 1
    end = np.minimum(np.r_[first[1:], len(least)], (begin[some] + windows[some])[text])
    return some[text], first - begin[some][text], end - first, least[first]


class _Batch:
    """The documents of a batch in the order of their ids, and their slices."""

    def __init__(self, table: pa.Table, length: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        rows = table.column("row").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (_rank(ids[i]), rows[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [(texts[i] or "").encode("utf-8") for i in order]
        self.length = length
        self.text, self.first, self.count, self.anchor = slices_of(self.texts, length)
        self.key = mixed(self.anchor)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and whether documents of different ids have each."""
        if not len(self.key):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        number = self.numbers()[self.text]
        order = np.lexsort((number, self.key))
        key, number = self.key[order], number[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        stops = np.r_[starts[1:], len(key)] - 1
        return key[starts], number[starts] != number[stops]

    def numbers(self) -> np.ndarray:
        """A number for each document that is the same for the same id."""
        known: dict = {}
        return np.array([known.setdefault(x, len(known)) for x in self.ids], np.int64)

    def shared(self, keys: np.ndarray, shards: int) -> _Groups:
        """Slices whose anchor is shared, grouped by shard, anchor and content, in a fixed order."""
        keys = np.sort(keys)
        at = np.searchsorted(keys, self.key).clip(max=max(len(keys) - 1, 0))
        some = np.flatnonzero(keys[at] == self.key) if len(keys) else np.zeros(0, np.int64)
        data = b"".join(self.texts)
        sizes = np.array([len(text) for text in self.texts], np.int64)
        start = (np.cumsum(sizes) - sizes)[self.text[some]] + self.first[some]
        end = start + self.count[some] + self.length - 1
        digests = b"".join([xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(start.tolist(), end.tolist())])
        high, low = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        shard = ((self.key[some] >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((some, low, high, self.key[some], shard))
        columns = [x[order] for x in (shard, self.key[some], high, low)]
        new = np.zeros(len(order), bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        new[:1] = True
        starts = np.flatnonzero(new)
        first = order[starts]
        slices = some[order]
        return _Groups(
            slices, np.cumsum(new) - 1, columns[0][starts], columns[1][starts],
            np.minimum.reduceat(self.text[slices], starts) if len(starts) else np.zeros(0, np.int64),
            [data[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())],
        )


@dataclass
class _Groups:
    """Equal slices of a batch together, sorted by their shard, anchor and content."""

    slices: np.ndarray  # of the batch, group after group
    group: np.ndarray  # of each of these
    shard: np.ndarray  # of each group, rising
    key: np.ndarray
    owner: np.ndarray  # the first document of the batch that has it
    contents: list[bytes]

    def of_shards(self) -> Iterator[tuple[int, slice]]:
        """Shards, and where their groups are."""
        cuts = np.flatnonzero(np.diff(self.shard, prepend=-1, append=-1))
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(self.shard[start]), slice(start, stop)


def _rank(doc_id) -> tuple:
    """Ids in order, null as the largest."""
    return (doc_id is None, doc_id if doc_id is not None else 0)


def _group(key: np.ndarray, groups: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _tabled(docs: DataFrame, batches: int) -> DataFrame:
    """doc_id, text, row and batch, written once in buckets of batches.

    The catalog forgets the table at once; what reads its files knows their buckets.
    """
    spark = docs.sparkSession
    buckets = max(1, min(batches, max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches // 32)))
    name = f"trendloom_{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(batches)).cast("int"))
    rows.repartition(buckets, "batch").write.bucketBy(buckets, "batch").sortBy("batch").option("compression", "zstd").option(
        "path", scratch_path(spark, "suffix-batches")
    ).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _anchors(table: DataFrame, groups: int, length: int) -> DataFrame:
    """group, batch, keys (32 bits each) and shared (one byte each): anchors of a batch."""

    def run(part: pa.Table) -> pa.Table:
        batch = part.column("batch")[0].as_py()
        keys, shared = _Batch(part, length).anchors()
        found = {"group": [], "batch": [], "keys": [], "shared": []}
        group = _group(keys, groups)
        for number in np.unique(group).tolist():
            mine = group == number
            found["group"].append(number)
            found["batch"].append(batch)
            found["keys"].append(keys[mine].astype(np.uint32).tobytes())
            found["shared"].append(shared[mine].tobytes())
        return pa.table(found, pa.schema([("group", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("shared", pa.binary())]))

    return table.groupBy("batch").applyInArrow(run, "group int, batch int, keys binary, shared binary")


def _shared_anchors(anchors: DataFrame) -> DataFrame:
    """group, batch and the keys of the batch that documents of different ids have.

    Keys of a group are told apart by 32 bits; two that are mistaken for one only
    cost the look at a slice.
    """

    def run(part: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in part.column("keys").to_pylist()]
        flags = [np.frombuffer(x, bool) for x in part.column("shared").to_pylist()]
        distinct, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        several = times > 1
        several[place[np.concatenate(flags)]] = True
        ends = np.cumsum([len(x) for x in keys])
        mine = [x[several[place[end - len(x) : end]]].tobytes() for x, end in zip(keys, ends)]
        return pa.table({"group": part.column("group"), "batch": part.column("batch"), "keys": pa.array(mine, pa.binary())})

    return anchors.groupBy("group").applyInArrow(run, "group int, batch int, keys binary")


def _keys_of(part: pa.Table, batch: _Batch, groups: int) -> np.ndarray:
    """The batch's own keys that are shared, whole."""
    keys = np.unique(batch.key)
    group = _group(keys, groups)
    found = []
    for number, some in zip(part.column("group").to_pylist(), part.column("keys").to_pylist()):
        if some is not None:
            mine = keys[group == number]
            found.append(mine[np.isin(mine.astype(np.uint32), np.frombuffer(some, np.uint32))])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _slices(table: DataFrame, shared: DataFrame, groups: int, shards: int, length: int) -> DataFrame:
    """shard, batch, data, sizes, keys and owners: distinct slices of shared anchors."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        found = {"shard": [], "batch": [], "data": [], "sizes": [], "keys": [], "owners": []}
        schema = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), *((name, pa.binary()) for name in ("data", "sizes", "keys")), ("owners", pa.list_(docs.schema.field("doc_id").type if docs.num_rows else pa.int64()))])
        if docs.num_rows and back.num_rows:
            batch = _Batch(docs, length)
            groups_of = batch.shared(_keys_of(back, batch, groups), shards)
            for shard, some in groups_of.of_shards():
                contents = groups_of.contents[some]
                found["shard"].append(shard)
                found["batch"].append(docs.column("batch")[0].as_py())
                found["data"].append(b"".join(contents))
                found["sizes"].append(np.array([len(c) for c in contents], np.int64).tobytes())
                found["keys"].append(groups_of.key[some].tobytes())
                found["owners"].append([batch.ids[i] for i in groups_of.owner[some].tolist()])
        return pa.table(found, schema)

    return table.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(
        run, f"shard int, batch int, data binary, sizes binary, keys binary, owners array<{kind}>"
    )


class _Shard:
    """Distinct slices of one shard, laid into a file as they arrive.

    Slices that several batches send alike are one string with the smallest owner, as
    long as its digest is remembered; one that is forgotten is only sorted again.  The
    first slice of an anchor waits until another one of the anchor differs from it; as
    long as none does, it needs no sorting.
    """

    def __init__(self, number: int, length: int):
        self.number, self.length = number, length
        self.text = Text(length)
        self.windows = Queue(self.text.held, np.dtype([("start", "<i8"), ("first", "<i8"), ("number", "<i8")]))
        self.owners: list[tuple] = []  # rank of the smallest owner of each distinct slice
        self.counts: list[int] = []  # and its windows
        self.known: dict[bytes, int] = {}
        self.firsts: dict[int, int] = {}  # the first slice of each anchor
        self.waiting: dict[int, bytes] = {}
        self.waiting_bytes = 0
        self.rows: list[tuple[int, np.ndarray, list[tuple]]] = []  # batch, its slices, their owners
        self.n_windows = 0

    def add(self, batch: int, data: bytes, sizes: np.ndarray, keys: np.ndarray, owners: list) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        numbers, ready, start = [], [], 0
        ranks = [_rank(owner) for owner in owners]
        for size, key, rank in zip(sizes.tolist(), keys.tolist(), ranks):
            content = data[start : start + size]
            start += size
            digest = xxhash.xxh3_128_digest(content)
            number = self.known.get(digest)
            if number is None:
                number = self.known[digest] = len(self.owners)
                self.owners.append(rank)
                self.counts.append(size - self.length + 1)
                first = self.firsts.setdefault(key, number)
                if first == number:
                    self.waiting[number] = content
                    self.waiting_bytes += size
                else:
                    if first in self.waiting:
                        ready.append((first, self._taken_out(first)))
                    ready.append((number, content))
            elif rank < self.owners[number]:
                self.owners[number] = rank
            numbers.append(number)
        self.rows.append((batch, np.array(numbers, np.int64), ranks))
        if self.waiting_bytes > WAITING:
            ready += [(number, self._taken_out(number)) for number in list(self.waiting)]
        if ready:
            self._lay(ready)

    def _taken_out(self, number: int) -> bytes:
        content = self.waiting.pop(number)
        self.waiting_bytes -= len(content)
        return content

    def _lay(self, slices: list[tuple[int, bytes]]) -> None:
        """Add the slices (number, content) to the text, each with a gap behind it."""
        sizes = np.array([len(content) for _, content in slices], np.int64)
        n = np.arange(len(sizes))
        before = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
        data = np.frombuffer(b"".join([content for _, content in slices]), np.uint8)
        symbols[np.arange(len(data)) + np.repeat(n, sizes)] = data.astype(np.uint16) + 1
        counts = sizes - self.length + 1
        rows = np.empty(len(sizes), self.windows.dtype)
        rows["start"] = self.text.size + before + n
        rows["first"] = self.n_windows + np.cumsum(counts) - counts
        rows["number"] = [number for number, _ in slices]
        self.windows.put(rows)
        self.text.append(symbols)
        self.n_windows += int(counts.sum())

    def taken(self) -> np.ndarray:
        """For each window that was laid whether a document with a smaller id than its slice's owner has it.

        Suffixes come in order; those with a common prefix of a window's length are a
        group.  Its smallest owner is known once the group ends, so owners are compared
        in a second pass over the sorted windows.
        """
        self.text.close()
        slices = self.windows.take(len(self.windows))
        starts, last = slices["start"], slices["first"]
        self.first = np.full(len(self.owners), -1, np.int64)
        self.first[slices["number"]] = last
        if not len(slices):
            return np.zeros(0, bool)
        counts = np.diff(np.r_[last, self.n_windows])
        laid = [self.owners[number] for number in slices["number"].tolist()]
        places = {rank: place for place, rank in enumerate(sorted(set(laid)))}
        place = np.array([places[rank] for rank in laid], np.int64)
        ordered = Queue(self.text.held, np.dtype([("window", "<i8"), ("owner", "<i4"), ("new", "?")]))
        least = Queue(self.text.held, np.dtype("<i4"))
        open_least, any_open, pending = 0, False, False
        for items in sorted_suffixes(self.text):
            at = positions(items)
            of = (np.searchsorted(starts, at, side="right") - 1).clip(0)
            offset = at - starts[of]
            new = prefixes(items) < self.length
            good = (offset >= 0) & (offset < counts[of])
            # A break before a suffix that is no window still ends the group.
            group = np.cumsum(new)
            some = np.flatnonzero(good)
            if len(some):
                own = group[some]
                begins = np.r_[own[0] > 0 or pending or not any_open, own[1:] != own[:-1]]
                part = np.empty(len(some), ordered.dtype)
                part["window"] = last[of[some]] + offset[some]
                part["owner"] = place[of[some]]
                part["new"] = begins
                ordered.put(part)
                cuts = np.flatnonzero(begins)
                values = part["owner"]
                if not begins[0]:
                    upto = cuts[0] if len(cuts) else len(values)
                    open_least = min(open_least, int(values[:upto].min()))
                if len(cuts):
                    if any_open:
                        least.put(np.array([open_least], "<i4"))
                    minima = np.minimum.reduceat(values, cuts)
                    least.put(minima[:-1].astype("<i4"))
                    open_least, any_open = int(minima[-1]), True
                pending = bool(new[some[-1] + 1 :].any())
            else:
                pending = pending or bool(new.any())
        if any_open:
            least.put(np.array([open_least], "<i4"))
        result = np.zeros(self.n_windows, bool)
        current = np.zeros(0, np.int32)
        for part in _taken(ordered):
            begins = int(part["new"].sum())
            minima = np.r_[current[-1:], least.take(begins)]
            which = np.cumsum(part["new"]) - (0 if len(current) else 1)
            result[part["window"]] = part["owner"] > minima[which]
            current = minima
        ordered.clear()
        return result

    def answers(self) -> Iterator[tuple[int, bytes]]:
        """Batch and one bit per window, in the order in which its slices came."""
        if not self.rows:
            return
        taken, sizes = np.r_[self.taken(), False], np.array(self.counts, np.int64)
        for batch, numbers, ranks in self.rows:
            counts, first = sizes[numbers], self.first[numbers]
            ends = np.cumsum(counts)
            at = np.arange(int(counts.sum())) + np.repeat(first - (ends - counts), counts)
            at[np.repeat(first < 0, counts)] = -1  # never sorted: nobody before the smallest owner
            later = np.array([rank > self.owners[number] for rank, number in zip(ranks, numbers.tolist())], bool)
            yield batch, np.packbits(taken[at] | np.repeat(later, counts)).tobytes()


def _taken(queue: Queue) -> Iterator[np.ndarray]:
    while len(part := queue.take()):
        yield part


def _owned_earlier(slices: DataFrame, shards: int, length: int) -> DataFrame:
    """shard, batch and bits: which windows of the batch's slices belong to smaller ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(shard: _Shard) -> pa.RecordBatch:
            answers = list(shard.answers())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard.number] * len(answers), pa.int32()),
                    pa.array([batch for batch, _ in answers], pa.int32()),
                    pa.array([bits for _, bits in answers], pa.binary()),
                ],
                ["shard", "batch", "bits"],
            )

        shard = None
        for part in parts:
            columns = [part.column(name) for name in ("shard", "batch", "data", "sizes", "keys", "owners")]
            for number, batch, data, sizes, keys, owners in zip(*columns):
                if shard is None or shard.number != number.as_py():
                    if shard is not None:
                        yield close(shard)
                    shard = _Shard(number.as_py(), length)
                arrays = np.frombuffer(sizes.as_py(), np.int64), np.frombuffer(keys.as_py(), np.uint64)
                shard.add(batch.as_py(), data.as_py(), *arrays, owners.as_py())
        if shard is not None:
            yield close(shard)

    dealt = slices.repartition(shards, "shard").sortWithinPartitions("shard", "batch")
    return dealt.mapInArrow(run, "shard int, batch int, bits binary")


def _cut(table: DataFrame, back: DataFrame, groups: int, shards: int, length: int) -> DataFrame:
    """The documents without the bytes that go: doc_id, kept (bytes), n_bytes, starts and ends."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in (("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())))})
        batch = _Batch(docs, length)
        bits = {s: b for s, b in zip(back.column("shard").to_pylist(), back.column("bits").to_pylist()) if b is not None}
        of = batch.shared(_keys_of(back, batch, groups), shards)
        windows = np.array([len(content) - length + 1 for content in of.contents], np.int64)
        taken = [np.zeros(0, bool)]
        for shard, some in of.of_shards():
            taken.append(np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=int(windows[some].sum())).astype(bool))
        edges = _edges(batch, of, windows, np.concatenate(taken))
        found = {"doc_id": pa.array(batch.ids, docs.schema.field("doc_id").type), "kept": [], "n_bytes": [], "starts": [], "ends": []}
        for text, edge in zip(batch.texts, edges):
            gone = np.cumsum(edge[:-1]) > 0
            change = np.diff(np.r_[False, gone, False].astype(np.int8))
            found["starts"].append(np.flatnonzero(change == 1))
            found["ends"].append(np.flatnonzero(change == -1))
            found["kept"].append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            found["n_bytes"].append(len(text))
        return pa.table(found, pa.schema([("doc_id", docs.schema.field("doc_id").type), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    return table.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(
        run, f"doc_id {kind}, kept binary, n_bytes long, starts array<long>, ends array<long>"
    )


def _edges(batch: _Batch, of: _Groups, windows: np.ndarray, taken: np.ndarray) -> list[np.ndarray]:
    """For each text and byte how many removed spans begin there, less those that end.

    A later id loses the whole slice to the group's owner; the owner what is older.
    """
    length, numbers = batch.length, batch.numbers()
    sizes = np.array([len(text) + 1 for text in batch.texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    start = begin[batch.text[of.slices]] + batch.first[of.slices]
    whole = numbers[batch.text[of.slices]] != numbers[of.owner[of.group]]
    n = windows[of.group]
    # The windows of the slices that keep what is theirs, each with its place in ``taken``.
    own, first = np.flatnonzero(~whole), np.cumsum(windows) - windows
    counts = n[own]
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    gone = taken[np.repeat(first[of.group[own]], counts) + offset]
    single = (np.repeat(start[own], counts) + offset)[gone]
    total = int(sizes.sum())
    opened = np.bincount(np.r_[start[whole], single], minlength=total)
    closed = np.bincount(np.r_[(start + n - 1 + length)[whole], single + length], minlength=total)
    return np.split(opened - closed, begin[1:])


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (the bytes that stay), n_bytes, starts, ends.

    ``starts`` and ``ends`` are the removed runs.  Null texts are empty.  Rows with the
    same id are one document's, so they do not take from each other; a null id is
    larger than any other.  ``length`` is at least 27 and at most 63 bytes.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / BATCH_BYTES))
    groups, shards = max(1, math.ceil(batches / 16)), max(1, math.ceil(size / SHARD_BYTES))
    table = _tabled(docs, batches)
    shared = materialize(_shared_anchors(_anchors(table, groups, length)), "suffix-anchors")
    slices = _slices(table, shared, groups, shards, length)
    bits = materialize(_owned_earlier(slices, shards, length), "suffix-bits")
    back = shared.select("batch", "group", "keys", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("bits"))
    back = back.unionByName(bits.select("batch", F.lit(None).cast("int").alias("group"), F.lit(None).cast("binary").alias("keys"), "shard", "bits"))
    return _cut(table, back, groups, shards, length)


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
