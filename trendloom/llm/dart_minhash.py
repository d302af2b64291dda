"""Near duplicates by DartMinHash signatures, banding and exact verification.

A text is the multiset of its shingles of five words.  The c-th occurrence of a
shingle is an element region of weight one; along its other side runs the rank.
Darts are thrown into unit squares of region and rank, one expected in each, where
they fall being a hash of the square; a dart is also dealt to one of the
signature's coordinates.  A coordinate keeps its earliest dart (the smallest
rank).  Two texts keep the same dart with a probability that is their weighted
Jaccard similarity.  As many squares are looked at as fill all coordinates: about
k ln k + 2k darts in all, not k for each shingle.

Texts that agree in all coordinates of a band are candidates.  What follows never
lists the pairs of a bucket:

1. equal texts are one node;
2. each node of a bucket is compared with the bucket's smallest node, exactly;
3. links make components; a bucket whose nodes are all in one component is done;
4. in the others the nodes of different components are compared with each other, in
   blocks inside tasks, and only links that join components come out: no link
   between candidates is lost, and no pair that is none becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.components import connected_components
from trendloom.llm.exact_dedup import drop_flagged, normalised
from trendloom.llm.text import WORD, WordHashes, byte_slices, mixed, texts_of
from trendloom.session import materialize

WORDS = 5
THRESHOLD = 0.8
#: Nodes of a bucket compared with as many others in one task at a time.
BLOCK = 512


@dataclass(frozen=True)
class Bands:
    """With 24 bands of 5 a pair of similarity 0.8 meets with probability 0.9999."""

    bands: int = 24
    rows: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
#: Chances of at most 0, 1, 2 ... darts in a unit square.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 20)]))
RANK_BITS = np.uint64(44)
NONE = np.uint64(2**64 - 1)


def elements(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Element regions of texts: the text each is of, ascending, and its 64-bit hash.

    A text of fewer than five words is one shingle, one without words has none.
    """
    words = [WORD.findall(text) for text in texts]
    sizes = np.array([len(found) for found in words], np.int64)
    flat = np.concatenate([hashes.of(found) for found in words]) if len(words) else np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes > 0, np.maximum(sizes - WORDS + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    shingles = np.repeat(mixed(np.minimum(sizes, WORDS).astype(np.uint64)), counts)
    end = np.repeat(starts + sizes, counts)
    for i, multiplier in enumerate(MULTIPLIERS):
        at = first + i
        inside = at < end
        shingles[inside] += mixed(flat[at[inside]] * multiplier)
    order = np.lexsort((shingles, text))
    text, shingles = text[order], shingles[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])][: len(text)]
    run = np.flatnonzero(new)
    occurrence = np.arange(len(text)) - np.repeat(run, np.diff(np.r_[run, len(text)]))
    return text, mixed(shingles + occurrence.astype(np.uint64) * GOLDEN)


def signatures(text: np.ndarray, regions: np.ndarray, n: int, size: int) -> np.ndarray:
    """The earliest dart's rank in each coordinate, for n texts; all ones without regions."""
    kept = np.full(n * size, NONE)
    weight = np.bincount(text, minlength=n)
    wanted = size * np.log(size) + 2 * size
    # Squares of ranks from ``low`` to ``high`` are thrown at; ever higher until all is filled.
    low = np.zeros(n, np.int64)
    high = np.where(weight > 0, np.ceil(wanted / np.maximum(weight, 1)), 0).astype(np.int64)
    while True:
        _throw(text, regions, low, high, size, kept)
        empty = (kept.reshape(n, size) == NONE).any(axis=1) & (weight > 0)
        if not empty.any():
            return kept.reshape(n, size)
        low, high = high, np.where(empty, 2 * high, high)


def _throw(text, regions, low, high, size, kept) -> None:
    """Throw the darts of ranks low to high of each text, in parts of bounded size."""
    levels = (high - low)[text]
    part = np.cumsum(levels) >> 20
    for number in np.unique(part[levels > 0]):
        some = np.flatnonzero((part == number) & (levels > 0))
        count = levels[some]
        of = np.repeat(some, count)
        level = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[text[of]]
        square = mixed(regions[of] + mixed(level.astype(np.uint64) * GOLDEN + np.uint64(1)))
        darts = np.searchsorted(POISSON, (square >> np.uint64(11)) * 2.0**-53, side="right")
        at = np.repeat(np.arange(len(square)), darts)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mixed(square[at] + (turn + 1).astype(np.uint64) * GOLDEN)
        rank = (level[at].astype(np.uint64) << RANK_BITS) | (dart >> (np.uint64(64) - RANK_BITS))
        coordinate = (mixed(dart + GOLDEN) % np.uint64(size)).astype(np.int64)
        np.minimum.at(kept, text[of[at]] * size + coordinate, rank)


def band_keys(signature: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit key for each text and band."""
    split = signature.reshape(len(signature), bands.bands, bands.rows)
    keys = np.zeros(split.shape[:2], np.uint64) + mixed(np.arange(bands.bands, dtype=np.uint64) + np.uint64(7))
    for row in range(bands.rows):
        keys = mixed(keys + mixed(split[:, :, row] + GOLDEN))
    return keys.view(np.int64)


def node_of(text: str = "text") -> Column:
    """128 bits of the SHA-256 of a text's words, joined by single blanks."""
    words = F.trim(normalised(text))
    return F.substring(F.unhex(F.sha2(words, 256)), 1, 16)


def _keys(docs: DataFrame, bands: Bands) -> DataFrame:
    """doc_id, node and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in byte_slices(batches, "text"):
            texts = texts_of(part)
            signature = signatures(*elements(texts, hashes), len(texts), bands.size)
            keys = pa.FixedSizeListArray.from_arrays(band_keys(signature, bands).ravel(), bands.bands)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("node"), keys.cast(pa.list_(pa.int64()))],
                ["doc_id", "node", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", node_of().alias("node"))
    return rows.mapInArrow(run, f"doc_id {kind}, node binary, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its element regions, sorted 64-bit numbers, for the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in byte_slices(batches, "text"):
            text, regions = elements(texts_of(part), hashes)
            regions = regions[np.lexsort((regions, text))]
            ends = np.searchsorted(text, np.arange(part.num_rows + 1))
            sets = [regions[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "regions"])

    # Copies of a text are combined by each task before anything moves.
    texts = docs.select(node_of().alias("node"), "text").groupBy("node").agg(F.first("text").alias("text"))
    return texts.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(run, "node binary, regions binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sets of element regions."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return 0.0  # the sizes alone keep it below
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [
                similarity(a, b) >= THRESHOLD
                for a, b in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    of_a = sets.select(F.col("node").alias("a"), F.col("regions").alias("of_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("regions").alias("of_b"))
    return pairs.join(of_b, "b").join(of_a, "a").mapInArrow(run, "a binary, b binary")


def _joining_links(nodes: list[bytes], roots: list[bytes], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray):
    """Pairs of a left and a right node that reach the threshold, enough of them to join their components.

    Common regions of all pairs are counted by one product of 0/1 matrices over the
    regions that more than one node has.
    """
    found, of = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(of, minlength=len(found)) > 1
    column = np.cumsum(shared) - 1
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    some = shared[of]
    has = np.zeros((len(sets), int(shared.sum())), np.float32)
    has[row[some], column[of[some]]] = 1
    both = has[left] @ has[right].T
    near = both >= THRESHOLD * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9
    parent: dict[bytes, bytes] = {}

    def top(root: bytes) -> bytes:
        while parent.get(root, root) != root:
            root = parent[root]
        return root

    for x, y in zip(*np.nonzero(near)):
        a, b = left[x], right[y]
        low, high = top(roots[a]), top(roots[b])
        if low != high:
            parent[high] = low
            yield max(nodes[a], nodes[b]), min(nodes[a], nodes[b])


def _stray_links(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components that share a bucket, enough to join what is to be joined.

    Buckets are cut into blocks of nodes; each pair of blocks is compared in one
    group.
    """
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
    )
    # A bucket of two has been compared already.
    several = several.filter((F.col("low") != F.col("high")) & (F.col("n") > 2)).select("key", "n")
    strays = placed.join(materialize(several, "stray-buckets"), "key").select("key", "node", "root", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(other, "block").alias("i"), F.greatest(other, "block").alias("j")),
    )
    grouped = (
        strays.withColumn("block", F.pmod(F.hash("node", "key"), blocks))
        .join(sets, "node")
        .withColumn("pair", F.explode(others))
        .select("key", "pair.i", "pair.j", "block", "node", "root", "regions")
    )

    def compare(group: pa.Table) -> pa.Table:
        nodes, roots = group.column("node").to_pylist(), group.column("root").to_pylist()
        block = group.column("block").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sets = [np.unique(np.frombuffer(x, np.uint64)) for x in group.column("regions").to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = list(_joining_links(nodes, roots, sets, left, right)) if len(left) and len(right) else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return grouped.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, row, class_id, class_size and kept.

    ``class_id`` is the smallest doc_id among the rows that chains of links join to
    the row; that row is kept, one row if ids repeat (null ids come last).  Texts
    with the same words are always of one class, also all texts without words.
    """
    rows = materialize(_keys(docs, bands).withColumn("row", F.monotonically_increasing_id()), "dart-keys")
    nodes = materialize(rows.groupBy("node").agg(F.first("keys").alias("keys")), "dart-nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n"))
    buckets = materialize(buckets.filter("n > 1").select("key", "pivot"), "dart-buckets")
    members = materialize(banded.join(buckets, "key"), "dart-members")
    pairs = materialize(
        members.filter(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(),
        "dart-pairs",
    )
    candidates = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = materialize(_sets(docs, materialize(candidates.distinct(), "dart-candidates")), "dart-sets")
    links = materialize(_verified(pairs, sets), "dart-links")
    roots = materialize(connected_components(links), "dart-roots")
    more = materialize(_stray_links(members, roots, sets), "dart-more-links")
    if more.limit(1).count():
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = materialize(connected_components(known.unionByName(more)), "dart-roots")
    classed = materialize(
        rows.select("doc_id", "node", "row")
        .join(roots, "node", "left")
        .select("doc_id", "node", "row", F.coalesce("root", "node").alias("root")),
        "dart-classes",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    classes = classed.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size"))
    return classed.join(materialize(classes, "dart-first"), "root").select(
        "doc_id",
        "node",
        F.col("first.id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``docs`` with one row of each class of near duplicates; all its columns."""
    flags = materialize(near_duplicates(docs, bands), "dart-flags")
    return drop_flagged(docs, node_of(), flags.withColumnRenamed("node", "digest"))
