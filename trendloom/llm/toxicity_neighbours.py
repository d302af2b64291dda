"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Learning, from a bounded sample of labelled rows: every term of the examples is in
the vocabulary.  Terms that go with the label in both halves of the sample are
marked; they make up four fifths of the squared length of a vector that has some, so
that one insult in a long text still counts, and all other terms the rest.  An inverted
index keeps the examples' weights by term and, for blocks of examples, the largest.

A search adds up the lists of the rarer terms.  For the frequent ones, which hold
most of all entries, the maxima of a block give a bound first; a block whose bound is
below the k-th sum so far is not opened.  What is left is added up again in doubles,
so the result is exact.

The neighbours vote with weights that fall with their distance.  Votes become
probabilities by a monotone curve fitted to the examples' own votes, each without
itself.  The nearest examples are returned as evidence.  Copies of a labelled text
are one example; the same text and its edited copies find it first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.rank_order_language import held_out
from trendloom.llm.text import WordHashes, byte_slices, mixed, texts_of
from trendloom.operators.sampling import hash_sample
from trendloom.session import materialize

TERM = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned from, and the search.

    ``examples``: labelled texts sampled, the smallest hashes of their digests; they
    bound vocabulary and index.
    ``chi_square``: least significance of a marked term in each half.
    ``marked``: share of marked terms in the squared length of a vector.
    ``soft``, ``power``: a vote weighs (soft + squared distance / 2) to minus this power.
    These three have the fewest errors of the examples' own votes on the test tables.
    """

    examples: int = 20_000
    chi_square: float = 10.83
    least_documents: int = 3
    marked: float = 0.8
    soft: float = 0.1
    power: float = 4.0
    neighbours: int = 25
    block: int = 64
    evidence: int = 3


#: Latin-1 characters outside terms become spaces.
BLANKED = bytes(c if TERM.match(chr(c)) else 0x20 for c in range(256))


def terms_of(text: str) -> list[str]:
    """What TERM finds in the lower-cased text; of Latin-1 texts the parts between all other characters."""
    text = text.lower()
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return TERM.findall(text)
    return plain.translate(BLANKED).decode("latin-1").split()


def labelled_sample(docs: DataFrame, labels: DataFrame, examples: int) -> DataFrame:
    """key, doc_id, toxic, half, weight, text of the sampled examples; a written table of at most ``examples`` rows.

    Held-out ids and null labels teach nothing; a repeated id counts as toxic if one
    of its labels says so.  Copies of one text are one example with the smallest of
    their ids, toxic if at least half of the ids are.  The sample is drawn from texts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    # Ids and digests meet, not texts; rows that repeat both are one.
    rows = docs.select("doc_id", digest).join(known, "doc_id").groupBy("doc_id", "digest").agg(F.max("toxic").alias("toxic"))
    distinct = rows.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")
    )
    sample = materialize(hash_sample(materialize(distinct, "labels"), "digest", examples), "label-sample")
    half = (F.xxhash64("digest") % 2 == 0).cast("int")
    # The sample's size is bounded by the parameter, so it may go to every task.
    found = docs.select("doc_id", digest, "text").join(F.broadcast(sample), ["doc_id", "digest"])
    found = found.groupBy("doc_id", "digest", "toxic").agg(F.first("text").alias("text"))
    texts = materialize(found.withColumn("half", half), "labelled-texts")
    # Texts of a group of near copies weigh about one together.
    slots = materialize(sketches(texts).select("digest", F.posexplode("least").alias("slot", "value")), "label-sketches")
    sizes = slots.groupBy("slot", "value").agg(F.count("*").alias("size"))
    size = F.sort_array(F.collect_list("size"), asc=False)[1]
    weights = slots.join(sizes, ["slot", "value"]).groupBy("digest").agg((1.0 / size).alias("weight"))
    weighted = texts.join(F.broadcast(weights), "digest")
    key = F.xxhash64("digest").alias("key")
    return materialize(weighted.select(key, "doc_id", "toxic", "half", "weight", "text"), "label-weights")


def sketches(texts: DataFrame) -> DataFrame:
    """digest and least: for each of four hashes the smallest over a text's runs of five terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            least = []
            for digest, text in zip(part.column("digest").to_pylist(), texts_of(part)):
                words = terms_of(text)
                runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {digest}
                hashes = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in runs), np.uint64, len(runs))
                least.append([int((mixed(hashes + np.uint64(seed)) >> np.uint64(1)).min()) for seed in range(4)])
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array(least, pa.list_(pa.int64()))], ["digest", "least"]
            )

    return texts.select("digest", "text").mapInArrow(run, "digest string, least array<long>")


def term_counts(examples: DataFrame) -> DataFrame:
    """hash of each term and, for each half, the added weights of the examples (n) and the toxic ones (t) that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in byte_slices(batches, "text"):
            found = [np.unique(hashes.of(terms_of(text))).view(np.int64) for text in texts_of(part)]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            columns = [part.column(name).take(pa.array(row)) for name in ("half", "toxic", "weight")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *columns], ["hash", "half", "toxic", "weight"])

    found = examples.select("half", "toxic", "weight", "text").mapInArrow(run, "hash long, half int, toxic int, weight double")
    return found.groupBy("hash").agg(*_by_half("n", "t", F.col("weight"), F.lit(True), F.col("toxic") == 1))


def _by_half(first: str, second: str, value: Column, of_first: Column, of_second: Column) -> list[Column]:
    sums = []
    for h in (0, 1):
        for name, some in ((first, of_first), (second, of_second)):
            sums.append(F.sum(F.when((F.col("half") == h) & some, value).otherwise(0)).alias(f"{name}{h}"))
    return sums


def neighbourhoods(examples: DataFrame, wanted: np.ndarray) -> DataFrame:
    """For the wanted terms the different neighbourhoods, by half, in clean (d) and in toxic examples (u).

    A neighbourhood is the words before and after a term's first use in a text; it weighs
    as the heaviest of the examples that have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, few = WordHashes(), set(wanted.tolist())
        for part in byte_slices(batches, "text"):
            rows, found, around = [], [], []
            for row, text in enumerate(texts_of(part)):
                words, first = terms_of(text), {}
                for i, word in enumerate(words):
                    if hashes[word] in few:
                        first.setdefault(word, i)
                rows += [row] * len(first)
                found += first
                around += [" ".join(words[max(0, i - 1) : i] + ["*"] + words[i + 1 : i + 2]) for i in first.values()]
            columns = [part.column(name).take(pa.array(rows, pa.int64())) for name in ("half", "toxic", "weight")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.of(found).view(np.int64)), pa.array(found, pa.string()), pa.array(around, pa.string()), *columns],
                ["hash", "term", "around", "half", "toxic", "weight"],
            )

    found = examples.select("half", "toxic", "weight", "text").mapInArrow(
        run, "hash long, term string, around string, half int, toxic int, weight double"
    )
    once = found.groupBy("hash", "term", "half", "toxic", F.xxhash64("around").alias("around")).agg(F.max("weight").alias("once"))
    return once.groupBy("hash", "term").agg(*_by_half("d", "u", F.col("once"), F.col("toxic") == 0, F.col("toxic") == 1))


def _chi_square(n, t, rows: float, toxic: float):
    """Of the 2 x 2 table of having a term and being toxic; signed by the direction."""
    a, b = t.cast("double"), (n - t).cast("double")
    c, d = F.lit(toxic) - a, F.lit(rows - toxic) - b
    cross = a * d - b * c
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, F.signum(cross) * rows * cross * cross / below).otherwise(0.0)


def vocabulary(examples: DataFrame, settings: Settings) -> Vocabulary:
    """All terms of the examples; marked are those that go with the label, or against it, in both halves.

    A term must also do so if, on the side it goes with, examples in which it has the
    same neighbours count once: near copies of one text are no independent examples.
    More of them take nothing from a term that others have too.
    """
    sizes = {row["half"]: row for row in examples.groupBy("half").agg(F.sum("weight").alias("rows"), F.sum(F.col("toxic") * F.col("weight")).alias("toxic")).collect()}
    total = {h: (sizes[h]["rows"], sizes[h]["toxic"]) if h in sizes else (0.0, 0.0) for h in (0, 1)}
    n0, n1, t0, t1, d0, d1, u0, u1 = (F.col(name + h) for name in "ntdu" for h in "01")
    least = settings.chi_square
    strong = lambda a, b: F.least(a, b) >= least
    s0, s1 = _chi_square(n0, t0, *total[0]), _chi_square(n1, t1, *total[1])
    goes_with, goes_against = strong(s0, s1), F.greatest(s0, s1) <= -least
    counted = term_counts(examples).select("*", (n0 + n1).alias("df"), (goes_with | goes_against).alias("likely"))
    counted = materialize(counted.withColumn("goes_with", goes_with), "label-terms")
    # As many rows as the sampled texts have terms, in Arrow columns.
    found = counted.select("hash", "df").toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    idf = np.log1p(sum(rows for rows, _ in total.values()) / found.column("df").to_numpy()[order])
    likely = counted.filter("likely").drop("df", "likely")
    wanted = likely.select("hash").toArrow().column("hash").to_numpy().view(np.uint64)
    marks = frozenset()
    if len(wanted):
        once = neighbourhoods(examples, wanted)
        # Collapsed on the toxic side, and on the clean one.
        up = [_chi_square(n - t + u, u, *total[h]) for h, (n, t, u) in enumerate(((n0, t0, u0), (n1, t1, u1)))]
        down = [-_chi_square(t + d, t, *total[h]) for h, (t, d) in enumerate(((t0, d0), (t1, d1)))]
        with_it = F.col("goes_with") & strong(*up) & (n0 + n1 - t0 - t1 + u0 + u1 >= settings.least_documents)
        against = ~F.col("goes_with") & strong(*down) & (t0 + t1 + d0 + d1 >= settings.least_documents)
        kept = likely.join(once, "hash").filter(with_it | against).select("term").toArrow()
        marks = frozenset(kept.column("term").to_pylist())
    marked = np.isin(hashes, np.array([term_hash(term) for term in marks], np.uint64))
    return Vocabulary(hashes, idf.astype(np.float32), marked, settings.marked, marks)


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


class Vectors(NamedTuple):
    """Sparse rows: where each starts, term numbers (ascending in a row) and weights."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.starts[i], self.starts[i + 1])
        return self.terms[some], self.weights[some]


@dataclass
class Vocabulary:
    """Terms by their sorted 64-bit hashes, with IDF and mark."""

    hashes: np.ndarray
    idf: np.ndarray
    marked: np.ndarray
    share: float
    marks: frozenset[str]

    def vectors(self, texts: list[str]) -> Vectors:
        """Unit vectors of (1 + ln tf) * idf, the marked terms and the others weighed by their shares."""
        words = [terms_of(text) for text in texts]
        flat = list(chain.from_iterable(words))
        text = np.repeat(np.arange(len(texts)), [len(found) for found in words])
        n = len(self.hashes)
        if not n:
            return Vectors(np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # Each different word is hashed and looked up once.
        words = pa.array(flat, pa.string()).dictionary_encode()
        different = words.dictionary.cast(pa.binary()).to_pylist()
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different))
        number = np.minimum(np.searchsorted(self.hashes, hashed), n - 1)
        number = np.where(self.hashes[number] == hashed, number, -1)[words.indices.to_numpy()]
        known = number >= 0
        both, count = np.unique(text[known] * n + number[known], return_counts=True)
        text, terms = both // n, both % n
        weights = (1 + np.log(count)) * self.idf[terms]
        marked = self.marked[terms].astype(np.int64)
        squares = np.bincount(2 * text + marked, weights**2, minlength=2 * len(texts)).reshape(-1, 2)
        mixed_rows = (squares > 0).all(axis=1)
        shares = np.where(mixed_rows[:, None], [1 - self.share, self.share], 1.0)
        weights = weights * np.sqrt(shares[text, marked] / squares[text, marked])
        return Vectors(np.searchsorted(text, np.arange(len(texts) + 1)), terms, weights)


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start to before its end, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


#: Terms in a larger share of the examples are frequent: their lists are kept in full rows.
FREQUENT = 0.05
#: More than rounding to single precision can change a sum.
SLACK = 1e-4
#: Texts searched for at a time.
BATCH = 256


@dataclass
class Index:
    """Block-max inverted index over unit vectors of examples.

    Lists of rare terms are places and weights.  Those of frequent terms, cut into
    blocks of examples, are full rows with the largest weight of each block.
    """

    ids: list
    keys: np.ndarray
    toxic: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    block: int

    @classmethod
    def build(cls, vectors: Vectors, ids: list, keys: np.ndarray, toxic: np.ndarray, n_terms: int, block: int) -> Index:
        """Examples with the same strongest term lie together; each needs a term."""
        n = len(ids)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(vectors.starts))
        strongest = np.flatnonzero(vectors.weights == np.maximum.reduceat(vectors.weights, vectors.starts[:-1])[row])
        _, first = np.unique(row[strongest], return_index=True)
        order = np.lexsort((keys, vectors.terms[strongest[first]]))
        place_of = np.empty(n, np.uint16 if n <= 1 << 16 else np.uint32)
        place_of[order] = np.arange(n)
        places = place_of[row]
        del row
        entries = np.lexsort((places, vectors.terms))
        places = places[entries]
        counts = np.bincount(vectors.terms, minlength=n_terms).astype(np.uint32)
        return cls(
            [ids[i] for i in order], keys[order], toxic[order].astype(float), counts, places,
            vectors.weights[entries].astype(np.float32), block,
        )

    # What follows from the lists is made where it is needed, so that it need not be sent.

    @cached_property
    def starts(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.counts, dtype=np.int64)]

    @cached_property
    def column(self) -> np.ndarray:
        """Of a frequent term its number among them, -1 of others."""
        frequent = self.counts > FREQUENT * len(self.ids)
        return np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)

    @cached_property
    def blocks(self) -> np.ndarray:
        """Weights of the frequent terms by block, term and example."""
        terms = np.flatnonzero(self.column >= 0)
        blocks = np.zeros((-(-len(self.ids) // self.block), len(terms), self.block), np.float32)
        at = ranges(self.starts[terms], self.starts[terms + 1])
        number = np.repeat(np.arange(len(terms)), self.counts[terms])
        blocks[self.places[at] // self.block, number, self.places[at] % self.block] = self.weights[at]
        return blocks

    @cached_property
    def maxima(self) -> np.ndarray:
        return self.blocks.max(axis=2)

    def nearest(self, vectors: Vectors, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row places and similarities of the k nearest examples with one above 0, nearest first."""
        for first in range(0, len(vectors.starts) - 1, BATCH):
            rows = [vectors.row(i) for i in range(first, min(first + BATCH, len(vectors.starts) - 1))]
            yield from self._batch(rows, k)

    def _batch(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n_blocks, n_frequent, block = self.blocks.shape
        n = n_blocks * block
        k = min(k, len(self.ids))
        frequent = np.zeros((len(rows), n_frequent))
        rare, sums = [], np.empty((len(rows), n), np.float32)
        for i, (terms, weights) in enumerate(rows):
            column = self.column[terms]
            often = column >= 0
            frequent[i, column[often]] = weights[often]
            rare.append(self._rare_sums(terms[~often], weights[~often], n))
            sums[i] = rare[i]
        single = frequent.astype(np.float32)
        # The k-th largest of the blocks' best sums: k examples have as much or more.
        best = sums.reshape(len(rows), n_blocks, block).max(axis=2)
        floor = _largest(best, k)
        bounds = best + single @ self.maxima.T + SLACK
        wanted = (bounds >= floor[:, None]) & (bounds > SLACK)
        for b in np.flatnonzero(wanted.any(axis=0)):
            here = slice(b * block, (b + 1) * block)
            if 4 * wanted[:, b].sum() > len(rows):  # copying the rows that want it would cost more
                sums[:, here] += single @ self.blocks[b]
            else:
                some = np.flatnonzero(wanted[:, b])
                sums[some, here] += single[some] @ self.blocks[b]
        # The k-th largest sum is at least that of the best of any groups, and is looked for above it.
        floor = _largest(sums.reshape(len(rows), block, n_blocks).max(axis=1), k)
        for i in range(len(rows)):
            places = np.flatnonzero(sums[i] >= floor[i] - np.float32(SLACK))
            near = sums[i, places]
            least = np.partition(near, len(near) - k)[len(near) - k] - SLACK
            places = places[(near >= least) & (near > 0)]
            columns = np.flatnonzero(frequent[i])
            values = self.blocks[(places // block)[:, None], columns, (places % block)[:, None]]
            similarity = rare[i][places] + (values * frequent[i, columns]).sum(axis=1)
            similarity = np.minimum(np.round(similarity, 9), 1.0)
            best_places = np.lexsort((places, -similarity))[:k]
            yield places[best_places], similarity[best_places]

    def _rare_sums(self, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """The sum of each place over the lists of rare terms, in doubles."""
        lists = [slice(a, b) for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist())]
        # Joining views of bytes costs a third of concatenating as many short arrays.
        places, values = memoryview(self.places), memoryview(self.weights)
        places = np.frombuffer(b"".join([places[some] for some in lists]), self.places.dtype)
        values = np.frombuffer(b"".join([values[some] for some in lists]), self.weights.dtype)
        products = np.repeat(weights.astype(np.float64), self.counts[terms])
        products *= values
        return np.bincount(places, products, minlength=n)


def _largest(best: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, 0 of rows that are shorter."""
    n = best.shape[1]
    return np.partition(best, n - k, axis=1)[:, n - k] if k <= n else np.zeros(len(best), best.dtype)


def vote(labels: np.ndarray, similarity: np.ndarray, settings: Settings) -> float:
    """Share of toxic votes; a vote's weight falls with its distance."""
    weights = (settings.soft + (1.0 - similarity).clip(0)) ** -settings.power
    return float(weights @ labels / weights.sum())


def monotone_curve(votes: list[float], labels: list[float]) -> tuple[list[float], list[float]]:
    """Steps of the best non-decreasing fit of labels to votes (pooling neighbours that fall).

    Each step's value is drawn to one half by one example of either kind.
    """
    steps: list[list[float]] = []  # lowest vote, toxic, all
    for v, y in sorted(zip(votes, labels)):
        if steps and steps[-1][0] == v:
            steps[-1][1] += y
            steps[-1][2] += 1
        else:
            steps.append([v, y, 1.0])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, y1, n1 = steps.pop()
            steps[-1][1] += y1
            steps[-1][2] += n1
    pooled = [[v, (y + 1) / (n + 2)] for v, y, n in steps]
    values = np.maximum.accumulate([p for _, p in pooled]).tolist() if pooled else []
    return [v for v, _ in pooled], values


@dataclass
class Model:
    """What is learned; its size is bounded by the settings."""

    vocabulary: Vocabulary
    index: Index | None
    none: float
    curve: tuple[list[float], list[float]]
    settings: Settings
    #: Vocabulary and index as they were sent to the tasks for the examples' own votes.
    sent: Broadcast | None = None

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list, list[float]]]:
        """Probability and evidence of each text: ids and similarities of the nearest examples."""
        if self.index is None:
            yield from ((self.none, [], []) for _ in texts)
            return
        steps, values = self.curve
        some = self.settings.evidence
        found = self.index.nearest(self.vocabulary.vectors(texts), self.settings.neighbours)
        for places, similarity in found:
            if not len(places):
                yield self.none, [], []
                continue
            share = vote(self.index.toxic[places], similarity, self.settings)
            probability = values[max(0, bisect_right(steps, share) - 1)]
            yield probability, [self.index.ids[p] for p in places[:some]], similarity[:some].tolist()


def example_vectors(examples: DataFrame, terms: Vocabulary) -> DataFrame:
    """key, doc_id, toxic, terms and weights of each example; a written table."""
    kind = examples.schema["doc_id"].dataType.simpleString()
    shared = examples.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            found = shared.value.vectors(texts_of(part))
            starts = pa.array(found.starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(name) for name in ("key", "doc_id", "toxic")),
                    pa.ListArray.from_arrays(starts, pa.array(found.terms, pa.int32())),
                    pa.ListArray.from_arrays(starts, pa.array(found.weights.astype(np.float32))),
                ],
                ["key", "doc_id", "toxic", "terms", "weights"],
            )

    vectors = examples.select("key", "doc_id", "toxic", "text").mapInArrow(
        run, f"key long, doc_id {kind}, toxic int, terms array<int>, weights array<float>"
    )
    written = materialize(vectors, "label-vectors")
    shared.unpersist()
    return written


def _rows_of(table: pa.Table) -> Vectors:
    """The vectors in columns terms and weights."""
    terms, weights = table.column("terms").chunks, table.column("weights").chunks
    sizes = [np.diff(x.offsets.to_numpy()) for x in terms]
    return Vectors(
        np.cumsum(np.concatenate([[0], *sizes])),
        np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in terms)]),
        np.concatenate([np.zeros(0, np.float32), *(x.flatten().to_numpy() for x in weights)]),
    )


def own_votes(vectors: DataFrame, sent: Broadcast, settings: Settings) -> pa.Table:
    """toxic and vote of each example that has other neighbours than itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = sent.value
        for batch in batches:
            keys, labels, votes = batch.column("key").to_numpy(), [], []
            nearest = index.nearest(_rows_of(pa.Table.from_batches([batch])), settings.neighbours + 1)
            for key, label, (places, similarity) in zip(keys, batch.column("toxic").to_pylist(), nearest):
                other = np.flatnonzero(index.keys[places] != key)[: settings.neighbours]
                if len(other):
                    labels.append(label)
                    votes.append(vote(index.toxic[places[other]], similarity[other], settings))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(votes, pa.float64())], ["toxic", "vote"])

    parallelism = vectors.sparkSession.sparkContext.defaultParallelism
    dealt = vectors.select("key", "toxic", "terms", "weights").repartition(parallelism, "key")
    return dealt.mapInArrow(run, "toxic int, vote double").toArrow()


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit the model on a bounded sample of labelled rows that are not held out."""
    examples = labelled_sample(docs, labels, settings.examples)
    terms = vocabulary(examples, settings)
    written = example_vectors(examples, terms)
    # At most ``settings.examples`` rows, in Arrow columns.
    found = written.toArrow()
    toxic = found.column("toxic").to_numpy()
    vectors, ids, keys = _rows_of(found), found.column("doc_id").to_pylist(), found.column("key").to_numpy()
    del found
    has = np.diff(vectors.starts) > 0
    # Drawn to the share of all examples by one of them.
    none = float((toxic[~has].sum() + toxic.mean()) / ((~has).sum() + 1)) if len(toxic) else 0.0
    if not has.any():
        return Model(terms, None, none, ([], []), settings)
    vectors = vectors._replace(starts=np.r_[vectors.starts[:-1][has], vectors.starts[-1]])
    ids = [i for i, some in zip(ids, has) if some]
    index = Index.build(vectors, ids, keys[has], toxic[has], len(terms.hashes), settings.block)
    del vectors
    sent = docs.sparkSession.sparkContext.broadcast((terms, index))
    votes = own_votes(written, sent, settings)
    curve = monotone_curve(votes.column("vote").to_pylist(), votes.column("toxic").to_pylist())
    return Model(terms, index, none, curve if curve[0] else ([0.0], [none]), settings, sent)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence_ids and evidence_similarity of each row.

    A null or empty text, and any without a term of the examples, has the smoothed
    share of toxic rows among such examples, and no evidence.
    """
    sent = model.sent or docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.index))
    rest = model.none, model.curve, model.settings
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*sent.value, *rest)
        for part in byte_slices(batches, "text"):
            found = list(learned.scores(texts_of(part)))
            scores = np.array([p for p, _, _ in found])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)),
                    pa.array([ids for _, ids, _ in found], pa.list_(part.schema.field("doc_id").type)),
                    pa.array([near for _, _, near in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "score", "predicted", "evidence_ids", "evidence_similarity"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, score double, predicted int, evidence_ids array<{kind}>, "
        "evidence_similarity array<double>",
    )
