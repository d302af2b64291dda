"""Ranked lexical search: the best documents for each query, exactly, by best positions.

1. One pass counts the terms of every text inside its task and writes them.
2. Corpus counts: documents and terms in all, and the documents of each query term,
   combined inside tasks first.  They give each term of a query its weight.
3. Counted documents are dealt out evenly into shards of a bounded number of postings.
   A task that gets a shard lays out its impact lists (``best_position``) and then sees
   the queries go by, a batch at a time; it answers with the best of its shard.
4. The answers of all shards are merged by a ranked window, which Spark limits before
   its shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.best_position import ImpactLists
from trendloom.llm.text import byte_slices
from trendloom.session import materialize

#: Distinct terms of documents, summed, in a shard.
SHARD_POSTINGS = 1 << 19
TOP = 10

#: Letters, digits and bytes of other characters make terms; A to Z are lower-cased.
LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def _lists(lists: list[list], kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array([x for some in lists for x in some], kind))


def counted(texts: DataFrame, id_column: str) -> DataFrame:
    """row, id, n, terms, tfs: the distinct terms of each text in the order of their first occurrence."""
    kind = texts.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            counts = [Counter(terms_of(text)) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("id"),
                    pa.array([sum(c.values()) for c in counts], pa.int64()),
                    _lists([list(c) for c in counts], pa.binary()).cast(pa.list_(pa.string())),
                    _lists([list(c.values()) for c in counts], pa.int64()),
                ],
                ["row", "id", "n", "terms", "tfs"],
            )

    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), "text")
    return rows.mapInArrow(run, f"row long, id {kind}, n long, terms array<string>, tfs array<long>")


class _Shard:
    """Counted documents of one shard as they arrive, in the order of their ids; then their lists."""

    def __init__(self, number: int, documents: int, terms: int):
        self.number, self.documents, self.terms = number, documents, terms
        self.parts, self.lists = [], None

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part.select(["id", "n", "terms", "tfs"]))

    def close(self) -> None:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.ids, terms, tfs = (table.column(name).combine_chunks() for name in ("id", "terms", "tfs"))
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        n = table.column("n").to_numpy()
        # Whole-number length norm, as the impact's denominator has it.
        m = np.array([25 + (75 * x * self.documents) // self.terms for x in n.tolist()], np.int64)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        tf = tfs.flatten().to_numpy()
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
        names = terms.flatten().dictionary_encode()
        self.numbers = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
        numbers = names.indices.to_numpy().astype(np.int64)
        self.lists = ImpactLists(numbers, docs, impacts, len(self.numbers), len(sizes))

    def answers(self, queries: pa.RecordBatch, k: int) -> Iterator[tuple]:
        """(query, document, score) of a batch of queries."""
        columns = [queries.column(name) for name in ("row", "terms", "tfs")]
        for row, terms, factors in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist()):
            known = [(self.numbers[t], f) for t, f in zip(terms, factors) if t in self.numbers]
            if known:
                numbers, weights = np.array(known, np.int64).T
                for score, doc in self.lists.best(numbers, weights, k)[0]:
                    yield row, doc, score


def _search(docs: DataFrame, queries: DataFrame, shards: int, documents: int, terms: int, k: int) -> DataFrame:
    """query, id, score: the best ``k`` of every shard for each query."""
    kind = docs.schema["id"].dataType.simpleString()
    candidates = docs.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("part"), "row", "id", "n", "terms", "tfs"
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"), "row",
        F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("n"), "terms", F.col("factors").alias("tfs"),
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
                    current = _Shard(number, documents, terms)
                if part == 0:
                    current.add(some)
                    continue
                if current.lists is None:
                    if not current.parts:
                        continue  # no documents fell to this shard
                    current.close()
                found = list(current.answers(some, k))
                query, doc, score = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), current.ids.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())],
                    ["query", "id", "score"],
                )

    return dealt.mapInArrow(run, f"query long, id {kind}, score long")


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP,
    doc_id: str = "doc_id",
    query_id: str = "item_id",
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` best documents for the text of each query.

    Both tables have a column ``text``.  Terms are runs of letters, digits and
    characters beyond ASCII; only A to Z are lower-cased.  Null and empty texts have no
    term: such a document is never found and does not count, such a query finds nothing.
    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), once for each time that the
    query has it; scores are whole numbers, and those above 0 count.  Equal scores go to
    the smaller id, null ids last.  Rows that repeat an id are documents, or queries, of
    their own.
    """
    texts = materialize(counted(docs, doc_id), "search-documents").filter("n > 0")
    documents, terms, postings = texts.agg(
        F.count("*"), F.sum("n"), F.sum(F.size("terms").cast("long"))
    ).first()
    asked = materialize(counted(queries, query_id), "search-queries")
    # Spark knows the size of the written queries, and sends their terms out only while they are few.
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    frequencies = (
        texts.select(F.explode("terms").alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    weight = F.floor(F.log((2.0 * (documents or 0) + 2) / (2 * F.col("df") + 1)) * 1000)
    weighted = (
        asked.select("row", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
        .join(frequencies, "term")
        .groupBy("row")
        .agg(F.collect_list(F.struct("term", (weight * F.col("tf")).cast("long").alias("factor"))).alias("t"))
        .select("row", F.col("t.term").alias("terms"), F.col("t.factor").alias("factors"))
    )
    shards = max(1, math.ceil((postings or 0) / shard_postings))
    found = _search(texts, materialize(weighted, "search-weights"), shards, documents or 0, terms or 1, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(names, "query").select(
        F.col("query_id").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score"
    )
