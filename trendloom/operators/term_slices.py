"""Counted documents in slices: terms stand once per slice, documents refer to them by number.

What is moved by term is a row per term and slice, not one per entry, and what comes back
to a slice are the numbers of the terms that a vocabulary knows.  Documents of a group (a
cluster) have slices of their own, so that terms can be counted within groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import tokens as tk
from trendloom.functions.tokens import counted_ngrams, plain_letters
from trendloom.session import scratch_path, short_shuffles

# Text of a slice, and rows of a batch of what comes of it.
SLICE_BYTES = 8 << 20
BATCH_ROWS = 100_000
# Documents that are handed on at once, and numbers of terms gathered before they move.
DOCS_AT_ONCE, GATHERED = 512, 2_000_000

DOCS, TERMS = "docs", "terms"
#: A row of documents has megabytes; pages and row groups are buffered whole.
BUFFERED = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "compression": "zstd"}
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def token_rows(docs: DataFrame, text: str, analyzer, *keep: str) -> DataFrame:
    """(keep, _text, _found): lowered texts, with the tokens of those that Spark has to find."""
    lowered = docs.select(*keep, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_lower"))
    if analyzer.all_scripts:
        lowered = lowered.withColumn("_lower", tk.strip_all_accents(F.col("_lower")))
    other = analyzer.find(tk.strip_accents(F.col("_lower")) if _plain(analyzer) else F.col("_lower"))
    return lowered.select(
        *keep, F.col("_lower").alias("_text"), F.when(tk.has_other_scripts(F.col("_lower")), other).alias("_found")
    )


def _plain(analyzer) -> bool:
    return analyzer.strip_accents and not analyzer.all_scripts


def token_finder(analyzer):
    """A function of a batch of ``token_rows``: the tokens of each text."""
    pattern = tk.PYTHON_WORD_TOKENS if analyzer.word_tokens else tk.PYTHON_LETTER_TOKENS
    plain = _plain(analyzer)
    table = tk.plain_table() if plain else {}

    def tokens(part: pa.RecordBatch) -> list[list[str]]:
        find = re.compile(pattern).findall
        return [
            found if found is not None else find(plain_letters(text, table) if plain else text)
            for text, found in zip(part.column("_text").to_pylist(), part.column("_found").to_pylist())
        ]

    return tokens


def text_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut after at most ``size`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _by_group(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    groups = part.column("_group").to_numpy(zero_copy_only=False)
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    for some in np.split(order, cuts):
        yield part if len(some) == part.num_rows else part.take(pa.array(some))


def _bytes(array: np.ndarray, kind: str = "<i4") -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def counted_slices(
    docs: DataFrame, id_column: str, text: str, analyzer, group: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the documents (slice, _group, ids, ends, codes, tfs) and their terms
    (slice, _group, code, term, df, cf).

    ``codes`` are the numbers of the terms within the slice, ``ends`` close the documents.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    owner = F.lit(0) if group is None else F.col(group).cast("int")
    rows = token_rows(docs.select(F.col(id_column).alias("_id"), owner.alias("_group"), text), text, analyzer, "_id", "_group")
    stop_words, lengths = sorted(set(analyzer.stop_words)), (analyzer.shortest, analyzer.longest)
    find = token_finder(analyzer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        without, number = pa.array(stop_words, pa.string()), TaskContext.get().partitionId() << 32
        for whole in text_slices(batches, SLICE_BYTES):
            for part in _by_group(whole):
                shared = {"slice": number, "_group": part.column("_group")[0].as_py()}
                first, found = 0, [(np.zeros(0, np.int64),) * 3]
                for terms, df, cf, row, code, tf in counted_ngrams(find(part), without, *lengths):
                    found.append((row, code + first, tf))
                    for i in range(0, len(terms), BATCH_ROWS):
                        some = terms.slice(i, BATCH_ROWS)
                        codes = pa.array(np.arange(i, i + len(some)) + first, pa.int32())
                        own = {"code": codes, "term": some, "df": pa.array(df[i : i + BATCH_ROWS]), "cf": pa.array(cf[i : i + BATCH_ROWS])}
                        yield _batch(len(some), part.column("_id").type, shared | own | {"kind": TERMS})
                    first += len(terms)
                row, code, tf = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(row, kind="stable")
                ids = part.column("_id")
                own = {
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    "ends": _bytes(np.cumsum(np.bincount(row, minlength=len(ids)))),
                    "codes": _bytes(code[order]), "tfs": _bytes(tf[order]),
                }
                yield _batch(1, ids.type, shared | own | {"kind": DOCS})
                number += 1

    form = (
        f"kind string, slice long, _group int, ids array<{kind}>, ends binary, codes binary, tfs binary, "
        "code int, term string, df long, cf long"
    )
    path = scratch_path(spark, "term-slices")
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, "2")  # rows are not sorted by kind
    try:
        with short_shuffles(spark):
            rows.mapInArrow(run, form).write.partitionBy("kind").options(**BUFFERED).parquet(path)
    finally:
        spark.conf.set(WRITERS, before)

    def read(kind_of: str, columns: str) -> DataFrame:
        found = spark.read.schema(columns)
        return found.parquet(f"{path}/kind={kind_of}") if _exists(spark, f"{path}/kind={kind_of}") else spark.createDataFrame([], columns)

    return (
        read(DOCS, f"slice long, _group int, ids array<{kind}>, ends binary, codes binary, tfs binary"),
        read(TERMS, "slice long, _group int, code int, term string, df long, cf long"),
    )


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _batch(n: int, id_kind: pa.DataType, columns: dict) -> pa.RecordBatch:
    kinds = {
        "kind": pa.string(), "slice": pa.int64(), "_group": pa.int32(), "ids": pa.list_(id_kind), "ends": pa.binary(),
        "codes": pa.binary(), "tfs": pa.binary(), "code": pa.int32(), "term": pa.string(), "df": pa.int64(), "cf": pa.int64(),
    }
    values = [columns.get(name) for name in kinds]
    arrays = [
        x if isinstance(x, pa.Array) else pa.nulls(n, kind) if x is None else pa.array([x] * n, kind)
        for x, kind in zip(values, kinds.values())
    ]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def added_terms(terms: DataFrame, least_df: int) -> DataFrame:
    """(_group, term, df, cf, slices, codes) of the terms of all slices that reach a document frequency.

    ``slices`` and ``codes`` say where a term occurs and as which number.
    """
    together = terms.select("_group", "term", "slice", "code", "df", "cf").repartition("_group", "term")
    together = together.sortWithinPartitions("_group", "term")
    form = "_group int, term string, df long, cf long, slices array<long>, codes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if table.num_rows == 0:
                continue
            batch = table.to_batches()[0]
            starts = _run_starts(batch)
            if len(starts) > 1:
                yield _runs(batch.slice(0, starts[-1]), starts[:-1], least_df)
            rest = batch.slice(starts[-1])
        if rest is not None:
            yield _runs(rest, np.array([0]), least_df)

    return together.mapInArrow(run, form)


def _run_starts(batch: pa.RecordBatch) -> np.ndarray:
    n = batch.num_rows
    term, group = batch.column("term"), batch.column("_group").fill_null(-1).to_numpy(zero_copy_only=False)
    new = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, new.astype(bool) | (group[1:] != group[:-1])])


def _runs(batch: pa.RecordBatch, starts: np.ndarray, least_df: int) -> pa.RecordBatch:
    df, cf = (np.add.reduceat(batch.column(name).to_numpy(), starts) for name in ("df", "cf"))
    sizes = np.diff(np.r_[starts, batch.num_rows])
    kept = df >= least_df
    inside = pa.array(np.repeat(kept, sizes))
    offsets = pa.array(np.r_[0, np.cumsum(sizes[kept])], pa.int32())
    first = pa.array(starts[kept])
    arrays = [batch.column("_group").take(first), batch.column("term").take(first), pa.array(df[kept]), pa.array(cf[kept])]
    arrays += [pa.ListArray.from_arrays(offsets, batch.column(name).filter(inside)) for name in ("slice", "code")]
    return pa.RecordBatch.from_arrays(arrays, ["_group", "term", "df", "cf", "slices", "codes"])


def _to_slices(known: DataFrame) -> DataFrame:
    """(slice, codes, numbers, idfs) from (slices, codes, number, idf), gathered in each task."""

    def gathered(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        slices, codes, numbers, idfs = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(slices, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(slices[order])) + 1):
            if len(some):
                blobs = [_bytes(codes[some]), _bytes(numbers[some], "<i8"), _bytes(idfs[some], "<f8")]
                arrays = [pa.array([slices[some[0]]], pa.int64())] + [pa.array([x], pa.binary()) for x in blobs]
                yield pa.RecordBatch.from_arrays(arrays, ["slice", "codes", "numbers", "idfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            lists = batch.column("slices")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            slices, codes = lists.flatten().to_numpy(), batch.column("codes").flatten().to_numpy()
            parts.append((slices, codes, *(np.repeat(batch.column(x).to_numpy(), sizes) for x in ("number", "idf"))))
            n += len(slices)
            if n > GATHERED:
                yield from gathered(parts)
                parts, n = [], 0
        if parts:
            yield from gathered(parts)

    picked = known.select("slices", "codes", F.col("number").cast("long").alias("number"), "idf")
    return picked.mapInArrow(run, "slice long, codes binary, numbers binary, idfs binary")


class _Weights:
    """The entries of the documents of a slice that the vocabulary knows, by document and number."""

    def __init__(self, row: dict, codes: list[np.ndarray], numbers: list[np.ndarray], idfs: list[np.ndarray]):
        ends, own, tfs = (np.frombuffer(row[name], "<i4").astype(np.int64) for name in ("ends", "codes", "tfs"))
        size = int(own.max(initial=-1)) + 1
        number, idf = np.full(size, -1, np.int64), np.zeros(size)
        for code, n, value in zip(codes, numbers, idfs):
            number[code], idf[code] = n, value
        doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        found = number[own]
        kept = found >= 0
        doc, found, w = doc[kept], found[kept], (1.0 + np.log(tfs[kept])) * idf[own[kept]]
        order = np.lexsort((found, doc))
        self.doc, self.number, w = doc[order], found[order], w[order]
        norm = np.sqrt(np.bincount(self.doc, w * w, len(ends)))
        self.weight = w / norm[self.doc]
        self.ends = np.cumsum(np.bincount(self.doc, minlength=len(ends)))


def _weighed(of_docs: DataFrame, known: DataFrame, result, form: str) -> DataFrame:
    """``result`` of the weights of each slice; what is known of a slice comes before its documents."""
    nothing = F.lit(None).cast("binary")
    no_ids = F.lit(None).cast(of_docs.schema["ids"].dataType)
    numbers = _to_slices(known).select(
        "slice", F.lit(0).alias("docs"), "codes", "numbers", "idfs", no_ids.alias("ids"), nothing.alias("ends"), nothing.alias("tfs")
    )
    owners = of_docs.select(
        "slice", F.lit(1).alias("docs"), "codes", nothing.alias("numbers"), nothing.alias("idfs"), "ids", "ends", "tfs"
    )
    together = numbers.unionByName(owners).repartition("slice").sortWithinPartitions("slice", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, codes, found, idfs = None, [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("slice", "docs", "codes", "numbers", "idfs", "ends", "tfs")}
                if row["slice"] != current:
                    current, codes, found, idfs = row["slice"], [], [], []
                if row["docs"]:
                    yield from result(batch.column("ids")[i].values, _Weights(row, codes, found, idfs))
                    codes, found, idfs = [], [], []
                else:
                    codes.append(np.frombuffer(row["codes"], "<i4"))
                    found.append(np.frombuffer(row["numbers"], "<i8"))
                    idfs.append(np.frombuffer(row["idfs"], "<f8"))

    return together.mapInArrow(run, form)


def weighted_rows(of_docs: DataFrame, known: DataFrame, id_column: str) -> DataFrame:
    """Sparse rows (id, term_ids, weights) of unit length; ``known`` has (slices, codes, number, idf)."""

    def rows(ids: pa.Array, found: _Weights) -> Iterator[pa.RecordBatch]:
        starts = np.r_[0, found.ends]
        for first in range(0, len(ids), DOCS_AT_ONCE):
            some = starts[first : first + DOCS_AT_ONCE + 1]
            offsets = pa.array(some - some[0], pa.int32())
            terms = pa.array(found.number[some[0] : some[-1]], pa.int32())
            weights = pa.array(found.weight[some[0] : some[-1]])
            arrays = [ids.slice(first, DOCS_AT_ONCE)] + [pa.ListArray.from_arrays(offsets, x) for x in (terms, weights)]
            yield pa.RecordBatch.from_arrays(arrays, [id_column, "term_ids", "weights"])

    kind = of_docs.schema["ids"].dataType.elementType.simpleString()
    return _weighed(of_docs, known, rows, f"{id_column} {kind}, term_ids array<int>, weights array<double>")


def weight_sums(of_docs: DataFrame, known: DataFrame) -> DataFrame:
    """(number, s): the sum of each term's weights over all documents."""

    def sums(ids: pa.Array, found: _Weights) -> Iterator[pa.RecordBatch]:
        number, place = np.unique(found.number, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.bincount(place, found.weight, len(number)), pa.float64())], ["number", "s"])

    parts = _weighed(of_docs, known, sums, "number long, s double")
    return parts.groupBy("number").agg(F.sum("s").alias("s"))
