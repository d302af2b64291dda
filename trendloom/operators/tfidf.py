"""TF-IDF: vocabulary, weights and the fitted model.

A fit counts slices of documents, and a term moves once for each slice.  Documents that
were fitted take their weights from the numbers of the slice's terms (``term_slices``);
the counts of new ones stay inside the row (sorted n-grams, run lengths), their weights
come from a join on the term, whose frequent terms are sent to the tasks, and are put
together again by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.fixed_values import DOMAIN_STOP_WORDS, ENGLISH_STOP_WORDS
from trendloom.functions import tokens as tk
from trendloom.functions.tokens import tallied_ngrams
from trendloom.operators import term_slices
from trendloom.operators.term_slices import text_slices
from trendloom.session import discard, materialize

MIN_DF = 5
MAX_DF = 0.80
# A vocabulary, or its frequent part, is sent to the tasks while it has at most so many
# terms: some ten megabytes.
SENT_TERMS = 200_000
# Text whose terms are added up at a time, and rows of a batch of what comes of it.
TALLY_BYTES = 8 << 20
TALLY_ROWS = 100_000
# Stands for the document itself among its terms; no tokenizer makes an empty one.
NO_TERM = ""


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms.

    ``strip_accents`` covers Latin text inside Spark's own expressions;
    ``all_scripts`` decomposes every character there is in Arrow batches.
    """

    strip_accents: bool = True
    all_scripts: bool = False
    word_tokens: bool = False
    stop_words: tuple[str, ...] = tuple(ENGLISH_STOP_WORDS) + tuple(DOMAIN_STOP_WORDS)
    shortest: int = 1
    longest: int = 2

    def tokens(self, docs: DataFrame, text: str, out: str = "tokens") -> DataFrame:
        """Add the token array, stop words still in."""
        docs = docs.withColumn("_text", F.lower(F.coalesce(F.col(text), F.lit(""))))
        if self.all_scripts:
            docs = docs.withColumn("_text", tk.strip_all_accents(F.col("_text")))
        elif self.strip_accents:
            docs = docs.withColumn("_text", tk.strip_accents(F.col("_text")))
        return docs.withColumn(out, self.find(F.col("_text"))).drop("_text")

    def find(self, c: Column) -> Column:
        return tk.word_tokens(c) if self.word_tokens else tk.letter_tokens(c)

    def kept_tokens(self, docs: DataFrame, text: str, out: str = "tokens") -> DataFrame:
        docs = self.tokens(docs, text, out)
        return docs.withColumn(out, tk.without_words(F.col(out), self.stop_words))

    def terms(self, docs: DataFrame, text: str, out: str = "terms") -> DataFrame:
        """Add the n-gram array; stop words are gone before n-grams form."""
        docs = self.kept_tokens(docs, text, "_tokens")
        grams = tk.ngrams(F.col("_tokens"), self.shortest, self.longest)
        return docs.withColumn(out, grams).drop("_tokens")

    def counted(self, docs: DataFrame, text: str, out: str = "tf") -> DataFrame:
        """Add the array of (term, tf), in term order."""
        docs = self.terms(docs, text, "_terms")
        docs = docs.withColumn("_terms", F.sort_array("_terms"))
        docs = docs.withColumn("_starts", tk.run_starts(F.col("_terms")))
        runs = tk.run_lengths(F.col("_terms"), F.col("_starts"))
        return docs.withColumn(out, runs).drop("_terms", "_starts")


# Terms for the embedding, and two- and three-word phrases for labels.
TERMS = Analyzer()
PHRASES = Analyzer(
    strip_accents=False,
    word_tokens=True,
    stop_words=tuple(ENGLISH_STOP_WORDS),
    shortest=2,
    longest=3,
)


def term_counts(docs: DataFrame, keys: list[str], text: str, analyzer: Analyzer) -> DataFrame:
    """(keys, term, tf), one row per term of each document."""
    counted = analyzer.counted(docs.select(*keys, text), text)
    # The outer form and a filter: for the inner one Spark would derive a filter
    # on the array's size and push it down, tokenizing every text twice more.
    return counted.select(*keys, F.inline_outer("tf")).filter(F.col("term").isNotNull())


def tallied_counts(docs: DataFrame, text: str, analyzer: Analyzer) -> DataFrame:
    """(term, df, cf) of slices of documents: ``term_counts`` without keys, added up in each slice.

    A term's rows add up to its frequencies (``add_tallies``).  Slices are bounded in bytes,
    and what they make are Arrow columns: a row per term of each document is never formed.
    """
    rows = term_slices.token_rows(docs, text, analyzer)
    stop_words, lengths = sorted(set(analyzer.stop_words)), (analyzer.shortest, analyzer.longest)
    find = term_slices.token_finder(analyzer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without = pa.array(stop_words, pa.string())
        for part in text_slices(batches, TALLY_BYTES):
            for tally in tallied_ngrams(find(part), without, *lengths):
                for first in range(0, tally.num_rows, TALLY_ROWS):
                    yield tally.slice(first, TALLY_ROWS)

    return rows.mapInArrow(run, "term string, df long, cf long")


def add_tallies(tallies: DataFrame) -> DataFrame:
    """Document and corpus frequency of each term from those of slices.

    Rows move by term first: few of a task's rows share a term that slices have not
    added up, and summing them before they move would mostly sort and spill.
    """
    return tallies.repartition("term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_statistics(counts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Document and corpus frequency of each term, per group if groups are given."""
    return counts.groupBy(*(groups or []), "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf")
    )


def smooth_idf(n_docs, df):
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0


def sublinear(tf):
    return F.lit(1.0) + F.log(tf.cast("double"))


def build_vocabulary(
    statistics: DataFrame,
    n_docs,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = None,
) -> DataFrame:
    """(term, df, cf, idf): pruned by document frequency, then the most frequent.

    ``n_docs`` is a number or a scalar column.  Ties in corpus count go to the
    alphabetically first term.
    """
    n_docs = n_docs if not isinstance(n_docs, (int, float)) else F.lit(n_docs)
    kept = statistics.filter(
        (F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n_docs)
    )
    kept = kept.select("term", "df", "cf", smooth_idf(n_docs, F.col("df")).alias("idf"))
    return kept if max_features is None else most_frequent(kept, max_features)


def size_class() -> Column:
    """Class of a corpus count, sixteen classes per power of two."""
    return F.floor(F.log2("cf") * 16)


def most_frequent(vocabulary: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms with the highest corpus count, ties in term order.

    Terms are counted by the size class of their corpus count.  Whole classes
    are kept or dropped in place and only the class at the border is sorted.
    """
    vocabulary = materialize(vocabulary, "vocabulary")
    sizes = vocabulary.groupBy(size_class().alias("class")).count().collect()
    room = n
    for border, size in sorted(sizes, reverse=True):
        if size > room:
            break
        room -= size
    else:
        return vocabulary
    above = vocabulary.filter(size_class() > border)
    at_border = vocabulary.filter(size_class() == border)
    return above.unionByName(at_border.orderBy(F.desc("cf"), "term").limit(room))


def most_frequent_per_group(vocabulary: DataFrame, group: str, n: int) -> DataFrame:
    """The same for every group; groups with at most ``n`` terms stay as they are."""
    vocabulary = materialize(vocabulary, "group-vocabulary")
    classes = vocabulary.groupBy(group, size_class().alias("class")).agg(F.count("*").alias("size"))
    upto = F.sum("size").over(Window.partitionBy(group).orderBy(F.desc("class")))
    borders = (
        classes.withColumn("upto", upto)
        .filter((F.col("upto") > n) & (F.col("upto") - F.col("size") <= n))
        .select(group, F.col("class").alias("border"), (n - F.col("upto") + F.col("size")).alias("room"))
    )
    borders = materialize(borders, "vocabulary-borders")
    if borders.isEmpty():
        return vocabulary
    marked = vocabulary.join(borders, group, "left")
    above = marked.filter(F.col("border").isNull() | (size_class() > F.col("border")))
    order = Window.partitionBy(group).orderBy(F.desc("cf"), "term")
    at_border = (
        marked.filter(size_class() == F.col("border"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.col("room"))
    )
    return above.select(*vocabulary.columns).unionByName(at_border.select(*vocabulary.columns))


@dataclass
class TfidfModel:
    """A fitted vocabulary, a table with the terms numbered in alphabetical order.

    ``table`` (term, term_id, df, cf, idf) is written; it is joined to the counts of
    the documents and never held by the driver, so it may be of any size.
    """

    table: DataFrame
    n_terms: int
    n_docs: int
    analyzer: Analyzer = field(default_factory=Analyzer)

    def vocabulary(self, spark: SparkSession | None = None) -> DataFrame:
        """(term, term_id, df, cf, idf)."""
        return self.table

    def transform(self, docs: DataFrame, id_column: str, text: str) -> DataFrame:
        """Sparse rows (id, term_ids, weights) of unit length.

        Terms outside the vocabulary are dropped; a document without any known
        term keeps a row with empty arrays.
        """
        counted = self.analyzer.counted(docs.select(id_column, text), text).drop(text)
        return self.weighted(counted, id_column)

    def weighted(self, counted: DataFrame, id_column: str) -> DataFrame:
        """The same from counted documents (id, tf)."""
        keyed = numbered_rows(counted)
        if self.n_terms > SENT_TERMS:
            # Read twice below, and only a written row has the same number again.
            keyed = materialize(keyed, "term-counts")
        itself = F.array(F.struct(F.lit(NO_TERM).alias("term"), F.lit(0).alias("tf")))
        counts = keyed.select(id_column, "_row", F.inline(F.concat(itself, "tf")))
        found = self._known(counts).withColumn("_w", sublinear(F.col("tf")) * F.col("idf"))
        entry = F.when(F.col("term_id").isNotNull(), F.struct("term_id", F.col("_w").alias("w")))
        rows = found.groupBy("_row").agg(
            F.first(id_column).alias(id_column), F.sort_array(F.collect_list(entry)).alias("_e")
        )
        norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda total, e: total + e.w * e.w))
        # As an array of one, the norm is made once and not for every entry.
        scaled = F.transform(F.array(norm), lambda n: F.transform("_e", lambda e: e.w / n))
        return rows.select(
            id_column, F.col("_e.term_id").alias("term_ids"), F.get(scaled, F.lit(0)).alias("weights")
        )

    def _known(self, counts: DataFrame) -> DataFrame:
        """Counts with (term_id, idf): those of known terms, and of the documents themselves.

        Terms outside the vocabulary go before anything is shuffled, as long as the
        vocabulary can be sent.  Of a larger one the most frequent terms are sent, and only
        entries of terms that are not among them are shuffled by term.
        """
        table = self.table.select("term", "term_id", "idf")
        if self.n_terms <= SENT_TERMS:
            kept = F.col("term_id").isNotNull() | (F.col("term") == NO_TERM)
            return counts.join(F.broadcast(table), "term", "left").filter(kept)
        least = self._least_df(SENT_TERMS)
        frequent = self.table.filter(F.col("df") >= least).select("term", "term_id", "idf")
        sent = F.broadcast(frequent.withColumnsRenamed({"term_id": "_id", "idf": "_idf"}))
        # What is found at once does not move by term; of the rest, what has no partner goes.
        met = counts.join(sent, "term", "left").filter(F.col("_id").isNotNull() | (F.col("term") == NO_TERM))
        met = met.withColumnsRenamed({"_id": "term_id", "_idf": "idf"})
        rest = counts.join(F.broadcast(frequent.select("term")), "term", "left_anti").filter(F.col("term") != NO_TERM)
        rest = rest.join(self.table.filter(F.col("df") < least).select("term", "term_id", "idf"), "term")
        return met.unionByName(rest)

    def _least_df(self, most: int) -> int:
        return least_df(self.table, most)


def least_df(table: DataFrame, most: int) -> int:
    """The least document frequency that at most ``most`` terms reach, up to a factor of two."""
    binary = F.floor(F.log2("df")).cast("int").alias("size")
    sizes = sorted(table.groupBy(binary).count().collect(), reverse=True)
    least = 1 << 62
    for size, count in sizes:
        most -= count
        if most < 0:
            break
        least = 1 << size
    return least


def numbered(vocabulary: DataFrame) -> DataFrame:
    """Number terms in alphabetical order, by ranges: (term, term_id, df, cf, idf).

    Terms are dealt out by ranges and written; a term's number is its place in its
    range after the terms of the ranges before.
    """
    ranged = vocabulary.repartitionByRange("term").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "vocabulary-ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("term"))
    return (
        ranged.withColumn("_place", place)
        .join(sizes.select("_part", before.alias("_before")), "_part")
        .select(
            "term", (F.col("_before") + F.col("_place") - 1).cast("int").alias("term_id"), "df", "cf", "idf"
        )
    )


def fit_statistics(
    statistics: DataFrame,
    n_docs: int,
    analyzer: Analyzer,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = None,
) -> TfidfModel:
    """Fit the vocabulary on the frequencies (term, df, cf) of all terms that may reach ``min_df``."""
    vocabulary = build_vocabulary(statistics, n_docs, min_df, max_df, max_features)
    table = materialize(numbered(vocabulary), "vocabulary")
    n_terms = table.count()
    if n_terms == 0:
        raise ValueError("no terms remain after pruning; lower min_df or raise max_df")
    return TfidfModel(table, n_terms, n_docs, analyzer)


def _require_room(n_docs: int, min_df: int, max_df: float) -> None:
    if max_df * n_docs < min_df:
        raise ValueError("max_df corresponds to fewer documents than min_df")


def numbered_rows(counted: DataFrame) -> DataFrame:
    """Add ``_row``, which tells documents apart also where they share an id."""
    return counted.withColumn("_row", F.monotonically_increasing_id())


def fit_tfidf(
    docs: DataFrame,
    id_column: str,
    text: str,
    analyzer: Analyzer = TERMS,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = None,
) -> TfidfModel:
    """Fit the vocabulary; all terms that the document frequencies leave, unless capped."""
    n_docs = docs.count()
    _require_room(n_docs, min_df, max_df)
    statistics = add_tallies(tallied_counts(docs, text, analyzer))
    return fit_statistics(statistics, n_docs, analyzer, min_df, max_df, max_features)


def fit_transform(
    docs: DataFrame,
    id_column: str,
    text: str,
    analyzer: Analyzer = TERMS,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = None,
):
    """The fitted model and the sparse rows of the same documents, tokenized once.

    Documents refer to terms by numbers within slices; a term moves once for each slice.
    """
    of_docs, terms = term_slices.counted_slices(docs, id_column, text, analyzer)
    n_docs = of_docs.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    _require_room(n_docs, min_df, max_df)
    found = materialize(term_slices.added_terms(terms, min_df), "slice-terms")
    discard(terms)
    model = fit_statistics(found.select("term", "df", "cf"), n_docs, analyzer, min_df, max_df, max_features)
    numbers = model.table.select("term", F.col("term_id").alias("number"), "idf")
    known = found.select("term", "slices", "codes").join(numbers, "term")
    return model, term_slices.weighted_rows(of_docs, known, id_column)


def entries(rows: DataFrame, id_column: str) -> DataFrame:
    """Sparse rows as (id, term_id, weight)."""
    pairs = F.arrays_zip("term_ids", "weights")
    return rows.select(id_column, F.inline(pairs).alias("term_id", "weight"))


def matrix_statistics(rows: DataFrame, n_terms: int) -> DataFrame:
    """One row: documents, terms and stored entries of the matrix."""
    return rows.agg(
        F.count("*").alias("n_docs"), F.sum(F.size("term_ids")).cast("long").alias("nnz")
    ).select("n_docs", F.lit(n_terms).cast("long").alias("n_terms"), "nnz")


def total_variance(rows: DataFrame, id_column: str, n_docs) -> DataFrame:
    """Sum over terms of the population variance of the weights, zeros included."""
    n_docs = n_docs if not isinstance(n_docs, (int, float)) else F.lit(n_docs)
    # Batches add up their own entries first; a row per entry would mostly be sorted and spilled.
    parts = rows.select("term_ids", "weights").mapInArrow(_moments, "term_id int, s double, q double")
    per_term = parts.repartition("term_id").groupBy("term_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / n_docs
    return per_term.agg(
        F.coalesce(F.sum(F.col("q") / n_docs - mean * mean), F.lit(0.0)).alias("total_variance")
    )


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term_id, s, q): sums of the weights and of their squares over each batch."""
    for batch in batches:
        terms, weights = batch.column("term_ids").flatten(), batch.column("weights").flatten()
        known = pc.is_valid(weights)
        terms, weights = terms.filter(known).to_numpy(), weights.filter(known).to_numpy()
        distinct, place = np.unique(terms, return_inverse=True)
        sums = [pa.array(np.bincount(place, x, len(distinct)), pa.float64()) for x in (weights, weights * weights)]
        yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.int32()), *sums], ["term_id", "s", "q"])
