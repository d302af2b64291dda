"""Exact deduplication that survives hot texts, on DataFrame functions only.

Texts are equal when they are identical after each run of white space has been
replaced by one space.  Digests alone tell which texts may have copies; the others
never move.  A table of bits, of a fixed size at most, holds the repeated digests and
goes to all tasks; a digest that shares its bit by chance only costs a look.  Texts that
are left are combined in three steps, each of which compares the whole normalised text
next to its digest:

1. each task combines the copies that it holds itself (map-side aggregation),
2. groups of (digest, salt, text) are merged, so that the copies of one text,
   be they a third of all rows, meet in many tasks,
3. the winners of the salts, at most ``salts`` per text, are merged globally.

Rows then find their winner by digest; large groups are few, so their winners are sent
to the rows.  If different texts shared a digest, the rows of these digests, and only
these, find it by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.text import SPACE_RUN
from trendloom.session import materialize

SALTS = 16
#: Words of 64 bits in the table of repeated digests.
WORDS = 1 << 21
#: Groups with more rows than this, and than a share of all rows, are sent: at most 1 / HOT_SHARE.
HOT_ROWS, HOT_SHARE = 1000, 1e-5


def normalised(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACE_RUN, " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _rank(row: str | None = None) -> Column:
    """What is smallest in the row that stays: ids before nulls, then the row's number."""
    parts = [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")]
    return F.struct(*parts, *([F.col(row).alias("row")] if row else []))


def combine(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per digest and content: the winner ``best``, and the number of its ``copies``.

    ``keyed`` has digest, content, rank (the winner is the smallest) and salt_key.
    """
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("salt_key"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.min("rank").alias("best"), F.count("*").alias("copies")
    )
    return merged.groupBy("digest", "content").agg(
        F.min("best").alias("best"), F.sum("copies").alias("copies")
    )


def _bit(digest: str = "digest") -> tuple[Column, Column]:
    """Where a digest's bit is: its word, and the word with this bit alone."""
    slot = F.pmod(F.xxhash64(digest), F.lit(64 * WORDS))
    return F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))


def _bits(digests: DataFrame) -> DataFrame:
    """(word, bits) of some digests: never more than ``WORDS`` rows."""
    word, bit = _bit()
    bits = digests.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    return materialize(bits, "exact-bits")


def _with_bit(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose digest has its bit in the table, found where they are."""
    word, bit = _bit()
    marked = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word")
    return marked.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")


def duplicate_groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs`` with the row that stays of its group of equal texts.

    Columns: doc_id, digest (binary), keep_id, group_size, kept.  A null text
    counts as empty; empty texts are equal to each other.  A row without id stays
    only if no copy has one.  Of rows that repeat both id and text one stays.
    ``digest`` maps the normalised text to its digest.
    """
    content = normalised("text")
    rows = materialize(
        docs.select("doc_id", digest(content).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "exact-digests",
    )
    several = rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    bits = _bits(several)
    texts = docs.select(
        digest(content).alias("digest"),
        content.alias("content"),
        _rank().alias("rank"),
        F.col("doc_id").alias("salt_key"),
    )
    classes = materialize(
        combine(_with_bit(texts, bits), salts)
        .groupBy("digest")
        .agg(
            F.count("*").alias("contents"),
            F.min("best.id").alias("keep_id"),
            F.sum("copies").alias("group_size"),
        )
        .filter("contents > 1 OR group_size > 1"),
        "exact-classes",
    )
    alike = classes.filter("contents = 1").drop("contents")
    found = _marked(rows, _with_bit(rows, bits), alike, ["digest"])
    shared = classes.filter("contents > 1").select("digest")
    if not shared.limit(1).count():
        return found
    found = found.join(shared, "digest", "left_anti")
    collided = docs.select("doc_id", digest(content).alias("digest"), content.alias("content"))
    collided = materialize(
        _with_bit(collided, bits).join(shared, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()),
        "exact-collisions",
    )
    winners = combine(
        collided.select("digest", "content", _rank().alias("rank"), F.col("doc_id").alias("salt_key")), salts
    ).select("digest", "content", F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"))
    return found.unionByName(_marked(collided, collided, winners, ["digest", "content"]))


def _marked(rows: DataFrame, candidates: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Give each row its class, and mark the row that stays: the first of those with the winning id.

    ``classes`` has one row per group of copies, and ``candidates`` all rows of these.
    The first row of each group is found by an aggregation, which combines inside tasks.
    Groups that are large against the table go to the rows; the rest are joined.
    """
    firsts = candidates.groupBy(*keys).agg(F.min(_rank("row")).alias("first"))
    firsts = firsts.select(*keys, F.col("first.row").alias("first"))
    classes = materialize(classes.join(firsts, keys), "exact-winners")
    most = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot = F.broadcast(classes.filter(F.col("group_size") > most))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    joined = rows.join(hot, keys).unionByName(
        rest.join(classes.filter(F.col("group_size") <= most), keys, "left")
    )
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        "digest",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("first"))).alias("kept"),
    )


def drop_flagged(docs: DataFrame, digest: Column, flags: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``flags`` (doc_id, digest, kept) do not keep; all columns.

    Rows that go are narrow, so they are taken away by an anti join on id and
    digest.  Only where an id comes twice with the same digest, kept and not kept,
    its rows are merged into one.  Ids may be of any type that has a text.
    """
    name = "key"
    while name in docs.columns:
        name += "_"

    def key(of: Column) -> Column:
        named = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
        return F.struct(named.alias("id"), of.alias("digest"))

    keyed = docs.withColumn(name, key(digest))
    flagged = flags.select(key(F.col("digest")).alias(name), "kept")
    gone = flagged.filter(~F.col("kept")).select(name)
    repeated = materialize(
        flagged.filter("kept").select(name).join(gone, name, "left_semi").distinct(), "repeated-rows"
    )
    # What goes grows with the corpus, so it is not sent to the rows.
    stay = keyed.join(gone.hint("merge"), name, "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return stay
    merged = keyed.join(repeated, name, "left_semi").groupBy(name)
    merged = merged.agg(F.first(F.struct(*docs.columns)).alias("row"))
    return stay.unionByName(merged.select("row.*"))


def drop_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``docs`` without the copies of a text; all columns of the rows that stay."""
    flags = materialize(duplicate_groups(docs, salts=salts), "exact-flags")
    return drop_flagged(docs, sha256(normalised("text")), flags)
