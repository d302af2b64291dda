"""Mixing sources to target weights by Pareto order sampling, on DataFrame functions only.

A source's target is its share of the mix in words; no target may pass
``max_copies`` times its source, and what is cut off there is shared again by
weight.  Inside a source a document of ``size`` words is expected in

    copies = min(max_copies, c * bits(size))

copies, ``bits`` being the binary length of the size: longer documents are
likelier, in steps of doublings, and ``c`` is set so that the expected words are
the target.  The whole part of ``copies`` is certain.  The fraction ``p`` is an
inclusion probability: documents are ranked by their random odds u / (1 - u)
divided by their inclusion odds p / (1 - p), and taken from the smallest
ratio on until the words left to take are reached as closely as whole documents
allow.  The size that is fixed is thus the number of words.

No source is sorted or gathered: the place where the order is cut comes from a
histogram of ratios, and only the documents of the one class at the cut are
ranked.  Applying the plan is a projection with a join to a small table.

Documents without words, null or empty, count in no source's size and are never
taken.  The random number depends on the id, the text's digest and, where rows of a
source repeat both, on their number among these, so each row is drawn by itself and
reruns agree up to the exchange of rows with equal id and text.  Such rows are numbered
by the part of the table that they are in, so a group of any size is spread.  A null
source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.text import WORD_RUN
from trendloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
#: Bits of a document's place in the order that are counted, and how many at a time:
#: a histogram has 128 classes of a source, and 2 ** -21 of a source is ranked.
PLACE_BITS, STEP_BITS = 21, 7


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_RUN)).cast("long")


def _bits(size: Column) -> Column:
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def _uniform(key: Column, seed: int) -> Column:
    """A number inside (0, 1) with 52 random bits that depends on the row's key and the seed only."""
    digest = F.md5(F.concat(key, F.lit(f"#{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _same() -> Column:
    """Equal for rows of a source that repeat id and text."""
    return F.xxhash64("source", F.col("doc_id").cast("string"), "digest")


def _keyed(rows: DataFrame, number: Column | str) -> DataFrame:
    """Add ``key``: id, digest and number of a row."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    number = F.col(number) if isinstance(number, str) else number
    return rows.withColumn("key", F.concat_ws("#", name, "digest", number.cast("string")))


def _repeated(sized: DataFrame) -> DataFrame | None:
    """(same) of the rows that others repeat; None if there are none."""
    several = sized.groupBy("same").agg(F.count("*").alias("n")).filter("n > 1").select("same")
    several = materialize(several, "mix-repeated")
    return several if several.limit(1).count() else None


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``number``, the place of a written row (with ``row``) among those of its ``same``.

    Rows are ranked inside their part of the table, after all those of the parts before.
    """
    rows = rows.withColumn("part", F.shiftright("row", 33))
    place = F.row_number().over(Window.partitionBy("same", "part").orderBy("row"))
    sizes = rows.groupBy("same", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("same").orderBy("part")) - F.col("n")
    offsets = sizes.select("same", "part", before.alias("before"))
    ranked = rows.withColumn("place", place).join(offsets, ["same", "part"])
    return ranked.withColumn("number", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def _sized(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, source, size and key of every row, written; and the repeated ones."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), _digest().alias("digest"))
    rows = materialize(rows.withColumns({"same": _same(), "row": F.monotonically_increasing_id()}), "mix-sizes")
    several = _repeated(rows)
    names = ["doc_id", "source", "size", "key"]
    if several is None:
        return _keyed(rows, F.lit(0)).select(names), None
    single = _keyed(rows.join(several, "same", "left_anti"), F.lit(0)).select(names)
    numbered = _keyed(_numbered(rows.join(several, "same", "left_semi")), "number").select(names)
    return materialize(single.unionByName(numbered), "mix-keys"), several


def _targets(words: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: one row per source; the windows go over sources only.

    A source is full if, with the level at which it just fills up, the sources
    together would not use more than there is to share.
    """
    sources = words.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_code_point) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    sources = sources.withColumn("weight", weight.cast("long")).withColumn(
        "most", F.col("source_size") * float(most)
    )
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = ranked.rowsBetween(1, Window.unboundedFollowing)
    sources = sources.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * float(share),
            "if_full": F.sum("most").over(upto)
            + F.col("most") / F.col("weight") * F.coalesce(F.sum("weight").over(after), F.lit(0)),
        }
    ).withColumn("full", F.col("if_full") <= F.col("budget"))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    full_words = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0))
    level = (F.col("budget") - full_words) / open_weight
    target = F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def _copies(words: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Expected copies for each source and binary length of the size; at most 64 rows a source."""
    source = Window.partitionBy("source")
    longer = source.orderBy(F.col("bits").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    shorter = source.orderBy(F.col("bits").desc()).rowsBetween(1, Window.unboundedFollowing)
    scaled = F.col("bits") * F.col("words")
    plan = (
        words.filter("bits > 0")
        .join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
        .drop("target_source")
        .withColumn(
            "if_full",
            F.sum("words").over(longer) * float(most)
            + (float(most) / F.col("bits")) * F.coalesce(F.sum(scaled).over(shorter), F.lit(0)),
        )
        .withColumn("full", F.col("if_full") <= F.col("target"))
    )
    full_words = F.coalesce(F.sum(F.when(F.col("full"), F.col("words"))).over(source), F.lit(0)) * float(most)
    open_scaled = F.sum(F.when(~F.col("full"), scaled)).over(source)
    copies = F.when(F.col("full"), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), (F.col("target") - full_words) / open_scaled * F.col("bits"))
    )
    plan = plan.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    certain = F.sum(F.col("whole") * F.col("words")).over(source)
    return plan.select(
        "source",
        "bits",
        "source_size",
        "target",
        "whole",
        (F.col("copies") - F.col("whole")).alias("p"),
        (F.col("target") - certain).alias("left_words"),
    )


def _ratio(seed: int) -> Column:
    u, p = _uniform(F.col("key"), seed), F.col("p")
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _of_source(rows: DataFrame, plan: DataFrame, *names: str) -> DataFrame:
    """Join rows to the plan by source, null included, and the other ``names``."""
    plan = plan.withColumnsRenamed({name: f"_{name}" for name in ("source", *names)})
    condition = F.col("source").eqNullSafe(F.col("_source"))
    for name in names:
        condition = condition & (F.col(name) == F.col(f"_{name}"))
    return rows.join(plan, condition, "left").drop("_source", *(f"_{name}" for name in names))


def mix_plan(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_copies: float = MAX_COPIES,
    seed: int = 0,
) -> DataFrame:
    """The plan of a mix of ``sized`` (source, size, key): a small written table.

    One row per source and binary length of the size: source_size, target, whole
    (certain copies), p (inclusion probability of one more), and cut_ratio and
    cut_key, the last place of the source's order that is taken.
    """
    words = materialize(
        sized.withColumn("bits", _bits(F.col("size")))
        .groupBy("source", "bits")
        .agg(F.sum("size").alias("words")),
        "mix-words",
    )
    plan = materialize(
        _copies(words, _targets(words, weights, share, max_copies), max_copies), "mix-plan"
    )
    place = F.col("ratio") / (1 + F.col("ratio"))
    ranked = (
        _of_source(sized.withColumn("bits", _bits(F.col("size"))), plan, "bits")
        .withColumn("ratio", _ratio(seed))
        .filter(F.col("ratio").isNotNull())
        .select(
            "source",
            "size",
            "ratio",
            "key",
            "left_words",
            F.floor(place * 2.0**PLACE_BITS).cast("long").alias("class"),
        )
    )
    borders = _border_class(ranked)
    in_order = Window.partitionBy("source").orderBy("ratio", "key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    border = (
        _of_source(ranked, borders.withColumnRenamed("before", "before_class"), "class")
        .filter(F.col("before_class").isNotNull())
        .withColumn("after", F.col("before_class") + F.sum("size").over(in_order))
        .withColumn("before", F.col("after") - F.col("size"))
    )
    # The document that passes the mark is taken if that brings the words nearer to it.
    taken = (F.col("before") < F.col("left_words")) & (
        F.col("after") - F.col("left_words") <= F.col("left_words") - F.col("before")
    )
    last = border.groupBy("source").agg(
        F.max(F.when(taken, F.struct("ratio", "key"))).alias("last"), F.first("class").alias("class")
    )
    cuts = last.select(
        "source",
        F.coalesce("last.ratio", F.col("class") / (2.0**PLACE_BITS - F.col("class"))).alias("cut_ratio"),
        F.coalesce("last.key", F.lit("")).alias("cut_key"),
    )
    return materialize(_of_source(plan, cuts), "mix-cuts")


def _border_class(ranked: DataFrame) -> DataFrame:
    """source, class, before: the class in which a source's words are used up, and the words before it.

    Found in steps of seven bits of the place, each a histogram of the class found last.
    """
    border = None
    for shift in range(PLACE_BITS - STEP_BITS, -1, -STEP_BITS):
        rows, before = ranked.withColumn("before", F.lit(0).cast("long")), F.col("before")
        if border is not None:
            found = border.withColumnRenamed("class", "parent")
            rows = _of_source(ranked, found).filter(
                F.shiftright("class", shift + STEP_BITS) == F.col("parent")
            )
        classes = rows.groupBy("source", F.shiftright("class", shift).alias("class")).agg(
            F.sum("size").alias("words"),
            F.first("left_words").alias("left_words"),
            F.first("before").alias("before"),
        )
        upto = before + F.sum("words").over(Window.partitionBy("source").orderBy("class"))
        border = materialize(
            classes.withColumn("upto", upto)
            .filter((F.col("upto") >= F.col("left_words")) & (F.col("upto") - F.col("words") < F.col("left_words")))
            .select("source", "class", (F.col("upto") - F.col("words")).alias("before")),
            "mix-border",
        )
    return border


def with_copies(rows: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (source, size, key, and more) with source_size, target and copies.

    A document's target and source_size are those of its source.  No shuffle of
    the rows, as long as the plan (64 rows a source at most) is small.
    """
    names = ("p", "whole", "left_words", "cut_ratio", "cut_key", "bits")
    by_source = plan.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    planned = _of_source(
        rows.withColumn("bits", _bits(F.col("size"))), plan.drop("source_size", "target"), "bits"
    )
    ratio = _ratio(seed)
    # Without a cut the source's fractions are taken whole or not at all.
    extra = F.when(F.col("p").isNull() | (F.col("p") <= 0), False).otherwise(
        F.when(F.col("cut_ratio").isNull(), F.col("left_words") > 0).otherwise(
            (ratio < F.col("cut_ratio"))
            | ((ratio == F.col("cut_ratio")) & (F.col("key") <= F.col("cut_key")))
        )
    )
    copies = F.coalesce(F.col("whole"), F.lit(0)) + extra.cast("long")
    return (
        _of_source(planned.withColumn("copies", copies), by_source)
        .withColumn("source_size", F.coalesce("source_size", F.lit(0).cast("long")))
        .withColumn("target", F.coalesce("target", F.lit(0.0)))
        .drop(*names)
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies of each row."""
    seed = settings.get("seed", 0)
    sized, _ = _sized(docs)
    return with_copies(sized, mix_plan(sized, **settings), seed).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.col("copies").cast("int").alias("copies"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Rows are not shuffled, but for those that repeat id and text, which are written once more.
    """
    seed = settings.get("seed", 0)
    sized, several = _sized(docs)
    plan = mix_plan(sized, **settings)
    whole = docs.select(
        "doc_id", "source", word_count().alias("size"), _digest().alias("digest"), F.struct(*docs.columns).alias("_row")
    ).withColumn("same", _same())
    names = ["source", "size", "key", "_row"]
    if several is None:
        keyed = _keyed(whole, F.lit(0)).select(names)
    else:
        many = whole.join(several, "same", "left_semi").withColumn("row", F.monotonically_increasing_id())
        keyed = _keyed(whole.join(several, "same", "left_anti"), F.lit(0)).select(names)
        keyed = keyed.unionByName(_keyed(_numbered(materialize(many, "mix-repeats")), "number").select(names))
    taken = with_copies(keyed, plan, seed).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
