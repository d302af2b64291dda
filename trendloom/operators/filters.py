"""Row filters of the corpus and guards on inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.cleaning import NOT_SPACE, SPACE

MIN_WORDS = 20


def drop_short_texts(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Keep documents with at least ``min_words`` words; blank ones go in any case.

    One pattern that stops at the last word it needs, however long the text is.
    """
    more = max(min_words, 1) - 1
    pattern = f"^{SPACE}*+(?:{NOT_SPACE}++{SPACE}++){{{more}}}{NOT_SPACE}"
    return docs.filter(F.coalesce(F.col(text), F.lit("")).rlike(pattern))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that the sides do not hold equally often: the side that has more, and both counts.

    Both tables are reduced to counts per key in one aggregation, so a key with
    many copies costs no more than one with a single row.
    """
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    side = F.when(F.col("n_left") > F.col("n_right"), "left").otherwise("right")
    return sides.filter("n_left <> n_right").select(key, side.alias("side"), "n_left", "n_right")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def require_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both tables hold the same keys, each once: joins on them keep the rows."""
    example = key_mismatch(left, right, key).take(1)
    if example:
        value, _, n_left, n_right = example[0]
        counts = f"{n_left} times in the left and {n_right} times in the right table"
        raise ValueError(f"{key} {value!r} is {counts}")
    example = repeated_keys(left, key).take(1)
    if example:
        raise ValueError(f"{key} {example[0][0]!r} is repeated: {example[0][1]} rows")
