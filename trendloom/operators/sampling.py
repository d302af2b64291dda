"""Uniform samples without replacement, reproducible on any partitioning.

A row's place in the random order is the MD5 of its id and a seed; a sample of
``n`` is the ``n`` smallest.  Sorting the corpus, or ranking a cluster that may
hold a third of it in one task, is avoided by finding the exact cut first: a
histogram over hash prefixes (a plain aggregation with map-side combine) tells
which prefix holds the n-th smallest hash, and only the rows of that one prefix
are ranked.  The wide rows are then filtered where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import materialize

# Four hex digits: 65,536 prefixes, so a ranked group is n / 65,536 rows.
PREFIX_DIGITS = 4


# Border prefixes with more rows than this are looked at more closely.
RANKED_ROWS = 100_000


def random_order(id_column: str, seed: int) -> Column:
    """The place of an id; null has one too."""
    named = F.coalesce(F.col(id_column).cast("string"), F.lit("\0null"))
    return F.md5(F.concat(named, F.lit(f"#{seed}")))


def _hashes(df: DataFrame, groups: list[str], id_column: str, seed: int) -> DataFrame:
    hashed = df.select(*groups, random_order(id_column, seed).alias("_hash"))
    return hashed.withColumn("_prefix", F.substring("_hash", 1, PREFIX_DIGITS))


def _borders(hashes: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The prefix with the n-th smallest hash of each group, and its place in there.

    Groups with fewer than ``n`` rows have none.  The running sum goes over at
    most 65,536 prefixes of a group.
    """
    histogram = hashes.groupBy(*groups, "_prefix").agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*groups).orderBy("_prefix"))
    return (
        histogram.withColumn("_upto", upto)
        .filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_rows") < n))
        .select(*groups, "_prefix", (n - F.col("_upto") + F.col("_rows")).alias("_wanted"))
    )


def _cut(order: DataFrame, n: int) -> tuple[str, int, int] | None:
    """The n-th smallest hash of ``order`` (_hash), its rows, and how many of them are among the n.

    None if there are fewer rows.  Prefixes get longer until few rows have the one at the
    border, so a hash that many rows share is counted and never ranked.
    """
    prefix, before = "", 0
    for digits in range(PREFIX_DIGITS, 33, PREFIX_DIGITS):
        inside = order.filter(F.col("_hash").startswith(prefix)) if prefix else order
        histogram = inside.groupBy(F.substring("_hash", 1, digits).alias("_prefix")).agg(F.count("*").alias("_rows"))
        upto = before + F.sum("_rows").over(Window.orderBy("_prefix"))
        border = (
            histogram.withColumn("_upto", upto)
            .filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_rows") < n))
            .first()
        )
        if border is None:
            return None
        prefix, before = border["_prefix"], border["_upto"] - border["_rows"]
        if border["_rows"] <= RANKED_ROWS:
            break
    counted = order.filter(F.col("_hash").startswith(prefix)).groupBy("_hash").agg(F.count("*").alias("_rows"))
    upto = before + F.sum("_rows").over(Window.orderBy("_hash"))
    last = counted.withColumn("_upto", upto).filter(F.col("_upto") >= n).orderBy("_hash").first()
    return last["_hash"], last["_rows"], n - (last["_upto"] - last["_rows"])


def hash_sample(df: DataFrame, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``min(n, rows)`` rows.

    Finding the cut reads the ids a few times and brings one row to the driver each
    time; the sample itself is then a plain filter.  Null counts as an id.  Rows that
    share an id lie together in the order; if the cut falls among them, they go by the
    hash of all their columns, and only rows that agree in these share their fate.
    """
    order = random_order(id_column, seed)
    found = _cut(df.select(order.alias("_hash")), n)
    if found is None:
        return df
    cut, rows, room = found
    if rows == room:
        return df.filter(order <= cut)
    tied = df.filter(order == cut)
    whole = F.md5(F.concat(F.xxhash64(*df.columns).cast("string"), F.lit(f"#{seed}")))
    last, _, _ = _cut(tied.select(whole.alias("_hash")), room)
    return df.filter((order < cut) | ((order == cut) & (whole <= last)))


def hash_sample_per_group(
    df: DataFrame, group: str, id_column: str, n: int, seed: int = 0
) -> DataFrame:
    """A uniform sample of ``min(n, rows)`` rows of every group; ids are unique.

    Borders and cuts are one small row per large group, written first: Spark
    then knows their size when it plans the joins and broadcasts them if small.
    """
    hashes = _hashes(df, [group], id_column, seed)
    borders = materialize(_borders(hashes, [group], n), "sample-borders")
    place = F.row_number().over(Window.partitionBy(group).orderBy("_hash"))
    cuts = (
        hashes.join(borders, [group, "_prefix"])
        .withColumn("_place", place)
        .filter(F.col("_place") == F.col("_wanted"))
        .select(group, F.col("_hash").alias("_cut"))
    )
    kept = df.join(materialize(cuts, "sample-cuts"), group, "left").filter(
        F.col("_cut").isNull() | (random_order(id_column, seed) <= F.col("_cut"))
    )
    return kept.select(*df.columns)
