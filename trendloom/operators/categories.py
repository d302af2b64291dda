"""Name clusters after the category codes of their documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.fixed_values import CATEGORY_NAMES
from trendloom.functions.labels import category_codes, join_shortened
from trendloom.operators.filters import require_columns

MIN_SHARE = 0.05
TOP_CODES = 3


def category_names(spark: SparkSession, names: dict[str, str] = CATEGORY_NAMES) -> DataFrame:
    """(code, name) as a local table, whose size Spark knows when it plans a join."""
    return spark.createDataFrame(pa.table({"code": list(names), "name": list(names.values())}))


def with_codes(meta: DataFrame) -> DataFrame:
    """Add the list of codes of every document."""
    return meta.withColumn("codes", category_codes(F.col("categories")))


def category_counts(meta: DataFrame) -> DataFrame:
    """(cluster, codes, n, cluster_total, share): mentions of each code per cluster."""
    require_columns(meta, "cluster", "categories")
    mentions = with_codes(meta).select("cluster", F.explode_outer("codes").alias("codes"))
    counts = (
        mentions.filter(F.col("cluster").isNotNull() & F.col("codes").isNotNull())
        .groupBy("cluster", "codes")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("cluster"))
    return counts.withColumn("cluster_total", total).withColumn(
        "share", F.col("n") / F.col("cluster_total")
    )


def ordered_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy("cluster", F.desc("n"), "codes")


def top_codes(
    counts: DataFrame, top: int = TOP_CODES, min_share: float = MIN_SHARE
) -> DataFrame:
    """The first codes of every cluster with at least ``min_share``.

    A cluster in which no code reaches it keeps its first codes anyway.  Equal
    counts go by code.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "codes")
    first = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    highest = F.max("share").over(Window.partitionBy("cluster"))
    return (
        first.withColumn("highest", highest)
        .filter((F.col("share") >= min_share) | (F.col("highest") < min_share))
        .drop("highest")
    )


def category_labels(
    top: DataFrame, names: DataFrame, short: int = 80, long: int = 120
) -> DataFrame:
    """(cluster, label_auto, label_alt, top_codes, top_names); unknown codes name themselves."""
    named = top.join(names, top["codes"] == names["code"], "left").select(
        "cluster", "place", "codes", F.coalesce("name", "codes").alias("name")
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "codes", "name")))
    lists = named.groupBy("cluster").agg(listed.alias("l")).select(
        "cluster",
        F.col("l.codes").alias("c"),
        F.col("l.name").alias("n"),
        F.transform("l", lambda x: F.concat(x["codes"], F.lit(" — "), x["name"])).alias("b"),
    )
    return lists.select(
        "cluster",
        join_shortened(F.col("n"), short).alias("label_auto"),
        join_shortened(F.col("b"), long).alias("label_alt"),
        F.array_join("c", ", ").alias("top_codes"),
        F.array_join("n", ", ").alias("top_names"),
    )


def labels_from_categories(meta: DataFrame, names: DataFrame | None = None) -> DataFrame:
    names = names if names is not None else category_names(meta.sparkSession)
    return category_labels(top_codes(category_counts(meta)), names)


def join_labels(meta: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Documents with the labels of their cluster.

    Pass a written label table: Spark then knows its size when it plans the
    join and broadcasts it only if it is small; otherwise adaptive execution
    splits clusters that hold many documents.
    """
    columns = columns or tuple(name for name in labels.columns if name != "cluster")
    return meta.join(labels.select("cluster", *columns), "cluster", "left")
