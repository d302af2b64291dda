"""Yearly shares of clusters and rankings of topics over the years.

Only the first aggregation reads documents; everything after it works on one
row per year and cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.labels import is_cluster_name, legend_label, short_label

TOP_BY_TOTAL = 8
TOP_TOPICS = 10
MODES = ("overall", "last", "last3", "total")


def yearly_share(meta: DataFrame) -> DataFrame:
    """(update_year, cluster, n, share); documents without year or cluster do not count."""
    counts = (
        meta.filter(F.col("update_year").isNotNull() & F.col("cluster").isNotNull())
        .groupBy("update_year", "cluster")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("update_year"))
    return counts.withColumn("share", F.col("n") / total)


def share_series(share: DataFrame) -> DataFrame:
    """(cluster, series): all years of the data in order, share 0 where a cluster is absent.

    ``share`` has one row per year and cluster, which is what the window over
    the whole table sees.
    """
    years = F.sort_array(F.collect_set("update_year").over(Window.partitionBy(F.lit(1))))
    known = share.select("cluster", "update_year", "share", years.alias("years"))
    per_cluster = known.groupBy("cluster").agg(
        F.first("years").alias("years"),
        F.map_from_entries(F.collect_list(F.struct("update_year", "share"))).alias("known"),
    )
    series = F.transform(
        "years",
        lambda year: F.struct(
            year.alias("update_year"),
            F.coalesce(F.try_element_at("known", year), F.lit(0.0)).alias("share"),
        ),
    )
    return per_cluster.select("cluster", series.alias("series"))


def share_grid(share: DataFrame) -> DataFrame:
    """(update_year, cluster, share) for every year with every cluster."""
    return share_series(share).select(
        "cluster", F.inline("series").alias("update_year", "share")
    ).select("update_year", "cluster", "share")


def share_table(share: DataFrame, clusters: list[int] | None = None) -> DataFrame:
    """One row per year, one column per cluster, zeros filled, sorted by year."""
    if clusters is None:
        clusters = sorted(row[0] for row in share.select("cluster").distinct().collect())
    wide = share.groupBy("update_year").pivot("cluster", clusters).agg(F.first("share"))
    return wide.na.fill(0.0).orderBy("update_year")


def unpivot_shares(wide: DataFrame, year: str = "update_year") -> DataFrame:
    """(update_year, cluster, share) from a wide table; other columns are ignored."""
    names = [name for name in wide.columns if name != year and is_cluster_name(name)]
    if not names:
        raise ValueError("no column is named by a cluster id")
    chosen = wide.select(
        F.col(f"`{year}`").cast("int").alias("update_year"),
        *[F.col(f"`{name}`").cast("double").alias(str(int(name))) for name in names],
    )
    long = chosen.unpivot(["update_year"], None, "cluster", "share")
    return long.withColumn("cluster", F.col("cluster").cast("int"))


def topic_score(series: Column, mode: str) -> Column:
    """Score of one series: mean, latest year, sum of the last three years, or sum."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    shares = F.transform(series, lambda x: x["share"])
    if mode == "last":
        return F.element_at(shares, -1)
    if mode == "last3":
        shares = F.slice(F.reverse(shares), 1, 3)
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return total / F.size(series) if mode == "overall" else total


def rank_topics(series: DataFrame, mode: str = "last3", top: int | None = TOP_TOPICS) -> DataFrame:
    """(rank, cluster, score, series) of the best topics.

    Scores count to nine decimals, equal ones go by cluster id.
    """
    scored = series.withColumn("score", F.round(topic_score(F.col("series"), mode), 9))
    best = scored.orderBy(F.desc("score"), "cluster")
    if top is not None:
        best = best.limit(top)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "cluster"))
    return best.select(rank.alias("rank"), "cluster", "score", "series")


def with_labels(
    ranked: DataFrame, labels: DataFrame | None = None, column: str = "label_auto"
) -> DataFrame:
    """Add the chart label of every ranked topic.

    ``labels`` has a label per cluster: names (``label_auto``) are cut to their
    first part, ``top_terms`` to three terms; without labels the id stands alone.
    """
    if labels is None:
        nothing = F.lit(None).cast("string")
        return ranked.withColumn("label", short_label(F.col("cluster"), nothing))
    text = labels.select("cluster", F.col(column).alias("_text"))
    shape = legend_label if column == "top_terms" else short_label
    named = ranked.join(text, "cluster", "left")
    return named.withColumn("label", shape(F.col("cluster"), F.col("_text"))).drop("_text")


def chart_series(
    ranked: DataFrame, labels: DataFrame | None = None, column: str = "label_auto"
) -> DataFrame:
    """(rank, cluster, label, update_year, share): the lines of a trend chart."""
    return with_labels(ranked, labels, column).select(
        "rank", "cluster", "label", F.inline("series").alias("update_year", "share")
    )
