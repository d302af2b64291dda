"""The whole way from raw metadata to named, mapped and trending topics.

Every step writes its result as a table below one output path and the next one
reads it: a lost executor costs a task, not a step, and each step can be run
again by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.fixed_values import CANDIDATE_TOPICS, CATEGORY_NAMES
from trendloom.functions.cleaning import clean_documents
from trendloom.functions.vectors import normalize_rows
from trendloom.operators import (
    block_svd,
    categories,
    clustering,
    filters,
    kmeans,
    layout,
    phrases,
    svd,
    tfidf,
    topic_map,
    trends,
    zero_shot,
)
from trendloom.session import scratch_of_run
from trendloom.sources import documents, models, tables


@dataclass(frozen=True)
class Settings:
    """All parameters of a run with their defaults."""

    on_bad_date: str = "raise"
    min_words: int = filters.MIN_WORDS
    min_df: int = tfidf.MIN_DF
    max_df: float = tfidf.MAX_DF
    max_features: int | None = 200_000
    n_components: int = svd.N_COMPONENTS
    n_iter: int = svd.N_ITER
    k_grid: tuple[int, ...] = clustering.SWEEP_GRID
    restarts: int = clustering.RESTARTS
    max_iter: int = 300
    candidates: tuple[str, ...] = tuple(CANDIDATE_TOPICS)
    whiten_candidates: bool = False
    category_names: dict[str, str] = field(default_factory=lambda: dict(CATEGORY_NAMES))
    phrases_per_cluster: int | None = None
    phrase_chars: int | None = None
    label_source: str = "categories"
    top_mode: str = "last3"
    n_top: int = trends.TOP_TOPICS
    map_rows: int = topic_map.SAMPLE_ROWS
    neighbors: int = topic_map.NEIGHBORS
    map_steps: int = layout.STEPS
    seed: int = 0

    def __post_init__(self):
        if self.label_source not in ("categories", "zero_shot", "none"):
            raise ValueError("label_source must be categories, zero_shot or none")
        if self.top_mode not in trends.MODES:
            raise ValueError(f"top_mode must be one of {', '.join(trends.MODES)}")


def clean(spark: SparkSession, raw_path: str, out: str, s: Settings) -> DataFrame:
    raw = documents.read_raw(spark, raw_path)
    documents.write_clean(clean_documents(raw, s.on_bad_date), f"{out}/clean")
    return documents.read_clean(spark, f"{out}/clean")


def embed(spark: SparkSession, out: str, s: Settings) -> None:
    """TF-IDF, SVD, whitened embeddings and document metadata."""
    docs = filters.drop_short_texts(
        documents.read_clean(spark, f"{out}/clean"), min_words=s.min_words
    )
    model, rows = tfidf.fit_transform(
        docs, "id", "text", min_df=s.min_df, max_df=s.max_df, max_features=s.max_features
    )
    models.save_tfidf(spark, model, f"{out}/tfidf")
    rows, seen = tables.write_observed(
        rows, f"{out}/tfidf_rows", n_docs=F.count("*"), nnz=F.sum(F.size("term_ids")).cast("long"),
        n_empty=F.count(F.when(F.size("term_ids") == 0, True)),
    )
    factors = block_svd.decompose(rows, "id", model.n_terms, s.n_components, s.n_iter, s.seed)
    models.save_svd(spark, factors, f"{out}/svd")
    stored = tables.write_embeddings(svd.whitened(rows, "id", factors), f"{out}/embeddings")
    meta, of_meta = tables.write_observed(
        docs.select("id", "categories", "update_year"), f"{out}/doc_meta",
        null_ids=F.count(F.when(F.col("id").isNull(), True)),
    )
    filters.require_same_keys(stored, meta, "id")
    part = svd.component_variance(svd.unwhitened(stored, factors.s)).first()[0]
    whole = tfidf.total_variance(rows, "id", model.n_docs).first()[0]
    explained = part / whole if whole else 0.0
    numbers = {**seen, **of_meta, "n_terms": model.n_terms}
    report = spark.createDataFrame([(*numbers.values(), explained)], [*numbers, "explained_variance"])
    tables.write_csv(report, f"{out}/embedding_report.csv")


def cluster(spark: SparkSession, out: str, s: Settings) -> None:
    """Choice of K, final clusters, top terms and yearly shares."""
    stored = tables.read_embeddings(spark, f"{out}/embeddings")
    unit = normalize_rows(stored, "embedding").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sweep = clustering.sweep_k(
            unit, "id", "embedding", s.k_grid, clustering.STARTS, s.seed, s.max_iter
        )
        model, _ = kmeans.best_restart(
            unit, "id", "embedding", sweep.k, s.restarts, s.seed, s.max_iter
        )
        clustered = kmeans.assign(unit, "embedding", model)
        final = clustering.silhouette_score(clustered, "embedding", "cluster")
        # Once, beside the unit rows: labels by name and the map read them from there.
        clustered = tables.write_table(
            clustered.select("id", "cluster", "embedding"), f"{out}/clustered"
        )
        meta = tables.read_table(spark, f"{out}/doc_meta")
        meta = tables.write_table(
            meta.join(clustered.select("id", "cluster"), "id"), f"{out}/doc_meta_with_clusters"
        )
    finally:
        unit.unpersist()
    models.save_kmeans(spark, model, f"{out}/kmeans")
    report = sweep.frame(spark).withColumn(
        "final_silhouette", F.when(F.col("chosen"), F.lit(final))
    )
    tables.write_csv(report, f"{out}/k_report.csv")
    factors = tables.read_table(spark, f"{out}/svd/factors")
    vocabulary = tables.read_table(spark, f"{out}/tfidf/vocabulary")
    weights = clustering.term_weights(factors, kmeans.centers_frame(spark, model))
    tables.write_csv(
        clustering.top_terms(weights, vocabulary).orderBy("cluster"), f"{out}/cluster_top_terms.csv"
    )
    share = tables.write_table(trends.yearly_share(meta), f"{out}/yearly_share")
    tables.write_csv(trends.share_table(share), f"{out}/cluster_share_by_year.csv")
    tables.write_csv(clustering.cluster_sizes(meta, top=None), f"{out}/cluster_sizes.csv")


def label_by_names(spark: SparkSession, out: str, s: Settings) -> None:
    meta = tables.read_table(spark, f"{out}/doc_meta_with_clusters")
    names = zero_shot.candidate_names(spark, s.candidates)
    embedded = zero_shot.embed_names(
        names,
        models.load_tfidf(spark, f"{out}/tfidf"),
        models.load_svd(spark, f"{out}/svd"),
        s.whiten_candidates,
    )
    clustered = tables.read_table(spark, f"{out}/clustered")
    centers = zero_shot.unit_centroids(clustered, "embedding", "cluster")
    labels = zero_shot.zero_shot_labels(zero_shot.similarity(centers, embedded), names)
    labels = tables.write_table(labels, f"{out}/labels_zero_shot")
    tables.write_csv(labels.orderBy("cluster"), f"{out}/cluster_labels_zero_shot.csv")
    tables.write_table(categories.join_labels(meta, labels), f"{out}/doc_meta_with_labels")


def label_by_phrases(spark: SparkSession, out: str, s: Settings) -> None:
    meta = tables.read_table(spark, f"{out}/doc_meta_with_clusters")
    found = phrases.cluster_phrases(
        documents.read_clean(spark, f"{out}/clean"),
        meta,
        per_cluster=s.phrases_per_cluster,
        max_chars=s.phrase_chars,
        seed=s.seed,
    )
    found = tables.write_table(found, f"{out}/key_phrases")
    tables.write_csv(found.orderBy("cluster"), f"{out}/cluster_key_phrases.csv")
    tables.write_table(categories.join_labels(meta, found), f"{out}/doc_meta_with_phrases")


def label_by_categories(spark: SparkSession, out: str, s: Settings) -> None:
    meta = tables.read_table(spark, f"{out}/doc_meta_with_clusters")
    counts = tables.write_table(categories.category_counts(meta), f"{out}/category_counts")
    tables.write_csv(categories.ordered_counts(counts), f"{out}/cluster_category_counts.csv")
    names = categories.category_names(spark, s.category_names)
    labels = categories.category_labels(categories.top_codes(counts), names)
    labels = tables.write_table(labels, f"{out}/labels_from_categories")
    tables.write_csv(labels.orderBy("cluster"), f"{out}/cluster_labels_from_categories.csv")
    labelled = categories.join_labels(
        categories.with_codes(meta), labels, "label_auto", "label_alt"
    )
    tables.write_table(labelled, f"{out}/doc_meta_with_cat_labels")


def chosen_labels(spark: SparkSession, out: str, s: Settings) -> DataFrame | None:
    folder = {"categories": "labels_from_categories", "zero_shot": "labels_zero_shot"}
    if s.label_source == "none":
        return None
    return tables.read_table(spark, f"{out}/{folder[s.label_source]}")


def trend(spark: SparkSession, out: str, s: Settings) -> None:
    """The series behind the two trend charts."""
    series = trends.share_series(tables.read_table(spark, f"{out}/yearly_share"))
    terms = tables.read_csv(spark, f"{out}/cluster_top_terms.csv", "cluster int, top_terms string")
    total = trends.rank_topics(series, "total", trends.TOP_BY_TOTAL)
    by_total = trends.chart_series(total, terms, "top_terms")
    tables.write_csv(by_total.orderBy("rank", "update_year"), f"{out}/yearly_trends_top8.csv")
    best = trends.rank_topics(series, s.top_mode, s.n_top)
    named = trends.chart_series(best, chosen_labels(spark, out, s))
    tables.write_csv(named.orderBy("rank", "update_year"), f"{out}/top_topics_over_years.csv")


def map_topics(spark: SparkSession, out: str, s: Settings) -> None:
    """The table behind the two-dimensional map and its legend."""
    docs = tables.read_table(spark, f"{out}/clustered")
    labels = chosen_labels(spark, out, s)
    placed = topic_map.topic_map(
        docs, "id", "embedding", labels, s.map_rows, s.neighbors, s.seed, s.map_steps
    )
    placed = tables.write_table(placed, f"{out}/topic_map")
    tables.write_csv(topic_map.largest_clusters(placed, labels), f"{out}/topic_map_legend.csv")


def run_pipeline(
    spark: SparkSession, raw_path: str, out: str, settings: Settings | None = None
) -> None:
    """All steps in order; ``out`` is the folder of this run."""
    s = settings or Settings()
    clean(spark, raw_path, out, s)
    with scratch_of_run(spark):
        for step in (
            embed,
            cluster,
            label_by_categories,
            label_by_names,
            label_by_phrases,
            trend,
            map_topics,
        ):
            step(spark, out, s)
