"""The registered queries: each runs one operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import cleaning, labels, tokens
from trendloom.functions.vectors import normalize_rows
from trendloom.operators import (
    block_svd,
    categories,
    cells,
    clustering,
    filters,
    kmeans,
    layout,
    phrases,
    sampling,
    svd,
    tfidf,
    topic_map,
    trends,
    zero_shot,
)
from trendloom.plans import fixtures as fx
from trendloom.schemas import CATEGORY_COUNTS
from trendloom.session import materialize, scratch_path
from trendloom.sources import models, quarantine, tables
from trendloom.sources.documents import parse_raw, read_clean, write_clean
from trendloom.streaming.assign_stream import assign_stream as start_assigning
from trendloom.streaming.assign_stream import load_models, read_assigned
from trendloom.streaming.clean_stream import clean_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Settings of the registered queries where the given tables ask for other
# values than the defaults.
SMALL_VOCABULARY = 500
SMALL_RESERVOIR = 40
SMALL_SAMPLE = 100
K_GRID = (5, 8, 10, 12)


def query(function):
    QUERIES[function.__name__] = function
    return function


def r6(column) -> F.Column:
    return F.round(column, 6)


def components(df: DataFrame, *keys: str, vector: str) -> DataFrame:
    long = df.select(*keys, F.posexplode_outer(vector).alias("component", "value"))
    long = long.filter(F.col("component").isNotNull())
    return long.withColumn("value", r6(F.col("value").cast("double")))


# ---- sources, cleaning -------------------------------------------------------


def raw_documents(spark, sf):
    return fx.latex(spark, sf)


@query
def ndjson_scan(spark, sf):
    lines = raw_documents(spark, sf).select(F.to_json(F.struct("*")).alias("line"))
    return parse_raw(lines, "line").select("id", "title", "abstract", "update_date")


@query
def clean_strip(spark, sf):
    raw = raw_documents(spark, sf)
    return raw.select(
        "id",
        cleaning.strip(F.col("title")).alias("title"),
        cleaning.strip(F.col("abstract")).alias("abstract"),
    )


@query
def clean_whitespace(spark, sf):
    docs = fx.table(spark, sf, "documents")
    flat = docs.select("doc_id", cleaning.collapse_spaces(F.col("text")).alias("text"))
    return flat.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def latex_ops(spark, sf):
    raw = raw_documents(spark, sf)
    return raw.select("id", cleaning.relation_words(F.col("abstract")).alias("text"))


@query
def latex_math_blocks(spark, sf):
    raw = raw_documents(spark, sf)
    return raw.select("id", cleaning.math_blocks(F.col("abstract")).alias("text"))


@query
def latex_commands(spark, sf):
    words = cleaning.command_words(F.col("abstract"))
    text = cleaning.drop_scripts(cleaning.drop_style_words(words))
    return raw_documents(spark, sf).select("id", text.alias("text"))


@query
def latex_sci_fix(spark, sf):
    text = cleaning.drop_scripts(cleaning.relation_words(F.col("abstract")))
    return raw_documents(spark, sf).select("id", cleaning.repair_powers(text).alias("text"))


@query
def clean_corpus(spark, sf):
    raw = raw_documents(spark, sf).withColumn("categories", F.expr(fx.CATEGORIES))
    return cleaning.clean_documents(raw)


@query
def stream_clean(spark, sf):
    base = scratch_path(spark, "stream")
    raw = raw_documents(spark, sf).withColumn("categories", F.expr(fx.CATEGORIES))
    raw.write.json(f"{base}/raw")
    stream = clean_stream(spark, f"{base}/raw", f"{base}/clean", f"{base}/checkpoint")
    stream.awaitTermination()
    return read_clean(spark, f"{base}/clean")


@query
def ndjson_quarantine(spark, sf):
    """Every 19th line lacks its end."""
    base = scratch_path(spark, "quarantine")
    end = F.when(F.col("p_partkey") % 19 == 0, "").otherwise("}")
    line = F.concat(F.lit('{"id":"'), F.col("p_partkey").cast("string"), F.lit('"'), end)
    fx.table(spark, sf, "part").select(line.alias("value")).write.text(f"{base}/raw")
    quarantine.split_stream(spark, f"{base}/raw", f"{base}/split", f"{base}/checkpoint", 2).awaitTermination()
    good = quarantine.read_good(spark, f"{base}/split").select("id", F.lit(None).cast("string").alias("line"))
    bad = quarantine.read_malformed(spark, f"{base}/split")
    return good.unionByName(bad.select(F.lit(None).cast("string").alias("id"), "line"))


@query
def run_report(spark, sf):
    """What is noted while the matrix is written."""
    _, rows = tfidf.fit_transform(corpus(spark, sf), "doc_id", "text")
    _, seen = tables.write_observed(
        rows, scratch_path(spark, "observed"), n_docs=F.count("*"), nnz=F.sum(F.size("term_ids")).cast("long"),
        n_empty=F.count(F.when(F.size("term_ids") == 0, True)), null_ids=F.count(F.when(F.col("doc_id").isNull(), True)),
    )
    return spark.createDataFrame(list(seen.items()), "metric string, value long")


@query
def weighted_text(spark, sf):
    raw = raw_documents(spark, sf)
    title, abstract = cleaning.strip(F.col("title")), cleaning.strip(F.col("abstract"))
    return raw.select("id", cleaning.weighted_text(title, abstract).alias("text"))


@query
def doc_year(spark, sf):
    raw = raw_documents(spark, sf)
    return raw.select("id", cleaning.year_of(F.col("update_date")).alias("update_year"))


# ---- text features -----------------------------------------------------------


def corpus(spark, sf):
    return filters.drop_short_texts(fx.corpus(spark, sf))


@query
def doc_filters(spark, sf):
    kept = corpus(spark, sf)
    words = F.size(F.split(cleaning.strip(F.col("text")), cleaning.SPACE + "+"))
    return kept.select("doc_id", "lang", words.alias("n_words"))


@query
def strip_accents(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    plain = docs.select("doc_id", tokens.strip_accents(F.col("text")).alias("text"))
    return plain.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def listed(df: DataFrame, column: str, name: str) -> DataFrame:
    # The outer form keeps Spark from tokenizing again for a derived size filter.
    rows = df.select("doc_id", F.posexplode_outer(column).alias("pos", name))
    return rows.filter(F.col(name).isNotNull())


@query
def tokens_a(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return listed(tfidf.TERMS.tokens(docs, "text"), "tokens", "token")


@query
def tokens_b(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return listed(tfidf.PHRASES.tokens(docs, "text"), "tokens", "token")


@query
def tokens_nostop(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return listed(tfidf.TERMS.kept_tokens(docs, "text"), "tokens", "token")


@query
def ngrams(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return listed(tfidf.TERMS.terms(docs, "text"), "terms", "term")


@query
def term_counts(spark, sf):
    return tfidf.term_counts(corpus(spark, sf), ["doc_id"], "text", tfidf.TERMS)


def vocabulary_of(spark, sf, max_features):
    docs = corpus(spark, sf)
    n_docs = docs.agg(F.count("*")).scalar()
    tallies = tfidf.tallied_counts(docs, "text", tfidf.TERMS)
    vocabulary = tfidf.build_vocabulary(
        tfidf.add_tallies(tallies), n_docs, max_features=max_features
    )
    return vocabulary.withColumn("idf", r6("idf"))


@query
def vocabulary(spark, sf):
    return vocabulary_of(spark, sf, None)


@query
def vocabulary_capped(spark, sf):
    return vocabulary_of(spark, sf, SMALL_VOCABULARY)


def named_weights(rows: DataFrame, model: tfidf.TfidfModel, key: str) -> DataFrame:
    names = model.vocabulary(rows.sparkSession).select("term_id", "term")
    return tfidf.entries(rows, key).join(names, "term_id").select(key, "term", r6("weight").alias("weight"))


@query
def tfidf_weights(spark, sf):
    model, rows = tfidf.fit_transform(corpus(spark, sf), "doc_id", "text")
    return named_weights(rows, model, "doc_id")


@query
def tfidf_stats(spark, sf):
    model, rows = tfidf.fit_transform(corpus(spark, sf), "doc_id", "text")
    return tfidf.matrix_statistics(rows, model.n_terms)


@query
def tfidf_transform(spark, sf):
    model = tfidf.fit_tfidf(corpus(spark, sf), "doc_id", "text")
    items = fx.table(spark, sf, "benchmark")
    return named_weights(model.transform(items, "item_id", "text"), model, "item_id")


# ---- dimension reduction -----------------------------------------------------


def fitted(spark, sf):
    """Model and written sparse rows of the corpus."""
    model, rows = tfidf.fit_transform(corpus(spark, sf), "doc_id", "text")
    return model, materialize(rows, "tfidf-rows")


@query
def total_variance(spark, sf):
    model, rows = tfidf.fit_transform(corpus(spark, sf), "doc_id", "text")
    return tfidf.total_variance(rows, "doc_id", model.n_docs).select(
        r6("total_variance").alias("total_variance")
    )


def embedding_rows(spark, sf) -> tuple[DataFrame, int]:
    """The given vectors as sparse rows, and their length."""
    vectors = fx.embeddings(spark, sf)
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    rows = vectors.select(
        "vec_id",
        F.sequence(F.lit(0), F.size("embedding") - 1).alias("term_ids"),
        F.col("embedding").alias("weights"),
    )
    return rows, width


def square(spark, matrix: np.ndarray, digits: int) -> DataFrame:
    """(i, j, g) of a small matrix; the sum with zero leaves no negative zero."""
    table = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "i int, g array<double>"
    )
    long = table.select("i", F.posexplode("g").alias("j", "g"))
    return long.withColumn("g", F.round("g", digits) + F.lit(0.0))


@query
def gram_matrix(spark, sf):
    rows, width = embedding_rows(spark, sf)
    return square(spark, svd.gram_times(rows, np.eye(width)), 6)


@query
def svd_full_rank(spark, sf):
    """At full rank the squared singular values add up to the squared entries, and explain all."""
    rows, width = embedding_rows(spark, sf)
    rows = materialize(rows, "embedding-rows")
    factors = svd.truncated_svd(rows, width, width)
    part = svd.component_variance(svd.project(rows, "vec_id", factors.v)).first()[0]
    whole = tfidf.total_variance(rows, "vec_id", rows.count())
    return whole.select(
        F.round(F.lit(float((factors.s**2).sum())), 4).alias("squares"),
        r6(F.lit(part) / F.col("total_variance")).alias("explained_variance"),
    )


@query
def svd_blocks(spark, sf):
    """The same in blocks of sixteen terms."""
    rows, width = embedding_rows(spark, sf)
    rows = materialize(rows, "embedding-rows")
    factors = block_svd.block_svd(rows, "vec_id", width, width, block_terms=16)
    part = svd.component_variance(factors.project(rows, "vec_id")).first()[0]
    whole = tfidf.total_variance(rows, "vec_id", rows.count())
    return whole.select(
        F.round(F.lit(float((factors.s**2).sum())), 4).alias("squares"),
        r6(F.lit(part) / F.col("total_variance")).alias("explained_variance"),
    )


@query
def svd_whiten_gram(spark, sf):
    """Whitened columns are orthonormal, as many as there are by default, or one for four documents."""
    model, rows = fitted(spark, sf)
    wanted = min(svd.N_COMPONENTS, model.n_docs // 4)
    factors = block_svd.decompose(rows, "doc_id", model.n_terms, wanted)
    white = svd.whitened(rows, "doc_id", factors)
    dense = white.select(
        F.sequence(F.lit(0), F.size("embedding") - 1).alias("term_ids"),
        F.col("embedding").alias("weights"),
    )
    return square(spark, svd.gram_times(dense, np.eye(len(factors.s))), 4)


@query
def svd_singular_values(spark, sf):
    model, rows = fitted(spark, sf)
    return block_svd.decompose(rows, "doc_id", model.n_terms, svd.N_COMPONENTS).singular_values(spark)


@query
def svd_whiten(spark, sf):
    model, rows = fitted(spark, sf)
    factors = block_svd.decompose(rows, "doc_id", model.n_terms, svd.N_COMPONENTS)
    return components(svd.whitened(rows, "doc_id", factors), "doc_id", vector="embedding")


@query
def explained_variance(spark, sf):
    model, rows = fitted(spark, sf)
    factors = block_svd.decompose(rows, "doc_id", model.n_terms, svd.N_COMPONENTS)
    part = svd.component_variance(factors.project(rows, "doc_id")).first()[0]
    whole = tfidf.total_variance(rows, "doc_id", model.n_docs)
    return whole.select(
        F.lit(part).alias("component_variance"),
        "total_variance",
        (F.lit(part) / F.col("total_variance")).alias("explained_variance"),
    )


@query
def project_rows(spark, sf):
    model, rows = tfidf.fit_transform(corpus(spark, sf), "doc_id", "text")
    return components(fixed_model(model).project(rows, "doc_id"), "doc_id", vector="embedding")


def fixed_vectors(model: tfidf.TfidfModel) -> np.ndarray:
    """Eight whole-number term vectors that depend on the terms' lengths."""
    table = model.table.orderBy("term_id").select(F.length("term").alias("n")).toArrow()
    lengths = table.column("n").to_numpy()
    return (lengths[:, None] * (np.arange(8) + 1)) % 7 - 3.0


def fixed_model(model: tfidf.TfidfModel) -> block_svd.BlockModel:
    """The same as a table of blocks, of which the driver sees nothing."""
    v = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: (F.length("term") * j % 7 - 3).cast("double"))
    return block_svd.from_factors(model.table.select("term_id", v.alias("v")), np.ones(8), model.n_terms, kind="<f8")


@query
def candidate_embedding(spark, sf):
    model = tfidf.fit_tfidf(corpus(spark, sf), "doc_id", "text")
    names = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("cand_id"), F.col("text").alias("name")
    )
    return components(zero_shot.embed_names(names, model, fixed_model(model)), "cand_id", vector="embedding")


@query
def clean_round_trip(spark, sf):
    path = scratch_path(spark, "clean")
    write_clean(clean_corpus(spark, sf), path)
    return read_clean(spark, path)


@query
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "counts")
    counts = categories.category_counts(fx.corpus(spark, sf))
    tables.write_csv(categories.ordered_counts(counts), path)
    return tables.read_csv(spark, path, CATEGORY_COUNTS)


@query
def model_round_trip(spark, sf):
    path = scratch_path(spark, "model")
    models.save_tfidf(spark, tfidf.fit_tfidf(corpus(spark, sf), "doc_id", "text"), path)
    return models.load_tfidf(spark, path).vocabulary().withColumn("idf", r6("idf"))


@query
def assign_stream(spark, sf):
    """New texts by stored models: the corpus' vocabulary, whole-number factors, one centre per component."""
    base = scratch_path(spark, "assign")
    model = tfidf.fit_tfidf(corpus(spark, sf), "doc_id", "text")
    models.save_tfidf(spark, model, f"{base}/tfidf")
    models.save_svd(spark, svd.SvdModel(fixed_vectors(model), np.ones(8)), f"{base}/svd")
    models.save_kmeans(spark, kmeans.Model(np.eye(8)), f"{base}/kmeans")
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    nothing = {"categories": F.lit(None).cast("string"), "update_year": F.lit(None).cast("int")}
    write_clean(items.withColumns(nothing), f"{base}/clean")
    stored = load_models(spark, base, whiten=False)
    start_assigning(spark, f"{base}/clean", f"{base}/out", f"{base}/checkpoint", stored, 3).awaitTermination()
    return read_assigned(spark, f"{base}/out").select(
        F.col("id").cast("long").alias("item_id"), "cluster", r6("distance").alias("distance")
    )


@query
def attach_cluster(spark, sf):
    """Clusters and years of the documents from two tables in the same buckets."""
    base = scratch_path(spark, "store")
    docs = fx.corpus(spark, sf)
    left = tables.write_bucketed(docs.select("id", "cluster"), f"{base}/clustered", "id", 8)
    right = tables.write_bucketed(docs.select("id", "update_year"), f"{base}/meta", "id", 8)
    return right.join(left.hint("merge"), "id").select("id", "update_year", "cluster")


# ---- clustering --------------------------------------------------------------


@query
def embedding_scan(spark, sf):
    return components(fx.table(spark, sf, "embeddings"), "vec_id", vector="embedding")


@query
def embedding_meta_mismatch(spark, sf):
    left = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    right = fx.table(spark, sf, "documents").select("doc_id")
    return filters.key_mismatch(left, right, "doc_id")


@query
def row_count_mismatch(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return filters.key_mismatch(
        docs, docs.unionByName(fx.table(spark, sf, "labels").select("doc_id")), "doc_id"
    )


@query
def normalized_rows(spark, sf):
    unit = normalize_rows(fx.embeddings(spark, sf), "embedding")
    return components(unit, "vec_id", vector="embedding")


@query
def hash_sample(spark, sf):
    docs = fx.corpus(spark, sf).select("id", "cluster")
    return sampling.hash_sample(docs, "id", SMALL_SAMPLE)


def label_centers(vectors: DataFrame) -> DataFrame:
    return clustering.centroids(vectors, "embedding", "cluster").select("cluster", "center")


@query
def assign_nearest(spark, sf):
    vectors = fx.embeddings(spark, sf)
    near = clustering.assign_nearest(
        vectors.select("vec_id", "embedding"), "embedding", label_centers(vectors)
    )
    return near.select("vec_id", "cluster", r6("distance").alias("distance"))


@query
def kmeans_step(spark, sf):
    vectors = fx.embeddings(spark, sf)
    step = clustering.lloyd_step(
        vectors.select("vec_id", "embedding"), "embedding", label_centers(vectors)
    )
    return components(step, "cluster", "n", vector="center")


def unit_features(spark, sf):
    unit = normalize_rows(fx.embeddings(spark, sf).select("vec_id", "embedding"), "embedding")
    return materialize(unit, "unit-rows")


def fixed_starts(vectors: DataFrame, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size so many centres: the means of the rows with one remainder of the id."""
    found = []
    for k in sizes:
        dealt = vectors.withColumn("cluster", (F.col("vec_id") % k).cast("int"))
        centers = clustering.centroids(dealt, "embedding", "cluster").select("cluster", "center")
        found.append(clustering.collect_centers(centers.orderBy("cluster"))[1])
    return found


def model_rows(spark, models: list[kmeans.Model]) -> DataFrame:
    """(model, cluster, n, cost, component, value)."""
    rows = [
        (i, c, int(m.counts[c]), float(m.cost), [float(x) for x in center])
        for i, m in enumerate(models)
        for c, center in enumerate(m.centers)
    ]
    table = spark.createDataFrame(rows, "model int, cluster int, n long, cost double, center array<double>")
    return components(table.withColumn("cost", r6("cost")), "model", "cluster", "n", "cost", vector="center")


@query
def kmeans_restart_step(spark, sf):
    """Two steps of three models at once, with their costs."""
    vectors = fx.embeddings(spark, sf).select("vec_id", "embedding")
    return model_rows(spark, kmeans.lloyd(vectors, "embedding", fixed_starts(vectors, (3, 5, 7)), max_iter=2))


@query
def kmeans_minibatch_step(spark, sf):
    """Two mini-batches of half the rows each, from the label centres, then costs over all rows."""
    vectors = fx.embeddings(spark, sf)
    model = kmeans.Model(clustering.collect_centers(label_centers(vectors).orderBy("cluster"))[1])
    for number in range(2):
        batch = vectors.filter(kmeans.batch_number("vec_id", 2) == number)
        kmeans.minibatch_step(batch, "embedding", [model])
    return model_rows(spark, kmeans.with_costs(vectors, "embedding", [model]))


@query
def kmeans_choose_k(spark, sf):
    """K chosen by silhouette among models that have gone one step from fixed starts."""
    unit = unit_features(spark, sf)
    starts = fixed_starts(unit, (3, 5, 7))
    models = dict(zip((3, 5, 7), kmeans.lloyd(unit, "embedding", starts, max_iter=1)))
    sweep = clustering.choose_k(unit, "embedding", models)
    return sweep.frame(spark).withColumn("silhouette", r6("silhouette"))


@query
def kmeans_cheapest(spark, sf):
    """Clusters of the rows by the cheapest of three models after two steps."""
    vectors = fx.embeddings(spark, sf).select("vec_id", "embedding")
    models = kmeans.lloyd(vectors, "embedding", fixed_starts(vectors, (3, 5, 7)), max_iter=2)
    best = min(models, key=lambda model: model.cost)
    return kmeans.assign(vectors, "embedding", best).select("vec_id", "cluster")


@query
def kmeans_scout(spark, sf):
    unit = unit_features(spark, sf)
    return clustering.scout_k(unit, "vec_id", grid=K_GRID).frame(spark)


@query
def kmeans_sweep(spark, sf):
    return clustering.sweep_k(unit_features(spark, sf), "vec_id", grid=K_GRID).frame(spark)


@query
def kmeans_final(spark, sf):
    unit = unit_features(spark, sf)
    model, _ = kmeans.best_restart(unit, "vec_id", "embedding", 10)
    return kmeans.assign(unit, "embedding", model).select("vec_id", "cluster")


@query
def silhouette_by_label(spark, sf):
    scored = clustering.silhouettes(fx.embeddings(spark, sf), "embedding", "cluster")
    return scored.groupBy("cluster").agg(
        F.count("*").alias("n"), r6(F.avg("silhouette")).alias("silhouette")
    )


@query
def silhouette_score(spark, sf):
    """Every fifth row is a zero row."""
    zero = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(x))
    rows = fx.embeddings(spark, sf).withColumn("embedding", zero)
    score = clustering.silhouette_score(rows, "embedding", "cluster")
    return spark.range(1).select(r6(F.lit(score)).alias("silhouette"))


@query
def cluster_sizes(spark, sf):
    return clustering.cluster_sizes(fx.corpus(spark, sf))


def fixed_factors(vocabulary: DataFrame, width: int = 64) -> DataFrame:
    """Whole-number factors computed from each term's length and counts."""
    v = F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda j: (
            (F.length("term") * j + F.col("df") * (j % 5) + F.col("cf") * (j % 3)) % 11 - 5
        ).cast("double"),
    )
    return vocabulary.select("term_id", v.alias("v"))


def top_terms_of(spark, sf):
    vocabulary = tfidf.fit_tfidf(corpus(spark, sf), "doc_id", "text").vocabulary(spark)
    centers = zero_shot.unit_centroids(fx.embeddings(spark, sf), "embedding", "cluster")
    weights = clustering.term_weights(fixed_factors(vocabulary), centers)
    return clustering.top_terms(weights, vocabulary)


@query
def cluster_top_terms(spark, sf):
    return top_terms_of(spark, sf)


@query
def term_legend(spark, sf):
    label = labels.legend_label(F.col("cluster"), F.col("top_terms"))
    return top_terms_of(spark, sf).select("cluster", label.alias("label"))


# ---- labels ------------------------------------------------------------------


@query
def cluster_centroids(spark, sf):
    centers = zero_shot.unit_centroids(fx.embeddings(spark, sf), "embedding", "cluster")
    return components(centers, "cluster", "n", vector="center")


def similarities(spark, sf):
    centers = zero_shot.unit_centroids(fx.embeddings(spark, sf), "embedding", "cluster")
    return zero_shot.similarity(centers, fx.candidates(spark, sf))


@query
def centroid_similarity(spark, sf):
    return similarities(spark, sf).select("cluster", "cand_id", r6("similarity").alias("similarity"))


@query
def zero_shot_labels(spark, sf):
    names = fx.candidates(spark, sf).select("cand_id", "name")
    return zero_shot.zero_shot_labels(similarities(spark, sf), names)


def text_and_lookup(spark, sf):
    docs = fx.corpus(spark, sf)
    return docs.select("id", "text"), phrases.cluster_lookup(docs, "doc_id")


@query
def phrase_input(spark, sf):
    texts, lookup = text_and_lookup(spark, sf)
    taken = phrases.sampled_texts(phrases.long_texts(texts), lookup, None)
    cut = labels.first_chars(F.col("text"), 50_000)
    return taken.select(
        "id", "cluster", F.length("text").alias("n_chars"), F.length(cut).alias("n_chars_cut")
    )


@query
def reservoir_per_cluster(spark, sf):
    texts, lookup = text_and_lookup(spark, sf)
    chosen = phrases.phrase_candidates(phrases.long_texts(texts), lookup)
    chosen = materialize(chosen, "phrase-candidates")
    return sampling.hash_sample_per_group(chosen, "cluster", "key", SMALL_RESERVOIR).drop("key")


@query
def dedup_per_cluster(spark, sf):
    return phrases.drop_copies(fx.corpus(spark, sf)).select("id", "cluster")


@query
def copies_dropped(spark, sf):
    return phrases.copies_dropped(fx.corpus(spark, sf))


@query
def cluster_phrases(spark, sf):
    docs = fx.corpus(spark, sf)
    return phrases.cluster_phrases(docs, docs, order="doc_id")


@query
def cluster_phrases_shared_ids(spark, sf):
    """Four texts share an id, some have none."""
    shared = F.concat(F.lit("s"), F.floor(F.col("doc_id") / 4).cast("string"))
    docs = fx.corpus(spark, sf).withColumn("id", F.when(F.col("doc_id") % 29 != 0, shared))
    return phrases.cluster_phrases(docs, docs, order="doc_id")


@query
def extract_codes(spark, sf):
    coded = categories.with_codes(fx.corpus(spark, sf))
    return coded.select(
        "id", F.array_join("codes", "|").alias("codes"), F.size("codes").alias("n_codes")
    )


@query
def category_counts(spark, sf):
    return categories.ordered_counts(categories.category_counts(fx.corpus(spark, sf)))


@query
def category_top_codes(spark, sf):
    counts = categories.category_counts(fx.corpus(spark, sf))
    return categories.top_codes(counts).select("cluster", "place", "codes", "n", "share")


@query
def category_labels(spark, sf):
    return categories.labels_from_categories(fx.corpus(spark, sf)).orderBy("cluster")


@query
def label_join(spark, sf):
    docs = fx.corpus(spark, sf).select("id", "cluster", "update_year", "categories")
    names = materialize(categories.labels_from_categories(docs), "labels")
    labelled = categories.join_labels(categories.with_codes(docs), names, "label_auto", "label_alt")
    return labelled.select(
        "id",
        "cluster",
        "update_year",
        F.array_join("codes", "|").alias("codes"),
        "label_auto",
        "label_alt",
    )


# ---- trends ------------------------------------------------------------------


@query
def yearly_share(spark, sf):
    return trends.yearly_share(fx.corpus(spark, sf))


@query
def yearly_share_wide(spark, sf):
    share = trends.yearly_share(fx.corpus(spark, sf))
    return trends.share_table(share, list(range(12)))


@query
def yearly_share_dense(spark, sf):
    return trends.share_grid(trends.yearly_share(fx.corpus(spark, sf)))


@query
def wide_to_long_share(spark, sf):
    wide = yearly_share_wide(spark, sf).withColumn("update_year.1", F.col("update_year"))
    return trends.unpivot_shares(wide.withColumn("remark", F.lit("total")))


def ranked(spark, sf, mode, top):
    series = trends.share_series(trends.yearly_share(fx.corpus(spark, sf)))
    return trends.rank_topics(series, mode, top)


@query
def top_clusters_total(spark, sf):
    return ranked(spark, sf, "total", trends.TOP_BY_TOTAL).drop("series")


@query
def top_topics_overall(spark, sf):
    return ranked(spark, sf, "overall", trends.TOP_TOPICS).drop("series")


@query
def top_topics_last(spark, sf):
    return ranked(spark, sf, "last", trends.TOP_TOPICS).drop("series")


@query
def top_topics_last3(spark, sf):
    best = ranked(spark, sf, "last3", trends.TOP_TOPICS)
    names = categories.labels_from_categories(fx.corpus(spark, sf))
    return trends.with_labels(best, names).select("rank", "cluster", "label", "score")


@query
def top_topics_series(spark, sf):
    best = ranked(spark, sf, "last3", trends.TOP_TOPICS)
    return trends.chart_series(best, categories.labels_from_categories(fx.corpus(spark, sf)))


# ---- topic map ---------------------------------------------------------------


@query
def map_legend(spark, sf):
    docs = fx.corpus(spark, sf).select("id", "cluster", "categories")
    names = categories.labels_from_categories(docs)
    sample = sampling.hash_sample(docs, "id", topic_map.SAMPLE_ROWS)
    return topic_map.largest_clusters(sample, names)


@query
def knn_cosine(spark, sf):
    near = topic_map.nearest_neighbors(fx.embeddings(spark, sf), "vec_id", "embedding")
    return near.select(
        F.col("id").alias("vec_id"), "neighbor", r6("distance").alias("distance"), "place"
    )


@query
def knn_cosine_cells(spark, sf):
    """The label centres are the cells."""
    vectors = fx.embeddings(spark, sf)
    near = cells.nearest_in_cells(vectors, "vec_id", "embedding", label_centers(vectors))
    return near.select(
        F.col("id").alias("vec_id"), "neighbor", r6("distance").alias("distance"), "place"
    )


@query
def knn_cell_recall(spark, sf):
    """How many of the cells hold which share of the true neighbours of all rows."""
    vectors = fx.embeddings(spark, sf)
    recalls = cells.recall_by_probes(
        vectors, "vec_id", "embedding", label_centers(vectors), rows=vectors.count()
    )
    return recalls.select("probes", r6("recall").alias("recall"))


@query
def knn_fuzzy_graph(spark, sf):
    near = topic_map.nearest_neighbors(fx.embeddings(spark, sf), "vec_id", "embedding")
    return topic_map.fuzzy_graph(near).withColumn("weight", r6("weight"))


def fixed_layout(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Edges to the five ids after each, both ways, and places from the first two components."""
    vectors = fx.embeddings(spark, sf)
    places = vectors.select(
        F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)) * 20).alias("x"), (F.get("embedding", F.lit(1)) * 20).alias("y")
    )
    after = places.select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("step"))
    forth = after.select("src", (F.col("src") + F.col("step")).alias("dst"), (1.0 / F.col("step")).alias("weight"))
    forth = forth.join(places.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")
    back = forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return forth.unionByName(back), materialize(places, "fixed-layout")


@query
def layout_step(spark, sf):
    edges, places = fixed_layout(spark, sf)
    moved = layout.layout_step(edges, places, 0.5, 1.75, 0.84, depth=3)
    return moved.select(F.col("id").alias("vec_id"), r6("x").alias("x"), r6("y").alias("y"))


@query
def layout_stretch(spark, sf):
    edges, places = fixed_layout(spark, sf)
    return layout.stretch(edges, places).select(r6("stretch").alias("stretch"))


@query
def topic_map_table(spark, sf):
    """What the map says about each row, and whether the row has a place."""
    docs = fx.embeddings(spark, sf)
    names = docs.select("cluster").distinct().filter("cluster % 2 = 0")
    names = names.select("cluster", F.concat(F.lit("topic "), F.col("cluster").cast("string")).alias("label_auto"))
    table = topic_map.topic_map(docs, "vec_id", "embedding", names, k=8)
    inside = (F.abs("x") < 100.0) & (F.abs("y") < 100.0)
    return table.select("vec_id", "cluster", "label", "color", F.coalesce(inside, F.lit(False)).alias("placed"))


@query
def topic_map_refined(spark, sf):
    return topic_map.topic_map(fx.embeddings(spark, sf), "vec_id", "embedding", steps=10)


@query
def topic_map_2d(spark, sf):
    return topic_map.topic_map(fx.embeddings(spark, sf), "vec_id", "embedding")


# Names that would hide a function used above.
for shown, function in [
    ("tokens", "tokens_a"),
    ("tfidf", "tfidf_weights"),
    ("normalize_rows", "normalized_rows"),
]:
    QUERIES[shown] = QUERIES.pop(function)
