import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.operators import clustering, svd, tfidf, topic_map, zero_shot
from trendloom.plans import fixtures as fx


@pytest.fixture(scope="module")
def unit(spark, sf_dir):
    frame = vectors.normalize_rows(fx.embeddings(spark, sf_dir), "embedding")
    return clustering.as_features(frame).persist()


def matrix(frame, *keys):
    rows = frame.orderBy(*keys).collect()
    return rows, np.array([row.embedding for row in rows])


def test_zero_rows_stay_zero(spark):
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [row.v for row in vectors.normalize_rows(frame, "v").collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_silhouette_equals_spark_evaluator(unit):
    scored = clustering.silhouettes(unit, "embedding", "cluster")
    own = scored.agg(F.avg("silhouette")).first()[0]
    evaluator = ClusteringEvaluator(
        predictionCol="cluster", featuresCol="features", distanceMeasure="cosine"
    )
    assert own == pytest.approx(evaluator.evaluate(unit), abs=1e-9)
    assert scored.filter("silhouette < -1 or silhouette > 1").count() == 0


def test_silhouette_of_single_rows_is_zero(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], 0), ([0.9, 0.1], 0), ([0.0, 1.0], 7)], "embedding array<double>, c int"
    )
    rows = clustering.silhouettes(frame, "embedding", "c").collect()
    assert [row.silhouette for row in rows if row.c == 7] == [0.0]
    with pytest.raises(ValueError):
        clustering.silhouettes(frame.filter("c = 0"), "embedding", "c")


def test_lloyd_steps_never_cost_more(spark, unit):
    centers = unit.filter("vec_id % 50 = 0").select(
        (F.col("vec_id") / 50).cast("int").alias("cluster"), F.col("embedding").alias("center")
    )
    costs = []
    for _ in range(4):
        near = clustering.assign_nearest(unit.select("vec_id", "embedding"), "embedding", centers)
        costs.append(near.agg(F.sum("distance")).first()[0])
        step = clustering.lloyd_step(unit.select("embedding"), "embedding", centers)
        centers = step.select("cluster", "center")
    assert costs == sorted(costs, reverse=True)


def test_matrix_in_parts_gives_the_same(unit, monkeypatch):
    rows, data = matrix(unit, "vec_id")
    keys, centers = np.arange(9, dtype=np.int32)[::-1], data[:9]
    def near():
        found = unit.select("vec_id", vectors.nearest_row(F.col("embedding"), keys, centers).alias("n"))
        return [row.n.key for row in found.orderBy("vec_id").collect()]
    def dots():
        found = unit.select("vec_id", vectors.products(F.col("embedding"), centers).alias("p"))
        return np.array([row.p for row in found.orderBy("vec_id").collect()])
    whole, products = near(), dots()
    monkeypatch.setattr(vectors, "PART_BYTES", 8 * 64 * 2)
    assert near() == whole and np.allclose(dots(), products)
    distance = ((data[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert whole == list(keys[distance.argmin(axis=1)])
    assert np.allclose(products, data @ centers.T)


def test_sweep_keeps_the_first_best(spark, unit):
    sweep = clustering.sweep_k(unit, "vec_id", grid=(3, 6), max_iter=10)
    scores = dict(sweep.scores)
    assert sweep.k == max(scores, key=scores.get) == sweep.model.k
    assert [row.chosen for row in sweep.frame(spark).orderBy("k").collect()].count(True) == 1


def test_candidates_live_in_document_space(spark):
    docs = spark.createDataFrame(
        [(str(i), "graph theory graph") for i in range(6)]
        + [(str(i), "string theory string") for i in range(6, 12)],
        "id string, text string",
    )
    model = tfidf.fit_tfidf(docs, "id", "text", max_df=0.9)
    rows = model.transform(docs, "id", "text")
    factors = svd.truncated_svd(rows, model.n_terms, 2)
    names = zero_shot.candidate_names(spark, ["graph theory", "string theory", "unknown words"])
    embedded = zero_shot.embed_names(names, model, factors)
    placed = svd.whitened(rows, "id", factors).withColumn(
        "cluster", (F.col("id").cast("int") >= 6).cast("int")
    )
    centers = zero_shot.unit_centroids(placed, "embedding", "cluster")
    labels = zero_shot.zero_shot_labels(zero_shot.similarity(centers, embedded), names)
    got = {row.cluster: row.label_auto for row in labels.collect()}
    assert got == {0: "graph theory", 1: "string theory"}


def test_neighbors_do_not_depend_on_blocks(unit):
    rows, data = matrix(unit, "vec_id")
    near = topic_map.nearest_neighbors(unit, "vec_id", "embedding", 5, block_rows=100)
    got = {}
    for row in near.orderBy("id", "place").collect():
        got.setdefault(row.id, []).append(row.neighbor)
    distance = np.round(1 - data @ data.T, 9)
    np.fill_diagonal(distance, np.inf)
    want = np.argsort(distance, axis=1, kind="stable")[:, :5]
    assert got == {row.vec_id: [rows[j].vec_id for j in want[i]] for i, row in enumerate(rows)}


def test_fewer_rows_than_neighbors(spark):
    frame = spark.createDataFrame(
        [(i, [float(i), 1.0]) for i in range(4)], "id int, embedding array<double>"
    )
    near = topic_map.nearest_neighbors(frame, "id", "embedding", 30)
    assert near.count() == 12
    graph = topic_map.fuzzy_graph(near, 30)
    assert graph.filter("weight <= 0 or weight > 1").count() == 0


def test_fuzzy_graph_is_symmetric_and_rows_sum_to_log_k(unit):
    near = topic_map.nearest_neighbors(unit, "vec_id", "embedding", 10)
    edges = {(r.src, r.dst): r.weight for r in topic_map.fuzzy_graph(near, 10).collect()}
    assert all(0 < w <= 1 for w in edges.values())
    assert all(edges[(b, a)] == pytest.approx(w) for (a, b), w in edges.items())
    distances = np.sort(np.random.default_rng(1).random((50, 10)), axis=1)
    sums = topic_map._memberships(distances, np.log2(10)).sum(axis=1)
    assert np.allclose(sums, np.log2(10), atol=1e-6)


def test_dense_index(spark):
    frame = spark.range(0, 3000, 3)
    rows = topic_map.dense_index(frame, "id").collect()
    assert sorted(row["index"] for row in rows) == list(range(1000))


def test_layout_is_finite_reproducible_and_splits_groups(spark):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(0, 0.1, (40, 3)) + center for center in np.eye(3) * 3])
    rows = [(i, [float(x) for x in p], i // 40) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id int, embedding array<double>, cluster int")
    first = topic_map.topic_map(frame, "id", "embedding", k=8).orderBy("id").collect()
    again = topic_map.topic_map(frame.repartition(5), "id", "embedding", k=8).orderBy("id").collect()
    xy = np.array([(r.x, r.y) for r in first])
    assert np.isfinite(xy).all()
    assert np.allclose(np.abs(xy), np.abs([(r.x, r.y) for r in again]), atol=1e-4)
    means = np.array([xy[40 * g : 40 * g + 40].mean(axis=0) for g in range(3)])
    assert min(np.linalg.norm(means[a] - means[b]) for a, b in ((0, 1), (0, 2), (1, 2))) > 1
    assert [r.color for r in first] == [r.cluster for r in first]
