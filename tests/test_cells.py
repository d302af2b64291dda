import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import cells, topic_map
from trendloom.plans import fixtures as fx


def listed(near):
    found = {}
    for row in near.orderBy("id", "place").collect():
        found.setdefault(row.id, []).append((row.neighbor, round(row.distance, 6)))
    return found


@pytest.fixture(scope="module")
def grouped(spark):
    """Twelve tight groups, one of which has a third of all rows."""
    draw = np.random.default_rng(4)
    middles = draw.normal(0, 1, (12, 8))
    group = np.r_[np.zeros(200, int), draw.integers(1, 12, 400)]
    points = middles[group] + draw.normal(0, 0.05, (600, 8))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").persist()


@pytest.fixture(scope="module")
def exact(grouped):
    return listed(topic_map.nearest_neighbors(grouped, "id", "embedding", 10))


def test_all_cells_give_the_exact_neighbours(spark, grouped, exact):
    centers = cells.cell_centers(grouped, "id", "embedding", 6)
    for part_rows in (17, 1000):
        near = cells.nearest_in_cells(grouped, "id", "embedding", centers, 10, 6, part_rows)
        assert listed(near) == exact


def test_recall_is_what_it_says(grouped, exact):
    centers = cells.cell_centers(grouped, "id", "embedding", 9)
    recalls = {r.probes: r.recall for r in cells.recall_by_probes(grouped, "id", "embedding", centers, 10, 600).collect()}
    assert sorted(recalls) == list(range(1, centers.count() + 1)) and recalls[max(recalls)] == 1.0
    for probes in (1, 2, 4):
        near = listed(cells.nearest_in_cells(grouped, "id", "embedding", centers, 10, probes))
        met = sum(len({n for n, _ in exact[i]} & {n for n, _ in near.get(i, [])}) for i in exact)
        assert met / 6000 == pytest.approx(recalls[probes])


def test_chosen_probes_reach_the_recall(grouped, exact, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 64)
    near = listed(cells.neighbors_by_cells(grouped, "id", "embedding", 10, recall=0.9))
    met = sum(len({n for n, _ in exact[i]} & {n for n, _ in near.get(i, [])}) for i in exact)
    assert met / 6000 >= 0.88


def test_a_hot_cell_is_split(spark):
    """Equal rows are all in one cell; every task holds a part of it."""
    frame = spark.range(300).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.4, 0.8])], "cluster int, center array<double>")
    near = listed(cells.nearest_in_cells(frame, "id", "embedding", centers, 3, 2, 20))
    assert near == {i: [(j, 0.0) for j in range(4) if j != i][:3] for i in range(300)}


def test_fewer_rows_than_neighbours_and_empty_cells(spark):
    frame = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    centers = spark.createDataFrame([(3, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [-1.0, 0.0])], "cluster int, center array<double>")
    assert listed(cells.nearest_in_cells(frame, "id", "embedding", centers, 5, 1)) == {}
    assert listed(cells.nearest_in_cells(frame, "id", "embedding", centers, 5, 2)) == {"a": [("b", 1.0)], "b": [("a", 1.0)]}
    assert cells.nearest_in_cells(frame.limit(0), "id", "embedding", centers, 5).count() == 0


def test_map_uses_cells_beyond_the_exact_bound(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(topic_map, "EXACT_ROWS", 100)
    docs = fx.embeddings(spark, sf_dir)
    placed = topic_map.topic_map(docs, "vec_id", "embedding", k=8).collect()
    assert len(placed) == docs.count() and all(r.x is not None for r in placed)


def test_rows_that_pass_blocks_in_shares(grouped, exact, monkeypatch):
    """Blocks, shares and chunks smaller than the groups of near rows."""
    for name, value in (("PASSING_ROWS", 90), ("CHUNK_ROWS", 32), ("SLICE_ROWS", 50)):
        monkeypatch.setattr(cells, name, value)
    assert listed(topic_map.nearest_neighbors(grouped, "id", "embedding", 10, block_rows=128)) == exact


def test_equal_rows_go_by_id_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK_ROWS", 16)
    frame = spark.range(300).select(F.format_string("%04d", "id").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("e"))
    near = listed(topic_map.nearest_neighbors(frame, "id", "e", 3, block_rows=40))
    ids = [f"{i:04d}" for i in range(300)]
    assert near == {i: [(j, 0.0) for j in ids[:4] if j != i][:3] for i in ids}


def test_many_asking_rows_do_not_pass_the_driver(grouped, monkeypatch):
    """Asking rows beyond a bounded number are held in blocks instead of being sent to every task."""
    sent = []
    monkeypatch.setattr(cells, "SENT_ROWS", 100, raising=False)
    real = cells._nearest_of
    monkeypatch.setattr(cells, "_nearest_of", lambda *args: sent.append(1) or real(*args))
    centers = cells.cell_centers(grouped, "id", "embedding", 9)
    few = cells.recall_by_probes(grouped, "id", "embedding", centers, 10, 80).count()
    assert few and sent == [1]
    assert cells.recall_by_probes(grouped, "id", "embedding", centers, 10, 600).count() == few and sent == [1]


def test_a_block_passes_on_k_rows_for_each_row(grouped):
    """However many rows go by."""
    unit = grouped.select("id", F.col("embedding").alias("v"))
    assert cells.nearest_of_all(unit, unit, 5, 100).count() == 600 * 5


def test_map_of_all_rows_has_exact_neighbours_however_many_there_are(spark, grouped, monkeypatch):
    """Neither a sample nor a change to cells where there are many rows."""

    def refused(*args, **settings):
        raise AssertionError("neighbours from cells")

    monkeypatch.setattr(topic_map, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(topic_map, "EXACT_ROWS", 100)
    docs = grouped.withColumn("cluster", (F.col("id") % 3).cast("int"))
    few = topic_map.topic_map(docs, "id", "embedding", sample_rows=150, k=8, exact_rows=100)
    assert few.count() == 150
    monkeypatch.setattr(cells, "neighbors_by_cells", refused)
    assert topic_map.topic_map(docs, "id", "embedding", k=8).count() == 600
