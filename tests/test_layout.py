import numpy as np
import pytest

from trendloom.operators import layout, topic_map
from trendloom.session import materialize


def test_curve():
    a, b = layout.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.005))
    assert layout.curve(0.05)[0] > a


def all_pushes(xy, a, b):
    gap = xy[:, None, :] - xy[None]
    square = (gap**2).sum(axis=2)
    strength = 2 * b / ((layout.EPSILON + square) * (1 + a * square**b))
    np.fill_diagonal(strength, 0.0)
    return (strength[:, :, None] * gap).sum(axis=1)


def places_of(spark, xy):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return materialize(spark.createDataFrame(rows, "id int, x double, y double"), "test-places")


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_cells_come_near_all_pairs(spark, depth):
    xy = np.random.default_rng(2).normal(0, 5, (400, 2))
    low_x, low_y, side = layout._extent(places_of(spark, xy))
    levels = layout.cell_sums(places_of(spark, xy), low_x, low_y, side, depth)
    assert [len(x) for x in levels] == [1 << i for i in range(depth + 1)]
    assert all(np.allclose(x.sum(axis=(0, 1)), [400, *xy.sum(axis=0)]) for x in levels)
    got = layout._pushes(xy, levels, np.array([low_x, low_y]), side, 1.6, 0.9)
    want = all_pushes(xy, 1.6, 0.9)
    error = np.linalg.norm(got - want, axis=1) / np.linalg.norm(want, axis=1)
    # Near neighbours repel most, so only small cells come near.
    assert depth < 6 or np.median(error) < 0.05


def test_every_other_row_counts_once(spark):
    """Rows in the middles of the cells: cells are then as good as rows."""
    grid = np.array([(i + 0.5, j + 0.5) for i in range(8) for j in range(8)])
    levels = layout.cell_sums(places_of(spark, grid), 0.0, 0.0, 8.0, 3)
    got = layout._pushes(grid, levels, np.zeros(2), 8.0, 1.0, 1.0)
    want = all_pushes(grid, 1.0, 1.0)
    assert np.abs(got - want).max() < 0.1 * np.abs(want).max()


def test_steps_bring_neighbours_together(spark):
    draw = np.random.default_rng(0)
    points = np.vstack([draw.normal(0, 0.1, (40, 3)) + center for center in np.eye(3) * 3])
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    graph = materialize(topic_map.fuzzy_graph(topic_map.nearest_neighbors(frame, "id", "v", 8), 8), "test-graph")
    start = places_of(spark, draw.normal(0, 4, (120, 2)))
    before = layout.stretch(graph, start).first()[0]
    after = layout.refine(graph, start, 40)
    assert layout.stretch(graph, after).first()[0] < 0.5 * before
    xy = np.array([(r.x, r.y) for r in after.orderBy("id").collect()])
    assert np.isfinite(xy).all() and len(xy) == 120


def test_one_row_and_equal_places(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src int, dst int, weight double")
    for n in (1, 3):
        moved = layout.layout_step(edges, places_of(spark, np.ones((n, 2))), 1.0, 1.6, 0.9).collect()
        assert [(r.x, r.y) for r in moved] == [(1.0, 1.0)] * n
