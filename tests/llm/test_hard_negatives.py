import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from trendloom.llm.cover_tree import Best, CoverTree, best_first, inner_products
from trendloom.llm.hard_negatives import hard_negatives, whole_numbers

SHAPES = {
    "scattered": lambda d: d.integers(-50, 50, (300, 6)),
    "clustered": lambda d: d.integers(-900, 900, (8, 5))[d.integers(0, 8, 300)] + d.integers(-4, 5, (300, 5)),
    "equal": lambda d: np.tile(d.integers(-9, 9, (1, 4)), (200, 1)),
    "mostly equal": lambda d: np.r_[np.tile([[3, -1]], (150, 1)), d.integers(-9, 9, (50, 2))],
    "zeros": lambda d: np.zeros((40, 3), np.int64),
    "one": lambda d: d.integers(-9, 9, (1, 4)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_tree_is_a_cover_tree(shape):
    """Balls cover the rows below them, and each row is in one leaf."""
    rows = SHAPES[shape](np.random.default_rng(1)).astype(np.int64)
    tree = CoverTree(rows, 4)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    queries = np.random.default_rng(2).integers(-60, 60, (20, rows.shape[1]))
    least, most = tree.bounds(queries)
    scores = inner_products(queries, rows)

    def below(node):
        if node >= tree.leaves_from:
            leaf = node - tree.leaves_from
            return tree.order[tree.starts[leaf] : tree.ends[leaf]].tolist()
        return [row for child in tree.children[node] for row in below(child)]

    assert sorted(below(0)) == list(range(len(rows)))
    for node in range(len(tree.centre)):
        inside = scores[:, below(node)]
        assert (least[:, [node]] <= inside).all() and (inside <= most[:, [node]]).all()


@pytest.mark.parametrize("shape", SHAPES)
def test_search_equals_looking_at_all_rows(shape):
    draw = np.random.default_rng(3)
    rows = SHAPES[shape](draw).astype(np.int64)
    tree = CoverTree(rows, 4)
    usable = draw.random(len(rows)) < 0.7
    for query in draw.integers(-60, 60, (30, rows.shape[1])):
        scores = rows @ query
        edges = np.quantile(scores, [0.1, 0.5, 0.9]).astype(int).tolist()
        limits = [(None, None), (edges[0], edges[1]), (edges[1], edges[2])]
        windows = [Best(low, high, 7) for low, high in limits]
        least, most = tree.bounds(query[None, :])
        best_first(tree, query, least[0], most[0], usable[tree.order], windows)
        for window, (low, high) in zip(windows, limits):
            fit = [i for i in np.flatnonzero(usable).tolist() if (low is None or scores[i] >= low) and (high is None or scores[i] <= high)]
            wanted = sorted(((int(scores[i]), i) for i in fit), key=lambda x: (-x[0], x[1]))[:7]
            assert window.found() == wanted


def test_tree_skips_rows_of_far_balls():
    draw = np.random.default_rng(5)
    rows = draw.integers(-9000, 9000, (40, 8))[draw.integers(0, 40, 4000)] + draw.integers(-5, 6, (4000, 8))
    tree = CoverTree(rows)
    looked = []
    for query in rows[:20]:
        least, most = tree.bounds(query[None, :])
        looked.append(best_first(tree, query, least[0], most[0], np.ones(4000, bool), [Best(None, None, 5)]))
    assert np.mean(looked) < 1000


def test_products_stay_exact():
    big = np.array([[1 << 30, 3]])
    assert inner_products(big, big)[0, 0] == (1 << 60) + 9
    with pytest.raises(ArithmeticError):
        inner_products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def brute(rows, positives=5, negatives=10):
    """Rows (id, label, vector); those with an id divisible by 4 are anchors."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    width = max((len(r[2]) for r in rows), default=0)
    vectors = [tuple(r[2]) + (0,) * (width - len(r[2])) for r in rows]
    order = lambda i, s: (-s[i], rows[i][0] is None, rows[i][0] or 0)
    found = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor is None or anchor % 4:
            continue
        s = [sum(x * y for x, y in zip(vectors[a], v)) for v in vectors]
        near = sorted((i for i in range(len(rows)) if i != a and rows[i][1] == label), key=lambda i: order(i, s))
        for p in near[:positives]:
            fit = [i for i in range(len(rows)) if rows[i][1] != label and 30 * s[p] <= 100 * s[i] <= 90 * s[p]]
            for rank, i in enumerate(sorted(fit, key=lambda i: order(i, s))[:negatives], 1):
                found.append((anchor, rows[p][0], rank, rows[i][0], s[p], s[i]))
    return sorted(found, key=repr)


def check(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, "id long, label int, vector array<bigint>")
    found = hard_negatives(frame, F.col("id") % 4 == 0, **sizes)
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute(rows)


def test_against_brute_force_with_hot_label_repeats_and_nulls(spark):
    draw = random.Random(1)
    rows = []
    for i in range(300):
        vector = [draw.randint(-3, 9) for _ in range(draw.choice([4, 4, 3, 0]))]
        rows.append((draw.choice([i, i, draw.randrange(40), None]), draw.choice([1, 1, 1, 2, 3, None]), vector))
    rows += [(400 + i, 1, [5, 5, 5, 5]) for i in range(100)] + [(4, 1, [1, 1, 1, 1]), (4, 2, None), (None, None, None)]
    check(spark, rows, shard_rows=64)


def test_one_label_only_and_empty(spark):
    check(spark, [(i, 1, [1, i]) for i in range(20)])
    check(spark, [])
    check(spark, [(0, 1, [2])])


def test_other_id_types_and_extra_columns(spark):
    rows = [(f"v{i:02}", "a" if i % 2 else "b", [i % 5, 3], i) for i in range(30)]
    frame = spark.createDataFrame(rows, "id string, label string, vector array<bigint>, row int").withColumn("score", F.lit(1))
    found = hard_negatives(frame, F.col("id") == "v04").collect()
    assert {r.anchor_id for r in found} == {"v04"}
    assert all(30 * r.positive_score <= 100 * r.negative_score <= 90 * r.positive_score for r in found)
    assert [r.negative_id for r in sorted(found, key=lambda r: (-r.positive_score, r.positive_id, r.rank))][:3] == ["v03", "v13", "v23"]


def test_whole_numbers(spark):
    rows = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],)], "x array<float>")
    assert [r[0] for r in rows.select(whole_numbers("x")).collect()] == [[128, -1], None, None, None, None, []]
