import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import clustering, kmeans
from trendloom.sources import models


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(8)
    return np.vstack([draw.normal(0, 0.4, (60, 3)) + middle for middle in draw.normal(0, 2, (5, 3))])


@pytest.fixture(scope="module")
def rows(spark, points):
    data = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "id long, v array<double>").repartition(4).persist()


def nearest(points, centers):
    distance = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2)
    return distance.argmin(axis=1), distance.min(axis=1).sum()


def test_one_scan_serves_all_models(rows, points, monkeypatch):
    starts = [points[:3], points[::50], points[7:8]]
    whole = kmeans.scan(rows, "v", starts)
    monkeypatch.setattr(kmeans, "SLICE_ROWS", 7)
    monkeypatch.setattr(kmeans, "MODEL_BYTES", 100)
    assert [len(g) for g in kmeans._groups(starts)] == [1, 1, 1]
    for start, a, b in zip(starts, whole, kmeans.scan(rows, "v", starts)):
        own, cost = nearest(points, start)
        assert a.counts.tolist() == b.counts.tolist() == np.bincount(own, minlength=len(start)).tolist()
        sums = np.array([points[own == i].sum(axis=0) for i in range(len(start))])
        assert np.allclose(a.sums, sums) and np.allclose(b.sums, sums)
        assert a.cost == pytest.approx(cost) and b.cost == pytest.approx(cost)


def test_lloyd_equals_plain_steps_and_converged_models_leave(rows, points, monkeypatch):
    seen, real = [], kmeans.scan

    def noted(unit, vector, centers):
        seen.append(len(centers))
        return real(unit, vector, centers)

    monkeypatch.setattr(kmeans, "scan", noted)
    starts = [points[[0, 60, 120, 180, 240]], points[[0, 1, 2, 3, 4, 5]], points[:1]]
    fitted = kmeans.lloyd(rows, "v", starts, max_iter=40)
    for start, model in zip(starts, fitted):
        centers = start.copy()
        for _ in range(model.steps):
            own, _ = nearest(points, centers)
            centers = np.array([points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centers)])
        assert np.allclose(model.centers, centers)
        assert model.cost == pytest.approx(nearest(points, centers)[1])
    # A scan per step of the longest run, and one for the costs.
    assert len(seen) == max(m.steps for m in fitted) + 1
    assert seen[:-1] == sorted(seen[:-1], reverse=True) and seen[0] == 3 and seen[-2] < 3


def test_restarts_cost_one_scan_per_step(rows, points, monkeypatch):
    scans, real = [], kmeans._scan
    monkeypatch.setattr(kmeans, "_scan", lambda *args: scans.append(len(args[2])) or real(*args))
    best, costs = kmeans.best_restart(rows, "id", "v", 5, restarts=10, max_iter=30)
    assert scans[0] == 10 and len(scans) <= 31 and len(costs) == 10
    assert best.cost == min(costs) and best.cost == pytest.approx(nearest(points, best.centers)[1])


def test_start_chosen_is_the_cheapest_and_goes_on_from_there(rows, points):
    candidates = kmeans.starts_for(rows, "id", "v", [2, 5], 6)
    best = kmeans.best_starts(rows, "v", candidates)
    for k, starts in candidates.items():
        costs = [nearest(points, s)[1] for s in starts]
        assert len(set(costs)) > 1 and best[k].cost == pytest.approx(min(costs))
        assert np.array_equal(best[k].centers, starts[int(np.argmin(costs))])


def test_starts_are_distinct_rows(points):
    chosen = kmeans.plus_plus(points, 8, 1)
    assert len(np.unique(chosen, axis=0)) == 8 and all((points == c).all(axis=1).any() for c in chosen)
    assert len(kmeans.plus_plus(np.ones((9, 2)), 4, 0)) == 1


def test_batches_share_the_rows(rows):
    numbered = rows.select("id", kmeans.batch_number("id", 6).alias("b"))
    assert {r.b for r in numbered.collect()} == set(range(6))
    assert numbered.filter("b = 2").count() < 90


def test_minibatch_step_is_a_running_mean(rows, points):
    """A centre is the mean of all rows that it took, when they came."""
    model = kmeans.Model(points[[0, 100, 250]].copy())
    taken = [[] for _ in range(3)]
    for number in range(3):
        picked = sorted(r.id for r in rows.filter(kmeans.batch_number("id", 3) == number).collect())
        own, cost = nearest(points[picked], model.centers)
        for i, c in zip(picked, own):
            taken[c].append(points[i])
        found = kmeans.minibatch_step(rows.filter(kmeans.batch_number("id", 3) == number), "v", [model])
        assert found == [pytest.approx(cost / len(picked))]
        assert np.allclose(model.centers, [np.mean(t, axis=0) for t in taken])
    assert model.counts.sum() == 300


def test_minibatches_come_near_lloyd_and_stop(rows, points):
    start = kmeans.plus_plus(points, 5, 3)
    (whole,) = kmeans.lloyd(rows, "v", [start])
    (quick,) = kmeans.minibatch(rows, "id", "v", [start], batch_rows=60, epochs=6, patience=10)
    assert quick.steps <= 30 and quick.cost <= 1.1 * whole.cost
    assert quick.cost == pytest.approx(nearest(points, quick.centers)[1])


def test_assign_and_stored_models(spark, tmp_path, rows, points):
    model = kmeans.Model(points[[3, 99, 200]].copy())
    got = {r.id: r.cluster for r in kmeans.assign(rows.withColumn("cluster", F.lit(9)), "v", model).collect()}
    assert [got[i] for i in range(300)] == nearest(points, model.centers)[0].tolist()
    models.save_kmeans(spark, model, str(tmp_path / "m"))
    assert np.array_equal(models.load_kmeans(spark, str(tmp_path / "m")).centers, model.centers)


def test_scout_is_a_minibatch_fit(spark, rows, monkeypatch):
    asked, real = [], kmeans.minibatch
    monkeypatch.setattr(kmeans, "minibatch", lambda *a, **b: asked.append(len(a[3])) or real(*a, **b))
    sweep = clustering.scout_k(rows, "id", "v", grid=(2, 5), rows=200, batch_rows=50, epochs=2)
    assert asked == [2] and sweep.k in (2, 5)


def test_no_rows_is_an_error(rows):
    with pytest.raises(ValueError):
        kmeans.starts_for(rows.limit(0), "id", "v", [2], 1)
