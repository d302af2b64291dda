import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions.vectors import normalize_rows
from trendloom.operators import filters, kmeans, svd, tfidf
from trendloom.plans import fixtures as fx
from trendloom.session import materialize
from trendloom.sources import documents, models, quarantine, tables
from trendloom.streaming.assign_stream import assign_documents, assign_stream, load_models, read_assigned


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    """Stored models, and the clusters that the run itself gave its documents."""
    out = str(tmp_path_factory.mktemp("run"))
    docs = filters.drop_short_texts(fx.corpus(spark, sf_dir)).select("id", "text")
    model, rows = tfidf.fit_transform(docs, "id", "text", max_features=300)
    rows = materialize(rows, "run-rows")
    factors = svd.truncated_svd(rows, model.n_terms, 8)
    unit = normalize_rows(svd.whitened(rows, "id", factors), "embedding")
    fitted = kmeans.Model(kmeans.plus_plus(kmeans.start_rows(unit, "id", "embedding"), 5, 0))
    models.save_tfidf(spark, model, f"{out}/tfidf")
    models.save_svd(spark, factors, f"{out}/svd")
    models.save_kmeans(spark, fitted, f"{out}/kmeans")
    return out, docs, {r.id: r.cluster for r in kmeans.assign(unit, "embedding", fitted).collect()}


def test_stored_models_repeat_the_run(spark, run):
    out, docs, clusters = run
    got = assign_documents(docs, load_models(spark, out)).collect()
    assert {r.id: r.cluster for r in got} == clusters


def test_stream_equals_batch_and_counts_once(spark, run, tmp_path):
    out, docs, _ = run
    clean, target, state = (str(tmp_path / name) for name in ("clean", "out", "state"))
    empty = {"categories": F.lit(None).cast("string"), "update_year": F.lit(2020)}
    documents.write_clean(docs.withColumns(empty).repartition(4), clean)
    stored = load_models(spark, out)
    assign_stream(spark, clean, target, state, stored, files_per_trigger=2).awaitTermination()
    want = {(r.id, r.cluster, round(r.distance, 9)) for r in assign_documents(docs, stored).collect()}
    read = lambda: [(r.id, r.cluster, round(r.distance, 9)) for r in read_assigned(spark, target).collect()]
    first = read()
    assert set(first) == want and len(first) == len(want)
    assign_stream(spark, clean, target, state, stored).awaitTermination()
    assert sorted(read()) == sorted(first)


def test_unknown_words_have_a_place(spark, run):
    out, _, _ = run
    odd = spark.createDataFrame([("x", "qqqq"), ("y", None)], "id string, text string")
    got = assign_documents(odd, load_models(spark, out)).collect()
    assert sorted(r.id for r in got) == ["x", "y"] and all(np.isfinite(r.distance) for r in got)


LINES = ['{"id":"1","title":"a"}', '{"id":"2"', "", "  ", "not json", '{"id":"3","other":1}', "[1]", '{"id":4}']


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(LINES[:5]) + "\n")
    (folder / "b.json").write_text("\n".join(LINES[5:]) + "\n")
    return str(folder)


def test_malformed_lines_keep_their_file(spark, raw, tmp_path):
    batch, stream = str(tmp_path / "batch"), str(tmp_path / "stream")
    quarantine.split_raw(spark, raw, batch)
    quarantine.split_stream(spark, raw, stream, str(tmp_path / "state"), 1).awaitTermination()
    for target in (batch, stream):
        good = quarantine.read_good(spark, target)
        assert sorted(r.id for r in good.collect()) == ["1", "3", "4"]
        assert good.columns == ["id", "title", "abstract", "categories", "update_date"]
        bad = quarantine.read_malformed(spark, target).collect()
        assert sorted((r.file[-6:], r.line) for r in bad) == [("a.json", "not json"), ("a.json", '{"id":"2"'), ("b.json", "[1]")]
    quarantine.split_stream(spark, raw, stream, str(tmp_path / "state"), 1).awaitTermination()
    assert quarantine.read_good(spark, stream).count() == 3


def test_no_malformed_lines(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"id": "1"}) + "\n")
    quarantine.split_raw(spark, str(tmp_path / "one.json"), str(tmp_path / "out"))
    assert quarantine.read_malformed(spark, str(tmp_path / "out")).count() == 0


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        result = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_metrics_cost_no_job(spark, tmp_path):
    frame = spark.range(1000).withColumn("half", F.when(F.col("id") % 2 == 0, F.col("id")))
    _, plain = jobs_of(spark, "plain", lambda: tables.write_table(frame, str(tmp_path / "a")))
    (stored, seen), watched = jobs_of(
        spark, "watched", lambda: tables.write_observed(frame, str(tmp_path / "b"), n=F.count("*"), nulls=F.count(F.when(F.col("half").isNull(), True)))
    )
    assert seen == {"n": 1000, "nulls": 500} and watched == plain and stored.count() == 1000


def test_buckets_join_without_exchange(spark, tmp_path, capsys):
    a = spark.range(500).withColumn("x", F.col("id") * 2)
    b = spark.range(0, 500, 3).withColumn("y", F.col("id") + 1)
    left = tables.write_bucketed(a, str(tmp_path / "a"), "id", 4)
    tables.write_bucketed(b, str(tmp_path / "b"), "id", 4)
    spark.sql(f"DROP TABLE {tables._bucketed_name(str(tmp_path / 'b'))}")
    right = tables.read_bucketed(spark, str(tmp_path / "b"), "id", 4)
    joined = left.join(right.hint("merge"), "id")
    assert joined.count() == 167 and joined.filter("x <> 2 * id OR y <> id + 1").count() == 0
    joined.explain("formatted")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan
