import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import block_svd, filters, sampling, svd, term_slices, tfidf
from trendloom.operators.sampling import hash_sample, hash_sample_per_group
from trendloom.plans import fixtures as fx
from trendloom.plans.queries import QUERIES
from trendloom.session import materialize


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    docs = filters.drop_short_texts(fx.corpus(spark, sf_dir))
    model = tfidf.fit_tfidf(docs, "id", "text", max_features=300)
    return model, materialize(model.transform(docs, "id", "text"), "test-rows")


@pytest.fixture(scope="module")
def dense(fitted):
    model, rows = fitted
    matrix = np.zeros((rows.count(), model.n_terms))
    ids = []
    for i, row in enumerate(rows.orderBy("id").collect()):
        matrix[i, row.term_ids] = row.weights
        ids.append(row.id)
    return ids, matrix


@pytest.fixture(scope="module")
def factors(fitted):
    model, rows = fitted
    return svd.truncated_svd(rows, model.n_terms, 10)


def test_short_texts(spark):
    words = " ".join("w" * 20)
    texts = [words, " \n" + words.replace(" ", "\xa0\t"), words[2:], "", None, " " * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    kept = filters.drop_short_texts(frame).orderBy("i").collect()
    assert [row.i for row in kept] == [0, 1]
    assert [row.i for row in filters.drop_short_texts(frame, min_words=0).orderBy("i").collect()] == [
        0,
        1,
        2,
    ]


def test_rows_have_length_one(dense):
    norms = np.linalg.norm(dense[1], axis=1)
    assert np.all((np.abs(norms - 1) < 1e-12) | (norms == 0))


def test_cap_keeps_the_most_frequent(spark):
    rows = [(f"t{i:03d}", 5, (i * 37) % 50 + 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "term string, df long, cf long")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    for n in (1, 7, 8, 9, 100, 399, 400, 1000):
        got = {row.term for row in tfidf.most_frequent(frame, n).collect()}
        assert got == {row[0] for row in order[:n]}


def test_cap_per_group(spark):
    rows = [(i % 2 if i < 300 else 2, f"t{i:03d}", (i * 37) % 50 + 1) for i in range(330)]
    frame = spark.createDataFrame(rows, "g int, term string, cf long")
    for n in (1, 13, 30, 149, 150, 500):
        got = tfidf.most_frequent_per_group(frame, "g", n).collect()
        want = set()
        for group in range(3):
            mine = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
            want |= {r[1] for r in mine[:n]}
        assert {row.term for row in got} == want and len(got) == len(want)


def test_pruning_everything_is_an_error(spark):
    few = spark.createDataFrame([(i, "alpha beta") for i in range(4)], "id int, text string")
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(few, "id", "text")
    different = spark.createDataFrame(
        [(i, "word" + chr(97 + i)) for i in range(10)], "id int, text string"
    )
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(different, "id", "text")


def test_unknown_terms_leave_an_empty_row(spark, fitted):
    model, _ = fitted
    odd = spark.createDataFrame([("x", "qqqq zzzz"), ("y", None)], "id string, text string")
    rows = model.transform(odd, "id", "text").collect()
    assert [(row.term_ids, row.weights) for row in rows] == [([], []), ([], [])]


def test_singular_values_match_a_dense_svd(dense, factors):
    want = np.linalg.svd(dense[1], compute_uv=False)[:10]
    assert np.allclose(factors.s[:4], want[:4], rtol=1e-6)
    assert np.allclose(factors.s, want, rtol=1e-2)
    assert np.allclose(factors.v.T @ factors.v, np.eye(10), atol=1e-8)


def test_whitened_columns_are_orthonormal(fitted, dense, factors):
    _, rows = fitted
    got = {r.id: r.embedding for r in svd.whitened(rows, "id", factors).collect()}
    z = np.array([got[i] for i in dense[0]])
    assert np.allclose(z.T @ z, np.eye(10), atol=1e-6)
    assert np.allclose(z, dense[1] @ factors.v / factors.s, atol=1e-9)


def test_narrow_blocks_change_nothing(fitted, factors, monkeypatch):
    model, rows = fitted
    monkeypatch.setattr(svd, "BLOCK_BYTES", 4 * model.n_terms * 4)
    monkeypatch.setattr(svd, "DOCS_AT_ONCE", 7)
    assert [b.stop - b.start for b in svd.column_blocks(model.n_terms, 10)] == [4, 4, 2]
    again = svd.truncated_svd(rows, model.n_terms, 10)
    assert np.allclose(again.s, factors.s) and np.allclose(again.v, factors.v, atol=1e-6)


def test_one_pass_for_each_multiplication(fitted, monkeypatch):
    model, rows = fitted
    passes = []
    real = svd._gram_block
    monkeypatch.setattr(svd, "_gram_block", lambda *args: passes.append(1) or real(*args))
    svd.truncated_svd(rows, model.n_terms, 300, n_iter=2)
    assert len(passes) == 3 and len(svd.column_blocks(200_000, 310)) == 1


def test_variances(fitted, dense, factors):
    model, rows = fitted
    whole = tfidf.total_variance(rows, "id", model.n_docs).first()[0]
    part = svd.component_variance(svd.project(rows, "id", factors.v)).first()[0]
    assert whole == pytest.approx(dense[1].var(axis=0).sum())
    assert part == pytest.approx((dense[1] @ factors.v).var(axis=0).sum())
    stored = svd.whitened(rows, "id", factors)
    assert svd.component_variance(svd.unwhitened(stored, factors.s)).first()[0] == pytest.approx(part)
    assert 0 < part < whole


def test_samples_are_the_smallest_hashes(spark):
    frame = spark.range(5000).select(
        F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("third"), F.col("id").alias("payload")
    )
    frame = frame.withColumn("group", F.when(F.col("id") < 4000, 0).otherwise(F.col("third") + 1))
    order = F.md5(F.concat(F.col("id").cast("string"), F.lit("#3")))
    rows = frame.withColumn("h", order).collect()
    for n in (1, 50, 4999, 5000, 9000):
        want = {r.id for r in sorted(rows, key=lambda r: r.h)[:n]}
        assert {r.id for r in hash_sample(frame, "id", n, seed=3).collect()} == want
    got = hash_sample_per_group(frame, "group", "id", 400, seed=3).collect()
    want = set()
    for group in (0, 1, 2):
        mine = sorted((r for r in rows if r.group == group), key=lambda r: r.h)
        want |= {r.id for r in mine[:400]}
    assert {r.id for r in got} == want and got[0].asDict().keys() == frame.first().asDict().keys()
    again = hash_sample(frame.repartition(17), "id", 50, seed=3)
    assert again.count() == 50


def test_queries_keep_every_component(spark, sf_dir, monkeypatch):
    asked, real = [], svd.truncated_svd

    def noted(rows, id_column, n_terms, n_components=svd.N_COMPONENTS, **settings):
        asked.append(n_components)
        return real(rows, n_terms, 5, n_iter=1)

    monkeypatch.setattr(block_svd, "decompose", noted)
    for name in ("svd_singular_values", "svd_whiten", "explained_variance"):
        QUERIES[name](spark, sf_dir)
    assert asked == [svd.N_COMPONENTS] * 3


def test_components_beyond_the_rank_stay_zero(spark):
    draw = np.random.default_rng(3)
    data = [(i, list(range(60)), [float(x) for x in draw.random(60)]) for i in range(20)]
    rows = spark.createDataFrame(data, "id int, term_ids array<int>, weights array<double>")
    factors = svd.truncated_svd(rows, 60, 50)
    white = np.array([r.embedding for r in svd.whitened(rows, "id", factors).collect()])
    assert np.allclose(white.T @ white, np.diag([1.0] * 20 + [0.0] * 30), atol=1e-6)


def test_vocabularies_too_large_to_send_give_the_same_rows(spark, fitted, dense, monkeypatch):
    model, rows = fitted
    monkeypatch.setattr(tfidf, "SENT_TERMS", 20)
    assert 0 < model.table.filter(F.col("df") >= model._least_df(20)).count() <= 20
    docs = spark.createDataFrame([("x", "qqqq zzzz"), ("y", None), ("x", "qqqq")], "id string, text string")
    corpus = filters.drop_short_texts(fx.corpus(spark, "/root/testdata/sf0.001")).select("id", "text")
    again = model.transform(corpus.unionByName(docs), "id", "text").collect()
    assert sorted(r.id for r in again if not r.term_ids and r.id in "xy") == ["x", "x", "y"]
    want = {r.id: (r.term_ids, r.weights) for r in rows.collect()}
    assert {r.id: (r.term_ids, r.weights) for r in again if r.id not in "xy"} == want


def test_small_vocabularies_are_sent(spark, fitted, capsys):
    model, _ = fitted
    model.transform(spark.createDataFrame([("x", "a b")], "id string, text string"), "id", "text").explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_samples_of_repeated_and_null_ids(spark, monkeypatch):
    """A hot id is counted, not ranked, and the sample has its size all the same."""
    monkeypatch.setattr(sampling, "RANKED_ROWS", 50)
    key = F.when(F.col("n") % 3 > 0, F.lit(None)).otherwise((F.col("n") / 30).cast("long"))
    frame = spark.range(3000).withColumnRenamed("id", "n").withColumn("id", key)
    for n in (1, 7, 500, 1500, 2999, 3000, 4000):
        got = {r.n for r in hash_sample(frame, "id", n).collect()}
        assert len(got) == min(n, 3000)
        assert got == {r.n for r in hash_sample(frame.repartition(7), "id", n).collect()}
    same = spark.range(200).select(F.lit("a").alias("id"))
    assert hash_sample(same, "id", 10).count() == 200


def test_entries_of_frequent_terms_are_not_shuffled_by_term(spark, fitted, monkeypatch, capsys):
    """Of a vocabulary too large to send, only entries that the sent part lacks meet the rest."""
    model, _ = fitted
    monkeypatch.setattr(tfidf, "SENT_TERMS", 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model.transform(spark.createDataFrame([("x", "a b")], "id string, text string"), "id", "text").explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    merged = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(merged) == 1 and "Inner" in merged[0] and "LeftAnti" in plan


def test_sums_of_neighbouring_terms_travel_as_one_row(spark, monkeypatch):
    """A map of many rows made one row per term and task in each of twenty iterations."""
    draw = np.random.default_rng(3)
    matrix = np.where(draw.random((60, 500)) < 0.05, draw.random((60, 500)), 0.0)
    matrix[7], matrix[:, 11] = 0.0, 0.0
    listed = [(np.flatnonzero(row).tolist(), row[np.flatnonzero(row)].tolist()) for row in matrix]
    rows = spark.createDataFrame(listed, "term_ids array<int>, weights array<double>").repartition(3)
    vectors = draw.integers(-9, 9, (500, 4)).astype(float)
    for size in (1, 32 * 100, svd.ROW_BYTES):
        monkeypatch.setattr(svd, "ROW_BYTES", size)
        np.testing.assert_allclose(svd.gram_times(rows, vectors), matrix.T @ (matrix @ vectors), atol=1e-10)
    shared = spark.sparkContext.broadcast(vectors)
    sums = svd.partial_sums(rows, shared, 100).collect()
    assert len(sums) <= 3 * 5
    assert {t for row in sums for t in row["term_ids"]} == set(np.flatnonzero(matrix.any(axis=0)))


def test_fitted_rows_are_those_of_new_documents(spark, sf_dir, monkeypatch):
    """Slices of few documents, with null and shared ids, and the path of new documents."""
    monkeypatch.setattr(term_slices, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(term_slices, "DOCS_AT_ONCE", 7)
    monkeypatch.setattr(term_slices, "GATHERED", 500)
    corpus = filters.drop_short_texts(fx.corpus(spark, sf_dir)).select(
        F.when(F.col("doc_id") % 9 > 0, F.floor(F.col("doc_id") / 2)).alias("id"), "text"
    )
    docs = materialize(corpus.unionByName(spark.createDataFrame([(1, ""), (None, None)], "id long, text string")), "test-docs")
    model, rows = tfidf.fit_transform(docs, "id", "text", min_df=3)
    assert model.n_docs == docs.count() and rows.columns == ["id", "term_ids", "weights"]
    again = tfidf.fit_tfidf(docs, "id", "text", min_df=3)
    assert sorted(map(tuple, again.table.collect())) == sorted(map(tuple, model.table.collect()))
    listed = [
        sorted(((str(r.id), r.term_ids, [round(x, 9) for x in r.weights]) for r in found.collect()))
        for found in (rows, model.transform(docs, "id", "text"))
    ]
    assert listed[0] == listed[1] and ("1", [], []) in listed[0] and ("None", [], []) in listed[0]


def test_a_fit_moves_a_term_once_for_each_slice(spark, capsys):
    """Not once for each document, and rows are not put together from their entries."""
    docs = spark.range(400).select("id", F.lit("alpha beta gamma alpha").alias("text")).repartition(2)
    of_docs, terms = term_slices.counted_slices(docs, "id", "text", tfidf.TERMS)
    assert of_docs.count() == 2 and terms.count() == 2 * 6
    added = term_slices.added_terms(terms, 5).collect()
    assert {(r.term, r.df, r.cf) for r in added} >= {("alpha", 400, 800), ("beta gamma", 400, 400)}
    assert term_slices.added_terms(terms, 401).count() == 0
    _, rows = tfidf.fit_transform(docs, "id", "text", max_df=1.0)
    rows.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_written_steps_leave_no_shuffle_files(spark):
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    left = lambda: {f.name for x in folders for f in Path(x).rglob("shuffle_*")}
    before = left()
    moved = materialize(spark.range(1000).repartition(5, "id"), "test-moved")
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before and moved.count() == 1000
