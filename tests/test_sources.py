import json

import pytest
from pyspark.sql import functions as F

from trendloom.functions.cleaning import clean_documents
from trendloom.operators import tfidf
from trendloom.operators.filters import key_mismatch, require_columns, require_same_keys
from trendloom.operators.svd import truncated_svd
from trendloom.plans import fixtures as fx
from trendloom.schemas import CATEGORY_COUNTS
from trendloom.sources import documents, models, tables
from trendloom.streaming.clean_stream import clean_stream


def write_lines(path, lines):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"part-{len(list(path.iterdir()))}.json").write_text("\n".join(lines) + "\n")


def record(**fields):
    return json.dumps(fields)


def test_raw_lines_keep_ids_as_text_and_missing_keys_null(spark, tmp_path):
    write_lines(tmp_path / "raw", [record(id="0704.0001", title="T", extra=1), ""])
    rows = documents.read_raw(spark, str(tmp_path / "raw")).collect()
    assert [tuple(row) for row in rows] == [("0704.0001", "T", None, None, None)]


def test_malformed_line_fails_or_is_kept(spark, tmp_path):
    write_lines(tmp_path / "raw", [record(id="1"), '{"id": "2"'])
    path = str(tmp_path / "raw")
    with pytest.raises(Exception):
        documents.read_raw(spark, path).collect()
    kept = documents.read_raw(spark, path, "PERMISSIVE").filter(F.col(documents.CORRUPT).isNotNull())
    assert [row[documents.CORRUPT] for row in kept.collect()] == ['{"id": "2"']
    with pytest.raises(ValueError):
        documents.read_raw(spark, path, "DROPMALFORMED")


def test_clean_round_trip_writes_nulls(spark, tmp_path):
    write_lines(tmp_path / "raw", [record(id="1", title="A"), record(id="2", update_date="2020-1-5")])
    clean = clean_documents(documents.read_raw(spark, str(tmp_path / "raw")))
    documents.write_clean(clean, str(tmp_path / "clean"))
    text = "".join(p.read_text() for p in (tmp_path / "clean").glob("*.json"))
    assert '"categories":null' in text and '"update_year":null' in text
    again = documents.read_clean(spark, str(tmp_path / "clean"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, clean.collect()))


def test_stream_equals_batch_and_counts_files_once(spark, tmp_path, sf_dir):
    raw = str(tmp_path / "raw")
    latex = fx.latex(spark, sf_dir).withColumn("categories", F.lit("cs.LG"))
    latex.coalesce(2).write.json(raw)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    clean_stream(spark, raw, target, state, files_per_trigger=1).awaitTermination()
    batch = clean_documents(documents.read_raw(spark, raw))
    want = sorted(map(tuple, batch.collect()), key=repr)
    assert sorted(map(tuple, documents.read_clean(spark, target).collect()), key=repr) == want
    write_lines(tmp_path / "raw", [record(id="new", title="N")])
    clean_stream(spark, raw, target, state).awaitTermination()
    assert documents.read_clean(spark, target).count() == len(want) + 1


def test_csv_keeps_commas_and_quotes(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    frame = spark.createDataFrame([(1, 'a, "b" — c'), (2, "plain")], "cluster int, label string")
    tables.write_csv(frame, path)
    again = tables.read_csv(spark, path, "cluster int, label string")
    assert sorted(map(tuple, again.collect())) == [(1, 'a, "b" — c'), (2, "plain")]


def test_category_counts_csv_has_the_declared_schema(spark, tmp_path, sf_dir):
    from trendloom.operators.categories import category_counts, ordered_counts

    counts = category_counts(fx.corpus(spark, sf_dir))
    tables.write_csv(ordered_counts(counts), str(tmp_path / "c.csv"))
    again = tables.read_csv(spark, str(tmp_path / "c.csv"), CATEGORY_COUNTS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, counts.collect()))


def test_models_reload_as_fitted(spark, tmp_path, sf_dir):
    docs = fx.corpus(spark, sf_dir)
    model = tfidf.fit_tfidf(docs, "id", "text", max_features=200)
    models.save_tfidf(spark, model, str(tmp_path / "tfidf"))
    again = models.load_tfidf(spark, str(tmp_path / "tfidf"))
    assert (again.n_terms, again.n_docs) == (model.n_terms, model.n_docs)
    assert sorted(again.vocabulary().collect()) == sorted(model.vocabulary().collect())
    rows = model.transform(docs, "id", "text")
    factors = truncated_svd(rows, model.n_terms, 4, n_iter=2)
    models.save_svd(spark, factors, str(tmp_path / "svd"))
    stored = models.load_svd(spark, str(tmp_path / "svd"))
    assert (stored.v == factors.v).all() and (stored.s == factors.s).all()


def test_guards(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "doc_id int")
    right = spark.createDataFrame([(2,), (3,)], "doc_id int")
    assert sorted(map(tuple, key_mismatch(left, right, "doc_id").collect())) == [
        (1, "left", 1, 0),
        (2, "left", 2, 1),
        (3, "right", 0, 1),
    ]
    with pytest.raises(ValueError):
        require_same_keys(left, right, "doc_id")
    with pytest.raises(ValueError, match="repeated"):
        require_same_keys(left, left, "doc_id")
    require_same_keys(right, right, "doc_id")
    with pytest.raises(ValueError, match="cluster"):
        require_columns(left, "cluster")
