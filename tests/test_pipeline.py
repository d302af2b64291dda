import pytest
from pyspark.sql import functions as F

from trendloom.plans import fixtures as fx
from trendloom.plans import pipeline
from trendloom.sources import tables


def test_run_from_raw_lines_to_the_map(spark, tmp_path, sf_dir):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "run")
    fx.corpus(spark, sf_dir).select(
        "id",
        F.lit("A $\\alpha_s$ title").alias("title"),
        F.col("text").alias("abstract"),
        "categories",
        F.concat(F.col("update_year").cast("string"), F.lit("-1-05")).alias("update_date"),
    ).write.json(raw)
    settings = pipeline.Settings(
        n_components=6, n_iter=2, k_grid=(3, 4), restarts=1, max_iter=10, neighbors=8, map_steps=2
    )
    pipeline.run_pipeline(spark, raw, out, settings)
    meta = tables.read_table(spark, f"{out}/doc_meta_with_clusters")
    n_docs = meta.count()
    assert n_docs == tables.read_embeddings(spark, f"{out}/embeddings").count() > 150
    assert meta.filter("cluster is null").count() == 0
    for name in ("doc_meta_with_labels", "doc_meta_with_phrases", "doc_meta_with_cat_labels"):
        assert tables.read_table(spark, f"{out}/{name}").count() == n_docs
    placed = tables.read_table(spark, f"{out}/topic_map")
    assert placed.count() == n_docs
    assert placed.filter("x is null or isnan(x) or label is null or color is null").count() == 0
    wide = tables.read_csv(spark, f"{out}/cluster_share_by_year.csv")
    sums = wide.select(sum(F.col(c).cast("double") for c in wide.columns[1:]).alias("s")).collect()
    assert all(row.s == pytest.approx(1) for row in sums)
    lines = tables.read_csv(spark, f"{out}/top_topics_over_years.csv")
    assert lines.filter("label like '%: %'").count() == lines.count() > 0


def test_settings_are_checked():
    with pytest.raises(ValueError):
        pipeline.Settings(top_mode="best")
    with pytest.raises(ValueError):
        pipeline.Settings(label_source="guess")
