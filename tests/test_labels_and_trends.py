import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_cleaning import column
from trendloom.functions import labels
from trendloom.operators import categories, phrases, term_slices, tfidf, trends


def test_codes(spark):
    texts = ["math.CO, cs.LG;hep-th", "a.b.c", None, "cs.LG cs.LG"]
    assert column(spark, texts, labels.category_codes) == [
        ["math.CO", "cs.LG", "hep-th"],
        ["a.b", "c"],
        [],
        ["cs.LG", "cs.LG"],
    ]


def test_shortened_join(spark):
    frame = spark.createDataFrame([(["abc", "def"],), (["abc"],)], "l array<string>")
    got = [row.r for row in frame.select(labels.join_shortened(F.col("l"), 6).alias("r")).collect()]
    assert got == ["abc, …", "abc"]


def test_short_and_legend_labels(spark):
    frame = spark.createDataFrame(
        [(3, "Computational Engineering, Finance, and Science"), (4, None), (5, " x ,y")],
        "k int, l string",
    )
    short = frame.select(labels.short_label(F.col("k"), F.col("l")).alias("r")).collect()
    assert [row.r for row in short] == ["3: Computational Engineering", "4: 4", "5: x"]
    legend = frame.select(labels.legend_label(F.col("k"), F.col("l"), 2).alias("r")).collect()
    assert [row.r for row in legend] == ["3: Computational Engineering, Finance", "4: ", "5:  x ,y"]
    assert column(spark, ["abcdef"], lambda c: labels.first_chars(c, 3)) == ["abc"]


def test_share_floor_falls_back(spark):
    codes = " ".join(f"c.{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30))
    meta = spark.createDataFrame([(0, codes), (1, "x.A x.A x.B"), (1, None)], "cluster int, categories string")
    top = categories.top_codes(categories.category_counts(meta)).orderBy("cluster", "place").collect()
    assert [(r.cluster, r.codes) for r in top] == [
        (0, "c.aa"),
        (0, "c.ab"),
        (0, "c.ac"),
        (1, "x.A"),
        (1, "x.B"),
    ]


def test_rare_codes_drop_below_the_floor(spark):
    meta = spark.createDataFrame([(0, "a.A " * 50 + "b.B")], "cluster int, categories string")
    top = categories.top_codes(categories.category_counts(meta)).collect()
    assert [r.codes for r in top] == ["a.A"]


def test_label_input_needs_clusters(spark):
    with pytest.raises(ValueError, match="cluster"):
        categories.category_counts(spark.createDataFrame([("x",)], "categories string"))


def corpus(spark, texts, cluster=0):
    rows = [(f"d{i:02d}", text, cluster) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, text string, cluster int")


def test_small_clusters_get_empty_phrases(spark):
    filler = "neural network training converges quickly "
    nine = corpus(spark, [filler * 4 + f"unique{i}" for i in range(9)], cluster=2)
    got = {r.cluster: r.key_phrases for r in phrases.cluster_phrases(nine, nine).collect()}
    assert got == {0: "", 1: "", 2: ""}


def test_phrases_drop_stop_words_after_the_cut(spark):
    shared = ["deep network", "introduction chapter"]
    texts = []
    for i in range(24):
        words = " ".join(f"w{i}x{j}" for j in range(30))
        texts.append(f"{words} {shared[i % 2]} {words}")
    docs = corpus(spark, texts)
    got = phrases.cluster_phrases(docs, docs, max_df=0.6).collect()
    assert [r.key_phrases for r in got] == ["deep network"]
    only = phrases.cluster_phrases(docs, docs, max_df=0.6, stop_words=["deep", "chapter"]).collect()
    assert set(only[0].key_phrases.split(", ")) == {"deep network", "introduction chapter"}


def test_last_cluster_of_an_id_counts(spark):
    meta = spark.createDataFrame(
        [("a", 1, 0), ("a", 2, 1), ("b", None, 0), (None, 3, 0)], "id string, cluster int, at int"
    )
    assert [tuple(r) for r in phrases.cluster_lookup(meta, "at").collect()] == [("a", 2)]


def test_length_is_checked_after_the_cut(spark):
    docs = corpus(spark, ["x" * 200, "y" * 119, "  " + "z" * 120])
    assert sorted(r.id for r in phrases.long_texts(docs).collect()) == ["d00", "d02"]
    cut = phrases.long_texts(docs, max_chars=150).collect()
    assert sorted(len(r.text) for r in cut) == [120, 150]


def yearly(spark):
    counts = [
        (2010, 0, 9),
        (2010, 1, 1),
        (2015, 0, 2),
        (2015, 1, 2),
        (2019, 1, 5),
        (2020, 1, 3),
        (2020, 2, 3),
    ]
    rows = [(y, c) for y, c, n in counts for _ in range(n)] + [(None, 0), (2020, None)]
    return trends.yearly_share(spark.createDataFrame(rows, "update_year int, cluster int"))


def test_shares_sum_to_one(spark):
    sums = yearly(spark).groupBy("update_year").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 4 and all(row.s == pytest.approx(1) for row in sums)


def test_rankings(spark):
    series = trends.share_series(yearly(spark))

    def ranked(mode, top=None):
        return [(r.cluster, r.score) for r in trends.rank_topics(series, mode, top).collect()]

    assert ranked("last3") == [(1, 2.0), (0, 0.5), (2, 0.5)]
    assert ranked("last") == [(1, 0.5), (2, 0.5), (0, 0.0)]
    assert ranked("overall", 1) == [(1, 0.525)]
    assert ranked("total", 2) == [(1, 2.1), (0, 1.4)]
    with pytest.raises(ValueError):
        ranked("first")


def test_wide_and_long_agree(spark):
    share = yearly(spark)
    wide = trends.share_table(share)
    assert wide.columns == ["update_year", "0", "1", "2"]
    extended = wide.withColumn("update_year.1", F.lit(1)).withColumnRenamed("2", " 2 ")
    long = trends.unpivot_shares(extended).select("update_year", "cluster", "share")
    grid = trends.share_grid(share)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, grid.collect()))
    with pytest.raises(ValueError):
        trends.unpivot_shares(wide.select("update_year"))


def test_chart_series_without_labels(spark):
    best = trends.rank_topics(trends.share_series(yearly(spark)), "last", 1)
    lines = trends.chart_series(best).orderBy("update_year").collect()
    assert [(r.rank, r.label, r.update_year) for r in lines] == [
        (1, "1: 1", year) for year in (2010, 2015, 2019, 2020)
    ]


def test_texts_of_one_id_are_vectorised_by_themselves(spark):
    texts = ["alpha beta gamma", "alpha beta delta", "gamma delta alpha beta", "delta gamma gamma"]
    counts = [Counter([f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])]) for t in texts]
    df = Counter(term for c in counts for term in c)
    want = Counter()
    for c in counts:
        w = {term: (1 + math.log(n)) * (math.log(5 / (1 + df[term])) + 1) for term, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for term, x in w.items():
            want[term] += x / norm / 4
    two_words = tfidf.Analyzer(strip_accents=False, word_tokens=True, stop_words=(), shortest=2, longest=2)
    for ids in ("abcd", "aabb", "aaaa", [None] * 4):
        docs = spark.createDataFrame([(0, i, t) for i, t in zip(ids, texts)], "cluster int, id string, text string")
        got = phrases.phrase_weights(docs, two_words, min_df=1, max_df=1.0).collect()
        assert {r.term: r.weight for r in got} == pytest.approx(dict(want))


def test_known_phrases_are_sent_or_met_in_parts(spark, monkeypatch, capsys):
    """Entries find their phrase without a shuffle by phrase; a bounded part of many gives the same."""
    from trendloom.operators import tfidf

    words = ["red stone bridge", "old stone bridge", "cold river water", "deep river water"]
    texts = [(i % 2, f"{words[i % 4]} {words[(i * 3 + 1) % 4]} item{i % 5} page{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(texts, "cluster int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = phrases.phrase_weights(docs, max_df=1.0)
        whole.explain()
        assert "BroadcastHashJoin" in capsys.readouterr().out
        want = {(r.cluster, r.term): r.weight for r in whole.collect()}
        monkeypatch.setattr(tfidf, "SENT_TERMS", 6)
        got = {(r.cluster, r.term): r.weight for r in phrases.phrase_weights(docs, max_df=1.0).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_phrases_move_once_for_each_slice(spark, capsys):
    """Not once for each document, whose weights are made without a shuffle by document."""
    texts = [(i % 2, f"red stone bridge item{i % 7} over water") for i in range(200)]
    docs = spark.createDataFrame(texts, "cluster int, text string").coalesce(1)
    weights = phrases.phrase_weights(docs, max_df=1.0)
    weights.explain()
    assert "Window" not in capsys.readouterr().out
    assert {(r.cluster, r.term) for r in weights.collect()} >= {(0, "red stone"), (1, "red stone bridge")}
    _, terms = term_slices.counted_slices(docs, "cluster", "text", tfidf.PHRASES, "cluster")
    assert terms.filter("term = 'red stone'").groupBy("_group").count().orderBy("_group").collect() == [(0, 1), (1, 1)]
