import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F
from tests.llm.awkward import ROWS, awkward, empty, with_text
from trendloom.llm import exact_dedup
from trendloom.llm.exact_dedup import drop_duplicates, duplicate_groups


def brute(rows):
    """Multiset of (doc_id, keep_id, group_size), and the number of kept rows per text."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    found = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        found += [(i, min(known) if known else None, len(ids)) for i in ids]
    return sorted(found, key=repr), len(groups)


def check(frame, rows):
    result = frame.collect()
    expected, n_groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in result), key=repr) == expected
    kept = [r for r in result if r.kept]
    assert len(kept) == n_groups and all(r.doc_id == r.keep_id for r in kept)


def test_awkward_rows(spark):
    check(duplicate_groups(awkward(spark)), [row[:2] for row in ROWS])


def test_digest_is_of_the_normalised_text(spark):
    row = duplicate_groups(with_text(spark, ["a \n\n b"])).first()
    assert bytes(row.digest) == hashlib.sha256(b"a b").digest()


def test_colliding_digests_are_told_apart(spark):
    texts = ["aa", "ab", "aa", "ba", "b", "ab", "", None, "b", "b"]
    weak = lambda content: F.substring(content, 1, 1).cast("binary")
    rows = list(enumerate(texts)) + [(4, "b"), (4, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(duplicate_groups(docs, digest=weak), rows)


def test_hot_text(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = duplicate_groups(docs).filter("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(row) for row in rows] == [(1, 3333)]


def test_rows_that_stay(spark):
    stay = drop_duplicates(awkward(spark))
    assert stay.columns == awkward(spark).columns
    _, n_groups = brute([row[:2] for row in ROWS])
    assert stay.count() == n_groups
    assert {r.doc_id for r in stay.collect()} == {1, 3, 5, 6, 7, 8, 9}


def test_empty_table(spark):
    assert duplicate_groups(empty(spark)).count() == 0
    assert drop_duplicates(empty(spark)).count() == 0


def test_one_hot_id_and_text_beside_others(spark):
    """A third of the rows have neither id nor words; groups of all sizes, sent and joined."""
    rows = [(None, " ") for _ in range(1500)] + [(i, f"text {i % 700}") for i in range(2500)] + [(7, "same")] * 1200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(duplicate_groups(docs), rows)


def test_tasks_combine_their_own_copies_before_texts_move(spark):
    """Below the first exchange that texts are in, there is an aggregation of the task's rows."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 10 AS string) AS text")
    texts = docs.select(
        exact_dedup.sha256(F.col("text")).alias("digest"), F.col("text").alias("content"),
        exact_dedup._rank().alias("rank"), F.col("doc_id").alias("salt_key"),
    )
    bits = exact_dedup._bits(texts.select("digest").distinct())
    assert bits.count() <= 10
    plan = exact_dedup.combine(exact_dedup._with_bit(texts, bits))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(digest" in line]
    assert len(exchanges) == 2 and any("partial_min(rank" in line for line in lines[exchanges[-1] :])
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan


def test_bits_find_all_their_digests(spark, monkeypatch):
    """Also when many share a bit."""
    monkeypatch.setattr(exact_dedup, "WORDS", 4)
    rows = spark.range(900).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    bits = exact_dedup._bits(rows.filter("id < 100").select("digest"))
    found = {r.id for r in exact_dedup._with_bit(rows, bits).collect()}
    assert bits.count() <= 4 and set(range(100)) <= found and len(found) < 900
    docs = spark.createDataFrame([(i, f"t{i % 50}") for i in range(90)], "doc_id long, text string")
    check(duplicate_groups(docs), [(i, f"t{i % 50}") for i in range(90)])


def test_rows_that_stay_with_text_ids_and_clashing_names(spark):
    rows = [("b", "x y", 1, 5), ("a", "x  y", 2, 6), (None, "x y", 3, 7), ("a", "x y", 4, 8), ("c", "z", 5, 9), ("", "q", 6, 1), (None, "q", 7, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, key int, __key int")
    stay = drop_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id, r.key + r["__key"] > 0) for r in stay.collect()) == [("", True), ("a", True), ("c", True)]
