import random
import re

from pyspark.sql import functions as F
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm.pareto_mix import mix, mixed_documents


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares of the mix, cut and shared again until none is above; by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_sources, found = share * sum(sizes.values()), set(order), {}
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if level * weight[s] >= most * sizes[s]}
        if not full:
            found.update({s: level * weight[s] for s in open_sources})
            break
        for s in full:
            found[s] = most * sizes[s]
            left -= found[s]
        open_sources -= full
    return found


def check(rows, nearness):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    for source in sizes:
        mine = [r for r in rows if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]}
        assert all(abs(r.target - want[source]) <= 1e-6 * max(1, want[source]) for r in mine)
        assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in mine)
        taken = sum(r.taken for r in mine)
        assert abs(taken - want[source]) <= max(nearness * want[source], max(r.size for r in mine))


def mixed(docs):
    return mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = mixed(docs)
    assert len(rows) == docs.count()
    check(rows, 0.02)


def test_reruns_agree(spark, sf_dir):
    docs = documents(spark, sf_dir)
    first = {r.doc_id: r.taken for r in mix(docs).collect()}
    assert first == {r.doc_id: r.taken for r in mix(docs.repartition(5)).collect()}
    assert first != {r.doc_id: r.taken for r in mix(docs, seed=1).collect()}


def test_longer_documents_are_likelier(spark):
    draw = random.Random(5)
    rows = [(i, "w " * draw.choice([3, 200]), draw.choice("ab")) for i in range(3000)]
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.4).collect()
    share = {n: sum(r.taken > 0 for r in found if r.size == n) / sum(r.size == n for r in found) for n in (3, 200)}
    assert 0 < share[3] < share[200]


def test_rows_of_the_mix(spark, sf_dir):
    docs = documents(spark, sf_dir)
    copies = {r.doc_id: r.copies for r in mix(docs).collect() if r.copies}
    rows = mixed_documents(docs)
    assert rows.columns == docs.columns
    assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == copies


def test_awkward_rows(spark):
    rows = mix(awkward(spark)).collect()
    assert len(rows) == len(ROWS)
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((row[0] or -1, words(row[1])) for row in ROWS)
    assert mixed_documents(awkward(spark)).columns == awkward(spark).columns
    nulls = awkward(spark).filter("source IS NULL")
    assert mix(nulls).agg(F.sum("taken")).first()[0] > 0


def test_empty_tables(spark):
    assert mix(empty(spark)).count() == 0
    assert mixed_documents(empty(spark)).count() == 0
    wordless = awkward(spark).filter("doc_id IN (3, 4, 5)")
    assert {(r.taken, r.target) for r in mix(wordless).collect()} == {(0, 0.0)}


def test_rows_that_repeat_an_id_are_drawn_one_by_one(spark):
    """Most ids are null, one is hot, and a third of the rows are the same text."""
    draw = random.Random(9)
    rows = []
    for i in range(3000):
        text = "the same text of nine words for many rows" if i % 3 == 0 else "w " * draw.randrange(1, 400)
        rows.append((draw.choice([None, None, 7, i]), text, draw.choice(["a", "a", "b", "c", None]), i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, i int").repartition(6)
    found = mix(docs)
    sources = {r.source: r for r in docs.groupBy("source").count().collect()}
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    totals = {s: sum(words(t) for _, t, source, _ in rows if source == s) for s in sources}
    wanted = targets(totals)
    by_target = {round(wanted[s], 3): s for s in wanted}
    taken = {}
    for r in found.collect():
        source = by_target[round(r.target, 3)]
        taken[source] = taken.get(source, 0) + r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - wanted[s]) <= 400 for s in wanted)
    repeats = {}
    for r in mixed_documents(docs).collect():
        repeats[r.i] = repeats.get(r.i, 0) + 1
    again = {}
    for i, n in repeats.items():
        again[rows[i][2]] = again.get(rows[i][2], 0) + n * words(rows[i][1])
    assert again == taken and max(repeats.values()) <= 2
    same = lambda frame: sorted((str(r.doc_id), r.size, r.target, r.taken) for r in frame.collect())
    assert same(found) == same(mix(docs.repartition(11)))


def test_repeated_rows_match_the_sql(spark, tmp_path):
    import duckdb
    from trendloom.llm.oracles import MIX

    rows = [(None if i % 3 else i // 9, "word " * (i % 40 + 1) if i % 5 else "hot text", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = db.sql(f"SELECT doc_id, size, target, taken FROM ({MIX})").fetchall()
    got = [tuple(r) for r in mix(docs).select("doc_id", "size", "target", "taken").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
