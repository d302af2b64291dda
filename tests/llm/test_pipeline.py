import re
from collections import Counter

import corpus_pipeline
from tests.llm.awkward import awkward, documents, empty
from tests.llm.test_dart_minhash import classes
from tests.llm.test_repetition import brute
from trendloom.llm.pareto_mix import mix
from trendloom.session import materialize


def staged(spark, docs):
    """What each stage returns, written and read again."""
    found = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, ""), f"test-stage-{number}")
        found.append(docs)
    return found


def test_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    good, distinct, apart, mixed, packed = staged(spark, docs)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    keep = []
    for row in rows:
        n, repeated, longest = brute(row.text)
        if n >= 20 and repeated <= 0.25 * n and longest <= 400:
            keep.append(row)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in keep}
    first = {}
    for row in keep:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row.text), row)
    assert {r.doc_id for r in distinct.collect()} == {r.doc_id for r in first.values()}
    left = sorted(first.values(), key=lambda r: r.doc_id)
    of = classes([r.text for r in left])
    assert {r.doc_id for r in apart.collect()} == {r.doc_id for i, r in enumerate(left) if of[i] == i}
    copies = {r.doc_id: r.copies for r in mix(apart).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == copies
    assert all(frame.columns == docs.columns for frame in (good, distinct, apart, mixed))
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.select("doc_id", "piece", "n_tokens").collect())) == sorted(
        map(tuple, packed.select("doc_id", "piece", "n_tokens").collect())
    )


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        frames = staged(spark, docs)
        assert all(frame.columns == docs.columns for frame in frames[:-1])


def test_every_stage_takes_awkward_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, awkward(spark), "").count()
        assert stage(spark, empty(spark), "").count() == 0
