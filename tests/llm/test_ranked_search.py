import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm.best_position import ImpactLists
from trendloom.llm.ranked_search import ranked_search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("step", [1, 3, 16])
def test_best_positions_equal_scoring_all(step):
    draw = np.random.default_rng(step)
    for _ in range(80):
        n_terms, n_docs = int(draw.integers(1, 9)), int(draw.integers(1, 60))
        cells = np.flatnonzero(draw.random(n_terms * n_docs) < draw.random())
        terms, docs = cells // n_docs, cells % n_docs
        impacts = draw.integers(1, draw.choice([3, 500]), len(cells))
        lists = ImpactLists(terms, docs, impacts, n_terms, n_docs)
        asked = draw.permutation(n_terms)[: draw.integers(1, n_terms + 1)]
        factors = draw.integers(0, 5, len(asked))
        score = np.zeros(n_docs, np.int64)
        for term, factor in zip(asked, factors):
            np.add.at(score, docs[terms == term], impacts[terms == term] * factor)
        k = int(draw.integers(1, 8))
        wanted = sorted(((int(s), d) for d, s in enumerate(score) if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert lists.best(asked, factors, k, step)[0] == wanted


def test_reading_stops_early():
    draw = np.random.default_rng(1)
    impacts = np.sort(draw.pareto(1.0, 5000) * 100).astype(np.int64) + 1
    lists = ImpactLists(np.repeat([0, 1], 5000), np.tile(np.arange(5000), 2), np.r_[impacts, impacts[::-1]], 2, 5000)
    found, scored = lists.best(np.array([0, 1]), np.array([1, 1]), 5)
    assert len(found) == 5 and scored < 1000


def test_places_seen_by_direct_access_count():
    """Equal lists: each round's documents are seen in both, so positions lead what was read."""
    n = 64
    lists = ImpactLists(np.repeat([0, 1], n), np.tile(np.arange(n), 2), np.tile(np.arange(n, 0, -1), 2), 2, n)
    assert lists.best(np.array([0, 1]), np.array([1, 1]), 4, 4) == ([(128, 0), (126, 1), (124, 2), (122, 3)], 4)


def brute(docs, queries, k=10):
    lower = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    counts = [Counter(TERM.findall(lower(text))) for _, text in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(term for c in counts for term in c)
    found = []
    for item, text in queries:
        scores = []
        asked = Counter(TERM.findall(lower(text)))
        for (doc, _), c, n in zip(docs, counts, sizes):
            score = 0
            for term, times in asked.items():
                if term in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 25 + (75 * n * n_docs) // n_terms
                    score += times * w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        found += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


def check(found, docs, queries):
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, queries)


def test_against_brute_force_over_many_shards(spark):
    draw = random.Random(3)
    words = ["The", "the", "a", "Ärger", "x1", "ñ", "rare", *(f"w{i}" for i in range(40))]
    text = lambda n: draw.choice([" ", ", ", "-"]).join(draw.choices(words, [40, 30, 20, *[1] * 44], k=n))
    docs = [(draw.choice([i, i, i, None, 5]), text(draw.randrange(30))) for i in range(300)]
    docs += [(1000 + i, "the same text of many copies rare") for i in range(60)] + [(2000, None), (2001, " .,;")]
    queries = [(i, text(draw.randrange(1, 12))) for i in range(20)] + [(7, "rare rare the"), (None, "w1 w2"), (50, None), (51, "unknown")]
    frames = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (queries, "item_id"))]
    check(ranked_search(*frames, shard_postings=200), docs, queries)


def test_awkward_rows_and_extra_columns(spark):
    queries = [(1, "the quick brown fox"), (2, "Qué 123"), (3, "lorem ipsum"), (4, "é \x00a")]
    frame = spark.createDataFrame(queries, "item_id long, text string").withColumn("row", F.lit("x"))
    check(ranked_search(awkward(spark), frame), [r[:2] for r in ROWS], queries)


def test_empty_tables(spark):
    queries = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(empty(spark), queries).count() == 0
    assert ranked_search(awkward(spark), queries.limit(0)).count() == 0


def test_documents_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    frame = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(8)
    check(ranked_search(documents(spark, sf_dir), frame), docs, [(r.item_id, r.text) for r in frame.collect()])


def test_terms():
    assert terms_of("Don't ÄB_c d 4.5") == [x.encode() for x in ("don", "t", "Äb", "c d", "4", "5")]
