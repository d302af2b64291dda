import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.awkward import ROWS, awkward, empty
from trendloom.llm.rank_order_language import held_out
from trendloom.llm.toxicity_neighbours import (
    TERM,
    Index,
    Settings,
    Vectors,
    Vocabulary,
    labelled_sample,
    learn,
    monotone_curve,
    score,
    term_hash,
    terms_of,
    vote,
)

LABELS = "doc_id long, toxic int, quality int, text string"


def rows_of(dicts):
    terms = [sorted(d) for d in dicts]
    flat = [d[t] for d, of in zip(dicts, terms) for t in of]
    return Vectors(np.cumsum([0, *map(len, terms)]), np.array([t for of in terms for t in of], np.int64), np.array(flat, float))


def cosines(query, examples):
    return [sum(w * example.get(t, 0.0) for t, w in query.items()) for example in examples]


@pytest.mark.parametrize("n_terms, most", [(12, 5), (400, 30)])
def test_search_is_exact(n_terms, most):
    """Few terms, all frequent, and many of very different frequency; ties go by place."""
    draw, rows = random.Random(1), []
    for i in range(700):
        terms = {int(n_terms * draw.random() ** 3) for _ in range(draw.randrange(1, most))}
        weights = {t: draw.choice([1.0, 2.0, 0.5]) for t in terms}
        length = math.sqrt(sum(w * w for w in weights.values()))
        rows.append({t: w / length for t, w in weights.items()})
    index = Index.build(rows_of(rows), list(range(700)), np.arange(700), np.arange(700) % 2, n_terms, 16)
    assert (index.toxic == np.array(index.ids) % 2).all() and (index.keys == index.ids).all()
    queries = rows[:300] + [{}]
    for query, (places, found) in zip(queries, index.nearest(rows_of(queries), 20), strict=True):
        all_of = cosines(query, rows)
        assert np.allclose(found, sorted((s for s in all_of if s > 1e-12), reverse=True)[:20], atol=1e-6)
        assert np.allclose([all_of[index.ids[p]] for p in places], found, atol=1e-6)
        assert list(places) == [p for _, p in sorted(zip(-found, places))]


def test_unlike_blocks_stay_closed():
    """Blocks whose bound is below the k-th sum so far are not opened."""
    rows = [{g: 0.6, 50 + 40 * g + i % 40: 0.8} for g in range(8) for i in range(64)]
    index = Index.build(rows_of(rows), list(range(512)), np.arange(512), np.zeros(512), 400, 64)
    opened = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, (int, np.integer)):
                opened.append(int(at))
            return np.asarray(self)[at]

    index.maxima  # made from the blocks before they are watched
    index.blocks = index.blocks.view(Watched)
    ((places, found),) = index.nearest(rows_of([rows[70]]), 2)
    assert 70 in [index.ids[p] for p in places] and abs(found[0] - 1) < 1e-6 and len(set(opened)) < 8


def test_terms_of_any_script():
    latin = "".join(map(chr, range(256)))
    for text in ["", latin, f"a{latin}b{latin}", "It's 2nd_try", "\xa0x\x85y\x1cz", "Straße ΑΣ ümlaut 中文 x٣y İ", "\u2028a\u2003b"]:
        assert terms_of(text) == TERM.findall(text.lower())


def test_each_different_word_is_looked_up_once():
    looked_up = []

    class Watched(np.ndarray):
        def searchsorted(self, values, *args, **kwargs):
            looked_up.append(len(values))
            return np.asarray(self).searchsorted(values, *args, **kwargs)

    hashes = np.sort(np.array([term_hash(x) for x in ("ein", "über", "word")], np.uint64))
    some = Vocabulary(hashes.view(Watched), np.ones(3, np.float32), hashes == term_hash("word"), 0.8, frozenset({"word"}))
    vectors = some.vectors(["Über word new " * 500, "", "new", "ein ein"])
    assert looked_up == [4] and np.diff(vectors.starts).tolist() == [2, 0, 0, 1]
    found = dict(zip(hashes[vectors.terms[:2]].tolist(), vectors.weights[:2]))
    assert np.allclose([found[term_hash("word")] ** 2, found[term_hash("über")] ** 2, vectors.weights[2]], [0.8, 0.2, 1.0])
    assert not len(some.vectors([]).terms)


def test_curve_never_falls():
    votes = [0.0, 0.1, 0.2, 0.2, 0.5, 0.7, 0.9, 1.0, 1.0]
    steps, values = monotone_curve(votes, [0, 1, 0, 0, 0, 1, 0, 1, 1])
    assert steps == sorted(steps) and values == sorted(values) and 0 < values[0] < values[-1] < 1


def made_up(spark, n=1200):
    """Documents of random words; the toxic ones have one of three marked words."""
    draw, rows = random.Random(4), []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"w{draw.randrange(400)}" for _ in range(60)] + [draw.choice(["vile", "nasty", "foul"])] * toxic
        draw.shuffle(words)
        rows.append((i, " ".join(f"{chr(97 + int(w[1:]) % 26)}{'xyz'[int(w[1:]) % 3]}{chr(97 + int(w[1:]) // 26)}" if w[0] == "w" else w for w in words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(spark):
    rows = made_up(spark)
    model = learn(rows.select("doc_id", "text"), rows.filter("doc_id < 900").select("doc_id", "toxic"))
    found = score(rows, model).join(rows.select("doc_id", "toxic"), "doc_id").filter(held_out()).collect()
    assert sum(r.predicted == r.toxic for r in found) > 0.98 * len(found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.evidence_ids for r in found if r.predicted)


def labelled_toxic(texts):
    """Labelled toxic rows with ids that are not held out, one for each text."""
    ids = (i for i in range(10_000, 100_000) if zlib.crc32(str(i).encode()) % 5)
    return [(i, text, 1) for i, text in zip(ids, texts)]


def test_copies_take_no_words_away(spark):
    rows, draw = made_up(spark), random.Random(6)
    other = [f"copied{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    exact, wordless = " ".join(["vile", *other[:30]]), " ".join(other[30:])
    near = []
    for i in range(200):
        words = [other[j] for j in range(30)] + ["nasty"]
        words[draw.randrange(30)] = f"edit{chr(97 + i // 26)}{chr(97 + i % 26)}"
        near.append(" ".join(words))
    copies = spark.createDataFrame(labelled_toxic([exact] * 150 + [wordless] * 150 + near), rows.schema)
    all_rows = rows.union(copies)
    labels = all_rows.filter("doc_id < 900 OR doc_id >= 10000").select("doc_id", "toxic")
    model = learn(all_rows.select("doc_id", "text"), labels)
    assert {"vile", "nasty", "foul"} <= model.vocabulary.marks
    found = score(all_rows, model).join(all_rows.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == r.toxic for r in held) > 0.98 * len(held)
    assert all(r.predicted and r.evidence_ids for r in found if r.doc_id >= 10_000)


def test_many_words_of_copies_push_none_out(spark):
    rows, groups = made_up(spark), []
    for group in "abc":
        words = [f"{group}q{''.join(chr(97 + i // 26**j % 26) for j in range(3))}" for i in range(2000)]
        for i in range(130):
            edit = f"edit{chr(97 + i // 26)}{chr(97 + i % 26)}"
            groups.append(" ".join([edit if j % 130 == i else word for j, word in enumerate(words)]))
    all_rows = rows.union(spark.createDataFrame(labelled_toxic(groups), rows.schema))
    labels = all_rows.filter("doc_id < 900 OR doc_id >= 10000").select("doc_id", "toxic")
    model = learn(all_rows.select("doc_id", "text"), labels)
    assert {"vile", "nasty", "foul"} <= model.vocabulary.marks


def test_sample_is_bounded_in_rows(spark):
    rows = [(1, f"text {i % 50}") for i in range(100)] + [(i, f"other {i}") for i in (2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, toxic int")
    found = [r.text for r in labelled_sample(docs, labels, 20).collect()]
    assert len(found) == len(set(found)) == 20


def test_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = score(docs.join(labels, "doc_id", "left_semi"), learn(docs, labels))
    found = found.join(labels, "doc_id").filter(held_out()).collect()
    toxic = [r for r in found if r.toxic]
    # Some labels are wrong: these texts have none of the words that the others share.
    assert sum(r.predicted for r in toxic) > 0.9 * len(toxic)
    assert sum(r.predicted for r in found if not r.toxic) < 0.005 * len(found)


def test_brute_force(spark):
    """Scores and evidence of all documents against cosines of all pairs."""
    folder, settings = "/root/testdata/sf0.001", Settings(neighbours=7)
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = learn(docs, labels, settings)
    words = model.vocabulary
    number = {h: i for i, h in enumerate(words.hashes.tolist())}

    def vector(text):
        raw = {}
        for term, count in Counter(terms_of(text or "")).items():
            if term_hash(term) in number:
                raw[number[term_hash(term)]] = (1 + math.log(count)) * words.idf[number[term_hash(term)]]
        parts = [{t: w for t, w in raw.items() if words.marked[t] == side} for side in (False, True)]
        shares = [1 - settings.marked, settings.marked] if all(parts) else [1.0, 1.0]
        return {t: w * math.sqrt(share / sum(x * x for x in part.values())) for part, share in zip(parts, shares) for t, w in part.items()}

    examples = labelled_sample(docs, labels, settings.examples).collect()
    terms = {term for e in examples for term in terms_of(e.text)}
    assert set(map(term_hash, terms)) == set(number)
    place = {key: i for i, key in enumerate(model.index.keys.tolist())}
    known = sorted((e for e in examples if terms_of(e.text)), key=lambda e: place[e.key])
    vectors = [vector(e.text) for e in known]
    toxic = np.array([e.toxic for e in known], float)
    assert model.index.ids == [e.doc_id for e in known] and (model.index.toxic == toxic).all()

    def nearest(query, without=None):
        near = np.array(cosines(query, vectors))
        if without is not None:
            near[without] = -1
        best = [p for p in np.lexsort((np.arange(len(near)), -near.round(6)))[: settings.neighbours] if near[p] > 1e-9]
        return best, near[best]

    own = [nearest(query, i) for i, query in enumerate(vectors)]
    steps, values = monotone_curve(
        [round(vote(toxic[best], near, settings), 4) for best, near in own if best], [toxic[i] for i, (best, _) in enumerate(own) if best]
    )
    assert np.allclose(np.interp(steps, model.curve[0], model.curve[1]), values, atol=0.05)
    found = {r.doc_id: r for r in score(docs, model).collect()}
    texts = docs.collect()
    assert len(found) == len(texts)
    for row in texts:
        best, near = nearest(vector(row.text))
        got = found[row.doc_id]
        assert np.allclose(got.evidence_similarity, near[:3], atol=1e-5)
        if best:
            share = vote(toxic[best], near, settings)
            at = [model.curve[1][max(0, int(np.searchsorted(model.curve[0], share + e, side="right")) - 1)] for e in (-1e-4, 1e-4)]
            assert at[0] - 1e-9 <= got.score <= at[1] + 1e-9


def test_edited_copy_finds_its_text(spark):
    """Without its marked word, too, and clean texts as well."""
    rows = made_up(spark)
    labels = rows.filter("doc_id < 900").select("doc_id", "toxic")
    model = learn(rows.select("doc_id", "text"), labels)
    taught = [r for r in rows.filter(~held_out()).filter("doc_id < 900").collect()][:150]
    edited = [(r.doc_id, " ".join([w for w in r.text.split() if w not in ("vile", "nasty", "foul")][1:])) for r in taught]
    found = score(spark.createDataFrame(edited, "doc_id long, text string"), model).collect()
    assert all(r.evidence_ids[0] == r.doc_id for r in found)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0, None), (1, 0, 1, "x"), (None, 1, 0, ""), (2, None, 0, ""), (8, 0, 0, ""), (99, 1, 1, "")], LABELS)
    rows = score(awkward(spark), learn(awkward(spark), labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], LABELS)
    assert score(empty(spark), learn(empty(spark), nothing)).count() == 0
    rows = score(awkward(spark), learn(awkward(spark), nothing)).select(F.countDistinct("score")).first()
    assert rows[0] == 1


def test_text_ids(spark):
    """Evidence has the ids' type."""
    rows = [(f"d{i}", "you idiot scum " + "w" * (i % 7) if i % 2 else f"a fine day {i % 9} here") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = docs.selectExpr("doc_id", "cast(text LIKE 'you%' AS int) AS toxic")
    found = score(docs, learn(docs, labels))
    assert dict(found.dtypes)["evidence_ids"] == "array<string>" and found.count() == 200
    assert any(r.evidence_ids for r in found.collect())
