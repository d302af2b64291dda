import re
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm.rank_order_language import held_out, identify, predict, profiles


def ngrams(text):
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        found.update(word)
        found.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return found


def nearest(text, learned, length):
    own = sorted(ngrams(text).items(), key=lambda item: (-item[1], len(item[0]), item[0]))[:length]
    best = None
    for lang in sorted(learned):
        there = learned[lang]
        apart = sum(abs(there[g] - k) if g in there else length for k, (g, _) in enumerate(own))
        best = min(best or (apart, lang), (apart, lang))
    return best[1], 1 - best[0] / (length * len(own))


def test_against_brute_force(spark, sf_dir):
    docs, length = documents(spark, sf_dir), 100
    training = docs.filter("doc_id < 60").select("lang", "text")
    counted = {}
    for row in training.collect():
        counted.setdefault(row.lang, Counter()).update(ngrams(row.text))
    expected = {
        lang: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda i: (-i[1], i[0]))[:length])}
        for lang, c in counted.items()
    }
    learned = profiles(training, length)
    assert {(r.lang, r.ngram): r.place for r in learned.collect()} == {
        (lang, g): k for lang, places in expected.items() for g, k in places.items()
    }
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in predict(docs, learned, length).collect():
        lang, score = nearest(texts[row.doc_id], expected, length)
        assert row.lang_pred == lang and abs(row.score - score) < 1e-12


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    rows = identify(awkward(spark)).collect()
    assert len(rows) == len(ROWS)
    langs = {row[2] for row in ROWS if row[2]}
    letters = {row[0]: any(unicodedata.category(c)[0] == "L" for c in row[1] or "") for row in ROWS}
    for row in rows:
        if row.doc_id is not None:
            assert (row.lang_pred in langs) if letters[row.doc_id] else (row.lang_pred, row.score) == ("und", 0.0)


def test_nothing_to_learn_from(spark):
    assert identify(empty(spark)).count() == 0
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}


def test_only_training_folds_are_learned(spark):
    docs = awkward(spark).filter(held_out()).withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in identify(docs).collect()} <= {"und"}
