import random

import numpy as np
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm.repetition import Limits, good_documents, measure, repetition, suffix_array
from trendloom.llm.text import WORD


def brute(text, window=8):
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + window)}
    longest = 0
    for i in range(len(words)):
        for j in range(i):
            n = 0
            while i + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            longest = max(longest, n)
    return len(words), len(covered), longest if longest >= window else 0


def test_suffix_array_is_sorted_with_its_prefixes():
    draw = random.Random(1)
    for _ in range(200):
        texts = [[draw.randrange(3) for _ in range(draw.randrange(15))] for _ in range(draw.randrange(5))]
        ids = np.array([w for t in texts for w in t], np.int64)
        text = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
        order, lcp = suffix_array(ids, text)
        suffixes = [(k, t[i:]) for k, t in enumerate(texts) for i in range(len(t))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        for rank in range(1, len(order)):
            (k, a), (m, b) = suffixes[order[rank - 1]], suffixes[order[rank]]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[rank] == (common if k == m else 0)


def test_measures_against_brute_force():
    draw = random.Random(2)
    texts = []
    for _ in range(60):
        phrase = " ".join(draw.choice("abcd") for _ in range(draw.randrange(1, 25)))
        noise = " ".join(str(draw.random()) for _ in range(draw.randrange(40)))
        texts.append(" ".join(draw.choice([phrase, noise]) for _ in range(draw.randrange(5))))
    found = measure(texts, Limits())
    for i, text in enumerate(texts):
        n, repeated, longest = brute(text)
        assert (found["n_words"][i], found["n_repeat_words"][i], found["longest_repeat"][i]) == (n, repeated, longest)
        base_failed = n < 20 or 100 * repeated > 30 * n
        assert found["base_failed"][i] == base_failed
        good = repeated <= 0.25 * n and longest <= 400
        assert found["kept"][i] == (not base_failed and good)


def test_counts():
    found = measure(["Ab #*\n\nAb #*\n \nc <c>\nAb #*"], Limits())
    assert {k: int(v[0]) for k, v in found.items() if k[0] in "nw"} == {
        "n_words": 8, "word_chars": 2 * 6 + 4, "n_symbols": 8, "n_dup_lines": 2, "n_repeat_words": 0,
    }


def test_one_long_repeat_fails():
    words = [f"w{i}" for i in range(4000)]
    text = " ".join(words + words[:500])
    assert not measure([text], Limits())["kept"][0]
    assert measure([" ".join(words)], Limits())["kept"][0]


def test_awkward_rows(spark):
    rows = repetition(awkward(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in rows) == sorted(
        (row[0] or -1, len(WORD.findall(row[1] or ""))) for row in ROWS
    )
    assert not any(r.kept for r in rows)
    assert good_documents(awkward(spark)).columns == awkward(spark).columns
    assert repetition(empty(spark)).count() == good_documents(empty(spark)).count() == 0


def test_good_documents_are_the_kept_ones(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = {r.doc_id for r in repetition(docs).filter("kept").collect()}
    assert {r.doc_id for r in good_documents(docs).collect()} == kept
    # Documents of good quality stay.
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()
    assert sum(r.doc_id in kept for r in labels) > 0.9 * len(labels)
