import random
from collections import Counter

import numpy as np
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm.components import connected_components
from trendloom.llm.dart_minhash import Bands, drop_near_duplicates, elements, near_duplicates, signatures, similarity
from trendloom.llm.text import WORD, WordHashes


def shingles(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0)))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(texts, threshold=0.8):
    """The smallest number in each component of the links, by comparing all pairs."""
    of = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = WORD.findall(texts[i] or "") == WORD.findall(texts[j] or "")
            if of[i] != of[j] and (same or jaccard(sets[i], sets[j]) >= threshold):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def test_elements_and_similarity():
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(30))) for _ in range(40)] + ["", "a", "a b"]
    text, regions = elements(texts, WordHashes())
    sets = [np.sort(regions[text == i]).tobytes() for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            real = jaccard(shingles(texts[i]), shingles(texts[j]))
            if real >= 0.8 or similarity(sets[i], sets[j]) > 0:
                assert shingles(texts[i]) == Counter() or abs(similarity(sets[i], sets[j]) - real) < 1e-9


def test_signatures_estimate_the_similarity():
    size, draw = 2000, np.random.default_rng(2)
    for shared, own in ((900, 50), (30, 10), (1, 3)):
        numbers = draw.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
        first, second = numbers[: shared + own], np.r_[numbers[:shared], numbers[shared + own :]]
        text = np.repeat([0, 1], [len(first), len(second)])
        signed = signatures(text, np.r_[first, second], 2, size)
        real = shared / (shared + 2 * own)
        assert abs((signed[0] == signed[1]).mean() - real) < 4.5 * np.sqrt(real * (1 - real) / size)


def test_a_signature_does_not_depend_on_its_neighbours():
    hashes, texts = WordHashes(), ["a b c d e f g", "", "x " * 3000, "q"]
    together = signatures(*elements(texts, hashes), len(texts), 120)
    for i, text in enumerate(texts):
        assert (signatures(*elements([text], hashes), 1, 120)[0] == together[i]).all()


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {}
    for a, b in edges:
        if a != b:
            of.setdefault(a, a), of.setdefault(b, b)
            low, high = sorted((of[a], of[b]))
            of = {k: low if v == high else v for k, v in of.items()}
    assert found == of
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_brute_force(spark, sf_dir):
    rows = sorted(documents(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    of = classes([r.text for r in rows])
    found = {r.doc_id: r for r in near_duplicates(documents(spark, sf_dir)).collect()}
    sizes = Counter(of)
    for i, row in enumerate(rows):
        got = found[row.doc_id]
        assert (got.class_id, got.class_size, got.kept) == (rows[of[i]].doc_id, sizes[of[i]], of[i] == i)


def test_large_group_of_near_copies(spark):
    """Hundreds of texts share buckets; chains of links join texts that are not near each other."""
    draw, texts, base = random.Random(5), [], [f"w{i}" for i in range(120)]
    for i in range(400):
        words = list(base)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    for i in range(30):  # each differs from the one before only
        base = base[4:] + [f"y{i}.{j}" for j in range(4)]
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = classes(texts)
    assert 20 < len(set(of)) < 100
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == dict(enumerate(of))


def test_awkward_rows(spark):
    rows = near_duplicates(awkward(spark), Bands(8, 3)).collect()
    assert len(rows) == len(ROWS)
    assert {r.class_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert {r.class_id for r in rows if r.doc_id in (1, 2)} == {1}
    per_class = Counter((r.class_id, bytes(r.node)) for r in rows if r.kept)
    assert set(per_class.values()) == {1}
    stay = drop_near_duplicates(awkward(spark))
    assert stay.columns == awkward(spark).columns
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3, 6, 7, 7, 8, 9]


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == drop_near_duplicates(empty(spark)).count() == 0
