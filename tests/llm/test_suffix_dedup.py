import hashlib
import random

import numpy as np
import pytest
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm import induced_sorting, suffix_dedup
from trendloom.llm.suffix_dedup import cut_repeats, digests

SMALL = [(3, 20, 4), (7, 1, 2), (50, 100, 10), (1 << 17, 1 << 16, 1 << 21)]


@pytest.mark.parametrize("batch, held, in_memory", SMALL)
def test_suffixes_come_sorted_with_their_prefixes(monkeypatch, batch, held, in_memory):
    """Also when nearly nothing fits in memory."""
    for name, value in (("BATCH", batch), ("HELD", held), ("IN_MEMORY", in_memory)):
        monkeypatch.setattr(induced_sorting, name, value)
    draw = random.Random(batch)
    for _ in range(60):
        letters, depth = draw.choice([b"ab", b"abcdefgh", b"\x00\xff", b"a"]), draw.choice([2, 5, 50])
        strings = [bytes(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 5))]
        text = induced_sorting.Text(depth)
        for string in strings + strings[:2]:
            text.append(np.r_[np.frombuffer(string, np.uint8).astype(np.uint16) + 1, 0])
        text.close()
        found = np.concatenate(list(induced_sorting.sorted_suffixes(text)))
        symbols, n = text.symbols.tolist(), text.size
        at_of, lcp_of = induced_sorting.places(found).tolist(), induced_sorting.prefixes(found).tolist()
        assert sorted(at_of) == list(range(n))
        for before, at, lcp in zip(at_of, at_of[1:], lcp_of[1:]):
            if max(before, at) + depth <= n:
                assert symbols[before : before + depth] >= symbols[at : at + depth]
                common = next((i for i in range(depth) if symbols[before + i] != symbols[at + i]), depth)
                assert lcp == common


def brute(rows, length):
    """(doc_id, bytes, removed, spans, digest of what stays) of each row."""
    owner, found = {}, []
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    rank = lambda doc_id: (doc_id is None, doc_id or 0)
    for doc_id, text in data:
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            owner[window] = min(owner.get(window, rank(doc_id)), rank(doc_id))
    for doc_id, text in data:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if owner[text[i : i + length]] < rank(doc_id):
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        found.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def check(docs, rows, length=50):
    frame = digests(cut_repeats(docs, length))
    assert sorted((tuple(row) for row in frame.collect()), key=repr) == brute(rows, length)


def test_documents_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_many_repeats_against_brute_force(spark):
    draw = random.Random(7)
    passages = ["".join(draw.choice("ab ") for _ in range(draw.randrange(20, 90))) for _ in range(12)]
    rows = [(draw.randrange(60), "".join(draw.choice(passages) for _ in range(draw.randrange(5)))) for _ in range(80)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 30)


def test_awkward_rows(spark):
    rows = [(doc_id, text[:3000] if text else text) for doc_id, text, *_ in ROWS]
    docs = awkward(spark).selectExpr("doc_id", "substring(text, 1, 3000) AS text", "row")
    check(docs, rows)
    whole = digests(cut_repeats(awkward(spark))).collect()
    assert max(r.n_bytes for r in whole) == max(len((row[1] or "").encode()) for row in ROWS)


def test_empty_table(spark):
    assert cut_repeats(empty(spark)).count() == 0


def test_one_hot_id_and_one_passage_in_every_document(spark):
    """Neither an id nor a passage that all rows have is the work of one group."""
    draw = random.Random(11)
    passage = "this passage of more than fifty bytes is a part of every single document here"
    texts = ["".join(draw.choice("abcdefg ") for _ in range(90)) + passage + "".join(draw.choice("xyz ") for _ in range(40)) for _ in range(120)]
    for ids in ([None] * 120, [5] * 60 + [3] * 60, list(range(120))):
        rows = list(zip(ids, texts))
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


@pytest.mark.parametrize("name, value", [("WAITING", 100), ("REMEMBERED", 3), ("BATCH_BYTES", 500)])
def test_small_budgets_change_nothing(monkeypatch, name, value):
    """Slices that stop waiting are sorted; forgotten ones are sorted again."""
    monkeypatch.setattr(suffix_dedup, name, value)
    draw = random.Random(13)
    base = ["".join(draw.choice("ab ") for _ in range(70)) for _ in range(6)]
    shard = suffix_dedup._Shard(0, 50)
    sent, seen = [], {}
    for batch in range(12):
        contents = [draw.choice(base) + draw.choice(["", "a", "bb"]) for _ in range(5)]
        ids = [draw.randrange(30) for _ in contents]
        keys = np.array([base.index(c[:70]) for c in contents], np.uint64)
        shard.add(batch, "".join(contents).encode(), np.array([len(c) for c in contents]), keys, ids)
        sent.append((contents, ids))
        for c, i in zip(contents, ids):
            for at in range(len(c) - 49):
                seen[c[at : at + 50]] = min(seen.get(c[at : at + 50], i), i)
    for (batch, bits), (contents, ids) in zip(shard.answers(), sent):
        want = [seen[c[at : at + 50]] < i for c, i in zip(contents, ids) for at in range(len(c) - 49)]
        assert np.unpackbits(np.frombuffer(bits, np.uint8), count=len(want)).astype(bool).tolist() == want


def test_nothing_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    cut_repeats(documents(spark, "/root/testdata/sf0.001")).count()
    assert {t.name for t in spark.catalog.listTables()} == before
