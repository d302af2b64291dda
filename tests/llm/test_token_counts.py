import random

import pytest
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm import token_counts
from trendloom.llm.token_counts import TOKENIZER, WordCounts, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


PARTS = [
    "a", "Haus", "n.", "né,", "ÿ!", "B'", "'s", "́", "é", " ", "\n", "\x85", "\x1c", " ", "​", "12", "½",
    "Σ", "ΑΣ", "<|endoftext|>", "<|endof", "text|>", "<|startoftext|>", "İ", "ﬁ", "漢", "한", "ᄀ", "ᅡ", "😀", "$$", "...", "\x00",
]


def test_counts_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CALL_BYTES", 200)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3000)
    draw, counts = random.Random(1), WordCounts(tokenizer_path(TOKENIZER))
    for _ in range(30):
        texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(12))) for _ in range(200)]
        assert counts.of(texts).tolist() == [library(text) for text in texts]


def test_documents(spark, sf_dir, library):
    docs = documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in token_counts.token_counts(docs).collect():
        n = library(texts[row.doc_id])
        assert (row.n_tokens, row.over_limit) == (n, n > 2048)


def test_awkward_rows(spark, library):
    rows = token_counts.token_counts(awkward(spark)).collect()
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows)
    assert found == sorted((row[0] or -1, len((row[1] or "").encode()), library(row[1] or "")) for row in ROWS)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_what_a_file_does_is_asked_of_it(library, monkeypatch):
    """A mark that is no token of its own, or words without an end, take the general way."""
    counts = WordCounts(tokenizer_path(TOKENIZER))
    assert counts.by_letters and counts.marks == set(token_counts.MARKS)
    texts = ["the house. Was, it?", "x!", "né;"]
    want = [library(text) for text in texts]
    counts.marks = set()
    assert counts.of(texts).tolist() == want
    counts.known.clear()
    counts.by_letters = False
    assert counts.of(texts).tolist() == want
