import re
import unicodedata

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_cleaning import column
from trendloom.functions import tokens
from trendloom.operators import tfidf
from trendloom.operators.tfidf import Analyzer
from trendloom.plans.queries import QUERIES

LETTER = re.compile(r"\b[a-zA-Z][a-zA-Z\-]{1,}\b")
WORD = re.compile(r"\b[a-zA-Z][\w\-]{1,}\b")
TEXT = st.text(alphabet="abzAZ09-_ .,'éßñ²½Ωx́ \n", max_size=40)


def test_hand_cases(spark):
    text = "straße abc123 a-1 well-known x_y"
    assert column(spark, [text], tokens.letter_tokens) == [["a-", "well-known"]]
    assert column(spark, [text], tokens.word_tokens) == [
        ["straße", "abc123", "a-1", "well-known", "x_y"]
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=100, max_size=200))
def test_tokens_match_python_word_borders(spark, texts):
    assert column(spark, texts, tokens.letter_tokens) == [LETTER.findall(t) for t in texts]
    assert column(spark, texts, tokens.word_tokens) == [WORD.findall(t) for t in texts]


def plain(text):
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def test_accents(spark):
    letters = [chr(code) for code in range(1, 0x250)]
    letters += list("ﬁﬂﬃ") + ["é", "Ａｂｃ１", "𝐀𝐛", "ñandú", "plain"]
    got = column(spark, letters, tokens.strip_accents)
    for letter, result in zip(letters, got):
        want = plain(letter)
        if any(c.isascii() and c.isalnum() for c in want):
            assert result == want, (letter, result, want)
        else:
            # No ASCII letter comes out: the tokenizer sees the same borders.
            assert LETTER.findall(f"ab{result}cd") == LETTER.findall(f"ab{want}cd")


def test_all_scripts(spark):
    texts = ["é㎏ά", None, "", "plain", "한"]
    got = column(spark, texts, tokens.strip_all_accents)
    assert got == [text and plain(text) for text in texts]
    docs = spark.createDataFrame([("㎏ ßé ábc",)], "text string")
    wide = Analyzer(all_scripts=True).tokens(docs, "text").first().tokens
    assert wide == LETTER.findall(plain("㎏ ßé ábc"))


def test_ngrams_bridge_removed_words(spark):
    frame = spark.createDataFrame([("theory of sets",), ("one",), ("",)], "s string")
    frame = frame.select(tokens.letter_tokens(F.col("s")).alias("t"))
    frame = frame.select(tokens.without_words(F.col("t"), ["of", "one"]).alias("t"))
    got = [r.g for r in frame.select(tokens.ngrams(F.col("t"), 1, 2).alias("g")).collect()]
    assert got == [["theory", "sets", "theory sets"], [], []]


def test_two_and_three_grams(spark):
    frame = spark.createDataFrame([(list("abcd"),), (["a"],), (["a", "b"],)], "t array<string>")
    got = [r.g for r in frame.select(tokens.ngrams(F.col("t"), 2, 3).alias("g")).collect()]
    assert got == [["a b", "b c", "c d", "a b c", "b c d"], [], ["a b"]]


def test_runs(spark):
    frame = spark.createDataFrame([(["a", "a", "b"],), ([],), (["z"],)], "o array<string>")
    frame = frame.withColumn("p", tokens.run_starts(F.col("o")))
    got = frame.select(tokens.run_lengths(F.col("o"), F.col("p")).alias("r")).collect()
    assert [[tuple(x) for x in row.r] for row in got] == [[("a", 2), ("b", 1)], [], [("z", 1)]]


AWKWARD = [
    "Straße café naïve x-ray well- a-1 x_y", "ﬁne ŉame ℌello résumé", "中文 word ﻼ after", "힣 한국 tail",
    "one two one two one", "", None, "the of", "tail's end", "“quoted” words—joined … €5 a−b", "ΑΣ σ abc", "İstanbul KELVIN K 𝐛old",
    "Ĳssel ǆ dz ½half", "new \U00031350 letterࡰword x\U0001E4D0y",
]


def test_tallies_add_up_to_the_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD * 3)], "doc_id int, text string").coalesce(2)
    for size in (1, 8 << 20):
        monkeypatch.setattr(tfidf, "TALLY_BYTES", size)
        for analyzer in (tfidf.TERMS, tfidf.PHRASES, Analyzer(all_scripts=True, shortest=2, longest=2), Analyzer(stop_words=(), longest=3)):
            counts = tfidf.term_counts(docs, ["doc_id"], "text", analyzer)
            tallies = tfidf.add_tallies(tfidf.tallied_counts(docs, "text", analyzer))
            assert sorted(tallies.collect()) == sorted(tfidf.term_statistics(counts).collect())


def test_a_slice_gives_one_row_for_each_term():
    found = list(tokens.tallied_ngrams([["a", "b", "a", "b"], ["b", "of", "a"], []], pa.array(["of"]), 1, 2))
    rows = [tuple(row.values()) for batch in found for row in batch.to_pylist()]
    assert sorted(rows) == [("a", 2, 3), ("a b", 1, 2), ("b", 2, 3), ("b a", 2, 2)]


def test_vocabulary_forms_no_row_per_term_of_a_document(spark, sf_dir):
    plan = QUERIES["vocabulary"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_plain_letters_are_those_of_spark(spark):
    texts = [t for t in AWKWARD if t] + ["".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1FFFF)]))]
    assert column(spark, texts, tokens.strip_accents) == [tokens.plain_letters(t, tokens.plain_table()) for t in texts]
