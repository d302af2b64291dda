import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.functions import cleaning

GOLDEN = [
    ("", ""),
    ("  plain   text ", "plain text"),
    (r"\alpha_{s} \leq 5", "alpha s <= 5"),
    (r"$x \geq 1$", "x >= 1"),
    (r"\left( x \right)", "<=ft( x right)"),
    (r"a \cdots b", "a * s b"),
    (r"A \simeq B", "A ~ eq B"),
    (r"A \approxeq B", "A ~ eq B"),
    (r"\top", "to p"),
    (r"x \gets y", "x >=ts y"),
    (r"x \mapsto y", "x -> y"),
    (r"a \pm b", "a +/- b"),
    (r"x\to\infty", "x to infinity"),
    (r"\mathbb{R}", "R"),
    (r"$\mathrm_x$ vs \mathrm_x", "x vs mathrm x"),
    (r"3 \times 10^{(-22)}", "3 e-22"),
    (r"3 \times 10^{-22}", "3 x 10 -22"),
    ("5× 10(-3)", "5e-3"),
    ("5 × 10(-3)", "5 × 10(-3)"),
    (r"\[ x + y \]", "x + y ]"),
    (r"\[ \alpha \]", "alpha \\]"),
    (r"\(f(x)\)", r"\(f(x)\)"),
    (r"\(a+b\) ok", "a+b ok"),
    ("cost $5 and $6 now", "cost 5 and 6 now"),
    ("$$E=mc^2$$", "E=mc 2"),
    ("line\nbreak\xa0nbsp", "line break nbsp"),
]


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    out = rows.select("i", expression(F.col("s")).alias("r")).orderBy("i").collect()
    return [row.r for row in out]


def test_golden_cases(spark):
    got = column(spark, [text for text, _ in GOLDEN], cleaning.clean_text)
    assert got == [want for _, want in GOLDEN]
    assert column(spark, [None], cleaning.clean_text) == [""]


def test_every_space_character_collapses(spark):
    spaces = [chr(code) for code in range(0x110000) if chr(code).isspace()]
    assert sorted(spaces) == sorted(cleaning.SPACE_CHARS)
    texts = [f"{space}a{space}{space}b{space}" for space in spaces]
    assert column(spark, texts, cleaning.clean_text) == ["a b"] * len(texts)
    assert column(spark, texts, cleaning.strip) == [text.strip() for text in texts]


def test_style_words_need_whole_words(spark):
    texts = ["rm", "a rm b", "arm", "rm_", "ÉRM", "Rm-mathBB", "é rm é"]
    want = [re.sub(r"\b(mathbb|mathrm|rm)\b", " ", t, flags=re.I) for t in texts]
    assert column(spark, texts, cleaning.drop_style_words) == want


def test_documents(spark):
    raw = spark.createDataFrame(
        [
            ("0704.0001", "T", None, "cs.LG", "2020-1-5"),
            ("2", None, "", None, ""),
            ("3", " A ", "b  c", "x", None),
        ],
        "id string, title string, abstract string, categories string, update_date string",
    )
    rows = cleaning.clean_documents(raw).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        ("0704.0001", "cs.LG", "T. T.", 2020),
        ("2", None, ". .", None),
        ("3", "x", "A. A. b c", None),
    ]


def test_bad_dates_raise_or_become_null(spark):
    bad = ["2020-13-05", "2020-02-30", "soon"]
    for value in bad:
        with pytest.raises(Exception, match="not a year-month-day date"):
            column(spark, [value], cleaning.year_of)
    years = column(spark, bad + ["1999-12-31"], lambda c: cleaning.year_of(c, "null"))
    assert years == [None, None, None, 1999]
    with pytest.raises(ValueError):
        cleaning.year_of(F.col("s"), "ignore")


ALPHABET = string.ascii_letters + string.digits + "\\\\$$(){}[]_^ \n\té×¹"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=50, max_size=120))
def test_clean_text_never_leaves_scripts_or_wide_gaps(spark, texts):
    for result in column(spark, texts, cleaning.clean_text):
        assert not re.search(r"[{}_^]|\s\s", result)
        assert result == result.strip()
