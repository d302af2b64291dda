"""Column expressions that turn LaTeX-laden metadata into plain text.

Every function maps a string column to a string column, so a whole cleaning
pass is one projection without a shuffle and without Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.fixed_values import COMMAND, MATH_BLOCKS, RELATION_COMMANDS, STYLE_WORDS

# The characters that count as white space, spelled out because engines
# disagree about ``\s`` outside ASCII.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NOT_SPACE = SPACE.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"

STYLE = rf"(?i)(?<!{WORD})(?:{'|'.join(STYLE_WORDS)})(?!{WORD})"
# "x 10 (-22)"; the multiplication sign is no word character, so it starts a
# word boundary only right after one.
POWER_OF_TEN = (
    rf"(?:(?<!{WORD})x|(?<={WORD})\x{{D7}}){SPACE}*10{SPACE}*"
    rf"\({SPACE}*(-?\p{{Nd}}+){SPACE}*\)"
)
# Marks the borders of a math block while it is processed.
MARK = "\x01"


def strip(c: Column) -> Column:
    """Null becomes empty, white space at both ends goes."""
    return F.trim(F.coalesce(c, F.lit("")), F.lit(SPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def relation_words(c: Column) -> Column:
    """Readable forms of relation commands; prefixes of longer names match too."""
    for command, words in RELATION_COMMANDS:
        c = F.replace(c, F.lit(command), F.lit(words))
    return c


def command_words(c: Column) -> Column:
    return F.regexp_replace(c, COMMAND, "$1")


def drop_style_words(c: Column) -> Column:
    return F.regexp_replace(c, STYLE, " ")


def drop_scripts(c: Column) -> Column:
    """Braces, subscript and superscript signs become spaces."""
    return F.translate(c, "{}_^", "    ")


def repair_powers(c: Column) -> Column:
    return F.regexp_replace(c, POWER_OF_TEN, "e$1")


def _inside_math(c: Column) -> Column:
    # Scripts go before style words here, so a style word glued to a subscript
    # is still recognised.
    plain = drop_style_words(drop_scripts(command_words(relation_words(c))))
    return F.concat(F.lit(" "), collapse_spaces(plain), F.lit(" "))


def math_blocks(c: Column) -> Column:
    """Replace each math block by its cleaned inside.

    A block is framed by a marker; after splitting at the marker the odd parts
    are the insides.  U+0001 in the input is removed first.
    """
    c = F.translate(c, MARK, "")
    for pattern in MATH_BLOCKS:
        parts = F.split(F.regexp_replace(c, pattern, f"{MARK}$1{MARK}"), MARK)
        cleaned = F.transform(
            parts, lambda part, i: F.when(i % 2 == 1, _inside_math(part)).otherwise(part)
        )
        c = F.array_join(cleaned, "")
    return c


def clean_text(c: Column) -> Column:
    """The whole cleaning pass over one string column; null becomes empty."""
    c = math_blocks(relation_words(strip(c)))
    c = drop_scripts(drop_style_words(command_words(c)))
    return collapse_spaces(repair_powers(c))


def weighted_text(title: Column, abstract: Column) -> Column:
    """Title twice, then abstract; two empty inputs give ``. .``."""
    return collapse_spaces(F.concat(title, F.lit(". "), title, F.lit(". "), abstract))


def year_of(c: Column, on_error: str = "raise") -> Column:
    """Year of a ``year-month-day`` string; null or empty gives null."""
    given = F.nullif(c, F.lit(""))
    year = F.year(F.try_to_date(given, "yyyy-M-d"))
    if on_error == "null":
        return year
    if on_error != "raise":
        raise ValueError("on_error must be 'raise' or 'null'")
    message = F.concat(F.lit("not a year-month-day date: "), given)
    return F.when(given.isNotNull() & year.isNull(), F.raise_error(message).cast("int")).otherwise(
        year
    )


def clean_documents(raw: DataFrame, on_error: str = "raise") -> DataFrame:
    """Raw metadata rows to (id, categories, text, update_year), batch or stream."""
    cleaned = raw.select(
        "id",
        "categories",
        clean_text(F.col("title")).alias("title"),
        clean_text(F.col("abstract")).alias("abstract"),
        year_of(F.col("update_date"), on_error).alias("update_year"),
    )
    return cleaned.select(
        "id",
        "categories",
        weighted_text(F.col("title"), F.col("abstract")).alias("text"),
        "update_year",
    )
