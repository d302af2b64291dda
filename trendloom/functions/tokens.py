"""Tokens, stop words and n-grams as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trendloom.functions.cleaning import WORD

# A word border after the last character: a letter needs a non-word follower, a
# hyphen needs a word follower.
_BORDER = rf"(?:(?<={WORD})(?!{WORD})|(?<=-)(?={WORD}))"
LETTER_TOKENS = rf"(?<!{WORD})[a-zA-Z][a-zA-Z\-]+{_BORDER}"
WORD_TOKENS = rf"(?<!{WORD})[a-zA-Z][\p{{L}}\p{{N}}_\-]+{_BORDER}"

# The same for Python's engine, in texts without characters of scripts to which later
# versions of Unicode than Java's have added letters or numbers.
PYTHON_LETTER_TOKENS = r"\b[a-zA-Z][a-zA-Z\-]+\b"
PYTHON_WORD_TOKENS = r"\b[a-zA-Z][\w\-]+\b"
NOT_ASCII = re.compile(r"[^\x00-\x7F]+")
OTHER_SCRIPTS = (r"[\u0600-\u1FFF]", r"[\x{2C00}-\x{10FFFF}]")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """(from, to, deleted marks, longer replacements) derived from the Unicode data.

    Covers what can matter to a tokenizer of ASCII letters: characters whose
    compatibility decomposition without marks is one ASCII character, the
    combining marks themselves, and Latin letters and ligatures that decompose
    into several characters.
    """
    source, target, marks, longer = [], [], [], []
    for code in range(0x80, 0x1FFFF):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.combining(char):
            marks.append(char)
            continue
        plain = "".join(
            x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x)
        )
        if plain == char or not any(x.isascii() and x.isalnum() for x in plain):
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif code < 0x250 or 0xFB00 <= code <= 0xFB06:
            longer.append((char, plain))
    return "".join(source), "".join(target), "".join(marks), tuple(longer)


def strip_accents(c: Column) -> Column:
    """Letters without their marks; ASCII-only strings pass untouched.

    Expects a plain column reference: the expression uses it more than once.
    """
    source, target, marks, longer = _accent_table()
    plain = F.translate(c, source + marks, target)
    several = "[" + "".join(char for char, _ in longer) + "]"
    expanded = c
    for char, text in longer:
        expanded = F.replace(expanded, F.lit(char), F.lit(text))
    expanded = F.translate(expanded, source + marks, target)
    return (
        F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(c.rlike(several), expanded).otherwise(plain)
    )


@lru_cache(maxsize=1)
def plain_table() -> dict[int, str]:
    """What ``plain_letters`` replaces, made by the driver."""
    source, target, marks, longer = _accent_table()
    table = dict(zip(map(ord, source), target)) | dict.fromkeys(map(ord, marks), "")
    return table | {ord(char): text.translate(table) for char, text in longer}


def has_other_scripts(c: Column) -> Column:
    # One range each: Java takes ten times as long for a class of several.
    return F.coalesce(c.rlike(OTHER_SCRIPTS[0]) | c.rlike(OTHER_SCRIPTS[1]), F.lit(False))


def plain_letters(text: str, table: dict[int, str]) -> str:
    """``strip_accents`` of one Python string."""
    return text if text.isascii() else NOT_ASCII.sub(lambda run: run[0].translate(table), text)


@F.pandas_udf(StringType())
def strip_all_accents(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, for every character there is."""
    decomposed = texts.str.normalize("NFKD")
    return decomposed.map(
        lambda text: text and "".join(c for c in text if not unicodedata.combining(c))
    )


def letter_tokens(c: Column) -> Column:
    """Words of two or more ASCII letters and hyphens that start with a letter."""
    return F.regexp_extract_all(c, F.lit(LETTER_TOKENS), F.lit(0))


def word_tokens(c: Column) -> Column:
    """A letter, then one or more word characters or hyphens."""
    return F.regexp_extract_all(c, F.lit(WORD_TOKENS), F.lit(0))


def without_words(tokens: Column, words) -> Column:
    """Tokens that are not in ``words`` (a hashed set lookup per token)."""
    words = sorted(set(words))
    if not words:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(words))


def ngrams(tokens: Column, shortest: int, longest: int) -> Column:
    """All runs of ``shortest`` to ``longest`` tokens, joined by one space.

    Expects a plain column reference: the expression uses it more than once.
    """
    if not 1 <= shortest <= longest:
        raise ValueError("need 1 <= shortest <= longest")
    grams, wanted = tokens, []
    for n in range(1, longest + 1):
        if n > 1:
            count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), count),
                F.slice(tokens, F.lit(n), count),
                lambda left, right: F.concat(left, F.lit(" "), right),
            )
        if n >= shortest:
            wanted.append(grams)
    return wanted[0] if len(wanted) == 1 else F.concat(*wanted)


def tallied_ngrams(
    tokens: list[list[str]], stop_words: pa.Array, shortest: int, longest: int
) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of the n-grams of each length over all token lists, without the stop words."""
    for terms, df, cf, *_ in counted_ngrams(tokens, stop_words, shortest, longest):
        yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(cf)], ["term", "df", "cf"])


def counted_ngrams(
    tokens: list[list[str]], stop_words: pa.Array, shortest: int, longest: int
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, df, cf) of the n-grams of each length over all token lists, without the stop words,
    and (list, term, tf), the numbers of a list and a term that occurs in it and how often.

    An n-gram is the number of its first n - 1 words and that of its last one; its text is
    made once for all lists.
    """
    if not 1 <= shortest <= longest:
        raise ValueError("need 1 <= shortest <= longest")
    row = np.repeat(np.arange(len(tokens)), [len(found) for found in tokens])
    encoded = pa.array(list(chain.from_iterable(tokens)), pa.string()).dictionary_encode()
    words, word = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    kept = ~pc.is_in(words, value_set=stop_words).to_numpy(zero_copy_only=False)[word]
    row, word = row[kept], word[kept]
    # The gram that starts at each place, where its list is long enough.
    terms, gram, place = words, word, np.arange(len(word))
    for n in range(1, longest + 1):
        if n > 1:
            inside = place + n - 1 < len(row)
            inside[inside] = row[place[inside]] == row[place[inside] + n - 1]
            gram, place = gram[inside], place[inside]
            pairs, gram = np.unique(gram * len(words) + word[place + n - 1], return_inverse=True)
            first, following = terms.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words)))
            terms = pc.binary_join_element_wise(first, following, " ")
        if n >= shortest and len(gram):
            cf = np.bincount(gram, minlength=len(terms))
            once = np.sort(gram * len(tokens) + row[place])
            starts = np.flatnonzero(np.r_[True, once[1:] != once[:-1]])
            tf = np.diff(np.r_[starts, len(once)])
            found, listed = np.divmod(once[starts], len(tokens))
            df = np.bincount(found, minlength=len(terms))
            used = np.flatnonzero(cf)  # not the stop words
            number = np.cumsum(cf > 0) - 1
            yield terms.take(pa.array(used)), df[used], cf[used], listed, number[found], tf


def run_starts(ordered: Column) -> Column:
    """Positions at which a new value starts in a sorted array."""
    return F.array_compact(
        F.transform(
            ordered,
            lambda value, i: F.when((i == 0) | (value != F.get(ordered, i - 1)), i),
        )
    )


def run_lengths(ordered: Column, starts: Column) -> Column:
    """(term, tf) for each run of a sorted array, given its run starts."""
    return F.transform(
        starts,
        lambda start, i: F.struct(
            F.get(ordered, start).alias("term"),
            (F.coalesce(F.get(starts, i + 1), F.size(ordered)) - start).alias("tf"),
        ),
    )
