"""Quality rules on repetition inside a text, from a suffix array of its words.

The words of the texts of one slice are numbered and their suffixes sorted by
prefix doubling; only suffixes that still tie inside their own text are sorted
again.  Neighbours in the suffix array have longest common prefixes, and the
intervals of these prefixes are the repeated substrings: the longest repeat that
starts at a word is the larger of its two neighbouring prefixes, and it is
maximal if the word before does not extend it.  The spans of all maximal repeats
are united.  A text fails if the united spans hold too large a part of its words
or if one repeat is too long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trendloom.llm.text import WORD, byte_slices, texts_of

SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 8
MIN_WORDS = 20
BASE_PERCENT = 30


@dataclass(frozen=True)
class Limits:
    """Repeats of at least ``window`` words count; both limits are inclusive."""

    window: int = BASE_WINDOW
    max_fraction: float = 0.25
    max_longest: int = 400


def suffix_array(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, by text and then by words, and common prefix lengths.

    ``ids`` are word numbers, ``text`` the number of each word's text, ascending.
    A suffix ends with its text.  ``lcp[i]`` belongs to the suffixes at ranks
    ``i - 1`` and ``i``, 0 if they are of different texts.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = _heads(key[order], np.arange(n))
    levels, step, active = [rank.copy()], 1, _tied(rank[order], order)
    while len(active):
        ahead = active + step
        inside = ahead < n
        inside[inside] = text[ahead[inside]] == text[active[inside]]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[active].astype(np.int64) * (n + 1) + second
        by_key = np.argsort(key, kind="stable")
        active, key = active[by_key], key[by_key]
        first = key // (n + 1)
        # A group keeps its places: the first at its rank, the others after it.
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        places = first + np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        order[places] = active
        rank[active] = _heads(key, places)
        step *= 2
        active = _tied(rank[active], active)
        levels.append(rank.copy())
    left, right = order[:-1].copy(), order[1:].copy()
    same = text[left] == text[right]
    length = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(same & (left < n) & (right < n))
        at, to = left[inside], right[inside]
        equal = levels[level][at] == levels[level][to]
        inside = inside[equal]
        left[inside] += 1 << level
        right[inside] += 1 << level
        length[inside] += 1 << level
    return order, np.r_[0, length]


def _heads(sorted_keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each key the place of the first key that equals it."""
    new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    return places[np.flatnonzero(new)[np.cumsum(new) - 1]]


def _tied(sorted_ranks: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The items whose rank another one has, in order."""
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    return items[np.r_[same, False] | np.r_[False, same]]


def repeats(ids: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeats of at least ``window`` words, by start."""
    order, lcp = suffix_array(ids, text)
    longest = np.zeros(len(ids), np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
    extended = np.r_[False, (longest[:-1] > longest[1:]) & (text[:-1] == text[1:])] if len(ids) else longest > 0
    starts = np.flatnonzero((longest >= window) & ~extended)
    return starts, longest[starts]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def measure(texts: list[str], limits: Limits) -> dict[str, np.ndarray]:
    """All measures of some texts."""
    number = defaultdict(count().__next__).__getitem__
    words = [WORD.findall(text) for text in texts]
    sizes = np.array([len(found) for found in words], np.int64)
    ids = np.fromiter(map(number, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    window = min(limits.window, BASE_WINDOW)
    starts, lengths = repeats(ids, text, window)

    def per_text(window: int) -> tuple[np.ndarray, np.ndarray]:
        long = lengths >= window
        inside = covered(starts[long], lengths[long], len(ids))
        longest = np.zeros(len(texts), np.int64)
        np.maximum.at(longest, text[starts[long]], lengths[long])
        return np.bincount(text[inside], minlength=len(texts)), longest

    n_repeat_words, longest = per_text(BASE_WINDOW)
    in_repeats = n_repeat_words
    if limits.window != BASE_WINDOW:
        in_repeats, longest = per_text(limits.window)
    fraction = in_repeats / np.maximum(sizes, 1)
    base_failed = (sizes < MIN_WORDS) | (100 * n_repeat_words > BASE_PERCENT * sizes)
    good = (fraction <= limits.max_fraction) & (longest <= limits.max_longest)
    return {
        "n_words": sizes,
        "word_chars": np.array([sum(map(len, found)) for found in words], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": n_repeat_words.astype(np.int64),
        "base_failed": base_failed,
        "kept": ~base_failed & good,
        "repeated_fraction": fraction,
        "longest_repeat": longest,
    }


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, repeated_fraction double, longest_repeat long"
)


def repetition(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id and the measures of each row's text; one row per row of ``docs``.

    Null and empty texts have no words and fail the base rule, as any text of
    under 20 words does.  Copies are measured each by itself; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            found = measure(texts_of(part), limits)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {MEASURES}")


def good_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the base rule and the limits keep, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            yield part.filter(pa.array(measure(texts_of(part), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
