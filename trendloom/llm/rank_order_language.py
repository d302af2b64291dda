"""Language of a text by rank-order profiles of its n-grams.

A profile is the list of the most frequent n-grams (one to three characters of a
word with blanks around it), in order.  A language's profile comes from all of
its training rows: tasks count words, Spark adds up the n-grams of the counted
words.  A text is compared by the out-of-place distance: each n-gram of its own
profile adds the difference of its two ranks, or the profile length if the
language's profile lacks it.  The nearest language wins.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.text import byte_slices, texts_of

PROFILE = 400
NGRAM = 3
UNKNOWN = "und"
#: Bytes of text a training task counts at once, and n-grams it adds up before it hands them on.
TRAINING_BYTES, HELD_NGRAMS = 4 << 20, 400_000


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training: its id's checksum is divisible by ``folds``.

    A null id counts as the text ''.
    """
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


class Alphabet:
    """The letters of some texts, numbered from 1 in code point order; 0 is a blank.

    Letters are Unicode letters, and marks, which are counted like letters.  What
    lies between letters is one blank, and a blank begins and ends a text.
    """

    def __init__(self, texts: list[str], category: dict[int, str]):
        joined = "".join(text.lower() + "\n" for text in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(text.lower()) + 1 for text in texts])
        used = np.flatnonzero(np.bincount(points, minlength=1)) if len(points) else points
        for point in used.tolist():
            if point not in category:
                category[point] = unicodedata.category(chr(point))[0]
        self.letters = np.array([p for p in used.tolist() if category[p] in "LM"], np.int64)
        number = np.zeros(int(used.max(initial=0)) + 1, np.int64)
        number[self.letters] = np.arange(1, len(self.letters) + 1)
        symbols = number[points]
        keep = (symbols > 0) | (np.r_[0, symbols[:-1]] > 0)
        text = np.searchsorted(ends, np.flatnonzero(keep), side="right")
        #: Numbers of the letters and blanks, after one blank, and the text each is of.
        self.symbols, self.text = np.r_[0, symbols[keep]], np.r_[0, text]
        self.base = len(self.letters) + 1
        letter = np.array([category[p] == "L" for p in self.letters.tolist()], bool)
        self.has_letter = np.bincount(text[np.r_[False, letter][symbols[keep]]], minlength=len(texts)) > 0

    def ngrams(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, code and number of times of each n-gram, by group and code; -1 is left out.

        ``group`` has the group of each text.  A code has the n-gram's letters as
        digits after a leading 1, so codes are ordered by length, then letters.
        """
        s, base, of = self.symbols, self.base, group[self.text]
        codes = [
            (base + s, of, s > 0),
            ((base + s[:-1]) * base + s[1:], of[1:], s[1:] + s[:-1] > 0),
            (((base + s[:-2]) * base + s[1:-1]) * base + s[2:], of[1:-1], s[1:-1] > 0),
        ]
        span = 2 * base**3
        keys = np.sort(np.concatenate([(of * span + code)[ok & (of >= 0)] for code, of, ok in codes]))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        times = np.diff(np.r_[starts, len(keys)])
        return keys[starts] // span, keys[starts] % span, times

    def spell(self, codes: np.ndarray) -> list[str]:
        letters = [" ", *map(chr, self.letters.tolist())]
        spelled = []
        for code in codes.tolist():
            ngram = ""
            while code >= self.base:
                code, digit = divmod(code, self.base)
                ngram = letters[digit] + ngram
            spelled.append(ngram)
        return spelled

    def code(self, ngrams: list[str]) -> np.ndarray:
        """Codes of n-grams, -1 for those with a letter that no text here has."""
        number = {" ": 0, **{chr(p): i + 1 for i, p in enumerate(self.letters.tolist())}}
        codes = []
        for ngram in ngrams:
            code = 1
            for letter in ngram:
                code = code * self.base + number[letter] if code > 0 and letter in number else -1
            codes.append(code)
        return np.array(codes, np.int64)


def profiles(training: DataFrame, length: int = PROFILE) -> DataFrame:
    """lang, ngram, place (from 0): the ``length`` most frequent n-grams of each language.

    ``training`` has lang and text; null languages and texts teach nothing.  Ties
    are settled by the n-gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        category: dict[int, str] = {}

        def hand_on() -> pa.RecordBatch:
            langs, ngrams = zip(*counted) if counted else ((), ())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(ngrams, pa.string()), pa.array(counted.values(), pa.int64())],
                ["lang", "ngram", "times"],
            )
            counted.clear()
            return batch

        for part in byte_slices(batches, "text", TRAINING_BYTES):
            langs = part.column("lang").to_pylist()
            known = sorted(set(langs))
            alphabet = Alphabet(texts_of(part), category)
            group, codes, times = alphabet.ngrams(np.array([known.index(x) for x in langs], np.int64))
            distinct, place = np.unique(codes, return_inverse=True)
            spelled = alphabet.spell(distinct)
            for lang, at, n in zip(group.tolist(), place.tolist(), times.tolist()):
                counted[known[lang], spelled[at]] += n
            if len(counted) >= HELD_NGRAMS:
                yield hand_on()
        yield hand_on()

    labelled = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = labelled.select(F.col("lang").cast("string"), "text").mapInArrow(
        count, "lang string, ngram string, times long"
    )
    summed = counted.groupBy("lang", "ngram").agg(F.sum("times").alias("times"))
    # A filter on the number itself, which Spark limits before the rows of a language meet.
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "ngram"))
    first = summed.withColumn("place", number).filter(F.col("place") <= length)
    return first.withColumn("place", F.col("place") - 1)


class Profiles:
    """Distances of texts to the learned profiles."""

    def __init__(self, rows: list[tuple[str, str, int]], length: int):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.length = length
        self.ngrams = sorted({ngram for _, ngram, _ in rows})
        number = {ngram: i for i, ngram in enumerate(self.ngrams)}
        #: Place of each n-gram in each language; -1 if it is not in the profile, as in the last column.
        self.places = np.full((len(self.langs), len(self.ngrams) + 1), -1, np.int64)
        for lang, ngram, place in rows:
            self.places[self.langs.index(lang), number[ngram]] = place
        self.category: dict[int, str] = {}

    def of(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The nearest languages, and how near: 1 is the profile itself, 0 has nothing in common."""
        n = len(texts)
        alphabet = Alphabet(texts, self.category)
        if not self.langs or not len(alphabet.letters):
            return [UNKNOWN] * n, np.zeros(n)
        if n > 1 and n * 2 * alphabet.base**3 >= 2**62:  # keys of so many letters do not fit
            halves = self.of(texts[: n // 2]), self.of(texts[n // 2 :])
            return halves[0][0] + halves[1][0], np.r_[halves[0][1], halves[1][1]]
        text, codes, times = alphabet.ngrams(np.arange(n))
        # The most frequent n-grams of each text; ties by length and letters.
        most = int(times.max(initial=0)) + 1
        order = np.argsort(text * most + (most - 1 - times), kind="stable")
        text, codes = text[order], codes[order]
        sizes = np.bincount(text, minlength=n)
        here = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = here < self.length
        text, codes, here = text[own], codes[own], here[own]
        known = alphabet.code(self.ngrams)
        by_code = np.argsort(known)
        at = np.searchsorted(known, codes, sorter=by_code).clip(max=len(known) - 1)
        column = np.where(known[by_code[at]] == codes, by_code[at], len(known))
        there = self.places[:, column]
        apart = np.where(there < 0, self.length, np.abs(there - here))
        distance = np.array([np.bincount(text, row, minlength=n) for row in apart])
        best = distance.argmin(axis=0)
        worst = self.length * np.minimum(sizes, self.length)
        good = alphabet.has_letter
        score = np.where(good, 1 - distance.min(axis=0) / np.maximum(worst, 1), 0.0)
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best, good)], score


def predict(docs: DataFrame, learned: DataFrame, length: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row.

    A null or empty text, or one without a letter, is ``und`` with score 0, as is
    every text if nothing was learned.  Equal distances go to the first language
    by name.  The learned profiles, ``length`` rows a language, go to the tasks.
    """
    rows = [tuple(row) for row in learned.select("lang", "ngram", "place").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(rows, length)
        for part in byte_slices(batches, "text"):
            langs, scores = known.of(texts_of(part))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )


def identify(docs: DataFrame, length: int = PROFILE) -> DataFrame:
    """Learn from the rows that are not held out and predict every row: adds held_out."""
    learned = profiles(docs.filter(~held_out()).select("lang", "text"), length)
    return predict(docs, learned, length).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
