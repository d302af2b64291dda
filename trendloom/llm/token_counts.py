"""Token counts of whole texts by a public tokenizer, without keeping any token.

Texts are cut at white space, which these tokenizers treat as a border: no
token, merge, contraction or special string reaches over it, so a text's count is
the sum over its words.  Words, and what lies between, are handed to the library
in batches balanced by bytes; a word seen before is not encoded again.  Only
lengths come back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trendloom.llm.text import WORD, byte_slices, texts_of

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of words in one call of the library; words remembered by a task.
CALL_BYTES = 64 << 10
REMEMBERED = 300_000
#: A word of such letters is one piece of text to the tokenizer, and one such mark
#: after it another piece of one token, if the tokenizer of the file shows it to be so.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
MARKS = ".,;:!?"
SAMPLES = ["a", "the", "Haus", "\u00e9t\u00e9", "xqzwv"]


def _calls(words: Iterable[str]) -> Iterator[list[str]]:
    """Words in lists of about equal bytes."""
    call, size = [], 0
    for word in words:
        call.append(word)
        size += len(word) + 1
        if size >= CALL_BYTES:
            yield call
            call, size = [], 0
    if call:
        yield call


class WordCounts:
    """Counts of the words of texts; the file's tokenizer drops white space."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        alone = {word: len(self.tokenizer.encode(word, add_special_tokens=False)) for word in self._samples()}
        self.by_letters = self._plain(SAMPLES) == [alone[word] for word in SAMPLES]
        self.marks = {mark for mark in MARKS if all(alone[word + mark] == alone[word] + 1 for word in SAMPLES)}

    @staticmethod
    def _samples() -> list[str]:
        return [word + mark for word in SAMPLES for mark in ("", *MARKS)]

    def _learn(self, words: list[str]) -> None:
        """Encode new words: plain ones by their letters, the others with the places of tokens."""
        plain, other = {}, []
        for word in words:
            letters = word[:-1] if word[-1] in self.marks else word
            if self.by_letters and LETTERS.fullmatch(letters):
                plain.setdefault(letters, []).append(word)
            else:
                other.append(word)
        for call in _calls(plain):
            for letters, tokens in zip(call, self._plain(call)):
                for word in plain[letters]:
                    self.known[word] = tokens + len(word) - len(letters)
        for call in _calls(other):
            self.known.update(zip(call, self._placed(call)))

    def _plain(self, words: list[str]) -> list[int]:
        """Words of letters only: each has one token that ends a word, its last."""
        texts = ["\n".join(words[i : i + 100]) for i in range(0, len(words), 100)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int64)
        return np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1).tolist()

    def _placed(self, words: list[str]) -> list[int]:
        """Any words, one a line; a token belongs to the line in which it starts."""
        encoded = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.fromiter((start for start, _ in encoded.offsets), np.int64, len(encoded))
        lines = np.searchsorted(ends, starts, side="right")
        return np.bincount(lines, minlength=len(words)).tolist()

    def of(self, texts: list[str]) -> np.ndarray:
        words = [WORD.findall(text) for text in texts]
        seen = set()
        seen.update(*words)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = seen
        self._learn(list(new))
        count = self.known.__getitem__
        return np.fromiter((sum(map(count, found)) for found in words), np.int64, len(texts))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; null counts as empty.

    ``tokenizer`` names a file of the public tokenizers that drops white space.
    Special strings inside texts are special tokens, as the library has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(tokenizer_path(tokenizer))
        for part in byte_slices(batches, "text"):
            texts = texts_of(part)
            tokens = counts.of(texts)
            sizes = np.array([len(text.encode("utf-8")) for text in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
