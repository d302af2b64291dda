"""Token ids by a public byte-level BPE vocabulary, remembered per piece of text.

The vocabulary's own pattern cuts a text into pieces, and merges never leave a
piece, so a text's ids are those of its pieces in order.  Pieces repeat, within
and across texts; each is encoded once and then looked up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import regex

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Two bytes an id: the vocabulary has fewer than 65,536.
ID_TYPE = np.dtype("<u2")
REMEMBERED = 300_000


class PieceIds(dict):
    """The ids of pieces, as bytes; emptied at ``REMEMBERED`` pieces, which only costs time."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if max(ranks.values()) > np.iinfo(ID_TYPE).max:
            raise ValueError("ids of this vocabulary need more than two bytes")
        pattern = public_tokenizers.PATTERN
        self.pieces = regex.compile(pattern).findall
        self.encode = tiktoken.Encoding(
            "pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = np.array(self.encode(piece), ID_TYPE).tobytes()
        return ids

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), ID_TYPE)

    def count(self, texts: Iterable[str]) -> list[int]:
        get, cut, width = self.__getitem__, self.pieces, ID_TYPE.itemsize
        return [sum(map(len, map(get, cut(text)))) // width for text in texts]
