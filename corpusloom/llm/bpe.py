"""Byte-level BPE: encodings form a monoid, so halves are encoded apart and joined at their border."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from corpusloom.llm.rows import map_slices, octets

# Code points of a leaf of the tree.
LEAF = 512


class Bpe:
    """Encoder and decoder for byte-level ranks.

    The encoding of a text is a tree reduction: a leaf of LEAF code points is encoded by the rank
    merges of tiktoken, a longer text by halves whose token lists are joined. Tokens at the middle
    may be wrong in both halves, since a word may run across it or blanks may belong to
    the word behind. The join encodes a window around the middle anew and lets it grow on each
    side up to a border that no match of the pattern can cross whatever lies beyond: between a
    non-blank and a blank or line feed. All tokens outside the window are then final. A side without such a
    border becomes part of the window as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF):
        self.leaf = leaf
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = list(map(len, self.tokens))
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _border_before(text: str, low: int, high: int) -> int:
        """The last border in text[low:high], else low."""
        at = high
        while True:
            at = max(text.rfind(" ", low, at), text.rfind("\n", low, at))
            if at <= low:
                return low
            if not text[at - 1].isspace():
                return at

    @staticmethod
    def _border_after(text: str, low: int, high: int) -> int:
        """The first border in text[low:high], else high."""
        at = low
        while True:
            blank, feed = text.find(" ", at, high), text.find("\n", at, high)
            at = min(blank, feed) if blank >= 0 <= feed else max(blank, feed)
            if at < 0:
                return high
            if at > low and not text[at - 1].isspace():
                return at
            at += 1

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, stop = self._border_before(text, low, middle), self._border_after(text, middle, high)
        lengths = self.lengths
        keep, rest = len(left), len(text[start:middle].encode())
        while rest > 0:
            keep -= 1
            rest -= lengths[left[keep]]
        skip, rest = 0, len(text[middle:stop].encode())
        while rest > 0:
            rest -= lengths[right[skip]]
            skip += 1
        del left[keep:]
        left += self._encode(text[start:stop])
        left += right[skip:] if skip else right
        return left

    def _tree(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self._encode(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._tree(text, low, middle), self._tree(text, middle, high))

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(name: str) -> Bpe:
    """The encoder for a rank file of the tokenizer folder, made once per worker."""
    with open(public_tokenizers.path(name), "rb") as lines:
        return Bpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


RANKS = "byte_bpe_50k.tiktoken"


def encode_documents(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The documents with all their columns and ids array<int>, n_tokens, ids_sha256 (of the decimal ids
    joined by blanks) and decoded_sha256 (of the bytes that the ids decode to).

    A null or empty text has no ids; bytes that are not UTF-8 are replaced. Columns that have these names already are replaced. Row by row, without a shuffle.
    """
    added = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c.lower() not in added]
    octet = "_octets"
    while octet in kept:
        octet += "_"

    def make():
        bpe = load(ranks)
        decimal = list(map(str, range(len(bpe.tokens))))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, n, ids_sha, text_sha = [], [], [], []
            for text in batch.column(octet).to_pylist():
                got = bpe.encode(text.decode(errors="replace"))
                ids.append(np.array(got, np.int32))
                n.append(len(got))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, got)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(got)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()),
                 pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [*kept, *added])
        return each

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    schema = ", ".join([*fields, "ids array<int>", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"])
    return map_slices(docs.select(*kept, octets().alias(octet)), octet, schema, make)
