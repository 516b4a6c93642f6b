"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until the halves are short; leaves are encoded alone and
neighbours are joined: the tokens around the seam are replaced by those of a
re-encoded window that reaches from the last sure split in the left half to the
first sure split in the right half. A sure split is a place at which the
pattern must split whatever stands before it, so no token outside the window
can change; the window grows from the seam until it has one on either side (or
the half ends). Joining is associative, with the empty text as its unit.

Plan: a scan and an Arrow map; no shuffle. The vocabulary is read once for each
worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import by_row, table

#: Characters of a leaf.
LEAF = 4096
#: Tokens of a leaf of the decoder.
DECODE_LEAF = 4096
#: Between a letter or digit and ASCII white space or punctuation the pattern splits always. The scripts listed are letters in every Unicode version.
_SPLIT = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ɏа-яА-Я一-龥가-힣](?=[ \t\n\r.,;:!?\"()])")


class Codec:
    def __init__(self, vocabulary: str, pattern: str, leaf: int = LEAF):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = {r: len(b) for b, r in ranks.items()}
        self.leaf = max(2, leaf)

    def encode(self, text: str) -> list[int]:
        """The ids of the whole text."""
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The ids of ``left + right`` from those of either half."""
        i, j = self.last_split(left), self.first_split(right)
        keep = self.tokens(reversed(a), len(left[i:].encode()))
        drop = self.tokens(b, len(right[:j].encode()))
        return a[: len(a) - keep] + self.core.encode_ordinary(left[i:] + right[:j]) + b[drop:]

    def tokens(self, ids, size: int) -> int:
        """How many tokens make up the first ``size`` bytes."""
        n = 0
        for t in ids:
            if size <= 0:
                break
            size -= self.size[t]
            n += 1
        assert size == 0, "a split inside a token"
        return n

    def last_split(self, text: str) -> int:
        width = 64
        while True:
            start = max(0, len(text) - width)
            last = None
            for last in _SPLIT.finditer(text, start):
                pass
            if last:
                return last.end()
            if not start:
                return 0
            width *= 4

    def first_split(self, text: str) -> int:
        m = _SPLIT.search(text)
        return m.end() if m else len(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return self.core.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(4)
def codec(vocabulary: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> Codec:
    """By default the 50k byte-level vocabulary among the installed public tokenizers."""
    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return Codec(vocabulary, pattern, leaf)


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``ids``, array of int, to every row; a null text counts as empty, a text of any length is encoded whole. Repeated rows are encoded each, an empty table gives an empty one. A column ``ids`` is replaced."""
    own = lambda: lambda t: (codec(vocabulary, pattern).encode(t or ""),)
    return by_row(docs.drop("ids"), own, [text], "ids array<int>")


def decode(rows: DataFrame, ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids; null ids count as none. A column ``decoded`` is replaced."""
    own = lambda: lambda x: (codec(vocabulary, pattern).decode(x or []),)
    return by_row(rows.drop("decoded"), own, [ids], "decoded binary")


def digests(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode() and decode() in one pass that hands on digests: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Ids of a text outweigh the text, so they stay in the worker that makes them.
    """

    def row():
        c = codec(vocabulary, pattern)

        def one(t):
            ids = c.encode(t or "")
            return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        return one

    return by_row(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), row, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``round_trip``: whether decoding gives back the text's bytes. Columns of these names are replaced."""

    def row():
        c = codec(vocabulary, pattern)

        def one(t):
            ids = c.encode(t or "")
            return ids, len(ids), c.decode(ids) == (t or "").encode()

        return one

    return by_row(docs.drop("ids", "n_tokens", "round_trip"), row, [text], "ids array<int>, n_tokens long, round_trip boolean")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
