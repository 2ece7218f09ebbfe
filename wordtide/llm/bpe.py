"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token ends its encoding. It is
one of the vocabulary's tokens that are suffixes of the prefix, which an
automaton over the vocabulary gives at every position, and it is the one that is
compatible with the last token of the prefix before it: two tokens are
compatible if no merge of lower rank crosses the border between them, which
undoing the merges along the border decides. The back-pointers, followed from
the end, give the ids that merging pairs by rank would give, in time linear in
the length of the piece.

Texts are cut into pieces by the tokenizer's own pattern; the encodings of up to CACHE pieces of at most
LONGEST characters are kept in each worker.

Defined for every input: a null text has null ids; an empty text has none; a
text is encoded whole, however long; text that is not in the vocabulary's
language falls apart into bytes, so every text is encoded and decoded exactly; repeated
rows are repeated in the result; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import textkit

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 1 << 19
LONGEST = 32

SCHEMA = "doc_id long, ids array<int>, tokens long, exact boolean"


def load(path: str = TOKENIZER) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return [t for t, _ in sorted(ranks.items(), key=lambda kv: kv[1])]


class Encoder:
    """Encodes and decodes pieces with a vocabulary whose ids are its merge ranks."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.pair: dict[tuple[int, int], int] = {}
        for k, t in enumerate(tokens):
            if len(t) > 1 and (halves := self._halves(t, k)):
                self.left[k], self.right[k] = halves
                self.pair[halves] = k
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            # a token that no merges lead to is never emitted
            if len(t) == 1 or self.left[k] != k:
                self.automaton.add_word(t.decode("latin-1"), (len(t), k))
        self.automaton.make_automaton()
        self.fits = lru_cache(1 << 18)(self._fits)
        self.pieces = _Pieces(self)
        self.names = np.array([*tokens, None], object)[:-1]

    def _halves(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: what merges of lower rank leave of it."""
        parts = [self.rank[token[k : k + 1]] for k in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = self.pair.get((parts[k], parts[k + 1]), below)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [best]
        return parts[0], parts[1]

    def _fits(self, a: int, b: int) -> bool:
        """Whether a followed by b is what encoding their text gives."""
        limit, left, right, pair = 1 << 60, self.left, self.right, self.pair
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.rank.get(piece)) is not None and (len(piece) == 1 or self.left[whole] != whole):
            return [whole]
        n = len(piece)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        # matches come by their ends, the longest first; last[0] is -1 and goes before any token
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - length
                if not before or fits(last[before], token):
                    last[end], start[end] = token, before
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers in a row."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(self.names[np.asarray(ids, np.int64)].tolist())


class _Pieces(dict):
    """Encodings of pieces, short ones kept; emptied when it is full, so its size is bounded and its answers aren't affected."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encoder.encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


_made: dict[int, Encoder] = {}


def _encoder(tokens: list[bytes], pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    key = hash((tuple(tokens), pattern))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(tokens, pattern)
    return _made[key]


def _encode(shared, pattern: str):
    def run(batches):
        encoder = _encoder(shared.value, pattern)
        # a slice at a time: ids and decoded bytes of a whole batch would weigh many times its text
        for part in textkit.sliced(batches):
            texts = part.column("text").to_pylist()
            coded = [None if t is None else encoder.encode(t) for t in texts]
            sizes = np.array([0 if c is None else len(c) // 4 for c in coded], np.int64)
            flat = np.frombuffer(b"".join(c for c in coded if c), np.int32)
            exact = [None if t is None else encoder.decode(np.frombuffer(c, np.int32)) == t.encode() for t, c in zip(texts, coded)]
            missing = np.array([t is None for t in texts], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat), mask=pa.array(missing))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists, pa.array(sizes, mask=missing), pa.array(exact, pa.bool_())], ["doc_id", "ids", "tokens", "exact"])

    return run


def encode(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, tokens, exact): the ids of every text, their number, and whether decoding gave the text back."""
    shared = spark.sparkContext.broadcast(load(tokenizer))
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(_encode(shared, pattern), SCHEMA)


def _decode(shared):
    def run(batches):
        tokens = shared.value
        for b in batches:
            texts = [None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(spark: SparkSession, encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = spark.sparkContext.broadcast(load(tokenizer))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared), "doc_id long, text string")
