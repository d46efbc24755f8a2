"""Token ids as binary shards: a wavelet matrix each, with rank and select on compressed bit-planes.

A payload is a header (magic, tokens, planes), the zeros of each plane, the sizes of the compressed
planes and of the rank directory, then these. Plane b, from the highest bit down, holds that bit of
all tokens in the order that sorting by the higher bits, stably, from the last plane up, has left.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, two
from .tokens import BYTE_BPE, TOKENIZERS, byte_bpe

MAGIC = b"WVMX1\0"
#: A shard is closed with the document that brings it to so many tokens.
SHARD_TOKENS = 1 << 18
#: Bits of a block of the rank directory.
BLOCK = 512
SCHEMA = "shard_id long, n_docs long, n_tokens long, doc_ids array<long>, doc_offsets array<long>, payload binary"


def build(tokens: np.ndarray, level: int = 1) -> bytes:
    """The payload of a sequence of token ids below 2**32."""
    t = np.ascontiguousarray(tokens)
    t = t.astype(np.uint16 if not len(t) or t.max() < 1 << 16 else np.uint32)
    planes = max(1, int(t.max()).bit_length() if len(t) else 1)
    comp = zstandard.ZstdCompressor(level=level)
    zeros, packed, directory = [], [], []
    for b in range(planes - 1, -1, -1):
        bit = (t & t.dtype.type(1 << b)) != 0
        raw = np.packbits(bit, bitorder="little")
        words = np.zeros(-(-len(t) // BLOCK) * BLOCK // 8, np.uint8)
        words[: len(raw)] = raw
        ones = np.bitwise_count(words.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        directory.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
        packed.append(comp.compress(words.tobytes()))
        lows = t[~bit]
        zeros.append(len(lows))
        t = np.concatenate((lows, t[bit]))
    ranks = comp.compress(np.concatenate(directory).tobytes())
    return b"".join([MAGIC, struct.pack("<QI", len(tokens), planes), struct.pack(f"<{planes}Q", *zeros), struct.pack(f"<{planes + 1}Q", *map(len, packed), len(ranks)), *packed, ranks])


class WaveletMatrix:
    """Reads a payload. Planes are decompressed when first used and stay bits."""

    def __init__(self, payload: bytes):
        if payload[:6] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, self.planes = struct.unpack_from("<QI", payload, 6)
        at = 18
        self.zeros = struct.unpack_from(f"<{self.planes}Q", payload, at)
        at += 8 * self.planes
        sizes = struct.unpack_from(f"<{self.planes + 1}Q", payload, at)
        at += 8 * (self.planes + 1)
        self._raw = []
        for s in sizes:
            self._raw.append(payload[at : at + s])
            at += s
        self._open: dict[int, np.ndarray] = {}
        self._dir: np.ndarray | None = None

    def _plane(self, k: int) -> np.ndarray:
        if k not in self._open:
            self._open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._raw[k]), np.uint64)
        return self._open[k]

    def _ranks(self, k: int) -> np.ndarray:
        if self._dir is None:
            self._dir = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._raw[-1]), np.uint32).reshape(self.planes, -1)
        return self._dir[k]

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Set bits of plane k before each position."""
        i = np.asarray(i, np.int64)
        block = i // BLOCK
        out = self._ranks(k)[block].astype(np.int64)
        words = self._plane(k)
        if not len(words):
            return out
        first = block * (BLOCK // 64)
        word = i // 64
        for j in range(BLOCK // 64):
            w = first + j
            use = w < word
            out += np.where(use, np.bitwise_count(words[np.minimum(w, len(words) - 1)]), 0)
        part = (i % 64).astype(np.uint64)
        mask = (np.uint64(1) << part) - np.uint64(1)
        return out + np.bitwise_count(words[np.minimum(word, len(words) - 1)] & mask)

    def _bit(self, k: int, i: np.ndarray) -> np.ndarray:
        w = self._plane(k)[i // 64]
        return ((w >> (i % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def access(self, i) -> np.ndarray:
        """The tokens at the given positions."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("position out of range")
        out = np.zeros(len(i), np.int64)
        for k in range(self.planes):
            bit = self._bit(k, i)
            ones = self._ones(k, i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.planes:
            return 0, 0
        for k in range(self.planes):
            a, b = self._ones(k, np.array([lo, hi])).tolist()
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.planes - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token is among the first i."""
        lo, hi = self._range(token, 0, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k) -> np.ndarray:
        """Positions of the token's k-th occurrences, from 0."""
        lo, hi = self._range(token, 0, self.n)
        at = lo + np.atleast_1d(np.asarray(k, np.int64))
        if len(at) and (at.min() < lo or at.max() >= hi):
            raise IndexError("no such occurrence")
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            at = self._select(p, at - self.zeros[p] if one else at, bool(one))
        return at

    def _select(self, k: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """Position of the nth set, or unset, bit: binary search over the directory, then over a block."""
        lo = np.zeros(len(nth), np.int64)
        hi = np.full(len(nth), self.n, np.int64)
        while (open_ := hi - lo > 1).any():
            mid = (lo + hi) // 2
            ones = self._ones(k, mid)
            before = ones if one else mid - ones
            left = before > nth
            hi = np.where(open_ & left, mid, hi)
            lo = np.where(open_ & ~left, mid, lo)
        return lo

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of the token, in order."""
        return self.select(token, np.arange(self.count(token)))

    def tokens(self) -> np.ndarray:
        """The whole sequence."""
        return self.access(np.arange(self.n))


def wavelet_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shard_tokens: int = SHARD_TOKENS, tokenizers: str = TOKENIZERS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """One row per shard: (shard_id, n_docs, n_tokens, doc_ids, doc_offsets, payload).

    Each partition's texts are tokenized whole and laid end to end; a shard is closed by the document
    that fills it, so documents are never split and memory holds one shard. Narrow: no shuffle.
    doc_offsets has the first token of each document and the end. shard_id holds the partition in its
    high bits; it is stable as long as the input's splits are.

    Null and empty texts are documents of no tokens. Repeated rows and null ids are carried. An empty
    table has no shards. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = byte_bpe(tokenizers, vocabulary).encode_to_numpy if hasattr(byte_bpe(tokenizers, vocabulary), "encode_to_numpy") else None
        plain = byte_bpe(tokenizers, vocabulary).encode_ordinary
        ctx = TaskContext.get()
        base, seq = (ctx.partitionId() if ctx else 0) << 32, 0
        ids: list[int | None] = []
        got: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, got, total, seq
            off = np.concatenate(([0], np.cumsum([len(g) for g in got])))
            payload = build(np.concatenate(got))
            row = pa.RecordBatch.from_pylist([{"shard_id": base + seq, "n_docs": len(ids), "n_tokens": total, "doc_ids": ids, "doc_offsets": off.tolist(), "payload": payload}], schema=pa.schema([("shard_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())), ("payload", pa.binary())]))
            ids, got, total = [], [], 0
            seq += 1
            return row

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    if t:
                        got.append(encode(t, disallowed_special=()).astype(np.uint32) if encode else np.array(plain(t), np.uint32))
                    else:
                        got.append(np.zeros(0, np.uint32))
                    total += len(got[-1])
                    if total >= shard_tokens:
                        yield close()
        if ids:
            yield close()

    return two(df, id_col, text_col).mapInArrow(run, SCHEMA)


def token_occurrences(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, position in the document) of every occurrence of some tokens, off the payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, off, payload in zip(b.column(0), b.column(1), b.column(2), strict=True):
                wm, starts, names = WaveletMatrix(payload.as_py()), np.array(off.as_py()), ids.as_py()
                for token in tokens:
                    at = wm.occurrences(token)
                    doc = np.searchsorted(starts, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token, np.int64)), pa.array([names[d] for d in doc.tolist()], pa.int64()), pa.array(at - starts[doc])], names=["token", "doc_id", "position"])

    return shards.select("doc_ids", "doc_offsets", "payload").mapInArrow(run, "token long, doc_id long, position long")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n) over all shards, by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0):
                wm = WaveletMatrix(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([wm.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return shards.select("payload").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
