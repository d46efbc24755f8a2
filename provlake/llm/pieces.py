"""Sampled segmentations by a piece model: forward filtering, backward sampling over the piece lattice.

A text's lattice has an edge for every piece that occurs in it. No piece goes over the start of a
word or over a character that is in no longer piece, so the lattice is a chain of small ones, and the
forward sums of each distinct word are found once a slice, all words side by side. Sampling goes back
from the ends of all words at once; its random numbers are a hash of row key, seed and place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, list_column, mix, prefix_hash, slices, span_hash, two
from .tokens import PIECES, TOKENIZERS

#: Weight of a piece: its rank among the pieces by score, plus 2, to minus this power.
ALPHA = 1.0
SLICE_BYTES = 2 << 20
_SPACE = 0x2581
#: A literal U+2581, which a piece can't tell from a space, is spelled in bytes.
_LITERAL = 0x110000
_TABLE_BITS = 21
_LOADED: dict[tuple[str, float], Pieces] = {}


class Pieces:
    """A piece model's vocabulary as hash tables of its pieces' prefixes."""

    def __init__(self, path: str, alpha: float):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in ids}
        if any("▁" in p[1:] and p.strip("▁") for p in text.values()):
            raise ValueError("pieces must not go over the start of a word")
        order = sorted(ids, key=lambda i: (-sp.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        units = {i: np.array([ord(c) for c in p], np.uint32) for i, p in text.items()}
        self.longest = max(map(len, units.values()))
        # every prefix of a piece, once, with the piece that it is, if any
        entry: dict[int, int] = {}
        for i, u in units.items():
            h = prefix_hash(u)
            all_ = span_hash(h, np.zeros(len(u), np.int64), np.arange(1, len(u) + 1)).tolist()
            for x in all_[:-1]:
                entry.setdefault(x, -1)
            entry[all_[-1]] = i
        self.hash = np.array(list(entry), np.uint64)
        self.piece = np.array(list(entry.values()), np.int32)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(self.hash))
        for shift in (0, 21, 42):  # entries that share a slot go to the next table
            slot = (self.hash[left] >> np.uint64(shift)) & np.uint64((1 << _TABLE_BITS) - 1)
            t = np.full(1 << _TABLE_BITS, -1, np.int32)
            _, first = np.unique(slot, return_index=True)
            t[slot[first].astype(np.int64)] = left[first]
            self.tables.append((np.uint64(shift), t))
            left = np.delete(left, first)
        if len(left):
            raise ValueError("too many pieces")
        self.weight = np.zeros(sp.get_piece_size(), np.float64)
        for i, k in rank.items():
            self.weight[i] = -alpha * np.log(k + 2)
        self.joined = np.zeros(_LITERAL + 1, bool)  # characters that are in a piece of two or more
        self.single = np.zeros(_LITERAL + 1, bool)
        for u in units.values():
            (self.joined if len(u) > 1 else self.single)[u] = True
        spelled = [b"" for _ in range(sp.get_piece_size())]
        for i, p in text.items():
            spelled[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(x) for x in spelled])))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        for shift, t in self.tables:
            x = h[rest]
            at = t[((x >> shift) & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)]
            hit = (at >= 0) & (self.hash[at] == x)
            out[rest[hit]] = at[hit]
            rest = rest[(at >= 0) & ~hit]
            if not len(rest):
                break
        return out


def load(folder: str = TOKENIZERS, file: str = PIECES, alpha: float = ALPHA) -> Pieces:
    path = os.path.join(folder, file)
    if (path, alpha) not in _LOADED:
        _LOADED[path, alpha] = Pieces(path, alpha)
    return _LOADED[path, alpha]


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, a space before each that isn't empty, and the first of each and the end.

    A byte that isn't part of UTF-8 is the lone surrogate that stands for it.
    """
    data, off = buffers(column)
    raw = data.tobytes()
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    units = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(units) != heads[-1] or ((units >= 0xD800) & (units < 0xE000)).any():
        rows = [np.frombuffer(raw[a:b].decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32) for a, b in zip(off, off[1:], strict=False)]
        heads = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        units = np.concatenate(rows) if rows else units
    n = np.diff(heads)
    some = n > 0
    out_heads = np.concatenate(([0], np.cumsum(n + some)))
    out = np.full(int(out_heads[-1]), _SPACE, np.uint32)
    at = np.arange(len(units)) + np.repeat(out_heads[:-1] + some - heads[:-1], n)
    u = units.copy()
    u[units == _SPACE] = _LITERAL
    u[units == 32] = _SPACE
    out[at] = u
    return out, out_heads


def _lattice(p: Pieces, units: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward sums of words units[s:e]: (node of each word's start, first edge of each node, and of
    edges the probabilities, starts and pieces).

    A word of n symbols has nodes base .. base + n. A node's edges are side by side, the
    longest first; a probability is of this edge or one before it, given the end.
    """
    n = e - s
    base = np.concatenate(([0], np.cumsum(n + 1)))[:-1]
    total = int((n + 1).sum())
    first = np.concatenate(([0], np.cumsum(n)))
    flat = units[np.repeat(s - first[:-1], n) + np.arange(first[-1])]
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(first[-1])
    end = first[1:][word]
    h = prefix_hash(flat)
    starts, ends, ids = [], [], []
    live = place
    for length in range(1, p.longest + 1):
        live = live[live + length <= end[live]]
        if not len(live):
            break
        at = p.find(span_hash(h, live, live + length))
        piece = np.where(at >= 0, p.piece[at], -1)
        hit = piece >= 0
        starts.append(live[hit])
        ends.append(live[hit] + length)
        ids.append(piece[hit])
        if length == 1:  # characters without a piece are spelled in bytes
            none = live[~hit]
            starts.append(none)
            ends.append(none + 1)
            ids.append(np.full(len(none), -1, np.int32))
        live = live[at >= 0]
    a, b, ids = (np.concatenate(x[::-1]) for x in (starts, ends, ids))
    w = word[a]
    a, b = a + w, b + w  # places to nodes: a word has one node more than symbols
    rel = b - base[w]
    order = np.argsort(b, kind="stable")  # runs in order, the longest pieces first
    by = rel[order]
    order = order[np.argsort(by.astype(np.uint16) if len(by) and by.max() < 1 << 16 else by, kind="stable")]
    a, b, ids, rel = a[order], b[order], ids[order], rel[order]
    weight = np.where(ids >= 0, p.weight[ids], 0.0)
    alpha = np.full(total, -np.inf)
    alpha[base] = 0.0
    keys = np.empty(len(a))
    steps = np.flatnonzero(np.concatenate(([True], rel[1:] != rel[:-1], [True])))
    for i, j in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        v = alpha[a[i:j]] + weight[i:j]
        node = b[i:j]
        head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(np.append(head, j - i))
        top = np.maximum.reduceat(v, head)
        x = np.exp(v - np.repeat(top, size))
        t = np.add.reduceat(x, head)
        c = np.cumsum(x)
        c -= np.repeat(np.concatenate(([0.0], c[head[1:] - 1])), size)
        alpha[node[head]] = top + np.log(t)
        c /= np.repeat(t, size)
        c[np.append(head[1:], j - i) - 1] = 1.0
        keys[i:j] = c
    head = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    edge_first = np.zeros(total, np.int64)
    edge_first[b[head]] = head
    return base, edge_first, keys, a, ids


def sample(p: Pieces, column: pa.Array, row_key: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a sampled segmentation of each text, and the first of each and the end."""
    units, heads = _units(column)
    n = len(units)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[heads] = True
    cut[1:n] |= (units[1:] == _SPACE) & (units[:-1] != _SPACE)
    alone = ~p.joined[units]
    cut[:n] |= alone
    cut[1:] |= alone
    bound = np.flatnonzero(cut)
    s, e = bound[:-1], bound[1:]
    key = mix(span_hash(prefix_hash(units), s, e) ^ (e - s).astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    base, edge_first, edge_upto, edge_start, edge_piece = _lattice(p, units, s[first], e[first])
    row = np.searchsorted(heads, s, "right") - 1
    random = mix(row_key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
    token = np.full(n, -2, np.int32)
    lo = base[which]
    node = lo + (e - s)
    shift = s - lo  # from nodes to places
    salt, head = random[row], heads[row]
    while len(node):
        r = mix(salt ^ mix((node + shift - head).astype(np.uint64)))
        u = (r >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = edge_first[node]
        left = np.flatnonzero(u >= edge_upto[k])
        while len(left):  # a node's last edge has probability 1
            k[left] += 1
            left = left[u[left] >= edge_upto[k[left]]]
        node = edge_start[k]
        token[node + shift] = edge_piece[k]
        more = node > lo
        if not more.all():
            node, lo, shift, salt, head = node[more], lo[more], shift[more], salt[more], head[more]
    at = np.flatnonzero(token != -2)
    t = token[at]
    count = np.searchsorted(at, heads)
    byte = np.flatnonzero(t == -1)
    if not len(byte):
        return t, count
    c = units[at[byte]]
    c = np.where(c == _LITERAL, _SPACE, c)
    lone = (c >= 0xDC80) & (c <= 0xDCFF)
    size = np.where(lone | (c < 0x80), 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
    many = np.ones(len(t), np.int64)
    many[byte] = size
    to = np.concatenate(([0], np.cumsum(many)))
    out = np.repeat(t, many)
    for k in range(1, 5):
        mine = size == k
        x, spot = c[mine], to[byte[mine]]
        if k == 1:
            out[spot] = p.byte[np.where(lone[mine], x & 0xFF, x)]
            continue
        lead = (0, 0, 0xC0, 0xE0, 0xF0)[k]
        for j in range(k):
            bits = x >> np.uint32(6 * (k - 1 - j))
            out[spot + j] = p.byte[(bits | lead) if j == 0 else (bits & 0x3F) | 0x80]
    return out, to[count]


def decode_bytes(p: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that the pieces spell, and the first of each and the end."""
    ids = ids.astype(np.int64)
    size = p.spelled_at[ids + 1] - p.spelled_at[ids]
    to = np.concatenate(([0], np.cumsum(size)))
    raw = p.spelled[np.repeat(p.spelled_at[ids] - to[:-1], size) + np.arange(to[-1])] if len(ids) else np.zeros(0, np.uint8)
    heads = to[off]
    keep = np.ones(len(raw), bool)
    keep[heads[:-1][heads[:-1] < heads[1:]]] = False  # the space before each text
    return raw[keep], heads - np.concatenate(([0], np.cumsum(heads[:-1] < heads[1:])))


def sampled_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 0, alpha: float = ALPHA, tokenizers: str = TOKENIZERS, model: str = PIECES) -> DataFrame:
    """(doc_id, n_pieces, pieces) of each row: a segmentation drawn with its probability.

    A segmentation's probability is in proportion to the product of its pieces' weights; it is drawn
    exactly, over the whole text. Draws depend on doc_id, seed and text alone, so on no partitioning.
    Characters without a piece, and U+2581, are spelled in bytes: decoded_pieces gives the text back.

    A null text has null pieces, an empty one none. Equal rows get equal pieces; a null id draws like
    the id 0; an empty table gives an empty result; other columns are ignored. Narrow: no shuffle.
    """
    names = ["doc_id", "n_pieces", "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(tokenizers, model, alpha)
        for b in batches:
            for part in slices(b, limit=SLICE_BYTES):
                key = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, off = sample(p, part.column(1), mix(key.view(np.uint64)), seed)
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                got = list_column(ids, off, pa.int32())
                if null.any():
                    got = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=np.append(null, False)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off), pa.int64(), mask=null), got], names=names)

    return two(df, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>")


def decoded_pieces(df: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", *, tokenizers: str = TOKENIZERS, model: str = PIECES) -> DataFrame:
    """(doc_id, text) of each row of pieces; null pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(tokenizers, model)
        for b in batches:
            c = b.column(1)
            null = c.is_null().to_numpy(zero_copy_only=False)
            size = np.array([0 if x else y for x, y in zip(null, c.value_lengths().fill_null(0).to_pylist(), strict=True)], np.int64)
            off = np.concatenate(([0], np.cumsum(size)))
            raw, heads = decode_bytes(p, c.flatten().to_numpy(zero_copy_only=False), off)
            data = raw.tobytes()
            text = [None if x else data[s:e].decode("utf-8", "surrogateescape") for x, s, e in zip(null, heads[:-1].tolist(), heads[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{pieces_col}`").cast("array<int>").alias("pieces")).mapInArrow(run, "doc_id long, text string")
