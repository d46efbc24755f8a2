"""Suffix arrays with common-prefix lengths by induced sorting over bucket queues that can live on disk.

Suffixes that are smaller than their right neighbour but not than their left one (S*) are sorted by
naming their pieces and recursing; all others follow from them in two sweeps over a monotone priority
queue: a suffix is queued under its first symbol by the rank of the suffix after it, so each symbol's
part of the queue is a FIFO, a stretch of one flat file. Entries carry the common-prefix length with
the entry before them, found as one more than the least value scanned in between.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np

#: 0 ends the text, 1 separates its parts; the words' symbols follow.
END, BREAK, FIRST = 0, 1, 2
#: S* pieces up to which names are sorted in memory; more go through recursion.
BASE = 1 << 21
#: Bytes of a queue beyond which it's a file.
IN_MEMORY = 256 << 20
_DIGIT = 4000


class BucketQueue:
    """(position, common prefix) entries, a FIFO a symbol; on disk in ``folder`` when large."""

    def __init__(self, counts: np.ndarray, folder: str | None, in_memory: int = IN_MEMORY):
        self.start = np.concatenate(([0], np.cumsum(counts)))
        self.tail = self.start[:-1].copy()
        n = int(self.start[-1])
        self._paths: list[str] = []
        self.pos = self._array(n, np.int64, folder, in_memory)
        self.lcp = self._array(n, np.uint8, folder, in_memory)

    def _array(self, n: int, kind, folder: str | None, in_memory: int) -> np.ndarray:
        if folder is None or n * np.dtype(kind).itemsize <= in_memory:
            return np.empty(n, kind)
        os.makedirs(folder, exist_ok=True)
        self._paths.append(os.path.join(folder, f"queue-{uuid.uuid4().hex}"))
        return np.memmap(self._paths[-1], kind, "w+", shape=n)

    def put(self, symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray, first: np.ndarray) -> None:
        """Entries sorted by symbol; first: where each symbol's begin."""
        size = np.diff(np.append(first, len(symbol)))
        at = self.tail[symbol] + np.arange(len(symbol)) - np.repeat(first, size)
        self.pos[at] = pos
        self.lcp[at] = lcp
        self.tail[symbol[first]] += size

    def close(self) -> None:
        self.pos = self.lcp = np.empty(0, np.int64)
        for p in self._paths:
            os.unlink(p)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one, and for the last."""
    up = np.sign(np.diff(text.astype(np.int32)))
    known = np.flatnonzero(up)
    out = np.ones(len(text), bool)
    if len(text) > 1:
        at = np.searchsorted(known, np.arange(len(text) - 1))
        ok = at < len(known)
        out[:-1][ok] = up[known[at[ok]]] > 0
        out[:-1][~ok] = False
    return out


def _pack(text: np.ndarray, at: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """Four symbols from each position in one integer; those from ``end`` on are greater than any."""
    out = np.zeros(len(at), np.uint64)
    for k in range(4):
        i = at + k
        c = text[np.minimum(i, len(text) - 1)].astype(np.uint64)
        c[i >= len(text)] = 0
        if end is not None:
            c[i >= end] = 0xFFFF
        out |= c << np.uint64(16 * (3 - k))
    return out


def common_prefix(text: np.ndarray, breaks: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, up to cap, not over a break."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    k = 0
    while len(live) and k < cap:
        x = _pack(text, a[live] + k) ^ _pack(text, b[live] + k)
        same = (x < np.uint64(1 << 48)).astype(np.int64) + (x < np.uint64(1 << 32)) + (x < np.uint64(1 << 16)) + (x == 0)
        out[live] += same
        live = live[same == 4]
        k += 4
    for p in (a, b):
        out = np.minimum(out, breaks[np.searchsorted(breaks, p)] - p)
    return np.minimum(out, cap)


def _names(text: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rank of each S* piece, up to and with the first symbol of the next.

    A piece that ends where another goes on is the greater: it ends in a suffix that is smaller than
    its right neighbour, the other goes on with one that starts alike and is greater.
    """
    end = np.append(p[1:] + 1, len(text))
    tail = np.full(len(p), len(p), np.int64)
    longest = int((end - p).max())
    for at in range((longest - 1) // 4 * 4, 3, -4):  # from the last four symbols of the longest back
        use = np.flatnonzero(end - p > at)
        _, r = np.unique(_pack(text, p[use] + at, end[use]), return_inverse=True)
        _, both = np.unique(r * (len(p) + 1) + tail[use], return_inverse=True)
        tail[use] = both
    _, r = np.unique(_pack(text, p, end), return_inverse=True)
    return np.unique(r * (len(p) + 1) + tail, return_inverse=True)[1]


def _sorted_stars(text: np.ndarray, p: np.ndarray, cap: int, base: int, folder: str | None, in_memory: int) -> np.ndarray:
    """Order of the S* suffixes by their first ``cap`` symbols at least."""
    name = _names(text, p)
    m = int(name.max()) + 1
    if m == len(p):
        return np.argsort(name)
    if len(p) <= base:
        h = 1
        while h < cap and m < len(p):
            nxt = np.zeros(len(p), np.int64)
            nxt[:-h] = name[h:] + 1
            _, name = np.unique(name * (len(p) + 1) + nxt, return_inverse=True)
            m, h = int(name.max()) + 1, 2 * h
        return np.argsort(name, kind="stable")
    digits, top = 1, _DIGIT
    while top < m:
        digits, top = digits + 1, top * _DIGIT
    inner = np.empty(len(p) * digits + 1, np.uint16)
    inner[-1] = END
    for d in range(digits - 1, -1, -1):
        inner[d:-1:digits] = name % _DIGIT + FIRST
        name //= _DIGIT
    parts: list[np.ndarray] = []
    induced_sort(inner, lambda sa, _: parts.append(sa[(sa % digits == 0) & (sa < len(inner) - 1)] // digits), cap=cap * digits, base=base, folder=folder, in_memory=in_memory, breaks=False)
    return np.concatenate(parts[::-1])


class _Sweep:
    """What has been scanned so far, as far as the next common-prefix lengths need it."""

    def __init__(self, symbols: int, cap: int, text: np.ndarray, wanted: np.ndarray, queue: BucketQueue):
        self.least = np.full(symbols, cap, np.int64)
        self.cap, self.text, self.wanted, self.queue = cap, text, wanted, queue

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Queue the wanted left neighbours of suffixes that come next in order."""
        if not len(pos):
            return
        lcp = lcp.astype(np.int64)
        q = np.flatnonzero((pos > 0) & self.wanted[pos - 1])
        running = np.minimum.accumulate(lcp)
        if not len(q):
            np.minimum(self.least, running[-1], out=self.least)
            return
        c = self.text[pos[q] - 1]
        order = np.argsort(c, kind="stable")
        c, q = c[order].astype(np.int64), q[order]
        head = np.concatenate(([True], c[1:] != c[:-1]))
        first = np.flatnonzero(head)
        got = np.empty(len(q), np.int64)
        got[first] = np.minimum(self.least[c[first]], running[q[first]])
        rest = np.flatnonzero(~head)
        if len(rest):
            got[rest] = _range_min(lcp, q[rest - 1] + 1, q[rest])
        np.minimum(self.least, running[-1], out=self.least)
        last = np.append(first[1:], len(q)) - 1
        back = np.minimum.accumulate(lcp[::-1])[::-1]
        after = q[last] + 1
        self.least[c[last]] = np.where(after < len(lcp), back[np.minimum(after, len(lcp) - 1)], self.cap)
        got = np.minimum(got + 1, self.cap)
        got[c <= BREAK] = 0
        self.queue.put(c, pos[q] - 1, got, first)


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of x[a..b], both ends included, by a sparse table."""
    n = b - a + 1
    level = np.frexp(n.astype(np.float64))[1] - 1
    rows = [x.astype(np.uint8)]
    for k in range(int(level.max())):
        y = rows[-1].copy()
        step = 1 << k
        np.minimum(y[:-step], rows[-1][step:], out=y[:-step])
        rows.append(y)
    table = np.stack(rows)
    return np.minimum(table[level, a], table[level, b - (1 << level) + 1]).astype(np.int64)


def induced_sort(text: np.ndarray, emit: Callable[[np.ndarray, np.ndarray], None], *, cap: int = 50, base: int = BASE, folder: str | None = None, in_memory: int = IN_MEMORY, breaks: bool = True) -> None:
    """Sort the suffixes of a text that ends with its only END; emit(suffixes, common prefixes) a bucket.

    Buckets come from the greatest symbol down, each in ascending order; a common prefix is with the
    suffix before in the bucket, the first's is 0. Lengths are capped at ``cap``, at most 254, and end
    at breaks. Suffixes that agree on ``cap`` symbols or more may be in any order among themselves.

    In memory are the text, its types and the S* positions; the queues, 9 bytes a suffix, are files
    in ``folder`` beyond ``in_memory`` bytes each.
    """
    text = np.ascontiguousarray(text, np.uint16)
    n, symbols = len(text), int(text.max()) + 1
    small = suffix_types(text)
    star = small.copy()
    star[0] = False
    star[1:] &= ~small[:-1]
    if n == 1:
        emit(np.zeros(1, np.int64), np.zeros(1, np.uint8))
        return
    stop = np.flatnonzero(text <= BREAK) if breaks else np.array([n - 1])
    p = np.flatnonzero(star)
    p = p[_sorted_stars(text, p, cap, base, folder, in_memory)]
    plcp = np.zeros(len(p), np.uint8)
    plcp[1:] = common_prefix(text, stop, p[:-1], p[1:], cap)
    pc = text[p]
    new = np.ones(len(p), bool)
    new[1:] = pc[1:] != pc[:-1]
    plcp[new] = 0
    pat = np.searchsorted(pc, np.arange(symbols + 1))

    large_q = BucketQueue(np.bincount(text[~small], minlength=symbols), folder, in_memory)
    small_q = BucketQueue(np.bincount(text[small], minlength=symbols), folder, in_memory)

    def border(a: int, b: int) -> int:
        return int(common_prefix(text, stop, np.array([a]), np.array([b]), cap)[0])

    sweep = _Sweep(symbols, cap, text, ~small, large_q)
    for c in range(symbols):
        at = begin = int(large_q.start[c])
        while at < large_q.tail[c]:  # also what is queued under c meanwhile
            to = int(large_q.tail[c])
            lcp = np.array(large_q.lcp[at:to])
            if at == begin:
                lcp[0] = large_q.lcp[at] = 0
            sweep.scan(np.array(large_q.pos[at:to]), lcp)
            at = to
        a, b = int(pat[c]), int(pat[c + 1])
        if b > a:
            lcp = plcp[a:b].copy()
            if at > begin:
                lcp[0] = border(int(large_q.pos[at - 1]), int(p[a]))
            sweep.scan(p[a:b], lcp)
    sweep = _Sweep(symbols, cap, text, small, small_q)
    if symbols and text[n - 1] == END:
        small_q.put(np.array([END]), np.array([n - 1]), np.array([0]), np.array([0]))
    for c in range(symbols - 1, -1, -1):
        at = begin = int(small_q.start[c])
        while at < small_q.tail[c]:
            to = int(small_q.tail[c])
            lcp = np.array(small_q.lcp[at:to])
            if at == begin:
                lcp[0] = small_q.lcp[at] = 0
            sweep.scan(np.array(small_q.pos[at:to]), lcp)
            at = to
        a, b = int(large_q.start[c]), int(large_q.tail[c])
        lpos, llcp = np.array(large_q.pos[a:b]), np.array(large_q.lcp[a:b])
        spos, slcp = np.array(small_q.pos[begin:at]), np.array(small_q.lcp[begin:at])
        meet = border(int(lpos[-1]), int(spos[-1])) if len(lpos) and len(spos) else 0
        if len(lpos):  # downwards, each with the one above it
            sweep.scan(lpos[::-1], np.append(llcp[1:], meet)[::-1])
        if len(lpos) or len(spos):
            up = np.zeros(len(spos), np.uint8)
            up[1:] = slcp[1:][::-1]
            if len(spos):
                up[0] = meet
            emit(np.concatenate((lpos, spos[::-1])), np.concatenate((llcp, up)))
    large_q.close()
    small_q.close()
