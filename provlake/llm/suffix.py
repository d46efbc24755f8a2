"""Suffix-array dedup: passages that repeat anywhere in the corpus, found by external induced sorting.

Every run of WORDS words is assigned to its anchor, the least hash among the runs of ANCHOR words in
it, so all copies of a passage meet in one shard without shuffling the corpus more than about twice.
A shard's distinct stretches of text are laid end to end and their suffixes sorted with
common-prefix lengths; suffixes that share WORDS words with a neighbour are repeats.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slice, mix, prefix_hash, shared_dir, span_hash, two, word_hashes
from .induced import BASE, BREAK, END, FIRST, IN_MEMORY, induced_sort

#: Words of the shortest passage that is reported.
WORDS = 50
#: Words of the runs whose least hash is an anchor.
ANCHOR = 8
#: Bits of a word's symbol in the suffix array, and in the check that follows.
SORT_BITS, CHECK_BITS = 12, 16
#: A shard is closed with the anchor that brings it to so many words.
SHARD_WORDS = 1 << 21


def anchored(column: pa.Array, words: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(key, row, first word in the row, first word in all, end in all, word hashes, hash prefix) of the
    stretch of each anchor: all runs of ``words`` words whose least run of ``anchor`` words it is."""
    h, first = word_hashes(column)
    z = np.zeros(0, np.int64)
    span = words - anchor + 1
    if len(h) < words:
        return z, z, z, z, z, h, prefix_hash(h)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    ph = prefix_hash(mix(h))
    starts = np.arange(len(h) - anchor + 1)
    g = span_hash(ph, starts, starts + anchor)
    bits = np.uint64(max(20, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = (g & ~low) | starts.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    at = (m & low).astype(np.int64)  # of the run that begins at each word
    ok = row[: len(at)] == row[words - 1 : words - 1 + len(at)]
    s = np.flatnonzero(ok)
    if not len(s):
        return z, z, z, z, z, h, ph
    a = at[s]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (row[s[1:]] != row[s[:-1]]))))
    begin, end = s[head], s[np.append(head[1:], len(s)) - 1] + words
    return g[a[head]].view(np.int64), row[begin], begin - first[row[begin]], begin, end, h, ph


def stretches(df: DataFrame, words: int, anchor: int) -> DataFrame:
    names = ["key", "whole", "doc_id", "start", "symbols"]

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            key, row, start, a, b, h, ph = anchored(part.column(1), words, anchor)
            symbols = (mix(h) >> np.uint64(64 - CHECK_BITS)).astype(np.uint16)
            size = b - a
            off = np.concatenate(([0], np.cumsum(size)))
            flat = symbols[np.repeat(a - off[:-1], size) + np.arange(off[-1])] if len(a) else symbols[:0]
            text = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((off * 2).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(span_hash(ph, a, b).view(np.int64) if len(a) else key), part.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), text], names=names)

        return run

    return by_slice(df, make, "key long, whole long, doc_id long, start int, symbols binary")


def shard_repeats(symbols: np.ndarray, off: np.ndarray, piece: np.ndarray, doc: np.ndarray, start: np.ndarray, words: int, **sort) -> tuple[np.ndarray, ...]:
    """(doc, start, runs, first doc, first start) of the repeats among the occurrences of the pieces.

    ``runs`` counts the runs of ``words`` words from start on whose first occurrence, by (doc, start),
    lies as far from the first's start.
    """
    n = np.diff(off)
    pieces = len(n)
    text = np.full(int(off[-1]) + pieces + 1, BREAK, np.uint16)
    base = off[:-1] + np.arange(pieces)  # each piece's place in the text
    where = np.repeat(base - off[:-1], n) + np.arange(off[-1])
    text[where] = (symbols >> (CHECK_BITS - SORT_BITS)) + FIRST
    text[-1] = END
    full = np.zeros(len(text), np.uint16)
    full[where] = symbols
    p = np.uint64(0x9E3779B97F4A7C55)
    power = np.full(words, p, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    # earliest occurrence of each piece
    order = np.lexsort((start, doc, piece))
    head = np.searchsorted(piece[order], np.arange(pieces))
    d0, s0, many = doc[order][head], start[order][head], np.bincount(piece, minlength=pieces)
    of = np.repeat(np.arange(pieces), n + 1)  # text place -> piece
    first_doc, first_start = np.full(len(text), -1, np.int64), np.full(len(text), -1, np.int64)
    hit = np.zeros(len(text), bool)
    room = np.zeros(len(text), bool)
    room[where] = np.arange(off[-1]) - np.repeat(off[:-1], n) <= np.repeat(n, n) - words
    own = room.copy()
    own[:-1] &= many[of] > 1
    own[-1] = False

    def note(places: np.ndarray, group: np.ndarray) -> None:
        """Places of equal groups hold equal runs: the earliest of each group is the first of all."""
        g, d, s = of[places], d0[of[places]], s0[of[places]] + places - base[of[places]]
        o = np.lexsort((s, d, group))
        group, places, d, s = group[o], places[o], d[o], s[o]
        new = np.concatenate(([True], group[1:] != group[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(group)))
        rep = np.repeat(size > 1, size) | (many[g[o]] > 1)
        hit[places[rep]] = True
        first_doc[places] = np.repeat(d[at], size)
        first_start[places] = np.repeat(s[at], size)

    def emit(sa: np.ndarray, lcp: np.ndarray) -> None:
        tied = lcp >= words
        if not tied.any():
            return
        group = np.cumsum(~tied)
        use = tied.copy()
        use[:-1] |= tied[1:]
        places, group = sa[use], group[use]
        check = np.zeros(len(places), np.uint64)
        for k in range(words):
            check += full[places + k].astype(np.uint64) * power[k]
        _, group = np.unique(np.stack((group.astype(np.uint64), check), 1), axis=0, return_inverse=True)
        note(places, group.reshape(-1))

    induced_sort(text, emit, cap=words, **sort)
    lone = np.flatnonzero(own & ~hit)
    if len(lone):
        hit[lone] = True
        first_doc[lone] = d0[of[lone]]
        first_start[lone] = s0[of[lone]] + lone - base[of[lone]]
    places = np.flatnonzero(hit)
    if not len(places):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    # stretches of places of one piece whose firsts go on side by side
    shift = first_start[places] - places
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (of[places[1:]] != of[places[:-1]]) | (first_doc[places[1:]] != first_doc[places[:-1]]) | (np.diff(shift) != 0)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(places)))
    run_piece = of[places[at]]
    lo, hi = np.searchsorted(run_piece, piece, "left"), np.searchsorted(run_piece, piece, "right")
    times = hi - lo
    occ = np.repeat(np.arange(len(piece)), times)
    run = np.repeat(lo - np.concatenate(([0], np.cumsum(times)))[:-1], times) + np.arange(times.sum())
    pl = places[at[run]]
    return doc[occ], start[occ] + pl - base[of[pl]], size[run], first_doc[pl], first_start[pl]


def _repeats(table: DataFrame, words: int, shard_words: int, folder: str | None, base: int, in_memory: int) -> DataFrame:
    names = ["doc_id", "start", "runs", "first_doc_id", "first_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if folder is None else os.path.join(folder, uuid.uuid4().hex)
        shard: list[tuple[np.ndarray, ...]] = []  # of closed anchors: symbols, sizes, piece, doc, start
        held: list[tuple] = []  # of the open anchor
        total = 0

        def arrays(b: pa.RecordBatch) -> tuple:
            raw = b.column(4)
            off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
            return tuple(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)) + (np.frombuffer(data.tobytes(), np.uint16), (off - off[0]) // 2)

        def collapse(parts: list[tuple]) -> tuple | None:
            """Rows of whole anchors to (keys, symbols, sizes, piece, doc, start): anchors that occur once go."""
            key, whole, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(4))
            flat = np.concatenate([p[4] for p in parts])
            size = np.concatenate([np.diff(p[5]) for p in parts])
            off = np.concatenate(([0], np.cumsum(size)))
            same = np.ones(len(key), bool)
            same[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
            keep = np.flatnonzero(same)  # a repeated row occurs once
            key, whole, doc, start, size, begin = key[keep], whole[keep], doc[keep], start[keep], size[keep], off[:-1][keep]
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            keep = np.repeat(np.diff(edge) > 1, np.diff(edge))
            if not keep.any():
                return None
            key, whole, doc, start, size, begin = (x[keep] for x in (key, whole, doc, start, size, begin))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
            piece = np.cumsum(new) - 1
            a, n = begin[new], size[new]
            o = np.concatenate(([0], np.cumsum(n)))
            return flat[np.repeat(a - o[:-1], n) + np.arange(o[-1])], n, piece, doc, start

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard, total
            if shard:
                symbols, n = np.concatenate([s[0] for s in shard]), np.concatenate([s[1] for s in shard])
                before = np.cumsum([0] + [len(s[1]) for s in shard])
                piece = np.concatenate([s[2] + k for s, k in zip(shard, before, strict=False)])
                doc, start = (np.concatenate([s[i] for s in shard]) for i in (3, 4))
                out = shard_repeats(symbols, np.concatenate(([0], np.cumsum(n))), piece, doc, start, words, folder=own, base=base, in_memory=in_memory)
                for i in range(0, len(out[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)].astype(np.int64)) for x in out], names=names)
            shard, total = [], 0

        def add(parts: list[tuple]) -> None:
            nonlocal total
            if parts and (got := collapse(parts)):
                shard.append(got)
                total += len(got[0])

        def thin(parts: list[tuple]) -> list[tuple]:
            """Of an anchor that fills batches, the text only once a piece."""
            b = parts[-1]
            size = np.diff(b[5])
            prior = parts[-2][1][-1] if len(parts) > 1 else None
            new = np.ones(len(size), bool)
            new[1:] = b[1][1:] != b[1][:-1]
            if prior is not None and b[1][0] == prior:
                new[0] = False
            keep = np.repeat(new, size)
            size = np.where(new, size, 0)
            return [*parts[:-1], (*b[:4], b[4][keep], np.concatenate(([0], np.cumsum(size))))]

        for b in batches:
            if not b.num_rows:
                continue
            now = arrays(b)
            if held and held[-1][0][-1] != now[0][0]:
                add(held)
                held = []
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            if cut:
                add([*held, (*(x[:cut] for x in now[:4]), now[4][: now[5][cut]], now[5][: cut + 1])])
                held = []
            held.append((*(x[cut:] for x in now[:4]), now[4][now[5][cut] :], now[5][cut:] - now[5][cut]))
            if cut == 0 and len(held) > 1:
                held = thin(held)
            if total >= shard_words:
                yield from close()
        add(held)
        yield from close()

    return table.mapInArrow(run, "doc_id long, start long, runs long, first_doc_id long, first_start long")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, base: int = BASE, in_memory: int = IN_MEMORY) -> DataFrame:
    """Passages of ``words`` words or more that occur more than once, each occurrence a row:
    (doc_id, start_word, n_words, first_doc_id, first_start_word, is_first).

    first_* is where the passage's first run of ``words`` words occurs first, by (doc_id, start_word);
    a passage is cut where that changes, so rows of a document may overlap by up to words - 1 words.
    All passages and all occurrences are reported, those within a document too. Removing rows with
    is_first false leaves one occurrence of everything.

    Words are runs of letters, digits and non-ASCII characters in lower case, so passages that differ
    in marks, case or spaces alike are the same; a differing word goes unnoticed once in 2**16.
    Null, empty and shorter texts and rows with a null id have no passages; a repeated row counts
    once; empty tables give empty results; other columns are ignored. One shuffle, of about 150 bytes
    for 22 words, then one of the repeats; no cap on occurrences. A shard holds its text, 6 bytes a
    word; queues of the sort beyond ``in_memory`` bytes are files in the shared folder, where that is
    a mounted path.
    """
    if not 2 <= anchor < words <= 250:
        raise ValueError("it must be that 2 <= anchor < words <= 250")
    shared = shared_dir(df.sparkSession)
    folder = shared.removeprefix("file://").removeprefix("file:") if shared.startswith(("file:", "/")) else None
    docs = two(df, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    table = stretches(docs, words, anchor).repartition("key").sortWithinPartitions("key", "whole", "doc_id", "start")
    runs = _repeats(table, words, shard_words, f"{folder}/induced" if folder else None, base, in_memory)
    # side by side in the document and at the first occurrence: one passage
    w = Window.partitionBy("doc_id").orderBy("start", "runs")
    key = F.struct("first_doc_id", (F.col("first_start") - F.col("start")).alias("shift"))
    runs = runs.withColumn("key", key)
    new = F.when((F.lag("key").over(w) == F.col("key")) & (F.lag(F.col("start") + F.col("runs")).over(w) >= F.col("start")), 0).otherwise(1)
    island = runs.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), (F.max(F.col("start") + F.col("runs")) - F.min("start") + (words - 1)).alias("n_words"), F.min("first_doc_id").alias("first_doc_id"), F.min("first_start").alias("first_start_word"))
    return out.select("doc_id", "start_word", "n_words", "first_doc_id", "first_start_word", ((F.col("doc_id") == F.col("first_doc_id")) & (F.col("start_word") == F.col("first_start_word"))).alias("is_first"))
