"""Packing by shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slice, two, written
from .tokens import TOKENIZERS, byte_bpe

#: Tokens of a pack.
CONTEXT = 2048
#: Tokens that follow each document's own.
END_TOKENS = 1


def patterns(histogram: dict[int, int], context: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used, for so many pieces of each length up to context.

    Lengths go longest first. Each goes to the packs with the fewest tokens, so the most room; packs
    of one content are handled as one pattern with a count, so the work depends on the context's
    size and not on the number of documents.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, left: int) -> None:
        (room[left] if left else done).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        spaces = sorted((s for s, p in room.items() if p and s >= length), reverse=True)
        new: list[tuple[tuple[int, ...], int, int]] = []
        for space in spaces:
            while todo and room[space]:
                pattern, count = room[space].pop()
                used = min(count, todo)
                if count > used:
                    room[space].append((pattern, count - used))
                new.append(((*pattern, length), used, space - length))
                todo -= used
            if not todo:
                break
        # what was just opened may still have room for the same length
        while todo:
            fits = [x for x in new if x[2] >= length]
            if not fits:
                each = context // length
                full, rest = divmod(todo, each)
                if full:
                    put((length,) * each, full, context - each * length)
                if rest:
                    put((length,) * rest, 1, context - rest * length)
                todo = 0
                break
            best = max(fits, key=lambda x: x[2])
            new.remove(best)
            pattern, count, left = best
            used = min(count, todo)
            if count > used:
                new.append((pattern, count - used, left))
            new.append(((*pattern, length), used, left - length))
            todo -= used
        for p in new:
            put(*p)
    return done + [x for left in sorted(room) for x in room[left]]


def slots(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, packs, first pack, offset in the pack, how many there side by side), by length and rank.

    A length goes in a pattern as one row however often, and a pattern has at most sqrt(2 * context)
    different lengths; so the rows are bounded by the context alone, about 64 a pattern for 2048.
    """
    at: dict[int, int] = defaultdict(int)
    rows, pack = [], 0
    for pattern, count in found:
        offset = 0
        for length in dict.fromkeys(pattern):
            many = pattern.count(length)
            rows.append((length, at[length], count, pack, offset, many))
            at[length] += count * many
            offset += length * many
        pack += count
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def placed(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pack and offset of the pieces of a length by their rank among those of the length."""
    shift = 40
    k = np.searchsorted((table[:, 0] << shift) + table[:, 1], (length << shift) + rank, "right") - 1
    i, many = rank - table[k, 1], table[k, 5]
    return table[k, 3] + i // many, table[k, 4] + i % many * length


def pieces(df: DataFrame, id_col: str, text_col: str, context: int, end_tokens: int, tokenizers: str) -> DataFrame:
    """(doc_id, piece, start, n_tokens): each text's tokens, and its end, cut at multiples of context."""

    def make():
        encode = byte_bpe(tokenizers).encode_ordinary

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            n = np.array([len(encode(t)) + end_tokens if t else 0 for t in part.column(1).to_pylist()], np.int64)
            many = -(-n // context)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * context
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(np.minimum(context, n[row] - start).astype(np.int32))], names=["doc_id", "piece", "start", "n_tokens"])

        return run

    return by_slice(two(df, id_col, text_col), make, "doc_id long, piece int, start long, n_tokens int")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, context: int = CONTEXT, end_tokens: int = END_TOKENS, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Where each piece of each text goes: (doc_id, piece, start, n_tokens, pack_id, pack_offset).

    Texts are tokenized, ``end_tokens`` added, and cut into pieces of up to ``context`` tokens. The
    histogram of lengths, at most ``context`` rows, goes to the driver, which makes the patterns; the
    i-th piece of a length, in the order of (doc_id, piece, start), takes the i-th slot of that length.
    So the result doesn't depend on how the rows are partitioned. Packs number from 0; no pack holds
    more than ``context`` tokens; each piece is in one pack.

    Ranks are taken within ranges of ids, with offsets from the ranges' counts, so no task sees all
    pieces of a length, however many rows an id has. Only (doc_id, piece, start, n_tokens) is shuffled.
    Null and empty texts have no pieces, very long ones many; ids are cast to long, a null id is an id
    like others, before them; repeated rows each have pieces, of equal ones any first; an empty table
    gives an empty result; other columns are ignored.
    """
    cut = written(pieces(df, id_col, text_col, context, end_tokens, tokenizers), "pieces")
    # equal pieces may be dealt to several ranges: their order doesn't matter
    order = ("doc_id", "piece", "start", "n_tokens")
    ranges = cut.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange(*order, "deal").withColumn("part", F.spark_partition_id()).drop("deal")
    cut = written(ranges, "ranged-pieces")
    counts = written(cut.groupBy("n_tokens", "part").agg(F.count("*").alias("c")), "piece-counts")
    table = slots(patterns({r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("c")).collect()}, context))
    before = counts.select("n_tokens", "part", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("part")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "n_tokens").orderBy("doc_id", "piece", "start"))
    ranked = cut.withColumn("i", inside).join(before.hint("merge"), ["n_tokens", "part"]).select("doc_id", "piece", "start", "n_tokens", (F.col("i") - 1 + F.col("before")).alias("rank"))

    def place(batches):
        for b in batches:
            pack, offset = placed(table, b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(pack), pa.array(offset.astype(np.int32))], names=["doc_id", "piece", "start", "n_tokens", "pack_id", "pack_offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, n_tokens int, pack_id long, pack_offset int")
