"""What the text operators share: Arrow batch walking, vectorised word hashing and shared-folder tables.

Everything heavy is numpy over the raw Arrow buffers of a text column, a slice of about a megabyte at
a time, so the memory of a Python worker doesn't depend on the size of a partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
#: Words, of 8 bytes, of a filter that is sent to all tasks.
FILTER_WORDS = 1 << 20
#: Bytes of an Arrow batch on its way to or from Python, where the session has Spark's default of 64 MB.
BATCH_BYTES = 4 << 20
_OWN_DIR: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="provlake-"))
        at = _OWN_DIR[0]
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, outlives executors and has known sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id, as a long, and the text: columns of the input with clashing names play no part."""
    bounded(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small: a task holds them several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give memory that a finished task has freed back to the system; the Python worker lives on."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def fresh_ids(slots: int = 1 << 20) -> Callable[[np.ndarray], np.ndarray]:
    """Which ids come for the first time, as far as ``slots`` of 8 bytes remember: a repeat may be forgotten,
    a new id is never taken for a repeat."""
    seen = np.zeros(slots, np.int64)

    def fresh(ids: np.ndarray) -> np.ndarray:
        ids = ids.view(np.int64)
        new = np.zeros(len(ids), bool)
        new[np.unique(ids, return_index=True)[1]] = True
        slot = ids & (slots - 1)
        new &= (seen[slot] != ids) | (ids == 0)
        seen[slot] = ids
        return new

    return fresh


def id_filter(hashes: DataFrame, words: int = FILTER_WORDS) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """From a column of 64-bit hashes a filter for tasks that passes all of them, and few others: two bits a hash in one of ``words`` words.

    At most 16 bytes a word go to the driver and 8 to the tasks, whatever the number of hashes. Of very
    many nearly everything passes, so an exact join has to follow.
    """
    h = F.col(hashes.columns[0])
    bits = F.expr("shiftleft(1L, cast(h & 63 AS INT)) | shiftleft(1L, cast(shiftright(h, 6) & 63 AS INT))")
    got = hashes.select(h.alias("h")).select(F.pmod(F.shiftright("h", 12), F.lit(words)).alias("word"), bits.alias("bits"))
    table = got.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = np.zeros(words, np.int64)
    full[table.column(0).to_numpy()] = table.column(1).to_numpy()
    sent = hashes.sparkSession.sparkContext.broadcast(full)

    def make():
        def passes(h: np.ndarray) -> np.ndarray:
            want = (np.int64(1) << (h & 63)) | (np.int64(1) << ((h >> 6) & 63))
            return (sent.value[(h >> 12) % words] & want) == want

        return passes

    return make


def by_slice(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]], schema: T.StructType | str, text: str = "text") -> DataFrame:
    """mapInArrow with batches cut into slices of about SLICE_BYTES of text; make() runs once a task."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        try:
            for batch in batches:
                for part in slices(batch, text):
                    out = f(part)
                    if out is None:
                        continue
                    yield from ([out] if isinstance(out, pa.RecordBatch) else out)
        finally:
            release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    cum = np.cumsum(lens.to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < n:
        base = cum[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(cum, base + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offset of each row in them, and the end; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


# ---------------------------------------------------------------- hashing of words
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n + 1:
        size = max(n + 1, SLICE_BYTES + (SLICE_BYTES >> 2))
        for k, b in (("p", _BASE), ("i", _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POW[k] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(units: np.ndarray) -> np.ndarray:
    """h with (h[e] - h[s]) * inverse[s] the polynomial hash of units[s:e], modulo 2**64."""
    p, _ = powers(len(units))
    h = np.empty(len(units) + 1, np.uint64)
    h[0] = 0
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * p[: len(units)], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h) - 1)
    return mix((h[e] - h[s]) * inv[s])


def lower(data: np.ndarray) -> np.ndarray:
    """Letters of ASCII and of the Latin-1 block in lower case."""
    out = _LOWER[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 32
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of ASCII letters, digits and non-ASCII characters."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = _WORD[data]
    edge = np.zeros(len(data) + 2, bool)  # a row's first byte
    edge[1 + off[:-1][off[:-1] < len(data)]] = True
    s = np.flatnonzero(m[1:-1] & (~m[:-2] | edge[1:-1]))
    e = np.flatnonzero(m[1:-1] & (~m[2:] | edge[2:])) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, in order, and the first word of each row, and their number."""
    data, off = buffers(column)
    s, e, row = word_spans(data, off)
    return span_hash(prefix_hash(lower(data)), s, e), np.searchsorted(row, np.arange(len(off)), "left")


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words, and the row of each; a row of 1 to n - 1 words is one run."""
    count = np.diff(first)
    row_of = np.repeat(np.arange(len(count)), count)
    if not len(h):
        return h, row_of
    acc = h.copy()
    same = np.ones(len(h), bool)
    c = np.uint64(0x9E3779B97F4A7C15)
    for j in range(1, n):
        nxt = np.zeros(len(h), np.uint64)
        nxt[:-j or None] = h[j:] if j < len(h) else nxt[:0]
        inside = np.zeros(len(h), bool)
        if j < len(h):
            inside[:-j] = row_of[j:] == row_of[:-j]
        acc = np.where(inside, acc * c + nxt, acc)
        same &= inside
    start = np.zeros(len(h), bool)
    start[first[:-1][count > 0]] = True
    keep = same | (start & (count[row_of] < n))
    return mix(acc[keep]), row_of[keep]


def distinct_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the distinct shingle hashes, sorted: (hashes, how often each, offsets of rows)."""
    h, first = word_hashes(column)
    g, row = shingles(h, first, n)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(g)))
    return g[at], tf, np.searchsorted(row[at], np.arange(len(column) + 1), "left")


def list_column(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))
