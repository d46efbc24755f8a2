"""Quality rules by compression bands: repetitive text compresses too well, noise hardly at all."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, two

#: From so many bytes on: least and greatest bytes-per-compressed-byte of a text of that length. Short
#: texts carry the frame's overhead and little context, so the bands rise and widen with the length.
BANDS = ((0, 0.0, 1e9), (64, 0.75, 2.0), (128, 0.95, 2.6), (256, 1.05, 3.0), (512, 1.15, 3.5), (1024, 1.4, 4.0), (4096, 1.4, 5.0), (16384, 1.4, 6.0))
CHUNK_BYTES = 4096
#: Rejected when more than this share of the text's bytes is in chunks outside the band of their length.
BAD_SHARE = 0.3
LEVEL = 3

SCHEMA = "doc_id long, n_bytes long, ratio double, chunk_min double, chunk_max double, bad_share double, keep boolean, reason string"


def band(n: int, bands=BANDS) -> tuple[float, float]:
    lo, hi = bands[0][1:]
    for start, a, b in bands:
        if n >= start:
            lo, hi = a, b
    return lo, hi


def judge(raw: bytes | None, size, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> tuple:
    """n_bytes, ratio, chunk_min, chunk_max, bad_share, keep, reason of one text; size() compresses.

    A null text is rejected as ``null``, one without bytes as ``empty``; both have null ratios.
    """
    if raw is None:
        return None, None, None, None, None, False, "null"
    if not raw:
        return 0, None, None, None, None, False, "empty"
    n = len(raw)
    ratio = n / size(raw)
    low = high = None
    bad = 0
    for at in range(0, n, chunk_bytes):
        piece = raw[at : at + chunk_bytes]
        r = ratio if len(piece) == n else len(piece) / size(piece)
        a, b = band(len(piece), bands)
        bad += len(piece) * (not a <= r <= b)
        low, high = r if low is None else min(low, r), r if high is None else max(high, r)
    a, b = band(n, bands)
    reason = "repetitive" if ratio > b else "incompressible" if ratio < a else "bad_chunks" if bad > bad_share * n else None
    return n, ratio, low, high, bad / n, reason is None, reason


def compression_bands(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE, level: int = LEVEL) -> DataFrame:
    """One row per input row: its compression ratios, and whether it stays.

    Whole texts and their fixed chunks are compressed with zstandard. Narrow: no shuffle, memory for
    one batch. Null text: keep false, reason ``null``. Empty text: ``empty``. Texts shorter than the
    second band's start are kept. Repeated rows are judged each; a null id is carried. An empty table
    gives an empty result. Other columns are ignored.
    """

    def make():
        comp = zstandard.ZstdCompressor(level=level)

        def size(b: bytes) -> int:
            return len(comp.compress(b))

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [judge(x.as_buffer().to_pybytes() if x.is_valid else None, size, bands, chunk_bytes, bad_share) for x in part.column(1)]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return run

    return by_slice(two(df, id_col, text_col), make, SCHEMA)


def kept(df: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows that the rules keep, whole, with just the columns of df; see compression_bands."""
    names = df.columns
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = inner.schema
    text = f"c{names.index(text_col)}"
    bands, chunk, share, level = (params.get(k, v) for k, v in (("bands", BANDS), ("chunk_bytes", CHUNK_BYTES), ("bad_share", BAD_SHARE), ("level", LEVEL)))

    def make():
        comp = zstandard.ZstdCompressor(level=level)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            t = part.column(part.schema.get_field_index(text))
            ok = [judge(x.as_buffer().to_pybytes() if x.is_valid else None, lambda b: len(comp.compress(b)), bands, chunk, share)[5] for x in t]
            return part.filter(pa.array(ok, pa.bool_()))

        return run

    out = by_slice(inner, make, schema, text)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
