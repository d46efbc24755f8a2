"""Hashes of strings as columns. md5 and sha256 are Spark's own; others are Arrow functions or refused."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import HASH_CHARS

MD5, SHA256, XXHASH64, XXHASH32, WYHASH, FARMHASH = "md5", "sha256", "xxhash64", "xxhash32", "wyhash", "farmhash"
NATIVE_XXHASH64 = "spark_xxhash64"
DEFAULT = MD5
SUPPORTED = (MD5, SHA256, XXHASH64, XXHASH32, NATIVE_XXHASH64)


class UnsupportedHash(ValueError):
    pass


def check(algorithm: str) -> str:
    if algorithm not in SUPPORTED:
        raise UnsupportedHash(f"{algorithm} isn't among {', '.join(SUPPORTED)}")
    return algorithm


def _arrow(bits: int):
    import pandas as pd

    def run(s):
        import xxhash

        f = xxhash.xxh64_intdigest if bits == 64 else xxhash.xxh32_intdigest
        return s.map(lambda x: None if x is None else str(f(x)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def hashed(c: Column, algorithm: str = DEFAULT, chars: int | None = HASH_CHARS) -> Column:
    """The hash of a string column, cut to ``chars``; null stays null.

    xxhash32 and xxhash64 have seed 0 and are decimal, by an Arrow function. spark_xxhash64 is Spark's
    own, of seed 42, so of other digits, but runs in generated code.
    """
    check(algorithm)
    if algorithm == MD5:
        h = F.md5(c)
    elif algorithm == SHA256:
        h = F.sha2(c, 256)
    elif algorithm == NATIVE_XXHASH64:
        h = F.when(c.isNotNull(), F.xxhash64(c).cast("string"))
    else:
        h = _arrow(64 if algorithm == XXHASH64 else 32)(c)
    return h if chars is None else F.substring(h, 1, chars)


def joined(parts: list[Column | str]) -> Column:
    """Parts with ``|`` between; null if any is. Neighbouring literals become one."""
    out: list[Column | str] = []
    for i, p in enumerate(parts):
        sep = "|" if i else ""
        if isinstance(p, str):
            if out and isinstance(out[-1], str):
                out[-1] += sep + p
            else:
                out.append(sep + p)
        else:
            if sep and out and isinstance(out[-1], str):
                out[-1] += sep
            elif sep:
                out.append(sep)
            out.append(p)
    cols = [F.lit(x) if isinstance(x, str) else x for x in out]
    return cols[0] if len(cols) == 1 else F.concat(*cols)


def of_fields(values: Mapping[str, Column], algorithm: str = DEFAULT, chars: int | None = HASH_CHARS) -> Column:
    """One hash of all fields' hashes, in the order of their names."""
    return hashed(joined([values[k] for k in sorted(values)]), algorithm, chars)
