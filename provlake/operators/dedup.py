"""The latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind)
    return not isinstance(kind, T.MapType)


def keep_latest(df: DataFrame, ids: Sequence[str], by: Sequence[str], ties: Sequence[str] = (), *, whole: bool = True) -> DataFrame:
    """Of the rows of each id the one for which the first non-null of ``by`` is greatest, as a whole row.

    Ties go by ``ties`` and then, if ``whole``, by a hash of the row, so the result doesn't depend on the
    order of rows; without it a scan reads no columns but those that are asked for, and rows that tie
    in all of ``ties`` are taken for the same. A row whose ``by`` are all null comes last. Null ids are an id. Spark drops the losers of
    each task before the shuffle.
    """
    last = [F.xxhash64(*[col(f.name) for f in df.schema if _comparable(f.dataType)]).desc()] if whole else []
    order = [F.coalesce(*map(col, by)).desc_nulls_last(), *[col(c).desc_nulls_last() for c in ties], *last]
    rank = F.row_number().over(Window.partitionBy(*map(col, ids)).orderBy(*order))
    return df.withColumn("__rank__", rank).where("__rank__ = 1").drop("__rank__")


def tail(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """The last n rows in an order, in that order."""
    return df.orderBy(*[col(c).desc_nulls_last() for c in by]).limit(n).orderBy(*[col(c).asc_nulls_first() for c in by])
