"""Looking at rows: sorted heads, and nested values as short JSON text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col


def top(df: DataFrame, n: int, by: Sequence[str] = (), *, descending: bool = False) -> DataFrame:
    """The first n rows, in an order if one is given."""
    order = [col(c).desc_nulls_last() if descending else col(c).asc_nulls_first() for c in by]
    return (df.orderBy(*order) if order else df).limit(n)


def as_text(df: DataFrame, name: str, *, most: int = 4) -> Column:
    """A value as text: lists of more than ``most`` keep their ends around ``...``, the rest is JSON."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.ArrayType):
        item = (lambda x: F.to_json(x)) if isinstance(kind.elementType, T.StructType | T.MapType | T.ArrayType) else (lambda x: x.cast("string"))
        each = F.transform(F.array_compact(c), item)
        ends = F.concat(F.slice(each, 1, most // 2), F.array(F.lit("...")), F.slice(each, -(most - most // 2), most - most // 2))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(F.when(F.size(each) > most, ends).otherwise(each), ","), F.lit("]")))
    if isinstance(kind, T.StructType | T.MapType):
        return F.to_json(c)
    return c.cast("string")


def preview(df: DataFrame, n: int = 20, *, most: int = 4) -> DataFrame:
    return df.select(*[as_text(df, c, most=most).alias(c) for c in df.columns]).limit(n)


def partition_filter(values: Mapping[str, Any]) -> Column | None:
    """``==`` for one key of a column, ``IN`` for several; None where there are none."""
    conds = []
    for name, v in values.items():
        keys = [v] if isinstance(v, str) or not isinstance(v, Sequence) else list(v)
        if keys:
            conds.append(col(name) == keys[0] if len(keys) == 1 else col(name).isin(*keys))
    return reduce(lambda a, b: a & b, conds) if conds else None


def decoded(df: DataFrame, name: str, schema: str) -> DataFrame:
    """A column of JSON text as a struct or map; what doesn't parse is null."""
    return df.withColumn(name, F.from_json(col(name), schema))
