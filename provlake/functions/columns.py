"""Names and kinds of the engine's own columns, and the per-field column as a struct or a map."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "lake_"
PROV_BY_FIELD, PROV = PREFIX + "provenance_by_field", PREFIX + "provenance"
DATA_BY_FIELD, DATA = PREFIX + "data_version_by_field", PREFIX + "data_version"
FEATURE_VERSION, PROJECT_VERSION = PREFIX + "feature_version", PREFIX + "project_version"
CREATED, UPDATED, DELETED = PREFIX + "created_at", PREFIX + "updated_at", PREFIX + "deleted_at"
RUN = PREFIX + "materialization_id"
DEFINITION_VERSION = PREFIX + "definition_version"

SYSTEM = frozenset({PROV_BY_FIELD, PROV, DATA_BY_FIELD, DATA, FEATURE_VERSION, PROJECT_VERSION, CREATED, UPDATED, DELETED, RUN, DEFINITION_VERSION})
#: Carried through a join under the parent's name; the rest of SYSTEM stays behind.
CARRIED = (PROV_BY_FIELD, PROV, DATA_BY_FIELD, DATA)
KINDS = {PROV: "string", DATA: "string", FEATURE_VERSION: "string", PROJECT_VERSION: "string", CREATED: "timestamp", UPDATED: "timestamp", DELETED: "timestamp", RUN: "string"}


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_map(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.MapType)


def member(df: DataFrame, column: str, name: str) -> Column:
    """A field's value as a string; null where a map lacks it."""
    c = col(column)
    return (F.element_at(c, F.lit(name)) if is_map(df, column) else c.getField(name)).cast("string")


def members(df: DataFrame, column: str) -> list[str]:
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"{column} must be a struct to list its members, not {kind.simpleString()}")
    return kind.names


def by_field(values: Mapping[str, Column], *, as_map: bool = False) -> Column:
    if as_map:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.struct(*[v.alias(k) for k, v in values.items()])


def struct_to_map(df: DataFrame, column: str) -> Column:
    names = members(df, column)
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[col(column).getField(n).cast("string") for n in names]))


def map_to_struct(column: str, names: Iterable[str]) -> Column:
    return F.struct(*[F.element_at(col(column), F.lit(n)).alias(n) for n in names])


def typed(df: DataFrame) -> DataFrame:
    """Own columns that are untyped nulls get their types."""
    void = {n: col(n).cast(KINDS[n]) for n, k in df.dtypes if k == "void" and n in KINDS}
    return df.withColumns(void) if void else df


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SYSTEM]
