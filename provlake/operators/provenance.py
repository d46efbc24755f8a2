"""Hashes that say what each field of each row was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.hashing import DEFAULT, hashed, joined, of_fields
from ..model import HASH_CHARS, fq
from ..plans.plan import FeaturePlan
from .prepare import carried


def add_provenance(df: DataFrame, plan: FeaturePlan, *, algorithm: str = DEFAULT, chars: int = HASH_CHARS, as_map: bool = False) -> DataFrame:
    """df with the four version columns, from its parents' data versions, which go.

    A field's hash is of its key, its code's version, and each parent field's full name and data
    version. A missing optional parent counts as an empty version; a null one of a required parent
    makes the hash null.
    """
    optional = {d.feature for d in plan.spec.deps if d.optional}
    missing = [c for c in (carried(C.DATA_BY_FIELD, d.feature) for d in plan.spec.deps) if c not in df.columns]
    if missing:
        raise ValueError(f"parents' data versions are missing: {missing}")
    hashes: dict[str, Column] = {}
    for f in plan.spec.fields:
        parts: list[Column | str] = [str(f.key), f.code_version]
        for parent, name in plan.parents(f.key):
            v = C.member(df, carried(C.DATA_BY_FIELD, parent), name.member)
            parts += [fq(parent, name), F.coalesce(v, F.lit("")) if parent in optional else v]
        hashes[f.key.member] = hashed(joined(parts), algorithm, chars)
    names = {k: f"__p{i}__" for i, k in enumerate(hashes)}
    drop = {carried(c, d.feature) for d in plan.spec.deps for c in C.CARRIED}
    keep = [c for c in df.columns if c not in drop and c not in C.CARRIED]
    df = df.select(*map(C.col, keep), *[hashes[k].alias(n) for k, n in names.items()])
    got = {k: C.col(n) for k, n in names.items()}
    one, each = of_fields(got, algorithm, chars), C.by_field(got, as_map=as_map)
    return df.select(*map(C.col, keep), each.alias(C.PROV_BY_FIELD), one.alias(C.PROV), each.alias(C.DATA_BY_FIELD), one.alias(C.DATA))


def complete(df: DataFrame, fields: list[str], *, algorithm: str = DEFAULT, chars: int = HASH_CHARS) -> DataFrame:
    """df with what follows from its per-field provenance: one hash, and data versions where none are given."""
    if C.PROV_BY_FIELD not in df.columns:
        raise ValueError(f"a column {C.PROV_BY_FIELD} is needed")
    value = lambda c: {f: C.member(df, c, f) for f in fields}
    if C.PROV not in df.columns:
        df = df.withColumn(C.PROV, of_fields(value(C.PROV_BY_FIELD), algorithm, chars))
    if C.DATA_BY_FIELD not in df.columns:
        df = df.withColumn(C.DATA_BY_FIELD, C.col(C.PROV_BY_FIELD))
        return df.withColumn(C.DATA, C.col(C.PROV)) if C.DATA not in df.columns else df
    own = C.col(C.DATA_BY_FIELD).isNotNull()
    one = C.col(C.DATA) if C.DATA in df.columns else F.when(own, of_fields(value(C.DATA_BY_FIELD), algorithm, chars))
    return df.withColumns({C.DATA: F.coalesce(one, C.col(C.PROV)), C.DATA_BY_FIELD: F.when(own, C.col(C.DATA_BY_FIELD)).otherwise(C.col(C.PROV_BY_FIELD))})
