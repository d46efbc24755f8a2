"""From parents' tables to one frame: drop, rename, filter, select, apply lineage, join."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.filters import both
from ..functions.hashing import DEFAULT, hashed, of_fields
from ..model import HASH_CHARS, FeatureDep, FeatureKey, FeatureSpec
from ..plans.plan import FeaturePlan


def carried(name: str, parent: FeatureKey) -> str:
    return name + parent.suffix


def transform(df: DataFrame, dep: FeatureDep, parent: FeatureSpec, filters=None) -> DataFrame:
    """A parent's rows as the feature sees them; filters see the new names."""
    df = df.drop(*[c for c in df.columns if c in C.SYSTEM and c not in C.CARRIED])
    if C.DATA_BY_FIELD not in df.columns and C.PROV_BY_FIELD in df.columns:
        df = df.withColumn(C.DATA_BY_FIELD, C.col(C.PROV_BY_FIELD))
    names = dep.renames | {c: carried(c, dep.feature) for c in C.CARRIED}
    df = df.select(*[C.col(c).alias(names.get(c, c)) for c in df.columns])
    if dup := sorted({c for c in df.columns if df.columns.count(c) > 1}):
        raise ValueError(f"{dep.feature}: after renaming there are several columns {dup}")
    for f in (dep.filters, filters):
        if (cond := both(f)) is not None:
            df = df.where(cond)
    if dep.select is not None:
        need = [dep.renames.get(c, c) for c in (dep.lineage.on or ())] or [dep.renames.get(c, c) for c in parent.id_columns]
        system = [carried(c, dep.feature) for c in C.CARRIED if carried(c, dep.feature) in df.columns]
        keep = [*dep.select, *[c for c in need if c not in dep.select and c in df.columns], *system]
        df = df.select(*map(C.col, keep))
    return df


def _member(name: str):
    return lambda x: x[name]


def aggregate(df: DataFrame, dep: FeatureDep, parent: FeatureSpec, on: list[str], algorithm: str = DEFAULT, chars: int = HASH_CHARS) -> DataFrame:
    """N:1: every row gets the hashes of its whole group; rows stay.

    A group's values go in the order of the parent's ids through one aggregation, which is joined back:
    a hash a group, where a window would build the group's text anew for each of its rows.
    """
    data, prov = carried(C.DATA_BY_FIELD, dep.feature), carried(C.PROV_BY_FIELD, dep.feature)
    fields = [f.key.member for f in parent.fields]
    ids = [c for c in (dep.renames.get(c, c) for c in parent.id_columns) if c in df.columns] or on
    values = [C.member(df, data, f).alias(f"v{i}") for i, f in enumerate(fields)]
    rows = F.sort_array(F.collect_list(F.struct(*[C.col(c).cast("string").alias(f"o{i}") if C.is_map(df, c) else C.col(c).alias(f"o{i}") for i, c in enumerate(ids)], *values)))
    per = df.groupBy(*map(C.col, on)).agg(rows.alias("__rows__"))
    text = {f: F.array_join(F.transform("__rows__", _member(f"v{i}")), "|") for i, f in enumerate(fields)}
    per = per.select(*map(C.col, on), *[hashed(text[f], algorithm, chars).alias(f"__h{i}__") for i, f in enumerate(fields)])
    got = {f: C.col(f"__h{i}__") for i, f in enumerate(fields)}
    both_ = C.by_field(got, as_map=C.is_map(df, data))
    one = of_fields(got, algorithm, chars)
    per = per.select(*map(C.col, on), both_.alias(data), one.alias(carried(C.DATA, dep.feature)))
    per = per.withColumns({prov: C.col(data), carried(C.PROV, dep.feature): C.col(carried(C.DATA, dep.feature))})
    return df.drop(data, prov, carried(C.DATA, dep.feature), carried(C.PROV, dep.feature)).join(per, on, "left")


def _check_collisions(frames: list[tuple[FeatureDep, DataFrame]], ids: set[str]) -> None:
    seen: dict[str, FeatureKey] = {}
    for dep, df in frames:
        for c in df.columns:
            if c in ids or c.startswith(C.PREFIX):
                continue
            if c in seen:
                raise ValueError(f"{seen[c]} and {dep.feature} both bring a column {c}; rename or select")
            seen[c] = dep.feature


def join_parents(plan: FeaturePlan, frames: list[tuple[FeatureDep, DataFrame]]) -> DataFrame:
    """Required parents by inner joins, optional ones by left joins; by full joins if all are optional."""
    ids = plan.join_ids
    _check_collisions(frames, set(ids))
    required = [df for d, df in frames if not d.optional]
    optional = [df for d, df in frames if d.optional]
    if required:
        out = reduce(lambda a, b: a.join(b, ids, "inner"), required)
        return reduce(lambda a, b: a.join(b, ids, "left"), optional, out)
    return reduce(lambda a, b: a.join(b, ids, "full"), optional)


def prepare(plan: FeaturePlan, tables: Mapping[FeatureKey, DataFrame], *, filters: Mapping[FeatureKey, object] | None = None, algorithm: str = DEFAULT, chars: int = HASH_CHARS) -> DataFrame:
    """The parents joined, each after its own transformation and lineage."""
    plan.check()
    frames = []
    for dep in plan.spec.deps:
        parent = plan.by_feature[dep.feature]
        df = transform(tables[dep.feature], dep, parent, (filters or {}).get(dep.feature))
        if dep.lineage.kind == "aggregation":
            df = aggregate(df, dep, parent, plan.on(dep), algorithm, chars)
        frames.append((dep, df))
    shared = set(plan.join_ids)
    # ids of a parent that others carry too, but that aren't joined by, stay with the first
    out, seen = [], set(shared)
    for dep, df in frames:
        extra = [c for c in plan.spec.id_columns if c in df.columns and c in seen and c not in shared]
        out.append((dep, df.drop(*extra)))
        seen |= set(df.columns) & set(plan.spec.id_columns)
    return join_parents(plan, out)
