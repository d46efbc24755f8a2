"""A feature with its parents: what the operators need to know to build its query."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import columns as C
from ..model import ALL, FeatureDep, FeatureKey, FeatureSpec, FieldKey, fq


@dataclass(frozen=True)
class FeaturePlan:
    spec: FeatureSpec
    parent_specs: tuple[FeatureSpec, ...]

    @property
    def by_feature(self) -> dict[FeatureKey, FeatureSpec]:
        return {s.key: s for s in self.parent_specs}

    def parents(self, name: FieldKey) -> list[tuple[FeatureKey, FieldKey]]:
        """The parents' fields that a field is made from, by their full names."""
        if not self.spec.deps:
            return []
        own = self.spec.by_key[name].deps
        got: set[tuple[FeatureKey, FieldKey]] = set()
        if own == ALL:
            got = {(s.key, f.key) for s in self.parent_specs for f in s.fields}
        elif own:
            for d in own:
                there = self.by_feature[d.feature].by_key
                if d.fields != ALL and (unknown := [str(f) for f in d.fields if f not in there]):
                    raise ValueError(f"{d.feature} has no fields {unknown}")
                got |= {(d.feature, f) for f in (there if d.fields == ALL else d.fields)}
        else:
            for d in self.spec.deps:
                got |= {(d.feature, f) for f in d.mapping.parents(name, list(self.by_feature[d.feature].by_key))}
            if not got:
                raise RuntimeError(f"the field {name} of {self.spec.key} comes from no parent's field; name some, or change a mapping")
        return sorted(got, key=lambda x: fq(*x))

    def on(self, dep: FeatureDep) -> list[str]:
        """Columns by which a parent's rows are one unit of input, after its lineage."""
        if dep.lineage.kind == "aggregation":
            return list(dep.lineage.on or self.spec.id_columns)
        if dep.lineage.kind == "expansion":
            return list(dep.lineage.on or ())
        return [dep.renames.get(c, c) for c in self.by_feature[dep.feature].id_columns]

    @property
    def input_ids(self) -> list[str]:
        """Columns that all parents' units have in common, sorted."""
        sets = [set(self.on(d)) for d in self.spec.deps]
        return sorted(set.intersection(*sets)) if sets else []

    @property
    def join_ids(self) -> list[str]:
        ids = self.input_ids or [c for c in self.spec.id_columns if all(c in self.on(d) for d in self.spec.deps)]
        if not ids:
            raise ValueError(f"the parents of {self.spec.key} share no columns to join by")
        return ids

    @property
    def compare_ids(self) -> list[str]:
        """Columns by which expected rows meet stored ones."""
        return self.join_ids if self.spec.deps else list(self.spec.id_columns)

    @property
    def expands(self) -> bool:
        return any(d.lineage.kind == "expansion" for d in self.spec.deps)

    def check(self) -> None:
        """Names that can't work: renames to system or id columns, or to one name twice."""
        for d in self.spec.deps:
            ids, new = self.by_feature[d.feature].id_columns, list(d.renames.values())
            if bad := [x for x in new if x in C.SYSTEM]:
                raise ValueError(f"{d.feature}: renaming to system columns {bad}")
            if bad := [x for x in new if x in ids and d.renames.get(x, x) == x]:
                raise ValueError(f"{d.feature}: renaming to its id columns {bad}")
            if len(set(new)) < len(new):
                raise ValueError(f"{d.feature}: two columns are renamed to one: {sorted(new)}")
        ids = {c for d in self.spec.deps for c in self.on(d)} | set(self.spec.id_columns)
        seen: dict[str, FeatureKey] = {}
        for d in self.spec.deps:
            for c in (d.select or ()) if d.select is not None else d.renames.values():
                if c not in ids and seen.setdefault(c, d.feature) != d.feature:
                    raise ValueError(f"{d.feature} and {seen[c]} both bring a column {c}")
