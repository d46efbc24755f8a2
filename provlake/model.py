"""Declarations: keys, fields, features and how they depend on each other. Plain values, no Spark."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, ClassVar

_PART = re.compile(r"[A-Za-z0-9_-]+\Z")
#: Hex characters to which version hashes are cut, unless a graph says otherwise.
HASH_CHARS = 8
LEAST_HASH_CHARS = 8


def digest(*pieces: str, chars: int = HASH_CHARS) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.encode())
    return h.hexdigest()[:chars]


def same_hash(a: str | None, b: str | None) -> bool:
    """Equal, or one cut shorter than the other, by no less than LEAST_HASH_CHARS."""
    if a is None or b is None:
        return a is b
    n = min(len(a), len(b))
    return a == b or (n >= LEAST_HASH_CHARS and a[:n] == b[:n])


@dataclass(frozen=True, order=True)
class Key:
    """A path of names, written ``a/b/c``."""

    parts: tuple[str, ...]

    @classmethod
    def of(cls, x: Any):
        if isinstance(x, cls):
            return x
        if isinstance(x, FeatureSpec | FieldSpec | Definition):
            return x.key
        parts = tuple(x.split("/")) if isinstance(x, str) else tuple(x)
        for p in parts:
            if not isinstance(p, str) or not _PART.match(p) or "__" in p:
                raise ValueError(f"invalid part {p!r} of the key {x!r}: letters, digits, '-' and single '_' only")
        if not parts:
            raise ValueError("a key needs a part")
        return cls(parts)

    def __str__(self) -> str:
        return "/".join(self.parts)

    @property
    def member(self) -> str:
        """Name as a member of a struct."""
        return "_".join(self.parts)

    @property
    def suffix(self) -> str:
        """What is appended to a column that comes from this feature."""
        return "__" + self.member

    @property
    def table(self) -> str:
        return "__".join(p.replace("-", "_") for p in self.parts)


class FeatureKey(Key):
    pass


class FieldKey(Key):
    pass


def fq(feature: FeatureKey, name: FieldKey) -> str:
    return f"{feature}.{name}"


# ------------------------------------------------------------------ fields
ALL = "*"


@dataclass(frozen=True)
class FieldDep:
    """Fields of one parent, or all of them, that a field is made from."""

    feature: FeatureKey
    fields: tuple[FieldKey, ...] | str = ALL

    @classmethod
    def of(cls, feature: Any, fields: Iterable[Any] | str = ALL) -> FieldDep:
        return cls(FeatureKey.of(feature), ALL if fields == ALL else tuple(FieldKey.of(f) for f in fields))


@dataclass(frozen=True)
class FieldSpec:
    key: FieldKey
    code_version: str = "1"
    #: None: inferred from the dependencies' mappings; ALL: every field of every parent.
    deps: tuple[FieldDep, ...] | str | None = None

    @classmethod
    def of(cls, x: Any) -> FieldSpec:
        if isinstance(x, FieldSpec):
            return x
        if isinstance(x, Mapping):
            deps = x.get("deps")
            if deps is not None and deps != ALL:
                deps = tuple(d if isinstance(d, FieldDep) else FieldDep.of(d["feature"], d.get("fields", ALL)) for d in deps)
            return cls(FieldKey.of(x["key"]), str(x.get("code_version", "1")), deps)
        return cls(FieldKey.of(x))


# ------------------------------------------------------------------ mappings of fields to parents' fields
@dataclass(frozen=True)
class FieldsMapping:
    """Which fields of a parent a field is made from when it doesn't say so itself.

    kind ``default``: those of the same key, with ``suffix`` also those that end in it, and all where
    none is; ``specific``: those of ``table``; ``all``; ``none``. ``exclude`` is left out by default.
    """

    kind: str = "default"
    suffix: bool = False
    exclude: frozenset[FieldKey] = frozenset()
    table: tuple[tuple[FieldKey, tuple[FieldKey, ...]], ...] = ()

    @classmethod
    def default(cls, suffix: bool = False, exclude: Iterable[Any] = ()) -> FieldsMapping:
        return cls("default", suffix, frozenset(FieldKey.of(x) for x in exclude))

    @classmethod
    def specific(cls, table: Mapping[Any, Iterable[Any]]) -> FieldsMapping:
        return cls("specific", table=tuple(sorted((FieldKey.of(k), tuple(sorted(FieldKey.of(x) for x in v))) for k, v in table.items())))

    @classmethod
    def every(cls) -> FieldsMapping:
        return cls("all")

    @classmethod
    def none(cls) -> FieldsMapping:
        return cls("none")

    def parents(self, name: FieldKey, there: Sequence[FieldKey]) -> set[FieldKey]:
        if self.kind == "none":
            return set()
        if self.kind == "all":
            return set(there)
        if self.kind == "specific":
            wanted = dict(self.table).get(name, ())
            if unknown := set(wanted) - set(there):
                raise ValueError(f"no such parent fields: {sorted(map(str, unknown))}")
            return set(wanted)
        pool = [x for x in there if x not in self.exclude]
        n = len(name.parts)
        found = {x for x in pool if x == name or (self.suffix and x.parts[-n:] == name.parts)}
        return found or set(pool)


# ------------------------------------------------------------------ lineage
@dataclass(frozen=True)
class Lineage:
    """How a parent's rows become a feature's: ``identity`` 1:1, ``aggregation`` N:1, ``expansion`` 1:N."""

    kind: str = "identity"
    on: tuple[str, ...] | None = None
    id_pattern: str | None = None

    @classmethod
    def identity(cls) -> Lineage:
        return cls()

    @classmethod
    def aggregation(cls, on: Sequence[str] | None = None) -> Lineage:
        return cls("aggregation", tuple(on) if on else None)

    @classmethod
    def expansion(cls, on: Sequence[str], id_pattern: str | None = None) -> Lineage:
        if not on:
            raise ValueError("an expansion needs the parent's columns")
        return cls("expansion", tuple(on), id_pattern)


@dataclass(frozen=True)
class FeatureDep:
    """An edge to a parent: which of its rows and columns are used, under which names, and how."""

    feature: FeatureKey
    select: tuple[str, ...] | None = None
    rename: tuple[tuple[str, str], ...] = ()
    mapping: FieldsMapping = field(default_factory=FieldsMapping)
    filters: tuple[str, ...] = ()
    lineage: Lineage = field(default_factory=Lineage)
    optional: bool = False

    @classmethod
    def of(cls, feature: Any, *, select: Sequence[str] | None = None, rename: Mapping[str, str] | None = None, mapping: FieldsMapping | None = None, filters: Sequence[str] = (), lineage: Lineage | None = None, optional: bool = False) -> FeatureDep:
        rename = dict(rename or {})
        if select is not None and (old := [c for c in select if c in rename and c not in rename.values()]):
            raise ValueError(f"select takes names after renaming; these are from before: {old}")
        return cls(FeatureKey.of(feature), None if select is None else tuple(select), tuple(rename.items()), mapping or FieldsMapping(), (filters,) if isinstance(filters, str) else tuple(filters), lineage or Lineage(), optional)

    @property
    def renames(self) -> dict[str, str]:
        return dict(self.rename)


@dataclass(frozen=True)
class FeatureSpec:
    key: FeatureKey
    id_columns: tuple[str, ...]
    fields: tuple[FieldSpec, ...]
    deps: tuple[FeatureDep, ...] = ()
    metadata: tuple[tuple[str, Any], ...] = ()
    description: str | None = None

    DEFAULT_FIELDS: ClassVar = (FieldSpec(FieldKey(("default",))),)

    def __post_init__(self) -> None:
        if not self.id_columns:
            raise ValueError(f"{self.key} needs id columns")
        for what, names in (("fields", [str(f.key) for f in self.fields]), ("fields' struct members", [f.key.member for f in self.fields]), ("dependencies", [str(d.feature) for d in self.deps]), ("id columns", list(self.id_columns))):
            if len(set(names)) < len(names):
                raise ValueError(f"{self.key} has {what} that collide: {names}")

    @property
    def by_key(self) -> dict[FieldKey, FieldSpec]:
        return {f.key: f for f in self.fields}

    @property
    def code_version(self) -> str:
        """Of the fields' code alone, without parents."""
        return digest(*(x for f in sorted(self.fields, key=lambda f: str(f.key)) for x in (str(f.key), f.code_version)))

    def as_dict(self) -> dict[str, Any]:
        deps = [{"feature": str(d.feature), "select": d.select, "rename": dict(d.rename), "mapping": {"kind": d.mapping.kind, "suffix": d.mapping.suffix, "exclude": sorted(map(str, d.mapping.exclude)), "table": {str(k): [str(x) for x in v] for k, v in d.mapping.table}}, "filters": list(d.filters), "lineage": {"kind": d.lineage.kind, "on": d.lineage.on, "id_pattern": d.lineage.id_pattern}, "optional": d.optional} for d in self.deps]
        fields = [{"key": str(f.key), "code_version": f.code_version, "deps": f.deps if f.deps is None or f.deps == ALL else [{"feature": str(x.feature), "fields": x.fields if x.fields == ALL else [str(k) for k in x.fields]} for x in f.deps]} for f in self.fields]
        return {"key": str(self.key), "id_columns": list(self.id_columns), "fields": fields, "deps": deps, "metadata": dict(self.metadata), "description": self.description}

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> FeatureSpec:
        deps = [FeatureDep.of(x["feature"], select=x.get("select"), rename=x.get("rename"), mapping=_mapping(x.get("mapping") or {}), filters=x.get("filters") or (), lineage=Lineage(x["lineage"]["kind"], tuple(x["lineage"]["on"]) if x["lineage"].get("on") else None, x["lineage"].get("id_pattern")) if x.get("lineage") else None, optional=bool(x.get("optional"))) for x in d.get("deps") or ()]
        return feature(d["key"], d["id_columns"], d.get("fields"), deps, metadata=d.get("metadata"), description=d.get("description"))

    @property
    def version(self) -> str:
        """Of everything that is declared."""
        return digest(json.dumps(self.as_dict(), sort_keys=True))


def _mapping(x: Mapping[str, Any]) -> FieldsMapping:
    if x.get("kind") == "specific":
        return FieldsMapping.specific(x.get("table") or {})
    return FieldsMapping(x.get("kind", "default"), bool(x.get("suffix")), frozenset(FieldKey.of(k) for k in x.get("exclude") or ()))


def feature(key: Any, id_columns: Sequence[str] | str, fields: Sequence[Any] | None = None, deps: Sequence[Any] = (), *, metadata: Mapping[str, Any] | None = None, description: str | None = None) -> FeatureSpec:
    """A feature's declaration, from plain values."""
    ids = (id_columns,) if isinstance(id_columns, str) else tuple(id_columns)
    got = tuple(FieldSpec.of(f) for f in fields) if fields else FeatureSpec.DEFAULT_FIELDS
    return FeatureSpec(FeatureKey.of(key), ids, got, tuple(d if isinstance(d, FeatureDep) else FeatureDep.of(d) for d in deps), tuple(sorted((metadata or {}).items())), description)


@dataclass(frozen=True)
class Definition:
    """A feature as registered: its declaration, its columns' schema and the project it belongs to."""

    spec: FeatureSpec
    project: str = "default"
    schema: str = "{}"
    origin: str = ""
    external: bool = False
    #: An external feature's field versions, where its project fixes them.
    pinned: tuple[tuple[str, str], ...] = ()
    pinned_version: str | None = None
    tags: tuple[tuple[str, str], ...] = ()

    @property
    def key(self) -> FeatureKey:
        return self.spec.key

    @property
    def version(self) -> str:
        return self.pinned_version or digest(self.spec.version, json.dumps(json.loads(self.schema), sort_keys=True))

    def as_external(self) -> Definition:
        return replace(self, external=True)
