"""The registry of features: a directed graph without cycles, its versions, walks and snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from .model import HASH_CHARS, LEAST_HASH_CHARS, Definition, FeatureKey, FeatureSpec, FieldKey, digest, fq
from .plans.plan import FeaturePlan


class MissingFeature(KeyError):
    """A feature that is asked for, or depended on, isn't registered."""


class FeatureGraph:
    def __init__(self, features: Iterable[Any] = (), *, project: str = "default", hash_chars: int = HASH_CHARS):
        if hash_chars < LEAST_HASH_CHARS:
            raise ValueError(f"hashes need {LEAST_HASH_CHARS} characters at least")
        self.project, self.hash_chars = project, hash_chars
        self.definitions: dict[FeatureKey, Definition] = {}
        self._versions: dict[str, str] = {}
        for f in features:
            self.add(f)

    # ---------------------------------------------------------------- registry
    def add(self, x: FeatureSpec | Definition, *, replace: bool = False) -> Definition:
        """Register. What is external gives way to what isn't, and never replaces it."""
        d = x if isinstance(x, Definition) else Definition(x, self.project)
        old = self.definitions.get(d.key)
        if old and not replace and not old.external:
            if d.external:
                return old
            if old != d:
                raise ValueError(f"{d.key} is already registered")
        tables = {k.table: k for k in self.definitions if k != d.key}
        if d.key.table in tables:
            raise ValueError(f"{d.key} and {tables[d.key.table]} would share the table {d.key.table}")
        self.definitions[d.key] = d
        self._versions = {}
        return d

    def remove(self, key: Any) -> None:
        self._need(key)
        del self.definitions[FeatureKey.of(key)]
        self._versions = {}

    def _need(self, key: Any) -> Definition:
        k = FeatureKey.of(key)
        if k not in self.definitions:
            raise MissingFeature(f"no feature {k}")
        return self.definitions[k]

    def __getitem__(self, key: Any) -> FeatureSpec:
        return self._need(key).spec

    def __contains__(self, key: Any) -> bool:
        return FeatureKey.of(key) in self.definitions

    def list(self, projects: Iterable[str] | str | None = None, *, external: bool = False) -> list[FeatureKey]:
        wanted = {projects} if isinstance(projects, str) else set(projects) if projects is not None else None
        return sorted(k for k, d in self.definitions.items() if (external or not d.external) and (wanted is None or d.project in wanted))

    def plan(self, key: Any) -> FeaturePlan:
        spec = self[key]
        missing = [str(d.feature) for d in spec.deps if d.feature not in self.definitions]
        if missing:
            raise MissingFeature(f"{spec.key} depends on what isn't registered: {missing}")
        return FeaturePlan(spec, tuple(self.definitions[d.feature].spec for d in spec.deps))

    # ---------------------------------------------------------------- versions
    def field_version(self, key: Any, name: Any) -> str:
        d, name = self._need(key), FieldKey.of(name)
        at = fq(d.key, name)
        if at not in self._versions:
            pinned = dict(d.pinned) if d.external else {}
            if str(name) in pinned:
                self._versions[at] = pinned[str(name)]
            else:
                plan = self.plan(d.key)
                above = [self.field_version(f, n) for f, n in plan.parents(name)]
                self._versions[at] = digest(at, d.spec.by_key[name].code_version, *above, chars=self.hash_chars)
        return self._versions[at]

    def field_versions(self, key: Any) -> dict[str, str]:
        return {str(f.key): self.field_version(key, f.key) for f in self[key].fields}

    def feature_version(self, key: Any) -> str:
        return digest(*(x for kv in sorted(self.field_versions(key).items()) for x in kv), chars=self.hash_chars)

    def project_version(self, project: str | None = None) -> str:
        own = [(k, d) for k, d in sorted(self.definitions.items()) if d.project == (project or self.project) and not d.external]
        return digest(*(x for k, d in own for x in (str(k), d.version)), chars=self.hash_chars) if own else "empty"

    # ---------------------------------------------------------------- walks
    def parents(self, key: Any) -> list[FeatureKey]:
        return sorted(d.feature for d in self[key].deps)

    def children(self, key: Any) -> list[FeatureKey]:
        k = FeatureKey.of(key)
        return sorted(x for x, d in self.definitions.items() if any(p.feature == k for p in d.spec.deps))

    def sorted(self, keys: Iterable[Any] | None = None, *, descending: bool = False) -> list[FeatureKey]:
        """Parents before children, by name among those that are free; descending: children first."""
        wanted = {FeatureKey.of(k) for k in keys} if keys is not None else set(self.definitions)
        left = {k: {d.feature for d in self.definitions[k].spec.deps} & set(self.definitions) for k in self.definitions}
        out: list[FeatureKey] = []
        while left:
            free = min((k for k, p in left.items() if not p), default=None)
            if free is None:
                raise ValueError(f"the graph has a cycle among {sorted(map(str, left))}")
            out.append(free)
            del left[free]
            for p in left.values():
                p.discard(free)
        out = [k for k in out if k in wanted]
        return out[::-1] if descending else out

    def _reach(self, keys: Iterable[Any], step, levels: int | None) -> set[FeatureKey]:
        edge = {FeatureKey.of(k) for k in keys}
        start, seen = set(edge), set(edge)
        while edge and (levels is None or levels > 0):
            edge = {n for k in edge if k in self.definitions for n in step(k)} - seen
            seen |= edge
            levels = None if levels is None else levels - 1
        return seen - start

    def downstream(self, *keys: Any, levels: int | None = None) -> list[FeatureKey]:
        return self.sorted(self._reach(keys, self.children, levels))

    def upstream(self, *keys: Any, levels: int | None = None) -> list[FeatureKey]:
        return self.sorted(self._reach(keys, self.parents, levels))

    def roots(self) -> list[FeatureKey]:
        return [k for k in self.sorted() if not self.definitions[k].spec.deps]

    def subgraph(self, *keys: Any, up: int | None = 0, down: int | None = 0) -> FeatureGraph:
        near = {FeatureKey.of(k) for k in keys} | self._reach(keys, self.parents, up) | self._reach(keys, self.children, down)
        g = FeatureGraph(project=self.project, hash_chars=self.hash_chars)
        for k in self.sorted(near):
            g.definitions[k] = self.definitions[k]
        return g

    def select(self, *, projects: Iterable[str] | None = None, keys: Iterable[Any] | None = None, everything: bool = False) -> list[FeatureKey]:
        """Features of any of the projects or among the keys, parents first."""
        if everything:
            return self.sorted()
        got = set(self.list(list(projects), external=True)) if projects is not None else set()
        return self.sorted(got | {self._need(k).key for k in keys or ()})

    # ---------------------------------------------------------------- snapshots
    def snapshot(self) -> dict[str, dict[str, Any]]:
        return {str(k): {"spec": d.spec.as_dict(), "schema": d.schema, "origin": d.origin, "project": d.project, "external": d.external, "feature_version": self.feature_version(k), "definition_version": d.version} for k, d in sorted(self.definitions.items())}

    @classmethod
    def from_snapshot(cls, data: Mapping[str, Mapping[str, Any]] | str, *, project: str = "default", hash_chars: int = HASH_CHARS) -> FeatureGraph:
        data = json.loads(data) if isinstance(data, str) else data
        g = cls(project=project, hash_chars=hash_chars)
        for x in data.values():
            g.add(Definition(FeatureSpec.from_dict(x["spec"]), x.get("project", project), x.get("schema") or "{}", x.get("origin") or "", bool(x.get("external"))))
        return g
