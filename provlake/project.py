"""A project's configuration and lock file, in TOML and JSON."""

from __future__ import annotations

import importlib
import json
import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from .graph import FeatureGraph
from .model import HASH_CHARS, Definition, FeatureSpec
from .sources.store import Store


@dataclass
class Config:
    project: str = "default"
    #: Modules that declare features: each has FEATURES, a list of specs.
    entrypoints: list[str] = field(default_factory=list)
    stores: dict[str, dict[str, Any]] = field(default_factory=dict)
    store: str = "dev"
    hash_chars: int = HASH_CHARS

    @classmethod
    def load(cls, path: str = "provlake.toml") -> Config:
        """From a file; PROVLAKE_PROJECT and PROVLAKE_STORE override it."""
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        if unknown := sorted(set(raw) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown settings: {unknown}")
        c = cls(**raw)
        c.project = os.environ.get("PROVLAKE_PROJECT", c.project)
        c.store = os.environ.get("PROVLAKE_STORE", c.store)
        return c

    def graph(self) -> FeatureGraph:
        g = FeatureGraph(project=self.project, hash_chars=self.hash_chars)
        for name in self.entrypoints:
            for spec in importlib.import_module(name).FEATURES:
                g.add(spec)
        return g

    def open_store(self, spark: SparkSession, name: str | None = None, graph: FeatureGraph | None = None) -> Store:
        name = name or self.store
        if name not in self.stores:
            raise KeyError(f"no store {name}; there are {sorted(self.stores)}")
        opts = dict(self.stores[name])
        g = graph or self.graph()
        return Store(spark, opts.pop("path"), g, name=name, fallbacks=[self.open_store(spark, f, g) for f in opts.pop("fallbacks", [])], **opts)


def lock(graph: FeatureGraph) -> dict[str, Any]:
    """What other projects' features, and those above them, were when they were locked."""
    need = {k for k, d in graph.definitions.items() if d.external}
    need |= {k for k in graph.upstream(*need) if k in graph.definitions} if need else set()
    return {str(k): {"spec": graph[k].as_dict(), "project": graph.definitions[k].project, "schema": graph.definitions[k].schema, "definition_version": graph.definitions[k].version, "field_versions": graph.field_versions(k)} for k in sorted(need)}


def write_lock(graph: FeatureGraph, path: str) -> bool:
    """Write the lock file if it would change; whether it did."""
    text = json.dumps(lock(graph), indent=1, sort_keys=True) + "\n"
    if os.path.exists(path):
        with open(path) as f:
            if f.read() == text:
                return False
    with open(path, "w") as f:
        f.write(text)
    return True


def read_lock(graph: FeatureGraph, path: str) -> None:
    """Register the locked features as external."""
    with open(path) as f:
        for x in json.load(f).values():
            graph.add(Definition(FeatureSpec.from_dict(x["spec"]), x["project"], x["schema"], external=True, pinned=tuple(x["field_versions"].items()), pinned_version=x["definition_version"]))
