"""Graphs compared, described and drawn as text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from .graph import FeatureGraph
from .model import FeatureKey


@dataclass(frozen=True)
class FieldChange:
    field: str
    old: str | None
    new: str | None


@dataclass(frozen=True)
class NodeChange:
    key: str
    old_version: str
    new_version: str
    fields: tuple[FieldChange, ...]


@dataclass(frozen=True)
class GraphDiff:
    added: tuple[str, ...]
    removed: tuple[str, ...]
    changed: tuple[NodeChange, ...]
    unchanged: tuple[str, ...]

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.changed)


def compare(old: FeatureGraph, new: FeatureGraph) -> GraphDiff:
    a, b = set(old.definitions), set(new.definitions)
    changed, same = [], []
    for k in sorted(a & b):
        if old.feature_version(k) == new.feature_version(k):
            same.append(str(k))
            continue
        x, y = old.field_versions(k), new.field_versions(k)
        changed.append(NodeChange(str(k), old.feature_version(k), new.feature_version(k), tuple(FieldChange(f, x.get(f), y.get(f)) for f in sorted({*x, *y}) if x.get(f) != y.get(f))))
    return GraphDiff(tuple(map(str, sorted(b - a))), tuple(map(str, sorted(a - b))), tuple(changed), tuple(same))


def merged(old: FeatureGraph, new: FeatureGraph) -> dict[str, dict[str, Any]]:
    """All nodes of both, each with its status and parents."""
    d = compare(old, new)
    state = {k: "added" for k in d.added} | {k: "removed" for k in d.removed} | {c.key: "changed" for c in d.changed} | {k: "unchanged" for k in d.unchanged}
    out = {}
    for k, s in sorted(state.items()):
        g = old if s == "removed" else new
        out[k] = {"status": s, "parents": [str(p) for p in g.parents(k)], "old_version": old.feature_version(k) if k in old else None, "new_version": new.feature_version(k) if k in new else None}
    return out


def describe(graph: FeatureGraph, keys: Iterable[Any] | None = None) -> list[dict[str, Any]]:
    return [{"key": str(k), "project": graph.definitions[k].project, "feature_version": graph.feature_version(k), "id_columns": list(graph[k].id_columns), "fields": graph.field_versions(k), "parents": [str(p) for p in graph.parents(k)], "children": [str(c) for c in graph.children(k)], "external": graph.definitions[k].external} for k in graph.sorted(keys)]


def tree(graph: FeatureGraph, key: Any, *, down: bool = False) -> str:
    """The features above a feature, or below it, indented."""
    out: list[str] = []

    def walk(k: FeatureKey, depth: int) -> None:
        out.append("  " * depth + str(k))
        for n in graph.children(k) if down else graph.parents(k):
            walk(n, depth + 1)

    walk(FeatureKey.of(key), 0)
    return "\n".join(out)


def _name(k: Any) -> str:
    return FeatureKey.of(str(k)).table.replace("-", "_")


def mermaid(graph: FeatureGraph, *, fields: bool = False, against: FeatureGraph | None = None) -> str:
    colour = {"added": "#bfb", "removed": "#fbb", "changed": "#ffb"}
    nodes = merged(against, graph) if against else {str(k): {"status": "unchanged", "parents": [str(p) for p in graph.parents(k)]} for k in graph.sorted()}
    out = ["flowchart TB"]
    for k, n in nodes.items():
        g = against if n["status"] == "removed" else graph
        label = "<br/>".join([k, *[f"- {f}" for f in g.field_versions(k)]]) if fields else k
        out.append(f'    {_name(k)}["{label}"]')
        if n["status"] in colour:
            out.append(f"    style {_name(k)} fill:{colour[n['status']]}")
    out += [f"    {_name(p)} --> {_name(k)}" for k, n in nodes.items() for p in n["parents"]]
    return "\n".join(out)


def graphviz(graph: FeatureGraph) -> str:
    lines = [f'  "{k}";' for k in graph.sorted()] + [f'  "{p}" -> "{k}";' for k in graph.sorted() for p in graph.parents(k)]
    return "\n".join(["digraph features {", *lines, "}"])


def field_edges(graph: FeatureGraph) -> list[tuple[str, str]]:
    """(parent's field, field) by full names."""
    return [(f"{p}.{n}", f"{k}.{f.key}") for k in graph.sorted() for f in graph[k].fields for p, n in (graph.plan(k).parents(f.key) if graph[k].deps else [])]


def column_edges(graph: FeatureGraph, key: Any) -> list[tuple[str, str, str]]:
    """(parent, its column, column here) for ids and for what dependencies rename or select."""
    out = []
    plan = graph.plan(key)
    for d in plan.spec.deps:
        back = {v: k for k, v in d.renames.items()}
        names = set(plan.spec.id_columns) & set(plan.on(d)) | set(d.select or ()) | set(d.renames.values())
        out += [(str(d.feature), back.get(c, c), c) for c in sorted(names)]
    return out
