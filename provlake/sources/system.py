"""The store's own tables: pushed definitions and events."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import FeatureGraph
from .store import Store

VERSIONS, EVENTS = "system__feature_versions", "system__events"
VERSIONS_SCHEMA = "project string, feature_key string, feature_version string, definition_version string, recorded_at timestamp, feature_spec string, feature_schema string, feature_class_path string, project_version string, tags string, deleted_at timestamp"
EVENTS_SCHEMA = "project string, execution_id string, event_type string, timestamp timestamp, feature_key string, payload string"


@dataclass(frozen=True)
class Pushed:
    project_version: str
    already: bool
    changed: list[str] = field(default_factory=list)


def _rows(store: Store) -> DataFrame:
    t = store.table(VERSIONS)
    return t.read() if t.exists else store.spark.createDataFrame([], VERSIONS_SCHEMA)


def latest_of_each(rows: DataFrame) -> DataFrame:
    """The last recorded definition of each feature of each project."""
    w = Window.partitionBy("project", "feature_key").orderBy(F.desc("recorded_at"), F.desc("definition_version"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def push(store: Store, graph: FeatureGraph | None = None, *, project: str | None = None, tags: dict[str, str] | None = None, at: dt.datetime | None = None) -> Pushed:
    """Record the project's definitions where they differ from the last recorded; again changes nothing."""
    store._need_write()
    g = graph or store.graph
    project = project or g.project
    version = g.project_version(project)
    now = at or dt.datetime.now(dt.timezone.utc)
    last = {r["feature_key"]: r for r in latest_of_each(_rows(store).where(F.col("project") == project)).collect()}  # a row a feature
    rows, changed = [], []
    own = [(k, d) for k, d in sorted(g.definitions.items()) if d.project == project and not d.external]
    for k, d in own:
        old = last.get(str(k))
        if old is None or old["definition_version"] != d.version or old["feature_version"] != g.feature_version(k):
            changed.append(str(k))
    if not changed and {str(k) for k, _ in own} == set(last) and all(r["project_version"] == version for r in last.values()):
        return Pushed(version, True)
    for k, d in own:
        rows.append((project, str(k), g.feature_version(k), d.version, now, json.dumps(d.spec.as_dict(), sort_keys=True), d.schema, d.origin, version, json.dumps(tags or {}), None))
    if rows:
        store.table(VERSIONS).append(store.spark.createDataFrame(rows, VERSIONS_SCHEMA), "all")
    return Pushed(version, False, changed)


def snapshots(store: Store, project: str | None = None) -> DataFrame:
    """(project, project_version, recorded_at, n_features), the latest first."""
    df = _rows(store)
    if project is not None:
        df = df.where(F.col("project") == project)
    return df.groupBy("project", "project_version").agg(F.min("recorded_at").alias("recorded_at"), F.count("feature_key").alias("n_features")).orderBy(F.desc("recorded_at"), "project")


def snapshot_rows(store: Store, project: str, version: str | None = None) -> DataFrame:
    """The definitions of a pushed version, by default the last."""
    df = _rows(store).where(F.col("project") == project)
    if version is None:
        last = df.orderBy(F.desc("recorded_at")).limit(1).collect()
        if not last:
            return df
        version = last[0]["project_version"]
    return latest_of_each(df.where(F.col("project_version") == version))


def load_graph(store: Store, project: str, version: str | None = None) -> FeatureGraph:
    rows = snapshot_rows(store, project, version).collect()
    data = {r["feature_key"]: {"spec": json.loads(r["feature_spec"]), "schema": r["feature_schema"], "origin": r["feature_class_path"], "project": r["project"]} for r in rows}
    return FeatureGraph.from_snapshot(data, project=project)


def write_event(store: Store, kind: str, *, feature: Any = None, execution: str = "", payload: dict[str, Any] | None = None, at: dt.datetime | None = None) -> None:
    store._need_write()
    row = (store.graph.project, execution, kind, at or dt.datetime.now(dt.timezone.utc), None if feature is None else str(feature), json.dumps(payload or {}, sort_keys=True))
    store.table(EVENTS).append(store.spark.createDataFrame([row], EVENTS_SCHEMA), "all")


def events(store: Store) -> DataFrame:
    t = store.table(EVENTS)
    return t.read() if t.exists else store.spark.createDataFrame([], EVENTS_SCHEMA)


def sync_external(store: Store, graph: FeatureGraph, *, strict: bool = False) -> list[str]:
    """Take the recorded definitions of external features; returns those that differ from what was declared."""
    from ..model import Definition, FeatureSpec

    wanted = {str(k): d for k, d in graph.definitions.items() if d.external}
    differ = []
    for r in latest_of_each(_rows(store).where(F.col("feature_key").isin(*wanted))).collect() if wanted else []:
        old = wanted[r["feature_key"]]
        new = Definition(FeatureSpec.from_dict(json.loads(r["feature_spec"])), r["project"], r["feature_schema"], r["feature_class_path"], True, pinned_version=r["definition_version"])
        if new.spec.version != old.spec.version:
            differ.append(r["feature_key"])
            if strict:
                raise ValueError(f"{r['feature_key']} was recorded otherwise than it's declared here")
        graph.add(new, replace=True)
    return differ
