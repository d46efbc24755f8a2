"""How far features are behind their parents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import functions as F

from .functions.filters import both
from .model import FeatureKey
from .sources.store import Progress, Store


@dataclass(frozen=True)
class Status:
    key: str
    category: str  # missing, root, needs_update, up_to_date
    stored: int
    new: int = 0
    stale: int = 0
    orphaned: int = 0
    progress: Progress | None = None


def status(store: Store, key: Any, *, progress: bool = False, stale_if: Iterable[Any] = (), filters: Mapping[Any, Any] | None = None, global_filters: Any = None) -> Status:
    """A feature's counts by one job; ``filters`` hold rows of a feature by its key, ``global_filters`` those of all."""
    spec = store.graph[key]
    return _statuses(store, [spec.key], progress, stale_if, filters, global_filters)[0]


def report(store: Store, keys: Iterable[Any] | None = None, *, progress: bool = False, stale_if: Iterable[Any] = (), filters: Mapping[Any, Any] | None = None, global_filters: Any = None) -> list[Status]:
    """The status of many features, all counted in one job."""
    return _statuses(store, store.graph.sorted(keys), progress, stale_if, filters, global_filters)


def _statuses(store: Store, keys: list[Any], progress: bool, stale_if: Iterable[Any], filters: Mapping[Any, Any] | None, global_filters: Any) -> list[Status]:
    per = {FeatureKey.of(k): v for k, v in (filters or {}).items()}
    frames = []
    for key in keys:
        named = lambda df, what, key=key: df.groupBy(what).count().select(F.lit(str(key)).alias("key"), what.alias("what"), "count")
        if store.has(key):
            stored = store.read(key, fallback=False)
            for f in (per.get(key), global_filters):
                if (cond := both(f)) is not None:
                    stored = stored.where(cond)
            frames.append(named(stored, F.lit("stored")))
        if store.graph[key].deps:
            frames.append(named(store.tags(key, stale_if=list(stale_if), filters=per, global_filters=global_filters), F.col("status")))
    got: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for r in reduce(lambda a, b: a.unionByName(b), frames).collect() if frames else ():
        got[r["key"]][r["what"]] += r["count"]
    out = []
    for key in keys:
        c, there = got[str(key)], store.has(key)
        behind = c["new"] or c["stale"] or c["orphaned"]
        category = "missing" if not there else "root" if not store.graph[key].deps else "needs_update" if behind else "up_to_date"
        done = Progress(c["new"] + c["stale"] + c["fresh"], c["new"]) if progress and store.graph[key].deps else None
        out.append(Status(str(key), category, c["stored"], c["new"], c["stale"], c["orphaned"], done))
    return out
