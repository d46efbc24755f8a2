"""What an assistant or a notebook asks of a project, as plain values."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from .diff import describe
from .functions.filters import both
from .graph import FeatureGraph
from .operators.preview import preview, top
from .project import Config
from .sources.store import Store


class Tools:
    def __init__(self, config: Config, spark: SparkSession, graph: FeatureGraph | None = None):
        self.config, self.spark = config, spark
        self.graph = graph or config.graph()

    def get_config(self) -> dict[str, Any]:
        return dict(self.config.__dict__)

    def list_features(self, project: str | None = None) -> list[str]:
        return [str(k) for k in self.graph.list(project, external=True)]

    def get_feature(self, key: str) -> dict[str, Any]:
        return describe(self.graph, [key])[0] | {"spec": self.graph[key].as_dict()}

    def list_stores(self) -> list[str]:
        return sorted(self.config.stores)

    def get_store(self, name: str | None = None) -> dict[str, Any]:
        s = self._store(name)
        return s.info() | {"features": [str(k) for k in self.graph.sorted() if s.has(k)]}

    def get_rows(self, key: str, *, store: str | None = None, filters: Any = None, columns: Sequence[str] | None = None, by: Sequence[str] = (), descending: bool = False, limit: int = 50) -> list[dict[str, Any]]:
        """Up to ``limit`` latest rows, nested values as text."""
        df = self._store(store).read(key)
        if (cond := both(filters)) is not None:
            df = df.where(cond)
        df = top(df, limit, by, descending=descending)
        df = df.select(*columns) if columns else df
        return [json.loads(x) for x in preview(df, limit).toJSON().collect()]

    def _store(self, name: str | None) -> Store:
        return self.config.open_store(self.spark, name, self.graph)
