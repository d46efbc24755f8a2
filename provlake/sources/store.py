"""The store: reading, writing, deleting and resolving features over tables of one place."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashing
from ..functions.filters import both, parse, to_sql
from ..graph import FeatureGraph
from ..model import FeatureKey
from ..operators.dedup import keep_latest
from ..operators.increment import Increment, resolve, tagged
from ..operators.prepare import prepare
from ..operators.provenance import add_provenance, complete
from .tables import FormatTable, ParquetTable, TableMissing


class ReadOnly(PermissionError):
    """The store isn't open for writing."""


@dataclass(frozen=True)
class Progress:
    total: int
    missing: int

    @property
    def percent(self) -> float | None:
        return None if not self.total else (self.total - self.missing) / self.total * 100


class Store:
    """Features of a graph in tables under ``path``; reads fall back to other stores in order.

    ``kind`` is parquet, or delta or iceberg where the session has the package; ``path`` is then a
    database's name.
    """

    def __init__(self, spark: SparkSession, path: str, graph: FeatureGraph, *, name: str = "store", fallbacks: Sequence[Store] = (), algorithm: str = hashing.DEFAULT, as_map: bool = False, create_tables: bool = True, run_id: str | None = None, kind: str = "parquet"):
        hashing.check(algorithm)
        if bad := [s.name for s in fallbacks if s.algorithm != algorithm]:
            raise ValueError(f"fallback stores hash differently: {bad}")
        self.spark, self.path, self.graph, self.name = spark, path.rstrip("/"), graph, name
        self.fallbacks, self.algorithm, self.as_map, self.create_tables, self.run_id, self.kind = tuple(fallbacks), algorithm, as_map, create_tables, run_id, kind
        self._mode: list[str] = []
        self._stamp: dt.datetime | None = None

    # ---------------------------------------------------------------- opening
    @contextmanager
    def open(self, mode: str = "r") -> Iterator[Store]:
        """Nested: the innermost mode counts."""
        if mode not in ("r", "w"):
            raise ValueError("mode is r or w")
        self._mode.append(mode)
        try:
            yield self
        finally:
            self._mode.pop()

    def _need_write(self) -> None:
        if not self._mode or self._mode[-1] != "w":
            raise ReadOnly(f"open {self.name} with mode w to change it")

    @contextmanager
    def transaction(self, at: dt.datetime | None = None) -> Iterator[dt.datetime]:
        """All writes inside have one timestamp; nested ones share the outermost."""
        if self._stamp is not None:
            yield self._stamp
            return
        self._stamp = at or dt.datetime.now(dt.timezone.utc)
        try:
            yield self._stamp
        finally:
            self._stamp = None

    def table(self, key: Any):
        t = FeatureKey.of(key).table if not isinstance(key, str) or not key.startswith("system__") else key
        return ParquetTable(self.spark, f"{self.path}/{t}") if self.kind == "parquet" else FormatTable(self.spark, f"{self.path}.{t}", self.kind)

    def info(self, key: Any | None = None) -> dict[str, Any]:
        out = {"name": self.name, "path": self.path, "kind": self.kind, "algorithm": self.algorithm, "fallbacks": [s.name for s in self.fallbacks]}
        return out | ({"table": FeatureKey.of(key).table, "exists": self.table(key).exists} if key is not None else {})

    def has(self, key: Any, *, fallback: bool = False) -> bool:
        return self.table(key).exists or (fallback and any(s.has(key, fallback=True) for s in self.fallbacks))

    def find(self, key: Any) -> Store | None:
        """The first store, in the order of fallbacks, that has the feature."""
        if self.table(key).exists:
            return self
        return next((got for s in self.fallbacks if (got := s.find(key))), None)

    def schema(self, key: Any):
        return self.table(key).schema

    # ---------------------------------------------------------------- reading
    def read(self, key: Any, *, feature_version: str | None = None, filters: Any = None, columns: Sequence[str] | None = None, fallback: bool = True, feature_history: bool = False, sample_history: bool = False, deleted: bool = False, with_store: bool = False):
        """The latest row of each id of the feature's current version, without deleted ones.

        In order: version, latest row, deletion, ``filters``, ``columns``. ``feature_history`` reads
        all versions, of which the latest row of an id is one; ``sample_history`` reads all rows.
        """
        key = FeatureKey.of(key)
        if feature_version is not None and feature_history:
            raise ValueError("feature_version reads one version, feature_history all")
        owner = self if self.table(key).exists else (self.find(key) if fallback else None)
        if owner is None:
            raise TableMissing(f"no store has {key}")
        part = None if feature_history else feature_version or self.graph.feature_version(key)
        df = owner.table(key).read(part)
        if not sample_history:
            df = keep_latest(df, self.graph[key].id_columns, [C.DELETED, C.UPDATED], [C.CREATED, C.RUN, C.PROV, C.DATA], whole=False)
        if not deleted:
            df = df.where(C.col(C.DELETED).isNull())
        if (cond := both(filters)) is not None:
            df = df.where(cond)
        if columns is not None:
            df = df.select(*map(C.col, columns))
        return (df, owner) if with_store else df

    # ---------------------------------------------------------------- writing
    def _stamped(self, df: DataFrame, key: FeatureKey, run_id: str | None, keep_version: bool, deleting: bool, now: dt.datetime) -> DataFrame:
        spec = self.graph[key]
        df = complete(C.typed(df), [f.key.member for f in spec.fields], algorithm=self.algorithm, chars=self.graph.hash_chars)
        if self.as_map:
            df = df.withColumns({c: C.struct_to_map(df, c) for c in (C.PROV_BY_FIELD, C.DATA_BY_FIELD) if not C.is_map(df, c)})
        at = F.lit(now).cast("timestamp")
        own: dict[str, Any] = {}
        if not (keep_version and C.FEATURE_VERSION in df.columns and C.PROJECT_VERSION in df.columns):
            own |= {C.FEATURE_VERSION: F.lit(self.graph.feature_version(key)), C.PROJECT_VERSION: F.lit(self.graph.project_version())}
        if C.CREATED not in df.columns:
            own[C.CREATED] = at
        if not deleting or C.UPDATED not in df.columns:
            own[C.UPDATED] = at
        if C.DELETED not in df.columns:
            own[C.DELETED] = F.lit(None).cast("timestamp")
        own[C.RUN] = F.lit(run_id or self.run_id).cast("string")
        return df.withColumns(own)

    def write(self, key: Any, df: DataFrame, *, run_id: str | None = None, keep_version: bool = False, deleting: bool = False) -> int:
        """Append rows; how many, as seen while they were written. A column of per-field provenance is needed;
        the rest is made where it's missing.

        Rows that keep their versions go to a folder each by one write.
        """
        self._need_write()
        key = FeatureKey.of(key)
        spec = self.graph[key]
        if C.PROV_BY_FIELD not in df.columns:
            raise ValueError(f"{key}: rows need {C.PROV_BY_FIELD}")
        if lack := [c for c in spec.id_columns if c not in df.columns]:
            raise ValueError(f"{key}: rows lack the id columns {lack}")
        with self.transaction() as now:
            out = self._stamped(df, key, run_id, keep_version, deleting, now)
            seen = Observation()
            out = out.observe(seen, F.count(F.lit(1)).alias("n"))
            part = None if keep_version and C.FEATURE_VERSION in df.columns else self.graph.feature_version(key)
            self.table(key).append(out, part, create=self.create_tables)
            return seen.get["n"]

    def write_many(self, frames: Mapping[Any, DataFrame], **kw: Any) -> dict[str, int]:
        """Children before parents, so a reader that sees a parent's rows sees its children's; rows written by feature."""
        by = {FeatureKey.of(k): v for k, v in frames.items()}
        with self.transaction():
            return {str(key): self.write(key, by[key], **kw) for key in self.graph.sorted(by, descending=True)}

    def delete(self, key: Any, filters: Any = None, *, soft: bool = True, feature_history: bool = False) -> None:
        """Soft: live rows that match get a deletion time and are appended. Hard: all their rows go."""
        self._need_write()
        key = FeatureKey.of(key)
        cond = both(filters)
        if soft:
            with self.transaction() as now:
                gone = self.read(key, filters=filters, fallback=False, feature_history=feature_history)
                self.write(key, gone.withColumn(C.DELETED, F.lit(now).cast("timestamp")), keep_version=True, deleting=True)
            return
        version = self.graph.feature_version(key)
        hit = F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))
        if not feature_history:
            hit = hit & (C.col(C.FEATURE_VERSION) == F.lit(version))
        t = self.table(key)
        if isinstance(t, FormatTable):
            t.delete_where(to_sql(self.spark, F.coalesce(hit, F.lit(False)), t.schema))
        else:
            t.rewrite(lambda df: df.where(~F.coalesce(hit, F.lit(False))))

    def drop(self, key: Any) -> None:
        self._need_write()
        self.table(key).drop()

    def copy_from(self, other: Store, keys: Iterable[Any] | None = None, *, filters: Mapping[Any, Any] | None = None, global_filters: Any = None, feature_history: bool = True, sample_history: bool = False) -> dict[str, int]:
        """Append another store's features, their versions kept; rows copied by feature, counted as they're written.

        ``filters`` hold rows of a feature by its key, ``global_filters`` those of all.
        """
        self._need_write()
        wanted = self.graph.sorted(keys) if keys is not None else [k for k in self.graph.sorted() if other.has(k)]
        cond = {FeatureKey.of(k): v for k, v in (filters or {}).items()}
        out: dict[str, int] = {}
        with self.transaction():
            for key in wanted:
                if not other.has(key):
                    continue
                df = other.read(key, filters=cond.get(key), fallback=False, feature_history=feature_history, sample_history=sample_history, deleted=sample_history)
                if (every := both(global_filters)) is not None:
                    df = df.where(every)
                out[str(key)] = self.write(key, df, keep_version=True)
        return out

    # ---------------------------------------------------------------- resolving
    def expected(self, key: Any, *, filters: Mapping[Any, Any] | None = None, global_filters: Any = None, graph: FeatureGraph | None = None, versions: Mapping[Any, str] | None = None) -> DataFrame:
        """What the feature's rows should be, from its parents as they are."""
        g = graph or self.graph
        plan = g.plan(key)
        if not plan.spec.deps:
            raise ValueError(f"{key} has no parents; its rows come from samples")
        per = {FeatureKey.of(k): v for k, v in (filters or {}).items()}
        v = {FeatureKey.of(k): x for k, x in (versions or {}).items()}
        tables = {}
        for s in plan.parent_specs:
            df = self.read(s.key, feature_version=v.get(s.key))
            for f in (per.get(s.key), global_filters):
                if (cond := both(f)) is not None:
                    df = df.where(cond)
            tables[s.key] = df
        joined = prepare(plan, tables, algorithm=self.algorithm, chars=g.hash_chars)
        return add_provenance(joined, plan, algorithm=self.algorithm, chars=g.hash_chars, as_map=self.as_map)

    def resolve_update(self, key: Any, *, samples: DataFrame | None = None, filters: Mapping[Any, Any] | None = None, global_filters: Any = None, target_filters: Any = None, skip_comparison: bool = False, stale_if: Sequence[Any] | Any = ()) -> Increment:
        """What to make, remake and drop for the feature to be up to date.

        ``samples`` stand for the parents; a feature without parents needs them. ``filters`` hold rows of
        a feature by its key, ``global_filters`` those of all, ``target_filters`` the feature's own rows
        and the samples. ``stale_if``: conditions on stored rows.
        """
        key = FeatureKey.of(key)
        plan = self.graph.plan(key)
        if samples is not None:
            expected = complete(samples, [f.key.member for f in plan.spec.fields], algorithm=self.algorithm, chars=self.graph.hash_chars)
            for f in (global_filters, target_filters):
                if (cond := both(f)) is not None:
                    expected = expected.where(cond)
        elif not plan.spec.deps:
            raise ValueError(f"{key} has no parents: pass samples with {C.PROV_BY_FIELD}")
        else:
            expected = self.expected(key, filters=filters, global_filters=global_filters)
        if skip_comparison:
            none = expected.limit(0)
            return Increment(expected, none, none, expected)
        current = None
        if self.has(key):
            current = self.read(key, fallback=False)
            own = (filters or {}).get(key, (filters or {}).get(str(key)))
            for f in (own, global_filters, target_filters):
                if (cond := both(f)) is not None:
                    current = current.where(cond)
        ids = plan.spec.id_columns if samples is not None else plan.compare_ids
        preds = list(stale_if) if isinstance(stale_if, list | tuple) else [stale_if]
        return resolve(expected, current, ids, stale_if=[parse(p) for p in preds], expands=plan.expands and samples is None)

    def compute_provenance(self, key: Any, joined: DataFrame) -> DataFrame:
        """Provenance over parents that the caller has joined; their data versions carry their names."""
        return add_provenance(joined, self.graph.plan(key), algorithm=self.algorithm, chars=self.graph.hash_chars, as_map=self.as_map)

    def rebase(self, key: Any, stored: DataFrame, graph: FeatureGraph, versions: Mapping[Any, str] | None = None) -> DataFrame:
        """Stored rows with the provenance that another graph's definitions give; own data versions stay."""
        plan = graph.plan(key)
        if not plan.spec.deps:
            raise ValueError(f"{key} has no parents: there's nothing to work its provenance out from")
        v = {d.feature: graph.feature_version(d.feature) for d in plan.spec.deps} | {FeatureKey.of(k): x for k, x in (versions or {}).items()}
        fresh = self.expected(key, graph=graph, versions=v)
        ids = plan.compare_ids
        own = C.col(C.DATA) != C.col(C.PROV)
        rest = stored.withColumns({"__data__": F.when(own, C.col(C.DATA)), "__each__": F.when(own, C.col(C.DATA_BY_FIELD))}).drop(*C.CARRIED, C.FEATURE_VERSION, C.PROJECT_VERSION)
        side = fresh.select(*map(C.col, ids), C.col(C.PROV_BY_FIELD), C.col(C.PROV)).distinct() if not self.as_map else fresh.select(*map(C.col, ids), C.col(C.PROV_BY_FIELD), C.col(C.PROV))
        out = rest.join(side, ids, "inner").withColumns({C.DATA: F.coalesce("__data__", C.col(C.PROV)), C.DATA_BY_FIELD: F.coalesce("__each__", C.col(C.PROV_BY_FIELD))}).drop("__data__", "__each__")
        return out.withColumns({C.FEATURE_VERSION: F.lit(graph.feature_version(key)), C.PROJECT_VERSION: F.lit(graph.project_version())})

    def runs(self, key: Any, *, feature_history: bool = True) -> DataFrame:
        """(run id, rows, first and mean creation time as seconds) of each run that wrote rows of the feature."""
        df = self.read(key, fallback=False, feature_history=feature_history, sample_history=True, deleted=True)
        at = F.unix_micros(C.col(C.CREATED)).cast("decimal(38,0)")  # a sum of longs would overflow
        return df.groupBy(C.col(C.RUN).alias("run_id")).agg(F.count("*").alias("n"), (F.min(at).cast("double") / 1e6).alias("first_at"), (F.sum(at).cast("double") / F.count(at) / 1e6).alias("mean_at"))

    def progress(self, key: Any, increment: Increment | None = None) -> Progress:
        """Input units in all and those without any row yet."""
        inc = increment or self.resolve_update(key)
        ids = list(map(C.col, self.graph.plan(key).compare_ids))
        count = lambda df, tag: df.select(*ids).distinct().select(F.lit(tag).alias("what"))
        got = dict(count(inc.input if inc.input is not None else inc.new, "total").unionByName(count(inc.new, "new")).groupBy("what").count().collect())
        return Progress(got.get("total", 0), got.get("new", 0))

    def tags(self, key: Any, *, stale_if: Sequence[Any] = (), filters: Mapping[Any, Any] | None = None, global_filters: Any = None) -> DataFrame:
        """The status of every input unit and stored row, in one pass: new, stale, fresh or orphaned."""
        plan = self.graph.plan(key)
        ids = plan.compare_ids
        e = self.expected(key, filters=filters, global_filters=global_filters).select(*map(C.col, ids), C.col(C.PROV)).dropDuplicates(ids)
        if not self.has(key):
            return e.select(F.lit("new").alias("status"))
        c = self.read(key, fallback=False)
        own = (filters or {}).get(FeatureKey.of(key), (filters or {}).get(str(FeatureKey.of(key))))
        for f in (own, global_filters):
            if (cond := both(f)) is not None:
                c = c.where(cond)
        c = c.dropDuplicates(ids) if set(ids) != set(plan.spec.id_columns) else c
        return tagged(e, c, ids, stale_if=stale_if).select("status")

    def counts(self, key: Any, *, stale_if: Sequence[Any] = (), filters: Mapping[Any, Any] | None = None, global_filters: Any = None) -> dict[str, int]:
        """How many rows are new, stale, fresh and orphaned, in one job."""
        got = self.tags(key, stale_if=stale_if, filters=filters, global_filters=global_filters).groupBy("status").count().collect()
        return dict.fromkeys(("new", "stale", "fresh", "orphaned"), 0) | dict(got)
