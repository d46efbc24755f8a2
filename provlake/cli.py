"""Command line: python -m provlake.cli --config provlake.toml COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from . import diff
from .project import Config, write_lock
from .sources import system
from .status import report
from .tools import Tools


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provlake")
    p.add_argument("--config", default="provlake.toml")
    p.add_argument("--store")
    s = p.add_subparsers(dest="command", required=True)
    s.add_parser("config")
    s.add_parser("features").add_argument("--verbose", action="store_true")
    s.add_parser("stores")
    w = s.add_parser("show")
    w.add_argument("feature")
    w.add_argument("--filter", action="append", default=[])
    w.add_argument("--sort", action="append", default=[])
    w.add_argument("--descending", action="store_true")
    w.add_argument("--limit", type=int, default=20)
    g = s.add_parser("graph")
    g.add_argument("--format", choices=["mermaid", "graphviz", "json"], default="mermaid")
    g.add_argument("--fields", action="store_true")
    s.add_parser("describe").add_argument("feature")
    h = s.add_parser("history")
    h.add_argument("--limit", type=int)
    s.add_parser("graph-diff").add_argument("version", nargs="?")
    s.add_parser("push")
    s.add_parser("lock").add_argument("path", nargs="?", default="provlake.lock")
    for name in ("status", "delete", "copy", "rebase"):
        c = s.add_parser(name)
        c.add_argument("features", nargs="*")
        c.add_argument("--filter", action="append", default=[], help="holds rows of the features named, or of all")
        if name in ("status", "copy"):
            c.add_argument("--global-filter", action="append", default=[])
        if name == "status":
            c.add_argument("--progress", action="store_true")
            c.add_argument("--assert-in-sync", action="store_true")
            c.add_argument("--stale-if", action="append", default=[])
        if name == "delete":
            c.add_argument("--hard", action="store_true")
            c.add_argument("--dry-run", action="store_true")
        if name == "copy":
            c.add_argument("--from", dest="source", required=True)
        if name == "rebase":
            c.add_argument("--from-version", required=True)
            c.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    config = Config.load(a.config)
    say = lambda x: print(json.dumps(x, indent=1, default=str))
    if a.command == "config":
        say(config.__dict__)
        return 0
    if a.command == "stores":
        say(sorted(config.stores))
        return 0
    graph = config.graph()
    if a.command == "features":
        say(diff.describe(graph) if a.verbose else [str(k) for k in graph.sorted()])
        return 0
    if a.command == "graph":
        say(diff.describe(graph)) if a.format == "json" else print(diff.graphviz(graph) if a.format == "graphviz" else diff.mermaid(graph, fields=a.fields))
        return 0
    if a.command == "describe":
        say(diff.describe(graph, [a.feature])[0])
        print(diff.tree(graph, a.feature), diff.tree(graph, a.feature, down=True), sep="\n")
        return 0
    if a.command == "lock":
        print("changed" if write_lock(graph, a.path) else "unchanged")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "show":
        say(Tools(config, spark, graph).get_rows(a.feature, store=a.store, filters=a.filter or None, by=a.sort, descending=a.descending, limit=a.limit))
        return 0
    store = config.open_store(spark, a.store, graph)
    with store.open("w"):
        return _with_store(a, store, say, config, spark)


def _with_store(a: argparse.Namespace, store: Any, say: Any, config: Config, spark: SparkSession) -> int:
    graph = store.graph
    if a.command == "push":
        say(system.push(store).__dict__)
    elif a.command == "history":
        df = system.snapshots(store, graph.project)
        say([r.asDict() for r in (df.limit(a.limit) if a.limit else df).collect()])
    elif a.command == "graph-diff":
        old = system.load_graph(store, graph.project, a.version)
        d = diff.compare(old, graph)
        say({"added": d.added, "removed": d.removed, "changed": [c.key for c in d.changed]})
    elif a.command == "status":
        named = {k: a.filter for k in a.features} if a.filter else None
        every = [*a.global_filter, *([] if a.features else a.filter)] or None
        got = report(store, a.features or None, progress=a.progress, stale_if=a.stale_if, filters=named, global_filters=every)
        say([x.__dict__ | {"progress": x.progress.percent if x.progress else None} for x in got])
        return int(a.assert_in_sync and any(x.category in ("missing", "needs_update") for x in got))
    elif a.command == "delete":
        for k in a.features:
            if a.dry_run:
                say({k: store.read(k, filters=a.filter or None, fallback=False).count()})
            else:
                store.delete(k, a.filter or None, soft=not a.hard)
    elif a.command == "copy":
        source = config.open_store(spark, a.source, graph)
        every = [*a.global_filter, *([] if a.features else a.filter)] or None
        say(store.copy_from(source, a.features or None, filters={k: a.filter for k in a.features} if a.filter else None, global_filters=every))
    elif a.command == "rebase":
        for k in a.features:
            rows = store.read(k, feature_version=a.from_version, filters=a.filter or None, fallback=False)
            out = store.rebase(k, rows, graph)
            if a.dry_run:
                say({k: out.count()})
            else:
                store.write(k, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
