"""More queries over the sample tables: what goes through a store, its own tables and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diff
from .functions import columns as C
from .functions.filters import parse, to_sql
from .functions.hashing import XXHASH32, XXHASH64, hashed
from .graph import FeatureGraph
from .model import FieldDep, feature
from .queries import _AT, _DAY, _H, CUSTOMER, GRAPH, ORDER, ORDER_VIEW, _store, customer, flat, orders, query, sql, table
from .sources import system
from .sources.store import Store
from .status import report
from .streaming.writer import BufferedWriter, with_versions


def _ordered(spark, sf, name: str, kept: str = "o_orderstatus <> 'P'") -> Store:
    """Orders, the view made of those kept, then urgent orders changed."""
    s = _store(spark, name)
    df = orders(spark, sf)
    with s.open("w"):
        with s.transaction(_AT):
            s.write(ORDER.key, df, run_id="first")
            s.write(ORDER_VIEW.key, s.resolve_update(ORDER_VIEW.key, filters={ORDER.key: kept}).new, run_id="made")
        with s.transaction(_AT + _DAY):
            urgent = df.where("o_orderpriority = '1-URGENT'").withColumn(C.PROV_BY_FIELD, C.by_field({"status": F.lit("changed"), "price": F.lit("too")}))
            s.write(ORDER.key, urgent.drop(C.PROV, C.DATA, C.DATA_BY_FIELD), run_id="second")
    return s


_NEXT = FeatureGraph([CUSTOMER, ORDER, feature("sales/order-view", "o_orderkey", [{"key": "state", "code_version": "4", "deps": [FieldDep.of("sales/order", ["status"])]}, {"key": "money", "code_version": "1", "deps": [FieldDep.of("sales/order", ["price"])]}], ["sales/order"])], project="samples")


@query(sql(f"SELECT o_orderkey, v_state, v_money, {_H("concat(v_money, '|', v_state)")} AS v FROM (SELECT o_orderkey, {_H("concat('state|4|sales/order.status|', status)")} AS v_state, {_H("concat('money|1|sales/order.price|', price)")} AS v_money FROM ord)", "ord"))
def store_rebase(spark, sf):
    """Stored rows under the definitions of another graph, in which a field's code has changed."""
    s = _store(spark, "rebase")
    with s.open("w"):
        s.write(ORDER.key, orders(spark, sf))
        s.write(ORDER_VIEW.key, s.resolve_update(ORDER_VIEW.key).new)
    return flat(s.rebase(ORDER_VIEW.key, s.read(ORDER_VIEW.key), _NEXT), ORDER_VIEW, "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'new' ELSE 'stale' END AS status FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def store_samples(spark, sf):
    """A root feature is resolved against samples: debtors aren't stored, builders are otherwise."""
    s = _store(spark, "samples")
    df = customer(spark, sf)
    with s.open("w"):
        s.write(CUSTOMER.key, df.where("c_acctbal >= 0"))
    changed = F.when(F.col("c_mktsegment") == "BUILDING", "changed").otherwise(C.col(C.PROV_BY_FIELD).getField("profile"))
    samples = df.withColumn(C.PROV_BY_FIELD, C.by_field({"profile": changed, "balance": C.col(C.PROV_BY_FIELD).getField("balance")})).drop(C.PROV, C.DATA, C.DATA_BY_FIELD)
    return s.resolve_update(CUSTOMER.key, samples=samples).changes().select("c_custkey", "status")


@query("SELECT o_orderkey, 'new' AS status FROM orders WHERE (o_orderstatus = 'P' OR o_orderkey <= 1000) AND o_totalprice > 100000 AND o_orderkey % 2 = 0")
def store_filters(spark, sf):
    """Filters on a parent, on all, and on the feature's own rows, of which the first are passed over, so new."""
    s = _ordered(spark, sf, "filters").resolve_update(ORDER_VIEW.key, filters={ORDER.key: "o_totalprice > 100000"}, global_filters=F.expr("o_orderkey % 2 = 0"), target_filters="o_orderkey > 1000")
    return s.changes().where("status = 'new'").select("o_orderkey", "status")


@query("SELECT o_orderkey FROM orders")
def store_skip_comparison(spark, sf):
    return _ordered(spark, sf, "skip").resolve_update(ORDER_VIEW.key, skip_comparison=True).new.select("o_orderkey")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS missing FROM orders")
def store_progress(spark, sf):
    p = _ordered(spark, sf, "progress").progress(ORDER_VIEW.key)
    return spark.createDataFrame([(p.total, p.missing)], "total long, missing long")


@query("SELECT 'sales/order' AS key, 'root' AS category, count(*) AS stored, 0 AS new, 0 AS stale, 0 AS orphaned FROM orders UNION ALL SELECT 'sales/order-view', 'needs_update', count(*) FILTER (o_orderstatus <> 'P'), count(*) FILTER (o_orderstatus = 'P'), count(*) FILTER (o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'), 0 FROM orders UNION ALL SELECT 'sales/customer', 'missing', 0, 0, 0, 0")
def store_status(spark, sf):
    """Three features, counted in one job."""
    got = report(_ordered(spark, sf, "status"), [CUSTOMER.key, ORDER.key, ORDER_VIEW.key])
    return spark.createDataFrame([(x.key, x.category, x.stored, x.new, x.stale, x.orphaned) for x in got], "key string, category string, stored long, new int, stale long, orphaned int")


@query("SELECT 'first' AS run_id, count(*) AS n, CAST(epoch(TIMESTAMP '2026-01-01') AS DOUBLE) AS mean_at FROM orders UNION ALL SELECT 'second', count(*), epoch(TIMESTAMP '2026-01-02') FROM orders WHERE o_orderpriority = '1-URGENT'")
def store_runs(spark, sf):
    return _ordered(spark, sf, "runs").runs(ORDER.key).select("run_id", "n", "mean_at")


@query("SELECT o_orderkey, o_orderpriority = '1-URGENT' AS changed FROM orders")
def store_read_latest(spark, sf):
    s = _ordered(spark, sf, "latest")
    return s.read(ORDER.key, columns=["o_orderkey", C.PROV_BY_FIELD]).select("o_orderkey", (C.col(C.PROV_BY_FIELD).getField("status") == "changed").alias("changed"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS n FROM orders WHERE o_totalprice < 200000")
def store_sample_history(spark, sf):
    rows = _ordered(spark, sf, "history").read(ORDER.key, sample_history=True, filters="o_totalprice < 200000")
    return rows.groupBy("o_orderkey").agg(F.count("*").cast("int").alias("n"))


@query("SELECT c_custkey, 'far' AS store FROM customer WHERE c_acctbal > 0")
def store_fallback(spark, sf):
    """A feature that only a fallback's fallback has."""
    far = _store(spark, "far")
    with far.open("w"):
        far.write(CUSTOMER.key, customer(spark, sf))
    far.name = "far"
    middle = Store(spark, far.path + "-middle", GRAPH, fallbacks=[far])
    near = Store(spark, far.path + "-near", GRAPH, fallbacks=[middle])
    df, owner = near.read(CUSTOMER.key, filters="c_acctbal > 0", with_store=True)
    there = near.has(CUSTOMER.key, fallback=True) and not near.has(CUSTOMER.key) and near.find(CUSTOMER.key) is far
    return df.select("c_custkey", F.lit(owner.name if there else "none").alias("store"))


@query("SELECT 'sales/customer' AS feature, count(*) AS n FROM customer UNION ALL SELECT 'sales/order', count(*) FROM orders WHERE o_orderkey > 100")
def store_write_many(spark, sf):
    s = _store(spark, "many")
    with s.open("w"):
        got = s.write_many({CUSTOMER.key: customer(spark, sf), ORDER.key: orders(spark, sf).where("o_orderkey > 100")})
    stamps = s.read(CUSTOMER.key).select(C.UPDATED).distinct().unionByName(s.read(ORDER.key).select(C.UPDATED).distinct()).distinct()
    return spark.createDataFrame([(k, n if stamps.count() == 1 else -1) for k, n in got.items()], "feature string, n long")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 150000")
def store_copy_filtered(spark, sf):
    a, b = _ordered(spark, sf, "copied"), _store(spark, "copy")
    with b.open("w"):
        b.copy_from(a, [ORDER.key], filters={ORDER.key: "o_totalprice < 150000"})
    return b.read(ORDER.key).select("o_orderkey")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def buffered_writes(spark, sf):
    g = FeatureGraph([feature("web/event", "event_id", ["what"])], project="samples")
    s = Store(spark, _store(spark, "buffer").path, g)
    e = with_versions(table(spark, sf, "events"), {"what": ["event_type", "value"]})
    with BufferedWriter(s, rows=1000, seconds=60) as w:
        for k in range(3):
            w.put("web/event", e.where(F.pmod("event_id", F.lit(3)) == k), n=500)
    return s.read("web/event").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('samples', 3, TIMESTAMP '2026-01-02', FALSE), ('samples', 11, TIMESTAMP '2026-01-01', TRUE)) t(project, n_features, recorded_at, repeated)")
def pushed_snapshots(spark, sf):
    """A graph pushed twice, then another: what was recorded, and whether a repeated push changed nothing."""
    s = _store(spark, "pushed")
    with s.open("w"):
        system.push(s, at=_AT)
        again = system.push(s, at=_AT + _DAY).already
        system.push(s, _NEXT, at=_AT + _DAY)
    rows = system.snapshots(s, "samples")
    return rows.select("project", F.col("n_features").cast("int").alias("n_features"), F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), F.lit(again).__and__(F.col("n_features") > 3).alias("repeated"))


@query("SELECT * FROM (VALUES ('sales/customer'), ('sales/order'), ('sales/order-view')) t(feature_key)")
def pushed_graph(spark, sf):
    """The last pushed version of a project, read back as a graph."""
    s = _store(spark, "graph")
    with s.open("w"):
        system.push(s, at=_AT)
        system.push(s, _NEXT, at=_AT + _DAY)
    g = system.load_graph(s, "samples")
    same = g.project_version() == _NEXT.project_version()
    return spark.createDataFrame([(str(k),) for k in g.sorted() if same], "feature_key string")


@query("SELECT * FROM (VALUES ('started', 'sales/order', 'run-1'), ('ended', 'sales/order', 'run-1')) t(event_type, feature_key, execution_id)")
def event_log(spark, sf):
    s = _store(spark, "log")
    with s.open("w"):
        for kind in ("started", "ended"):
            system.write_event(s, kind, feature=ORDER.key, execution="run-1", payload={"rows": 1})
    return system.events(s).select("event_type", "feature_key", "execution_id")


def _named(spark, **lists) -> DataFrame:
    return spark.createDataFrame([(w, i, str(k)) for w, v in lists.items() for i, k in enumerate(v)], "walk string, place int, feature string")


@query("SELECT * FROM (VALUES ('down', 0, 'sales/customer-value'), ('down', 1, 'sales/order-totals'), ('down', 2, 'sales/order-view'), ('up', 0, 'sales/line'), ('up', 1, 'sales/order'), ('order', 0, 'sales/order'), ('order', 1, 'sales/order-view'), ('roots', 0, 'sales/customer'), ('roots', 1, 'sales/line'), ('roots', 2, 'sales/order'), ('roots', 3, 'text/document'), ('roots', 4, 'text/label')) t(walk, place, feature)")
def graph_walks(spark, sf):
    down = sorted(set(map(str, GRAPH.downstream(ORDER.key))) - {str(ORDER.key)})
    up = sorted(set(map(str, GRAPH.upstream("sales/order-totals"))) - {"sales/order-totals"})
    return _named(spark, down=down, up=up, order=GRAPH.sorted([ORDER_VIEW.key, ORDER.key]), roots=sorted(map(str, GRAPH.roots())))


@query("SELECT * FROM (VALUES ('changed', 'sales/order-view'), ('removed', 'sales/customer-value'), ('removed', 'sales/line'), ('removed', 'sales/order-totals'), ('removed', 'text/chunk'), ('removed', 'text/document'), ('removed', 'text/either'), ('removed', 'text/label'), ('removed', 'text/scored')) t(what, feature)")
def graph_difference(spark, sf):
    d = diff.compare(GRAPH, _NEXT)
    rows = [("added", str(k)) for k in d.added] + [("removed", str(k)) for k in d.removed] + [("changed", str(c.key)) for c in d.changed]
    return spark.createDataFrame(rows, "what string, feature string")


@query("SELECT event_id FROM events WHERE (event_type IS NOT NULL AND NOT value IS NULL) AND (value > 10) IS TRUE AND value <> 0")
def filter_nulls(spark, sf):
    df = table(spark, sf, "events").withColumn("big", F.col("value") > 10).withColumn("meta.value", F.col("value"))
    return df.where(parse("(event_type IS NOT NULL AND NOT value IS NULL) AND big AND meta.value != 0")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT (o_totalprice <= 50000 OR o_orderpriority IS NULL)")
def filter_as_sql(spark, sf):
    """A filter turned to SQL text, as deletes in table formats take it."""
    df = table(spark, sf, "orders")
    text = to_sql(spark, parse("o_orderstatus IN ('F', 'O') AND NOT (o_totalprice <= 50000 OR o_orderpriority = NULL)"), df.schema)
    return df.where(text).select("o_orderkey")


@query()
def hash_xxhash(spark, sf):
    """The Arrow hashes, which SQL here lacks; tests hold them against the library."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", hashed(key, XXHASH64, None).alias("h64"), hashed(key, XXHASH32, None).alias("h32"))


@query("SELECT count(*) AS n FROM customer")
def drop_and_write_again(spark, sf):
    s = _store(spark, "drop")
    with s.open("w"):
        s.write(CUSTOMER.key, customer(spark, sf).limit(5))
        s.drop(CUSTOMER.key)
        gone = not s.has(CUSTOMER.key)
        s.write(CUSTOMER.key, customer(spark, sf).where(F.lit(gone)))
    return s.read(CUSTOMER.key).agg(F.count("*").alias("n"))


