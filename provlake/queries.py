"""Queries over the sample tables, each a use of the engine's own operators, and their DuckDB twins.

The tables stand for features: customers, orders, lines, documents, labels, events. A root's data
versions are hashes of its columns. "What is stored" is a feature as it was made from earlier rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.filters import parse
from .functions.hashing import SHA256
from .graph import FeatureGraph
from .model import FeatureDep, FieldDep, FieldsMapping, Lineage, feature
from .operators.dedup import keep_latest, tail
from .operators.increment import Increment, collapse, resolve, tagged
from .operators.preview import as_text, decoded, partition_filter, top
from .operators.prepare import carried, prepare, transform
from .operators.provenance import add_provenance, complete
from .sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------------ the graph
CUSTOMER = feature("sales/customer", "c_custkey", ["profile", "balance"])
ORDER = feature("sales/order", "o_orderkey", ["status", "price"])
LINE = feature("sales/line", ["l_orderkey", "l_linenumber"], ["amount", "ship"])
DOCUMENT = feature("text/document", "doc_id", ["body", "meta"])
LABEL = feature("text/label", "doc_id", ["quality", "toxic"])
ORDER_VIEW = feature("sales/order-view", "o_orderkey", [{"key": "state", "code_version": "3", "deps": [FieldDep.of("sales/order", ["status"])]}, {"key": "money", "code_version": "1", "deps": [FieldDep.of("sales/order", ["price"])]}], ["sales/order"])
CUSTOMER_VALUE = feature("sales/customer-value", "c_custkey", ["value"], [FeatureDep.of("sales/order", rename={"o_custkey": "c_custkey"}, select=["c_custkey", "o_orderkey"], lineage=Lineage.aggregation(["c_custkey"])), FeatureDep.of("sales/customer", select=["c_custkey", "c_mktsegment"])])
ORDER_TOTALS = feature("sales/order-totals", "o_orderkey", [{"key": "totals", "deps": [FieldDep.of("sales/line", ["amount"]), FieldDep.of("sales/order", ["price"])]}, {"key": "shipping", "deps": [FieldDep.of("sales/line", ["ship"])]}], [FeatureDep.of("sales/line", rename={"l_orderkey": "o_orderkey"}, select=["o_orderkey", "l_linenumber"], lineage=Lineage.aggregation(["o_orderkey"])), FeatureDep.of("sales/order", select=["o_orderkey", "o_orderpriority"])])
SCORED = feature("text/scored", "doc_id", ["score"], [FeatureDep.of("text/document", select=["doc_id", "lang"]), FeatureDep.of("text/label", select=["doc_id"], optional=True)])
EITHER = feature("text/either", "doc_id", ["any"], [FeatureDep.of("text/document", select=["doc_id"], filters="n_chars > 2000", optional=True), FeatureDep.of("text/label", select=["doc_id"], optional=True)])
CHUNK = feature("text/chunk", ["doc_id", "chunk_no"], ["chunk"], [FeatureDep.of("text/document", select=["doc_id"], mapping=FieldsMapping.specific({"chunk": ["body"]}), lineage=Lineage.expansion(["doc_id"]))])
GRAPH = FeatureGraph([CUSTOMER, ORDER, LINE, DOCUMENT, LABEL, ORDER_VIEW, CUSTOMER_VALUE, ORDER_TOTALS, SCORED, EITHER, CHUNK], project="samples")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def version(*cols: str) -> F.Column:
    return F.substring(F.md5(F.concat_ws("|", *[F.expr(c) for c in cols])), 1, 8)


def root(df: DataFrame, **fields: F.Column) -> DataFrame:
    return complete(df.withColumn(C.PROV_BY_FIELD, C.by_field(fields)), list(fields))


_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)".format


def customer(spark, sf):
    return root(table(spark, sf, "customer"), profile=version("c_name", "c_mktsegment"), balance=version(_MONEY("c_acctbal")))


def orders(spark, sf):
    return root(table(spark, sf, "orders"), status=version("o_orderstatus", "o_orderpriority"), price=version(_MONEY("o_totalprice")))


def lines(spark, sf):
    raw = table(spark, sf, "lineitem")
    latest = keep_latest(raw, ["l_orderkey", "l_linenumber"], ["l_shipdate"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return root(latest, amount=version(_MONEY("l_extendedprice"), _MONEY("l_discount")), ship=version("CAST(CAST(l_shipdate AS DATE) AS STRING)"))


def documents(spark, sf):
    return root(table(spark, sf, "documents"), body=version("text"), meta=version("lang", "source"))


def labels(spark, sf):
    return root(table(spark, sf, "labels"), quality=version("CAST(quality AS STRING)"), toxic=version("CAST(toxic AS STRING)"))


def made(spec, tables, **kw) -> DataFrame:
    plan = GRAPH.plan(spec.key)
    return add_provenance(prepare(plan, {k.key: v for k, v in tables.items()}, **kw), plan, **kw)


def flat(df: DataFrame, spec, *extra: str) -> DataFrame:
    members = [C.col(C.PROV_BY_FIELD).getField(f.key.member).alias(f"v_{f.key.member}") for f in spec.fields]
    return df.select(*extra, *members, C.col(C.PROV).alias("v"))


# ------------------------------------------------------------------ the same in SQL
_V = "substr(md5(concat_ws('|', {})), 1, 8)".format
_M = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)".format
SQL = {
    "cust": f"SELECT *, {_V('c_name, c_mktsegment')} AS profile, {_V(_M('c_acctbal'))} AS balance FROM customer",
    "ord": f"SELECT *, {_V('o_orderstatus, o_orderpriority')} AS status, {_V(_M('o_totalprice'))} AS price FROM orders",
    "line": f"SELECT *, {_V(_M('l_extendedprice') + ', ' + _M('l_discount'))} AS amount, {_V('CAST(CAST(l_shipdate AS DATE) AS VARCHAR)')} AS ship FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1",
    "doc": f"SELECT *, {_V('text')} AS body, {_V('lang, source')} AS meta FROM documents",
    "lab": f"SELECT *, substr(md5(CAST(quality AS VARCHAR)), 1, 8) AS vq, substr(md5(CAST(toxic AS VARCHAR)), 1, 8) AS vt FROM labels",
}
_H = "substr(md5({}), 1, 8)".format
SQL["agg_ord"] = f"SELECT o_custkey, {_H("string_agg(status, '|' ORDER BY o_orderkey)")} AS status, {_H("string_agg(price, '|' ORDER BY o_orderkey)")} AS price FROM ord GROUP BY o_custkey"
SQL["value"] = f"SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment, {_H("concat('value|1|sales/customer.balance|', c.balance, '|sales/customer.profile|', c.profile, '|sales/order.price|', a.price, '|sales/order.status|', a.status)")} AS v_value FROM ord o JOIN agg_ord a USING (o_custkey) JOIN cust c ON c.c_custkey = o.o_custkey"
SQL["expected"] = f"SELECT DISTINCT c_custkey, {_H('v_value')} AS v FROM value"


def sql(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body


# ------------------------------------------------------------------ provenance
@query(sql(f"SELECT o_orderkey, v_state, v_money, {_H("concat(v_money, '|', v_state)")} AS v FROM (SELECT o_orderkey, {_H("concat('state|3|sales/order.status|', status)")} AS v_state, {_H("concat('money|1|sales/order.price|', price)")} AS v_money FROM ord)", "ord"))
def provenance_identity(spark, sf):
    return flat(made(ORDER_VIEW, {ORDER: orders(spark, sf)}), ORDER_VIEW, "o_orderkey")


@query(sql("SELECT o_orderkey, v_state, v_money, substr(sha256(concat(v_money, '|', v_state)), 1, 8) AS v FROM (SELECT o_orderkey, substr(sha256(concat('state|3|sales/order.status|', status)), 1, 8) AS v_state, substr(sha256(concat('money|1|sales/order.price|', price)), 1, 8) AS v_money FROM ord)", "ord"))
def provenance_sha256(spark, sf):
    return flat(made(ORDER_VIEW, {ORDER: orders(spark, sf)}, algorithm=SHA256), ORDER_VIEW, "o_orderkey")


@query(sql(f"SELECT o_orderkey, c_custkey, c_mktsegment, v_value, {_H('v_value')} AS v FROM value", "cust", "ord", "agg_ord", "value"))
def provenance_aggregation(spark, sf):
    return flat(made(CUSTOMER_VALUE, {CUSTOMER: customer(spark, sf), ORDER: orders(spark, sf)}), CUSTOMER_VALUE, "o_orderkey", "c_custkey", "c_mktsegment")


SQL["agg_line"] = f"SELECT l_orderkey, {_H("string_agg(amount, '|' ORDER BY l_orderkey, l_linenumber)")} AS amount, {_H("string_agg(ship, '|' ORDER BY l_orderkey, l_linenumber)")} AS ship FROM line GROUP BY l_orderkey"
SQL["totals"] = f"SELECT l.l_linenumber, o.o_orderkey, o.o_orderpriority, {_H("concat('totals|1|sales/line.amount|', a.amount, '|sales/order.price|', o.price)")} AS v_totals, {_H("concat('shipping|1|sales/line.ship|', a.ship)")} AS v_shipping FROM line l JOIN agg_line a USING (l_orderkey) JOIN ord o ON o.o_orderkey = l.l_orderkey"


@query(sql(f"SELECT o_orderkey, l_linenumber, o_orderpriority, v_totals, v_shipping, {_H("concat(v_shipping, '|', v_totals)")} AS v FROM totals", "line", "ord", "agg_line", "totals"))
def provenance_mixed_lineage(spark, sf):
    return flat(made(ORDER_TOTALS, {LINE: lines(spark, sf), ORDER: orders(spark, sf)}), ORDER_TOTALS, "o_orderkey", "l_linenumber", "o_orderpriority")


@query(sql(f"SELECT doc_id, v_chunk, {_H('v_chunk')} AS v FROM (SELECT doc_id, {_H("concat('chunk|1|text/document.body|', body)")} AS v_chunk FROM doc)", "doc"))
def provenance_expansion(spark, sf):
    return flat(made(CHUNK, {DOCUMENT: documents(spark, sf)}), CHUNK, "doc_id")


@query(sql(f"SELECT doc_id, lang, v_score, {_H('v_score')} AS v FROM (SELECT d.doc_id, d.lang, {_H("concat('score|1|text/document.body|', d.body, '|text/document.meta|', d.meta, '|text/label.quality|', coalesce(l.vq, ''), '|text/label.toxic|', coalesce(l.vt, ''))")} AS v_score FROM doc d LEFT JOIN lab l USING (doc_id))", "doc", "lab"))
def join_optional_left(spark, sf):
    return flat(made(SCORED, {DOCUMENT: documents(spark, sf), LABEL: labels(spark, sf)}), SCORED, "doc_id", "lang")


@query(sql(f"SELECT doc_id, v_any, {_H('v_any')} AS v FROM (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, {_H("concat('any|1|text/document.body|', coalesce(d.body, ''), '|text/document.meta|', coalesce(d.meta, ''), '|text/label.quality|', coalesce(l.vq, ''), '|text/label.toxic|', coalesce(l.vt, ''))")} AS v_any FROM (SELECT * FROM doc WHERE n_chars > 2000) d FULL JOIN lab l ON d.doc_id = l.doc_id)", "doc", "lab"))
def join_all_optional_full(spark, sf):
    return flat(made(EITHER, {DOCUMENT: documents(spark, sf), LABEL: labels(spark, sf)}), EITHER, "doc_id")


@query("SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_required_inner(spark, sf):
    return prepare(GRAPH.plan(CUSTOMER_VALUE.key), {ORDER.key: orders(spark, sf), CUSTOMER.key: customer(spark, sf)}).select("o_orderkey", "c_custkey", "c_mktsegment")


@query(sql("SELECT c_custkey, value_of_order, status AS parent_status, price AS parent_price FROM (SELECT o_custkey AS c_custkey, o_totalprice AS value_of_order, o_orderkey, status, price FROM ord) WHERE value_of_order > 100000 AND c_custkey IS NOT NULL", "ord"))
def dep_rename_select(spark, sf):
    dep = FeatureDep.of("sales/order", rename={"o_custkey": "c_custkey", "o_totalprice": "value_of_order"}, select=["c_custkey", "value_of_order"], filters=["value_of_order > 100000", "c_custkey IS NOT NULL"])
    df = transform(orders(spark, sf), dep, ORDER)
    data = C.col(carried(C.DATA_BY_FIELD, ORDER.key))
    return df.select("c_custkey", "value_of_order", data.getField("status").alias("parent_status"), data.getField("price").alias("parent_price"))


@query(sql(f"SELECT o_orderkey, v_state, v_money FROM (SELECT o_orderkey, {_H("concat('state|3|sales/order.status|', CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE status END)")} AS v_state, {_H("concat('money|1|sales/order.price|', price)")} AS v_money FROM ord)", "ord"))
def data_version_override(spark, sf):
    """Data versions that are set by hand drive what comes after, whatever the provenance."""
    df = orders(spark, sf)
    own = F.struct(F.when(F.col("o_orderstatus") == "F", "final").otherwise(C.col(C.DATA_BY_FIELD).getField("status")).alias("status"), C.col(C.DATA_BY_FIELD).getField("price").alias("price"))
    return flat(made(ORDER_VIEW, {ORDER: df.withColumn(C.DATA_BY_FIELD, own)}), ORDER_VIEW, "o_orderkey").drop("v")


@query(sql(f"SELECT o_orderkey, {_H("concat('state|3|sales/order.status|', status)")} AS v_state FROM ord", "ord"))
def map_columns(spark, sf):
    df = orders(spark, sf)
    df = df.withColumns({c: C.struct_to_map(df, c) for c in (C.PROV_BY_FIELD, C.DATA_BY_FIELD)})
    plan = GRAPH.plan(ORDER_VIEW.key)
    out = add_provenance(prepare(plan, {ORDER.key: df}), plan, as_map=True)
    return out.select("o_orderkey", C.member(out, C.PROV_BY_FIELD, "state").alias("v_state"))


@query(sql(f"SELECT o_orderkey, {_H("concat('state|3|sales/order.status|', status)")} AS v_state FROM ord JOIN customer ON o_custkey = c_custkey", "ord"))
def provenance_of_own_join(spark, sf):
    """compute_provenance over parents that the caller has joined."""
    plan = GRAPH.plan(ORDER_VIEW.key)
    mine = transform(orders(spark, sf), plan.spec.deps[0], ORDER).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return flat(add_provenance(mine, plan), ORDER_VIEW, "o_orderkey").select("o_orderkey", "v_state")


# ------------------------------------------------------------------ increments
def _value_now(spark, sf):
    return made(CUSTOMER_VALUE, {CUSTOMER: customer(spark, sf), ORDER: orders(spark, sf)}).select("c_custkey", C.PROV).distinct()


def _value_then(spark, sf):
    """Before urgent orders got their prices and furniture makers became customers; suppliers were customers."""
    then = orders(spark, sf).withColumn(C.DATA_BY_FIELD, F.struct(C.col(C.DATA_BY_FIELD).getField("status").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "none").otherwise(C.col(C.DATA_BY_FIELD).getField("price")).alias("price")))
    old = made(CUSTOMER_VALUE, {CUSTOMER: customer(spark, sf).where("c_mktsegment != 'FURNITURE'"), ORDER: then}).select("c_custkey", "c_mktsegment", C.PROV).distinct()
    gone = table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.lit(None).cast("string").alias("c_mktsegment"), F.lit("gone").alias(C.PROV))
    return old.unionByName(gone)


SQL["then_ord"] = f"SELECT o_custkey, {_H("string_agg(status, '|' ORDER BY o_orderkey)")} AS status, {_H("string_agg(CASE WHEN o_orderpriority = '1-URGENT' THEN 'none' ELSE price END, '|' ORDER BY o_orderkey)")} AS price FROM ord GROUP BY o_custkey"
SQL["stored"] = f"SELECT c.c_custkey, c.c_mktsegment, {_H(_H("concat('value|1|sales/customer.balance|', c.balance, '|sales/customer.profile|', c.profile, '|sales/order.price|', a.price, '|sales/order.status|', a.status)"))} AS s FROM cust c JOIN then_ord a ON c.c_custkey = a.o_custkey WHERE c.c_mktsegment <> 'FURNITURE' UNION ALL SELECT -s_suppkey, NULL, 'gone' FROM supplier"
_ALL = ("cust", "ord", "agg_ord", "value", "expected", "then_ord", "stored")


def _increment(spark, sf, **kw) -> Increment:
    return resolve(_value_now(spark, sf), _value_then(spark, sf), ["c_custkey"], **kw)


@query(sql("SELECT c_custkey, v FROM expected e WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.c_custkey = e.c_custkey)", *_ALL))
def increment_new(spark, sf):
    return _increment(spark, sf).new.select("c_custkey", C.col(C.PROV).alias("v"))


@query(sql("SELECT e.c_custkey, e.v FROM expected e JOIN stored s USING (c_custkey) WHERE s.s IS NULL OR s.s <> e.v", *_ALL))
def increment_stale(spark, sf):
    return _increment(spark, sf).stale.select("c_custkey", C.col(C.PROV).alias("v"))


@query(sql("SELECT c_custkey, s AS v FROM stored s WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE s.c_custkey = e.c_custkey)", *_ALL))
def increment_orphaned(spark, sf):
    return _increment(spark, sf).orphaned.select("c_custkey", C.col(C.PROV).alias("v"))


@query(sql("SELECT e.c_custkey, e.v FROM expected e JOIN stored s USING (c_custkey) WHERE s.s <> e.v OR s.c_mktsegment = 'BUILDING' OR s.c_custkey < 100", *_ALL))
def stale_predicate(spark, sf):
    return _increment(spark, sf, stale_if=["c_mktsegment = 'BUILDING'", "c_custkey < 100"]).stale.select("c_custkey", C.col(C.PROV).alias("v"))


@query(sql("SELECT e.c_custkey, e.v, 'new' AS status FROM expected e ANTI JOIN stored s USING (c_custkey) UNION ALL SELECT e.c_custkey, e.v, 'stale' FROM expected e JOIN stored s USING (c_custkey) WHERE s.s <> e.v", *_ALL))
def union_incremental(spark, sf):
    return _increment(spark, sf).changes().select("c_custkey", C.col(C.PROV).alias("v"), "status")


@query(sql("SELECT status, count(*) AS n FROM (SELECT CASE WHEN s.c_custkey IS NULL THEN 'new' WHEN e.c_custkey IS NULL THEN 'orphaned' WHEN s.s IS NULL OR s.s <> e.v THEN 'stale' ELSE 'fresh' END AS status FROM expected e FULL JOIN stored s ON e.c_custkey = s.c_custkey) GROUP BY status", *_ALL))
def status_counts(spark, sf):
    return tagged(_value_now(spark, sf), _value_then(spark, sf), ["c_custkey"]).groupBy("status").agg(F.count("*").alias("n"))


@query(sql("SELECT c_custkey, v FROM expected", *_ALL[:5]))
def skip_comparison(spark, sf):
    return resolve(_value_now(spark, sf), None, ["c_custkey"]).new.select("c_custkey", C.col(C.PROV).alias("v"))


@query(sql("SELECT (SELECT count(DISTINCT c_custkey) FROM expected) AS total, (SELECT count(DISTINCT e.c_custkey) FROM expected e ANTI JOIN stored s USING (c_custkey)) AS missing", *_ALL))
def progress(spark, sf):
    inc = _increment(spark, sf)
    return inc.input.select(F.lit(0).alias("new"), "c_custkey").unionByName(inc.new.select(F.lit(1).alias("new"), "c_custkey")).agg(F.count_distinct(F.when(F.col("new") == 0, F.col("c_custkey"))).alias("total"), F.count_distinct(F.when(F.col("new") == 1, F.col("c_custkey"))).alias("missing"))


@query(sql(f"SELECT d.doc_id, {_H(_H("concat('chunk|1|text/document.body|', d.body)"))} AS v FROM doc d JOIN conversations_chunks c USING (doc_id) WHERE c.lang <> 'en'", "doc").replace("WITH ", "WITH conversations_chunks AS (SELECT DISTINCT doc_id, lang FROM documents WHERE n_chars > 300), ", 1))
def expansion_increment(spark, sf):
    """Stored chunks, several a document, against documents; those that aren't English were made otherwise."""
    expected = made(CHUNK, {DOCUMENT: documents(spark, sf)}).select("doc_id", C.PROV)
    docs = table(spark, sf, "documents").where("n_chars > 300").select("doc_id", "lang")
    stored = expected.join(docs, "doc_id").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_no"), F.when(F.col("lang") == "en", C.col(C.PROV)).otherwise("before").alias(C.PROV))
    return resolve(expected, stored, ["doc_id"], expands=True).stale.select("doc_id", C.col(C.PROV).alias("v"))


@query("SELECT conv_id, any_value(role) IS NOT NULL AS has_role, count(*) AS turns FROM conversations GROUP BY conv_id")
def collapse_children(spark, sf):
    t = table(spark, sf, "conversations")
    n = t.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return collapse(t, ["conv_id"]).join(n, "conv_id").select("conv_id", F.col("role").isNotNull().alias("has_role"), "turns")


# ------------------------------------------------------------------ reading
@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def read_latest(spark, sf):
    return keep_latest(table(spark, sf, "events"), ["user_id"], ["ts"], ["event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, CASE WHEN event_type = 'click' THEN ts END AS gone FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(gone, ts) DESC, event_id DESC) = 1 AND gone IS NULL AND value > 20")
def read_soft_deleted(spark, sf):
    """Clicks stand for deletions: the latest row of a user decides, then it must be live, then filters apply."""
    df = table(spark, sf, "events").withColumn("gone", F.when(F.col("event_type") == "click", F.col("ts")))
    return keep_latest(df, ["user_id"], ["gone", "ts"], ["event_id"]).where("gone IS NULL").where(parse("value > 20")).select("user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1")
def keep_latest_lines(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'O') AND NOT (o_totalprice <= 50000 OR o_orderpriority = '5-LOW')) OR o_orderkey = 7 AND o_custkey IS NOT NULL AND -1 < o_totalprice")
def filter_parser(spark, sf):
    text = "(o_orderstatus IN ('F', 'O') AND NOT (o_totalprice <= 50000 OR o_orderpriority = '5-LOW')) OR o_orderkey = 7 AND o_custkey != NULL AND -1 < o_totalprice"
    return table(spark, sf, "orders").where(parse(text)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def tail_n(spark, sf):
    return tail(table(spark, sf, "orders"), 25, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_at, CAST(sum(epoch_us(ts)) AS DOUBLE) / count(*) AS mean_at_us FROM events GROUP BY event_type")
def version_summary(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_at"), (F.sum(F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)")).cast("double") / F.count("*")).alias("mean_at_us"))


@query("SELECT event_type, user_id, value FROM events WHERE event_type IN ('click', 'view') AND user_id = 1")
def partition_filters(spark, sf):
    keys = {"event_type": ["click", "view"], "user_id": [1], "value": []}
    return table(spark, sf, "events").where(partition_filter(keys)).select("event_type", "user_id", "value")


@query("SELECT vec_id, '[' || CAST(label AS VARCHAR) || ',' || CAST(label + 1 AS VARCHAR) || ',...,' || CAST(label + 4 AS VARCHAR) || ',' || CAST(label + 5 AS VARCHAR) || ']' AS shown, '{\"id\":' || CAST(vec_id AS VARCHAR) || ',\"label\":' || CAST(label AS VARCHAR) || '}' AS nested FROM embeddings ORDER BY vec_id DESC LIMIT 50")
def preview_nested(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.sequence("label", F.col("label") + 5).alias("shown"), F.struct(F.col("vec_id").alias("id"), "label").alias("nested"))
    few = top(df, 50, ["vec_id"], descending=True)
    return few.select("vec_id", as_text(few, "shown").alias("shown"), as_text(few, "nested").alias("nested"))


@query("SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type FROM events")
def json_round_trip(spark, sf):
    """Structs stored as JSON text, as databases without structs have them, and read back."""
    df = table(spark, sf, "events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("j"))
    return decoded(df, "j", "user_id long, event_type string").select("event_id", "j.user_id", "j.event_type")


# ------------------------------------------------------------------ through a store
def _store(spark, name: str) -> Store:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="provlake-")
    return Store(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", GRAPH)


_AT = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
_DAY = dt.timedelta(days=1)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0 OR c_mktsegment = 'BUILDING'")
def store_write_delete_read(spark, sf):
    """Written, those in debt softly deleted, builders written again: a later row brings an id back."""
    s = _store(spark, "delete")
    df = customer(spark, sf)
    with s.open("w"):
        with s.transaction(_AT):
            s.write(CUSTOMER.key, df)
        with s.transaction(_AT + _DAY):
            s.delete(CUSTOMER.key, "c_acctbal < 0")
        with s.transaction(_AT + 2 * _DAY):
            s.write(CUSTOMER.key, df.where("c_mktsegment = 'BUILDING'"))
    return s.read(CUSTOMER.key).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0")
def store_hard_delete(spark, sf):
    s = _store(spark, "hard")
    with s.open("w"):
        s.write(CUSTOMER.key, customer(spark, sf))
        s.delete(CUSTOMER.key, "c_acctbal < 0", soft=False)
    return s.read(CUSTOMER.key, sample_history=True, deleted=True).select("c_custkey")


@query("SELECT c_custkey, 2 AS n FROM customer")
def copy_history(spark, sf):
    a, b = _store(spark, "from"), _store(spark, "to")
    df = customer(spark, sf)
    with a.open("w"):
        for k in range(2):
            with a.transaction(_AT + k * _DAY):
                a.write(CUSTOMER.key, df)
    with b.open("w"):
        b.copy_from(a, [CUSTOMER.key], sample_history=True)
    return b.read(CUSTOMER.key, sample_history=True).groupBy("c_custkey").agg(F.count("*").cast("int").alias("n"))


@query(sql("SELECT o_orderkey, 'stale' AS status FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P'", "ord"))
def store_resolve_update(spark, sf):
    """Parents written, a feature made, urgent orders changed: what is new and what is stale."""
    s = _store(spark, "resolve")
    df = orders(spark, sf)
    with s.open("w"):
        with s.transaction(_AT):
            s.write(ORDER.key, df)
            s.write(ORDER_VIEW.key, s.resolve_update(ORDER_VIEW.key, filters={ORDER.key: "o_orderstatus <> 'P'"}).new)
        with s.transaction(_AT + _DAY):
            changed = df.where("o_orderpriority = '1-URGENT'").withColumn(C.PROV_BY_FIELD, C.by_field({"status": F.lit("changed"), "price": F.lit("too")})).drop(C.PROV, C.DATA, C.DATA_BY_FIELD)
            s.write(ORDER.key, changed)
    return s.resolve_update(ORDER_VIEW.key).changes().select("o_orderkey", "status")


@query("SELECT event_id, event_type FROM events")
def stream_append(spark, sf):
    """A file stream appended to a feature, micro-batch by micro-batch, and read back."""
    from .streaming.writer import with_versions, write_stream

    g = FeatureGraph([feature("web/event", "event_id", ["what"])], project="samples")
    s = _store(spark, "stream")
    s = Store(spark, s.path, g)
    src = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src if not src.endswith("events.parquet") or _is_dir(spark, src) else f"{sf}/event[s].parquet")
    write_stream(s, "web/event", stream, checkpoint=f"{s.path}/checkpoint", make=lambda df: with_versions(df, {"what": ["event_type", "value"]})).awaitTermination()
    return s.read("web/event").select("event_id", "event_type")


def _is_dir(spark, path: str) -> bool:
    from .sources.files import Files

    fs, p = Files(spark)._at(path)
    return fs.getFileStatus(p).isDirectory()


from . import store_queries  # noqa: E402, F401  (registers its queries)
