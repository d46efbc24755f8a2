"""Tables under crashes, readers and writers; conditions as SQL; pruned reads; statuses under filters."""

import json

import pytest
from provlake import cli
from provlake.functions import columns as C
from provlake.functions.filters import parse, to_sql
from provlake.graph import FeatureGraph
from provlake.model import feature
from provlake.operators.increment import resolve
from provlake.sources.store import Store
from provlake.sources.tables import FormatTable, ParquetTable
from provlake.status import report
from pyspark.sql import functions as F


def rows(spark, n, tag="a"):
    return spark.range(n).select("id", F.lit(tag).alias("tag"))


def test_a_rewrite_that_died_can_be_tried_again(spark, tmp_path, monkeypatch):
    t = ParquetTable(spark, f"file://{tmp_path}/t")
    t.append(rows(spark, 10), "v1")
    with monkeypatch.context() as m:
        m.setattr(ParquetTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.rewrite(lambda df: df.where("id > 4"))
    assert t.read().count() == 10
    t.rewrite(lambda df: df.where("id > 4"))
    assert t.read().count() == 5


def test_readers_survive_a_rewrite(spark, tmp_path):
    t = ParquetTable(spark, f"file://{tmp_path}/t")
    t.append(rows(spark, 10), "v1")
    before = t.read()
    t.rewrite(lambda df: df.where("id > 4"))
    assert before.count() == 10 and t.read().count() == 5
    t.rewrite(lambda df: df.where("id > 5"))
    assert t.read().count() == 4 and len([x for x in t.files.list(t.path) if x != "log"]) == 2


def test_an_append_beside_a_rewrite_isnt_lost(spark, tmp_path, monkeypatch):
    t, other = (ParquetTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    t.append(rows(spark, 10), "v1")
    put, once = ParquetTable._put, []

    def late(self, df, folder, part):
        put(self, df, folder, part)
        if not once:
            once.append(1)
            other.rewrite(lambda df: df.where("id > 4 AND tag = 'a'"))

    monkeypatch.setattr(ParquetTable, "_put", late)
    t.append(rows(spark, 3, "b"), "v1")
    assert t.read().where("tag = 'b'").count() == 3 and t.read().where("tag = 'a'").count() == 5

    def during(df):
        other.append(rows(spark, 2, "c"), "v2")
        return df

    with pytest.raises(RuntimeError, match="try again"):
        t.rewrite(during)
    assert t.read().where("tag = 'c'").count() >= 2


def test_conditions_as_sql(spark):
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, -1.0), (3, "it's", 0.0)], "id long, s string, v double")
    df.createOrReplaceTempView("conditions")
    for text in ("id IN (1, 3) AND NOT v <= 0", "s = NULL OR v < -0.5", "s != 'x'", "s = 'it''s'", "id IS NOT NULL AND (v > 1 OR s IS NULL)"):
        got = spark.sql(f"SELECT id FROM conditions WHERE {to_sql(spark, parse(text), df.schema)}").collect()
        assert got == df.where(parse(text)).select("id").collect()


def test_hard_delete_of_a_format_table_is_sql(spark, monkeypatch):
    said = []
    g = FeatureGraph([feature("a/b", "id", ["x"])])
    s = Store(spark, "db", g, kind="delta")
    monkeypatch.setattr(FormatTable, "schema", spark.createDataFrame([], f"id long, v double, {C.FEATURE_VERSION} string").schema)
    monkeypatch.setattr(FormatTable, "delete_where", lambda self, sql: said.append((self.name, sql)))
    with s.open("w"):
        s.delete("a/b", "v < 0 OR id = 7", soft=False)
    name, sql = said[0]
    assert name == f"db.{g['a/b'].key.table}" and g.feature_version("a/b") in sql
    df = spark.createDataFrame([(1, -1.0, g.feature_version("a/b")), (7, 2.0, "old"), (7, 2.0, g.feature_version("a/b")), (8, None, g.feature_version("a/b"))], f"id long, v double, {C.FEATURE_VERSION} string")
    assert sorted(x["id"] for x in df.where(sql).collect()) == [1, 7]


@pytest.fixture()
def store(spark, tmp_path):
    g = FeatureGraph([feature("r/root", "id", ["x"]), feature("r/leaf", "id", ["y"], ["r/root"])], project="p")
    s = Store(spark, f"file://{tmp_path}/s", g)
    df = spark.range(20).select("id", F.concat(F.lit("t"), "id").alias("text"), C.by_field({"x": F.col("id").cast("string")}).alias(C.PROV_BY_FIELD))
    with s.open("w"):
        assert s.write("r/root", df) == 20 and s.write("r/root", df.limit(0)) == 0
        s.write("r/leaf", s.resolve_update("r/leaf", filters={"r/root": "id < 12"}).new)
        s.write("r/root", df.where("id < 5").withColumn(C.PROV_BY_FIELD, C.by_field({"x": F.lit("new")})))
    return s


def test_reads_open_only_what_they_need(store):
    plan = store.read("r/root", columns=["id"])._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "text" not in schema and C.DATA_BY_FIELD not in schema


def test_changes_are_one_join(store):
    inc = store.resolve_update("r/leaf")
    plan = inc.changes()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
    got = {(x["id"], x["status"]) for x in inc.changes().collect()}
    assert got == {(i, "stale") for i in range(5)} | {(i, "new") for i in range(12, 20)}
    assert got == {(x["id"], "new") for x in inc.new.collect()} | {(x["id"], "stale") for x in inc.stale.collect()}


def test_changes_with_null_ids_and_marks(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], f"id long, {C.PROV} string")
    c = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (None, "d"), (9, "z")], f"id long, {C.PROV} string")
    inc = resolve(e, c, ["id"], stale_if=["id = 1"])
    assert sorted(((x["id"] or 0), x["status"]) for x in inc.changes().collect()) == [(0, "new"), (1, "stale"), (2, "stale"), (3, "stale")]
    assert inc.orphaned.count() == 2


def test_statuses_under_filters(store):
    full = {s.key: s for s in report(store, progress=True)}
    assert (full["r/leaf"].stored, full["r/leaf"].new, full["r/leaf"].stale, full["r/leaf"].category) == (12, 8, 5, "needs_update")
    assert full["r/root"].category == "root" and full["r/leaf"].progress.percent == 60.0 == store.progress("r/leaf").percent
    some = {s.key: s for s in report(store, global_filters="id >= 10")}["r/leaf"]
    assert (some.stored, some.new, some.stale, some.orphaned) == (2, 8, 0, 0)
    held = {s.key: s for s in report(store, filters={"r/root": "id < 12"})}["r/leaf"]
    assert (held.new, held.stale, held.orphaned) == (0, 5, 0)


def test_copies_under_filters(store, spark, tmp_path):
    to = Store(spark, f"file://{tmp_path}/to", store.graph)
    with to.open("w"):
        assert to.copy_from(store, global_filters="id < 3") == {"r/root": 3, "r/leaf": 3}
    assert to.read("r/root").count() == 3
    assert sorted(r["n"] for r in store.runs("r/root").collect()) == [25]


def test_status_command_takes_filters(store, spark, tmp_path, capsys, monkeypatch):
    from provlake.project import Config

    monkeypatch.setattr(Config, "load", classmethod(lambda cls, path: type("X", (), {"graph": lambda self: store.graph, "open_store": lambda self, *a: store})()))
    assert cli.main(["status", "--filter", "id >= 10"], spark) == 0
    got = {x["key"]: x for x in json.loads(capsys.readouterr().out)}
    assert got["r/leaf"]["stored"] == 2 and got["r/root"]["stored"] == 10
    assert cli.main(["status", "r/leaf", "--global-filter", "id >= 10"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["new"] == 8
