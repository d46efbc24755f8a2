import datetime as dt
import json

import pytest
from provlake.cli import main
from provlake.functions import columns as C
from provlake.graph import FeatureGraph
from provlake.model import FeatureDep, feature
from provlake.project import Config
from provlake.sources import system
from provlake.sources.store import ReadOnly, Store
from provlake.sources.tables import TableMissing
from provlake.status import report, status
from provlake.streaming.writer import BufferedWriter, with_versions, write_stream
from provlake.tools import Tools
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
DAY = dt.timedelta(days=1)


def graph(code="1"):
    return FeatureGraph([feature("root", "id", ["a", "b"]), feature("leaf", "id", [{"key": "a", "code_version": code}], ["root"])])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", graph())


def root(spark, data):
    return with_versions(spark.createDataFrame(data, "id int, x string, y string"), {"a": ["x"], "b": ["y"]})


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_modes_and_missing(spark, store):
    with pytest.raises(ReadOnly):
        store.write("root", root(spark, [(1, "u", "v")]))
    with pytest.raises(TableMissing):
        store.read("root")
    with store.open("w"), pytest.raises(ValueError, match="provenance"):
        store.write("root", spark.range(3))
    with pytest.raises(ValueError):
        store.read("root", feature_version="x", feature_history=True)


def test_write_resolve_write(spark, store):
    with store.open("w"):
        with store.transaction(T0):
            store.write("root", root(spark, [(1, "u", "v"), (2, "w", "z")]), run_id="r1")
        first = store.resolve_update("leaf")
        assert ids(first.new) == [1, 2] and ids(first.stale) == [] == ids(first.orphaned)
        store.write("leaf", first.new)
        same = store.resolve_update("leaf")
        assert ids(same.new) == ids(same.stale) == ids(same.orphaned) == []
        with store.transaction(T0 + DAY):
            store.write("root", root(spark, [(1, "u", "CHANGED"), (2, "CHANGED", "z"), (3, "n", "n")]))
        inc = store.resolve_update("leaf")
        assert ids(inc.new) == [3] and ids(inc.stale) == [2]  # field b isn't used
        assert {r["status"] for r in inc.changes().collect()} == {"new", "stale"}
        assert ids(store.resolve_update("leaf", global_filters="id < 3").new) == []
        assert ids(store.resolve_update("leaf", target_filters="id = 99").new) == [1, 2, 3]
        assert ids(store.resolve_update("leaf", skip_comparison=True).new) == [1, 2, 3]
        assert ids(store.resolve_update("leaf", stale_if="id = 1").stale) == [1, 2]
        p = store.progress("leaf")
        assert (p.total, p.missing) == (3, 1)
        s = status(store, "leaf")
        assert (s.category, s.new, s.stale, s.orphaned, s.stored) == ("needs_update", 1, 1, 0, 2)
        store.write("leaf", inc.changes().drop("status"))
        assert [x.category for x in report(store)] == ["root", "up_to_date"]
        store.delete("root", "id = 3")
        assert ids(store.resolve_update("leaf").orphaned) == [3]
    r = store.read("root", sample_history=True).where(C.col(C.RUN) == "r1").collect()
    assert len(r) == 2 and all(x[C.CREATED] == x[C.UPDATED] for x in r)


def test_delete_soft_hard_and_back(spark, store):
    with store.open("w"):
        with store.transaction(T0):
            store.write("root", root(spark, [(i, "u", "v") for i in range(4)]))
        with store.transaction(T0 + DAY):
            store.delete("root", "id < 2")
        assert ids(store.read("root")) == [2, 3] and ids(store.read("root", deleted=True)) == [0, 1, 2, 3]
        assert ids(store.read("root", sample_history=True)) == [0, 1, 2, 3]
        with store.transaction(T0 + 2 * DAY):
            store.write("root", root(spark, [(0, "again", "v")]))
        assert ids(store.read("root")) == [0, 2, 3]
        store.delete("root", "id = 2", soft=False)
        assert ids(store.read("root", sample_history=True, deleted=True)) == [0, 0, 0, 1, 1, 3]
        store.drop("root")
        assert not store.has("root")


def test_versions_history_and_new_fields(spark, tmp_path):
    old = Store(spark, f"file://{tmp_path}/s", FeatureGraph([feature("root", "id", ["a"])]))
    new = Store(spark, old.path, FeatureGraph([feature("root", "id", ["a", "b"])]))
    with old.open("w"), old.transaction(T0):
        old.write("root", with_versions(spark.createDataFrame([(1, "u"), (2, "u")], "id int, x string"), {"a": ["x"]}))
    with new.open("w"), new.transaction(T0 + DAY):
        new.write("root", root(spark, [(1, "u", "v")]))
    assert ids(new.read("root")) == [1] and ids(old.read("root")) == [1, 2]
    assert ids(new.read("root", feature_history=True)) == [1, 2] and ids(new.read("root", feature_history=True, sample_history=True)) == [1, 1, 2]
    assert new.read("root", columns=["y"]).columns == ["y"]


def test_fallback_and_copy(spark, store, tmp_path):
    with store.open("w"):
        store.write("root", root(spark, [(1, "u", "v")]))
    dev = Store(spark, f"file://{tmp_path}/dev", graph(), fallbacks=[store], name="dev")
    df, owner = dev.read("root", with_store=True)
    assert owner is store and ids(df) == [1] and dev.find("leaf") is None and dev.has("root", fallback=True) and not dev.has("root")
    assert ids(dev.resolve_update("leaf").new) == [1]
    with pytest.raises(TableMissing):
        dev.read("root", fallback=False)
    with dev.open("w"):
        assert dev.copy_from(store) == {"root": 1}
    assert ids(dev.read("root", fallback=False)) == [1]
    with pytest.raises(ValueError):
        Store(spark, "x", graph(), algorithm="sha256", fallbacks=[store])


def test_samples_and_data_version_override(spark, store):
    with pytest.raises(ValueError, match="samples"):
        store.resolve_update("root")
    s = root(spark, [(1, "u", "v")])
    with store.open("w"):
        inc = store.resolve_update("root", samples=s)
        store.write("root", inc.new.withColumn(C.DATA_BY_FIELD, C.by_field({"a": F.lit("fixed"), "b": F.lit("fixed")})).drop(C.DATA))
        store.write("leaf", store.resolve_update("leaf").new)
        more = root(spark, [(1, "OTHER", "v")])
        assert ids(store.resolve_update("root", samples=more).stale) == [1]
        store.write("root", more.withColumn(C.DATA_BY_FIELD, C.by_field({"a": F.lit("fixed"), "b": F.lit("fixed")})))
        assert ids(store.resolve_update("leaf").stale) == []


def test_rebase(spark, tmp_path):
    one, two = graph("1"), graph("2")
    s = Store(spark, f"file://{tmp_path}/s", one)
    with s.open("w"):
        s.write("root", root(spark, [(1, "u", "v"), (2, "x", "y")]))
        s.write("leaf", s.resolve_update("leaf").new.withColumn("mine", F.lit("kept")))
    t = Store(spark, s.path, two)
    assert ids(t.resolve_update("leaf").new) == [1, 2]
    with t.open("w"):
        t.write("leaf", t.rebase("leaf", s.read("leaf"), two))
    assert {r["mine"] for r in t.read("leaf").collect()} == {"kept"}
    inc = t.resolve_update("leaf")
    assert ids(inc.new) == ids(inc.stale) == []
    with pytest.raises(ValueError):
        t.rebase("root", s.read("root"), two)


def test_system_tables(spark, store):
    with store.open("w"):
        a = system.push(store, at=T0)
        b = system.push(store, at=T0 + DAY)
        assert a.changed == ["leaf", "root"] and b.already
        c = system.push(store, graph("2"), at=T0 + 2 * DAY)
        assert c.changed == ["leaf"]
        system.write_event(store, "started", feature="leaf", payload={"n": 1})
    assert [r["n_features"] for r in system.snapshots(store).collect()] == [2, 2]
    assert system.load_graph(store, "default").feature_version("leaf") == graph("2").feature_version("leaf")
    assert system.load_graph(store, "default", a.project_version).feature_version("leaf") == graph().feature_version("leaf")
    assert json.loads(system.events(store).first()["payload"]) == {"n": 1}


def test_maps(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/m", graph(), as_map=True)
    with s.open("w"):
        s.write("root", root(spark, [(1, "u", "v")]))
        s.write("leaf", s.resolve_update("leaf").new)
    assert s.read("leaf").first()[C.PROV_BY_FIELD].keys() == {"a"}
    assert ids(s.resolve_update("leaf").stale) == []


def test_stream_and_buffer(spark, store, tmp_path):
    src = f"file://{tmp_path}/in"
    schema = "id int, x string, y string"
    make = lambda df: with_versions(df, {"a": ["x"], "b": ["y"]})
    go = lambda: write_stream(store, "root", spark.readStream.schema(schema).parquet(src), checkpoint=f"file://{tmp_path}/cp", make=make).awaitTermination()
    for k in range(2):
        spark.createDataFrame([(k, "u", "v")], schema).write.mode("append").parquet(src)
        go()
    go()
    assert ids(store.read("root", sample_history=True)) == [0, 1]
    with BufferedWriter(store, rows=3) as w:
        w.put("root", root(spark, [(5, "u", "v"), (6, "u", "v")]))
        w.put("root", root(spark, [(7, "u", "v")]))
        w.flush(120)
        assert w.written == {"root": 3}
        w.put("root", spark.range(1))
        with pytest.raises(RuntimeError):
            w.flush(120)
    assert ids(store.read("root")) == [0, 1, 5, 6, 7]


def test_all_optional_and_id_kinds(spark, tmp_path):
    g = FeatureGraph([feature("p", "id", ["a"]), feature("q", "id", ["a"]), feature("c", "id", ["a"], [FeatureDep.of("p", optional=True), FeatureDep.of("q", optional=True)])])
    s = Store(spark, f"file://{tmp_path}/o", g)
    mk = lambda xs: with_versions(spark.createDataFrame([(x,) for x in xs], "id string"), {"a": ["id"]})
    with s.open("w"):
        s.write_many({"p": mk("ab"), "q": mk("bc")})
    assert sorted(r["id"] for r in s.resolve_update("c").new.collect()) == ["a", "b", "c"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "feats_for_cli.py").write_text("from provlake import feature\nFEATURES = [feature('root', 'id', ['a', 'b']), feature('leaf', 'id', ['a'], ['root'])]\n")
    (tmp_path / "p.toml").write_text(f"project = 'default'\nentrypoints = ['feats_for_cli']\n[stores.dev]\npath = 'file://{tmp_path}/s'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    run = lambda *a: main(["--config", str(tmp_path / "p.toml"), *a], spark)
    assert run("features") == 0 and json.loads(capsys.readouterr().out) == ["root", "leaf"]
    assert run("push") == 0 and run("history") == 0 and run("graph-diff") == 0
    capsys.readouterr()
    assert run("graph") == 0 and "root --> leaf" in capsys.readouterr().out
    s = Store(spark, f"file://{tmp_path}/s", graph())
    with s.open("w"):
        s.write("root", root(spark, [(1, "u", "v")]))
    capsys.readouterr()
    assert run("show", "root", "--filter", "id = 1", "--sort", "id") == 0 and json.loads(capsys.readouterr().out)[0]["x"] == "u"
    tools = Tools(Config.load(str(tmp_path / "p.toml")), spark)
    assert tools.list_features() == ["leaf", "root"] and tools.get_store()["features"] == ["root"] and tools.get_feature("leaf")["parents"] == ["root"]
    assert tools.list_stores() == ["dev"] and tools.get_config()["project"] == "default"
    assert run("status", "--assert-in-sync", "--progress") == 1
    assert run("delete", "root", "--filter", "id = 1") == 0 and s.read("root").count() == 0
