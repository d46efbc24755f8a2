"""The operators against plain Python, and the laws of increments."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from provlake.functions import columns as C
from provlake.functions.filters import FilterError, parse
from provlake.functions.hashing import UnsupportedHash, hashed
from provlake.graph import FeatureGraph
from provlake.model import FeatureDep, Lineage, feature
from provlake.operators.dedup import keep_latest
from provlake.operators.increment import resolve, tagged
from provlake.operators.prepare import prepare
from provlake.operators.provenance import add_provenance, complete
from pyspark.sql import functions as F


def md5(*parts):
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:8]


def rows(spark, ddl, data, **by):
    df = spark.createDataFrame(data, ddl)
    return df.withColumn(C.PROV_BY_FIELD, C.by_field({k: F.col(v) for k, v in by.items()})).drop(*by.values())


def test_identity_and_optional_against_python(spark):
    g = FeatureGraph([feature("p", "id", ["a", "b"]), feature("o", "id", ["z"]), feature("c", "id", [{"key": "a", "code_version": "7"}], ["p", FeatureDep.of("o", optional=True)])])
    p = rows(spark, "id int, x string, y string", [(1, "u", "v"), (2, "w", None), (3, None, "q")], a="x", b="y")
    o = rows(spark, "id int, x string", [(1, "k")], z="x")
    plan = g.plan("c")
    out = add_provenance(prepare(plan, {s.key: df for s, df in zip(plan.parent_specs, (p, o))}), plan)
    got = {r["id"]: r for r in out.collect()}
    h = md5("a", "7", "o.z", "k", "p.a", "u")
    assert got[1][C.PROV_BY_FIELD]["a"] == h and got[1][C.PROV] == md5(h) == got[1][C.DATA]
    assert got[2][C.PROV_BY_FIELD]["a"] == md5("a", "7", "o.z", "", "p.a", "w")
    assert got[3][C.PROV] is None
    assert not [c for c in out.columns if "__" in c]


def test_aggregation_keeps_rows_and_isolates_fields(spark):
    g = FeatureGraph([feature("r", ["s", "n"], ["t", "h"]), feature("stats", "s", ["t", "h"], [FeatureDep.of("r", lineage=Lineage.aggregation(["s"]))])])
    plan = g.plan("stats")

    def run(data):
        df = rows(spark, "s string, n int, x string, y string", data, t="x", h="y")
        return add_provenance(prepare(plan, {plan.parent_specs[0].key: df}), plan).collect()

    one = run([("a", 2, "t2", "h2"), ("a", 1, "t1", "h1"), ("b", 1, "t3", "h3")])
    two = run([("a", 1, "t1", "h1"), ("a", 2, "CHANGED", "h2"), ("b", 1, "t3", "h3")])
    a1, a2 = ([r[C.PROV_BY_FIELD] for r in x if r["s"] == "a"] for x in (one, two))
    assert len(one) == 3 and len({r["t"] for r in a1}) == 1
    assert a1[0]["t"] == md5("t", "1", "r.t", md5("t1", "t2")) != a2[0]["t"] and a1[0]["h"] == a2[0]["h"]


def test_filters_see_new_names_and_collisions(spark):
    g = FeatureGraph([feature("p", "id", ["a"]), feature("q", "id", ["a"]), feature("c", "id", ["a"], [FeatureDep.of("p", rename={"w": "weight"}, filters="weight > 1"), "q"])])
    plan = g.plan("c")
    p = rows(spark, "id int, w int, x string", [(1, 1, "u"), (2, 2, "v")], a="x")
    q = rows(spark, "id int, weight int, x string", [(1, 1, "u"), (2, 2, "v")], a="x")
    with pytest.raises(ValueError, match="both bring"):
        prepare(plan, {plan.spec.deps[0].feature: p, plan.spec.deps[1].feature: q})
    assert [r["id"] for r in prepare(plan, {plan.spec.deps[0].feature: p, plan.spec.deps[1].feature: q.drop("weight")}).collect()] == [2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 12), st.sampled_from("abc"), max_size=10), st.dictionaries(st.integers(0, 12), st.sampled_from(["a", "b", None]), max_size=10))
def test_increment_laws(spark, want, have):
    ddl = f"id int, {C.PROV} string"
    e, c = spark.createDataFrame(list(want.items()), ddl), spark.createDataFrame(list(have.items()), ddl)
    inc = resolve(e, c, ["id"], stale_if=["id = 3"])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    new, stale, gone = ids(inc.new), ids(inc.stale), ids(inc.orphaned)
    assert new == sorted(set(want) - set(have)) and gone == sorted(set(have) - set(want))
    assert stale == sorted(k for k in set(want) & set(have) if have[k] is None or have[k] != want[k] or k == 3)
    by = {}
    for r in tagged(e, c, ["id"], stale_if=["id = 3"]).collect():
        by.setdefault(r["status"], []).append(r["id"])
    assert sorted(by.get("new", [])) == new and sorted(by.get("stale", [])) == stale and sorted(by.get("orphaned", [])) == gone
    again = resolve(e, e, ["id"])
    assert not ids(again.new) and not ids(again.stale) and not ids(again.orphaned)


def test_keep_latest_takes_whole_rows(spark):
    data = [("a", 1, "2024-01-01", None), ("a", 2, "2024-01-03", "x"), ("a", 3, "2024-01-02", None), (None, 4, "2024-01-01", None), (None, 5, "2024-01-02", None), ("t", 6, None, None)]
    df = spark.createDataFrame(data, "id string, v int, at string, note string")
    assert sorted(r["v"] for r in keep_latest(df, ["id"], ["at"]).collect()) == [2, 5, 6]
    tie = spark.createDataFrame([("a", i, "2024", "n") for i in range(20)], df.schema)
    assert keep_latest(tie, ["id"], ["at"]).collect() == keep_latest(tie.orderBy(F.desc("v")), ["id"], ["at"]).collect()
    assert keep_latest(df.limit(0), ["id"], ["at"]).count() == 0


def test_parser(spark):
    df = spark.createDataFrame([(1, 30, "active", True, None, "q"), (2, 17, "it's", False, "2024", "r"), (3, None, None, None, None, None)], "id int, age int, status string, ok boolean, `a.b` string, `sel ect` string")
    ids = lambda t: [r["id"] for r in df.where(parse(t)).orderBy("id").collect()]
    for text, want in {
        "age >= 18": [1], "18 < age": [1], "age = NULL": [3], "age != NULL": [1, 2], "a.b IS NULL": [1, 3], "status IS NOT NULL AND NOT ok": [2], "status = 'it''s'": [2],
        "id IN (1, 3)": [1, 3], "id NOT IN (1)": [2, 3], "ok": [1], "(ok) OR id = 3": [1, 3], "((id)) > (-1)": [1, 2, 3], "true": [1, 2, 3], "id > 1.5": [2, 3], "ok IS TRUE": [1], '"sel ect" = \'q\'': [1], "status <> 'active'": [2], "not (id = 1 or id = 2)": [3], "age IS 17": [2],
    }.items():
        assert ids(text) == want, text
    for bad in ("", "  ", "age BETWEEN 1 AND 2", "lower(status) = 'a'", "age + 1 > 2", "status LIKE 'a%'", "id IN (age)", "1 IN (1)", "age >", "'x'", "id = 1 id = 2", "(id = 1", "age < NULL", "id; drop"):
        with pytest.raises(FilterError):
            parse(bad)


def test_hashes(spark):
    import xxhash

    df = spark.createDataFrame([("abc",), (None,)], "s string")
    got = df.select(hashed(F.col("s"), "md5", None), hashed(F.col("s"), "sha256", 8), hashed(F.col("s"), "xxhash64", None), hashed(F.col("s"), "xxhash32", None), hashed(F.col("s"), "spark_xxhash64", None)).collect()
    assert tuple(got[0]) == (hashlib.md5(b"abc").hexdigest(), hashlib.sha256(b"abc").hexdigest()[:8], str(xxhash.xxh64_intdigest("abc")), str(xxhash.xxh32_intdigest("abc")), "1423657621850124518")
    assert tuple(got[1]) == (None,) * 5
    for a in ("wyhash", "farmhash", "nope"):
        with pytest.raises(UnsupportedHash):
            hashed(F.col("s"), a)


def test_complete_fills_only_what_is_missing(spark):
    df = spark.createDataFrame([(1, ("p",), ("own",)), (2, ("p",), None)], f"id int, {C.PROV_BY_FIELD} struct<f:string>, {C.DATA_BY_FIELD} struct<f:string>")
    a, b = complete(df, ["f"]).orderBy("id").collect()
    assert a[C.DATA_BY_FIELD]["f"] == "own" and a[C.DATA] == md5("own") and a[C.PROV] == md5("p")
    assert b[C.DATA_BY_FIELD]["f"] == "p" and b[C.DATA] == md5("p")
