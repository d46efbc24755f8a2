import pytest
from hypothesis import given
from hypothesis import strategies as st
from provlake.diff import compare, field_edges, mermaid, tree
from provlake.graph import FeatureGraph, MissingFeature
from provlake.model import ALL, FeatureDep, FeatureKey, FieldDep, FieldKey, FieldsMapping, Lineage, feature, same_hash
from provlake.project import lock, read_lock, write_lock

part = st.from_regex(r"[a-z0-9](-?[a-z0-9]){0,8}", fullmatch=True)


@given(st.lists(part, min_size=1, max_size=4))
def test_keys_round_trip(parts):
    k = FeatureKey.of(parts)
    assert FeatureKey.of(str(k)) == k == FeatureKey.of(k)
    assert k.table.split("__") == [p.replace("-", "_") for p in parts]


@pytest.mark.parametrize("bad", ["", "a//b", "a__b", "a b", ["x/y"], "é"])
def test_bad_keys(bad):
    with pytest.raises(ValueError):
        FeatureKey.of(bad)


def diamond(**kw):
    return FeatureGraph([feature("root", "id", [{"key": "value", "code_version": kw.get("v", "1")}, "other"]), feature("a", "id", ["value"], ["root"]), feature("b", "id", ["other"], ["root"]), feature("leaf", "id", ["x"], ["a", "b"])])


def test_versions_follow_only_what_they_depend_on():
    one, two = diamond(), diamond(v="2")
    assert one.field_version("b", "other") == two.field_version("b", "other")
    assert one.feature_version("a") != two.feature_version("a")
    assert one.feature_version("leaf") != two.feature_version("leaf")
    d = compare(one, two)
    assert [c.key for c in d.changed] == ["a", "leaf", "root"] and d.unchanged == ("b",)
    assert [f.field for f in d.changed[2].fields] == ["value"]


def test_walks():
    g = diamond()
    assert list(map(str, g.sorted())) == ["root", "a", "b", "leaf"]
    assert list(map(str, g.sorted(descending=True))) == ["leaf", "b", "a", "root"]
    assert list(map(str, g.downstream("root"))) == ["a", "b", "leaf"] and list(map(str, g.upstream("leaf", levels=1))) == ["a", "b"]
    assert list(map(str, g.roots())) == ["root"]
    assert ("root.value", "a.value") in field_edges(g)
    assert "root --> a" in mermaid(g) and tree(g, "leaf").splitlines()[0] == "leaf"
    assert sorted(map(str, g.subgraph("a", up=1).definitions)) == ["a", "root"]


def test_cycle_and_missing():
    g = FeatureGraph([feature("a", "id", deps=["b"]), feature("b", "id", deps=["a"])])
    with pytest.raises(ValueError, match="cycle"):
        g.sorted()
    with pytest.raises(MissingFeature):
        FeatureGraph([feature("a", "id", deps=["b"])]).plan("a")
    with pytest.raises(ValueError, match="registered"):
        diamond().add(feature("root", "other"))


def test_mappings():
    there = [FieldKey.of(x) for x in ("audio/french", "audio/english", "video")]
    f = FieldKey.of("french")
    assert FieldsMapping.default().parents(f, there) == set(there)
    assert FieldsMapping.default(suffix=True).parents(f, there) == {there[0]}
    assert FieldsMapping.default(exclude=["video"]).parents(FieldKey.of("video"), there) == set(there[:2])
    assert FieldsMapping.none().parents(f, there) == set()
    assert FieldsMapping.specific({"french": ["video"]}).parents(f, there) == {there[2]}


def test_explicit_and_all_field_deps():
    g = FeatureGraph([feature("p", "id", ["a", "b"]), feature("c", "id", [{"key": "x", "deps": [FieldDep.of("p", ["b"])]}, {"key": "y", "deps": ALL}], ["p"])])
    assert [str(n) for _, n in g.plan("c").parents(FieldKey.of("x"))] == ["b"]
    assert [str(n) for _, n in g.plan("c").parents(FieldKey.of("y"))] == ["a", "b"]


def test_input_ids():
    g = FeatureGraph([feature("r", ["s", "t"]), feature("q", "s"), feature("d", "s", deps=[FeatureDep.of("r", lineage=Lineage.aggregation(["s"])), "q"])])
    assert g.plan("d").input_ids == ["s"]
    with pytest.raises(ValueError):
        FeatureGraph([feature("r", "x"), feature("q", "y"), feature("d", "z", deps=["r", "q"])]).plan("d").join_ids


def test_collisions_are_refused():
    with pytest.raises(ValueError):
        feature("a", "id", ["x/y", "x_y"])
    with pytest.raises(ValueError):
        FeatureGraph([feature("a-b", "id"), feature("a_b", "id")])
    with pytest.raises(ValueError):
        FeatureDep.of("a", rename={"old": "new"}, select=["old"])
    with pytest.raises(ValueError):
        FeatureGraph([feature("p", "id"), feature("c", "id", deps=[FeatureDep.of("p", rename={"x": "lake_provenance"})])]).plan("c").check()


def test_snapshot_and_hash_length():
    g = diamond()
    back = FeatureGraph.from_snapshot(g.snapshot())
    assert back.project_version() == g.project_version() and back.snapshot() == g.snapshot()
    long = FeatureGraph([d.spec for d in g.definitions.values()], hash_chars=16)
    assert same_hash(g.field_version("root", "value"), long.field_version("root", "value"))
    assert not same_hash("12345678", "1234567890"[::-1]) and FeatureGraph().project_version() == "empty"


def test_lock(tmp_path):
    from dataclasses import replace

    g = diamond()
    ext = FeatureGraph(project="mine")
    for k in g.sorted():
        ext.add(replace(g.definitions[k], external=True, project="theirs"))
    path = str(tmp_path / "x.lock")
    assert write_lock(ext, path) and not write_lock(ext, path)
    other = FeatureGraph(project="mine")
    read_lock(other, path)
    assert other.field_versions("leaf") == g.field_versions("leaf") and set(lock(other)) == set(lock(ext))
