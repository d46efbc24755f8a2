import os
import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from provlake.llm import quality, secrets


def _docs():
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuw") for _ in range(r.randint(2, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    rows = [(i, text(8), "en", "src0") for i in range(30)]
    rows += [(100, rows[3][1], "en", "src1"), (101, rows[4][1].replace("a", "e", 1), "en", "src1")]
    rows += [(102, "spam spam " * 500, "en", "src1"), (103, None, "en", "src1"), (104, "", None, None), (105, text(3) + "\napi_key = '9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08'", "en", "src2")]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = _docs()
    sf = str(tmp_path)
    t = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": [r[2] for r in rows], "source": [r[3] for r in rows], "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(t, os.path.join(sf, "documents.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(out := f"{sf}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(out)
        seen.append({x["doc_id"]: x for x in docs.collect()})
        if name != "packing":
            assert docs.columns == columns
    good, lined, one, masked, packed = seen
    comp = __import__("zstandard").ZstdCompressor(level=quality.LEVEL)
    assert set(good) == {r[0] for r in rows if quality.judge(None if r[1] is None else r[1].encode(), lambda b: len(comp.compress(b)))[5]}
    assert {102, 103, 104}.isdisjoint(good) and set(range(30)) <= set(good)
    assert 100 not in lined and lined[3]["text"] == good[3]["text"] and set(range(30)) <= set(lined)
    assert 101 not in one and set(range(30)) <= set(one)
    assert "9f86d081" not in masked[105]["text"] and "[SECRET:" in masked[105]["text"]
    assert all(masked[d]["text"] == one[d]["text"] for d in one if not secrets.scan_text(one[d]["text"].encode()))
    assert set(packed) == {d for d in masked if masked[d]["text"]}
    again = {(x["doc_id"], x["piece"]): x["pack_id"] for x in corpus_pipeline.run(spark, sf).collect()}
    assert {k[0] for k in again} == set(packed)


def test_empty(spark, tmp_path):
    t = pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())})
    pq.write_table(t, os.path.join(tmp_path, "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = _docs()
    text = {r[0]: r[1] for r in rows}
    other = text[5][::-1]
    rows = [(r[0], r[1], "x", 1, 2, "g") for r in rows]
    rows += [(None, text[7], "x", 1, 2, "g"), (None, None, "x", 1, 2, "g"), (9, text[9], "x", 1, 2, "g"), (10, other, "x", 1, 2, "g")]
    long = "\n".join(f"{random.Random(i).getrandbits(60):x} line {i} of a long text" for i in range(4000))
    rows += [(300, long, "x", 1, 2, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, key int, row long, part string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert (None, text[7]) in left and left.count((9, text[9])) == 2 and (10, other) in left and (10, text[10]) in left
    assert any(d == 300 and len(t) > 0.9 * len(long) for d, t in left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {x["doc_id"] for x in packed} == {d for d, t in left if t}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
