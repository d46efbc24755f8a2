import random

import numpy as np
import pyarrow as pa
from provlake.llm import simhash


def fingerprint(text):
    """Votes one by one."""
    import math

    from provlake.llm.common import distinct_shingles

    h, tf, _ = distinct_shingles(pa.array([text]), simhash.SHINGLE)
    out = 0
    for b in range(64):
        if sum((1 + math.log(t)) * (1 if int(x) >> b & 1 else -1) for x, t in zip(h, tf)) > 1e-4:
            out |= 1 << b
    return out


def texts(r):
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(r.randint(20, 200))) for _ in range(40)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(r.choice([0, 1, 3])):
            w = b.split()
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = f"z{r.randrange(999)}"
            out.append(" ".join(w))
    return out


def test_votes():
    r = random.Random(0)
    some = texts(r)[:12]
    fp, ok = simhash.simhash_rows(pa.array([*some, None, "", "..."]))
    assert ok.tolist() == [True] * 12 + [False] * 3
    assert [int(x) & (1 << 64) - 1 for x in fp[:12]] == [fingerprint(t) for t in some]


def test_tables_cover_the_radius():
    for blocks, radius in ((6, 3), (4, 1), (5, 4)):
        masks = simhash.block_masks(blocks, radius)
        r = random.Random(1)
        for _ in range(300):
            d = sum(1 << b for b in r.sample(range(64), radius))
            assert any(d & m == 0 for m in masks)


def test_pairs_equal_brute_force(spark):
    r = random.Random(2)
    rows = list(enumerate(texts(r)))
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (5, rows[5][1]), (902, None), (903, ""), (None, rows[0][1]), (904, "many " * 50000)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, key int, fingerprint int")
    for radius, blocks in ((3, 6), (8, 12)):
        fp = {x["doc_id"]: x["fingerprint"] for x in simhash.fingerprints(df).where("doc_id IS NOT NULL AND fingerprint IS NOT NULL").collect()}
        rep = {}
        for d in sorted(fp):
            rep.setdefault(fp[d], d)
        want = {(d, rep[f], 0) for d, f in fp.items() if rep[f] != d}
        for f, d in rep.items():
            for g, e in rep.items():
                n = int(np.bitwise_count(np.uint64((f ^ g) & (1 << 64) - 1)))
                if d > e and n <= radius:
                    want.add((d, e, n))
        got = [(x[0], x[1], x[2]) for x in simhash.near_fingerprints(df, radius=radius, blocks=blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert simhash.near_fingerprints(df.limit(0)).count() == 0


def test_flips_cover_the_radius():
    for blocks, radius in ((3, 8), (simhash.BLOCKS, simhash.RADIUS), (2, 7), (4, 4)):
        tables = simhash.block_flips(blocks, radius)
        r = random.Random(3)
        for _ in range(300):
            d = sum(1 << b for b in r.sample(range(64), radius))
            assert any((d & m) ^ f in flips for m, *flips in tables for f in flips)


def test_near_copies_are_found_by_default(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        w = [f"w{r.randrange(4000)}" for _ in range(100)]
        rows.append((2 * i, " ".join(w)))
        for k in (10, 40, 60, 90):  # bigram Jaccard of 0.85
            w[k] = f"z{r.randrange(9999)}"
        rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {d: simhash.simhash_rows(pa.array([t]))[0].view(np.uint64)[0] for d, t in rows}
    want = {(d, e) for d in fp for e in fp if d > e and np.bitwise_count(fp[d] ^ fp[e]) <= 8}
    got = [(x[0], x[1]) for x in simhash.near_fingerprints(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum((2 * i + 1, 2 * i) in want for i in range(60)) > 48


def test_keys_are_not_broadcast(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randrange(4000)}" for _ in range(8))) for i in range(2000)], "doc_id long, text string")
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "4m")  # 2000 fingerprints fit it, their 67 keys each don't
    try:
        assert simhash.near_fingerprints(df).count() >= 0
    finally:
        spark.conf.set(key, before)


def test_ties_are_ties():
    r = random.Random(6)
    some = [" ".join(f"w{r.randrange(9)}" for _ in range(r.randint(4, 40))) for _ in range(2000)]
    from provlake.llm.common import distinct_shingles

    h, tf, off = distinct_shingles(pa.array(some), simhash.SHINGLE)
    weight = [round((1 + np.log(t)) * (1 << 20)) for t in tf]
    want = []
    for i in range(len(some)):
        own = range(off[i], off[i + 1])
        want.append(sum(1 << b for b in range(64) if sum(weight[k] * (1 if int(h[k]) >> b & 1 else -1) for k in own) > 0))
    assert [int(x) & (1 << 64) - 1 for x in simhash.simhash_rows(pa.array(some))[0]] == want


def test_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VOTES", 7)
    r = random.Random(7)
    rows = list(enumerate(texts(r)))
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (5, rows[5][1]), (902, None), (903, ""), (None, rows[0][1]), (6, rows[9][1]), (6, rows[5][1] + " more"), (7, rows[7][1] + " more")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, class_id int, fingerprint int")
    nodes = {}
    for d, t in rows:
        if d is not None and t:
            nodes.setdefault(int(simhash.simhash_rows(pa.array([t]))[0][0]), set()).add(d)
    for radius, blocks in ((8, 3), (14, 4)):
        near = {f: [g for g in nodes if g != f and int(np.bitwise_count(np.uint64((f ^ g) & (1 << 64) - 1))) <= radius] for f in nodes}
        root = {}
        for f in nodes:
            seen, todo = {f}, [f]
            while todo:
                for g in near[todo.pop()]:
                    if g not in seen:
                        seen.add(g)
                        todo.append(g)
            root[f] = min(d for g in seen for d in nodes[g])
        want = sorted((d, root[f], len(near[f]), len(nodes[f]), d == root[f], f) for f in nodes for d in nodes[f])
        assert sorted(tuple(x) for x in simhash.near_documents(df, radius=radius, blocks=blocks).collect()) == want
        pairs = sorted((*sorted((min(nodes[f]), min(nodes[g])), reverse=True), 1) for f in nodes for g in near[f] if f > g)
        got = simhash.near_fingerprints(df, radius=radius, blocks=blocks).where("distance > 0").collect()
        assert sorted((x[0], x[1], 1) for x in got) == pairs
    assert any(x[2] > 1 for x in want) and (7, 7, 1) in pairs
    assert simhash.near_documents(df.limit(0)).count() == 0


def test_query_has_a_row_a_document(spark, tmp_path):
    from provlake.llm.queries import QUERIES

    r = random.Random(8)
    base = [f"w{r.randrange(4000)}" for _ in range(300)]
    rows = [(i, " ".join([*base[:i], f"z{i}", *base[i + 1 :]])) for i in range(80)]  # versions, nearly all of them linked
    spark.createDataFrame([*rows, (80, rows[0][1]), (81, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_document_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(81))
    assert sum(x["n_links"] for x in got) > 81 * 20


def test_summed_links_go_out_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{(i // 4) * 50 + k}" for k in range(40)) + f" z{i}") for i in range(80)], "doc_id long, text string")
    want = sorted(tuple(x) for x in simhash.near_documents(df).collect())
    monkeypatch.setattr(simhash, "HELD", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(tuple(x) for x in simhash.near_documents(df).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
