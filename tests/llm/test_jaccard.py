import random
import re

import numpy as np
from provlake.llm import jaccard


def grams(text, n):
    w = re.findall(r"[0-9a-zà-ÿ]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def make(r, n):
    rows = []
    while len(rows) < n:
        base = [r.choice(["of", "the", "and"]) if r.random() < 0.3 else f"w{r.randrange(5000)}é" for _ in range(int(5 * 60 ** r.random()))]
        for _ in range(r.choice([1, 1, 2, 4, 8])):
            rows.append(" ".join(f"x{r.randrange(9999)}" if r.random() < r.choice([0, 0.01, 0.05, 0.1]) / 1.0 else w for w in base))
    return list(enumerate(rows))


def brute(rows, ngram=2, threshold=0.7):
    """Links between different sets, and (doc_id, class_id, n_links, n_equal) of each text with words."""
    sets = {(d, t): frozenset(grams(t, ngram)) for d, t in rows if d is not None and t and grams(t, ngram)}
    least = {}
    for (d, _), g in sets.items():
        least[g] = min(least.get(g, d), d)
    distinct = list(least)
    links, root = {}, {g: g for g in distinct}

    def find(g):
        while root[g] is not g:
            g = root[g]
        return g

    for i, g in enumerate(distinct):
        for o in distinct[:i]:
            j = len(g & o) / len(g | o)
            if j >= threshold:
                links[g, o] = j
                root[find(g)] = find(o)
    first = {}
    for g in distinct:
        first[find(g)] = min(first.get(find(g), least[g]), least[g])
    n = {g: sum(g in k for k in links) for g in distinct}
    same = {g: sum(x == g for x in sets.values()) for g in distinct}
    pairs = sorted((max(least[g], least[o]), min(least[g], least[o]), round(j, 9)) for (g, o), j in links.items())
    return pairs, sorted((d, first[find(g)], n[g], same[g]) for (d, _), g in sets.items())


def test_equals_brute_force(spark):
    rows = make(random.Random(3), 500)
    more = [(None, rows[0][1]), (9001, None), (9002, ""), (3, rows[3][1]), (9003, "... !"), (3, rows[10][1]), (4, rows[5][1] + " more"), (9004, "one"), (9005, "One!"), (9006, "a b c"), (9007, "a b c d e")]
    df = spark.createDataFrame([(*x, 0, 1) for x in rows + more], "doc_id long, text string, n int, key int")
    pairs, classes = brute(rows + more)
    assert sorted((x[0], x[1], round(x[2], 9)) for x in jaccard.similar_pairs(df).collect()) == pairs and len(pairs) > 100
    got = jaccard.jaccard_join(df).collect()
    assert sorted(tuple(x)[:4] for x in got) == classes
    assert all(x["is_first"] == (x["doc_id"] == x["class_id"]) for x in got)


def test_no_pair_at_the_threshold_is_missed():
    r = np.random.default_rng(1)
    missed = total = 0
    for size in [*range(2, 16), 20, 28, 41, 60, 100, 150, 200, 300, 700, 1500]:
        sets, want = [], 0
        for _ in range(max(40, min(600, 20000 // size))):
            n = size
            m = int(r.integers(n, int(n / 0.7 + 1e-9) + 1))
            c = int(np.ceil(0.7 / 1.7 * (n + m) - 1e-9))
            if c > n:
                continue
            x = r.integers(0, 1 << 62, n + m - c).astype(np.uint64)
            sets += [np.sort(x[:n]), np.sort(np.concatenate((x[:c], x[n:])))]
            want += 1
        if not want:
            continue
        off = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        row, key, tag = jaccard.part_keys(np.concatenate(sets), off, 0.7)
        order = np.lexsort((tag & 3, row, key))
        row, key, tag = row[order], key[order], tag[order]
        met = (key[1:] == key[:-1]) & (row[1:] == row[:-1] + 1) & (row[1:] % 2 == 1) & ((tag[1:] | tag[:-1]) & 1 == 1) 
        for i in range(jaccard.BEFORE):
            x, y = (t >> (2 + jaccard.BITS * i) & (1 << jaccard.BITS) - 1 for t in (tag[1:], tag[:-1]))
            met &= (x != y) | (x == 0)
        missed += want - len(np.unique(row[1:][met]))
        total += want
    assert total > 5000 and not missed, (missed, total)


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.random(len(a)) < 0.8], r.integers(0, 1 << 60, 30).astype(np.uint64))))
        s = jaccard.folded(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        assert int(np.bitwise_count(s[0] ^ s[1]).sum()) <= len(np.setxor1d(a, b))


def test_bands_hold_all_pairs():
    for t in (0.5, 0.7, 0.9, 1.0):
        e = jaccard.edges(t, 10000) if t < 1 else [*range(1, 10000)]
        for n in range(1, 3000):
            m = int(n / t + 1e-9)
            assert np.searchsorted(e, m, "right") - np.searchsorted(e, n, "right") <= 1


def test_components_and_removal(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (None, 3), (7, 7)], "doc_id long, match_id long")
    got = {x["doc_id"]: x["root"] for x in jaccard.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}
    df = spark.createDataFrame([], "doc_id long, text string, root int")
    assert jaccard.one_of_each(df).count() == 0
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, t, 1), (2, t + " more", 2), (3, "else", 3), (None, t, 4), (5, None, 5), (6, "", 6)], "doc_id long, text string, root int")
    assert {x["root"] for x in jaccard.one_of_each(df).collect()} == {1, 3, 4, 5, 6}


def test_cells_of_any_size_give_the_same(spark, monkeypatch):
    rows = make(random.Random(5), 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(x) for x in jaccard.similar_pairs(df).collect()}
    classes = {tuple(x) for x in jaccard.jaccard_join(df).collect()}
    monkeypatch.setattr(jaccard, "CELL_GRAMS", 50)
    assert {tuple(x) for x in jaccard.similar_pairs(df).collect()} == want and len(want) > 50
    monkeypatch.setattr(jaccard, "CELL_PAIRS", 3)
    assert {tuple(x) for x in jaccard.jaccard_join(df).collect()} == classes


def test_filter_passes_every_hash(spark):
    from provlake.llm.common import id_filter

    r = np.random.default_rng(2)
    ids = r.integers(-(1 << 63), (1 << 63) - 1, 3000)
    passes = id_filter(spark.createDataFrame([(int(x),) for x in ids[:1500]], "h long"), 1 << 12)()
    assert passes(ids[:1500]).all() and passes(ids[1500:]).mean() < 0.05
