import random
from collections import defaultdict

import numpy as np
import pytest
from provlake.llm import suffix
from provlake.llm.induced import induced_sort


def run_sort(t, **kw):
    parts = []
    induced_sort(t, lambda a, b: parts.append((a, b)), **kw)
    return np.concatenate([p[0] for p in parts[::-1]]), np.concatenate([p[1] for p in parts[::-1]])


@pytest.mark.parametrize("base,limit", [(1 << 20, 1 << 20), (3, 10)])
def test_induced_sort_equals_brute_force(base, limit, tmp_path):
    r = np.random.default_rng(0)
    for trial in range(80):
        t = r.integers(2, 3 + r.integers(1, 6), r.integers(1, 80))
        t[r.random(len(t)) < 0.08] = 1
        t = np.append(np.tile(t, 1 + 2 * (trial % 2)), 0).astype(np.uint16)
        cap = (250, 5)[trial % 2]
        sa, lcp = run_sort(t, cap=cap, base=base, folder=str(tmp_path), in_memory=limit)
        text = t.tolist()
        want = sorted(range(len(t)), key=lambda i: text[i:])
        assert [text[i : i + cap] for i in sa] == [text[i : i + cap] for i in want]
        for j in range(1, len(sa)):
            k = 0
            while k < cap and text[sa[j - 1] + k] == text[sa[j] + k] > 1:
                k += 1
            assert lcp[j] == k
    assert not list(tmp_path.iterdir())


def brute(rows, words):
    at = defaultdict(list)
    for d, t in rows:
        w = t.lower().split()
        for i in range(len(w) - words + 1):
            at[tuple(w[i : i + words])].append((d, i))
    return {x: min(v) for v in at.values() if len(v) > 1 for x in v}


@pytest.mark.parametrize("kw", [{}, {"shard_words": 50}, {"base": 5, "in_memory": 64}])
def test_passages_equal_brute_force(spark, kw):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    shared = [[word() for _ in range(r.randint(6, 40))] for _ in range(12)]
    rows = []
    for d in range(120):
        w = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.choice([0, 1, 2])):
            k = r.randrange(len(w) + 1)
            s = r.choice(shared)
            w[k:k] = s[r.randrange(3) : len(s) - r.randrange(3)]
        rows.append((d, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, "same " * 300)]
    more = [(None, rows[3][1]), (300, None), (301, ""), (3, rows[3][1])]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows + more], "doc_id long, text string, start int, key string")
    got = {}
    for x in suffix.repeated_passages(df, words=10, anchor=3, **kw).collect():
        for i in range(x["n_words"] - 9):
            k = (x["doc_id"], x["start_word"] + i)
            assert k not in got
            got[k] = (x["first_doc_id"], x["first_start_word"] + i)
        assert x["is_first"] == (got[x["doc_id"], x["start_word"]] == (x["doc_id"], x["start_word"]))
    assert got == brute(rows, 10)


def test_empty(spark):
    assert suffix.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
