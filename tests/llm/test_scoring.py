import random

import numpy as np
import pyarrow as pa
from provlake.llm import scoring


def phrases(r, n):
    """Text in which each word is fixed by its neighbours."""
    tail = [["red", "apples", "fall", "softly"], ["old", "rivers", "bend", "slowly"], ["cold", "winds", "blow", "hard"]]
    return " ".join(w for _ in range(n) for w in r.choice(tail))


def test_gradient_equals_differences():
    r = np.random.default_rng(0)
    per = r.integers(0, 50, scoring.CODES)
    y = r.integers(0, scoring.CODES, 40)
    x = scoring.contexts(y, np.array([0, 25, 40]))
    assert (x[0][:2] == scoring.CODES).all() and x[0][25] == scoring.CODES and x[2][24] == scoring.CODES + 2 * (scoring.CODES + 1)
    before = scoring.Window.fresh(per).astype(np.float64)
    w = scoring.Window(before.copy())
    w.seen[:] = 1e12  # so that a step is the gradient, scaled
    w.step(x, y, 1e6)
    grad = before - w.flat
    at = np.concatenate((np.flatnonzero(np.abs(grad) > 1e-7)[::97], [len(before) - 5]))
    for i in at:
        up, down = before.copy(), before.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        d = (scoring.Window(down).forward(x, y)[3].mean() - scoring.Window(up).forward(x, y)[3].mean()) / 2e-4
        assert abs(d - grad[i]) < 1e-5 + 0.02 * abs(d)


def test_probabilities_add_up():
    r = np.random.default_rng(1)
    w = scoring.Window(scoring.Window.fresh(r.integers(0, 9, scoring.CODES)))
    x = np.repeat(scoring.contexts(np.array([5, 9, 700]), np.array([0, 3]))[:, 1:2], scoring.CODES, 1)
    assert abs(np.exp(w.forward(x, np.arange(scoring.CODES))[3].astype(float)).sum() - 1) < 1e-4


def test_held_out_order_and_cases(spark):
    r = random.Random(0)
    texts = [phrases(r, 60) for _ in range(120)]
    good = phrases(random.Random(99), 60)
    bad = good.split()
    random.Random(1).shuffle(bad)
    rows = [(i, t, 0, 0) for i, t in enumerate(texts)] + [(500, good, 0, 0), (501, " ".join(bad), 0, 0), (502, None, 0, 0), (503, "", 0, 0), (None, good, 0, 0), (504, "red", 0, 0), (500, good, 0, 0), (505, good + " apples" * 70000, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int, n int")
    got = [tuple(x) for x in scoring.pseudo_likelihood(df, epochs=2).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[500][3] > by[501][3] + 1
    base = np.log(12)  # the words alone
    assert by[500][3] > -0.6 * base
    assert by[502][1:] == (0, 0.0, None) and by[503][1:] == (0, 0.0, None)
    same = [g[2] for g in got if g[0] in (None, 500)]
    assert len(same) == 3 and max(same) - min(same) < 1e-4
    assert by[505][1] == 240 + 70000 and abs(by[500][2] / 240 - by[500][3]) < 1e-9
    again = {x[0]: tuple(x) for x in scoring.pseudo_likelihood(df, epochs=2).collect()}
    assert all(abs(again[k][2] - by[k][2]) < 1e-3 for k in by)
    assert scoring.pseudo_likelihood(df.limit(0)).count() == 0


def test_words_of_a_code_have_their_own_probabilities(spark):
    rows = [(f"w{i}", 1 + i % 7) for i in range(4000)]
    df = spark.createDataFrame([(i, w) for i, (w, n) in enumerate(rows) for _ in range(n)], "doc_id long, text string")
    got = {x["doc_id"]: x["pseudo_log_likelihood"] for x in scoring.pseudo_likelihood(df, epochs=1).collect()}
    assert 0.9 < sum(np.exp(x) for x in got.values()) < 1 + 1e-3  # one context: the words' probabilities add up
    known, rank, per = scoring.vocabulary(scoring.word_counts(df))
    code = scoring.codes_of(scoring.word_hashes(pa.array([w for w, _ in rows]))[0], known, rank, len(per))
    mates = np.flatnonzero(code == code[next(i for i in range(4000) if code[i] >= len(known))])
    assert len(mates) > 3
    for i in mates:
        assert abs(got[i] - got[mates[0]] - np.log(rows[i][1] / rows[mates[0]][1])) < 1e-5


def test_vocabulary_grows_with_the_counts(spark):
    for words in (3000, 6000):
        counts = spark.range(words).selectExpr("xxhash64(id) AS word", "20 - id % 2 * 15 AS n")
        known, _, per = scoring.vocabulary(counts, 5, 20)
        assert len(known) == words // 2 and len(per) >= len(known) + scoring.SHARED and per.sum() == words * 12.5
    w = scoring.Window(scoring.Window.fresh(per), len(per))
    x = np.repeat(scoring.contexts(np.array([5, 9, 700]), np.array([0, 3]), len(per))[:, 1:2], len(per), 1)
    assert w.digits == 3 and abs(np.exp(w.forward(x, np.arange(len(per)))[3].astype(float)).sum() - 1) < 1e-3


def test_scores_equal_brute_force_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD_WORDS", 500)
    r = random.Random(5)
    rows = [(i % 80 if i else None, phrases(r, r.randrange(12)) + " ".join(f" rare{r.randrange(3000)}" for _ in range(r.randrange(9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_tokens"], round(x["pseudo_log_likelihood"], 7)) for x in scoring.pseudo_likelihood(df.repartition(n)).collect()) for n in (1, 6))
    assert a == b
    counts, known, rank, per, flat = scoring.trained(df.select("doc_id", "text"))
    often = {x["word"] & (2**64 - 1): x["n"] for x in counts.collect()}
    w, codes, side = scoring.Window(flat, len(per)), len(per), scoring.SIDE
    want = []
    for d, t in rows:
        h = scoring.word_hashes(pa.array([t]))[0]
        code = scoring.codes_of(h, known, rank, codes).tolist()
        total = 0.0
        for i, c in enumerate(code):
            hidden = w.of["b"].astype(float)
            for p, shift in enumerate([*range(-side, 0), *range(1, side + 1)]):
                near = code[i + shift] if 0 <= i + shift < len(code) else codes
                hidden = hidden + w.of["e"][near + p * (codes + 1)]
            hidden = np.tanh(hidden)
            before = 0
            for k in range(w.digits):
                digit = c // scoring.DIGIT ** (w.digits - 1 - k) % scoring.DIGIT
                z = hidden @ w.of[f"w{k}"] + w.of[f"c{k}"][before]
                total += z[digit] - np.log(np.exp(z).sum())
                before = before * scoring.DIGIT + digit
            total += np.log(often[int(h[i])] / per[c])
        want.append((-1 if d is None else d, len(code), total))
    for x, y in zip(a, sorted(want, key=lambda v: (v[0], v[1], round(v[2], 3)))):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 * (1 + x[1])
