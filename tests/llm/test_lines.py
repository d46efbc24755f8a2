import random

import numpy as np
from provlake.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (c != d))
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(len(s) + 1)
        what = r.random()
        if what < 0.4 and s:
            s[k % len(s)] = r.choice("abcdé")
        elif what < 0.7:
            s.insert(k, r.choice("abcdé"))
        elif s:
            del s[k % len(s)]
    return "".join(s)


def test_banded_distance_equals_brute_force():
    r = random.Random(1)
    for k in (1, 2, 3):
        a = ["".join(r.choice("abcdé") for _ in range(r.randint(0, 60))) for _ in range(400)]
        b = [edited(r, x, r.randint(0, k + 2)) for x in a]
        units = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in x] for x in (a, b)]
        got = lines.bounded_distances(*units, k)
        assert got.tolist() == [min(distance(x, y), k + 1) for x, y in zip(a, b)]


def brute(rows, edits, min_chars):
    occ = sorted({(d, i, x.strip("\t\n\x0b\x0c\r \xa0")) for d, t in rows if d is not None and t for i, x in enumerate(t.split("\n")) if len(x.strip("\t\n\x0b\x0c\r \xa0")) >= min_chars})
    first = {}
    for d, i, x in occ:
        first.setdefault(x, (d, i))
    out = [(d, i, *first[x], 0) for d, i, x in occ if first[x] != (d, i)]
    for x, at in first.items():
        m = [(*o, distance(x, y)) for y, o in first.items() if o < at and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits]
        if m:
            out.append((*at, *min(m)))
    return sorted(set(out))


def test_join_equals_brute_force(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abc dé") for _ in range(r.randint(20, 50))) for _ in range(25)]
    rows = []
    for d in range(60):
        rows.append((d, "\n".join(edited(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randint(0, 5)))))
    rows += [(None, base[0]), (61, None), (62, ""), (63, "x" * 1500 + base[1]), (64, "x" * 1500 + base[1] + "!"), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, line string, key int")
    for k in (1, 2):
        got = sorted(tuple(x) for x in lines.repeated_lines(df, edits=k, min_chars=20).collect())
        assert got == brute(rows, k, 20)


def test_empty_and_removal(spark):
    df = spark.createDataFrame([], "doc_id long, text string, gone int")
    assert lines.repeated_lines(df).count() == 0
    assert lines.without_repeats(df).count() == 0
    long = "a line that is long enough to count"
    df = spark.createDataFrame([(1, long + "\nshort", 1), (2, long, 2), (3, "own\n" + long + ".", 3), (4, "", 4), (None, long, 5), (5, None, 6)], "doc_id long, text string, gone int")
    got = {x["gone"]: x["text"] for x in lines.without_repeats(df).collect()}
    assert got == {1: long + "\nshort", 3: "own", 4: "", 5: long, 6: None}


def test_short_lines_repeat_when_equal(spark):
    short = "All rights reserved."
    rows = [(1, short + "\nIn in oredble ea.\n}"), (2, "own line\n" + short), (3, "In in oredble ea.\n}\n \nIn in oredble eb."), (4, "all rights reserved."), (5, "} \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in lines.repeated_lines(df).collect())
    assert got == [(2, 1, 1, 0, 0), (3, 0, 1, 1, 0), (3, 1, 1, 2, 0), (4, 0, 1, 0, 1), (5, 0, 1, 2, 0)]
    left = {x["doc_id"]: x["text"] for x in lines.without_repeats(df).collect()}
    assert left == {1: rows[0][1], 2: "own line", 3: " \nIn in oredble eb."}


def test_texts_that_share_an_id(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abc dé") for _ in range(r.randint(20, 40))) for _ in range(12)]
    rows = [(r.randrange(12), "\n".join(edited(r, r.choice(base), r.choice([0, 1, 2])) for _ in range(r.randint(1, 4)))) for _ in range(40)]
    rows += [rows[0], (None, base[0]), (1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in lines.repeated_lines(df, edits=2, min_chars=20).collect())
    want = brute(rows, 2, 20)
    assert got == want
    gone = {(d, n, m) for d, n, m, *_ in want}
    left = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["text"] or "") for x in lines.without_repeats(df, edits=2, min_chars=20).collect())
    first = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None and t):
        for i, x in enumerate(t.split("\n")):
            x = x.strip("\t\n\x0b\x0c\r \xa0")
            first[x] = min(first.get(x, (d, i)), (d, i))
    near = {(x, *o) for x, o in first.items() for y, p in first.items() if p < o and min(len(x), len(y)) >= 20 and distance(x, y) <= 2}
    expect = []
    for d, t in rows:
        if d is None or not t:
            expect.append((-1 if d is None else d, t or ""))
            continue
        keep = []
        for i, x in enumerate(t.split("\n")):
            y = x.strip("\t\n\x0b\x0c\r \xa0")
            if len(y) < 20 or (first[y] == (d, i) and (y, d, i) not in near):
                keep.append(x)
        if "\n".join(keep).strip():
            expect.append((d, "\n".join(keep)))
    assert left == sorted(expect) and gone


def test_keys_that_many_lines_share(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, f"posted by user {r.randrange(10**6):06d} on the board of the town") for i in range(150)]
    rows += [(200 + i, edited(r, rows[i * 3][1], 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2, 20)
    assert sorted(tuple(x) for x in lines.repeated_lines(df).collect()) == want and len(want) >= 30
    monkeypatch.setattr(lines, "HOT", 4)
    monkeypatch.setattr(lines, "CELL", 20)
    assert sorted(tuple(x) for x in lines.repeated_lines(df).collect()) == want
    monkeypatch.setattr(lines, "CELL", 1000)
    assert sorted(tuple(x) for x in lines.repeated_lines(df).collect()) == want


def test_an_edit_flips_at_most_four_bits():
    r = random.Random(8)
    for _ in range(300):
        a = "".join(r.choice("abcdé ") for _ in range(r.randint(20, 60)))
        b = edited(r, a, 2)
        x, y = (np.array(lines.bigram_sketch(t), np.int64).view(np.uint64) for t in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= 8
