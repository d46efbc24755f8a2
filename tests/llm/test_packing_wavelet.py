import random
from collections import Counter, defaultdict

import numpy as np
from provlake.llm import packing, wavelet
from provlake.llm.tokens import byte_bpe


def brute(lengths, context):
    """Shortest pack first, one piece at a time."""
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= context]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return packs


def test_patterns_equal_one_at_a_time():
    r = random.Random(0)
    for context in (16, 64):
        for _ in range(60):
            lengths = [min(context, int(context ** r.random()) + 1) for _ in range(r.randint(1, 300))]
            found = packing.patterns(Counter(lengths), context)
            assert Counter(x for p, c in found for x in p * c) == Counter(lengths)
            assert all(sum(p) <= context and c > 0 for p, c in found)
            packs = brute(lengths, context)
            assert sum(c for _, c in found) <= len(packs) * 1.1 + 1
            table = packing.slots(found)
            at = defaultdict(list)
            for length, n in Counter(lengths).items():
                for pack, offset in zip(*packing.placed(table, np.full(n, length), np.arange(n))):
                    at[int(pack)].append((int(offset), length))
            assert sorted(at) == list(range(sum(c for _, c in found)))
            for p in at.values():
                end = 0
                for offset, length in sorted(p):
                    assert offset == end
                    end += length
                assert end <= context


def test_packs(spark):
    r = random.Random(1)
    texts = [" ".join(f"word{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 30, 400]))) for _ in range(200)]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2), (7, texts[7], 1, 2), (901, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, bucket int")
    got = [tuple(x) for x in packing.pack_documents(df, context=128).collect()]
    enc = byte_bpe()
    want = Counter()
    for i, t, *_ in rows:
        n = len(enc.encode_ordinary(t)) + 1 if t else 0
        for p in range(0, n, 128):
            want[i, p // 128, p, min(128, n - p)] += 1
    assert Counter(g[:4] for g in got) == want
    packs = defaultdict(list)
    for g in got:
        packs[g[4]].append((g[5], g[3]))
    assert sorted(packs) == list(range(len(packs)))
    for p in packs.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 128
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packs_take_pieces_in_order_whatever_the_partitions(spark):
    r = random.Random(3)
    rows = [(i * 7 % 101, " ".join(f"word{r.randrange(99)}" for _ in range(r.choice([1, 5, 30, 400])))) for i in range(101)] + [(7, "one id " * r.randrange(1, 90)) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(tuple(x) for x in packing.pack_documents(df.repartition(n), context=128).collect()) for n in (1, 7))
    assert a == b
    enc = byte_bpe()
    cut = sorted((d, p // 128, p, min(128, n - p)) for d, t in rows for n in [len(enc.encode_ordinary(t)) + 1] for p in range(0, n, 128))
    table = packing.slots(packing.patterns(Counter(x[3] for x in cut), 128))
    rank, want = Counter(), []
    for x in cut:
        pack, offset = packing.placed(table, np.array([x[3]]), np.array([rank[x[3]]]))
        rank[x[3]] += 1
        want.append((*x, int(pack[0]), int(offset[0])))
    assert a == sorted(want)


def test_wavelet_matrix_equals_the_sequence():
    r = np.random.default_rng(0)
    for n, top in ((0, 2), (1, 1), (700, 2), (5000, 50000), (3000, 70000), (512, 300)):
        t = np.minimum(r.integers(0, top, n), r.integers(0, top, n))
        wm = wavelet.WaveletMatrix(wavelet.build(t))
        assert wm.tokens().tolist() == t.tolist()
        for token in [*t[:20].tolist(), 0, 1, 99999]:
            at = np.flatnonzero(t == token)
            assert wm.occurrences(token).tolist() == at.tolist()
            assert wm.rank(token, n // 2) == int((at < n // 2).sum())
            assert wm.count(token, n // 3, n) == int((at >= n // 3).sum())


def test_shards_round_trip(spark):
    rows = [(i, f"text number {i}, été " * (i % 7), 0) for i in range(100)] + [(None, "x", 0), (200, None, 0), (3, "again", 0), (201, "long " * 30000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload int")
    shards = wavelet.wavelet_shards(df, shard_tokens=500)
    enc = byte_bpe()
    got = []
    for s in shards.collect():
        wm = wavelet.WaveletMatrix(bytes(s["payload"]))
        all_ = wm.tokens()
        assert s["n_tokens"] == len(all_) == s["doc_offsets"][-1] and s["n_docs"] == len(s["doc_ids"])
        for d, a, b in zip(s["doc_ids"], s["doc_offsets"], s["doc_offsets"][1:]):
            got.append((d, enc.decode(all_[a:b].tolist())))
    assert Counter(got) == Counter((d, t or "") for d, t, _ in rows)
    token = enc.encode_ordinary(" number")[0]
    assert {(x["token"], x["n"]) for x in wavelet.token_counts(shards, [token]).collect()} == {(token, sum(t.count(" number") for _, t, _ in rows if t))}
    assert wavelet.token_occurrences(shards, [token]).count() == sum(t.count(" number") for _, t, _ in rows if t)
    assert wavelet.wavelet_shards(df.limit(0)).count() == 0
