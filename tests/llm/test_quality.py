import random

import zstandard
from provlake.llm import quality


def prose(r, n):
    v = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return " ".join(r.choice(v) for _ in range(n))


def test_bands_and_cases(spark):
    r = random.Random(0)
    noise = "".join(chr(r.randrange(33, 126)) for _ in range(6000))
    rows = [(1, prose(r, 50)), (2, prose(r, 3000)), (3, "buy now " * 800), (4, noise), (5, None), (6, ""), (7, "short"), (None, prose(r, 60)), (3, "buy now " * 800), (8, prose(r, 300) + "na " * 6000), (9, prose(r, 200_000))]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, ratio int, keep string")
    comp = zstandard.ZstdCompressor(level=quality.LEVEL)
    size = lambda b: len(comp.compress(b))
    got = [tuple(x) for x in quality.compression_bands(df).collect()]
    assert len(got) == len(rows)
    for (d, t), g in zip(rows, got):
        assert g[0] == d and g[1:] == quality.judge(None if t is None else t.encode(), size)
    reason = {g[0]: g[7] for g in got}
    assert reason == {1: None, 2: None, 3: "repetitive", 4: "incompressible", 5: "null", 6: "empty", 7: None, None: None, 8: "repetitive", 9: None}
    kept = quality.kept(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 2, 7, 9]
    assert quality.compression_bands(df.limit(0)).count() == 0 and quality.kept(df.limit(0)).count() == 0


def test_chunks_of_a_mixed_text():
    r = random.Random(1)
    comp = zstandard.ZstdCompressor(level=3)
    size = lambda b: len(comp.compress(b))
    noise = bytes(r.randrange(33, 126) for _ in range(4096 * 2))
    raw = prose(r, 30000).encode()[: 4096 * 3] + noise
    n, ratio, low, high, bad, keep, why = quality.judge(raw, size)
    assert (n, keep, why) == (len(raw), False, "bad_chunks") and bad == 0.4 and low == 4096 / size(noise[:4096])
    assert ratio == n / size(raw)
