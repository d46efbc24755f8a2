import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from provlake.llm import pieces
from provlake.llm.tokens import PIECES, TOKENIZERS

P = pieces.load(TOKENIZERS, PIECES)


def round_trip(texts, seed=0):
    ids, off = pieces.sample(P, pa.array(texts, pa.string()), np.arange(len(texts)).astype(np.uint64), seed)
    raw, heads = pieces.decode_bytes(P, ids, off)
    data = raw.tobytes()
    return [data[a:b].decode() for a, b in zip(heads, heads[1:])], ids, off


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab the\n\t ▁éß字🙂 0")) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5), st.integers(-5, 5))
def test_lossless(texts, seed):
    assert round_trip(texts, seed)[0] == texts


def test_draws_follow_the_weights():
    """Chi-squared against all segmentations of a word, by brute force."""
    word = "▁there"
    by_text = {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{PIECES}")
    for i in range(259, sp.get_piece_size()):
        by_text[sp.id_to_piece(i)] = i

    def all_ways(s):
        if not s:
            return [()]
        return [(by_text[s[:k]], *rest) for k in range(1, len(s) + 1) if s[:k] in by_text for rest in all_ways(s[k:])]

    ways = all_ways(word)
    w = {x: math.exp(sum(P.weight[list(x)])) for x in ways}
    total = sum(w.values())
    n = 40000
    ids, off = pieces.sample(P, pa.array(["there"] * n), np.arange(n).astype(np.uint64), 7)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(off, off[1:]))
    assert set(got) <= set(ways)
    for x in ways:
        p = w[x] / total
        assert abs(got[x] - n * p) < 5 * math.sqrt(n * p) + 5


def test_same_row_same_draw_whatever_the_batch():
    r = random.Random(0)
    texts = [" ".join(r.choice(["hello", "world's", "naïve", "x" * 50, "\n"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    _, ids, off = round_trip(texts)
    for i in range(0, 60, 7):
        one, o = pieces.sample(P, pa.array(texts[i : i + 1]), np.array([i], np.uint64), 0)
        assert one.tolist() == ids[off[i] : off[i + 1]].tolist()
    _, other, _ = round_trip(texts, 1)
    assert other.tolist() != ids.tolist()


def test_query_and_cases(spark):
    rows = [(1, "one two", 0), (2, None, 0), (3, "", 0), (None, "no id", 0), (1, "one two", 0), (4, "long " * 50000 + "y" * 30000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    out = pieces.sampled_pieces(df)
    got = [tuple(x) for x in out.collect()]
    assert got[0] == got[4] and got[1] == (2, None, None) and got[2] == (3, 0, [])
    assert Counter(tuple(x) for x in pieces.decoded_pieces(out).collect()) == Counter(r[:2] for r in rows)
    assert pieces.sampled_pieces(df.limit(0)).count() == 0
