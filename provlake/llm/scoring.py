"""LM scoring: pseudo-likelihood of a bidirectional window network that is trained in numpy.

Each word is masked in turn and predicted from the words to its left and right. Words that occur
often have codes of their own, as many as the corpus has such words; the others share SHARED codes by
hash, and a word's probability is that of its code times the word's share of the code's occurrences,
by the counts of the whole corpus. The output is a softmax digit by digit, each digit given those
before it, so that a prediction costs DIGIT logits a digit, and the probabilities of all words add up
to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, list_column, mix, slices, two, word_hashes, written

#: Codes at least.
CODES = 1024
#: So many words have codes of their own at least, and all that occur LEAST times.
FREQUENT = 768
LEAST = 1024
#: Codes that the hashes of the other words share at least.
SHARED = 256
DIGIT = 32
#: Words on each side.
SIDE = 2
WIDTH = 16
BATCH = 4096
RATE = 0.1
#: Passes over the corpus; after each, the shards' weights are averaged by their numbers of words.
EPOCHS = 1
#: Words of a shard, about, that a set of weights is trained on.
SHARD_WORDS = 1 << 20
_BLOCKS = 16


def word_counts(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(word, n): how often each word's hash occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merge():
            k = np.concatenate([p[0] for p in parts])
            u, inv = np.unique(k, return_inverse=True)
            return u, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

        def out(k, c):
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)])], names=["word", "n"])

        for b in batches:
            for part in slices(b):
                parts.append(np.unique(word_hashes(part.column(1))[0], return_counts=True))
                held += len(parts[-1][0])
                if held > most:
                    keys, counts = merge()
                    parts, held = [(keys, counts)], len(keys)
                    if held > most // 2:
                        yield from out(keys, counts)
                        parts, held = [], 0
        if parts:
            yield from out(*merge())

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codes_of(h: np.ndarray, known: np.ndarray, rank: np.ndarray, codes: int = CODES) -> np.ndarray:
    """Code of each word hash; known: sorted hashes of frequent words, rank: their codes."""
    out = (len(known) + (mix(h) % np.uint64(codes - len(known)))).astype(np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        out[hit] = rank[at[hit]]
    return out


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent words, their codes, and how often each code occurs in all.

    Frequent are the ``frequent`` most frequent words and all that occur ``least`` times.
    """
    many = max(frequent, counts.where(F.col("n") >= least).count())
    h = counts.orderBy(F.desc("n"), "word").limit(many).select("word").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    known, rank = h[order], np.arange(len(h))[order]
    codes = max(CODES, -(-(len(h) + SHARED) // DIGIT) * DIGIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(codes, np.int64)
        for b in batches:
            c = codes_of(b.column(0).to_numpy().view(np.uint64), known, rank, codes)
            total += np.bincount(c, b.column(1).to_numpy(), codes).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    per = np.zeros(codes, np.int64)
    got = counts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    per[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return known, rank, per


def prefixes(codes: int) -> list[int]:
    """How many values the digits before each digit of a code take."""
    out = [-(-codes // DIGIT)]
    while out[0] > 1:
        out.insert(0, -(-out[0] // DIGIT))
    return out


class Window:
    """The network: tanh of a sum of context embeddings by position, a softmax a digit over it."""

    @staticmethod
    def shape(codes: int) -> list[tuple[str, tuple[int, ...]]]:
        digits = list(enumerate(prefixes(codes)))
        return [("e", (2 * SIDE * (codes + 1), WIDTH)), ("b", (WIDTH,)), *((f"w{i}", (WIDTH, DIGIT)) for i, _ in digits), *((f"c{i}", (n, DIGIT)) for i, n in digits)]

    def __init__(self, flat: np.ndarray, codes: int = CODES):
        self.flat = flat
        self.seen = np.full(len(flat), 1e-6, np.float32)
        self.digits = len(prefixes(codes))
        self.of, self.sq = {}, {}
        at = 0
        for name, shape in self.shape(codes):
            n = math.prod(shape)
            self.of[name] = flat[at : at + n].reshape(shape)
            self.sq[name] = self.seen[at : at + n].reshape(shape)
            at += n

    @classmethod
    def fresh(cls, per: np.ndarray, seed: int = 0) -> np.ndarray:
        """Weights that predict each code by how often it occurs."""
        codes = len(per)
        w = cls(np.zeros(sum(math.prod(s) for _, s in cls.shape(codes)), np.float32), codes)
        r = np.random.default_rng(seed)
        for name in ("e", *(f"w{i}" for i in range(w.digits))):
            w.of[name][:] = r.normal(0, 0.1, w.of[name].shape)
        p = per + 0.5
        for i in reversed(range(w.digits)):
            p = np.append(p, np.zeros(-len(p) % DIGIT)).reshape(-1, DIGIT)
            total = p.sum(1)
            w.of[f"c{i}"][:] = np.log(np.maximum(p / total[:, None], 1e-35))  # digits that no code has
            p = total
        return w.flat

    def forward(self, x: np.ndarray, y: np.ndarray) -> tuple:
        """Hidden layer, probabilities of each digit, (digit, those before it), and log-probability of each code."""
        e = self.of["e"]
        h = e[x[0]]
        for p in range(1, len(x)):
            h += e[x[p]]
        h += self.of["b"]
        np.tanh(h, out=h)
        rows = np.arange(len(y))
        probs, places = [], []
        lp = 0
        for i in range(self.digits):
            rest = y // DIGIT ** (self.digits - 1 - i)
            before, digit = rest // DIGIT, rest % DIGIT
            z = h @ self.of[f"w{i}"] + self.of[f"c{i}"][before]
            lp = lp + z[rows, digit]
            np.exp(z, out=z)
            total = z.sum(1)
            lp -= np.log(total)
            z /= total[:, None]
            probs.append(z)
            places.append((digit, before))
        return h, probs, places, lp

    def step(self, x: np.ndarray, y: np.ndarray, rate: float = RATE) -> float:
        """One Adagrad step on a batch; its mean log-probability before."""
        n = np.float32(len(y))
        h, probs, places, lp = self.forward(x, y)
        rows = np.arange(len(y))
        g = 0
        for i, (z, (digit, _)) in enumerate(zip(probs, places, strict=True)):
            z[rows, digit] -= 1
            g = g + z @ self.of[f"w{i}"].T
        g *= 1 - h * h
        g /= n
        for i, (z, (_, before)) in enumerate(zip(probs, places, strict=True)):
            self._update(f"w{i}", h.T @ z / n, rate)
            if i:
                self._rows(f"c{i}", before, z / n, rate)
            else:
                self._update("c0", z.sum(0, keepdims=True) / n, rate)
        self._update("b", g.sum(0), rate)
        self._rows("e", x.reshape(-1), g, rate)
        return float(lp.mean())

    def _rows(self, name: str, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        """Update the rows at, of which each len(g) have the gradients g, by their sums."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        g = np.add.reduceat(g[order % len(g)], first, axis=0)
        at = at[first]
        sq = self.sq[name][at] + g * g
        self.sq[name][at] = sq
        self.of[name][at] -= rate * g / np.sqrt(sq)

    def _update(self, name: str, g: np.ndarray, rate: float) -> None:
        self.sq[name] += g * g
        w = self.of[name]
        w -= rate * g / np.sqrt(self.sq[name])


def contexts(code: np.ndarray, first: np.ndarray, codes: int = CODES) -> np.ndarray:
    """Embedding row of each neighbour, a row a position; a place outside the text is a code of its own."""
    n = len(code)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.empty((2 * SIDE, n), np.int64)
    for p, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        x = np.full(n, codes)
        if abs(shift) < n:
            a, b = (slice(-shift, n), slice(0, n + shift)) if shift < 0 else (slice(0, n - shift), slice(shift, n))
            x[a] = np.where(row[a] == row[b], code[b], codes)
        out[p] = x + p * (codes + 1)
    return out


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, text, shard), a shard in one partition and in the order of ids and texts."""
    row = F.xxhash64("text")
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", row), F.lit(shards)).cast("int").alias("shard"))
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", row)


def train(docs: DataFrame, known: np.ndarray, rank: np.ndarray, flat: np.ndarray, rate: float = RATE, codes: int = CODES, shards: int = 1) -> np.ndarray:
    """Weights after a pass over docs as sharded: each shard trains a copy on all its texts, then all are averaged.

    Batches are so many words of a shard, in its order, so the weights don't depend on how the rows are
    partitioned. Weights travel in blocks of rows, of the embeddings only those that a shard has
    changed; each block is averaged by one task, so the driver gets one set, not one a shard. There are
    as many blocks as shards, so what a task reads doesn't grow with them.
    """
    ends = 2 * SIDE * (codes + 1) * WIDTH  # of the embeddings
    edges = np.append(np.linspace(0, ends // WIDTH, max(_BLOCKS, min(shards, ends // WIDTH // 4)) + 1).astype(int) * WIDTH, len(flat))
    names = ["block", "part", "n", "at", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, shard = Window(flat.copy(), codes), 0, None
        x, y = np.zeros((2 * SIDE, 0), np.int64), np.zeros(0, np.int64)

        def step(all_: bool) -> None:
            nonlocal x, y
            at = 0
            while len(y) - at >= (1 if all_ else BATCH):
                w.step(np.ascontiguousarray(x[:, at : at + BATCH]), y[at : at + BATCH], rate)
                at += BATCH
            x, y = x[:, at:], y[at:]

        def close() -> Iterator[pa.RecordBatch]:
            step(True)
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if n else ():
                size = WIDTH if b <= ends else 1
                now = w.flat[a:b].reshape(-1, size)
                at = np.flatnonzero((now != flat[a:b].reshape(-1, size)).any(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([now[at].tobytes()], pa.binary())], names=names)

        for b in batches:
            of = b.column(2).to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
            for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                if int(of[lo]) != shard:
                    yield from close()
                    w, n, shard = Window(flat.copy(), codes), 0, int(of[lo])
                for part in slices(b.slice(lo, hi - lo)):
                    h, first = word_hashes(part.column(1))
                    code = codes_of(h, known, rank, codes)
                    x, y = np.concatenate((x, contexts(code, first, codes)), 1), np.concatenate((y, code))
                    n += len(code)
                    step(False)
        yield from close()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for k, n, at, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                a, b = edges[k], edges[k + 1]
                step = WIDTH if b <= ends else 1
                t = total.setdefault(k, [np.zeros(((b - a) // step, step)), 0])
                rows = np.frombuffer(at.as_buffer(), np.int32)
                t[0][rows] += n * (np.frombuffer(w.as_buffer(), np.float32).reshape(-1, step).astype(np.float64) - flat[a:b].reshape(-1, step)[rows])
                t[1] += n
        for k, (change, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(flat[edges[k] : edges[k + 1]] + change.reshape(-1) / n).astype(np.float32).tobytes()], pa.binary())], names=["block", "w"])

    got = docs.mapInArrow(run, "block int, part int, n long, at binary, w binary").repartition("block").sortWithinPartitions("block", "part").mapInArrow(mean, "block int, w binary").collect()
    out = flat.copy()
    for r in got:
        out[edges[r["block"]] : edges[r["block"] + 1]] = np.frombuffer(r["w"], np.float32)
    return out


def trained(docs: DataFrame, *, epochs: int = EPOCHS, frequent: int = FREQUENT, least: int = LEAST, rate: float = RATE, seed: int = 0) -> tuple:
    """(counts of all words, hashes of the frequent ones, their codes, how often each code occurs, weights) from all texts."""
    counts = written(word_counts(docs.select("doc_id", "text")), "word-counts")
    known, rank, per = vocabulary(counts, min(frequent, CODES - 1), least)
    codes = len(per)
    flat = Window.fresh(per, seed)
    shards = max(1, -(-int(per.sum()) // SHARD_WORDS))
    for _ in range(epochs):
        flat = train(sharded(docs, shards), known, rank, flat, rate, codes, shards)
    return counts, known, rank, per, flat


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, epochs: int = EPOCHS, frequent: int = FREQUENT, least: int = LEAST, rate: float = RATE, seed: int = 0) -> DataFrame:
    """(doc_id, n_tokens, pseudo_log_likelihood, mean_log_prob) of each row, the same, but for rounding,
    however the rows are partitioned.

    The sum, over all words of a text, of the log-probability of the word given SIDE words on either
    side: of its code by the network, and of the word among those of its code by the counts. Words are
    counted, the network trained, and texts scored over the whole table. A model has a code for each
    word that occurs ``least`` times, 256 bytes each. Texts are dealt by hash of id and text to shards of
    about SHARD_WORDS words, each trained on in order by one task. Ids are cast to long. Texts without words, null or empty, have 0
    tokens, a likelihood of 0 and a null mean. Repeated rows are scored each, and count in training; a
    null id is carried; an empty table gives an empty result; other columns are ignored. Very long texts
    are scored whole. Three scans; shuffled are the texts once a pass, words' counts, by task, the shards'
    changed weights, and the words of each text that share codes, which are joined with their counts.
    """
    docs = two(df, id_col, text_col)
    counts, known, rank, per, flat = trained(docs, epochs=epochs, frequent=frequent, least=least, rate=rate, seed=seed)
    codes = len(per)

    def make():
        from pyspark import TaskContext

        w = Window(flat.copy(), codes)
        log_per = np.log(np.maximum(per, 1))
        ctx = TaskContext.get()
        at = [(ctx.partitionId() if ctx else 0) << 40]

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            h, first = word_hashes(part.column(1))
            y = codes_of(h, known, rank, codes)
            x = contexts(y, first, codes)
            lp = np.zeros(len(y) + 1)
            for i in range(0, len(y), BATCH):
                lp[i : i + len(y[i : i + BATCH])] = w.forward(np.ascontiguousarray(x[:, i : i + BATCH]), y[i : i + BATCH])[3]
            n = np.diff(first)
            shared = np.flatnonzero(y >= len(known))
            lp[shared] -= log_per[y[shared]]
            total = np.where(n > 0, np.add.reduceat(lp, first[:-1]), 0.0) if len(n) else np.zeros(0)
            g, row = h[shared], np.repeat(np.arange(len(n)), n)[shared]
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (row[1:] != row[:-1]))) if len(g) else np.zeros(0, bool))
            off = np.searchsorted(row[new], np.arange(len(n) + 1))
            key = at[0] + np.arange(len(n))
            at[0] += len(n)
            times = np.diff(np.append(new, len(g)))
            return pa.RecordBatch.from_arrays([pa.array(key), part.column(0), pa.array(n.astype(np.int64)), pa.array(total), list_column(g[new].view(np.int64), off, pa.int64()), list_column(times, off, pa.int32())], names=["at", "doc_id", "n_tokens", "by_code", "words", "times"])

        return run

    # the words of codes of their own are all of their codes' occurrences; a word that occurs once has a logarithm of 0
    scored = written(by_slice(docs, make, "at long, doc_id long, n_tokens long, by_code double, words array<long>, times array<int>"), "scored-by-code")
    words = scored.select("at", F.explode(F.arrays_zip("words", "times")).alias("x")).select("at", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    log_n = counts.where("n > 1").select(F.col("word").alias("counted"), F.log("n").alias("log_n"))
    extra = words.join(log_n, words["word"] == log_n["counted"]).groupBy("at").agg(F.sum(F.col("times") * F.col("log_n")).alias("extra")).withColumnRenamed("at", "extra_at")
    total = F.col("by_code") + F.coalesce("extra", F.lit(0.0))
    return scored.join(extra, scored["at"] == extra["extra_at"], "left").select("doc_id", "n_tokens", total.alias("pseudo_log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
