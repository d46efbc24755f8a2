"""Document fingerprints: SimHash votes and permuted block tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, distinct_shingles, two, written
from .jaccard import components

BITS = 64
SHINGLE = 1
#: Bits; of near copies with a bigram Jaccard of 0.7 and more, most differ in up to so many.
RADIUS = 8
BLOCKS = 3
#: Words of a document whose votes are summed at once.
VOTES = 1 << 14
#: Fingerprints whose links a task sums up in memory.
HELD = 1 << 18


def simhash_rows(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each row as signed longs, and whether the row has any word."""
    h, tf, off = distinct_shingles(column, shingle)
    n = len(column)
    out = np.zeros(n, np.uint64)
    weight = np.rint((1 + np.log(tf)) * (1 << 20))  # whole numbers, so that sums are exact and ties are ties in any order
    for i in range(n):
        votes = np.zeros(BITS)
        for a in range(off[i], off[i + 1], VOTES):  # one small matrix product each
            b = min(a + VOTES, off[i + 1])
            bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            votes += 2 * (weight[a:b] @ bits) - weight[a:b].sum()
        out[i] = np.packbits(votes > 0, bitorder="little").view(np.uint64)[0]
    return out.view(np.int64), off[1:] > off[:-1]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and 64-bit fingerprint of each row: each distinct run of ``shingle`` words votes on every
    bit with weight 1 + ln(times it occurs). Texts without words, null or empty, have a null fingerprint."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            fp, ok = simhash_rows(part.column(1), shingle)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.int64(), mask=~ok)], names=["doc_id", "fingerprint"])

        return run

    return by_slice(two(df, id_col, text_col), make, "doc_id long, fingerprint long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask per table: two fingerprints within the radius agree on all bits of at least one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def block_flips(blocks: int, radius: int) -> list[list[int]]:
    """For each block its mask, and the bits that make its keys when flipped in a fingerprint, 0 first.

    With no more blocks than the radius, two fingerprints within it differ in at most radius // blocks
    bits of some block; so their keys meet where each is flipped in up to half as many, rounded up.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    most = (radius // blocks + 1) // 2
    return [[((1 << (b - a)) - 1) << a, *(sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(a, b), k))] for a, b in zip(edges, edges[1:], strict=False)]


def _groups(df: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint) of each document with words, once; and of each fingerprint its least id and number of documents (fingerprint, least, n_equal)."""
    fp = written(fingerprints(df, id_col, text_col, shingle).where("doc_id IS NOT NULL AND fingerprint IS NOT NULL").distinct(), "fingerprints")
    return fp, written(fp.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_equal")), "fingerprint-groups")


def _links(groups: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(hi, lo, distance): each pair of different fingerprints within ``radius`` bits once, hi the greater. All candidates of a table are compared.

    A pair counts in the first table that it meets in, and there only where hi is flipped in the lower
    half of the bits in which they differ, rounded down, and lo in the others; so pairs aren't shuffled.
    """
    if radius < 0 or not 0 < blocks <= BITS:
        raise ValueError("radius must be 0 at least and blocks 1 to 64")
    to_long = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    tables = [[m, 0] for m in block_masks(blocks, radius)] if radius < blocks else block_flips(blocks, radius)
    reach = 2 * max(flip.bit_count() for _, *flips in tables for flip in flips)
    upward = lambda flip: -(flip & -flip) & (1 << 64) - 1  # noqa: E731  # its lowest bit and all above
    each = [(t, mask, flip, upward(flip)) for t, (mask, *flips) in enumerate(tables) for flip in flips]
    at = lambda k, i: F.element_at(F.array(*[to_long(x[k]) for x in each]), F.col(i) + 1)
    keys = [F.col("fingerprint").bitwiseAND(to_long(mask)).bitwiseXOR(to_long(flip)) for _, mask, flip, _ in each]
    keyed = groups.select("fingerprint", F.posexplode(F.array(*keys)).alias("i", "key")).select(F.xxhash64(at(0, "i"), "key").alias("key"), F.col("i").cast("int").alias("i"), "fingerprint")
    a, b = keyed.alias("a"), keyed.alias("b").hint("merge")  # by its estimate, that of groups, Spark would send all keys through the driver
    differ = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    x, y = at(2, "a.i"), at(2, "b.i")
    meets = [F.bit_count(differ.bitwiseAND(to_long(mask))) <= reach for mask, *_ in tables]
    first = reduce(lambda case, t: case.when(meets[t], t), range(1, len(meets)), F.when(meets[0], 0))
    lower = (x.bitwiseAND(at(3, "b.i")) == 0) & (F.bit_count(y) - F.bit_count(x)).isin(0, 1)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fingerprint") > F.col("b.fingerprint")) & (F.bit_count(differ) <= radius) & lower & (first == at(0, "a.i")))
    return pairs.select(F.col("a.fingerprint").alias("hi"), F.col("b.fingerprint").alias("lo"), F.bit_count(differ).cast("int").alias("distance"))


def _summed(links: DataFrame) -> DataFrame:
    """Of each fingerprint that has links in a task (fingerprint, root, n_links), root one fingerprint for all that they connect.

    What a task knows goes out whenever it holds HELD fingerprints, so links are neither kept nor shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        count: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([*count], [find(k) for k in count], [*count.values()])], names=["fingerprint", "root", "n_links"])
            root.clear()
            count.clear()
            return out

        for batch in batches:
            for hi, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[hi] = count.get(hi, 0) + 1
                count[lo] = count.get(lo, 0) + 1
                root[find(hi)] = find(lo)
            if len(count) >= HELD:
                yield flush()
        yield flush()

    return links.select("hi", "lo").mapInArrow(run, "fingerprint long, root long, n_links long")


def near_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document with words: (doc_id, class_id, n_links, n_equal, is_first, fingerprint).

    Two fingerprints are linked if they are within ``radius`` bits, found without fail. A class is a connected
    component of links, known by its smallest doc_id; is_first marks that one. n_links counts the other
    fingerprints that the document's is linked to; n_equal the documents of the same fingerprint, itself
    included. near_fingerprints has the links. Nothing is capped.

    Texts without words, null or empty, and rows with a null id have no row. Rows that repeat an id and a
    fingerprint count once; texts of one id with different fingerprints have a row each, and may be
    linked. Ids are cast to long. An empty table gives an empty result; other columns are ignored.

    Only fingerprints are shuffled, not texts: C(blocks, radius) times with more blocks than the radius,
    else once a key of block_flips, 67 times for 3 blocks and 8 bits. Links are summed up where they are
    found, so rows and what is written are in proportion to documents; the comparing isn't, within groups
    of near copies.
    """
    fp, groups = _groups(df, id_col, text_col, shingle)
    linked = written(_summed(_links(groups, radius, blocks)), "fingerprint-links")
    links = linked.groupBy("fingerprint").agg(F.sum("n_links").alias("n_links"))
    root = components(linked, "fingerprint", "root").withColumnRenamed("doc_id", "fingerprint")
    both = groups.join(links, "fingerprint", "left").join(root, "fingerprint", "left")
    rooted = written(both.select("fingerprint", "least", "n_equal", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "fingerprint").alias("root")), "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    out = fp.join(rooted.join(least, "root").drop("root", "least"), "fingerprint")
    return out.select("doc_id", "class_id", "n_links", "n_equal", (F.col("doc_id") == F.col("class_id")).alias("is_first"), "fingerprint")


def near_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """Every pair of fingerprints within ``radius`` bits: (doc_id, match_id, distance, fingerprint).

    Documents of one fingerprint are a group whose smallest id stands for it: each other member has a
    row (member, that id, 0). Groups are matched by their smallest ids, one row a pair, the smaller id
    as match_id; two groups of the same smallest id, as an id repeats, are a row of that id twice. So the
    result is complete at any size of group, and linear in groups of copies, but grows with the square
    of the versions of a text. Rows are treated as near_documents says.
    """
    fp, groups = _groups(df, id_col, text_col, shingle)
    members = fp.join(groups, "fingerprint").where("doc_id != least").select("doc_id", F.col("least").alias("match_id"), F.lit(0).alias("distance"), "fingerprint")
    named = lambda c: groups.select(F.col("fingerprint").alias(c), F.col("least").alias(f"{c}_least"))
    both = _links(groups, radius, blocks).join(named("hi"), "hi").join(named("lo"), "lo")
    own = F.when(F.col("hi_least") >= F.col("lo_least"), F.col("hi")).otherwise(F.col("lo"))
    return both.select(F.greatest("hi_least", "lo_least").alias("doc_id"), F.least("hi_least", "lo_least").alias("match_id"), "distance", own.alias("fingerprint")).unionByName(members)
