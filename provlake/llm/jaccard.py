"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, distinct_shingles, fresh_ids, id_filter, list_column, mix, two, written

NGRAM = 2
THRESHOLD = 0.7
#: Mean elements of a sketch's part, and least of a part that sets are found by: equal parts of fewer are mostly of common n-grams.
MEAN = 3
STRONG = 3
#: A pair at the threshold is missed by its parts once in so many; pairs of more similar sets hardly ever.
MISSED = 10**7
#: In bands of sets of up to so many n-grams, sets are found by their subsets instead.
TINY = 7
#: Parts before one that it tells of, and bits of each: BEFORE * BITS + 2 fit an int.
BEFORE, BITS = 3, 9
WORDS = 8
#: Bytes of an n-gram's hash when sets are sent to be compared.
GRAM_BYTES = 6
#: N-grams on either side of a cell of pairs that are verified together.
CELL_GRAMS = 1 << 22
#: Pairs of a cell, about.
CELL_PAIRS = 1 << 18
_SALT = np.uint64(0xA5A5A5A5A5A5A5A5)


def edges(threshold: float, top: int = 1 << 40) -> list[int]:
    """Least sizes of the bands; sets of the threshold's similarity are in one band or in neighbours."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int((out[-1] - 1) / threshold + 1e-9) + 1))
    return out


def parts_needed(threshold: float) -> int:
    """Parts by which a set is found, so that sets at the threshold differ in all of them once in MISSED.

    A part is of use if the difference leaves it untouched and it holds STRONG elements or more. Sets at
    the lower end of their band have smaller parts, for which more are taken.
    """
    other, common = MEAN * 2 * (1 - threshold) / (1 + threshold), MEAN * 2 * threshold / (1 + threshold)
    use = math.exp(-other) * (1 - math.exp(-common) * sum(common**i / math.factorial(i) for i in range(STRONG)))
    return math.ceil(-1.35 * math.log(MISSED) / math.log(1 - use))


def _subset_keys(h: np.ndarray, off: np.ndarray, row: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the subsets that a set of so many elements can have in common with one of the threshold's similarity."""
    rows, keys = [], []
    tag = np.uint64((1 << 60) + level)
    for r in row.tolist():
        x = mix(h[off[r] : off[r + 1]] ^ _SALT)
        total = np.bitwise_xor.reduce(x)
        for k in range(int((1 - threshold) * len(x) + 1e-9) + 1):
            for c in combinations(range(len(x)), k):
                keys.append(total ^ np.bitwise_xor.reduce(x[list(c)]) if c else total)
                rows.append(r)
    return np.array(rows, np.int64), mix(np.array(keys, np.uint64) ^ mix(tag.reshape(1))[0])


def part_keys(h: np.ndarray, off: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, tag) of the sketch parts that each set is found by; tag has the role and the parts before.

    A sketch has 2**16 bits a part; each element flips one. A part is known by the XOR of codes of
    its set bits, so equal parts have equal keys. Parts in which the sets don't differ are equal. Role
    is 1 for the band of the set, 2 for the band below. Sketches of few elements have few parts, so
    there are several of them, of other hashes. Of each of the BEFORE parts before a tag has BITS bits of
    the key, 0 if there's none: two sets need be paired only where none of these is equal, as
    none is at their first equal part.
    """
    n = np.diff(off)
    wanted = parts_needed(threshold)
    bounds = np.array(edges(threshold))
    band = np.searchsorted(bounds, n, "right") - 1
    spread = mix(h ^ _SALT)
    bit = mix((spread & np.uint64(0xFFFF)) + np.uint64(1))
    row_of = np.repeat(np.arange(len(n)), n)
    rows, keys, tags = [], [], []
    for level in np.unique(np.concatenate((band[n > 0], band[n > 0] - 1))).tolist():
        if level < 0:
            continue
        most = int(bounds[level + 1] - 1)
        use = (n > 0) & ((band == level) | (band == level + 1))
        if most <= TINY:
            r, k = _subset_keys(h, off, np.flatnonzero(use), level, threshold)
            rows.append(r)
            keys.append(k)
            tags.append(np.where(band[r] == level, 1, 2).astype(np.int32))
            continue
        parts = -(-most // MEAN)
        many = -(-wanted // parts)
        mine = use[row_of]
        sp, cd, rw = spread[mine], bit[mine], row_of[mine]
        slots, codes = [], []
        for f in range(many):
            high = (sp if not f else mix(sp + np.uint64(f))) >> np.uint64(32)
            part = ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            ok = part < wanted
            slots.append((rw[ok] * many + f) * parts + part[ok])
            codes.append(cd[ok])
        slot, c = np.concatenate(slots), np.concatenate(codes)
        if not len(slot):
            continue
        order = np.argsort(slot, kind="stable")
        slot, c = slot[order], c[order]
        at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        strong = np.diff(np.append(at, len(slot))) >= STRONG
        s = slot[at]
        key = mix(np.bitwise_xor.reduceat(c, at) ^ mix((s % (many * parts) + (level << 40)).astype(np.uint64)))
        code = 1 + (key % np.uint64((1 << BITS) - 1)).astype(np.int64)
        before = np.zeros(len(s), np.int64)
        for back in range(1, BEFORE + 1):
            for far in range(1, back + 1):  # the part so far back is at most as many entries back
                follows = strong[:-far] & (s[far:] == s[:-far] + back) & (s[far:] % parts >= back)
                before[far:][follows] |= code[:-far][follows] << (2 + BITS * (back - 1))
        r = s[strong] // (many * parts)
        rows.append(r)
        keys.append(key[strong])
        tags.append((before[strong] | np.where(band[r] == level, 1, 2)).astype(np.int32))
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.int32)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(tags)


def folded(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The parity sketch folded to WORDS * 64 bits, a row of longs each: the distance of two sketches
    never exceeds the number of elements in which the sets differ."""
    n = len(off) - 1
    bits = WORDS * 64
    bit = (mix(h ^ _SALT) & np.uint64(bits - 1)).astype(np.int64)
    slot = np.repeat(np.arange(n), np.diff(off)) * bits + bit
    odd = (np.bincount(slot, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64).reshape(n, WORDS)


def whole_hashes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return mix((total[off[1:]] - total[off[:-1]]) ^ np.diff(off).astype(np.uint64)).view(np.int64)


def sketches(rows: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(doc_id, row, whole, n, s0.., key, tag) of each text with words, whole the hash of its set of n-grams.

    n, the sketch and the keys are null for a set that the task has just sent.
    """
    sk = [f"s{i}" for i in range(WORDS)]

    def make():
        fresh = fresh_ids()

        def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(0, part.num_rows, 1024):
                piece = part.slice(i, 1024)
                h, _, off = distinct_shingles(piece.column(1), ngram)
                n = np.diff(off)
                whole = whole_hashes(h, off)
                new = (n > 0) & fresh(whole)
                at = np.flatnonzero(new)
                mine = np.repeat(new, n)
                h, off = h[mine], np.concatenate(([0], np.cumsum(n[at])))
                row, key, tag = part_keys(h, off, threshold)
                order = np.argsort(row, kind="stable")
                place = np.full(len(n), -1)
                place[at] = np.arange(len(at))
                back = pa.array(place, pa.int64(), mask=~new)
                koff = np.searchsorted(row[order], np.arange(len(at) + 1), "left")
                columns = [n[at], *folded(h, off).T]
                arrays = [piece.column(0), piece.column(2), pa.array(whole), *(pa.array(np.ascontiguousarray(c)).take(back) for c in columns), list_column(key[order], koff, pa.int64()).take(back), list_column(tag[order], koff, pa.int32()).take(back)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "whole", "n", *sk, "key", "tag"]).filter(pa.array(n > 0))

        return run

    return by_slice(rows, make, f"doc_id long, row long, whole long, n long, {', '.join(f'{x} long' for x in sk)}, key array<long>, tag array<int>")


def packed(h: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each row's hashes, cut to GRAM_BYTES, as a binary."""
    raw = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES])
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * GRAM_BYTES).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // GRAM_BYTES, 8), np.uint8)
    out[:, :GRAM_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, GRAM_BYTES)
    return np.sort(out.view(np.uint64).reshape(-1))


def _gram_sets(rows: DataFrame, holders: DataFrame, ngram: int) -> DataFrame:
    """(whole, grams) of the texts of holders (doc_id, row), and of a few others, which a filter of bounded size lets pass."""
    keep = id_filter(holders.select(F.xxhash64("doc_id", "row").alias("id")))

    def make():
        fresh = fresh_ids()
        chosen = keep()

        def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
            part = part.filter(pa.array(chosen(part.column(3).to_numpy())))
            if not part.num_rows:
                return None
            h, _, off = distinct_shingles(part.column(1), ngram)
            whole = whole_hashes(h, off)
            ok = pa.array((np.diff(off) > 0) & fresh(whole))
            return pa.RecordBatch.from_arrays([pa.array(whole), packed(h, off)], names=["whole", "grams"]).filter(ok)

        return run

    return by_slice(rows.withColumn("id", F.xxhash64("doc_id", "row")), make, "whole long, grams binary")


def _cells(near: DataFrame) -> DataFrame:
    """(hi, lo, cell): pairs (hi, lo, n), n the n-grams of both, of one group of copies share cells.

    A group is known by the least partner of the pair's smaller id. So a set is sent about once for
    a group of up to CELL_GRAMS and CELL_PAIRS, not once for each of its pairs; a larger group is cut
    into squares.
    """
    least = near.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "lo")
    pairs = near.join(least, "lo", "left").select("hi", "lo", "n", F.coalesce("m", "lo").alias("g"))
    many = pairs.groupBy("g").agg(F.ceil(F.greatest(F.sqrt(2.0 * F.count("*")) * F.avg("n") / 2 / CELL_GRAMS, F.sqrt(F.count("*") / CELL_PAIRS))).alias("k"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("k"))
    return pairs.join(many, "g").select("hi", "lo", F.xxhash64("g", side("hi"), side("lo")).alias("cell"))


def _verified(cells: DataFrame, grams: DataFrame, threshold: float, links: bool) -> DataFrame:
    """(hi, lo, jaccard) of the pairs that reach the threshold; or of each set of a cell that is linked in it
    (whole, root, n_links), root one set for all that the cell's links connect.

    A cell's sets come first, then its pairs; a cell's sets are in memory together.
    """
    wanted = cells.select("cell", F.explode(F.array("hi", "lo")).alias("whole")).distinct()
    sets = grams.join(wanted.hint("shuffle_hash"), "whole").select("cell", F.lit(0).alias("kind"), F.col("whole").alias("hi"), F.lit(None).cast("long").alias("lo"), "grams")
    rows = sets.unionByName(cells.select("cell", F.lit(1).alias("kind"), "hi", "lo", F.lit(None).cast("binary").alias("grams")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        over: list[tuple[int, int, int]] = []  # of closed cells
        root: dict[int, int] = {}
        count: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def close() -> None:
            over.extend((x, find(x), n) for x, n in count.items())
            root.clear()
            count.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in over], pa.int64()) for i in range(3)], names=["whole", "root", "n_links"])
            over.clear()
            return out

        for b in batches:
            cs, kinds, his, los = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(4))
            sets = b.column(4)
            hi, lo, got = [], [], []
            for i, (c, kind, d, o) in enumerate(zip(cs.tolist(), kinds.tolist(), his.tolist(), los.tolist(), strict=True)):
                if c != cell:
                    close()
                    cell, held = c, {}
                if not kind:
                    if d not in held:
                        held[d] = unpacked(sets[i].as_buffer())
                    continue
                p, q = held[d], held[o]
                if len(p) > len(q):
                    p, q = q, p
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                j = common / (len(p) + len(q) - common)
                if j < threshold - 1e-12:
                    continue
                if links:
                    count[d] = count.get(d, 0) + 1
                    count[o] = count.get(o, 0) + 1
                    root[find(d)] = find(o)
                else:
                    hi.append(d)
                    lo.append(o)
                    got.append(j)
            yield flush() if links else pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(got, pa.float64())], names=["hi", "lo", "jaccard"])
        if links:
            close()
            yield flush()

    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "whole long, root long, n_links long" if links else "hi long, lo long, jaccard double")


def _linked(rows: DataFrame, ngram: int, threshold: float, links: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, whole) of each text with words, and what _verified has of the sets, each by its whole."""
    if not 0.5 <= threshold <= 0.99:
        raise ValueError("threshold must be from 0.5 to 0.99")
    sets = written(sketches(rows, ngram, threshold), "sketches")
    once = sets.where("n IS NOT NULL")
    keyed = once.select("whole", F.explode(F.arrays_zip("key", "tag")).alias("x")).select("x.key", "whole", "x.tag").repartition("key").groupBy("key", "whole").agg(F.min("tag").alias("tag"))
    a, b = keyed.alias("a"), keyed.alias("b")
    part = lambda t, i: F.shiftright(f"{t}.tag", 2 + BITS * i).bitwiseAND((1 << BITS) - 1)
    first = reduce(lambda x, y: x & y, [(part("a", i) != part("b", i)) | (part("a", i) == 0) for i in range(BEFORE)])
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.whole") > F.col("b.whole")) & (F.col("a.tag").bitwiseOR(F.col("b.tag")).bitwiseAND(1) == 1) & first
    # sent by hi, for the join with its sketch too
    found = a.join(b, meet).select(F.col("a.whole").alias("hi"), F.col("b.whole").alias("lo")).repartition("hi").groupBy("hi", "lo").agg(F.count("*").alias("times")).drop("times")
    light = once.groupBy("whole").agg(F.any_value("n").alias("n"), *(F.any_value(f"s{i}").alias(f"s{i}") for i in range(WORDS)))
    side = lambda name: light.select(F.col("whole").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in light.columns[1:]))
    both = found.join(side("hi"), "hi").join(side("lo"), "lo")
    far = sum((F.bit_count(F.col(f"hi_s{i}").bitwiseXOR(F.col(f"lo_s{i}"))) for i in range(WORDS)), F.lit(0))
    total, least, greatest = F.col("hi_n") + F.col("lo_n"), F.least("hi_n", "lo_n"), F.greatest("hi_n", "lo_n")
    most = F.floor(total * ((1 - threshold) / (1 + threshold)) + 1e-9)
    near = written(both.where((far <= most) & (least >= greatest * threshold - 1e-9)).select("hi", "lo", total.alias("n")), "sketch-pairs")
    cells = written(_cells(near), "sketch-cells")
    ids = near.select(F.explode(F.array("hi", "lo")).alias("want")).distinct()
    holders = sets.groupBy("whole").agg(F.min(F.struct("doc_id", "row")).alias("x"))
    grams = _gram_sets(rows, holders.join(ids, holders["whole"] == ids["want"], "left_semi").select("x.doc_id", "x.row"), ngram)
    return sets.select("doc_id", "row", "whole"), written(_verified(cells, grams, threshold, links), "similar-sets")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return two(df, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("row", F.xxhash64("text"))


def _classes(rows: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(doc_id, row, class_id, n_links, n_equal) of each text with words."""
    sets, linked = _linked(rows, ngram, threshold, True)
    sets = sets.distinct()
    links = linked.groupBy("whole").agg(F.sum("n_links").alias("n_links"))
    root = components(linked, "whole", "root")
    groups = sets.groupBy("whole").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_equal"))
    groups = groups.join(links, "whole", "left").join(root.withColumnRenamed("doc_id", "whole"), "whole", "left")
    groups = written(groups.select("whole", "least", "n_equal", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "whole").alias("root")), "set-groups")
    least = groups.groupBy("root").agg(F.min("least").alias("class_id"))
    groups = groups.join(least, "root").select("whole", "class_id", "n_links", "n_equal")
    return sets.join(groups, "whole").select("doc_id", "row", "class_id", "n_links", "n_equal")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with words: (doc_id, class_id, n_links, n_equal, is_first).

    Two documents are linked if their sets of word n-grams have a Jaccard similarity of at least
    ``threshold``. A class is a connected component of links, known by its smallest doc_id; is_first
    marks that one. n_links counts the other sets that the document's set is linked to, equal sets
    once; n_equal the documents of the same set, itself included. similar_pairs has the links.

    Similarities are exact, by hash of n-grams. Sets of few n-grams are found by common subsets without
    fail; of other pairs at the threshold less than one in MISSED has no equal part that it is
    found by, and far fewer of more similar ones. Nothing is capped.

    Words are runs of letters, digits and non-ASCII characters in lower case; a text of fewer than
    ``ngram`` words is one n-gram. Texts without words, null or empty, and rows with a null id have no
    row. Ids are cast to long. Rows that repeat an id and a text count once; different texts of one id
    have a row each. Empty tables give empty results; other columns are ignored.
    """
    out = _classes(_rows(df, id_col, text_col), ngram, threshold)
    return out.select("doc_id", "class_id", "n_links", "n_equal", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The links between different sets: (doc_id, match_id, jaccard), each set by its smallest doc_id, match_id the smaller.

    A pair of sets is a row, so links grow with the square of the versions of a text. Rows are treated
    as jaccard_join says; two sets of the same smallest doc_id, as an id repeats, are a row of that id twice.
    """
    sets, pairs = _linked(_rows(df, id_col, text_col), ngram, threshold, False)
    rep = sets.groupBy("whole").agg(F.min("doc_id").alias("rep"))
    named = lambda c: rep.select(F.col("whole").alias(c), F.col("rep").alias(f"{c}_rep"))
    both = pairs.join(named("hi"), "hi").join(named("lo"), "lo")
    return both.select(F.greatest("hi_rep", "lo_rep").alias("doc_id"), F.least("hi_rep", "lo_rep").alias("match_id"), "jaccard")


def components(pairs: DataFrame, a: str = "doc_id", b: str = "match_id") -> DataFrame:
    """(doc_id, root): the smallest id of the connected component of every id that is in a pair.

    Alternating large-star and small-star rounds, each written to the shared folder, until the edges
    stay the same: about the logarithm of the longest path. A null or self pair is no edge.
    """
    edges_ = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(edges_)
    while last[0]:
        both = edges_.unionByName(edges_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges_ = written(small, "edges")
        now = mark(edges_)
        if now == last:
            break
        last = now
    return edges_.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """df with one document, that of the smallest id, of each class of jaccard_join.

    Rows without words, null texts included, or with a null id stay. Rows that repeat an id and a text
    stay or go together; of different texts of one id each goes with its own class.
    """
    classes = _classes(_rows(df, id_col, text_col), ngram, threshold)
    gone = classes.where("doc_id != class_id").select(F.col("doc_id").alias("__gone__"), F.col("row").alias("__row__"))
    here = (df[f"`{id_col}`"].cast("long") == gone["__gone__"]) & (F.xxhash64(df[f"`{text_col}`"].cast("string")) == gone["__row__"])
    return df.join(gone, here, "left_anti")
