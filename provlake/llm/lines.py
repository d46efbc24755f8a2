"""Line dedup: a segment-partition edit join over all lines, verified by banded bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, by_slice, fresh_ids, mix, prefix_hash, span_hash, two, written

#: Edits (insertions, deletions, substitutions of characters) up to which lines are the same.
EDITS = 2
#: Lines of fewer characters, surrounding white space not counted, stay: blank ones.
MIN_CHARS = 1
#: Lines of fewer characters are the same only if they are equal.
EDIT_CHARS = 20
#: Different lines of one key up to which a task pairs them as they stream by; the pairs of more are cut into cells.
HOT = 1024
#: Lines on each side of a cell.
CELL = 8192
_SPACE = np.array([9, 10, 11, 12, 13, 32, 160], np.uint32)


def line_table(column: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a column, and start, end, row and number of each line that is long enough."""
    data, off = buffers(column)
    units = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    z = np.zeros(0, np.int64)
    if not len(units) or heads[-1] != len(units):
        if len(units):  # bytes that aren't UTF-8: count the code points row by row
            raw = data.tobytes()
            heads = np.concatenate(([0], np.cumsum([len(raw[a:b].decode("utf-8", "replace")) for a, b in zip(off, off[1:], strict=False)])))
            units = np.frombuffer("".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(off, off[1:], strict=False)).encode("utf-32-le", "surrogatepass"), np.uint32)
        else:
            return units, z, z, z, z
    breaks = np.flatnonzero(units == 10)
    filled = heads[:-1][heads[1:] > heads[:-1]]
    starts = np.union1d(filled, breaks + 1)
    starts = starts[starts < len(units)]
    row = np.searchsorted(heads, starts, "right") - 1
    ends = np.append(starts[1:], len(units))
    first = np.searchsorted(starts, heads[row], "left")
    number = np.arange(len(starts)) - first
    solid = np.flatnonzero(~np.isin(units, _SPACE))
    if not len(solid):
        return units, z, z, z, z
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    a, b, row, number = a[some], b[some], row[some], number[some]
    s, e = solid[a], solid[b - 1] + 1
    long = e - s >= min_chars
    return units, s[long], e[long], row[long], number[long]


def line_ids(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(span_hash(h, s, e) ^ (e - s).astype(np.uint64)).view(np.int64)


def signatures(h: np.ndarray, s: np.ndarray, e: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(key, index of the line, role) of its own segments, role 1, of the substrings it probes, 2, both 3.

    A line of n characters is indexed by edits + 1 segments. It probes the segments of lines of n,
    n - 1, ... n - edits characters, by the substrings that the multi-match-aware bounds leave: start
    in [p - (i-1), p + (i-1)] and in [p + d - (edits+1-i), p + d + (edits+1-i)] for the i-th segment at
    p of a line d shorter. Lines within the distance share at least one key.
    """
    n = e - s
    parts = edits + 1
    who = np.arange(len(s))
    for d in range(edits + 1):
        size = n - d
        base, extra = size // parts, size % parts
        for i in range(1, parts + 1):
            longer = np.maximum(0, (i - 1) - (parts - extra))
            p = (i - 1) * base + longer
            length = base + (i > parts - extra)
            tag = mix((size * parts + i).astype(np.uint64))
            for at in range(max(-(i - 1), d - (parts - i)), min(i - 1, d + (parts - i)) + 1):
                q = p + at
                ok = (q >= 0) & (q + length <= n) & (length > 0)
                a = (s + q)[ok]
                key = mix(span_hash(h, a, a + length[ok]) ^ tag[ok]).view(np.int64)
                yield key, who[ok], 3 if d == 0 and at == 0 else 2


def bigram_sketch(text: str) -> tuple[int, int]:
    """128 parities of a line's hashed pairs of characters; an edit flips at most four of them."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    g = mix((u[:-1] << np.uint64(32)) | u[1:])
    bit, high = np.uint64(1) << (g & np.uint64(63)), (g >> np.uint64(6)) & np.uint64(1) == 1
    return tuple(int(np.bitwise_xor.reduce(bit[x]).view(np.int64)) if x.any() else 0 for x in (~high, high))


def pairs_of_runs(key: np.ndarray, line: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different lines, of one key each, of which one is indexed; keys are sorted."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    for n in np.unique(size[size > 1]).tolist():
        at = edge[:-1][size == n]
        step = max(1, (1 << 21) // (n * n)) if n < 1024 else 1
        for k in range(0, len(at), step):
            rows = at[k : k + step, None] + np.arange(n)
            ln, rl = line[rows], role[rows]
            for shift in range(1, n):
                a, b = ln[:, :-shift], ln[:, shift:]
                ok = (a != b) & (((rl[:, :-shift] | rl[:, shift:]) & 1) > 0)
                if ok.any():
                    yield np.minimum(a, b)[ok], np.maximum(a, b)[ok]


def bounded_distances(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Edit distance of each pair of code-point arrays; edits + 1 where it is more.

    Common ends are trimmed; then all pairs go through the columns together, a band of 2 * edits + 1
    diagonals in one word each (Hyyrö's banded form of Myers' algorithm).
    """
    out = np.full(len(a), edits + 1, np.int64)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if abs(len(x) - len(y)) > edits:
            continue
        n = min(len(x), len(y))
        d = np.flatnonzero(x[:n] != y[:n])
        p = int(d[0]) if len(d) else n
        r = np.flatnonzero(x[len(x) - n + p :][::-1] != y[len(y) - n + p :][::-1])
        q = int(r[0]) if len(r) else n - p
        x, y = x[p : len(x) - q], y[p : len(y) - q]
        if not len(x) or not len(y):
            out[i] = len(x) + len(y) if len(x) + len(y) <= edits else edits + 1
        elif min(len(x), len(y)) <= 2 * edits + 1:
            out[i] = _small(x.tolist(), y.tolist(), edits)
        else:
            todo.append((i, x, y))
    todo.sort(key=lambda t: -len(t[2]))
    for k in range(0, len(todo), 4096):
        part = todo[k : k + 4096]
        out[[t[0] for t in part]] = _banded([t[1] for t in part], [t[2] for t in part], edits)
    return out


def _small(x: list[int], y: list[int], edits: int) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        diag, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (c != d))
    return min(row[-1], edits + 1)


def _banded(x: list[np.ndarray], y: list[np.ndarray], k: int) -> np.ndarray:
    """Pairs sorted by the length of y, longest first; all longer than 2k + 1, lengths within k."""
    m = np.array([len(v) for v in x])
    n = np.array([len(v) for v in y])
    pad = np.full(k, -1, np.int64)
    tail = np.full(2 * k + 2, -2, np.int64)
    xs = np.concatenate([w for v in x for w in (pad, v.astype(np.int64), tail)])
    x0 = np.concatenate(([0], np.cumsum(m + 3 * k + 2)))[:-1]
    ys = np.concatenate([v.astype(np.int64) for v in y])
    y0 = np.concatenate(([0], np.cumsum(n)))[:-1]
    full = np.uint64((1 << (2 * k + 1)) - 1)
    top = np.uint64(1 << (2 * k))
    one = np.uint64(1)
    vp = np.full(len(m), full ^ np.uint64((1 << k) - 1), np.uint64)
    vn = np.zeros(len(m), np.uint64)
    score = np.full(len(m), k, np.int64)
    for i in range(int(n[0])):
        live = int(np.searchsorted(-n, -i, "left"))
        c = ys[y0[:live] + i]
        eq = np.zeros(live, np.uint64)
        at = x0[:live] + np.minimum(i, m[:live] + k + 1)
        for j in range(2 * k + 1):
            eq |= (xs[at + j] == c).astype(np.uint64) << np.uint64(j)
        p, v = vp[:live], vn[:live]
        d0 = ((((eq & p) + p) ^ p) | eq | v) & full
        hp = (v | ~(d0 | p)) & full
        hn = d0 & p
        diagonal = i < m[:live] - k
        h = np.maximum(2 * k - 1 - (i - (m[:live] - k)), 0).astype(np.uint64)
        score[:live] += np.where(diagonal, ((d0 & top) == 0).astype(np.int64), ((hp >> h) & one).astype(np.int64) - ((hn >> h) & one).astype(np.int64))
        vp[:live] = (hn | ~((d0 >> one) | hp)) & full
        vn[:live] = (d0 >> one) & hp
    return np.minimum(score, k + 1)


# ---------------------------------------------------------------- the join
def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row): row tells texts apart that share an id."""
    return two(df, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("row", F.xxhash64("text"))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            units, s, e, row, number = line_table(part.column(1), min_chars)
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array(number.astype(np.int32)), pa.array(line_ids(prefix_hash(units), s, e))], names=["doc_id", "row", "line_no", "line"])

        return run

    return by_slice(rows, make, "doc_id long, row long, line_no int, line long")


def _signatures(rows: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(key, line, role) of each line; a task sends a line again only when it has forgotten it."""
    names = ["key", "line", "role"]

    def make():
        fresh = fresh_ids()

        def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            units, s, e, _, _ = line_table(part.column(1), min_chars)
            h = prefix_hash(units)
            ids, first = np.unique(line_ids(h, s, e), return_index=True)
            new = fresh(ids)
            ids, first = ids[new], first[new]
            s, e = s[first], e[first]
            for key, who, role in signatures(h, s, e, edits):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[who]), pa.array(np.full(len(key), role, np.int8))], names=names)

        return run

    return by_slice(rows, make, "key long, line long, role byte")


def _candidates(sig: DataFrame) -> DataFrame:
    """Pairs of lines that share a key, (lo, hi); of keys of more than HOT lines the lines, (lo, null, key, role).

    Each partition is a sorted stream, of which only a key's first HOT lines are held.
    """
    names = ["lo", "hi", "key", "role"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int8())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
        hot: int | None = None  # the key that the stream is in the midst of, if it's a hot one

        def distinct(key, line, role):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
            at = np.flatnonzero(new)
            return [key[at], line[at], np.bitwise_or.reduceat(role, at)]

        def lines_of(key, line, role):
            return pa.RecordBatch.from_arrays([pa.array(line), pa.nulls(len(line), pa.int64()), pa.array(key), pa.array(role)], names=names)

        def pairs(seen):
            u = np.unique(np.concatenate(seen), axis=0)
            none = pa.nulls(len(u))
            return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), none.cast(kinds[2]), none.cast(kinds[3])], names=names)

        def out(key, line, role):
            size = np.diff(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))))
            big = np.repeat(size > HOT, size)
            if big.any():
                yield lines_of(key[big], line[big], role[big])
                key, line, role = key[~big], line[~big], role[~big]
            seen: list[np.ndarray] = []
            for lo, hi in pairs_of_runs(key, line, role) if len(key) > 1 else ():
                seen.append(np.stack([lo, hi], 1))
                if sum(map(len, seen)) > 1 << 18:
                    yield pairs(seen)
                    seen = []
            if seen:
                yield pairs(seen)

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if hot is not None:
                n = int(np.searchsorted(now[0], hot, "right"))
                if n:
                    yield lines_of(*distinct(*(x[:n] for x in now)))
                now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                hot = None
            held = distinct(*(np.concatenate(x) for x in zip(held, now, strict=True)))
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield from out(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            if len(held[0]) > HOT:
                hot = int(held[0][0])
                yield lines_of(*held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from out(*held)

    return sig.repartition("key").sortWithinPartitions("key", "line").mapInArrow(run, "lo long, hi long, key long, role byte")


def _hot_pairs(hot: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(lo, hi) of lines of a hot key, (key, line, role), whose sketches lie within 4 * edits bits.

    A key's lines are dealt to blocks of about CELL lines; each two blocks are a cell, in one task. So
    a task holds two blocks whatever the key, and of all its pairs emits those that may be within the edits.
    """
    hot = written(hot.groupBy("key", "line").agg(F.bit_or("role").alias("role")), "hot-lines")
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array([bigram_sketch(t) for t in part.column(1).to_pylist()], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["line", "s0", "s1"])

        return run

    sketches = by_slice(texts.join(hot.select("line").distinct(), "line").select("line", "text"), make, "line long, s0 long, s1 long")
    placed = hot.join(blocks, "key").join(sketches, "line").withColumn("block", F.pmod(F.xxhash64("line"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.select("key", "line", "role", "s0", "s1", "block", other.alias("other")).withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            line, role, s0, s1, block, other = (np.concatenate([h[i] for h in held]) for i in range(1, 7))
            s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
            first = block <= other
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            alone = not len(right) and (block == other).all()
            if alone:
                right = left
            for i in range(0, len(left), 256):
                a = left[i : i + 256]
                far = np.bitwise_count(s0[a, None] ^ s0[right]) + np.bitwise_count(s1[a, None] ^ s1[right])
                x, y = np.nonzero((far <= 4 * edits) & (((role[a, None] | role[right]) & 1) > 0))
                x, y = line[a[x]], line[right[y]]
                ok = x < y if alone else x != y
                x, y = x[ok], y[ok]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["lo", "hi"])

        held: list[list[np.ndarray]] = []
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            edge = np.flatnonzero(np.concatenate(([True], now[0][1:] != now[0][:-1], [True]))) if b.num_rows else np.zeros(1, np.int64)
            for lo, hi in zip(edge, edge[1:], strict=False):
                if held and held[0][0][0] != now[0][lo]:
                    yield from out(held)
                    held = []
                held.append([x[lo:hi].copy() for x in now])
        if held:
            yield from out(held)

    return cells.select("cell", "line", "role", "s0", "s1", "block", "other").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "lo long, hi long")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the wanted (doc_id, row, line_no, line), by one join on the row."""
    per = wanted.groupBy(F.col("doc_id").alias("want_id"), F.col("row").alias("want_row")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("want"))
    joined = rows.join(per.hint("shuffle_hash"), (rows["doc_id"] == per["want_id"]) & (rows["row"] == per["want_row"])).select("doc_id", "text", F.col("want.line_no").alias("no"), F.col("want.line").alias("line"))

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            units, s, e, row, number = line_table(part.column(1), 1)
            many = part.column(2).value_lengths().to_numpy().astype(np.int64)
            at = (np.repeat(np.arange(part.num_rows), many) << 32) + part.column(2).flatten().to_numpy()
            k = np.searchsorted((row << 32) + number, at)  # every wanted line is there
            texts = [units[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(s[k], e[k], strict=True)]
            return pa.RecordBatch.from_arrays([part.column(3).flatten(), pa.array(texts, pa.string())], names=["line", "text"])

        return run

    return by_slice(joined, make, "line long, text string").dropDuplicates(["line"])


def _verified(pairs: DataFrame, edits: int) -> DataFrame:
    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            units = [[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in part.column(i).to_pylist()] for i in (2, 3)]
            d = bounded_distances(*units, edits)
            ok = np.flatnonzero(d <= edits)
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ok)), part.column(1).take(pa.array(ok)), pa.array(d[ok].astype(np.int32))], names=["lo", "hi", "distance"])

        return run

    return by_slice(pairs, make, "lo long, hi long, distance int", "text")


def _repeats(rows: DataFrame, edits: int, min_chars: int, edit_chars: int) -> DataFrame:
    """(doc_id, row, line_no, line, match_doc_id, match_line_no, distance); see repeated_lines."""
    edit_chars = max(min_chars, edit_chars)
    if edit_chars <= 2 * edits + 1:
        raise ValueError("edit_chars must be more than 2 * edits + 1")
    lines = written(_lines(rows, min_chars), "lines")
    first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"))
    first = written(first.select("line", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_no"), F.col("first.row").alias("first_row")), "first-lines")
    found = written(_candidates(_signatures(rows, edits, edit_chars)), "line-candidates")
    wanted = first.join(found.select(F.explode(F.array("lo", "hi")).alias("line")).where("line IS NOT NULL").distinct(), "line")
    texts = written(_texts(rows, wanted.select(F.col("first_doc").alias("doc_id"), F.col("first_row").alias("row"), F.col("first_no").alias("line_no"), "line")), "line-texts")
    hot = _hot_pairs(found.where("hi IS NULL").select("key", F.col("lo").alias("line"), "role"), texts, edits)
    pairs = found.where("hi IS NOT NULL").select("lo", "hi").unionByName(hot).distinct()
    a, b = texts.select(F.col("line").alias("lo"), F.col("text").alias("text")), texts.select(F.col("line").alias("hi"), F.col("text").alias("other"))
    near = _verified(pairs.join(a, "lo").join(b, "hi").select("lo", "hi", "text", "other"), edits)
    ends = near.select(F.explode(F.array(F.struct(F.col("lo").alias("line"), F.col("hi").alias("to"), "distance"), F.struct(F.col("hi").alias("line"), F.col("lo").alias("to"), "distance"))).alias("x")).select("x.*")
    other = first.select(F.col("line").alias("to"), F.col("first_doc").alias("match_doc_id"), F.col("first_no").alias("match_line_no"))
    best = ends.join(first, "line").join(other, "to").where(F.struct("match_doc_id", "match_line_no") < F.struct(F.col("first_doc").alias("match_doc_id"), F.col("first_no").alias("match_line_no")))
    best = best.groupBy("line").agg(F.min(F.struct("match_doc_id", "match_line_no", "distance")).alias("m"), F.any_value("first_doc").alias("first_doc"), F.any_value("first_no").alias("first_no"))
    # the rows of a line's first place have the line's own match, all others its first place
    here = (F.col("doc_id") == F.col("first_doc")) & (F.col("line_no") == F.col("first_no"))
    same = lines.join(first.drop("first_row"), "line").where(~here).select("doc_id", "row", "line_no", "line", F.col("first_doc").alias("match_doc_id"), F.col("first_no").alias("match_line_no"), F.lit(0).alias("distance"))
    firsts = lines.join(best, "line").where(here).select("doc_id", "row", "line_no", "line", "m.match_doc_id", "m.match_line_no", "m.distance")
    return same.unionByName(firsts)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits: int = EDITS, min_chars: int = MIN_CHARS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """One row per line that repeats an earlier one: (doc_id, line_no, match_doc_id, match_line_no, distance).

    Lines are compared without surrounding white space, in code points, in the order of (doc_id,
    line_no), numbered from 0. Equal lines match the first of them, at distance 0. That first line
    matches the earliest line within ``edits`` of it that begins earlier. So dropping all rows of the
    result leaves at least the first line of every chain. The search is exact: nothing is capped.

    Lines under ``edit_chars`` match only equal ones. Lines under ``min_chars`` are left alone, as are
    null and empty texts and rows with a null id. Ids are cast to long. Rows that repeat an id and a
    text count once; different texts of one id each have their lines, and two lines of the same id and
    number don't match each other. Empty tables give empty results; other columns are ignored. Texts are
    shuffled once, for the documents that hold candidates; keys are shuffled as 17 bytes, 12 for a line
    at 2 edits, about once a task for a line however often it occurs. Of a key that very many
    different lines share, blocks of lines are compared by sketches in separate tasks.
    """
    out = _repeats(_rows(df, id_col, text_col), edits, min_chars, edit_chars)
    return out.select("doc_id", "line_no", "match_doc_id", "match_line_no", "distance").distinct()


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits: int = EDITS, min_chars: int = MIN_CHARS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """df without the lines that repeated_lines reports, and without the rows that are left blank by it.

    Rows that lose nothing stay as they are, blank ones and those with a null id or text too. Rows that
    repeat an id and a text lose the same lines; of different texts of one id each loses its own.
    """
    names = df.columns
    gone = _repeats(_rows(df, id_col, text_col), edits, min_chars, edit_chars)
    gone = written(gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "lines-gone")
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    k = names.index(text_col)
    key, text = inner[f"c{names.index(id_col)}"].cast("long"), inner[f"c{k}"].cast("string")
    joined = inner.join(gone.hint("shuffle_hash"), (key == gone["gone_id"]) & (F.xxhash64(text) == gone["gone_row"]), "left").drop("gone_id", "gone_row")

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            gone = part.column(part.num_columns - 1)
            column = part.column(k)
            keep, new = np.ones(part.num_rows, bool), {}
            for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                drop = set(gone[i].as_py())
                new[int(i)] = left = "\n".join(x for j, x in enumerate(column[i].as_py().split("\n")) if j not in drop)
                keep[i] = bool(left.strip())
            cols = [part.column(i) for i in range(part.num_columns - 1)]
            if new:
                cols[k] = pa.array([new[i] if i in new else x.as_py() for i, x in enumerate(column)], column.type)
            return pa.RecordBatch.from_arrays(cols, schema=pa.schema([part.schema.field(i) for i in range(part.num_columns - 1)])).filter(pa.array(keep))

        return run

    out = by_slice(joined, make, inner.schema, f"c{k}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
