"""Secret scans by structural confirmation: a candidate is reported only if what it decodes to parses.

Candidates are long runs of base64, base64url or hex characters, found with numpy over the bytes of
the column. Each is decoded and must hold a key encoding whose nested lengths add up (DER, OpenSSH), a
signed token with a valid header, a checksummed access token, or, where a name like ``token`` or
``secret`` is assigned to it, as many random bytes as keys have.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, by_slice, two

SCHEMA = "doc_id long, kind string, start long, length long, detail string, digest string"
MIN_RUN = 20
#: Lengths in bytes that raw keys and digests have.
KEY_BYTES = frozenset({16, 20, 24, 28, 32, 48, 64})
_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[*b"0123456789"]] = True

_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s\\nr:,.-]*?)-----END \1-----")
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
_ACCESS = re.compile(rb"(?<![A-Za-z0-9])(gh[pousr]_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NAMED = re.compile(rb"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)s?[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}(?:bearer\s)?[\"']?$")
#: Bytes before a value that its name and the signs between are in at most.
_BEFORE = 40
#: Where a DER sequence or an OpenSSH key may begin in base64 or hex; its lengths tell where it ends.
_KEY_64 = re.compile(rb"(?=(M[A-I][A-Za-z0-9+/_-]{10}|b3BlbnNzaC1rZXktdjEA))")
_KEY_16 = re.compile(rb"(?i)(?=(30(?:8[1-4]|[1-7][0-9a-f])[0-9a-f]{14}))")
_CHARS_64 = re.compile(rb"([A-Za-z0-9+/_-]+)(?:\s|\\[nr])*")
_HEX = re.compile(rb"(?:[0-9a-f]{2})+\Z|(?:[0-9A-F]{2})+\Z")
_B64 = re.compile(rb"[A-Za-z0-9+/]+={0,2}\Z|[A-Za-z0-9_-]+={0,2}\Z")
_SIGNATURE = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "none": (0, 0)} | {a + b: (128, 2048) for a in ("RS", "PS") for b in ("256", "384", "512")}
_B62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def unbase64(raw: bytes) -> bytes | None:
    """Decoded base64 or base64url, with or without padding; None if it isn't."""
    if not _B64.match(raw):
        return None
    body = raw.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER value at ``at``; None if it leaves [at, end)."""
    if at + 2 > end:
        return None
    tag, n = raw[at], raw[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or raw[at] == 0:
            return None
        n = int.from_bytes(raw[at : at + k], "big")
        at += k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def children(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill [at, end) exactly; None if lengths don't add up."""
    out = []
    while at < end:
        if (x := tlv(raw, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def der_kind(raw: bytes) -> str | None:
    """Which private key encoding these bytes are; None if none, or if any nested length is off."""
    if len(raw) < 16 or raw[0] != 0x30 or (top := tlv(raw, 0, len(raw))) is None or top[2] != len(raw):
        return None
    kids = children(raw, top[1], top[2])
    if not kids:
        return None
    tags = [k[0] for k in kids]
    number = lambda k: int.from_bytes(raw[k[1] : k[2]], "big")
    if len(kids) in (6, 9) and set(tags) == {2} and number(kids[0]) in (0, 1) and kids[1][2] - kids[1][1] >= 20:
        return "rsa_private_key" if len(kids) == 9 else "dsa_private_key"
    if tags[:3] == [2, 0x30, 4] and number(kids[0]) in (0, 1):
        inner = children(raw, kids[1][1], kids[1][2])
        return "pkcs8_private_key" if inner and inner[0][0] == 6 else None
    if tags[:2] == [2, 4] and number(kids[0]) == 1 and 16 <= kids[1][2] - kids[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec_private_key"
    if tags == [0x30, 4]:
        inner = children(raw, kids[0][1], kids[0][2])
        return "encrypted_private_key" if inner and inner[0][0] == 6 and kids[1][2] - kids[1][1] >= 32 else None
    return None


def openssh_end(raw: bytes) -> int | None:
    """Where an OpenSSH private key that these bytes begin with ends; None if a nested length is off."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return None
    at = len(magic)
    parts: list[bytes] = []
    for want in ("s", "s", "s", "n", "s", "s"):
        if at + 4 > len(raw):
            return None
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if want == "n":
            if not 1 <= n <= 16:
                return None
            continue
        if at + n > len(raw):
            return None
        parts.append(raw[at : at + n])
        at += n
    return at if parts[0].isascii() and parts[4] else None


def openssh_kind(raw: bytes) -> str | None:
    return "openssh_private_key" if openssh_end(raw) == len(raw) else None


def _gathered(raw: bytes, at: int, need: int | None) -> tuple[bytes, int]:
    """Up to ``need`` base64 characters from ``at`` on, over line ends, and the end of the last of them."""
    out, end, left = [], at, need
    while (m := _CHARS_64.match(raw, at)) and (left is None or left > 0):
        piece = m[1] if left is None else m[1][:left]
        out.append(piece)
        end, at = m.start() + len(piece), m.end()
        left = left if left is None else left - len(piece)
    return b"".join(out), end


def embedded_keys(raw: bytes, s: int, e: int) -> list[tuple[str, int, int, str]]:
    """Key encodings that begin anywhere in raw[s:e]; those in base64 may go on over the lines that follow."""
    out: list[tuple[str, int, int, str]] = []
    done = s
    for m in _KEY_64.finditer(raw, s, e):
        at = m.start()
        if at < done:
            continue
        head = unbase64(m[1][:12]) or b""
        if m[1].startswith(b"b3"):
            got, _ = _gathered(raw, at, None)
            body = unbase64(got[: len(got) // 4 * 4]) or b""
            size = openssh_end(body + (unbase64(got[len(got) // 4 * 4 :]) or b"" if len(got) % 4 > 1 else b""))
        else:
            size = tlv(head + bytes(8), 0, 1 << 40)[2] if tlv(head + bytes(8), 0, 1 << 40) else None
        if size is None or size < 16 or size > len(raw):
            continue
        need = -(-size * 4 // 3)
        got, end = _gathered(raw, at, need)
        if len(got) == need and (kind := key_kind((unbase64(got) or b"")[:size])):
            while raw[end : end + 1] == b"=" and end - at < need + 2 + raw[at:end].count(b"\n") * 2:
                end += 1
            out.append((kind, at, end, "base64"))
            done = end
    for m in _KEY_16.finditer(raw, s, e):
        at = m.start()
        head = tlv(bytes.fromhex(m[1].decode()) + bytes(8), 0, 1 << 40)
        if at < done or head is None or head[2] < 16 or at + 2 * head[2] > e:
            continue
        piece = raw[at : at + 2 * head[2]]
        if _HEX.match(piece) and (kind := der_kind(bytes.fromhex(piece.decode()))):
            out.append((kind, at, at + len(piece), "hex"))
            done = at + len(piece)
    return out


def key_kind(raw: bytes | None) -> str | None:
    return (der_kind(raw) or openssh_kind(raw)) if raw else None


def jwt_detail(header: bytes, payload: bytes, signature: bytes) -> str | None:
    try:
        h = json.loads(unbase64(header) or b"")
        p = json.loads(unbase64(payload) or b"")
    except (ValueError, RecursionError):
        return None
    if not isinstance(h, dict) or not isinstance(p, dict) or not isinstance(h.get("alg"), str):
        return None
    span = _SIGNATURE.get(h["alg"])
    got = len(unbase64(signature) or b"") if signature else 0
    return h["alg"] if span and span[0] <= got <= span[1] else None


def random_looking(raw: bytes) -> bool:
    """Whether the bytes spread as random ones do: enough different ones, no long runs, not all text."""
    return len(set(raw)) >= 0.6 * min(len(raw), 40) and not all(32 <= b < 127 for b in raw)


def _entropy(raw: bytes) -> float:
    n = len(raw)
    return -sum(c / n * math.log2(c / n) for c in (raw.count(bytes([b])) for b in set(raw)))


def scan_run(raw: bytes, s: int, e: int) -> list[tuple[str, int, int, str]]:
    """Confirmed secrets in the run raw[s:e] of candidate characters: (kind, start, end, detail)."""
    run = raw[s:e]
    out = []
    for m in _JWT.finditer(run):
        if detail := jwt_detail(*m.groups()):
            out.append(("signed_token", s + m.start(), s + m.end(), detail))
    for m in _ACCESS.finditer(run):
        crc, code = zlib.crc32(m[2]), 0
        for b in m[3]:
            code = code * 62 + _B62.index(b)
        if crc == code:
            out.append(("access_token", s + m.start(), s + m.end(), m[1].decode()))
    for k in embedded_keys(raw, s, e):
        if not any(a < k[2] and k[1] < b for _, a, b, _ in out):
            out.append(k)
    # what is left of the run between them
    left, at = [], s
    for _, a, b, _ in sorted(out, key=lambda x: x[1]):
        left.append((at, a))
        at = max(at, b)
    for a, b in [*left, (at, e)]:
        out += _assigned(raw, a, b)
    return out


def _assigned(raw: bytes, s: int, e: int) -> list[tuple[str, int, int, str]]:
    """Random bytes of raw[s:e] to which a name of secrets is given."""
    out = []
    at = s
    for piece in re.split(rb"(?<![=])=+(?=[^=])|\.", raw[s:e]) if e > s else ():
        at = raw.index(piece, at) if piece else at
        end = at + len(piece)
        if len(piece) >= MIN_RUN:
            as_hex = bytes.fromhex(piece.decode()) if _HEX.match(piece) else None
            as_64 = None if as_hex else unbase64(piece)
            if (as_hex or as_64) and _NAMED.search(raw[max(0, at - _BEFORE) : at]):
                got = as_hex or as_64 or b""
                ok = len(got) in KEY_BYTES and random_looking(got) if as_hex else len(got) >= 15 and random_looking(got) and _entropy(piece) > 3.5 and any(48 <= b < 58 for b in piece)
                if ok:
                    out.append(("assigned_key", at, end, f"{'hex' if as_hex else 'base64'} {len(got)} bytes"))
        at = end
    return out


def pem_blocks(raw: bytes) -> list[tuple[str, int, int, str]]:
    out = []
    for m in _PEM.finditer(raw):
        lines = [x.strip() for x in re.split(rb"\\n|\\r|\s+", m[2])]
        got = unbase64(b"".join(x for x in lines if x and b":" not in x and b"," not in x))
        enc = b"Proc-Type:" in m[2] and b"ENCRYPTED" in m[2] or b"DEK-Info" in m[2]
        kind = key_kind(got) or ("encrypted_private_key" if enc and got and len(got) % 8 == 0 and got else None)
        if kind:
            out.append((kind, m.start(), m.end(), "pem"))
    return out


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of runs of MIN_RUN candidate characters or more, with a digit among them."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = _RUN[data]
    edge = np.zeros(len(data) + 2, bool)
    edge[1 + off[:-1][off[:-1] < len(data)]] = True
    s = np.flatnonzero(m[1:-1] & (~m[:-2] | edge[1:-1]))
    e = np.flatnonzero(m[1:-1] & (~m[2:] | edge[2:])) + 1
    long = e - s >= MIN_RUN
    s, e = s[long], e[long]
    d = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    has = d[e] > d[s]
    s, e = s[has], e[has]
    return s, e, np.searchsorted(off, s, "right") - 1


def scan_text(raw: bytes, runs: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int, str]]:
    """Secrets of one text as (kind, start, end, detail), byte offsets, in order, not overlapping."""
    if runs is None:
        data = np.frombuffer(raw, np.uint8)
        s, e, _ = candidates(data, np.array([0, len(raw)]))
        runs = list(zip(s.tolist(), e.tolist(), strict=True))
    found = pem_blocks(raw) if b"-----BEGIN" in raw else []
    for s, e in runs:
        if not any(a <= s < b for _, a, b, _ in found):
            found += scan_run(raw, s, e)
    return sorted(found, key=lambda x: x[1])


def _rows(column: pa.Array):
    """(row, bytes of the row, secrets) of each row that has any."""
    data, off = buffers(column)
    s, e, row = candidates(data, off)
    raw = data.tobytes()
    by_row: dict[int, list[tuple[int, int]]] = {}
    for a, b, r in zip(s.tolist(), e.tolist(), row.tolist(), strict=True):
        by_row.setdefault(r, []).append((a, b))
    at = raw.find(b"-----BEGIN")
    while at >= 0:
        by_row.setdefault(int(np.searchsorted(off, at, "right") - 1), [])
        at = raw.find(b"-----BEGIN", at + 1)
    for r in sorted(by_row):
        text = raw[off[r] : off[r + 1]]
        if found := scan_text(text, [(a - int(off[r]), b - int(off[r])) for a, b in by_row[r]]):
            yield r, text, found


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed secret: kind, start and length in characters, detail, SHA-256 of the secret.

    The secret itself isn't returned. Keys are found wherever their encoding begins, next to other
    secrets or in a longer run, and over line ends; their nested lengths say where they end. Narrow: no
    shuffle. Null and empty texts have none, very long ones are scanned whole; a repeated row reports
    its secrets again; a null id is carried, ids are cast to long; an empty table gives an empty
    result; other columns are ignored.
    """

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, rows = part.column(0), []
            for r, text, found in _rows(part.column(1)):
                for kind, s, e, detail in found:
                    start = len(text[:s].decode("utf-8", "replace"))
                    rows.append((ids[r].as_py(), kind, start, len(text[s:e].decode("utf-8", "replace")), detail, hashlib.sha256(text[s:e]).hexdigest()))
            if not rows:
                return None
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return run

    return by_slice(two(df, id_col, text_col), make, SCHEMA)


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each confirmed secret replaced by ``[SECRET:kind]``; all rows and columns stay.

    Null and empty texts stay as they are, as do ids, null or repeated; repeated rows are treated alike,
    an empty table stays empty, and very long texts are scanned whole.
    """
    names = df.columns
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    k = names.index(text_col)

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            column = part.column(k)
            new: dict[int, str] = {}
            for r, text, found in _rows(column):
                out, at = [], 0
                for kind, s, e, _ in found:
                    out += [text[at:s], f"[SECRET:{kind}]".encode()]
                    at = e
                new[r] = b"".join([*out, text[at:]]).decode("utf-8", "replace")
            if not new:
                return part
            texts = pa.array([new.get(i, x.as_py()) if i in new else x.as_py() for i, x in enumerate(column)], column.type)
            return pa.RecordBatch.from_arrays([texts if i == k else part.column(i) for i in range(part.num_columns)], schema=part.schema)

        return run

    out = by_slice(inner, make, inner.schema, f"c{k}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
