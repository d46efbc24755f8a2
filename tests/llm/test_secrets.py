import base64
import hashlib
import json
import random
import zlib

from provlake.llm import secrets

B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


def number(x):
    return der(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))


R = random.Random(3)
RSA = der(0x30, b"".join(map(number, [0, R.getrandbits(1024) | 1 << 1023, 65537, *[R.getrandbits(512) | 1 for _ in range(6)]])))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))
EC = der(0x30, number(1) + der(4, R.randbytes(32)) + der(0xA0, der(6, b"\x2b\x81\x04\x00\x0a")))


def ssh():
    s = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(R.randbytes(51)) + s(R.randbytes(120))


def jwt(alg="HS256", size=32):
    e = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return ".".join([e(json.dumps({"alg": alg, "typ": "JWT"}).encode()), e(json.dumps({"sub": "12345", "name": "someone"}).encode()), e(R.randbytes(size))])


def access(good=True):
    body = "".join(R.choice(B62) for _ in range(30))
    n, code = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        code = B62[k] + code
    return "ghp_" + body + (code if good else code[::-1])


def pem(raw, kind="RSA PRIVATE KEY"):
    b = base64.b64encode(raw).decode()
    return f"-----BEGIN {kind}-----\n" + "\n".join(b[i : i + 64] for i in range(0, len(b), 64)) + f"\n-----END {kind}-----"


KEY = R.randbytes(32)
FOUND = {
    pem(RSA): "rsa_private_key", pem(PKCS8, "PRIVATE KEY"): "pkcs8_private_key", pem(EC, "EC PRIVATE KEY"): "ec_private_key", pem(ssh(), "OPENSSH PRIVATE KEY"): "openssh_private_key",
    "key " + base64.b64encode(RSA).decode() + " end": "rsa_private_key", "hex " + EC.hex() + " end": "ec_private_key", f"see {jwt()} there": "signed_token", f"a {access()} b": "access_token",
    f"api_key = '{KEY.hex()}'": "assigned_key", f"SECRET={base64.b64encode(KEY).decode()}": "assigned_key",
}
CLEAN = ["", "plain words only", "sha256 of it: " + KEY.hex(), "x" * 500, pem(RSA[:-1]), pem(b"no key at all, just text here"), f"tok {access(False)} no", jwt().replace(".", " "), jwt("HS256", 31), "token = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", base64.b64encode(RSA[:5] + b"\0" + RSA[5:]).decode(), "password: " + "correcthorsebatterystaple" * 2, "https://example.org/" + "a1b2" * 30]


def test_kinds_are_confirmed_and_others_left():
    for text, kind in FOUND.items():
        got = secrets.scan_text(text.encode())
        assert [g[0] for g in got] == [kind], (text, got)
    for text in CLEAN:
        assert not secrets.scan_text(text.encode()), text


def test_scan_and_redaction(spark):
    every = list(FOUND)
    rows = [(i, "é words before " + t + " after", 1) for i, t in enumerate(every)] + [(100 + i, t, 1) for i, t in enumerate(CLEAN)] + [(None, every[6], 1), (200, None, 1), (3, "é words before " + every[3] + " after", 1), (201, "long word " * 30000 + every[6] + " tail", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = [tuple(x) for x in secrets.secret_scan(df).collect()]
    text = {r[0]: r[1] for r in rows}
    assert {g[0] for g in got} == {*range(len(every)), None, 201} and len(got) == len(every) + 3
    for d, kind, start, length, _, digest in got:
        assert hashlib.sha256(text[d][start : start + length].encode()).hexdigest() == digest
    red = {(x["doc_id"]): x["text"] for x in secrets.redacted(df).collect()}
    assert secrets.redacted(df).columns == df.columns and red[200] is None
    for i in range(len(every)):
        assert "[SECRET:" in red[i] and red[i].startswith("é words before") and red[i].endswith("after") and not secrets.scan_text(red[i].encode())
    assert all(red[100 + i] == t for i, t in enumerate(CLEAN))
    assert secrets.secret_scan(df.limit(0)).count() == 0 and secrets.redacted(df.limit(0)).count() == 0


def test_keys_next_to_tokens_and_in_longer_runs():
    key = base64.b64encode(RSA).decode().rstrip("=")
    wrapped = "\n".join(key[i : i + 64] for i in range(0, len(key), 64))
    ec, t = base64.b64encode(EC).decode().rstrip("="), jwt()
    for text, kinds in {
        f"{t}/{key}": ["signed_token", "rsa_private_key"],
        f"{t}.{key}": ["signed_token", "rsa_private_key"],
        f"{access()}.{ec} x": ["access_token", "ec_private_key"],
        f"path/to/{key}": ["rsa_private_key"],
        f"raw\n{wrapped}\nend": ["rsa_private_key"],
        f"{key}/{ec}": ["rsa_private_key", "ec_private_key"],
        f"aa{EC.hex()}00": ["ec_private_key"],
        f"raw {base64.b64encode(ssh()).decode()} end": ["openssh_private_key"],
        f"a_name_that_is_far_longer_than_thirty_characters_token = {KEY.hex()}": ["assigned_key"],
        f"auth: {base64.b64encode(R.randbytes(3000)).decode()}": ["assigned_key"],
    }.items():
        got = secrets.scan_text(text.encode())
        if text.startswith(f"{t}."):  # a token of four parts isn't one; the key in it is
            assert [g[0] for g in got] in (kinds, kinds[1:]), text[:40]
        else:
            assert [g[0] for g in got] == kinds, (text[:40], got)
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))


def _parses(raw):
    """The values of a DER sequence that fills raw, by a parser of its own; None if lengths don't add up."""

    def value(at, end):
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n > 127:
            k = n - 128
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        if at + n > end:
            raise IndexError
        return tag, at, at + n

    try:
        tag, a, b = value(0, len(raw))
        if tag != 0x30 or b != len(raw):
            return None
        out = []
        while a < b:
            t, x, a = value(a, b)
            out.append((t, raw[x:a]))
        return out
    except IndexError:
        return None


def test_embedded_keys_equal_brute_force():
    """Every stretch of characters that decodes to an elliptic-curve key, tried one by one."""
    r = random.Random(9)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for _ in range(12):
        key = base64.b64encode(der(0x30, number(1) + der(4, r.randbytes(r.choice([16, 24, 32]))))).decode().rstrip("=")
        if r.random() < 0.3:
            key = key[:6] + r.choice(chars) + key[7:]
        junk = lambda: "".join(r.choice(chars) for _ in range(r.randrange(20)))
        text = junk() + key + junk()
        want = set()
        for i in range(len(text)):
            for j in range(i + 20, len(text) + 1):
                if (j - i) % 4 == 1:
                    continue
                raw = base64.b64decode(text[i:j] + "=" * (-(j - i) % 4))
                kids = _parses(raw) if raw[:1] == b"0" else None
                if kids and len(kids) == 2 and kids[0] == (2, b"\x01") and kids[1][0] == 4 and 16 <= len(kids[1][1]) <= 66:
                    want.add(i)
        got = {s for kind, s, _, _ in secrets.embedded_keys(text.encode(), 0, len(text)) if kind == "ec_private_key"}
        assert got == want
