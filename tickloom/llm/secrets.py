"""Secret scan with structural confirmation.

Three base patterns report what they match.  Beyond them, base64 and hex
candidates are decoded and reported only if the bytes parse as a private key
(DER or OpenSSH, every nested length exact) and dotted candidates only if they
are signed tokens whose header and payload parse.  Public keys, certificates,
digests and random strings don't confirm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import append_arrow, spare, texts_of

KINDS = ("assign", "access", "hex", "jwt", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is [0-9a-f]+ of 24 or more
DOTTED = re.compile(r"[A-Za-z0-9_.-]++")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
# A base64 run that goes on in the next lines; line ends may be escaped.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40,}+(?:[\x20\t]*+(?:\\r)?(?:\\n|\r?\n)[\x20\t]*+[A-Za-z0-9+/]++)++={0,2}")
LINE = re.compile(r"\\[rn]|([A-Za-z0-9+/]+)")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0x)?((?:[0-9a-f]{2}){24,}+)(?![0-9A-Za-z])", re.I | re.A)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\x00-\x7f])*)-----END \1-----")
LINE_END = re.compile(r"\\r|\\n|[\r\n]+")
DEK = re.compile(r"DEK-Info:\x20*[A-Za-z0-9-]+,([0-9A-Fa-f]{16,32})", re.A)
# Letters of the shortest header that names an algorithm, {"alg":""}, are 14.
LEAST_HEADER = 14
# How the base64 of a JSON object begins: an opening brace, then a quote, a blank or a line end.
OBJECTS = (b"eyJ", b"eyA", b"ewo", b"ewk", b"ew0")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

# Shortest run of base64 letters that a confirmed candidate or a hex match holds.
MIN_RUN = 20
_RUN = bytes(97 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 32 for b in range(256))


def nested(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly, by DER lengths; else None."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data) or data[i] & 31 == 31:
            return None
        tag, size, i = data[i], data[i + 1], i + 2
        if size & 128:
            k = size & 127
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            size, i = int.from_bytes(data[i : i + k], "big"), i + k
            if size < 128:
                return None
        if i + size > len(data):
            return None
        out.append((tag, data[i : i + size]))
        i += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private key in one of its usual DER encodings."""
    top = nested(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or (parts := nested(top[0][1])) is None:
        return False
    tags = [t for t, _ in parts]
    if tags[:1] == [2]:
        version = parts[0][1]
        if len(version) != 1 or version[0] > 1:
            return False
        if set(tags) == {2}:  # RSA: nine integers; DSA: six
            return len(tags) in (6, 9) and len(parts[1][1]) >= 32
        if tags[1:3] == [0x30, 4]:  # PKCS#8: algorithm, then the key's own encoding
            alg = nested(parts[1][1])
            return bool(alg) and alg[0][0] == 6 and bool(parts[2][1])
        return tags[1:2] == [4] and version[0] == 1 and len(parts[1][1]) >= 16 and set(tags[2:]) <= {0xA0, 0xA1}  # EC
    if tags == [0x30, 4]:  # encrypted PKCS#8
        alg = nested(parts[0][1])
        return bool(alg) and alg[0][0] == 6 and len(parts[1][1]) >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file: counted strings that end where the data ends."""
    if not data.startswith(b"openssh-key-v1\x00"):
        return False
    at, fields = 15, []

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for _ in range(3):
        fields.append(string())
    if None in fields or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    rest = [string() for _ in range(keys + 1)]
    return None not in rest and at == len(data)


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_ssh_key(data)


def unbase64(text: str) -> bytes:
    """Either alphabet, padding optional; empty if it doesn't decode."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_pem_key(body: str) -> bool:
    """The body of a PEM block: a key, or an encrypted one with its cipher, vector and whole blocks."""
    lines = [x.strip() for x in LINE_END.split(body)]
    head = [x for x in lines if ":" in x]
    data = unbase64("".join("".join(x.split()) for x in lines if ":" not in x))
    if any(x.startswith("Proc-Type:") and x.endswith("ENCRYPTED") for x in head):
        return any(DEK.match(x) for x in head) and len(data) >= 32 and len(data) % 8 == 0
    return is_key(data)


def wrapped_key(run: str) -> int:
    """Where the key at the start of a run of base64 lines ends in it; 0 if there is none.

    A DER key says its own length, so lines after it don't matter; an OpenSSH key ends with a line.
    """
    lines = [(m.end(1), m[1]) for m in LINE.finditer(run) if m[1]]
    whole = "".join(x for _, x in lines)
    start = unbase64(whole[:8])
    if start[:1] == b"\x30" and len(start) == 6:
        k = start[1] & 127 if start[1] & 128 else 0
        if k > 4:
            return 0
        size = 2 + k + (int.from_bytes(start[2 : 2 + k], "big") if k else start[1])
        need = -(-size * 4 // 3)
        if need > len(whole) or not is_der_key(unbase64(whole[:need])[:size]):
            return 0
        used = 0
        for end, x in lines:
            used += len(x)
            if used >= need:
                end -= used - need
                return end + min(2, len(run) - end - len(run[end:].lstrip("=")))
    if whole.startswith("b3BlbnNzaC1rZXktdjEA"):
        for n in (len(lines), len(lines) - 1):
            if n and is_ssh_key(unbase64("".join(x for _, x in lines[:n]))):
                return len(run) if n == len(lines) else lines[n - 1][0]
    return 0


def tokens_of(text: str) -> Iterator[Span]:
    """Dotted runs of two or three parts that are signed tokens; the third may be empty."""
    for m in DOTTED.finditer(text):
        run = m[0].rstrip(".")
        parts = run.split(".", 3)
        if len(parts) == 2 and len(m[0]) > len(run):
            run += "."
        elif len(parts) != 3:
            continue
        if len(parts[0]) >= LEAST_HEADER and parts[1] and is_token(run):
            yield m.start(), m.start() + len(run), "jwt"


def is_token(text: str) -> bool:
    """A compact signed token: header object with an algorithm, payload object, signature of a fitting length."""
    head, body, signature = text.split(".")
    try:
        header, claims = json.loads(unbase64(head)), json.loads(unbase64(body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return not signature if header["alg"].lower() == "none" else len(unbase64(signature)) >= 32


Span = tuple[int, int, str]


def base_spans(text: str, data: bytes) -> Iterator[Span]:
    """The three base patterns; ``data`` is the text in UTF-8."""
    low = data.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield m.start(), m.end(), "assign"
    if b"AKIA" in data:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield m.start(), m.end(), "access"


def confirmed(text: str) -> Iterator[Span]:
    """Candidates that decode to a structure, found in time proportional to the text's length."""
    yield from tokens_of(text)
    blocks = [(m.start(), m.end(), "key") for m in PEM.finditer(text) if is_pem_key(m[2])]
    for m in WRAPPED.finditer(text):
        if size := wrapped_key(m[0]):
            blocks.append((m.start(), m.start() + size, "key"))
    inside: list[Span] = []
    for block in sorted(blocks):
        if not inside or block[0] >= inside[-1][1]:
            inside.append(block)
    yield from inside
    for rx, group, decode in ((BASE64, 0, unbase64), (ANY_HEX, 1, bytes.fromhex)):
        at = 0
        for m in rx.finditer(text):
            while at < len(inside) and inside[at][1] <= m.start(group):
                at += 1
            if (at == len(inside) or m.start(group) < inside[at][0]) and is_key(decode(m[group])):
                yield m.start(group), m.end(group), "key"


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, in code points, each by start and kind."""
    data = text.encode()
    base, added = list(base_spans(text, data)), []
    # Everything else but short tokens holds a long run of base64 letters; most texts have none.
    if b"a" * MIN_RUN in data.translate(_RUN):
        base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        added = list(confirmed(text))
    elif "-----BEGIN " in text:
        added = list(confirmed(text))
    elif any(x in data for x in OBJECTS):
        added = list(tokens_of(text))
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=order), sorted(set(added), key=order)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Append n_assign, n_access, n_hex (long), base_sha256 and spans; null text is empty, without spans.

    Repeated rows repeat; a new column whose name is taken gets underscores.  No shuffle.
    """

    def make():
        def fn(column: pa.Array):
            base, added = zip(*[scan(t) for t in texts_of(column)]) if len(column) else ((), ())
            order = lambda s: (s[0], KINDS.index(s[2]), s[1])
            out = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
            out.append(pa.array([hashlib.sha256(spelled(b).encode()).hexdigest() for b in base], pa.string()))
            out.append(pa.array([spelled(sorted([*b, *a], key=order)) for b, a in zip(base, added)], pa.string()))
            return out

        return fn

    fields = [(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [("base_sha256", T.StringType()), ("spans", T.StringType())]
    return append_arrow(df, [text], fields, make)


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of ``text`` replaced; a null text stays null, other columns stay."""

    def make():
        def fn(column: pa.Array):
            texts = column.to_pylist()
            found = [t and (lambda s: s[0] + s[1])(scan(t)) for t in texts]
            return [pa.array([redact(t, s, mark) if s else t for t, s in zip(texts, found)], pa.string())]

        return fn

    name = spare(df, "clean")
    out = append_arrow(df, [text], [(name, T.StringType())], make)
    return out.select(*[F.col(name).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
