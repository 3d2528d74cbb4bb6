"""Secrets: pattern matches, and encoded keys and signed tokens confirmed by their structure.

Three base kinds are plain patterns. The method adds spans only after decoding a candidate:
``pem`` and ``der`` parse nested tag-length-value lengths that must end exactly (``pem`` also
sealed bodies of whole cipher blocks and armoured packets with their checksum), ``ssh`` the nested
32-bit lengths of an openssh-key-v1 body, ``jwt`` a signed token's header and claims, and
``coded`` base64 or hex that decodes to a text with a base secret in it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks

KINDS = ("assign", "access", "hex", "pem", "ssh", "der", "jwt", "coded")
# Fixed patterns of the base kinds. With re.ASCII "either case" means A-Z and a-z alone.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # any run of 32 or more begins where a run begins
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
_SEALED = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s+Proc-Type:\x204,ENCRYPTED\s+DEK-Info:\x20([A-Z0-9-]+),([0-9A-Fa-f]+)\s+([A-Za-z0-9+/=\s]+)-----END \1-----"
)
_PGP = re.compile(r"-----BEGIN PGP PRIVATE KEY BLOCK-----[\x20\t]*\r?\n((?:[A-Za-z]+:\x20.*\n)*)\s*([A-Za-z0-9+/\s]+=*)\s+=([A-Za-z0-9+/]{4})\s+-----END PGP PRIVATE KEY BLOCK-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# The shortest base match, "token:" and 8 more, has 14 bytes: 19 base64 characters or 28 hex digits.
_RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}={0,2}")
_RUNHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){14,}(?![0-9A-Fa-f])")
_NO_UTF8 = re.compile("[\udc80-\udcff]")
_NEXT64 = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})(?!\S)")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, in code points."""
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in _HEX_LONG.finditer(text)]
    return out


def decode64(run: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 with or without padding; None if it isn't."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, body) of consecutive DER items that fill ``data`` exactly; None if lengths don't nest."""
    at, items = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20 and (depth > 8 or der_items(body, depth + 1) is None):
            return None
        items.append((tag, body))
        at += size
    return items


def is_private_der(data: bytes) -> bool:
    """A SEQUENCE of a small version INTEGER and either key numbers (RSA, DSA), a key OCTET STRING (EC), or an algorithm and a key (PKCS #8)."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(top[0][1]) or []
    if len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == 0x30 and tags[1] == 0x04 and len(inner) == 2:  # encrypted PKCS #8
        return len(inner[1][1]) >= 16
    if tags[0] != 0x02 or len(inner[0][1]) != 1:
        return False
    numbers = len(inner) >= 6 and all(t == 0x02 for t in tags)
    return numbers or tags[1] == 0x04 and len(inner[1][1]) >= 16 or len(inner) >= 3 and tags[1] == 0x30 and tags[2] == 0x04


def is_ssh_key(data: bytes) -> bool:
    """An openssh-key-v1 body whose nested 32-bit lengths end exactly."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, parts = len(magic), 0

    def field(at: int) -> int:
        size = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else -1
        return at + 4 + size if 0 <= size <= len(data) - at - 4 else -1

    for _ in range(3):  # cipher, key derivation, its options
        if (at := field(at)) < 0:
            return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for parts in range(keys + 1):  # public keys, then the private block
        if parts > 64 or (at := field(at)) < 0:
            return False
    return keys > 0 and at == len(data)


def is_sealed_key(iv: str, body: str) -> bool:
    """An encrypted body of whole cipher blocks, whose initial vector has 8 or 16 bytes."""
    data = decode64(re.sub(r"\s", "", body))
    return len(iv) in (16, 32) and bool(data) and len(data) % (len(iv) // 2) == 0


def is_pgp_key(body: str, check: str) -> bool:
    """An armoured body with its right 24-bit checksum that begins with a secret-key packet whose length fits."""
    data, want = decode64(re.sub(r"\s", "", body)), decode64(check)
    if not data or not want or len(data) < 8:
        return False
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = (crc << 1) ^ (0x1864CFB if crc & 0x800000 else 0)
    if crc != int.from_bytes(want, "big") or not data[0] & 0x80:
        return False
    if data[0] & 0x40:  # the newer form: a tag of 6 bits, then a length of 1, 2 or 5 bytes
        n = data[1]
        size, head = (n, 2) if n < 192 else ((n - 192 << 8) + data[2] + 192, 3) if n < 224 else (int.from_bytes(data[2:6], "big"), 6)
        return data[0] & 0x3F == 5 and head + size <= len(data)
    head = 1 << (data[0] & 3)
    return data[0] >> 2 & 15 == 5 and head < 8 and 1 + head + int.from_bytes(data[1 : 1 + head], "big") <= len(data)


def is_signed_token(header: str, claims: str) -> bool:
    """A header object that names its algorithm and claims that are an object."""
    try:
        head, body = (json.loads(decode64(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _hides_secret(data: bytes) -> bool:
    try:
        return bool(base_spans(data.decode()))
    except UnicodeDecodeError:
        return False


def _first_hiding(lines: list[str]) -> int | None:
    """The first of ``lines``, from which on two or more decode to a text that hides a secret; all but the last have one length.

    Lines that begin at whole groups of four characters are decoded together, and the text begins
    after the last byte that is no UTF-8, so the time is linear in the lines' characters.
    """
    apart = 4 // math.gcd(len(lines[0]), 4)
    step = apart * len(lines[0]) // 4 * 3
    found = []
    for first in range(min(apart, len(lines) - 1)):
        data = decode64("".join(lines[first:]))
        if data is None:
            continue
        shown = data.decode(errors="surrogateescape")[::-1]
        broken = _NO_UTF8.search(shown)
        at = -(-(len(data) - len(shown[: broken.start()].encode()) if broken else 0) // step)
        while at * step < len(data) and data[at * step] & 0xC0 == 0x80:
            at += 1
        line = first + at * apart
        if line < len(lines) - 1 and _hides_secret(data[at * step :]):
            found.append(line)
    return min(found, default=None)


def wrapped_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of base64 over lines of one length, the last of which may be shorter: where it hides a secret."""
    out, past = [], 0
    for start, end in runs:
        if start < past:
            continue
        parts, spans = [text[start:end]], [(start, end)]
        while len(parts[-1]) == len(parts[0]) and parts[-1][-1] != "=" and (m := _NEXT64.match(text, spans[-1][1])) and len(m[1]) <= len(parts[0]):
            parts.append(m[1])
            spans.append(m.span(1))
        whole = len(parts) - (len(parts[-1]) < len(parts[0]))
        past = spans[whole - 1][1]
        for n in dict.fromkeys((len(parts), whole)):  # a shorter line may be no part of it
            if n > 1 and (line := _first_hiding(parts[:n])) is not None:
                past = spans[n - 1][1]
                out.append((spans[line][0], past))
                break
    return out


def _outside(spans: list[tuple[int, int]]):
    """Whether a place is outside all of ``spans``."""
    starts, ends = [], []
    for s, e in sorted(spans):
        starts.append(s)
        ends.append(max(e, ends[-1]) if ends else e)
    return lambda at: not starts or (k := bisect_right(starts, at)) == 0 or at >= ends[k - 1]


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the candidates whose structure holds."""
    out = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            data = decode64(re.sub(r"\s|\\n|\\r", "", m[2]))
            if data and (is_private_der(data) or is_ssh_key(data)):
                out.append((m.start(), "pem", m.end()))
        out += [(m.start(), "pem", m.end()) for m in _SEALED.finditer(text) if is_sealed_key(m[3], m[4])]
        out += [(m.start(), "pem", m.end()) for m in _PGP.finditer(text) if is_pgp_key(m[2], m[3])]
    if "eyJ" in text:
        out += [(m.start(), "jwt", m.end()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    free = _outside([(s, e) for s, k, e in out if k == "pem"])
    runs = [m for m in _RUN64.finditer(text) if free(m.start())]
    wrapped = wrapped_spans(text, [m.span() for m in runs])
    out += [(s, "coded", e) for s, e in wrapped]
    free = _outside(wrapped)
    for m in runs:
        if not free(m.start()):
            continue
        data = decode64(m[0])
        if data is None:
            continue
        if is_ssh_key(data):
            out.append((m.start(), "ssh", m.end()))
        elif len(data) >= 32 and is_private_der(data):
            out.append((m.start(), "der", m.end()))
        elif _hides_secret(data):
            out.append((m.start(), "coded", m.end()))
    for m in _RUNHEX.finditer(text):
        data = bytes.fromhex(m[0])
        if len(data) >= 32 and is_private_der(data):
            out.append((m.start(), "der", m.end()))
        elif _hides_secret(data):
            out.append((m.start(), "coded", m.end()))
    return out


def listed(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for part in chunks(batches):
        rows = []
        for doc_id, text in zip(part["doc_id"], part["text"]):
            text = text or ""
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, listed(base + confirmed_spans(text))))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 3 else pa.int64()) for i, c in enumerate(zip(*rows))], names)


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets of each document: counts and digest of the base kinds, and all spans.

    A null or empty text has none. Repeated rows give repeated results; other columns are not
    read. Texts are scanned whole; nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


