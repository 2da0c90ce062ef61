"""Secret scan with structural confirmation.

Plain patterns find assignments, access keys and long hexadecimal runs.  Runs of base64 or
hexadecimal characters and PEM blocks are only *candidates*: they are decoded, and a span is
reported when the bytes parse as a key encoding (nested DER lengths that add up, an OpenSSH
private key with its length-prefixed fields) or as a signed token whose header names an
algorithm that signs.  PEM blocks may have header lines and escaped line breaks, as in JSON
files, and base64 may be wrapped over lines without any marks.

Defined results: a null text counts as empty; empty texts give no spans; repeated rows are
scanned one by one; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
_HEADER = re.compile(r"(?<![A-Za-z0-9])eyJ")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----")
#: Base64 that is wrapped over lines; a line may end with the two characters of an escaped break.
_BREAK = r"(?:\\r)?(?:\\n|\r?\n)"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{{40,}}+(?:{_BREAK}[A-Za-z0-9+/]++)++={{0,2}}")
_LINES = re.compile(_BREAK)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{64,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{96,}")

_SEQUENCE, _INTEGER, _OCTETS, _OID = 0x30, 0x02, 0x04, 0x06
_SSH_MAGIC = b"openssh-key-v1\0"


def _decode64(text: str) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at ``at``; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``data[at:end]`` exactly."""
    found = []
    while at < end:
        element = _tlv(data, at, end)
        if element is None:
            return None
        found.append(element)
        at = element[2]
    return found


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one of the DER private key structures.

    PKCS#1 (a version and eight more integers), SEC 1 (version 1 and an octet string) and
    PKCS#8 (a version, an algorithm identifier with an object identifier, an octet string).
    """
    outer = _tlv(data, 0, len(data))
    if outer is None or outer[0] != _SEQUENCE or outer[2] != len(data):
        return False
    parts = _children(data, outer[1], outer[2])
    if not parts or len(parts) < 2 or parts[0][0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    tags = [p[0] for p in parts]
    if tags == [_INTEGER] * 9:
        return True
    if tags[1] == _OCTETS and data[parts[0][1]] == 1:
        return True
    if len(parts) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        algorithm = _children(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == _OID
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key: its magic, then strings whose lengths fit."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and int.from_bytes(data[at : at + 4], "big") >= 1


def is_encrypted_key(data: bytes) -> bool:
    """Whether ``data`` is an encrypted PKCS#8 key: an algorithm identifier and an octet string."""
    outer = _tlv(data, 0, len(data))
    if outer is None or outer[0] != _SEQUENCE or outer[2] != len(data):
        return False
    parts = _children(data, outer[1], outer[2])
    if not parts or [p[0] for p in parts] != [_SEQUENCE, _OCTETS]:
        return False
    algorithm = _children(data, parts[0][1], parts[0][2])
    return bool(algorithm) and algorithm[0][0] == _OID


def _json_object(part: str) -> dict | None:
    raw = _decode64(part)
    try:
        found = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, payload: str, signature: str = "c2ln") -> bool:
    """Whether header and payload are base64url JSON objects, the header names an algorithm that signs, and there is a signature."""
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and bool(_decode64(signature)) and _json_object(payload) is not None


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens.  A header may follow any character but a letter or digit."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        at, past = run.start(), 0
        for k, part in enumerate(parts[:-2]):
            if k >= past and "eyJ" in part and _json_object(parts[k + 1]) is not None:
                for m in _HEADER.finditer(part):
                    if is_signed_token(part[m.start() :], parts[k + 1], parts[k + 2]):
                        yield at + m.start(), at + len(part) + len(parts[k + 1]) + len(parts[k + 2]) + 2
                        past = k + 3
                        break
            at += len(part) + 1


def _pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PEM blocks that hold a private key, also with header lines and escaped line breaks."""
    for m in _PEM.finditer(text):
        stop = text.find("-----", m.end())
        tail = f"-----END {m[1]}-----"
        if stop < 0 or "PRIVATE KEY" not in m[1] or not text.startswith(tail, stop):
            continue
        lines = [x.strip() for x in _LINES.split(text[m.end() : stop])]
        headers = [x for x in lines if ":" in x]
        body = _decode64("".join("".join(x.split()) for x in lines if ":" not in x))
        sealed = any("ENCRYPTED" in h for h in headers) and any(h.startswith("DEK-Info:") for h in headers)
        if body and (_key_kind(body) or is_encrypted_key(body) or sealed and len(body) % 8 == 0):
            yield m.start(), stop + len(tail)


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of keys in base64 that is wrapped over lines.  The key's own length tells the line on which it ends."""
    for m in _WRAPPED.finditer(text):
        body = _LINES.sub("", m[0])
        head = _decode64(body[:16])
        outer = _tlv(head, 0, 1 << 32) if head else None
        if outer and outer[0] == _SEQUENCE:
            body = body[: -(-outer[2] // 3) * 4]
        kind = _key_kind(_decode64(body))
        if kind is None:
            continue
        end, left = m.start(), len(body)
        for line in _LINES.finditer(m[0] + "\n"):
            size = m.start() + line.start() - end
            if left <= size:
                break
            left -= size
            end = m.start() + line.end()
        yield m.start(), end + left, kind


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_der_key(data):
        return "der"
    return "ssh" if is_ssh_key(data) else None


def _within(at: int, spans: list[tuple[int, int]]) -> bool:
    k = bisect_right(spans, (at, sys.maxsize)) - 1
    return k >= 0 and at < spans[k][1]


def scan_text(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end, kind) of every span of one text, in that order."""
    found: list[tuple[int, int, int, str]] = []

    def add(kind: str, start: int, end: int) -> None:
        found.append((start, KINDS.index(kind), end, kind))

    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                add("assign", *m.span())
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 16:
                add("access", *m.span())
    for m in _HEX.finditer(text):
        add("hex", *m.span())
    if "eyJ" in text:
        for start, end in _tokens(text):
            add("jwt", start, end)
    inside: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for start, end in _pem_blocks(text):
            add("pem", start, end)
            inside.append((start, end))
    blocks = len(inside)
    for start, end, kind in _wrapped(text):
        if not _within(start, inside[:blocks]):
            add(kind, start, end)
            inside.append((start, end))
    inside.sort()
    for m in _BASE64.finditer(text):
        if not _within(m.start(), inside) and (kind := _key_kind(_decode64(m[0]))):
            add(kind, *m.span())
    for m in _HEX_ANY.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
            add(kind, *m.span())
    found.sort()
    return found


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = scan_text(text or "")
            count = dict.fromkeys(KINDS, 0)
            for span in spans:
                count[span[3]] += 1
            base = _joined([s for s in spans if s[3] in BASE_KINDS])
            rows.append((*count.values(), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
        out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
        out.insert(0, "id", batch["id"].array)
        yield out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, counts by kind, a digest of the base spans, all spans."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(
        _scan, f"id string, {counts}, base_sha256 string, spans string"
    )
    first = [f"n_{k}" for k in BASE_KINDS]
    rest = [f"n_{k}" for k in KINDS if k not in BASE_KINDS]
    return found.select(F.col("id").cast(id_type).alias(id_col), *first, "base_sha256", "spans", *rest)
