"""Secret scan with structural confirmation.

Three base patterns report by their form.  Beyond them, base64 and hex
candidates are decoded and reported only when their structure confirms them:
DER private keys (nested lengths that fit exactly and the fields of a key
encoding), OpenSSH private keys (nested length-prefixed strings) and signed
tokens (a JSON header that names its algorithm and a JSON payload).
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import map_texts, texts
from utterscope.llm.rows import recount, replace_texts

# The base patterns (kind, pattern, group whose length counts,
# least length).
BASE = [
    ("assign", re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
                          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                          "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
CONFIRMED = ["der_key", "ssh_key", "signed_token"]
KINDS = [k for k, *_ in BASE] + CONFIRMED

_HEX = re.compile(r"[0-9a-f]{16,}")  # the same as runs of any length, then the long ones
# how a key in base64 begins, its lines, and what may stand between them: a
# line break, written out or not, and indentation
_KEY = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-Za-z0-9+/_-]{23}|b3Bl[A-Za-z0-9+/_-]{20})")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAK = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*(?=[A-Za-z0-9+/_-])")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{40,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")

SEQUENCE, INTEGER, OCTETS, OID, CONTEXT_0 = 0x30, 0x02, 0x04, 0x06, 0xA0


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one private key: PKCS#1, PKCS#8 (plain or
    encrypted), SEC1 or DSA."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    fields = der_items(outer[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]

    def algorithm(content: bytes) -> bool:
        inner = der_items(content)
        return bool(inner) and inner[0][0] == OID and len(inner[0][1]) > 0

    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        return algorithm(fields[0][1]) and len(fields[1][1]) >= 16
    if tags[0] != INTEGER or fields[0][1] not in (b"\x00", b"\x01"):
        return False
    if len(tags) >= 6 and all(t == INTEGER and c for t, c in fields):  # DSA has 6 numbers, RSA 9
        return len(tags) in (6, 9) and len(fields[1][1]) >= 32
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8
        return algorithm(fields[1][1]) and len(fields[2][1]) >= 16
    return tags[1] == OCTETS and len(fields[1][1]) >= 16 and all(t in (CONTEXT_0, 0xA1) for t in tags[2:])  # SEC1


def ssh_key_size(data: bytes) -> int:
    """The size of the OpenSSH private key that ``data`` begins with (the
    magic string, then cipher, key derivation, options, key count, as many
    public keys and the private part), 0 if it begins with none, or, negative,
    how many bytes it takes to go on reading."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic[:len(data)]):
        return 0
    at, part, keys = len(magic), 0, 1
    while part < 5 + keys:
        if at + 4 > len(data):
            return -(at + 4)
        size, at = int.from_bytes(data[at:at + 4], "big"), at + 4
        if part == 3:
            keys = size
            if not keys:
                return 0
        elif size > MAX_KEY or (part > 3 and not size):
            return 0
        else:
            if part < 2 and not data[at:at + size].isascii():
                return 0
            at += size
        part += 1
    return at if at <= len(data) else -at


def der_key_size(data: bytes) -> int:
    """The size of the DER value that ``data`` begins with, if it may be a
    private key: a sequence that begins with version 0 or 1 or a sequence."""
    if len(data) < 8 or data[0] != SEQUENCE:
        return 0
    width = data[1] & 0x7F if data[1] >= 0x80 else 0
    if data[1] == 0x80 or width > 4:
        return 0
    size = int.from_bytes(data[2:2 + width], "big") if width else data[1]
    inner = data[2 + width:5 + width]
    known = inner[:1] == bytes([SEQUENCE]) or inner in (b"\x02\x01\x00", b"\x02\x01\x01")
    return 2 + width + size if known and size <= MAX_KEY else 0


MAX_KEY = 1 << 20  # bytes of a private key: many times the largest in use


def key_at(text: str, start: int) -> tuple[int, str] | None:
    """(end, kind) of the private key in base64 that begins at ``start``.

    Its first bytes tell its length, so no more than the key is read, and
    once.  It must end where a line does; padding belongs to it.
    """
    head = unbase64(text[start:start + 24])
    if head is None:
        return None
    kind = "der_key" if head[0] == SEQUENCE else "ssh_key"
    size = der_key_size(head) if kind == "der_key" else ssh_key_size(head)
    while size:
        want = -(-abs(size) * 8 // 6)
        parts, have, at = [], 0, start
        while True:
            line = _LINE.match(text, at)
            if not line:
                return None
            parts.append(line.group()[:want - have])
            have, at = have + len(parts[-1]), at + len(parts[-1])
            if have == want:
                break
            gap = _BREAK.match(text, at)
            if not gap:
                return None
            at = gap.end()
        data = unbase64("".join(parts))
        if data is None:
            return None
        if size > 0:
            if at < line.end() or (kind == "der_key" and not is_der_key(data[:size])):
                return None
            while at < len(text) and text[at] == "=" and at - line.end() < -want % 4:
                at += 1
            return at, kind
        size = ssh_key_size(data)
    return None


def unbase64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, with or without padding."""
    body = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """Whether two base64url parts are the JSON header, naming its algorithm,
    and the JSON payload of a signed token."""
    read = []
    for part in (header, payload):
        try:
            read.append(json.loads(unbase64(part) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in read) and isinstance(read[0].get("alg"), str)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in code points, by start and kind."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    for m in _JWT.finditer(text):
        if is_signed_token(m.group(1), m.group(2)):
            found.append((m.start(), m.end(), "signed_token"))
    at = 0
    while m := _KEY.search(text, at):
        key = key_at(text, m.start())
        if key:
            found.append((m.start(), *key))
        at = key[0] if key else m.end()
    for m in _HEX_KEY.finditer(text):
        if len(m.group()) % 2 == 0 and is_der_key(bytes.fromhex(m.group())):
            found.append((m.start(), m.end(), "der_key"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kinds, starts, ends): the secrets of every whole text, as
    parallel arrays by start and kind, in code points, ends exclusive.

    A null or empty text has none; null ids, repeated rows and empty tables
    stay; other columns are left out.  Row-wise: nothing is shuffled.
    """
    def batch(ids: list, values: list) -> dict:
        spans = [find_spans(t) for t in values]
        return {"doc_id": pa.array(ids, type=pa.int64()),
                "kinds": pa.array([[s[2] for s in x] for x in spans], type=pa.list_(pa.string())),
                "starts": pa.array([[s[0] for s in x] for x in spans], type=pa.list_(pa.int64())),
                "ends": pa.array([[s[1] for s in x] for x in spans], type=pa.list_(pa.int64()))}

    return map_texts(texts(docs, id_col, text_col), batch,
                     "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every maximal run of secret spans replaced by ``mark``."""
    out, at, until = [], 0, -1
    for start, end, _ in find_spans(text):
        if start >= until:
            out += [text[at:start], mark]
        until = at = max(until, end)
    return "".join(out) + text[at:] if out else text


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets``: (doc_id, n_assign, n_access,
    n_hex, base_sha256, spans)."""
    at = F.arrays_zip("kinds", "starts", "ends")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")

    def number(kind: str):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    base = [k for k, *_ in BASE]
    return scanned.select(
        "doc_id",
        *map(number, base),
        F.sha2(joined(F.filter(at, lambda s: s["kinds"].isin(base))), 256).alias("base_sha256"),
        joined(at).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with secrets in the text replaced by ``mark``;
    ``n_chars`` follows if there is one."""
    return recount(replace_texts(docs, text_col, lambda t: redact_text(t, mark)), text_col)
