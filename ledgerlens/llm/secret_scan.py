"""Secret scans with structural confirmation.

Base matches are three patterns: assignments, access key ids and long hex runs. On top of
them the scan takes runs of base64 or hex characters, decodes what may be a key there and reports it
only if it is built like one: DER whose nested lengths fit (a private key's version number, integers
or algorithm inside one sequence, or an encrypted key's algorithm and octets), an OpenSSH key file's
length-prefixed fields, PEM armour around either, or a signed token whose first part is a
JSON header that names an algorithm. Nothing that fails is reported, and base matches stay whatever
the decoding says.

A run may be wrapped over lines, also with line ends written as escapes, and a key may begin and end anywhere
in it: behind a path, an 0x or another value. Its own outer length tells where it ends, so the span is
that of the key. A run that decodes to PEM armour, or as a whole to another run, is decoded once more.

Offsets are code points, ends exclusive. Edge cases: a null or empty text has no spans; every
text is scanned whole; a row's result depends on that row alone, so repeated rows repeat it; a null id stays null;
columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The base patterns and least lengths: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "token", "pem", "key", "hexkey")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
#: A line end as it is or as an escape.
BREAK = r"(?:\\r\\n|\\n|\r?\n)"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[rn])*)-----END \1-----")
BASE64_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{BREAK}[ \t]*[A-Za-z0-9+/_-]+)*={{0,2}}")
HEX_RUN = re.compile(rf"[0-9A-Fa-f]{{32,}}(?:{BREAK}[ \t]*[0-9A-Fa-f]{{16,}})*")
_BREAKS = re.compile(rf"{BREAK}[ \t]*")
LEAST_BYTES = 24
#: Where a key can begin in base64: a DER sequence, an OpenSSH file, PEM armour.
BEGIN64 = re.compile(r"M[C-I]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi")
BEGIN_HEX = re.compile(r"30|6f70656e7373682d6b65792d7631|2d2d2d2d2d424547494e", re.IGNORECASE)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, kinds array<string>, starts array<int>, ends array<int>"


def decode64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, with or without padding; None if it isn't base64."""
    raw = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill data exactly; None if lengths don't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _der_key(data: bytes) -> bool:
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags == [0x30, 0x04]:  # the algorithm and the octets of an encrypted key
        return _algorithm(inner[0][1]) and len(inner[1][1]) >= 16
    if tags[0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 1:
        return False
    if len(tags) >= 6 and all(t == 0x02 for t in tags[:6]):  # version and the integers of an RSA or DSA key
        return True
    if tags[1] == 0x04:  # version, then an elliptic-curve scalar
        return 16 <= len(inner[1][1]) <= 80
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # version, algorithm, wrapped key
        return _algorithm(inner[1][1])
    return False


def _algorithm(data: bytes) -> bool:
    """Whether data begins with an object identifier, as an algorithm does."""
    items = der_items(data)
    return bool(items) and items[0][0] == 0x06 and len(items[0][1]) >= 3


def _der_length(head: bytes) -> int:
    """The length of the DER sequence that head begins, header included, if a version or an algorithm comes first; else 0."""
    if len(head) < 8 or head[0] != 0x30:
        return 0
    n, at = head[1], 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return 0
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    first = head[at : at + 3]
    fits = first[:2] == b"\x02\x01" and first[2:] in (b"\0", b"\1") or first[:1] == b"\x30"
    return at + n if fits else 0


def _openssh_length(data: bytes) -> int:
    """The length of the OpenSSH key file that data begins; 0 if its fields don't fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at, keys = len(magic), 0

    def field(start: int) -> int:
        end = start + 4 + int.from_bytes(data[start : start + 4], "big")
        return end if start + 4 <= len(data) and end <= len(data) else 0

    for _ in range(3):  # cipher, derivation, its options
        if not (at := field(at)):
            return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= keys <= 16:
        return 0
    at += 4
    for _ in range(keys + 1):  # the public keys and the private part
        if not (at := field(at)):
            return 0
    return at


def key_like(data: bytes | None) -> bool:
    return bool(data) and len(data) >= LEAST_BYTES and (_der_key(data) or _openssh_length(data) == len(data))


def _signed_token(head: str) -> bool:
    try:
        parsed = json.loads(decode64(head) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _pem(text: str) -> list[tuple[int, int]]:
    """The armour in text that holds a key."""
    if "-----BEGIN" not in text:
        return []
    return [(m.start(), m.end()) for m in PEM.finditer(text) if key_like(decode64(re.sub(r"\s+|\\[rn]", "", m[2])))]


def _decode16(text: str) -> bytes | None:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _keys_in(run: str, begin: re.Pattern, decode, width: tuple[int, int], again: bool) -> list[tuple[int, int]]:
    """(start, end) of the keys in a run without breaks. width: so many characters hold so many bytes."""
    out, free, (chars, size) = [], 0, width
    at = lambda n: -(-n * chars // size)  # noqa: E731  the characters of n bytes
    for m in begin.finditer(run):
        start = m.start()
        if start < free:
            continue
        head = decode(run[start : start + at(24)].rstrip("=")) or b""
        if n := _der_length(head):
            data = decode(run[start : start + at(n)]) if start + at(n) <= len(run) else None
            found = (data or b"")[:n]
            end = start + at(n) if len(found) == n and key_like(found) else 0
        elif head.startswith((b"openssh-key-v1", b"-----BEGIN")):
            tail = run[start:].rstrip("=")
            data = decode(tail[: len(tail) // chars * chars] if len(tail) % chars == 1 else tail) or b""
            if head.startswith(b"open"):
                n = _openssh_length(data)
            else:
                armour = _pem(data.decode("latin-1")) if again else []
                n = armour[0][1] if armour else 0
            end = start + at(n) if n else 0
        else:
            continue
        if end:
            end += len(run[end : end + 2]) - len(run[end : end + 2].lstrip("="))
            out.append((start, end))
            free = end
    if not out and again:  # the whole run may hold another run
        data = decode(run) or b""
        if len(data) >= 32 and re.fullmatch(rb"[A-Za-z0-9+/_=\s-]+", data) and keys_of(data.decode("ascii"), False):
            out.append((0, len(run)))
    return out


def keys_of(text: str, again: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the keys that runs of base64 or hex in text hold; again: decode what decodes to a run."""
    out = []
    for kind, pattern, begin, decode, width in ((5, BASE64_RUN, BEGIN64, decode64, (4, 3)), (6, HEX_RUN, BEGIN_HEX, _decode16, (2, 1))):
        for m in pattern.finditer(text):
            if m.end() - m.start() < 32:
                continue
            parts, at = [], m.start()  # the run without its breaks, and where each of its parts stands in text
            for gap in _BREAKS.finditer(text, m.start(), m.end()):
                parts.append((at, gap.start()))
                at = gap.end()
            parts.append((at, m.end()))
            run = "".join(text[a:b] for a, b in parts)
            for a, b in _keys_in(run, begin, decode, width, again):
                out.append((_placed(parts, a), kind, _placed(parts, b - 1) + 1))
    return out


def _placed(parts: list[tuple[int, int]], at: int) -> int:
    for a, b in parts:
        if at < b - a:
            return a + at
        at -= b - a
    raise IndexError(at)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """The spans that decode to a key or a signed token."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if _signed_token(m[1])]
    armour = _pem(text)
    out += [(a, 4, b) for a, b in armour]
    return out + [(a, k, b) for a, k, b in keys_of(text) if not any(x <= a and b <= y for x, y in armour)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base matches, and all spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                text = text or ""
                base = sorted(base_spans(text))
                every = sorted(base + confirmed_spans(text))
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((None if doc_id is None else int(doc_id), *n, digest, joined(every), [KINDS[k] for _, k, _ in every], [a for a, _, _ in every], [b for _, _, b in every]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")], dtype=object)

    return docs.selectExpr(f"cast(`{id_col}` as string) as k", f"`{text_col}` as t").mapInPandas(run, SCHEMA)
