"""Text of PDF files, page by page, read by the workers: no library is needed for text that is stored as text.

Objects are found by their markers and in object streams, so a damaged cross-reference table does no harm. Pages are
taken in the order of the page tree, and each page's content streams are run for their text operators: strings go through the
font's ToUnicode map, or Windows-1252 without one; moves to another line end a line. What can't be read is a warning and not a failure: files that are
encrypted, not PDF or beyond a limit have a row with warnings and no pages. Streams other than Flate ones are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES, MOST_PAGES, MOST_STREAM = 256 << 20, 5_000, 64 << 20
PAGES = "path string, sha256 string, page_number int, raw_text string, image_count int, warnings array<string>"
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+.\d][-+.\d]*|[A-Za-z'\"*][A-Za-z0-9'\"*]*", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflate(data: bytes) -> bytes | None:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, MOST_STREAM)
    except zlib.error:
        return None
    return None if z.unconsumed_tail else out


class File:
    """The objects of a PDF file by number: (dictionary text, stream or None)."""

    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        self.warnings: list[str] = []
        marks = list(_OBJECT.finditer(data))
        for k, m in enumerate(marks):
            body = data[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(data)]
            head, mark, rest = body.partition(b"stream")
            if mark and not head.rstrip().endswith(b"end") and b"<<" in head:
                rest = rest[2:] if rest.startswith(b"\r\n") else rest[1:]
                length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
                end = int(length[1]) if length and rest[int(length[1]) :].lstrip()[:9] == b"endstream" else rest.rfind(b"endstream")
                self.objects[int(m[1])] = (head, rest[: max(end, 0)])
            else:
                self.objects[int(m[1])] = (body.partition(b"endobj")[0], None)
        for head, stream in list(self.objects.values()):
            if stream is not None and re.search(rb"/Type\s*/ObjStm", head):
                self._unpack(head, stream)
        self.encrypted = re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data) is not None

    def _unpack(self, head: bytes, stream: bytes) -> None:
        body, first = self.decoded(head, stream), re.search(rb"/First\s+(\d+)", head)
        if body is None or not first:
            self.warnings.append("OBJECT_STREAM")
            return
        numbers = [int(x) for x in body[: int(first[1])].split()]
        starts = [*(int(first[1]) + x for x in numbers[1::2]), len(body)]
        for n, a, b in zip(numbers[::2], starts, starts[1:]):
            self.objects.setdefault(n, (body[a:b], None))

    def decoded(self, head: bytes, stream: bytes) -> bytes | None:
        filters = re.findall(rb"/(\w+Decode)", head)
        if not filters:
            return stream
        return _inflate(stream) if filters == [b"FlateDecode"] else None

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """The objects that a key of a dictionary names: one, or an array of them."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[int]:
        """Page objects in the order of the tree, or by number if there is no tree."""
        roots = [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", h) and not re.search(rb"/Parent\b", h)]
        out, queue, seen = [], roots[:1], set()
        while queue:
            n = queue.pop(0)
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            head = self.objects[n][0]
            if re.search(rb"/Type\s*/Page\b(?!s)", head):
                out.append(n)
            else:
                queue = self.refs(head, b"Kids") + queue
        return out or sorted(n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", h))

    def inherited(self, n: int, key: bytes) -> bytes:
        """The text of a page's or its nearest ancestor's dictionary that has the key, with the dictionary that the key names appended."""
        for _ in range(32):
            head = self.objects.get(n, (b"", None))[0]
            if b"/" + key in head:
                return head + b"".join(self.objects.get(r, (b"", None))[0] for r in self.refs(head, key))
            if not (up := self.refs(head, b"Parent")):
                break
            n = up[0]
        return b""

    def fonts(self, n: int) -> dict[bytes, dict[bytes, str]]:
        """Font names of a page -> code to text, for fonts with a ToUnicode map."""
        resources = self.inherited(n, b"Resources")
        resources += b"".join(self.objects.get(r, (b"", None))[0] for r in self.refs(resources, b"Font"))
        out = {}
        for name, ref in re.findall(rb"/(\w[\w.+-]*)\s+(\d+)\s+\d+\s+R", resources):
            font = self.objects.get(int(ref), (b"", None))[0]
            for m in self.refs(font, b"ToUnicode"):
                head, stream = self.objects.get(m, (b"", None))
                if stream is not None and (text := self.decoded(head, stream)) is not None:
                    out[name] = unicode_map(text)
        return out

    def text(self, n: int) -> str:
        parts = []
        for ref in self.refs(self.objects[n][0], b"Contents"):
            inner = self.objects.get(ref, (b"", None))
            for head, stream in [self.objects.get(x, (b"", None)) for x in re.findall(rb"(\d+)\s+\d+\s+R", inner[0])] if inner[1] is None else [inner]:
                body = None if stream is None else self.decoded(head, stream)
                if body is None:
                    self.warnings.append("CONTENT_STREAM")
                else:
                    parts.append(body)
        return shown(b"\n".join(parts), self.fonts(n))


def unicode_map(cmap: bytes) -> dict[bytes, str]:
    """code -> text of a ToUnicode map."""
    of = lambda x: bytes.fromhex(re.sub(rb"\s", b"", x).decode())
    text = lambda b: b.decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out.update({of(a): text(of(b)) for a, b in re.findall(rb"<([^>]*)>\s*<([^>]*)>", block)})
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, one, several in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[([^\]]*)\])", block):
            low, high, width = int.from_bytes(of(a)), int.from_bytes(of(b)), len(of(a))
            texts = [of(x) for x in re.findall(rb"<([^>]*)>", several)] if several else None
            for i in range(min(high - low + 1, 65536)):
                to = texts[i] if texts and i < len(texts) else (int.from_bytes(of(one)) + i).to_bytes(max(2, len(of(one)))) if one else None
                if to is not None:
                    out[(low + i).to_bytes(width)] = text(to)
    return out


def literal(token: bytes) -> bytes:
    """The bytes of a string token, in parentheses or hexadecimal."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match[bytes]) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.DOTALL)


def decoded(data: bytes, font: dict[bytes, str] | None) -> str:
    if not font:
        return data.decode("cp1252", "replace")
    width = max(map(len, font))
    return "".join(font.get(data[i : i + width], "\ufffd") for i in range(0, len(data), width))


def shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """What the text operators of a content stream show, line by line."""
    lines: list[list[str]] = [[]]
    stack: list = []
    font, array = None, None
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token == b"[":
            array = []
        elif token == b"]":
            stack, array = [*stack, array or []], None
        elif token[:1] in b"(<" or token[:1] == b"/" or re.fullmatch(rb"[-+]?\d*\.?\d+|[-+]?\d+\.", token):
            (stack if array is None else array).append(token)
        else:
            number = lambda k: float(stack[k]) if len(stack) >= -k and isinstance(stack[k], bytes) and re.fullmatch(rb"[-+]?\d*\.?\d+|[-+]?\d+\.", stack[k]) else 0.0
            if token == b"Tf" and len(stack) > 1 and isinstance(stack[-2], bytes):
                font = fonts.get(stack[-2][1:])
            elif token in (b"T*", b"'", b'"') or token in (b"Td", b"TD") and number(-1) != 0 or token == b"Tm" and lines[-1]:
                lines.append([])
            elif token in (b"Td", b"TD") and lines[-1]:
                lines[-1].append(" ")
            if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes) and stack[-1][:1] in b"(<":
                lines[-1].append(decoded(literal(stack[-1]), font))
            elif token == b"TJ" and stack and isinstance(stack[-1], list):
                for x in stack[-1]:
                    if x[:1] in b"(<":
                        lines[-1].append(decoded(literal(x), font))
                    elif x[:1] != b"/" and float(x) < -200:  # a gap as wide as a space
                        lines[-1].append(" ")
            stack = []
    return "\n".join(x for x in ("".join(p).rstrip() for p in lines) if x)


def read_pages(data: bytes) -> tuple[list[tuple[int, str, int]], list[str]]:
    """((page number from 1, text, images) of every page, warnings)."""
    if len(data) > MOST_BYTES:
        return [], ["FILE_TOO_LARGE"]
    if b"%PDF-" not in data[:1024]:
        return [], ["NOT_PDF"]
    file = File(data)
    if file.encrypted:
        return [], ["ENCRYPTED"]
    pages = file.pages()
    if len(pages) > MOST_PAGES:
        file.warnings.append("TOO_MANY_PAGES")
    out = [(k, file.text(n), len(re.findall(rb"/Subtype\s*/Image", b"".join(file.objects.get(int(r), (b"", None))[0] for r in re.findall(rb"(\d+)\s+\d+\s+R", file.inherited(n, b"Resources")))))) for k, n in enumerate(pages[:MOST_PAGES], 1)]
    return out, sorted(set(file.warnings) | ({"NO_PAGES"} if not out else set()))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """PAGES of the PDF files at path (a folder, file or pattern); files are read in parallel, each by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                data = bytes(data)
                pages, warnings = read_pages(data)
                digest = hashlib.sha256(data).hexdigest()
                rows = [(name, digest, k, text, images, warnings) for k, text, images in pages] or [(name, digest, None, None, 0, warnings)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")], dtype=object)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, PAGES)
