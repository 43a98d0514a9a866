"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer gives each page a record in its own gzip member. Of pages with equal payloads of
at least ``min_revisit`` bytes the one with the least page_id is a response; the others are
revisit records that name it and carry the digest and length of the full payload but no copy.
A task writes files of bounded size under names of its own and returns their names; only
returned files are read, so a task that is run again leaves at most an unread file.

The reader checks each member (gzip CRC and length) and each record (version line, header
fields, Content-Length, block and payload digests). After a failed check it searches for the
next gzip member, or in a file that isn't compressed the next version line, from which a
whole valid record can be read; it goes on there and reports the bytes between as a
quarantined gap. Nothing is held but one record at a time: what a damaged length points to is looked
at before it is read, a gap's bytes are let go while the search goes on, and a member that inflates to
more than MOST_BYTES, which no value of Spark's can hold, is damage. A round trip that reads other
than the written number of records, or a gap, raises.

Edge cases: a null html is an empty payload; payloads that are null, empty or short are all
responses; a page_id that repeats with the same payload is a response in every copy of its least
page_id; a null page_id comes after all others, never is referred to, and is always a response;
line ends in urls are percent-encoded; an empty table gives no file and an empty result; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, or_empty, scratch_path

VERSION = b"WARC/1.1\r\n"
MIN_REVISIT = 100
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
MOST_BYTES = 1 << 31
#: How a gzip member and a record that isn't compressed begin.
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, start long, bytes long, note string"


def filesystem(path: str):
    """(pyarrow file system, path in it) of a path or URI."""
    from pyarrow import fs

    if re.match(r"^\w[\w+.-]*:/", path):
        path = re.sub(r"^file:/(?=[^/])", "file:///", path)
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record, not compressed."""
    name = "" if page_id is None else str(page_id)
    block = b"" if refers_to is not None else payload
    uri = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}:{uri}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Page-ID: {name}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{digest if refers_to is None else hashlib.sha256(b'').hexdigest()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as one gzip member, the same bytes on every run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Bytes:
    """A file read forward in blocks, with the bytes from `base` on at hand."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, bytearray()

    def reach(self, end: int) -> None:
        while self.base + len(self.held) < min(end, self.size):
            got = self.file.read(max(READ_BYTES, end - self.base - len(self.held)))
            if not got:
                self.size = self.base + len(self.held)
                return
            self.held += got

    def peek(self, start: int, n: int) -> bytes:
        """n bytes at start, without holding those before; the file goes on where it was."""
        if start + n <= self.base + len(self.held):
            return self.get(start, n)
        self.file.seek(start)
        got = self.file.read(n)
        self.file.seek(self.base + len(self.held))
        return bytes(got)

    def get(self, start: int, n: int) -> bytes:
        self.reach(start + n)
        return bytes(self.held[start - self.base : start - self.base + n])

    def drop(self, to: int) -> None:
        if to - self.base >= READ_BYTES:
            del self.held[: to - self.base]
            self.base = to

    def find(self, start: int) -> int:
        """The place of the next member or version line at or after start, or the file's end."""
        while start < self.size:
            self.reach(start + READ_BYTES)
            if m := MARK.search(self.held, start - self.base):
                return self.base + m.start()
            start = max(start, self.base + len(self.held) - 6)
            if self.base + len(self.held) >= self.size:
                break
        return self.size


def _parse(data: bytes, whole: bool) -> tuple[dict, int] | str:
    """The record at the start of data and its length, or what is wrong. whole: data ends with the record."""
    if not re.match(rb"WARC/1\.[01]\r\n", data):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "header without end"
    head = {}
    for line in data[10:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without a name"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        return "no content length"
    stop = end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "short block"
    if whole and len(data) != stop + 4:
        return "bytes after the record"
    block = data[end + 4 : stop]
    if head.get("warc-block-digest", "") not in ("", f"sha256:{hashlib.sha256(block).hexdigest()}"):
        return "block digest differs"
    kind = head.get("warc-type")
    if kind == "response" and head.get("warc-payload-digest", "") not in ("", f"sha256:{hashlib.sha256(block).hexdigest()}"):
        return "payload digest differs"
    return {"head": head, "block": block}, stop + 4


def _inflate(src: _Bytes, start: int) -> tuple[bytes, int] | str:
    """One gzip member from start: what it holds and its length."""
    z, at, out, n = zlib.decompressobj(31), start, [], 0
    try:
        while not z.eof:
            got = z.unconsumed_tail or src.get(at, READ_BYTES)
            if not got:
                return "member cut off"
            at += 0 if z.unconsumed_tail else len(got)
            out.append(z.decompress(got, 16 * READ_BYTES))
            n += len(out[-1])
            if n > MOST_BYTES:
                return "member too long"
    except zlib.error as e:
        return f"member: {e}"
    return b"".join(out), at - len(z.unused_data) - start


def _record_at(src: _Bytes, at: int) -> tuple[dict, int] | str:
    if src.get(at, 2) == b"\x1f\x8b":
        got = _inflate(src, at)
        if isinstance(got, str):
            return got
        found = _parse(got[0], True)
        return found if isinstance(found, str) else (found[0], got[1])
    first = src.get(at, 64 << 10)
    if not first.startswith(b"WARC/1."):
        return "no member or version line"
    m = re.search(rb"\r\ncontent-length:\s*(\d+)\r\n", first.split(b"\r\n\r\n")[0] + b"\r\n", re.I)
    need = first.find(b"\r\n\r\n") + 8 + int(m[1]) if m else len(first)
    if m and (need > MOST_BYTES or at + need > src.size or src.peek(at + need - 4, 4) != b"\r\n\r\n"):
        return "short block"
    return _parse(src.get(at, need), False)


def salvage(file, size: int) -> Iterator[dict]:
    """Records {start, bytes, head, block} and gaps {start, bytes, note} of an archive, in file order."""
    src, at = _Bytes(file, size), 0
    while at < src.size:
        found = _record_at(src, at)
        if not isinstance(found, str):
            yield {"start": at, "bytes": found[1]} | found[0]
            at += found[1]
            src.drop(at)
            continue
        why, near = found, at + 1
        while near < src.size:
            src.drop(near)
            near = src.find(near)
            if near >= src.size or not isinstance(_record_at(src, near), str):
                break
            near += 1
        yield {"start": at, "bytes": near - at, "note": why}
        at = near
        src.drop(at)


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each page to files in folder; the written table of their names (file, records, bytes)."""
    spark = pages.sparkSession
    html = or_empty("html")
    rows = pages.select("page_id", "url", html.alias("html"))
    # who refers to whom: over ids and digests only; the least id of each digest that several rows have
    keys = rows.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    keys = keys.where(F.col("n") >= min_revisit)
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    keyed = rows.withColumn("digest", F.sha2(html.cast("binary"), 256))
    placed = keyed.join(cut(firsts, "firsts"), "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, below = filesystem(folder)
        out, name, n, size = None, "", 0, 0
        try:
            for batch in batches:
                for page_id, url, text, digest, to in zip(batch.page_id, batch.url, batch.html, batch.digest, batch.refers_to, strict=True):
                    if out is None:
                        where.create_dir(below, recursive=True)
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = where.open_output_stream(f"{below}/{name}", compression=None)
                    data = member(record(None if pd.isna(page_id) else int(page_id), None if pd.isna(url) else url, text.encode(), digest, None if pd.isna(to) else int(to)))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= file_bytes:
                        out.close()
                        yield pd.DataFrame({"file": [name], "records": [n], "bytes": [size]})
                        out = None
            if out is not None:
                out.close()
                yield pd.DataFrame({"file": [name], "records": [n], "bytes": [size]})
                out = None
        finally:
            if out is not None:
                out.close()

    wanted = placed.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return cut(wanted.mapInPandas(put, "file string, records long, bytes long"), "archives")


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records and gaps (note not null) of the named files, in FOUND's columns."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, below = filesystem(folder)
        for batch in batches:
            for name in batch.file:
                path, out = f"{below}/{name}", []
                with where.open_input_file(path) as file:
                    for r in salvage(file, where.get_file_info(path).size):
                        head = r.get("head", {})
                        number = lambda k, h=head: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None
                        block = r.get("block", b"")
                        full = head.get("warc-type") == "response"
                        out.append((
                            number("warc-page-id"),
                            (len(block) if full else number("warc-payload-length")) if head else None,
                            (hashlib.sha256(block).hexdigest() if full else head.get("warc-payload-digest", "").removeprefix("sha256:")) if head else None,
                            head.get("warc-type"), number("warc-refers-to-page-id"), name, r["start"], r["bytes"], r.get("note"),
                        ))
                        if len(out) >= 2000:
                            yield _frame(out)
                            out = []
                if out:
                    yield _frame(out)

    return files.select("file").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file").mapInPandas(get, FOUND)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in FOUND.split(", ")]
    df = pd.DataFrame(rows, columns=names, dtype=object)
    return df


def roundtrip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives and read them back; raises if what is read isn't every record written and no gap."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    files = write(pages, folder)
    found = cut(read(files, folder), "records")
    written = files.agg(F.sum("records")).first()[0] or 0
    records, gaps = found.agg(F.count_if(F.col("note").isNull()), F.count("note")).first()
    if records != written or gaps:
        raise ValueError(f"{written} records were written; {records} were read, with {gaps} gaps")
    return found
