"""Token ids in a content-addressed store.

Each document's ids (its tokens and an end id) are cut into chunks where a rolling hash of the last
WINDOW ids hits a mask, so equal runs of ids give equal chunks wherever they stand. A chunk is
named by a digest of its ids and stored once: in the pack of the first document that has
it. A document's recipe lists its chunks' digests and lengths and a Merkle root over them;
the manifest has a root for each block of recipes and, level by level, one for all. Reading
goes the other way: chunks are looked up by digest, checked against it, put together by recipe,
and the roots are built again from what was read and compared with the manifest.

Files (Parquet, below one folder): ``packs`` - a row for each document in ascending doc_id
order of ``row_number``: doc_id, start (ids of all documents before it), n_tokens, digests,
lengths, held (which of its chunks are stored here), wanted (which of those others want), the ids of
the chunks held as zstd-compressed little-endian unsigned integers of ``width`` bytes, root;
``manifest`` - level, block, root.

Tokenizing remembers the ids of words (bounded). About PORTION bytes of texts are cut at once, each distinct piece is
looked up once, and the ids are gathered from one array. A text is cut only where the tokenizer always cuts: before a
single space that a character other than white space follows, around a line end between such characters, and before the
punctuation that ends such a word after a letter or digit; a text where that is not certain is encoded whole. New words of
letters only go straight to the library's model, all other pieces through the whole tokenizer.

Edge cases: a null text is an empty one and has the end id only; null ids come first; rows that
repeat are stored as documents of their own that share all chunks; an empty table gives empty
files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_path, scratch_path

END_ID = 0
WINDOW, LEAST, MASK, MOST = 8, 64, 255, 1024
MANIFEST_BLOCK = 4096
#: Words whose ids a worker remembers.
REMEMBERED = 1_250_000
#: Bytes of text that are encoded at once: each distinct word of them is looked up once.
PORTION = 8_000_000
_MARK = np.isin(np.arange(256), list(string.punctuation.encode()))
_BEFORE = np.isin(np.arange(256), list((string.ascii_letters + string.digits).encode())) | (np.arange(256) >= 0x80)
_OTHER_SPACE = re.compile(r"[^\S \n]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to ids with the tokenizers library, remembering words."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered
        # the words, the ids of all of them in a row, and how many each has
        self.words, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)
        self.line_end = self._ids("\n")
        # words are looked up only if the tokenizer is known to cut where words are cut here
        self.splits = "ByteLevel" in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None and len(self.line_end) == 1
        if self.splits:
            # the character that stands for each byte
            all_bytes = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x110000, 64)]))
            self.stands = dict(zip(all_bytes.encode(), "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(all_bytes)), strict=False))
            probe = "One two, three.\nFour (five) \u00e9l\u00e8ve\u00df! si\u00d7,\nit's 12. seven"
            pieces = self._cut_up(*_utf8(pa.array([probe])))[1].to_pylist()
            self.splits = "".join(pieces) == probe and np.array_equal(np.concatenate(self._learn(pieces)), self._ids(probe))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's with END_ID, and where each text's end."""
        offsets, data = _utf8(texts)
        first, pieces, whole = self._cut_up(offsets, data)
        per, coded = np.diff(first), pieces.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(names, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        words = names.take(pa.array(new)).to_numpy(zero_copy_only=False)
        # texts with other white space are uncertain too, and nothing is learned from uncertain ones
        if _OTHER_SPACE.search("".join(words)):
            odd = np.isin(codes, new[[_OTHER_SPACE.search(x) is not None for x in words]])
            whole[np.searchsorted(first, np.flatnonzero(odd), "right") - 1] = True
        if whole.any():
            codes, per = codes[~np.repeat(whole, per)], np.where(whole, 0, per)
            used = np.bincount(codes, minlength=len(names))[new] > 0
            new, words = new[used], words[used]
        fresh = self._learn(words.tolist())
        place[new] = len(self.words) + np.arange(len(new))

        # a text is its pieces, or the ids of all of it, and the end id
        alone = np.flatnonzero(whole)
        more = [self._ids(data[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in alone.tolist()] + [np.array([END_ID], self.dtype)]
        ids, sizes = np.concatenate([self.ids, *fresh, *more]), np.concatenate([self.sizes, [*map(len, fresh)], [*map(len, more)]]).astype(np.int64)
        known = len(self.words) + len(fresh)
        added = np.full(len(texts) + len(alone), len(sizes) - 1)
        added[np.cumsum(1 + whole)[alone] - 2] = known + np.arange(len(alone))
        codes = np.insert(place[codes], np.repeat(np.cumsum(per), 1 + whole), added)
        if known <= self.remembered:
            self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
            self.ids, self.sizes = ids[: len(ids) - sum(map(len, more))], sizes[:known]

        n = sizes[codes]
        ends = np.cumsum(n)
        from_ = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n)
        from_ += np.arange(len(from_))
        return ids[from_], ends[np.cumsum(per + 1 + whole) - 1]

    def _cut_up(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The number of each text's first piece (and of all pieces), the pieces of all texts, and whether a text has to be encoded whole: if
        a space or line end doesn't stand between other characters, or if it has a special token."""
        line = data == 10
        starts = (data == 32) | line
        blank = np.flatnonzero(starts)
        filled = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        starts[1:] |= line[:-1]
        starts[heads] = True
        # a run of punctuation after a letter or digit, if a piece ends where the run ends; a text may begin within it
        marks = _MARK[data]
        turns = 1 + np.flatnonzero(marks[1:] != marks[:-1])
        begins = marks[turns] & _BEFORE[data[turns - 1]]
        begins[begins] = (data[turns[begins] - 1] < 0x80) | _letter(data[turns[begins] - 2], data[turns[begins] - 1])
        run, stop = turns[begins], np.append(turns, len(data))[1:][begins]
        stop = np.minimum(stop, np.append(heads, len(data))[np.searchsorted(heads, run, "right")])
        starts[run[np.append(starts, True)[stop]]] = True
        starts = np.flatnonzero(starts)
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])

        rims, joined = np.concatenate([heads, tails]), data.tobytes()
        special = [m.start() for x in self.special for m in re.finditer(re.escape(x), joined)]
        doubtful = np.concatenate([blank[:-1][np.diff(blank) == 1], rims[np.isin(data[rims], (10, 32))], np.flatnonzero(data == 0), np.array(special, np.int64)])
        whole = np.full(len(offsets) - 1, not self.splits)
        whole[np.searchsorted(offsets, doubtful, "right") - 1] = True
        return np.searchsorted(starts, offsets), pieces, whole

    def _learn(self, new: list[str]) -> list[np.ndarray]:
        """The ids of each new piece. Nothing cuts a run of letters, so the library's model gets such words as they are."""
        plain = [x.isalpha() or (x[0] == " " and x[1:].isalpha()) for x in new]
        words, rest = [x for x, is_plain in zip(new, plain, strict=True) if is_plain], [x for x, is_plain in zip(new, plain, strict=True) if not is_plain]
        flat, ends, tokenize = [], [], self.model.tokenize
        for word in "\n".join(words).encode().decode("latin-1").translate(self.stands).split(self.stands[10]) if words else ():
            flat += [x.id for x in tokenize(word)]
            ends.append(len(flat))
        flat = np.array(flat, self.dtype)
        known, others = iter([flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]), iter(self._encoded(rest))
        return [next(known if is_plain else others) for is_plain in plain]

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        """Pieces are encoded many at a time, between line ends."""
        out, end = [], self.line_end[0]
        for at in range(0, len(pieces), 4096):
            groups = [pieces[i : min(i + 128, at + 4096)] for i in range(at, min(at + 4096, len(pieces)), 128)]
            for some, got in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(x) for x in groups], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, dtype=self.dtype)
                ends = np.flatnonzero(ids == end).tolist()
                if len(ends) == len(some) - 1:
                    out += [ids[a:b] for a, b in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)], strict=True)]
                else:
                    out += map(self._ids, some)
        return out


def _letter(lead: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether two bytes are a letter of U+00C0 .. U+023F or U+0400 .. U+047F; all but two of these are."""
    return (last < 0xC0) & (((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | ((lead >= 0xC4) & (lead <= 0xC8)) | (lead == 0xD0) | (lead == 0xD1))


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where texts (null: empty) start and end within their bytes, and these bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker: what it remembers serves all tasks of that worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def marks(ids: np.ndarray) -> np.ndarray:
    """The places after the windows of ids whose hash hits the mask, ascending."""
    step = 1 << 15
    return np.concatenate([np.zeros(0, np.int64), *(_marks(ids[at : at + step + WINDOW - 1]) + at for at in range(0, len(ids) - WINDOW + 1, step))])


def _marks(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        total = np.zeros(len(ids) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            total *= np.uint64(0xD1342543DE82EF95)
            total += h[k : len(ids) - WINDOW + 1 + k]
        total ^= total >> np.uint64(32)
    return np.flatnonzero((total & np.uint64(MASK)) == 0) + WINDOW


def ends_of(found: list[int], start: int, end: int) -> list[int]:
    """The ends, from start on, of the chunks of the ids start .. end of a sequence with these marks."""
    out, last, at = [], start, 0
    while end - last > LEAST:
        # chunks have LEAST ids, so a mark's window never reaches before start
        at = bisect_left(found, last + LEAST, at)
        last = min(found[at] if at < len(found) else end, last + MOST, end)
        out.append(last - start)
    if last < end:
        out.append(end - start)
    return out


def boundaries(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of ids, by content: the last is len(ids)."""
    return ends_of(marks(ids).tolist(), 0, len(ids))


def digest(ids: np.ndarray) -> bytes:
    """A chunk's name: of its ids as unsigned 32-bit integers, whatever width they are stored in."""
    return named(ids.astype("<u4").tobytes())


def named(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def root(hashes: list[bytes]) -> bytes:
    """Merkle root; an odd hash at the end of a level goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in hashes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _manifest(rows: DataFrame) -> DataFrame:
    """(row_number, root as hexadecimal) -> (level, block, root): each level has a root for MANIFEST_BLOCK of the one below."""
    level, below, out = 0, rows.select(F.col("row_number").alias("block"), "root"), None
    while True:
        grouped = below.groupBy(F.floor(F.col("block") / MANIFEST_BLOCK).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("block", "root"))).alias("parts"))
        below = cut(grouped.select(F.col("up").alias("block"), F.sha2(F.array_join("parts.root", ""), 256).alias("root")), "manifest")
        now = below.select(F.lit(level).alias("level"), "block", "root")
        out = now if out is None else out.unionByName(now)
        if below.count() <= 1:
            return out
        level += 1


STAGED = {"doc_id": "long", "n_tokens": "long", "digests": "array<binary>", "lengths": "array<int>", "width": "int", "ids": "binary", "root": "string"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _batch(values: list, columns: dict[str, str]) -> pa.RecordBatch:
    made = [v if isinstance(v, pa.Array) else pa.array(v, _ARROW[kind]) for v, kind in zip(values, columns.values(), strict=True)]
    return pa.RecordBatch.from_arrays(made, names=list(columns))


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about PORTION bytes together, at least one row each."""
    offsets, _ = _utf8(batch.column("text"))
    bounds = [0, *(np.flatnonzero(np.diff(offsets[1:] // PORTION)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize docs and write packs and manifest below folder."""
    path = tokenizer or default_tokenizer()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z = encoder(path), zstandard.ZstdCompressor(1)
        for batch in batches:
            for some in _portions(batch):
                ids, ends = enc.encode(some.column("text"))
                found, wide, data, width = marks(ids).tolist(), memoryview(ids.astype("<u4").view(np.uint8)), memoryview(ids.view(np.uint8)), enc.dtype.itemsize
                digests, lengths, kept, roots = [], [], [], []
                for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    stops = ends_of(found[bisect_left(found, start) : bisect_left(found, end + 1)], start, end)
                    names = [named(wide[4 * (start + a) : 4 * (start + b)]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]
                    digests.append(names)
                    lengths.append(stops)
                    kept.append(z.compress(data[width * start : width * end]))
                    roots.append(root(names).hex())
                yield _batch([some.column("doc_id"), np.diff(ends, prepend=0), digests, [[b - a for a, b in zip([0, *x[:-1]], x, strict=True)] for x in lengths], [width] * len(ends), kept, roots], STAGED)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged_at = scratch_path(docs.sparkSession, "tokens")
    made = source.mapInArrow(tokenize, _ddl(STAGED))
    staged = cut(made.withColumn("at", F.monotonically_increasing_id()), "tokens", staged_at)

    # where each document starts: a sort of narrow rows by id, running sums in a range, and the sums of the ranges before
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = staged.select("at", "doc_id", "n_tokens").repartitionByRange(ranges, "doc_id", "at").sortWithinPartitions("doc_id", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = tokens = 0
        for batch in batches:
            total = batch.n_tokens.cumsum()
            yield pd.DataFrame({"at": batch["at"], "n_tokens": batch.n_tokens, "row": np.arange(rows, rows + len(batch)), "before": tokens + total - batch.n_tokens})
            rows, tokens = rows + len(batch), tokens + int(total.iloc[-1]) if len(batch) else tokens

    placed = cut(narrow.mapInPandas(run, "at long, n_tokens long, row long, before long").withColumn("range", F.spark_partition_id()), "placed")
    rows, tokens, starts = 0, 0, {}
    for r in sorted(placed.groupBy("range").agg(F.count("*"), F.sum("n_tokens")).collect()):
        starts[r[0]] = (rows, tokens)
        rows, tokens = rows + r[1], tokens + r[2]
    offset = lambda k: F.element_at(F.array(*[F.lit(starts.get(i, (0, 0))[k]).cast("long") for i in range(max(starts, default=0) + 1)]), F.col("range") + 1)
    placed = placed.select("at", (F.col("row") + offset(0)).alias("row_number"), (F.col("before") + offset(1)).alias("start"))

    # which chunks several places have: the first place holds them
    chunks = staged.select("at", F.posexplode("digests").alias("seq", "digest"))
    shared = cut(chunks.groupBy("digest").agg(F.min(F.struct("at", "seq")).alias("home"), F.count("*").alias("n")).where("n > 1").select("digest", "home"), "shared")
    role = chunks.join(shared, "digest").select("at", "seq", (F.struct("at", "seq") == F.col("home")).alias("home"))
    roles = cut(role.groupBy("at").agg(F.collect_list(F.when(F.col("home"), F.col("seq"))).alias("wanted"), F.collect_list(F.when(~F.col("home"), F.col("seq"))).alias("absent")), "roles")
    none = F.array().cast("array<int>")
    placed = placed.join(roles, "at", "left").withColumns({c: F.coalesce(c, none) for c in ("wanted", "absent")})
    told = staged.join(cut(placed, "told"), "at")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, u = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for batch in batches:
            kept = []
            for ids, lengths, width, absent in zip(batch.ids, batch.lengths, batch.width, batch.absent, strict=True):
                if absent is None or len(absent) == 0:
                    kept.append(ids)
                    continue
                away = set(absent)
                parts = np.split(np.frombuffer(u.decompress(ids), f"<u{width}"), np.cumsum(lengths)[:-1])
                kept.append(z.compress(b"".join(p.tobytes() for i, p in enumerate(parts) if i not in away)))
            yield batch.assign(ids=kept)

    columns = "row_number long, doc_id long, start long, n_tokens long, digests array<binary>, lengths array<int>, width int, wanted array<int>, absent array<int>, ids binary, root string"
    told.select(*[c.split()[0] for c in columns.split(", ")]).mapInPandas(pack, columns).write.parquet(f"{folder}/packs")
    drop_path(spark, staged_at)
    _manifest(spark.read.parquet(f"{folder}/packs").select("row_number", "root")).write.parquet(f"{folder}/manifest")


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, put together from the store and verified; raises if a
    chunk, a recipe or the manifest doesn't agree."""
    packs = spark.read.parquet(f"{folder}/packs")

    def lend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The chunks that others want."""
        u = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for digests, lengths, width, wanted, absent, ids in zip(batch.digests, batch.lengths, batch.width, batch.wanted, batch.absent, batch.ids, strict=True):
                for k, part in _held(u, digests, lengths, width, absent, ids).items():
                    if k in set(wanted):
                        out.append((digests[k], part.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["digest", "part"], dtype=object)

    lent = packs.where("size(wanted) > 0").select("digests", "lengths", "width", "wanted", "absent", "ids").mapInPandas(lend, "digest binary, part binary")
    asked = packs.where("size(absent) > 0").select("row_number", F.explode("absent").alias("seq"), "digests").select("row_number", "seq", F.col("digests")[F.col("seq")].alias("digest"))
    lent_parts = cut(lent, "lent")
    fetched = asked.join(lent_parts, "digest").groupBy("row_number").agg(F.collect_list(F.struct("seq", "part")).alias("fetched"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                fetched = {x["seq"]: x["part"] for x in r.fetched} if r.fetched is not None else {}
                held = memoryview(np.frombuffer(u.decompress(r.ids), f"<u{r.width}").astype("<u4").tobytes())
                parts, at = [], 0
                for k, n in enumerate(r.lengths):
                    if k in fetched:
                        parts.append(fetched[k])
                    else:
                        parts.append(held[at : at + 4 * n])
                        at += 4 * n
                names = [named(p) for p in parts]
                if names != list(r.digests) or at != len(held):
                    raise ValueError(f"document {r.doc_id}: a chunk differs from its digest")
                ids = b"".join(parts)
                out.append((r.row_number, None if pd.isna(r.doc_id) else int(r.doc_id), r.start, len(ids) // 4, zlib.crc32(ids), root(names).hex()))
            yield pd.DataFrame(out, columns=["row_number", "doc_id", "start", "n_tokens", "ids_crc32", "root"], dtype=object)

    recipe = ["row_number", F.col("doc_id").cast("string").alias("doc_id"), "start", "digests", "lengths", "width", "absent", "ids"]
    none = F.lit(None).cast("array<struct<seq:int,part:binary>>")
    whole = packs.where("size(absent) = 0").select(*recipe, none.alias("fetched"))
    partial = packs.where("size(absent) > 0").select(*recipe).join(fetched, "row_number").select(*whole.columns)
    built = cut(whole.unionByName(partial).mapInPandas(build, "row_number long, doc_id long, start long, n_tokens long, ids_crc32 long, root string"), "built")
    found, kept = _manifest(built), spark.read.parquet(f"{folder}/manifest")
    if found.exceptAll(kept).take(1) or kept.exceptAll(found).take(1):
        raise ValueError("the manifest doesn't agree with what was read")
    return built.select("doc_id", "start", "n_tokens", "ids_crc32")


def _held(u: zstandard.ZstdDecompressor, digests: list, lengths: list, width: int, absent: list | None, ids: bytes) -> dict[int, np.ndarray]:
    """The chunks that a pack row holds, by place."""
    away = set(absent) if absent is not None else set()
    here = [k for k in range(len(lengths)) if k not in away]
    parts = np.split(np.frombuffer(u.decompress(ids), f"<u{width}"), np.cumsum([lengths[k] for k in here])[:-1]) if here else []
    return dict(zip(here, parts, strict=True))


def roundtrip(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a store and read it back."""
    folder = folder or scratch_path(docs.sparkSession, "store")
    write(docs, folder, tokenizer)
    return read(docs.sparkSession, folder)
