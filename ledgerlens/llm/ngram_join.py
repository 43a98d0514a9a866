"""N-gram Jaccard join by MinHash banding.

A document is the set of its five-word shingles. Documents with equal sets form a class, and
classes are what is joined. Band and row counts follow from the wanted recall at the threshold;
classes meet by a shuffle on band hashes. Buckets of one class end there. Classes that the
others chain together are a neighbourhood, outside which no class can have a partner. A
neighbourhood that fits a block is compared there, with many small ones in one block; a larger one is
dealt into blocks by the least row of a row's buckets, and two of its blocks are compared if a bucket has
rows of both, once for all the buckets they share. Comparisons are on the full sets, in tiles of a
block, so a group of m near copies moves at most m * m / BLOCK_ROWS rows and emits no pairs;
n_links counts every link exactly.

Words are runs of letters, digits and underscores, lower-cased. Edge cases: fewer than five words make
one shingle of all of them; null texts and texts without words have no set, link with nothing
and are kept; null ids link with nothing and are kept; rows that repeat count as copies of each
other, and an id that repeats with other texts has the links of all of them; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairwise import per_row, settle
from .shared import components, cut

SHINGLE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 128
#: About so many rows and shingles make a block; so many rows a tile of it.
BLOCK_ROWS, BLOCK_SHINGLES, TILE = 2048, 1_000_000, 256
#: Into so many blocks small neighbourhoods go that would fill one.
PACKS = 4
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) of most rows a band, so fewest chance meetings, that reach recall at the threshold with at most `most` hashes."""
    for rows in range(most, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches that recall")


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes; word hashes are remembered up to a bound."""

    def __init__(self, n: int = SHINGLE, remembered: int = 500_000):
        self.n, self.known, self.remembered = n, {}, remembered

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        h, n = self.words(words), min(self.n, len(words))
        with np.errstate(over="ignore"):
            total = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                total = total * _MIX + h[k : len(h) - n + 1 + k]
            return np.unique(_scatter(total + np.uint64(n)))


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n hash functions of 32 bits."""
    seeds = _scatter(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MIX).astype(np.uint32)
    return (seeds[:n] | np.uint32(1))[:, None], seeds[n:, None]


def sketch(shingles: np.ndarray, bands: int, rows: int) -> list[int]:
    """The hash of each band of the MinHash sketch, as signed 64-bit integers.

    The hash functions are multiply-add modulo 2^32 of the upper halves of the well-mixed shingle hashes.
    """
    factor, summand = _hashes(bands * rows)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factor), np.iinfo(np.uint32).max, np.uint32)
    block = np.empty((len(factor), min(len(x), 2048)), np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            out = block[:, : len(part)]
            np.multiply(factor, part, out=out)
            out += summand
            np.minimum(low, out.min(axis=1), out=low)
        key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
        for k in range(rows):
            key = _scatter(key ^ low[k::rows].astype(np.uint64))
    return key.view(np.int64).tolist()


def _sets(a: list[bytes], b: list[bytes], threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the sets a and b have a Jaccard similarity of threshold or more: exact counts of shared members.

    Rows are taken in tiles; two tiles are multiplied over the members that both have.
    """
    every = [np.frombuffer(x, np.uint64) for x in (a if a is b else [*a, *b])]
    size = np.array([len(x) for x in every])
    values, inverse, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), size)
    keep = times[inverse] > 1  # members of one set alone are never shared
    row, col = row[keep], inverse[keep]
    del values, inverse, every
    split = 0 if a is b else len(a)
    tiles = lambda start, stop: [_Tile(row, col, at, min(at + TILE, stop)) for at in range(start, stop, TILE)]
    left = tiles(0, len(a))
    right = left if a is b else tiles(split, len(size))
    hit = np.zeros((len(a), len(b)), bool)
    for i, x in enumerate(left):
        for y in right[i if a is b else 0 :]:
            shared = x.shared(y)
            union = size[x.start : x.stop, None] + size[None, y.start : y.stop] - shared
            linked = (shared > 0) & (shared >= threshold * union - 1e-9)
            hit[x.start : x.stop, y.start - split : y.stop - split] = linked
            if a is b:
                hit[y.start : y.stop, x.start : x.stop] = linked.T
    return hit


class _Tile:
    """The members of a few rows, ascending by member."""

    def __init__(self, row: np.ndarray, col: np.ndarray, start: int, stop: int):
        self.start, self.stop = start, stop
        lo, hi = np.searchsorted(row, [start, stop])
        order = np.argsort(col[lo:hi], kind="stable")
        self.row, self.col = row[lo:hi][order] - start, col[lo:hi][order]
        self.members = np.unique(self.col)

    def dense(self, members: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.col, [members[0], members[-1] + 1])
        at = np.minimum(np.searchsorted(members, self.col[lo:hi]), len(members) - 1)
        own = members[at] == self.col[lo:hi]
        out = np.zeros((self.stop - self.start, len(members)), np.float32)
        out[self.row[lo:hi][own], at[own]] = 1
        return out

    def shared(self, other: "_Tile") -> np.ndarray:
        both = np.intersect1d(self.members, other.members, assume_unique=True)
        out = np.zeros((self.stop - self.start, other.stop - other.start))
        for at in range(0, len(both), 8192):
            some = both[at : at + 8192]
            out += self.dense(some) @ other.dense(some).T
        return out


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the documents with an equal set), n_links (other documents linked directly),
    component_id (least id reachable by links), kept (doc_id = component_id) of every row of docs."""
    bands, rows = bands_and_rows(threshold, recall)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                s = shingler.shingles(text)
                usable = len(s) and doc_id is not None
                out.append((None if doc_id is None else int(doc_id), hashlib.md5(s.tobytes()).hexdigest() if usable else None, len(s), sketch(s, bands, rows) if usable else None))
            yield pd.DataFrame(out, columns=["doc_id", "class_key", "n", "bands"], dtype=object)

    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(source.mapInPandas(sign, "doc_id long, class_key string, n int, bands array<long>"), "signed")
    ids = signed.select("doc_id", "class_key")
    of_class = signed.where("class_key is not null").groupBy("class_key")
    heads = cut(of_class.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min_by("n", "doc_id").alias("n"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    classes = heads.select("class_key", "class_id", "copies")

    # buckets of two or more classes
    in_bands = heads.select(F.col("class_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = cut(in_bands.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("bucket", "lead"), "buckets")
    members = cut(in_bands.join(shared, "bucket"), "members")

    # neighbourhoods, and in each the least row of a row's buckets; an id that several texts repeat is one node
    nodes = heads.groupBy(F.col("class_id").alias("node")).agg(F.max("n").alias("n"), F.max("copies").alias("copies"))
    leads = cut(members.groupBy("node", "lead").agg(F.count("*").alias("buckets")).select("node", "lead"), "leads")
    near = components(leads.select(F.col("node").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("root", "area")
    led = cut(leads.groupBy("node").agg(F.min("lead").alias("lead")).join(near, "node").join(nodes, "node"), "led")

    # a neighbourhood is a share of a block or makes several; rows of one lead stay together where they can
    share = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)
    of_lead = cut(led.groupBy("area", "lead").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), share.alias("share")), "of_lead")
    of_area = of_lead.groupBy("area").agg(F.greatest(F.sum("rows") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES).alias("whole"), F.sum(F.when(F.col("share") < 0.5, F.col("share"))).alias("rest"))
    of_area = cut(of_area.withColumn("small", F.col("whole") <= 1), "of_area")
    packs = math.ceil(PACKS * (of_area.where("small").agg(F.sum("whole")).first()[0] or 1))
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.ceil(parts)))
    block = (
        F.when(F.col("small"), F.concat(F.lit("s:"), dealt("area", F.lit(packs))))
        .when(F.col("share") >= 0.5, F.concat_ws(":", "area", "lead", dealt("node", F.col("share"))))
        .otherwise(F.concat_ws(":", "area", F.lit("m"), dealt("lead", F.col("rest"))))
    )
    sized = of_lead.select("area", "lead", "share").join(of_area, "area").select("lead", "area", "share", "small", "rest")
    placed = cut(led.join(sized, ["area", "lead"]).select("node", "copies", "area", "small", block.alias("at")), "placed")

    # blocks of large neighbourhoods that meet
    met = cut(members.select("bucket", "node").join(placed.where(~F.col("small")).select("node", "at"), "node").groupBy("bucket", "at").agg(F.count("*").alias("rows")).select("bucket", "at"), "met")
    within = met.select(F.col("at").alias("one"), F.col("at").alias("other"))
    several = met.groupBy("bucket").agg(F.count("*").alias("blocks")).where("blocks > 1").select("bucket")
    mixed = cut(met.join(several, "bucket").select("bucket", "at"), "mixed")
    across = mixed.select("bucket", F.col("at").alias("one")).join(mixed.select("bucket", F.col("at").alias("other")), "bucket").where("one < other").select("one", "other")
    pairs = cut(within.unionByName(across).distinct(), "pairs").withColumn("block", F.concat_ws("|", "one", "other"))
    visits = pairs.select("block", F.col("one").alias("at"), F.when(F.col("one") == F.col("other"), 2).otherwise(0).alias("side")).unionByName(pairs.where("one <> other").select("block", F.col("other").alias("at"), F.lit(1).alias("side")))

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for batch in batches:
            yield batch.drop(columns="text").assign(payload=[shingler.shingles(t).tobytes() for t in batch.text])

    # rows that can link grow with the corpus, so this join is a shuffle at every size
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).where("node is not null").join(placed.hint("merge"), "node")
    if _repeated(ids):
        texts = texts.dropDuplicates(["node", "text"])
    sets = cut(texts.select("node", "copies", "area", "small", "at", "text").mapInPandas(collect, "node long, copies long, area long, small boolean, at string, payload binary"), "sets")
    columns = ["block", "part", "node", "copies", "side", "payload"]
    alone = sets.where("small").select(F.col("at").alias("block"), F.col("area").alias("part"), "node", "copies", F.lit(2).alias("side"), "payload")
    meeting = sets.where(~F.col("small")).join(cut(visits, "visits"), "at").withColumn("part", F.lit(0).cast("long")).select(*columns)
    found = settle(alone.unionByName(meeting), lambda a, b: _sets(a, b, threshold))
    return per_row(ids, classes, found, "doc_id")


def _repeated(ids: DataFrame) -> bool:
    return bool(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").take(1))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that a kept one stands for, in the columns of docs; of rows that repeat an id of
    one group, one stays."""
    found = cut(join(docs, threshold), "decisions")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    # what goes grows with the corpus, so this join is a shuffle at every size too
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if _repeated(found):
        numbered = kept.dropDuplicates(["doc_id", "text"])
        nameless = kept.where("doc_id is null")
        kept = numbered.where("doc_id is not null").unionByName(nameless)
    return kept
