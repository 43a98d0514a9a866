"""Embedding near-dedup with an inverted multi-index.

Vectors are split in halves; each half has its own codebook, fitted on a bounded sample, and
the product of the codebooks is a grid of cells. Every vector is listed in the cell of its
nearest codewords. A query walks cells by the multi-sequence algorithm, nearest first: the
distance of a cell is how far the vector would have to move, in each half, to fall into it.
It stops at the distance of unit vectors at just the threshold, sqrt(2 - 2 * threshold), beyond which
no cell holds a partner, however the vectors are spread: no pair is lost.
Cells met are compared exactly, in double precision, in blocks of bounded size.

A pair is looked for from the vector whose cell is the lesser one, so it is found once. Bit-equal
vectors with equal labels form a class that is indexed once.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and vectors with a
null label or id, link with nothing and are kept; vectors of different length never link; those
not of the sample's commonest length share one cell and are compared exactly; rows that repeat
are copies of each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairwise import per_row, settle
from .shared import cut

THRESHOLD = 0.98
#: Added to the radius for rounding.
SLACK = 1e-6
#: The bound of the sample that codebooks are fitted on.
SAMPLE_ROWS = 8_000
CELL_ROWS, MOST_WORDS, BLOCK_ROWS, PROBE_ROWS = 48, 256, 2048, 2048


def clean(vector) -> np.ndarray | None:
    """The vector in double precision and unit length, or None if it can't link."""
    if vector is None or len(vector) == 0:
        return None
    v = np.array([np.nan if x is None else x for x in vector] if not isinstance(vector, np.ndarray) else vector, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        for c in range(k):
            own = x[near == c]
            centers[c] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return centers


@dataclass
class Index:
    """Two codebooks and the radius of a query's walk; dim 0: no codebooks."""

    dim: int
    books: list[np.ndarray]
    radius: float

    def distances(self, half: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword of each row and, for every codeword, the distance to the border of its region (0 for the nearest)."""
        c = self.books[half]
        d = (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 1e-18))[own]
        far = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * apart)
        far[np.arange(len(x)), own] = 0
        return own, far

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        cut_at = self.dim // 2
        return [x[:, :cut_at], x[:, cut_at:]]

    def walks(self, x: np.ndarray, radius: float | None = None) -> tuple[np.ndarray, list[list[int]]]:
        """The home cell of each row and the cells within the radius, nearest first, by multi-sequence traversal."""
        radius = self.radius if radius is None else radius
        (own1, far1), (own2, far2) = (self.distances(h, part) for h, part in enumerate(self.halves(x)))
        width, out, most = len(self.books[1]), [], radius**2
        by1, by2 = far1.argsort(1, kind="stable"), far2.argsort(1, kind="stable")
        for i in range(len(x)):
            o1, o2, f1, f2 = by1[i], by2[i], far1[i] ** 2, far2[i] ** 2
            queue, seen, cells = [(f1[o1[0]] + f2[o2[0]], 0, 0)], {(0, 0)}, []
            while queue:
                d, a, b = heapq.heappop(queue)
                if d > most:
                    break
                cells.append(int(o1[a]) * width + int(o2[b]))
                for a2, b2 in ((a + 1, b), (a, b + 1)):
                    if a2 < len(o1) and b2 < len(o2) and (a2, b2) not in seen:
                        seen.add((a2, b2))
                        heapq.heappush(queue, (f1[o1[a2]] + f2[o2[b2]], a2, b2))
            out.append(cells)
        return own1 * width + own2, out


def fit(sample: np.ndarray, rows: int, labels: int, threshold: float = THRESHOLD) -> Index:
    """Codebooks from a sample of unit vectors, for a table of so many rows and labels."""
    if len(sample) < 8 or sample.shape[1] < 2:
        return Index(0, [], 0.0)
    k = int(min(MOST_WORDS, max(1, len(sample) // 4), max(1, math.ceil(math.sqrt(rows / max(1, labels) / CELL_ROWS)))))
    # a partner at the threshold is this far; each half moves at least to the border of its partner's cell
    index = Index(sample.shape[1], [], math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    index.books = [k_means(part, k) for part in index.halves(sample)]
    return index


def _linked(a: list[bytes], b: list[bytes], threshold: float = THRESHOLD) -> np.ndarray:
    out = np.zeros((len(a), len(b)), bool)
    one, other = ([np.frombuffer(x, np.float64) for x in y] for y in (a, b))
    for dim in {len(x) for x in one}:
        i = [k for k, x in enumerate(one) if len(x) == dim]
        j = [k for k, x in enumerate(other) if len(x) == dim]
        if i and j:
            out[np.ix_(i, j)] = np.stack([one[k] for k in i]) @ np.stack([other[k] for k in j]).T >= threshold
    return out


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, class_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    source = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vec_id, e, label in zip(batch.vec_id, batch.embedding, batch.label, strict=True):
                v = clean(e) if vec_id is not None and label is not None else None
                raw = None if v is None else np.asarray(e, dtype=np.float64)
                key = None if v is None else hashlib.md5((raw + 0.0).tobytes() + label.encode()).hexdigest()
                out.append((None if vec_id is None else int(vec_id), label, key, None if v is None else len(v)))
            yield pd.DataFrame(out, columns=["vec_id", "label", "class_key", "dim"], dtype=object)

    named = cut(source.mapInPandas(name, "vec_id long, label string, class_key string, dim int"), "named")
    usable = named.where("class_key is not null")
    heads = cut(usable.groupBy("class_key", "label", "dim").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")), "heads")
    shape = heads.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).first()
    dim = heads.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    picked = heads.where(F.col("dim") == (dim[0]["dim"] if dim else 0)).orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE_ROWS).select(F.col("class_id").cast("string").alias("vec_id"))
    # one vector per id, so no more than SAMPLE_ROWS come to the driver however often an id repeats
    rows = source.join(F.broadcast(picked), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toPandas().sort_values("vec_id")
    sample = [v for v in map(clean, rows.embedding) if v is not None and len(v) == dim[0]["dim"]][:SAMPLE_ROWS] if len(rows) else []
    index = fit(np.stack(sample) if sample else np.zeros((0, 0)), shape["n"], shape["labels"], threshold)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = [clean(e) for e in batch.embedding]
            home, walk = [0] * len(units), [[] for _ in units]
            own = [i for i, v in enumerate(units) if v is not None and len(v) == index.dim]
            if own:
                cells, found = index.walks(np.stack([units[i] for i in own]))
                for i, c, w in zip(own, cells, found, strict=True):
                    home[i], walk[i] = int(c), [x for x in w if x > c]
            yield pd.DataFrame({"node": batch.node, "copies": batch.copies, "label": batch.label, "dim": batch["dim"], "home": home, "walk": walk, "payload": [b"" if v is None else v.tobytes() for v in units]})

    firsts = heads.select(F.col("class_id").cast("string").alias("vec_id"), "label", F.col("class_id").alias("node"), "copies", "dim")
    told = source.join(firsts, ["vec_id", "label"])
    placed = cut(told.select("node", "copies", "label", "dim", "embedding").mapInPandas(place, "node long, copies long, label string, dim int, home int, walk array<int>, payload binary"), "placed")
    if _repeated(named):
        placed = cut(placed.dropDuplicates(["node", "label", "payload"]), "placed")

    # how many rows a cell lists and how many visit it, hence its blocks
    cell = ["label", "dim", "home"]
    visits = placed.select("label", "dim", F.explode("walk").alias("home"))
    listed = placed.groupBy(*cell).agg(F.count("*").alias("listed")).withColumn("parts", F.ceil(F.col("listed") / BLOCK_ROWS).cast("int"))
    asked = visits.groupBy(*cell).agg(F.count("*").alias("asked")).withColumn("asks", F.ceil(F.col("asked") / PROBE_ROWS).cast("int"))
    cells = cut(listed.join(asked, cell, "left").select(*cell, "listed", "parts", F.coalesce("asks", F.lit(0)).alias("asks")), "cells")

    key = lambda *x: F.concat_ws("|", "label", "dim", "home", *x)
    each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = placed.join(cells, cell).withColumn("part", part)
    inside = members.where("listed > 1").withColumn("y", F.explode(each("parts")))
    inside = inside.select(key(F.lit("in"), F.least("part", "y"), F.greatest("part", "y")).alias("block"), "node", "copies", F.when(F.col("part") == F.col("y"), 2).otherwise((F.col("part") > F.col("y")).cast("int")).alias("side"), "payload")
    answering = members.where("asks > 0").withColumn("y", F.explode(each("asks"))).select(key(F.lit("of"), "part", "y").alias("block"), "node", "copies", F.lit(1).alias("side"), "payload")
    asking = placed.withColumn("home", F.explode("walk")).join(cells, cell).withColumn("ask", F.pmod(F.xxhash64("node", F.lit(1)), F.col("asks")).cast("int"))
    asking = asking.withColumn("y", F.explode(each("parts"))).select(key(F.lit("of"), "y", "ask").alias("block"), "node", "copies", F.lit(0).alias("side"), "payload")
    blocks = inside.unionByName(answering).unionByName(asking).withColumn("part", F.lit(0).cast("long"))
    found = settle(blocks, lambda a, b: _linked(a, b, threshold))
    classes = heads.select("class_key", "class_id", "copies")
    return per_row(named.select("vec_id", "class_key"), classes, found, "vec_id")


def _repeated(ids: DataFrame) -> bool:
    return bool(ids.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1 and vec_id is not null").take(1))
