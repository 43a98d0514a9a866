"""Benchmark decontamination: a BM25 index of the test items, walked with block-max WAND.

Items are cut into segments of at most SEGMENT words, so that a passage can hold one whole. The
index lists, for each term, the segments with the term's share of the segment's own BM25
score: a segment scores 1 against itself, and one threshold holds for long and short items.
Every document is read as overlapping passages of words, and every passage is a query that
retrieves all segments at or above the threshold. Segments are grouped in GROUPS groups, and a
passage whose terms' largest shares in no group sum to the threshold ends there: these sums, of
distinct terms only, are taken for all passages of a document at once. The others walk the
lists, skipping blocks whose maxima are too small.

A retrieved item is verified on the words around the passage: of its question (all sentences but the
last) and of its answer (the last sentence) at least half of the word trigrams must be there.

The items are read in blocks of about INDEX_ITEMS items and INDEX_WORDS words at most, each an index of its own with its own
statistics. One block is broadcast, and its items collected, at a time: every document meets every block in a pass of
its own, and a block's index is given up before the next is built.

Edge cases: null, empty and short texts have no passage that reaches the threshold unless they hold an item;
items without words match nothing; an item of one sentence is question and answer at once; a
null item_id is reported as null in item_ids; repeated documents are judged alike; repeated items are found under each id; empty
tables leave all documents clean; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SEGMENT, PASSAGE, STRIDE = 48, 64, 32
THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 3
K1, B, BLOCK, GROUPS = 1.2, 0.75, 64, 64
#: Items and words of an index that is broadcast, which so takes a few tens of MB.
INDEX_ITEMS, INDEX_WORDS = 20_000, 2_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words, _SENTENCE.split((text or "").strip())) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(ids: list[int], n: int) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)}


class Index:
    """Postings of item segments with blockwise maxima."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.term: dict[str, int] = {}
        self.items: list[int | None] = []
        self.checks: list[tuple[int, list[tuple[int, set]]]] = []
        segments: list[list[int]] = []
        self.owner: list[int] = []
        for item_id, text in items:
            question, answer = question_and_answer(text)
            every = words(text)
            if not every:
                continue
            ids = lambda ws: [self.term.setdefault(w, len(self.term)) for w in ws]
            checks = [(n := min(GRAM, len(part)), grams(ids(part), n)) for part in (question, answer)]
            self.checks.append((len(every), checks))
            self.items.append(item_id)
            parts = max(1, math.ceil(len(every) / SEGMENT))
            for k in range(parts):
                segments.append(ids(every[len(every) * k // parts : len(every) * (k + 1) // parts]))
                self.owner.append(len(self.items) - 1)
        df = Counter(t for s in segments for t in set(s))
        mean = sum(map(len, segments)) / max(1, len(segments))
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, s in enumerate(segments):
            tf = Counter(s)
            share = {t: math.log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * len(s) / mean)) for t, k in tf.items()}
            whole = sum(share.values())
            for t, x in share.items():
                lists[t].append((i, x / whole))
        self.docs = [[d for d, _ in lists[t]] for t in range(len(self.term))]
        self.shares = [[x for _, x in lists[t]] for t in range(len(self.term))]
        self.tops = [[max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for s in self.shares]
        self.bound = np.array([max(s) for s in self.shares] + [0.0])  # the last is for words that no item has
        self.groups = np.zeros((len(self.term) + 1, GROUPS), np.float32)
        for t, (at, share) in enumerate(zip(self.docs, self.shares, strict=True)):
            np.maximum.at(self.groups[t], np.array(at) % GROUPS, np.array(share, np.float32))

    def near(self, ids: np.ndarray, threshold: float) -> np.ndarray:
        """The places of the passages that may reach the threshold in some group of segments.

        Passages are two halves of STRIDE words. A word counts once per passage: in the first half if it wasn't there
        before, in the second if in neither half before.
        """
        order = np.argsort(ids, kind="stable")
        last = np.full(len(ids), -1)
        same = ids[order[1:]] == ids[order[:-1]]
        last[order[1:][same]] = order[:-1][same]
        half = np.arange(len(ids)) // STRIDE * STRIDE
        share = self.groups[ids]
        edges = np.arange(0, len(ids), STRIDE)
        total = np.add.reduceat(share * (last < half)[:, None], edges, axis=0)
        if len(edges) > 1:
            total[:-1] += np.add.reduceat(share * (last < half - STRIDE)[:, None], edges, axis=0)[1:]
        found = np.flatnonzero((total >= threshold - 1e-4).any(axis=1))
        return found[(found == 0) | (found < len(edges) - 1)] * STRIDE

    def search(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments that score threshold or more, by block-max WAND."""
        docs, shares, tops, bound, end = self.docs, self.shares, self.tops, self.bound, len(self.owner)
        cursors = [[docs[t][0], 0, t] for t in terms]
        found, slack = [], threshold - 1e-12
        while True:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, (d, _, t) in enumerate(cursors):
                if d >= end:
                    break
                total += bound[t]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            most, upto = 0.0, end
            for c in cursors[: pivot + 1]:
                lst = docs[c[2]]
                at = bisect_left(lst, doc, c[1])
                if at < len(lst):
                    block = at // BLOCK
                    most += tops[c[2]][block]
                    upto = min(upto, lst[min(len(lst), (block + 1) * BLOCK) - 1] + 1)
            if most >= slack:
                if cursors[0][0] == doc:
                    score = sum(shares[t][at] for d, at, t in cursors[: pivot + 1] if d == doc)
                    if score >= slack:
                        found.append((doc, float(score)))
                    to = doc + 1
                else:
                    to = doc
            else:
                to = max(doc + 1, upto)
                if pivot + 1 < len(cursors):
                    to = max(doc + 1, min(to, cursors[pivot + 1][0]))
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    c[1] = bisect_left(docs[c[2]], to, c[1])
                    c[0] = docs[c[2]][c[1]] if c[1] < len(docs[c[2]]) else end

    def overlaps(self, item: int, ids: list[int]) -> bool:
        """Whether at least OVERLAP of the grams of both the question and the answer are among ids."""
        return all(len(want & grams(ids, n)) >= OVERLAP * len(want) for n, want in self.checks[item][1])

    def leaks(self, text: str | None, threshold: float = THRESHOLD) -> dict[int, float]:
        """Verified items of a whole text with their best passage score."""
        none = len(self.term)
        get = self.term.get
        ids = np.array([get(w, none) for w in words(text)], dtype=np.int64)
        if not len(ids) or not none:
            return {}
        best: dict[int, float] = {}
        for a in self.near(ids, threshold).tolist():
            b = min(a + PASSAGE, len(ids))
            terms = set(ids[a:b].tolist())
            terms.discard(none)
            for segment, score in self.search(terms, threshold):
                item = self.owner[segment]
                if score > best.get(item, 0.0):
                    n = self.checks[item][0]
                    if item in best or self.overlaps(item, ids[max(0, a - n) : b + n].tolist()):
                        best[item] = score
        return best


def indexes(benchmark: DataFrame) -> Iterator:
    """(number of blocks, broadcast index) of each block of items; the index is destroyed when the next one is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", r"\W+"))).alias("words")).first()
    blocks = max(1, math.ceil(size["n"] / INDEX_ITEMS), math.ceil((size["words"] or 0) / INDEX_WORDS))
    for k in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        held = spark.sparkContext.broadcast(Index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))))
        yield blocks, held
        if blocks > 1:
            held.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), best_score (0 if none) of every row of docs."""

    def searched(rows: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = held.value
            for batch in batches:
                got = [index.leaks(t, threshold) for t in batch.text]
                items = [[index.items[i] for i in g] for g in got]
                yield pd.DataFrame({"key": batch.key, "items": items, "score": [max(g.values(), default=0.0) for g in got]})

        return rows.mapInPandas(run, "key string, items array<long>, score double")

    source = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    numbered, found = None, None
    for blocks, held in indexes(benchmark):
        if blocks == 1:
            out = searched(source, held).withColumnsRenamed({"key": "doc_id", "items": "every", "score": "best"})
            break
        # several passes: rows get a number once, and each pass writes what it found
        if numbered is None:
            numbered = cut(source.withColumn("at", F.monotonically_increasing_id()), "numbered")
        here = cut(searched(numbered.select(F.col("at").cast("string").alias("key"), "text"), held).where("size(items) > 0"), "found")
        found = here if found is None else found.unionByName(here)
    else:
        per = found.groupBy(F.col("key").cast("long").alias("at")).agg(F.flatten(F.collect_list("items")).alias("every"), F.max("score").alias("best"))
        out = numbered.select("at", F.col("key").alias("doc_id")).join(per, "at", "left")
    ids = F.array_distinct(F.coalesce("every", F.array().cast("array<long>")))
    ids = F.concat(F.array_sort(F.array_compact(ids)), F.filter(ids, lambda x: x.isNull()))
    out = out.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("best_score"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").alias("n_items"), "item_ids", "best_score")


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item, in the columns of docs: documents are judged where they are read, and written between the passes of several blocks."""

    def cleaned(rows: DataFrame, held) -> DataFrame:
        @F.pandas_udf("boolean")
        def clean(text: pd.Series) -> pd.Series:
            return pd.Series([not held.value.leaks(t, threshold) for t in text], dtype=bool)

        return rows.where(clean(F.col("text")))

    for blocks, held in indexes(benchmark):
        docs = cleaned(docs, held) if blocks == 1 else cut(cleaned(docs, held), "clean")
    return docs
