"""Line dedup: later copies of repeated runs of lines are deleted.

The corpus is a sequence of line ids, document after document in ascending id. Suffixes
are ranked by distributed prefix doubling: the rank of a suffix by its first 2k lines is the
order of the pair (its rank by k lines, the rank by k lines of the suffix k further on). Only
suffixes whose prefix occurs elsewhere stay, so a level holds repeated lines and no others,
and a document's end ends a prefix. Suffixes with equal ranks are an interval of the suffix array
with a longest common prefix of at least that depth.

A run counts if it has MIN_WORDS words (a line of none counts as one). The suffixes that share
a run's least qualifying prefix form an LCP interval, whose depth w is between two levels, 2^k <= w < 2^(k+1):
it is named by w and the ranks at level k of its first and its last 2^k lines. All
of an interval but its first suffix, in corpus order, are later copies, unless they overlap that first one in
its document: a run that repeats into itself keeps one whole copy. Windows are taken
least from the left and least from the right, for every line; a maximal repeated run is the
union of those in it, so exactly the lines of later copies of qualifying maximal runs are deleted.

Documents with equal texts are one document here; all but the first lose all lines if the
text qualifies. A window has at most MIN_WORDS lines, which bounds the levels.

Edge cases: null and empty texts have one empty line and never qualify; lines are compared without
white space of any kind around them, and only whole lines count: a passage set inside a longer line is not found; null ids come first; rows that repeat an id and a text are one
document, in which nothing is deleted that has no earlier copy; an empty table gives an empty result; further columns are
ignored (and kept, with their names, by deduplicated()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, or_empty
from .sharding import number_rows

MIN_WORDS = 50
#: All characters that Unicode counts as white space.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def windows(weights: list[int], least: int = MIN_WORDS) -> set[tuple[int, int]]:
    """(start, lines) of the least windows of weight `least` from each start and to each end."""
    total = np.concatenate([[0], np.cumsum(weights)])
    n, out = len(weights), set()
    ends = np.searchsorted(total, total[:-1] + least, side="left")
    out.update((i, int(e) - i) for i, e in enumerate(ends) if e <= n)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    out.update((int(s), i + 1 - int(s)) for i, s in enumerate(starts) if total[i + 1] >= least)
    return out


def _ranked(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys) of more than one row, with their dense order as rank."""
    found = cut(pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), name)
    return cut(number_rows(found, keys, name).withColumnRenamed("row_number", "rank"), f"{name}_rank")


def deleted_lines(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, n_lines, weight) of each document's text, and (key, lines) to delete from the first document of that key;
    every other document of a key whose weight qualifies is a copy."""
    text = or_empty(text_col)
    # one pass over the texts: a line is its MD5 and its number of words
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.unhex(F.md5(F.trim(x, F.lit(WHITE)).cast("binary"))).alias("name"), F.greatest(F.lit(1), F.regexp_count(x, F.lit(r"\S+"))).alias("words")))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("key"), lines.alias("lines")), "lines")
    told = rows.select("key", "doc_id", F.size("lines").alias("n_lines"), F.aggregate("lines.words", F.lit(0), lambda a, x: a + x).alias("weight"))
    # the first document of each text, numbered in corpus order
    heads = cut(rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("head"), F.first("lines").alias("lines")).select("key", "head.doc_id", "lines"), "heads")
    order = number_rows(heads.select("key", "doc_id"), ["doc_id", "key"], "order").withColumnRenamed("row_number", "doc").drop("doc_id")
    heads = cut(heads.join(order, "key").select("doc", "key", "lines"), "ordered")
    each = heads.select("doc", F.posexplode("lines").alias("line", "x")).select("doc", "line", "x.name")

    level = cut(each.join(_ranked(each, ["name"], "names"), "name").select("doc", "line", "rank"), "level")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(doc, start, n) for doc, weights in zip(batch.doc, batch.weights, strict=True) for start, n in windows(weights, least)]
            yield pd.DataFrame(out, columns=["doc", "start", "n"], dtype="int64")

    weights = heads.select("doc", F.col("lines.words").alias("weights"))
    spans = weights.join(level.select("doc").distinct(), "doc", "left_semi").mapInPandas(spread, "doc long, start int, n int")
    spans, found, size = cut(spans, "spans"), None, 1
    while size <= least:
        here = spans.where((F.col("n") >= size) & (F.col("n") < 2 * size)).withColumn("tail", (F.col("start") + F.col("n") - size).cast("int"))
        first = level.select("doc", F.col("line").alias("start"), F.col("rank").alias("a"))
        last = level.select("doc", F.col("line").alias("tail"), F.col("rank").alias("b"))
        ranked = here.join(first, ["doc", "start"]).join(last, ["doc", "tail"]).select("doc", "start", "n", "a", "b")
        found = ranked if found is None else found.unionByName(ranked)
        if 2 * size <= least:
            further = level.select("doc", (F.col("line") - size).alias("line"), F.col("rank").alias("b"))
            pairs = cut(level.withColumnRenamed("rank", "a").join(further, ["doc", "line"]), "pairs")
            level = cut(pairs.join(_ranked(pairs, ["a", "b"], "ranks"), ["a", "b"]).select("doc", "line", "rank"), "level")
        size *= 2
    found = cut(found, "windows")
    interval = found.groupBy("n", "a", "b").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = found.join(cut(interval, "intervals"), ["n", "a", "b"]).where((F.col("doc") > F.col("first.doc")) | (F.col("start") >= F.col("first.start") + F.col("n")))
    gone = later.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line"))
    gone = gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return told, cut(heads.select("doc", "key").join(gone, "doc").select("key", "lines"), "gone")


def dedup(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (the deleted lines' numbers from 0, ascending) of every row of docs."""
    told, gone = deleted_lines(docs, least, id_col, text_col)
    first = told.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("head")).select("key", F.col("head.doc_id").alias("head"))
    known = cut(first.join(gone, "key", "left"), "known")
    copy = ~F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("weight") >= least)
    every = F.sequence(F.lit(0), F.col("n_lines") - 1)
    lines = F.when(copy, every).otherwise(F.coalesce("lines", F.array().cast("array<int>")))
    return told.join(known, "key").select("doc_id", "n_lines", F.size(lines).alias("n_deleted"), lines.alias("deleted"))


def deduplicated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with the deleted lines cut from text, without the documents that lose all lines; columns and other values stay."""
    cols = docs.columns
    told, gone = deleted_lines(docs, least)
    first = told.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("head"), F.max("weight").alias("weight")).select("key", F.col("head.doc_id").alias("head"), "weight")
    known = cut(first.join(gone, "key", "left"), "known").select(F.col("key").alias("k"), "head", "weight", "lines")
    row = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    row = row.withColumn("k", F.md5(or_empty("t").cast("binary"))).join(known, "k")
    kept = F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains("lines", i))
    text = F.when(F.col("lines").isNull(), F.col("t")).when(F.size(kept) > 0, F.array_join(kept, "\n"))
    row = row.where(F.col("id").eqNullSafe(F.col("head")) | (F.col("weight") < least)).withColumn("new", text)
    row = row.where(F.col("lines").isNull() | F.col("new").isNotNull())
    return row.select(*[F.col("new").alias(c) if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)])
