"""Mixing sources to target weights.

Every document gets a key that hashes like a random number. Within a source the keys
are ranges of a hash space, so a range partition of them is even however large the
source is: prefix sums of sizes are a running sum inside a range plus the totals of the
ranges before it. A source is cut at its budget; a budget above its size repeats it.
Everything is DataFrame code.

Edge cases: a null or blank text has size 0 and is taken 0 words; null sources form one
source that comes last; rows that repeat (also with the same id) are separate documents,
ordered by key, id and text; an empty table gives an empty result; columns other than
id, text and source are ignored, so their names may be anything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
#: Key ranges per source: a range for each so many rows of the table, within these bounds.
ROWS_A_RANGE, MOST_RANGES = 128, 4096
_KEY_BITS = 40


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    """What a document's key is made of: MD5 of its id and text, in hexadecimal."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def key_of(hash_col: str) -> Column:
    return F.conv(F.substring(hash_col, 1, _KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: weights 1, 2, 3, 1, ... in code-point order, nulls last.

    The shares of all sizes are capped at most_epochs times a source's size; what is above
    goes to the others by weight. Ascending in cap / weight, a source is capped as long as its
    cap is within its share of what the capped ones before it leave. One row per source is
    sorted here, never one per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most_epochs)
    # cap / weight as an integer: weights divide 6
    order = Window.orderBy((F.col("cap") * 6 / F.col("weight")).cast("long"), F.col("source").isNull(), "source")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    known = (
        weighed.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fits", F.col("cap") * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
        .withColumn("capped", F.min("fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    free = F.when(~F.col("capped"), F.col("left_size"))
    shared = known.withColumn("free_size", F.max(free).over(whole)).withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole))
    # the first source that is not capped has what all capped ones leave: the largest left_size among the uncapped
    shared = shared.withColumn(
        "target",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("free_size") * F.col("weight")).cast("double") / F.col("free_weight").cast("double")),
    )
    return shared.select("source", "source_size", "target")


def mix(docs: DataFrame, most_epochs: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, epochs (whole passes), part (words of the
    pass that the budget cuts), taken = epochs * size + part."""
    # texts are read once; from here on the rows are a few numbers wide
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), hashed(F.col(id_col), F.col(text_col)).alias("hash"))
    narrow = cut(kept.withColumn("key", key_of("hash")), "mix")
    n = narrow.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / ROWS_A_RANGE)))
    narrow = narrow.withColumn("range", F.floor(F.col("key") * ranges / F.lit(float(1 << _KEY_BITS))).cast("int"))

    cells = narrow.groupBy("source", "range").agg(F.sum("size").alias("cell_size"))
    cells = cut(cells, "cells")
    goals = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), most_epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).alias("c")
    cells = cells.join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "c.range", "c.offset", "g.source_size", "g.target")
    cells = cut(cells, "offsets")

    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    run = narrow.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    cells = cells.alias("c")
    placed = run.join(cells, F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.range") == F.col("c.range")), "left").select("d.*", "c.offset", "c.source_size", "c.target")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    epochs = F.least(epochs, F.lit(most_epochs)).cast("long")
    rest = F.when(F.col("epochs") < most_epochs, budget - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0))
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("run"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken", "key", "hash")
    )


def mixed_documents(docs: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus in the columns of docs: a document as often as the mix takes it.

    The document in which a source's budget ends is taken whole in that pass, so no text is
    altered; a source exceeds its budget by less than one document. Documents without words
    cost nothing and are kept once. What a source takes is a position in its key order, so the
    documents themselves are joined with one row per source and never shuffled by id.
    """
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    place = F.struct("key", "doc_id", "hash")
    taken = mix(docs.select("doc_id", "text", "source"), most_epochs)
    cuts = cut(taken.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("part") > 0, place)).alias("last")), "cuts").alias("s")
    keyed = docs.select("doc_id", "source", hashed(F.col("doc_id"), F.col("text")).alias("hash"), words(F.col("text")).alias("size"), row.alias("row"))
    placed = keyed.withColumn("key", key_of("hash")).withColumn("place", place).alias("d").join(cuts, F.col("d.source").eqNullSafe(F.col("s.source")))
    once_more = F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("int")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs").cast("int") + once_more)
    copies = placed.withColumn("times", times).where("times > 0").select(F.explode(F.expr("array_repeat(row, times)")).alias("row"))
    return copies.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)])
