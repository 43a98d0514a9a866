"""Sharding by a keyed permutation of row numbers.

Rows are numbered 0 .. n-1 in ascending id order. A Feistel network permutes the smallest
power-of-two domain that holds n, its two halves one bit apart if the bits are odd; a value that lands at n
or above is permuted again until it falls below n (cycle walking), which keeps the map a bijection of 0 .. n-1. The image p
gives shard = p mod shards and slot = p div shards, so both are computable from a row
number alone, and shards differ by at most one row. Numbers of rows come from a range
sort of narrow rows plus the sizes of the ranges before; the permutation is column code.

The domain is less than 2 n, so of n rows about n / 2 ^ w are above n after w walks: for 2 ^ 40 rows, 2 ^ -216 of
a row after the 256 walks a column makes. What were left even so is walked on from a written table until none is.

Law: ``rows`` (counts at most one apart). Nothing holds rows with equal texts together:
a group of copies may be a third of all rows, more than any of 24 even shards. All rows
of a group are sharded like any other row.

Edge cases: a null text has size 8 and the crc32 of nothing, 0, as an empty one has; null
ids come first; rows that repeat are numbered one after another; an empty table gives an
empty result; columns other than id and text are carried by place, so names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, or_empty

LAW = "rows"
ROUNDS, WALKS = 4, 256
#: Round keys: fixed, so that every run and every reader gets the same order.
SEED = 20240229


def halves(n: int) -> tuple[int, int]:
    """The bits of the two halves of the smallest domain that holds n values."""
    bits = max(2, max(n - 1, 1).bit_length())
    return bits // 2, bits - bits // 2


def keyed(value: Column, key: Column) -> Column:
    """The round function: 48 bits of the MD5 of value and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", value.cast("string"), key).cast("binary")), 1, 12), 16, 10).cast("long")


def feistel(value: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of the permutation of the domain that holds n, as a column: the halves are altered in turns, each by the other."""
    left, right = halves(n)
    low = lambda bits: F.lit((1 << bits) - 1).cast("long")
    state = F.struct(F.shiftright(value, right).alias("l"), value.bitwiseAND(low(right)).alias("r"))
    keys = F.array(*[F.struct(F.lit(f"{seed}:{i}").alias("key"), F.lit(i % 2 == 0).alias("left")) for i in range(rounds)])
    turn = lambda s, k: F.struct(
        F.when(k["left"], s["l"].bitwiseXOR(keyed(s["r"], k["key"]).bitwiseAND(low(left)))).otherwise(s["l"]).alias("l"),
        F.when(k["left"], s["r"]).otherwise(s["r"].bitwiseXOR(keyed(s["l"], k["key"]).bitwiseAND(low(right)))).alias("r"),
    )
    last = F.aggregate(keys, state, turn)
    return F.shiftleft(last["l"], right).bitwiseOR(last["r"])


def walk(value: Column, n: int, seed: int = SEED, walks: int = WALKS) -> Column:
    """value if it is below n, else what up to `walks` passes make of it."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), value, lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, seed)))


def permute(rows: DataFrame, n: int, seed: int = SEED, walks: int = WALKS) -> DataFrame:
    """rows with place, the image of row_number: a pass, then passes until it is below n."""
    out = cut(rows.withColumn("place", walk(feistel(F.col("row_number"), n, seed), n, seed, walks)), "places")
    while out.where(F.col("place") >= n).take(1):
        out = cut(out.withColumn("place", walk(F.col("place"), n, seed, walks)), "places")
    return out


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with row_number 0 .. n-1 in the given order (a total one up to equal rows), as a written table.

    A range partition and a local sort; monotonically_increasing_id then holds the range and the
    place in it. Only one count per range goes to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed, name)
    sizes = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r["range"]], total = total, total + r["n"]
    start = F.lit(0).cast("long")
    if starts:
        offsets = F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts) + 1)])
        start = F.element_at(offsets, (F.shiftright("at", 33) + 1).cast("int"))
    return placed.withColumn("row_number", start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def shard(docs: DataFrame, shards: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every row."""
    text = or_empty(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = number_rows(narrow, ["doc_id", "text_crc32", "size"], "numbered")
    n = numbered.count()
    place = permute(numbered, n, seed) if n else numbered.withColumn("place", F.lit(0).cast("long"))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
