"""Joins of texts' tokens on larger tables."""

from pyspark.sql import functions as F

from ledgerlens.operators import spans


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_texts_are_not_broadcast(spark):
    pages = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("See T-"), "id", F.lit(" is reversed, not T-"), F.col("id") + 1).alias("raw_text"))
    found = spans.transaction_spans(pages, spark.range(0, 50, 2).select(F.concat(F.lit("T-"), "id").alias("txn_id")), ["k"])
    after = spans.followed_by(found, pages, ["k"], "^ is reversed")
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(after)
    assert sorted(tuple(r) for r in after.collect()) == [(k, 4, 6 + len(str(k)), f"T-{k}") for k in range(0, 50, 2)]
