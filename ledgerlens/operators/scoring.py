"""Publication and scoring of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a right status, actual and evidence are worth, and the error at which an actual is worth nothing.
STATUS_WEIGHT, ACTUAL_WEIGHT, EVIDENCE_WEIGHT, TOLERANCE = 0.5, 0.3, 0.2, 0.05


def published(value: Column) -> Column:
    """Absolute, two places, half up."""
    return F.round(F.abs(value.cast("decimal(38,10)")), 2)


def verdict(status: Column, compliance: Column, actual: Column) -> Column:
    """COMPLIANT, BREACH or NULL; a covenant that isn't activated is complied with if its actual is known."""
    return F.when(status == "RESOLVED", compliance).when((status == "NOT_ACTIVATED") & actual.isNotNull(), F.lit("COMPLIANT"))


def softened(compliance: Column, comparator: Column, actual: Column, threshold: Column, margin: float = 0.05) -> Column:
    """A breach of a ceiling by at most the margin counts as compliance; off by default everywhere."""
    near = (comparator == "LTE") & (compliance == "BREACH") & (actual <= threshold * (1 + margin))
    return F.when(near, F.lit("COMPLIANT")).otherwise(compliance)


def submission(template: DataFrame, results: DataFrame, evidence: DataFrame | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """One row per cell of the template: status, published actual, evidence; cells without a result are NULL, and filled by fallback if given."""
    r = results.select("scenario_id", "clause_id", "definition_id", verdict(F.col("status"), F.col("compliance"), F.col("value")).alias("verdict"), published(F.col("value")).alias("actual"))
    out = template.join(r, ["scenario_id", "clause_id"], "left")
    if evidence is not None:
        out = out.join(evidence.select("definition_id", "txn_id"), "definition_id", "left")
    else:
        out = out.withColumn("txn_id", F.lit(None).cast("string"))
    if fallback is not None:
        f = fallback.select("scenario_id", "clause_id", verdict(F.col("status"), F.col("compliance"), F.col("value")).alias("f_verdict"), published(F.col("value")).alias("f_actual"))
        out = out.join(f, ["scenario_id", "clause_id"], "left").withColumns({"actual": F.when(F.col("verdict").isNull(), F.col("f_actual")).otherwise(F.col("actual")), "verdict": F.coalesce("verdict", "f_verdict")})
    return out.select("scenario_id", "clause_id", F.col("verdict").alias("status"), F.when(F.col("verdict").isNotNull(), F.col("actual")).alias("actual"), F.col("txn_id").alias("evidence_txn_id"))


def relative_error(submitted: Column, expected: Column) -> Column:
    """NULL stands for infinite."""
    exact = F.when(submitted == expected, F.lit(0.0))
    return F.when(F.abs(expected) == 0, exact).otherwise(F.abs(submitted - expected).cast("double") / F.abs(expected).cast("double"))


def scored(submitted: DataFrame, truth: DataFrame) -> DataFrame:
    """Score of every cell of truth: 0 without the right status, else its weight plus the parts of actual and evidence."""
    s = submitted.select("scenario_id", "clause_id", F.col("status").alias("s_status"), F.col("actual").alias("s_actual"), F.col("evidence_txn_id").alias("s_evidence"))
    rows = truth.join(s, ["scenario_id", "clause_id"], "left").withColumn("error", relative_error(F.col("s_actual"), F.col("actual")))
    factor = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("error") / TOLERANCE), F.lit(0.0))
    right = F.coalesce((F.col("s_status") == F.col("status")) & F.col("actual").isNotNull() & F.col("status").isin("COMPLIANT", "BREACH"), F.lit(False))
    proof = F.when(F.col("evidence_txn_id").isNull(), EVIDENCE_WEIGHT * factor).when(F.col("s_evidence") == F.col("evidence_txn_id"), EVIDENCE_WEIGHT).otherwise(0.0)
    return rows.select(
        "scenario_id",
        "clause_id",
        F.when(right, STATUS_WEIGHT + ACTUAL_WEIGHT * factor + proof).otherwise(0.0).alias("score"),
        right.alias("status_ok"),
        F.when(right, ACTUAL_WEIGHT * factor).otherwise(0.0).alias("actual_part"),
        F.when(right, proof).otherwise(0.0).alias("evidence_part"),
    )


def totals(cells: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """cells, score, uniform share and, with weights (scenario_id, clause_id, weight), the weighted share."""
    w = cells.withColumn("weight", F.lit(1.0)) if weights is None else cells.join(weights, ["scenario_id", "clause_id"], "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    return w.agg(F.count("*").alias("cells"), F.sum("score").alias("score"), F.avg("score").alias("uniform"), (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("weighted"))


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only: (keys, side) with MISSING (only right) or EXTRA (only left)."""
    a, b = left.select(*keys), right.select(*keys)
    return b.exceptAll(a).withColumn("side", F.lit("MISSING")).unionByName(a.exceptAll(b).withColumn("side", F.lit("EXTRA")))


def same_output(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two outputs have equal rows: (rows_a, rows_b, equal), by counts and order-free sums of row hashes."""
    row = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    digest = lambda df, n: df.agg(F.count("*").alias(f"rows_{n}"), F.sum(row).alias(f"hash_{n}"))
    both = digest(a, "a").crossJoin(digest(b, "b"))  # one row each
    return both.select("rows_a", "rows_b", ((F.col("rows_a") == F.col("rows_b")) & F.col("hash_a").eqNullSafe(F.col("hash_b"))).alias("equal"))
