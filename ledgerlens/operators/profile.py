"""Table profiles: types, nulls, distinct values, extremes and examples of every column, and what names suggest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that suggest a meaning, with a confidence.
SEMANTICS = (
    ("transaction_id", ("transaction_id", "txn_id", "tx_id"), 0.9), ("document_id", ("document_id", "doc_id"), 0.85), ("case_id", ("case_id", "caseid"), 0.9),
    ("entity_id", ("entity_id", "party_id", "customer_id"), 0.8), ("counterparty_id", ("counterparty_id", "counterparty"), 0.85), ("contract_id", ("contract_id", "agreement_id"), 0.85),
    ("invoice_id", ("invoice_id", "invoice"), 0.8), ("amount", ("amount", "sum", "value", "total"), 0.8), ("currency", ("currency", "ccy", "curr"), 0.9), ("status", ("status", "state"), 0.75),
    ("transaction_type", ("transaction_type", "txn_type", "type"), 0.7), ("occurred_at", ("occurred_at", "occurred", "event_time", "timestamp"), 0.85), ("posted_at", ("posted_at", "posted"), 0.85),
    ("settled_at", ("settled_at", "settled"), 0.85), ("reversal_of_id", ("reversal_of_id", "reversal_of"), 0.9), ("parent_transaction_id", ("parent_transaction_id", "parent_txn_id"), 0.9),
    ("description", ("description", "memo", "narrative", "comment"), 0.7), ("decision", ("decision", "verdict", "outcome"), 0.75), ("evidence", ("evidence", "proof", "citation"), 0.75),
    ("record_id", ("record_id", "id", "row_id"), 0.6),
)


def column_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower().replace("-", "_")).strip("_") or "unnamed"


def semantics(name: str) -> list[tuple[str, float]]:
    """The three likeliest meanings of a column's name: exact names, then names that contain one."""
    n = column_name(name)
    hits = [(kind, c if n in tokens else max(0.5, c - 0.15)) for kind, tokens, c in SEMANTICS if n in tokens or any(len(x) >= 4 and x in n for x in tokens)]
    return sorted(hits, key=lambda h: (-h[1], h[0]))[:3] or [("unknown", 0.2)]


def primitive(value: Column) -> Column:
    """The type a text looks like; NULL for blank ones."""
    s, low = F.trim(value), F.lower(F.trim(value))
    bare = F.replace(s, F.lit(","), F.lit(""))
    number = bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(value.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(low.isin("true", "false", "yes", "no", "y", "n"), "BOOLEAN")
        .when(s.rlike(r"^[+-]?\d+$"), "INTEGER")
        .when(number, F.when(s.rlike("[.,]"), "DECIMAL").otherwise("INTEGER"))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}Z?$"), "DATETIME")
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), "DATE")
        .otherwise("STRING")
    )


def merged(kinds: Column) -> Column:
    """The type of a column from the distinct types of its values."""
    only = lambda *names: F.size(F.array_except(kinds, F.array(*map(F.lit, names)))) == 0
    return F.when(F.size(kinds) == 0, "NULL").when(F.size(kinds) == 1, kinds[0]).when(only("INTEGER", "DECIMAL"), "DECIMAL").when(only("DATE", "DATETIME"), "DATETIME").otherwise("MIXED")


def profile(df: DataFrame, columns: list[str] | None = None, most: int = 80) -> DataFrame:
    """One row per column: position, rows, nulls, distinct, least, greatest, the three least examples, type.

    All columns are profiled in one pass: rows become (position, value) and are counted per value first, with partial counts, so
    a frequent value is one row after the shuffle; distinct counts are exact.
    """
    names = columns or df.columns
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in names])).alias("position", "value"))
    values = cells.groupBy("position", "value").agg(F.count("*").alias("n"))
    filled = F.col("value").isNotNull() & (F.trim("value") != "")
    kept = F.when(filled, F.col("value"))
    per = values.groupBy("position").agg(
        F.sum("n").alias("rows"), F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("nulls"), F.count(kept).alias("distinct_values"), F.min(kept).alias("least"), F.max(kept).alias("greatest"),
        F.sort_array(F.collect_set(primitive(F.col("value")))).alias("kinds"),
    )
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(F.col(c))
    return per.select(F.element_at(F.array(*map(F.lit, names)), F.col("position") + 1).alias("column_name"), "position", "rows", "nulls", "distinct_values", cut("least").alias("least"), cut("greatest").alias("greatest"), merged(F.col("kinds")).alias("type"))


def examples(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The n least distinct values of a column."""
    return df.select(F.col(column).cast("string").alias("value")).where("trim(value) <> ''").distinct().orderBy("value").limit(n)


def role(path: str, fmt: str, semantic: set[str] | None = None) -> str:
    """What a file of a data set is for, by its name, format and columns."""
    name = path.lower()
    if fmt == "ZIP":
        return "NESTED_ARCHIVE"
    if "template" in name or "submission" in name:
        return "SUBMISSION_TEMPLATE"
    if "scor" in name or "rubric" in name:
        return "SCORING_RULES"
    if "case" in name or "scenario" in name:
        return "CASE_DEFINITION"
    if fmt in ("CSV", "XLSX", "JSONL") and semantic and len(semantic & {"transaction_id", "amount", "currency"}) >= 2:
        return "TRANSACTION_TABLE"
    if fmt in ("PDF", "DOCX", "IMAGE"):
        return "DOCUMENT"
    return "METADATA" if "meta" in name or "manifest" in name or "readme" in name else "UNKNOWN"


def answer_key(payload) -> bool:
    """Whether a parsed JSON value is shaped like an answer key: scenarios that map to covenants with a status and an actual."""
    scenarios = payload.get("scenarios") if isinstance(payload, dict) else None
    if not isinstance(scenarios, dict):
        return False
    cells = [c for s in scenarios.values() if isinstance(s, dict) for c in (s.get("covenants") or {}).values()]
    return any(isinstance(c, dict) and c.get("status") is not None and "actual" in c for c in cells)
