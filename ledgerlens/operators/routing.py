"""Ledger rows to scenarios: by the token in the transaction id, else by an account that one scenario owns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

TOKEN = r"^TXN-([^-]+)(?:-[^-]+)+$"


def account(raw: Column) -> Column:
    """Account ids compare trimmed and upper-cased."""
    return F.upper(F.trim(raw))


def token(txn_id: Column) -> Column:
    """The complete segment after TXN-, or NULL."""
    found = F.regexp_extract(F.trim(txn_id), TOKEN, 1)
    return F.when(found != "", found)


def deduplicated(ledger: DataFrame) -> DataFrame:
    """Rows with `duplicate`: TRUE for all but the first row of a transaction id; rows of one number go by counterparty and amount."""
    first = Window.partitionBy(F.trim("txn_id")).orderBy("row_index", "counterparty", "amount")
    return ledger.withColumn("duplicate", F.row_number().over(first) > 1)


def anchors(rows: DataFrame) -> DataFrame:
    """account -> the scenarios whose transactions name it (rows: account, token)."""
    return rows.where(F.col("token").isNotNull()).groupBy("account").agg(F.sort_array(F.collect_set("token")).alias("claims"))


def routed(ledger: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The first row of each transaction with its scenario_id (NULL where none is certain), scenario_token, method and confidence.

    The anchors are one aggregate per account with a partial one before the shuffle, joined back, so an account
    that holds a third of the rows is a skewed join, which Spark splits, and not a window. First rows are written once, as
    anchors and routing both read them.
    """
    rows = deduplicated(ledger).where(~F.col("duplicate")).withColumn("account", account(F.col("account_id"))).withColumn("named", token(F.col("txn_id")))
    known = scenarios.select(F.col("scenario_id").alias("token"))
    rows = written(rows.join(known, F.col("named") == F.col("token"), "left"), "named")
    rows = rows.join(anchors(rows.select("account", "token")), "account", "left")
    one = F.size("claims") == 1
    strong = F.col("token").isNotNull()
    method = F.when(strong & one, "TXN_ID_PREFIX").when(strong, "TXN_ID_ACCOUNT_CONFLICT").when(one, "ACCOUNT_ID_FALLBACK").otherwise("UNRESOLVED")
    found = F.col("method").isin("TXN_ID_PREFIX", "ACCOUNT_ID_FALLBACK")
    return rows.withColumn("method", method).select(
        *[c for c in ledger.columns if c != "txn_id"],
        F.trim("txn_id").alias("txn_id"),
        F.col("account").alias("account_id_normalized"),
        F.when(found, F.col("claims")[0]).alias("scenario_id"),
        F.col("token").alias("scenario_token"),
        "method",
        F.when(F.col("method") == "TXN_ID_PREFIX", "EXACT").when(F.col("method") == "ACCOUNT_ID_FALLBACK", "DERIVED").otherwise("UNRESOLVED").alias("confidence"),
    )


def route(ledger: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The links of routed rows: transaction, account, scenario, method."""
    return routed(ledger, scenarios).select("txn_id", "row_index", "account_id_normalized", "scenario_id", "scenario_token", "method", "confidence", F.col("counterparty").alias("counterparty_raw"))


def conflicts(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """kind, scenario_ids, account_id, rows: scenarios of several accounts, accounts of several scenarios, repeated ids."""
    claimed = links.where(F.col("scenario_token").isNotNull())
    several = claimed.groupBy("scenario_token").agg(F.count_distinct("account_id_normalized").alias("n"), F.count("*").alias("rows")).where("n > 1")
    shared = claimed.groupBy("account_id_normalized").agg(F.sort_array(F.collect_set("scenario_token")).alias("claims"), F.count("*").alias("rows")).where(F.size("claims") > 1)
    twice = deduplicated(ledger).where("duplicate").groupBy(F.trim("txn_id").alias("txn_id")).agg(F.count("*").alias("rows"))
    none = F.lit(None).cast("string")
    return (
        several.select(F.lit("SCENARIO_WITH_MULTIPLE_ACCOUNTS").alias("kind"), F.col("scenario_token").alias("subject"), F.lit("").alias("detail"), "rows")
        .unionByName(shared.select(F.lit("TRANSACTION_ACCOUNT_CONFLICT").alias("kind"), F.col("account_id_normalized").alias("subject"), F.array_join("claims", ",").alias("detail"), "rows"))
        .unionByName(twice.select(F.lit("DUPLICATE_TRANSACTION_ID").alias("kind"), F.col("txn_id").alias("subject"), F.coalesce(none, F.lit("")).alias("detail"), "rows"))
    )


def scenario_records(links: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Per scenario: its number in code-point order from 0, accounts and transactions; scenarios without any have 0."""
    per = links.where(F.col("scenario_id").isNotNull()).groupBy("scenario_id").agg(F.count("*").alias("txn_count"), F.sort_array(F.collect_set("account_id_normalized")).alias("accounts"))
    numbered = scenarios.withColumn("ordinal", F.row_number().over(Window.orderBy("scenario_id")) - 1)  # one row per scenario
    return numbered.join(per, "scenario_id", "left").select("scenario_id", "ordinal", F.coalesce("txn_count", F.lit(0)).alias("txn_count"), F.coalesce(F.size("accounts"), F.lit(0)).alias("account_count"))


def counterparties(links: DataFrame) -> DataFrame:
    """Per raw counterparty name: transactions, scenarios and accounts."""
    return links.groupBy("counterparty_raw").agg(F.count("*").alias("txn_count"), F.sort_array(F.collect_set("scenario_id")).alias("scenario_ids"), F.count_distinct("account_id_normalized").alias("account_count"))


def account_owners(links: DataFrame) -> DataFrame:
    """account -> scenarios that own it."""
    return links.where(F.col("scenario_id").isNotNull()).groupBy("account_id_normalized").agg(F.sort_array(F.collect_set("scenario_id")).alias("scenario_ids"))
