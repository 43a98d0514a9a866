"""The engine's inputs, made from the order tables: a ledger with noise, the scenarios, facts and definitions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import algebra as a
from ..types import GTE, LTE, MONEY, PERCENT, RATIO

#: Descriptions by part: what a line was for. The sign of the amount follows the first column.
DESCRIPTIONS = (
    (1, "Customer invoice collection - March settlement"), (-1, "Catalyst regeneration servicing contract"), (-1, "Quarterly interest on term loan"), (-1, "Payroll - production staff"),
    (-1, "Electricity supply charge"), (-1, "Property tax instalment"), (-1, "Insurance premium - fleet"), (-1, "Office rent - head office"), (1, "Revolver drawdown"),
    (-1, "Equipment purchase for plant"), (-1, "Warehouse lease payment"), (-1, "Product launch ad campaign"), (-1, "Legal and consulting engagement"), (1, "Insurance refund received"),
    (-1, "Severance package"), (-1, "Transfer of assets to unrestricted subsidiary"), (1, "Interest income on deposit"), (-1, "Office rent and equipment lease combined charge"),
    (-1, "Telecom leased line - site office"), (-1, "Miscellaneous unclassified internal memo"), (1, "Sales proceeds - wholesale"), (-1, "Operating expenses - depot"),
    (-1, "Cleaning and supplies"), (-1, "Capitalised interest charge - Q4"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows as text, in the form of a source file: some ids malformed, some amounts missing or invalid, some dates absent."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    kind = (F.col("l_partkey") % len(DESCRIPTIONS)).cast("int")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    token = F.concat(F.lit("N"), F.col("c_nationkey"))
    value = F.col("l_extendedprice").cast("decimal(18,2)") * F.element_at(F.array(*[F.lit(s) for s, _ in DESCRIPTIONS]), kind + 1)
    return rows.select(
        ((key * 10 + line) * 1_000_000 + F.col("l_partkey")).cast("long").alias("row_index"),
        F.when(key % 97 == 0, F.concat(F.lit("REV-"), token, F.lit("-"), key, F.lit("-"), line))
        .when(key % 193 == 0, F.concat(F.lit("txn-"), token, F.lit("-"), key, F.lit("-"), line))
        .otherwise(F.concat(F.lit("TXN-"), token, F.lit("-"), key, F.lit("-"), line))
        .alias("txn_id"),
        F.when((key % 227 == 0) & (F.col("c_nationkey") % 4 == 1), F.lit(None)).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.concat(F.lit(" acc-"), F.col("o_custkey"), F.lit(" ")).alias("account_id"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(" LLP")).otherwise(F.lit(" JSC"))).alias("counterparty"),
        F.element_at(F.array(*[F.lit(d) for _, d in DESCRIPTIONS]), kind + 1).alias("description"),
        F.when(key % 211 == 0, F.lit("")).when(key % 223 == 0, F.lit("n/a")).otherwise(value.cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when((F.col("c_nationkey") % 7 == 3) & (F.col("l_partkey") % 48 == 1), F.lit("EUR")).otherwise(F.lit("USD")).alias("currency"),
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe of scenarios: a nation each, all but every eighth."""
    return read(spark, sf_dir, "nation").where("n_nationkey % 8 <> 7").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("scenario_id"))


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of ownership: (scenario_id, entity_name, percent); some names are damaged."""
    s = read(spark, sf_dir, "supplier")
    form = F.when(F.col("s_suppkey") % 2 == 0, F.lit(" LLP")).otherwise(F.lit(" JSC"))
    name = F.concat(F.lit("Supplier "), F.col("s_suppkey"), form)
    return s.where("s_suppkey % 5 < 2").select(
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("scenario_id"),
        F.when(F.col("s_suppkey") % 15 == 1, F.regexp_replace(name, "ppl", "p?l")).otherwise(name).alias("entity_name"),
        ((F.col("s_suppkey") * 7) % 60).cast("decimal(9,4)").alias("percent"),
    )


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, percent) of related parties: two for every sixth scenario, none for every fifth."""
    n = read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4")
    scenario = F.concat(F.lit("N"), F.col("n_nationkey")).alias("scenario_id")
    return n.select(scenario, F.lit(25).cast("decimal(9,4)").alias("percent")).unionByName(n.where("n_nationkey % 6 = 5").select(scenario, F.lit(30).cast("decimal(9,4)").alias("percent")))


def sets(category: str, **more) -> a.Expr:
    return a.Sum(a.TransactionSet(a.Selector(category, **more)))


def _families() -> dict[str, tuple[a.Expr, str, a.Quantity, a.Expr]]:
    """The formula families: metric, comparator, a threshold, activation."""
    r, o = sets("REVENUE"), sets("OPEX")
    e = a.Subtract(r, o)
    x = lambda name, **more: sets(name, **more)
    ratio = lambda v: a.Quantity(RATIO, Decimal(v))
    money = lambda v: a.Quantity(MONEY, Decimal(v), "USD")
    always = a.Always()
    draw = a.Compare(x("FINANCING_INFLOWS"), "GT", a.Constant(money("1000000")))
    return {
        "INTEREST_COVER_RATIO": (a.Divide(e, x("INTEREST_EXPENSE")), GTE, ratio("1.5"), always),
        "SPRINGING_DRAWDOWN_LEVERAGE": (a.Divide(x("FINANCING_INFLOWS"), e), LTE, ratio("3"), draw),
        "SOURCES_OVER_USES_RATIO": (a.Divide(a.Add(r, x("FINANCING_INFLOWS")), a.Add(o, x("CAPEX"))), GTE, ratio("1.1"), always),
        "CAPITAL_INTENSITY_RATIO": (a.Divide(x("CAPEX"), a.Add(o, x("LEASE_PAYMENTS"))), LTE, ratio("0.6"), always),
        "MIN_INSURANCE_COVER_RATIO": (a.Divide(x("INSURANCE_PREMIUMS"), a.Add(x("RENT"), x("UTILITIES"))), GTE, ratio("0.1"), always),
        "MIN_ADJ_EBITDA_MARGIN": (a.Divide(a.Add(e, x("ONE_TIME_ADD_BACKS")), r), GTE, a.Quantity(PERCENT, Decimal(10)), always),
        "MAX_GROUP_CAPEX_TO_BORROWER_EBITDA": (a.Divide(x("GROUP_CAPEX", group_level=True), e), LTE, ratio("0.5"), always),
        "MAX_TAX_UTILITIES_TO_EBITDA": (a.Divide(a.Add(x("TAXES"), x("UTILITIES")), e), LTE, ratio("4"), always),
        "MAX_RP_AS_RATIO_OF_OPEX": (a.Divide(x("RELATED_PARTY_PAYMENTS"), o), LTE, ratio("0.2"), always),
        "MIN_REVENUE_COVER_OF_PAYROLL_UTILITIES": (a.Divide(r, a.Add(x("LABOR"), x("UTILITIES"))), GTE, ratio("0.75"), always),
        "MAX_CAPITAL_TRANSFERS_TO_UNRESTRICTED_SUBS_RATIO": (a.Divide(x("CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS"), x("CAPEX")), LTE, ratio("0.3"), always),
        "MAX_RELATED_PARTY_RATIO_OF_REVENUE": (a.Divide(x("RELATED_PARTY_PAYMENTS"), r), LTE, ratio("0.25"), always),
        "MIN_REVENUE_MINUS_MAX_OVERHEAD": (a.Subtract(r, a.Max((x("LABOR"), x("TAXES")))), GTE, money("100000"), always),
        "MAX_SINGLE_OVERHEAD_LINE": (a.Max((x("LABOR"), x("UTILITIES"))), LTE, money("3000000"), always),
        "MAX_PERSONNEL_OBLIGATIONS": (a.Add(x("LABOR"), x("SEVERANCE_LIABILITY")), LTE, money("5000000"), always),
        "MAX_RELATED_PARTY_PAYMENTS": (x("RELATED_PARTY_PAYMENTS"), LTE, money("2000000"), always),
        "MAX_CAPEX": (x("CAPEX"), LTE, money("4000000"), always),
        "MIN_REVENUE": (r, GTE, money("1000000"), always),
        "MIN_REVENUE_QUARTER": (a.PeriodAggregate(r, "FINANCIAL_QUARTER", "MIN"), GTE, money("10000"), always),
    }


FAMILIES = _families()
PERIOD = a.Period("CLOSED_INTERVAL", "1997-01-01", "1998-12-31")


def definitions(scenario_ids: list[str], families: list[str] | None = None, period: a.Period = PERIOD) -> list[a.Definition]:
    return [
        a.simple_definition(f"{s}:{name}", s, str(k), FAMILIES[name][0], FAMILIES[name][1], FAMILIES[name][2], activation=FAMILIES[name][3], period=period, family_id=name)
        for s in scenario_ids
        for k, name in enumerate(families or FAMILIES)
    ]
