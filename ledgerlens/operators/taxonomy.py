"""Linked ledger rows to calculation inputs: parse, classify, adjust by facts, sign, and say why a row is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..types import AMOUNT, INFLOWS, POSITIVE_MAGNITUDE

PLAIN_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"


def parse_amount(raw: Column) -> Column:
    """A plain decimal; exponents, underscores, NaN and words don't parse."""
    return F.when(raw.rlike(PLAIN_NUMBER), F.trim(raw).try_cast(AMOUNT))


def amount_state(raw: Column) -> Column:
    return F.when(raw.isNull() | (F.trim(raw) == ""), "AMOUNT_MISSING").when(parse_amount(raw).isNull(), "AMOUNT_INVALID").otherwise("OK")


def parse_date(raw: Column) -> Column:
    """The first ten characters as an ISO date, or NULL."""
    return F.to_date(F.try_to_timestamp(F.substring(F.trim(raw), 1, 10), F.lit("yyyy-MM-dd")))


def sign_rule(category: Column) -> Column:
    return F.when(category.isin(*POSITIVE_MAGNITUDE), "POSITIVE_MAGNITUDE_AS_IS").when(category.isin(*INFLOWS), "INFLOW_AS_IS").otherwise("EXPENSE_NEGATE_SOURCE")


def metric_amount(amount: Column, category: Column, positive: Column | None = None) -> Column:
    """Expenses change sign, so a refund counts against them; inflows and magnitudes stay."""
    stays = category.isin(*INFLOWS, *POSITIVE_MAGNITUDE)
    if positive is not None:
        stays = stays | F.coalesce(positive, F.lit(False))
    return F.when(stays, amount).otherwise(-amount).cast(AMOUNT)


def classified(routed: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Routed rows with parsed fields and class. Each distinct description is classified once and joined back.

    overrides: (txn_id, description, category, confidence) of a model; used only where the rules say UNRESOLVED, the
    description is echoed and the confidence is HIGH.
    """
    kinds = routed.select("description").distinct().select(F.col("description").alias("said_as"), text.classify(F.col("description")).alias("hit"))
    rows = routed.join(kinds, F.col("description").eqNullSafe(F.col("said_as")), "left")
    out = rows.select(
        "row_index",
        F.trim("txn_id").alias("txn_id"),
        "scenario_id",
        "counterparty",
        "description",
        "currency",
        parse_date(F.col("date")).alias("transaction_date"),
        parse_amount(F.col("amount")).alias("source_amount"),
        amount_state(F.col("amount")).alias("amount_state"),
        F.col("hit.status").alias("class_status"),
        F.col("hit.category").alias("category"),
        F.col("hit.rule").alias("rule"),
    )
    if overrides is not None:
        o = overrides.select("txn_id", F.col("description").alias("said"), F.col("category").alias("proposed"), "confidence")
        good = (F.col("class_status") == "UNRESOLVED") & F.col("rule").isNull() & (F.col("said") == F.col("description")) & (F.col("confidence") == "HIGH")
        out = out.join(o, "txn_id", "left").withColumn("use", F.coalesce(good, F.lit(False)))
        out = out.withColumns({"category": F.when(F.col("use"), F.col("proposed")).otherwise(F.col("category")), "rule": F.when(F.col("use"), "SEMANTIC_MODEL").otherwise(F.col("rule")), "class_status": F.when(F.col("use"), "CLASSIFIED").otherwise(F.col("class_status"))})
        out = out.drop("said", "proposed", "confidence", "use")
    return out


def agreed(facts: DataFrame, value: list[str]) -> DataFrame:
    """Facts per transaction: the one distinct value, or conflict; (transaction_id, value..., fact_ids, conflict)."""
    row = F.struct(*value)
    per = facts.where(F.col("transaction_id").isNotNull()).groupBy("transaction_id").agg(F.count_distinct(row).alias("n"), F.min(row).alias("v"), F.sort_array(F.collect_set("fact_id")).alias("fact_ids"))
    return per.select("transaction_id", *[F.when(F.col("n") == 1, F.col(f"v.{c}")).alias(c) for c in value], "fact_ids", (F.col("n") > 1).alias("conflict"))


def linked_facts(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts that name a transaction, with link_status: LINKED, FACT_SCENARIO_MISMATCH or UNUSED."""
    known = links.select(F.col("txn_id").alias("transaction_id"), F.col("scenario_id").alias("txn_scenario"))
    joined = facts.join(known, "transaction_id", "left")
    status = F.when(F.col("txn_scenario").isNull(), "UNUSED").when(F.col("txn_scenario") != F.col("scenario_id"), "FACT_SCENARIO_MISMATCH").otherwise("LINKED")
    return joined.withColumn("link_status", status)


def reclass_targets(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """(fact_id, status, txn_id): by id in the scenario, else by amount and counterparty; none is UNUSED, several are ambiguous."""
    from ..functions.names import identity_key

    r = rows.where(F.col("scenario_id").isNotNull()).select("scenario_id", "txn_id", F.abs("source_amount").alias("size"), identity_key(F.col("counterparty")).alias("name"))
    by_id = facts.where(F.col("transaction_id").isNotNull()).join(r.select("scenario_id", F.col("txn_id").alias("transaction_id")), ["scenario_id", "transaction_id"]).select("fact_id", F.col("transaction_id").alias("txn_id"))
    loose = facts.where(F.col("transaction_id").isNull()).select("fact_id", "scenario_id", F.abs("amount").cast(AMOUNT).alias("size"), identity_key(F.col("counterparty")).alias("name"))
    by_value = loose.join(r, ["scenario_id", "size", "name"]).select("fact_id", "txn_id")
    hits = by_id.unionByName(by_value).groupBy("fact_id").agg(F.count_distinct("txn_id").alias("n"), F.min("txn_id").alias("txn_id"))
    out = facts.select("fact_id").join(hits, "fact_id", "left")
    return out.select("fact_id", F.when(F.col("n").isNull(), "UNUSED").when(F.col("n") > 1, "FACT_LINK_AMBIGUOUS").otherwise("LINKED").alias("status"), F.when(F.col("n") == 1, F.col("txn_id")).alias("txn_id"))


def add_back_targets(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """One-time add-backs to rows: same scenario, name and size, within the service dates if given; unique matches only."""
    from ..functions.names import identity_key

    f = facts.select("fact_id", "scenario_id", F.abs("amount").cast(AMOUNT).alias("size"), identity_key(F.coalesce("counterparty", "entity_name")).alias("name"), "service_start", "service_end")
    r = rows.select("scenario_id", "txn_id", "transaction_date", F.abs("source_amount").alias("size"), identity_key(F.col("counterparty")).alias("name"))
    inside = (F.col("service_start").isNull() | (F.col("transaction_date") >= F.col("service_start"))) & (F.col("service_end").isNull() | (F.col("transaction_date") <= F.col("service_end")))
    hits = f.join(r, ["scenario_id", "size", "name"]).where(inside).groupBy("fact_id").agg(F.count_distinct("txn_id").alias("n"), F.min("txn_id").alias("txn_id"))
    return f.select("fact_id").join(hits, "fact_id", "left").select("fact_id", F.when(F.col("n") == 1, "ATTACHED").when(F.col("n") > 1, "FACT_LINK_AMBIGUOUS").otherwise("DERIVED").alias("status"), F.when(F.col("n") == 1, F.col("txn_id")).alias("txn_id"))


def corrected(rows: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """Rows after the facts on single transactions, in their order: amount corrections, reclassification, periods, treatment.

    Corrections keep the sign of the source, or take the category's where the source is missing. Facts on a
    transaction that disagree are a conflict, and none of them applies. What was before stays in before_*.
    """
    ok = linked_facts(facts, links).where(F.col("link_status") == "LINKED")
    of = lambda kind, value, names: agreed(ok.where(F.col("fact_kind") == kind), value).select(F.col("transaction_id").alias("txn_id"), *[F.col(v).alias(n) for v, n in zip(value, names, strict=True)], F.col("conflict").alias(f"{names[0]}_conflict"))
    # labels are few and their rules long, so each distinct one is resolved once
    labels = ok.select("to_category").where("to_category is not null").distinct().select(F.col("to_category").alias("new_category"), text.label_category(F.col("to_category")).alias("said_category"))
    out = rows
    for one in (
        of("AMOUNT_CORRECTION", ["amount"], ["new_amount"]),
        of("RECLASSIFICATION", ["to_category", "disposition"], ["new_category", "reclass"]).join(labels, "new_category", "left"),
        of("PERIOD", ["disposition", "service_start", "service_end"], ["period_rule", "new_start", "new_end"]),
        of("TREATMENT", ["disposition"], ["treatment"]),
    ):
        out = out.join(one, "txn_id", "left")
    expense = ~F.col("category").isin(*INFLOWS, *POSITIVE_MAGNITUDE)
    minus = F.when(F.col("source_amount").isNotNull(), F.col("source_amount") < 0).otherwise(expense)
    amount = F.when(F.col("new_amount").isNotNull(), F.when(minus, -F.abs("new_amount")).otherwise(F.abs("new_amount"))).otherwise(F.col("source_amount"))
    category = F.when(F.col("reclass") == "ACCEPTED", F.coalesce("said_category", "category")).otherwise(F.col("category"))
    conflict = F.coalesce(*[F.when(F.col(c), F.lit(c.split("_conflict")[0])) for c in ("new_amount_conflict", "new_category_conflict", "period_rule_conflict", "treatment_conflict")])
    return out.withColumns({"before_amount": F.col("source_amount"), "before_category": F.col("category")}).withColumns({"source_amount": amount.cast(AMOUNT), "category": category, "fact_conflict": conflict}).withColumns(
        {
            "period_excluded": F.coalesce(F.col("period_rule") == "EXCLUDE", F.lit(False)),
            "period_start": F.when(F.col("period_rule") == "ASSIGN", F.col("new_start")),
            "period_end": F.when(F.col("period_rule") == "ASSIGN", F.col("new_end")),
        }
    )


def drop_reason(treatment: Column | None = None, conflict: Column | None = None) -> Column:
    """Why a row is no input, or NULL."""
    out = F.when(F.col("scenario_id").isNull(), "NO_SCENARIO")
    if treatment is not None:
        out = out.when(treatment == "EXCLUDE", "TREATMENT_EXCLUDED")
    if conflict is not None:
        out = out.when(conflict.isNotNull(), "FACT_CONFLICT")
    return out.when(F.col("class_status") == "CONFLICT", "CLASSIFICATION_CONFLICT").when(F.col("category").isNull(), "UNCLASSIFIED").when(F.col("source_amount").isNull(), F.coalesce("amount_state", F.lit("AMOUNT_MISSING")))


def inputs(rows: DataFrame, related: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """Calculation inputs of classified rows. related: (scenario_id, counterparty, related_party); status: (scenario_id, counterparty, subsidiary_status)."""
    at = lambda c, other: F.col(c) if c in rows.columns else other
    none = lambda k: F.lit(None).cast(k)
    kept = rows.where(drop_reason(at("treatment", None), at("fact_conflict", None)).isNull())
    for table, name, default in ((related, "related_party", "UNKNOWN"), (status, "subsidiary_status", "UNKNOWN")):
        if table is None:
            kept = kept.withColumn(name, F.lit(default))
        else:
            kept = kept.join(table.select("scenario_id", "counterparty", name), ["scenario_id", "counterparty"], "left").withColumn(name, F.coalesce(name, F.lit(default)))
    flag = F.coalesce(text.rule_flag(F.col("rule")), text.label_flag(at("new_category", none("string"))))
    return kept.select(
        F.concat(F.lit("LEDGER:"), F.col("txn_id")).alias("input_id"),
        "scenario_id",
        F.lit("LEDGER").alias("source_kind"),
        F.col("txn_id").alias("transaction_id"),
        "category",
        text.memberships(F.col("category"), F.col("description")).alias("selector_categories"),
        metric_amount(F.col("source_amount"), F.col("category")).alias("amount"),
        "source_amount",
        "currency",
        F.lit("FLOW").alias("period_semantics"),
        "transaction_date",
        at("period_start", none("date")).alias("period_start"),
        at("period_end", none("date")).alias("period_end"),
        none("date").alias("as_of_date"),
        at("period_excluded", F.lit(False)).alias("period_excluded"),
        "related_party",
        F.lit("BORROWER").alias("entity_scope"),
        "subsidiary_status",
        F.array_compact(F.array(flag)).alias("flags"),
    )


def derived(facts: DataFrame) -> DataFrame:
    """Inputs that only documents have: severance, group capital expenditure, unattached add-backs, contingent obligations."""
    of = {"OFF_LEDGER_AMOUNT": "SEVERANCE_LIABILITY", "GROUP_CAPEX": "GROUP_CAPEX", "ONE_TIME_ADD_BACK": "ONE_TIME_ADD_BACKS", "CONTINGENT_OBLIGATION": "OTHER_EXPENSE"}
    category = F.coalesce(*[F.when(F.col("fact_kind") == k, F.lit(c)) for k, c in of.items()])
    none = lambda k: F.lit(None).cast(k)
    group = F.col("fact_kind") == "GROUP_CAPEX"
    return facts.where(F.col("fact_kind").isin(*of) & F.col("amount").isNotNull()).select(
        F.concat(F.lit("FACT:"), F.col("fact_id")).alias("input_id"), "scenario_id", F.lit("FACT").alias("source_kind"), "transaction_id", category.alias("category"), F.array(category).alias("selector_categories"),
        F.abs("amount").cast(AMOUNT).alias("amount"), F.col("amount").cast(AMOUNT).alias("source_amount"), "currency",
        F.when(F.col("as_of_date").isNotNull() & F.col("service_start").isNull(), "AS_OF").otherwise("FLOW").alias("period_semantics"), none("date").alias("transaction_date"),
        F.col("service_start").alias("period_start"), F.col("service_end").alias("period_end"), "as_of_date", F.lit(False).alias("period_excluded"), F.lit("UNKNOWN").alias("related_party"),
        F.when(group, "GROUP").otherwise("BORROWER").alias("entity_scope"), F.lit("UNKNOWN").alias("subsidiary_status"),
        F.array_compact(F.array(F.when(group, F.lit("GROUP_LEVEL_SOURCE")), F.when(F.col("fact_kind") == "CONTINGENT_OBLIGATION", F.col("label")))).alias("flags"),
    )


def convert(inputs_: DataFrame, rate: DataFrame, source: str = "EUR", target: str = "USD") -> DataFrame:
    """Inputs of scenarios with a trusted rate (scenario_id, rate) in the target currency; others stay as they are."""
    out = inputs_.join(rate, "scenario_id", "left")
    use = (F.col("currency") == source) & F.col("rate").isNotNull()
    return out.withColumns({"amount": F.when(use, F.col("amount") * F.col("rate")).otherwise(F.col("amount")).cast(AMOUNT), "currency": F.when(use, F.lit(target)).otherwise(F.col("currency"))}).drop("rate")


def unique_rate(facts: DataFrame) -> DataFrame:
    """(scenario_id, rate): a scenario's one explicit rate."""
    of = facts.where((F.col("fact_kind") == "FX_RATE") & F.col("amount").isNotNull())
    return of.groupBy("scenario_id").agg(F.count_distinct("amount").alias("n"), F.min("amount").alias("rate")).where("n = 1").select("scenario_id", "rate")


def settlement_rate(pairs: DataFrame) -> DataFrame:
    """The one ratio of settled to invoiced amounts in the corpus, between 0.5 and 2, or no row: (rate)."""
    ratio = (F.col("settled") / F.col("invoiced")).cast("decimal(18,6)")
    return pairs.select(ratio.alias("rate")).where("rate > 0.5 and rate < 2").agg(F.count_distinct("rate").alias("n"), F.min("rate").alias("rate")).where("n = 1").select("rate")


def manifest(inputs_: DataFrame) -> DataFrame:
    """Counters: inputs by category, by membership and by related-party state, in one pass over the inputs."""
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    names = F.concat(F.array(of("category", F.col("category")), of("related_party", F.col("related_party"))), F.transform("selector_categories", lambda m: of("membership", m)))
    return inputs_.select(F.explode(names).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
