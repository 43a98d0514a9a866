"""The registered queries over the order tables and documents."""

from __future__ import annotations

import calendar
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import types as t
from .functions import money as money_in
from .functions import names, periods, text
from .operators import coverage as cov
from .operators import documents as docs
from .operators import evidence, facts, grids, profile, related, retrieval, routing, scoring, spans, taxonomy
from .operators import selectors as sel
from .plans import algebra as a
from .plans import clauses
from .plans import compile as c
from .sources import tables as src
from .sources.scratch import written
from .streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def _ids(spark: SparkSession, d: str) -> list[str]:
    """The scenarios: tens of names."""
    return sorted(r[0] for r in src.scenarios(spark, d).collect())


def _links(spark: SparkSession, d: str) -> DataFrame:
    return routing.route(src.ledger(spark, d), src.scenarios(spark, d))


def _routed(spark: SparkSession, d: str) -> DataFrame:
    """Routed rows, written once: parties, classes and inputs all come from them."""
    return written(routing.routed(src.ledger(spark, d), src.scenarios(spark, d)), "routed")


def _parties(spark: SparkSession, d: str, routed: DataFrame | None = None) -> DataFrame:
    rows = _routed(spark, d) if routed is None else routed
    return written(rows.where("scenario_id is not null").select("scenario_id", "counterparty").distinct(), "parties")


def _related(spark: SparkSession, d: str, parties: DataFrame | None = None) -> DataFrame:
    return related.resolve(_parties(spark, d) if parties is None else parties, src.ownership(spark, d), src.thresholds(spark, d))


def _status(spark: SparkSession, d: str) -> DataFrame:
    s = src.read(spark, d, "supplier")
    form = F.when(F.col("s_suppkey") % 2 == 0, F.lit(" LLP")).otherwise(F.lit(" JSC"))
    state = lambda n: F.when(F.col("s_suppkey") % n == 0, "UNRESTRICTED").otherwise("RESTRICTED")
    base = s.where("s_suppkey % 3 < 2").select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey")).alias("scenario_id"), F.concat(F.lit("Supplier "), F.col("s_suppkey"), form).alias("entity_name"))
    return base.select("scenario_id", "entity_name", state(2).alias("status")).unionByName(base.where("s_suppkey % 7 = 0").select("scenario_id", "entity_name", state(5).alias("status")))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.classified(_routed(spark, d))


def _inputs_of(spark: SparkSession, d: str, routed: DataFrame, classified: DataFrame) -> DataFrame:
    parties = _parties(spark, d, routed)
    return taxonomy.inputs(classified, _related(spark, d, parties), related.subsidiaries(parties, _status(spark, d)))


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    routed = _routed(spark, d)
    return _inputs_of(spark, d, routed, taxonomy.classified(routed))


def _results(spark: SparkSession, d: str, period: a.Period = src.PERIOD, families: list[str] | None = None, strict: bool = False) -> DataFrame:
    return c.evaluate(src.definitions(_ids(spark, d), families, period), _inputs(spark, d), strict)


def _shown(results: DataFrame) -> DataFrame:
    return results.select("definition_id", "scenario_id", "status", "compliance", "activation", "currency", F.round(F.col("value").cast("double"), 6).alias("actual"), F.array_join("issues", ",").alias("issues"))


# Ledger: scan, route, classify


@query("a1_ledger")
def a1(spark, d):
    return src.ledger(spark, d)


@query("s14_route")
def s14(spark, d):
    return _links(spark, d).select("txn_id", "row_index", "account_id_normalized", "scenario_id", "scenario_token", "method", "confidence")


@query("w3_duplicates")
def w3(spark, d):
    return routing.deduplicated(src.ledger(spark, d)).where("duplicate").select("row_index", "txn_id")


@query("w7_conflicts")
def w7(spark, d):
    return routing.conflicts(src.ledger(spark, d), _links(spark, d))


@query("a5_f4_scenarios")
def f4(spark, d):
    return routing.scenario_records(_links(spark, d), src.scenarios(spark, d))


@query("f1_counterparties")
def f1(spark, d):
    return routing.counterparties(_links(spark, d)).select("counterparty_raw", "txn_count", F.array_join("scenario_ids", ",").alias("scenario_ids"), "account_count")


@query("c11_account_owners")
def c11(spark, d):
    return routing.account_owners(_links(spark, d)).select("account_id_normalized", F.array_join("scenario_ids", ",").alias("scenario_ids"))


@query("s1_s2_s3_classify")
def s1(spark, d):
    seen = src.ledger(spark, d).groupBy("description").agg(F.count("*").alias("n")).withColumn("hit", text.classify(F.col("description")))
    return seen.select("description", "n", "hit.status", "hit.category", "hit.rule", F.array_join("hit.competing", ",").alias("competing"))


@query("s4_s5_s6_memberships")
def s4(spark, d):
    seen = src.ledger(spark, d).select("description").distinct().withColumn("category", text.classify(F.col("description"))["category"]).where("category is not null")
    return seen.select(
        "description", "category", F.array_join(text.memberships(F.col("category"), F.col("description")), ",").alias("memberships"),
        F.array_join(text.membership_reasons(F.col("category"), F.col("description")), ",").alias("reasons"), text.operating_tax(F.col("description")).cast("string").alias("operating_tax"),
    )


@query("s7_s8_s9_labels")
def s7(spark, d):
    label = F.concat(F.lower("p_name"), F.lit(" "), F.element_at(F.array(*map(F.lit, ("Marketing Expenses", "Group CAPEX", "Operating  expenses", "Advisory fees", "REVENUE", "other"))), (F.col("p_partkey") % 6 + 1).cast("int")))
    label = F.when(F.col("p_partkey") % 5 == 0, F.element_at(F.split(label, " ", 3), 3)).otherwise(label)
    return src.read(spark, d, "part").select("p_partkey", text.label_category(label).alias("category"), text.label_flag(label).alias("flag"))


@query("m7_amounts")
def m7(spark, d):
    rows = src.ledger(spark, d).select(taxonomy.amount_state(F.col("amount")).alias("state"), taxonomy.parse_amount(F.col("amount")).alias("v"), taxonomy.parse_date(F.col("date")).alias("day"))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"), F.count("day").alias("dated"))


@query("m8_m9_signs")
def m8(spark, d):
    rows = _classified(spark, d).where("category is not null and source_amount is not null")
    return rows.groupBy("category", taxonomy.sign_rule(F.col("category")).alias("rule")).agg(F.count("*").alias("n"), F.sum(taxonomy.metric_amount(F.col("source_amount"), F.col("category"))).cast("double").alias("total"))


@query("b13_drop_reasons")
def b13(spark, d):
    return _classified(spark, d).groupBy(F.coalesce(taxonomy.drop_reason(), F.lit("KEPT")).alias("reason")).agg(F.count("*").alias("n"))


@query("r1_calculation_inputs")
def r1(spark, d):
    return _inputs(spark, d).select(
        "input_id", "scenario_id", "category", F.array_join("selector_categories", ",").alias("memberships"), F.col("amount").cast("double").alias("amount"), "currency",
        F.col("transaction_date").cast("string").alias("day"), "related_party", "subsidiary_status", F.array_join("flags", ",").alias("flags"),
    )


@query("f2_manifest")
def f2(spark, d):
    return taxonomy.manifest(_inputs(spark, d))


# Related parties


@query("c5_c9_owners")
def c5(spark, d):
    return related.owners(src.ownership(spark, d), src.thresholds(spark, d)).select("scenario_id", "entity_name", "identity", F.col("percent").cast("double").alias("percent"), F.col("damaged").cast("string").alias("damaged"))


@query("c6_related_party")
def c6(spark, d):
    return _related(spark, d)


@query("c7_c8_recovered")
def c8(spark, d):
    return related.recovered(related.damaged(src.ownership(spark, d), src.thresholds(spark, d)), _parties(spark, d))


@query("c10_subsidiaries")
def c10(spark, d):
    return related.subsidiaries(_parties(spark, d), _status(spark, d))


@query("s10_s11_s12_names")
def s10(spark, d):
    raw = F.concat(F.lit('"'), F.upper("s_name"), F.lit('"'), F.element_at(F.array(*map(F.lit, (" L.L.P.", ", JSC", " ao", ""))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return src.read(spark, d, "supplier").select("s_suppkey", names.identity_key(raw).alias("identity"), names.base_key(raw).alias("base"), names.legal_form(raw).alias("form"))


# Facts on transactions


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that name ledger transactions, one of each row: corrections, reclassifications, periods and treatments, some of them in conflict."""
    rows = routing.deduplicated(src.ledger(spark, d)).where(~F.col("duplicate"))
    scenario = F.regexp_extract("txn_id", r"^[A-Za-z]+-([^-]+)-", 1)
    n = (F.col("row_index") % 4).cast("int")
    kinds = F.array(*map(F.lit, ("AMOUNT_CORRECTION", "RECLASSIFICATION", "PERIOD", "TREATMENT")))
    one = rows.select(
        F.concat(F.lit("F"), F.col("row_index")).alias("fact_id"), F.when(F.col("row_index") % 9 == 0, F.lit("N0")).otherwise(scenario).alias("scenario_id"), F.element_at(kinds, n + 1).alias("fact_kind"),
        F.trim("txn_id").alias("transaction_id"), F.when(n == 0, F.lit(Decimal(1250))).cast(t.AMOUNT).alias("amount"), F.when(n == 1, F.lit("Capex")).alias("to_category"),
        F.element_at(F.array(*map(F.lit, ("", "ACCEPTED", "EXCLUDE", "EXCLUDE"))), n + 1).alias("disposition"), F.lit(None).cast("date").alias("service_start"), F.lit(None).cast("date").alias("service_end"),
        F.lit(None).cast("decimal(9,4)").alias("percent"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("entity_name"), F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("period_label"), F.lit(None).cast("string").alias("label"),
    )
    again = one.where(F.col("fact_id").rlike("0$") & (F.col("fact_kind") == "AMOUNT_CORRECTION")).withColumns({"fact_id": F.concat("fact_id", F.lit("b")), "amount": F.lit(Decimal(999)).cast(t.AMOUNT)})
    return one.unionByName(again)


@query("c2_fact_links")
def c2(spark, d):
    return taxonomy.linked_facts(_facts(spark, d), _links(spark, d)).select("fact_id", "fact_kind", "link_status")


@query("f13_f14_fact_conflicts")
def f13(spark, d):
    return facts.conflicts(_facts(spark, d)).select("fact_kind", "scenario_id", "identity", "values", F.array_join("fact_ids", ",").alias("fact_ids"))


@query("f15_fact_dedupe")
def f15(spark, d):
    f = _facts(spark, d)
    return facts.deduplicated(f.unionByName(f.withColumn("fact_id", F.concat(F.lit("Z"), F.col("fact_id"))))).select("fact_id", "fact_kind")


@query("f17_m10_corrected")
def f17(spark, d):
    out = taxonomy.corrected(_classified(spark, d), _facts(spark, d), _links(spark, d))
    changed = out.where("new_amount is not null or reclass is not null or period_excluded or treatment is not null or fact_conflict is not null")
    return changed.select("txn_id", "category", F.col("source_amount").cast("double").alias("source_amount"), F.col("period_excluded").cast("string").alias("period_excluded"), "treatment", "fact_conflict")


@query("c3_reclass_targets")
def c3(spark, d):
    l = src.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))).alias("l"))
    o = src.read(spark, d, "orders").select("o_orderkey", "o_custkey").join(src.read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    token = F.concat(F.lit("N"), F.col("c_nationkey"))
    f = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("R"), F.col("l_orderkey")).alias("fact_id"), token.alias("scenario_id"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("TXN-"), token, F.lit("-"), F.col("l_orderkey"), F.lit("-"), F.col("l.l_linenumber"))).alias("transaction_id"),
        F.col("l.v").cast(t.AMOUNT).alias("amount"), F.concat(F.lit("SUPPLIER  "), F.col("l.l_suppkey"), F.when(F.col("l.l_suppkey") % 2 == 0, " llp").otherwise(" jsc")).alias("counterparty"),
    )
    return taxonomy.reclass_targets(f, _classified(spark, d))


@query("c4_add_backs")
def c4(spark, d):
    o = src.read(spark, d, "orders").select("o_orderkey", "o_custkey").join(src.read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    l = src.read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.to_date("l_shipdate")
    f = l.select(
        F.concat_ws("-", F.lit("AB"), "l_orderkey", "l_linenumber", "l_partkey").alias("fact_id"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("scenario_id"), F.col("l_extendedprice").cast("decimal(18,2)").cast(t.AMOUNT).alias("amount"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey"), F.when(F.col("l_suppkey") % 2 == 0, " LLP").otherwise(" JSC")).alias("counterparty"), F.lit(None).cast("string").alias("entity_name"),
        F.when(F.col("l_linenumber") % 3 == 0, F.date_add(day, 5)).alias("service_start"), F.lit(None).cast("date").alias("service_end"),
    )
    return taxonomy.add_back_targets(f, _classified(spark, d))


# Evaluation


@query("e13_evaluate")
def e13(spark, d):
    return _shown(_results(spark, d))


@query("f3_manifest")
def f3(spark, d):
    return c.manifest(_results(spark, d))


@query("e14_trace")
def e14(spark, d):
    """What each node of two families came to."""
    out = c.trace(src.definitions(_ids(spark, d), ["MAX_CAPEX", "MAX_SINGLE_OVERHEAD_LINE"]), _inputs(spark, d))
    return out.select("definition_id", "step", "kind", "status", "qtype", F.round(F.when(F.col("qtype") == t.MONEY, F.col("value")).cast("double"), 4).alias("amount"), "currency", F.array_join("issues", ",").alias("issues"))


@query("e13_strict")
def e13_strict(spark, d):
    return _shown(_results(spark, d, families=["MIN_REVENUE_QUARTER", "MAX_CAPEX"], strict=True))


@query("e12_springing")
def e12(spark, d):
    return _shown(_results(spark, d, families=["SPRINGING_DRAWDOWN_LEVERAGE"]))


@query("d11_period_aggregate")
def d11(spark, d):
    defs = [a.simple_definition(f"{s}:{r}", s, r, a.PeriodAggregate(src.sets("UTILITIES"), g, r), t.LTE, a.Quantity(t.MONEY, Decimal(400000), "USD"), period=src.PERIOD) for s in _ids(spark, d) for g, r in (("MONTH", "MAX"), ("YEAR", "SUM"), ("FINANCIAL_QUARTER", "MIN"))]
    return _shown(c.evaluate(defs, _inputs(spark, d)))


@query("b8_materiality")
def b8(spark, d):
    floor = a.Floor("UTILITIES", Decimal(50000), "USD")
    defs = [a.Definition(f"{s}:FLOOR", s, "1", src.sets("UTILITIES"), t.LTE, a.Quantity(t.MONEY, Decimal(400000), "USD"), src.PERIOD, floor=floor) for s in _ids(spark, d)]
    return _shown(c.evaluate(defs, _inputs(spark, d)))


@query("d16_counts")
def d16(spark, d):
    count = lambda s, k: a.Definition(f"{s}:COUNT:{k}", s, "1", a.Count(a.TransactionSet(a.Selector(k))), t.LTE, a.Quantity(t.COUNT, Decimal(20)), src.PERIOD)
    return _shown(c.evaluate([count(s, k) for s in _ids(spark, d) for k in ("LABOR", "TAXES", "RENT")], _inputs(spark, d)))


@query("e4_e5_compound")
def e4(spark, d):
    """Breach if revenue is low, or if labour exceeds taxes and utilities exceed a limit."""
    usd = lambda v: a.Constant(a.Quantity(t.MONEY, Decimal(v), "USD"))
    breach = a.Or((a.Compare(src.sets("REVENUE"), t.LT, usd(500000)), a.And((a.Compare(src.sets("LABOR"), t.GT, src.sets("TAXES")), a.Not(a.Compare(src.sets("UTILITIES"), t.LTE, usd(900000)))))))
    defs = [a.Definition(f"{s}:COMPOUND", s, "1", src.sets("REVENUE"), t.GTE, a.Quantity(t.MONEY, Decimal(500000), "USD"), src.PERIOD, breach=breach) for s in _ids(spark, d)]
    return _shown(c.evaluate(defs, _inputs(spark, d)))


@query("b3_b4_b5_b6_periods")
def b3(spark, d):
    """Rows in, out of and undecidable for four kinds of period."""
    ps = [("closed", a.Period("CLOSED_INTERVAL", "1997-03-01", "1997-09-30", start_inclusive=False)), ("quarter", a.Period("FINANCIAL_QUARTER", quarter=2)), ("asof", a.Period("AS_OF", as_of="1997-06-30")), ("mixed", a.Period("MIXED", as_of="1998-01-01", flow_start="1997-01-01", flow_end="1997-12-31"))]
    kind = "struct<kind:string,start:date,end:date,as_of:date,start_inclusive:boolean,end_inclusive:boolean,quarter:int,flow_start:date,flow_end:date>"
    rows = [(n, (p.kind, c._date(p.start), c._date(p.end), c._date(p.as_of), p.start_inclusive, p.end_inclusive, p.quarter, c._date(p.flow_start), c._date(p.flow_end))) for n, p in ps]
    table = F.broadcast(spark.createDataFrame(rows, f"name string, period {kind}"))  # four rows
    got = _inputs(spark, d).crossJoin(table)
    return got.groupBy("name", sel.in_period().cast("string").alias("member"), sel.at_or_before(F.col("transaction_date")).cast("string").alias("at_or_before")).agg(F.count("*").alias("n"))


@query("b1_b2_selectors")
def b1(spark, d):
    """How many inputs each category's selector takes, with and without related parties only."""
    table = spark.createDataFrame([(k, r) for k in t.CATEGORIES for r in (False, True)], "wanted string, related_only boolean")
    none = F.array().cast("array<string>")
    got = _inputs(spark, d).crossJoin(F.broadcast(table)).where(sel.matches(F.col("wanted"), F.col("related_only"), F.lit(False), none, F.array(F.lit("MARKETING"))))
    return got.groupBy("wanted", F.col("related_only").cast("string").alias("related_only")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("c13_f7_coverage")
def c13(spark, d):
    slots = c.slot_table(spark, src.definitions(_ids(spark, d)))
    n = src.read(spark, d, "nation")
    needs = n.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("scenario_id"), F.lit("SUBSIDIARY_STATUS").alias("fact_kind"), F.when(F.col("n_nationkey") % 2 == 0, "RESOLVED").otherwise("UNRESOLVED").alias("state"), F.lit(None).cast("string").alias("reason"))
    return cov.coverage(slots, _inputs(spark, d), needs)


@query("f6_readiness")
def f6(spark, d):
    return cov.readiness(c13(spark, d))


@query("r8_universe")
def r8(spark, d):
    known = spark.createDataFrame([(s,) for s in [*_ids(spark, d)[1:], "N99"]], "scenario_id string")
    return cov.invalid(_inputs(spark, d), known)


@query("c14_c15_only_period")
def c14(spark, d):
    o = src.read(spark, d, "orders")
    per = o.select((F.col("o_custkey") % 50).cast("string").alias("scenario_id"), F.col("o_orderpriority").alias("category"), F.year("o_orderdate").cast("string").alias("start"), F.lit("x").alias("end"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).alias("as_of"))
    return cov.only_period(per)


#: Categories whose sum over a month is a definition of its own, for evidence.
PLAIN = ("CAPEX", "LABOR", "UTILITIES", "TAXES", "OPEX", "INSURANCE_PREMIUMS", "INTEREST_EXPENSE", "LEASE_PAYMENTS")


def _monthly(spark: SparkSession, d: str) -> list[a.Definition]:
    """Plain sums of every month of the period, for every scenario."""
    months = [(y, m) for y in (1997, 1998) for m in range(1, 13)]
    period = lambda y, m: a.Period("CLOSED_INTERVAL", f"{y}-{m:02}-01", f"{y}-{m:02}-{calendar.monthrange(y, m)[1]}")
    limit = a.Quantity(t.MONEY, Decimal(60000), "USD")
    return [a.simple_definition(f"{s}:{k}:{y}-{m:02}", s, k, src.sets(k), t.LTE, limit, period=period(y, m)) for s in _ids(spark, d) for k in PLAIN for y, m in months]


def _adjusted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Inputs after all facts on transactions, and the inputs of those transactions before."""
    routed = _routed(spark, d)
    rows, fact_rows = taxonomy.classified(routed), written(_facts(spark, d), "facts")
    links = routed.select("txn_id", "scenario_id")
    after = written(_inputs_of(spark, d, routed, taxonomy.corrected(rows, fact_rows, links)), "after")
    touched = taxonomy.linked_facts(fact_rows, links).where("link_status = 'LINKED'").select("transaction_id").distinct()
    return after, written(_inputs_of(spark, d, routed, rows).join(touched, "transaction_id", "left_semi"), "before")


@query("r2_w9_evidence")
def r2(spark, d):
    """The one transaction whose absence turns a monthly sum's verdict."""
    return evidence.causal(_monthly(spark, d), written(_inputs(spark, d), "inputs"))


@query("r2_r4_treatment")
def r2_treatment(spark, d):
    """The same over adjusted inputs: the one adjustment whose undoing turns a verdict comes before absences."""
    after, before = _adjusted(spark, d)
    return evidence.causal(_monthly(spark, d), after, before)


@query("r2_families")
def r2_families(spark, d):
    """Evidence for all formula families over the whole period, with the smallest quarter among them."""
    after, before = _adjusted(spark, d)
    return evidence.causal(src.definitions(_ids(spark, d)), after, before)


@query("d24_contributing")
def d24(spark, d):
    """The transactions behind every definition's number."""
    return c.contributing(src.definitions(_ids(spark, d)), _inputs(spark, d))


@query("c16_submission")
def c16(spark, d):
    cells = src.scenarios(spark, d).crossJoin(F.broadcast(spark.createDataFrame([(str(k),) for k in range(21)], "clause_id string")))
    out = scoring.submission(cells, _results(spark, d))
    return out.select("scenario_id", "clause_id", "status", F.col("actual").cast("double").alias("actual"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cust = src.read(spark, d, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey")).alias("scenario_id"), F.col("c_custkey").cast("string").alias("clause_id"), F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("decimal(38,6)").alias("actual"))
    status = F.when(F.col("actual") > 0, "COMPLIANT").otherwise("BREACH")
    truth = cust.select("scenario_id", "clause_id", status.alias("status"), "actual", F.when(F.col("k") % 3 == 0, F.concat(F.lit("T"), F.col("k"))).alias("evidence_txn_id"))
    sent = cust.where("k % 13 <> 0").select("scenario_id", "clause_id", F.when(F.col("k") % 11 == 0, F.lit("BREACH")).otherwise(status).alias("status"), (F.col("actual") * (1 + (F.col("k") % 5) / F.lit(100.0)).cast("decimal(6,4)")).cast("decimal(38,6)").alias("actual"), F.when(F.col("k") % 6 == 0, F.concat(F.lit("T"), F.col("k"))).alias("evidence_txn_id"))
    return sent, truth


@query("m20_m21_score_cells")
def m20(spark, d):
    out = scoring.scored(*_cells(spark, d))
    return out.select("scenario_id", "clause_id", F.round("score", 9).alias("score"), F.col("status_ok").cast("string").alias("status_ok"), F.round("actual_part", 9).alias("actual_part"), F.round("evidence_part", 9).alias("evidence_part"))


@query("c17_f19_totals")
def c17(spark, d):
    out = scoring.totals(scoring.scored(*_cells(spark, d)))
    return out.select("cells", *[F.round(x, 6).alias(x) for x in ("score", "uniform", "weighted")])


@query("i2_i3_keys")
def i2(spark, d):
    return scoring.key_differences(*_cells(spark, d), ["scenario_id", "clause_id"])


@query("r7_reproduction")
def r7(spark, d):
    o = src.read(spark, d, "orders")
    return scoring.same_output(o, o.repartition(7)).select("rows_a", "rows_b", F.col("equal").cast("string").alias("equal"))


@query("e22_e23_m22_verdicts")
def e22(spark, d):
    o = src.read(spark, d, "orders").withColumn("v", F.col("o_totalprice").cast("decimal(18,4)") / 7)
    status = F.element_at(F.array(*map(F.lit, ("RESOLVED", "NOT_ACTIVATED", "UNRESOLVED"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    compliance = F.when(F.col("v") <= 20000, "COMPLIANT").otherwise("BREACH")
    verdict = scoring.verdict(status, compliance, F.col("v"))
    soft = scoring.softened(compliance, F.lit("LTE"), F.col("v"), F.lit(Decimal(20000)))
    return o.groupBy(verdict.alias("verdict"), soft.alias("soft")).agg(F.count("*").alias("n"), F.sum(scoring.published(F.col("v"))).cast("double").alias("total"))


@query("m15_m16_m17_fx")
def fx(spark, d):
    n = src.read(spark, d, "nation")
    rate = n.where("n_nationkey % 7 = 3").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("scenario_id"), F.lit("FX_RATE").alias("fact_kind"), (F.lit(Decimal("1.1")) + F.col("n_regionkey") * F.lit(Decimal("0.01"))).cast("decimal(38,6)").alias("amount"))
    got = taxonomy.convert(_inputs(spark, d), taxonomy.unique_rate(rate))
    return got.groupBy("scenario_id", "currency").agg(F.count("*").alias("n"), F.round(F.sum("amount").cast("double"), 4).alias("total"))


@query("k10_compiled_clauses")
def k10(spark, d):
    """Clauses compiled from text and evaluated."""
    doc = (
        "1. Definitions\nEBITDA means revenue less operating expenses.\n"
        "6.1 Interest cover\nThe interest cover ratio of EBITDA to interest expense shall be at least 1.5x from 1997-01-01 to 1998-12-31.\n"
        "6.2 Capital expenditure\nCapital expenditure shall not exceed USD 4,000,000 from 1997-01-01 to 1998-12-31.\n"
        "6.3 Capital intensity\nThe capital intensity ratio shall not exceed 0.6x from 1997-01-01 to 1998-12-31.\n"
    )
    found = [clauses.compile_clause(doc, s, k, src.FAMILIES).definition for s in _ids(spark, d) for k in ("6.1", "6.2", "6.3")]
    return _shown(c.evaluate([x for x in found if x], _inputs(spark, d)))


# Text: money, percentages, dates


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """A sentence per order, with money in several forms."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    forms = F.array(F.concat(F.lit("Paid $"), F.format_number(v, 2), F.lit(" on call.")), F.concat(F.lit("Sum EUR "), v.cast("string"), F.lit(" due")), F.concat(F.lit("Fee of USD "), v.cast("string"), F.lit("abc was void")), F.concat(F.lit("Rates of "), F.col("o_orderkey") % 40, F.lit(".5 % apply")))
    return src.read(spark, d, "orders").select("o_orderkey", F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("note"))


@query("m1_m4_money")
def m1(spark, d):
    first = money_in.first_money(F.col("note"))
    scan = money_in.money_scan(F.col("note"))
    return _notes(spark, d).select("o_orderkey", first["currency"].alias("currency"), first["value"].cast("double").alias("value"), scan["malformed"].cast("string").alias("malformed"), F.size(scan["values"]).alias("n"))


@query("m5_m6_m12_numbers")
def m5(spark, d):
    v = F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(v, 2)
    eu = F.translate(us, ",.", ".,")
    return _notes(spark, d).join(src.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").select(
        "o_orderkey", money_in.plain_number(us).cast("double").alias("us"), money_in.plain_number(eu).cast("double").alias("eu"), money_in.percent(F.col("note")).cast("double").alias("pct"), money_in.token_estimate(F.col("note")).alias("tokens")
    )


@query("p1_p3_p5_dates")
def p1(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    dotted = F.date_format("o_orderdate", "dd.MM.yyyy")
    label = F.element_at(F.array(F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate")), F.lit("third quarter"), F.concat(F.lit(" FY "), F.year("o_orderdate"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return src.read(spark, d, "orders").select("o_orderkey", periods.iso_date(F.concat(day, F.lit("T10:00"))).cast("string").alias("iso"), periods.any_date(dotted).cast("string").alias("dotted"), periods.iso_date(dotted).cast("string").alias("bad"), periods.period_label(label).alias("label"))


def _txn_notes(spark: SparkSession, d: str) -> DataFrame:
    """A sentence per order that names transactions, some twice, some with more after them."""
    k = F.col("o_orderkey")
    note = F.concat(F.lit("See TXN-N1-"), k, F.lit("-1, (TXN-N2-"), k, F.lit("-2) and TXN-N3-"), k, F.lit("; TXN-N1-"), k, F.lit("-1 is reversed, not TXN-N1-"), k, F.lit("-1-X."))
    return src.read(spark, d, "orders").select("o_orderkey", note.alias("raw_text"))


def _txn_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.transaction_spans(_txn_notes(spark, d), src.ledger(spark, d).select(F.trim("txn_id").alias("txn_id")), ["o_orderkey"])


@query("s19_txn_spans")
def s19(spark, d):
    """Where sentences name transactions of the ledger."""
    return _txn_spans(spark, d)


@query("s20_s21_txn_mentions")
def s20(spark, d):
    """Distinct transactions in the order of the text, and how often each is named."""
    return spans.mentions(_txn_spans(spark, d), ["o_orderkey"])


@query("s22_txn_near_pattern")
def s22(spark, d):
    return spans.followed_by(_txn_spans(spark, d), _txn_notes(spark, d), ["o_orderkey"], "^ is reversed")


def _account_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = src.read(spark, d, "customer").select(F.concat(F.lit("ACC-"), F.col("c_custkey")).alias("account"))
    note = F.concat(F.lit("from acc-"), F.col("o_custkey"), F.lit(" to ACC-"), F.col("o_custkey") + 7, F.lit("-8 by ACC-X, ACC-"), F.col("o_custkey") + 7)
    return src.read(spark, d, "orders").select("o_orderkey", note.alias("raw_text")), known


@query("s13_s16_s17_accounts")
def s13(spark, d):
    """Accounts that sentences name, with offsets: known ones, ones of the family's form and near misses."""
    notes, known = _account_notes(spark, d)
    return spans.account_spans(notes, known, ["o_orderkey"])


@query("s18_prefix_collisions")
def s18(spark, d):
    notes, known = _account_notes(spark, d)
    return spans.prefix_collisions(spans.account_spans(notes, known, ["o_orderkey"]).where("status <> 'MALFORMED'"))


# Documents


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: the lines of a text, ten to a page, some of them empty."""
    lines = src.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.groupBy("document_id", F.floor(F.col("n") / 10).cast("int").alias("page_number")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("raw_text"))


@query("n1_n2_page_states")
def n1(spark, d):
    pages = _pages(spark, d).withColumns({"image_count": (F.col("document_id") % 3).cast("int"), "image_visibility": F.when(F.col("document_id") % 5 == 0, "UNKNOWN").otherwise("KNOWN")})
    return docs.page_signals(pages).withColumn("state", docs.page_state()).select("document_id", "page_number", "char_count", F.round("alnum_ratio", 6).alias("alnum_ratio"), "state")


@query("f10_parse_metrics")
def f10(spark, d):
    m = docs.parse_metrics(_pages(spark, d))
    return m.select("document_id", "page_count", "empty_pages", "total_chars", F.round("alnum_ratio", 6).alias("alnum_ratio"), "control_chars", F.round("duplicate_line_ratio", 6).alias("duplicate_line_ratio"))


@query("n3_gate")
def n3(spark, d):
    return docs.quality_gate(docs.parse_metrics(_pages(spark, d)))


@query("n4_trust")
def n4(spark, d):
    return docs.trust_gate(n1(spark, d))


@query("h6_ocr_plan")
def h6(spark, d):
    return docs.ocr_plan(n1(spark, d), 25)


@query("n6_n7_n8_w4_authority")
def w4(spark, d):
    p = src.read(spark, d, "part")
    heads = F.array(*map(F.lit, ("LOAN AGREEMENT executed copy", "Auditor's report FINAL", "KYC dossier", "Treasury memo - working document", "Loan agreement DRAFT", "Press release", "SUPERSEDED loan agreement")))
    head = F.element_at(heads, (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("document_id"), F.concat(F.lit("N"), F.col("p_size")).alias("scenario_id"), docs.document_type(head).alias("doc_type"), docs.lifecycle(head).alias("lifecycle"), F.col("p_brand").alias("date_key"))
    return docs.winners(rows.withColumn("domain", docs.domain(F.col("doc_type"), F.col("lifecycle"))))


@query("n10_families")
def n10(spark, d):
    p = src.read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("document_id"), F.concat(F.lit("N"), F.col("p_size")).alias("scenario_id"), F.element_at(F.array(*map(F.lit, ("LOAN_AGREEMENT", "KYC_DOSSIER", "PRESS_RELEASE"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("doc_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("agreement_number"))
    return docs.families(rows)


@query("c12_document_scenarios")
def c12(spark, d):
    o = src.read(spark, d, "orders")
    return docs.resolve_documents(o.select(F.col("o_custkey").alias("document_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.concat(F.lit("N"), F.col("o_orderkey") % 25).alias("scenario_id")))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Two pages per part, the first with what a title page says."""
    k = F.col("p_partkey")
    title = F.element_at(F.array(*map(F.lit, ("Loan Agreement no. LA-", "Annual report RP-", "KYC dossier "))), (k % 3 + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("1997-01-01").cast("date"), (k % 700).cast("int")), "yyyy-MM-dd")
    stamp = F.when(k % 5 == 0, F.lit("\nSUPERSEDED copy")).when(k % 5 == 1, F.lit("\nIt is not superseded")).otherwise(F.lit(""))
    first = F.concat(F.lit("Part "), k, F.lit("\n"), title, k, F.lit("\nVersion 2."), k % 4, F.lit("\nEffective date: "), day, F.lit("\nPeriod ended 31 December 1997\n"), F.lit("x"))
    second = F.concat(F.lit("Body of the text."), stamp, F.when(k % 2 == 0, F.lit("\nThis is a DRAFT of it")).otherwise(F.lit("")))
    return src.read(spark, d, "part").select(k.alias("document_id"), F.posexplode(F.array(first, second)).alias("n", "raw_text")).select("document_id", (F.col("n") + 1).alias("page_number"), "raw_text")


@query("n9_metadata")
def n9(spark, d):
    return spans.metadata(_reports(spark, d))


@query("s28_n41_markers")
def s28(spark, d):
    """Where documents are marked as superseded: as a banner, and in words that no negation is near."""
    pages = _reports(spark, d)
    one = spans.first_marker(pages, spans.SUPERSEDED, "banner").withColumn("accept", F.lit("banner"))
    return one.unionByName(spans.first_marker(pages, spans.SUPERSEDED, "not negated").withColumn("accept", F.lit("not negated")))


@query("n12_n40_borrowers")
def n12(spark, d):
    """Borrowers that pages declare, by the account nearest to them, and the scenarios that own those accounts."""
    c_ = src.read(spark, d, "customer")
    text = F.concat(F.lit("Borrower: "), F.lit("Client "), F.col("c_custkey") % 900, F.lit(" LLP, account ACC-"), F.col("c_custkey") % 700, F.lit(", formerly ACC-"), F.col("c_custkey") + 1)
    pages = c_.select(F.col("c_custkey").alias("document_id"), F.lit(1).alias("page_number"), text.alias("raw_text"))
    known = c_.select(F.concat(F.lit("ACC-"), F.col("c_custkey") % 1000).alias("account"))
    told = spans.borrower_declarations(pages, spans.account_spans(pages, known, ["document_id", "page_number"]), r"Borrower: (?P<name>[\w ]+? LLP)")
    owners = c_.select(F.concat(F.lit("ACC-"), F.col("c_custkey")).alias("account"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("scenario_id"))
    return spans.anchored_borrowers(told, owners).withColumn("identities", F.array_join("identities", ","))


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A table per order: a header and a row per line, whose third column is empty for every third part."""
    l = src.read(spark, d, "lineitem")
    lines = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))
    cells = lines.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("row_index"), F.posexplode(F.array(F.col("l_linenumber").cast("string"), F.col("flag"), F.when(F.col("part") % 3 > 0, F.col("part").cast("string")))).alias("column_index", "raw_text"))
    heads = l.select(F.col("l_orderkey").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_index"), F.posexplode(F.array(F.lit("line"), F.lit("flag"), F.lit("part"))).alias("column_index", "raw_text"))
    cells = cells.where("raw_text is not null").unionByName(heads)
    tables = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.lit(3).alias("column_count"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" Order "), F.col("o_orderkey"))).alias("caption"))
    return cells, tables


@query("n17_tables")
def n17(spark, d):
    return grids.table_texts(*_grid(spark, d))


@query("n18_rows")
def n18(spark, d):
    return grids.row_texts(*_grid(spark, d))


@query("n14_chunks")
def n14(spark, d):
    return docs.chunks(src.read(spark, d, "documents"), id_col="doc_id").select("document_id", "ordinal", "char_start", "char_end", "tokens")


@query("f12_chunk_manifest")
def f12(spark, d):
    return docs.chunk_manifest(docs.chunks(src.read(spark, d, "documents"), id_col="doc_id"))


@query("c20_evidence_overlap")
def c20(spark, d):
    docs_ = src.read(spark, d, "documents")
    cut = docs_.select(F.col("doc_id").alias("document_id"), F.posexplode(F.sequence(F.lit(0), F.col("n_chars"), F.lit(1000))).alias("ordinal", "char_start")).withColumn("char_end", F.col("char_start") + 1000)
    spans = docs_.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("s"), F.col("doc_id")).alias("span_id"), (F.col("n_chars") / 3).cast("long").alias("char_start"), (F.col("n_chars") / 3 + 700).cast("long").alias("char_end"))
    return docs.evidence_overlap(cut, spans)


@query("n26_n38_facts")
def n26(spark, d):
    """Facts extracted from generated report pages, validated against them."""
    v = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    token = F.concat(F.lit("TXN-N"), F.col("o_custkey") % 25, F.lit("-"), F.col("o_orderkey"), F.lit("-1"))
    body = F.array(
        F.concat(token, F.lit(" was recorded as OPEX, reclassified to Capex.")), F.concat(F.lit("A person who owns 25% or more is one of the related parties.")), F.concat(token, F.lit(" is corrected to $"), v, F.lit(".")),
        F.concat(F.lit("Severance liability of $"), v, F.lit(" stands as of 1997-12-31.")), F.concat(token, F.lit(" is excluded from the period.")), F.concat(F.lit("Aktau Trade LLP is an unrestricted subsidiary. Borat Steel JSC 41.5 %")),
    )
    pages = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.concat(F.lit("N"), F.col("o_custkey") % 25).alias("scenario_id"), F.element_at(body, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("raw_text"))
    got = facts.validated(facts.extract(pages), pages)
    return got.select("document_id", "fact_kind", "transaction_id", "entity_name", F.col("amount").cast("double").alias("amount"), F.col("percent").cast("double").alias("percent"), "disposition", "status", "reason")


# Retrieval


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set: every benchmark row whose id is divisible by 50, with its whole text."""
    return src.read(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


@query("h2_bm25_or")
def h2(spark, d):
    return retrieval.bm25(src.read(spark, d, "documents"), _queries(spark, d), 10, "OR", "doc_id").select("query_id", "id", F.round("score", 6).alias("score"))


@query("h3_bm25_and")
def h3(spark, d):
    return retrieval.bm25(src.read(spark, d, "documents"), _queries(spark, d), 10, "AND", "doc_id").select("query_id", "id", F.round("score", 6).alias("score"))


@query("h1_h4_h5_cosine")
def h1(spark, d):
    e = src.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return retrieval.nearest(e, q, 5, digits=6)


@query("w1_w2_rrf")
def w1(spark, d):
    e = src.read(spark, d, "events")
    one = e.withColumn("position", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id"))).select(F.col("event_type").alias("query_id"), F.lit("value").alias("list"), "position", F.col("user_id").alias("id"))
    two = e.withColumn("position", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))).select(F.col("event_type").alias("query_id"), F.lit("time").alias("list"), "position", F.col("user_id").alias("id"))
    out = retrieval.fuse(one.unionByName(two))
    return out.select("query_id", "id", F.round("score", 9).alias("score"))


@query("r12_hybrid")
def r12(spark, d):
    e = src.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = _queries(spark, d).join(e.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id")
    return retrieval.hybrid(src.read(spark, d, "documents"), e, q, id_col="doc_id").select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("m18_m19_ir_metrics")
def m18(spark, d):
    e = src.read(spark, d, "events")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "rank")
    relevant = e.where("event_id % 5 = 0").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("event_id") % 4).cast("double").alias("grade"))
    out = retrieval.metrics(ranked, relevant, 10)
    return out.select("query_id", *[F.round(x, 9).alias(x) for x in ("recall", "mrr", "hit", "ndcg")])


@query("b9_filters")
def b9(spark, d):
    c_ = src.read(spark, d, "documents").withColumn("page_numbers", F.array((F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 11).cast("int")))
    return retrieval.filtered(c_, pages=[3, 10], lang=["en", "de"], source=["src0", "src1", "src2"]).select("doc_id", "lang", "source")


@query("r11_vectors")
def r11(spark, d):
    e = src.read(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 10 == 0, F.array_append(F.slice("embedding", 1, 63), F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return e.groupBy(retrieval.valid_vector(v, 64).alias("state")).agg(F.count("*").alias("n"))


# Profiles and streams


@query("f11_profile")
def f11(spark, d):
    return profile.profile(src.read(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_totalprice"))


@query("f11_profile_ledger")
def f11_ledger(spark, d):
    return profile.profile(src.ledger(spark, d))


@query("stream_sums")
def stream_sums(spark, d):
    """What the streaming job gives for all events."""
    got = stream.sums(src.read(spark, d, "events"))
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))
