"""Evidence and contributing transactions against evaluating everything again."""

import datetime
import random
from dataclasses import replace
from decimal import Decimal

from ledgerlens import types as t
from ledgerlens.operators import evidence
from ledgerlens.plans import algebra as a
from ledgerlens.plans import compile as c
from ledgerlens.sources import tables as src

KINDS = ("REVENUE", "OPEX", "CAPEX", "INTEREST_EXPENSE", "LABOR", "TAXES", "UTILITIES", "RENT", "LEASE_PAYMENTS", "INSURANCE_PREMIUMS", "FINANCING_INFLOWS")


def row(scenario, k, txn, category, amount, day, related="FALSE", members=None):
    return (f"{scenario}:{k}", scenario, "LEDGER", txn, category, members or [category], Decimal(amount), Decimal(amount), "USD", "FLOW", day, None, None, None, False, related, "BORROWER", "UNKNOWN", [])


def frame(spark, rows):
    return spark.createDataFrame(rows, t.CALC_INPUTS)


def transactions(seed, n=34):
    rng = random.Random(seed)
    day = lambda: datetime.date(1997, 1, 1) + datetime.timedelta(rng.randrange(720))
    return [(f"T{i}", KINDS[i % len(KINDS)], rng.randrange(1000, 200000), day(), rng.choice(["TRUE", "FALSE"])) for i in range(n)]


def put(scenario, txns):
    return [row(scenario, x[0], *x) for x in txns]


def verdicts(spark, definitions, rows):
    return {(r["scenario_id"], r["definition_id"].split(":", 1)[1]): (r["compliance"], r["value"]) for r in c.evaluate(definitions, frame(spark, rows)).collect()}


def near(spark, txns):
    """The families' definitions with thresholds so near their values that single transactions may turn them."""
    base = src.definitions(["S"])
    told = verdicts(spark, base, put("S", txns))
    out = []
    for k, d in enumerate(base):
        value = told["S", d.definition_id.split(":", 1)[1]][1]
        if value is not None:
            out.append(replace(d, threshold=a.Quantity(a.quantity_type(d.metric), (Decimal(value) * Decimal([1.02, 0.97, 1.15, 0.8, 0.88, 1.3, 0.93][k % 7])).quantize(Decimal("0.000001")), d.threshold.currency)))
    return out


def copies(definitions, scenario):
    return [replace(d, definition_id=f"{scenario}:{d.definition_id.split(':', 1)[1]}", scenario_id=scenario) for d in definitions]


def turned(spark, definitions, txns, variants):
    """family -> names of the variants (name -> transactions) that turn its verdict."""
    names = ["S", *variants]
    told = verdicts(spark, [d for s in names for d in copies(definitions, s)], [r for s in names for r in put(s, variants.get(s, txns))])
    out = {}
    for d in definitions:
        f = d.definition_id.split(":", 1)[1]
        was = told["S", f][0]
        out[f] = {s for s in variants if was is not None and told[s, f][0] not in (None, was)}
    return out


def test_evidence_is_what_evaluating_again_says(spark):
    for seed in (1, 2):
        after = transactions(seed)
        before = [(x[0], "OPEX" if i % 3 else x[1], x[2] // (1 + i % 4), *x[3:]) for i, x in enumerate(after) if i % 2]
        was = {x[0]: x for x in before}
        definitions = near(spark, after)
        absent = turned(spark, definitions, after, {f"-{x[0]}": [y for y in after if y is not x] for x in after})
        undone = turned(spark, definitions, after, {f"u{k}": [was[k] if y[0] == k else y for y in after] for k in was})
        only = lambda s: next(iter(s))[1:] if len(s) == 1 else None
        want = {f: (only(undone[f]), "TREATMENT") if only(undone[f]) else (only(absent[f]), "ABSENCE") for f in absent if only(undone[f]) or only(absent[f])}
        got = {r["definition_id"].split(":", 1)[1]: (r["txn_id"], r["kind"]) for r in evidence.causal(definitions, frame(spark, put("S", after)), frame(spark, put("S", before))).collect()}
        assert got == want and any(k == "TREATMENT" for _, k in want.values())
        alone = {r["definition_id"].split(":", 1)[1]: r["txn_id"] for r in evidence.causal(definitions, frame(spark, put("S", after))).collect()}
        assert alone == {f: only(s) for f, s in absent.items() if only(s)} and alone


def test_known_evidence(spark):
    day = datetime.date(1997, 5, 1)
    usd = lambda v: a.Quantity(t.MONEY, Decimal(v), "USD")
    d = [a.simple_definition("S:x", "S", "x", src.sets("REVENUE"), t.GTE, usd(100), period=src.PERIOD)]
    one = lambda *v: frame(spark, [row("S", i, f"TX-{i}", "REVENUE", x, day) for i, x in enumerate(v)])
    assert [(r["txn_id"], r["kind"]) for r in evidence.causal(d, one(120)).collect()] == [("TX-0", "ABSENCE")]
    assert evidence.causal(d, one(60, 60)).collect() == []
    ratio = [a.simple_definition("S:r", "S", "r", a.Divide(src.sets("REVENUE"), src.sets("OPEX")), t.GTE, a.Quantity(t.RATIO, Decimal(1)), period=src.PERIOD)]
    rows = frame(spark, [row("S", 1, "TX-ratio", "REVENUE", 120, day), row("S", 2, "TX-cost", "OPEX", 100, day)])
    before = frame(spark, [row("S", 1, "TX-ratio", "REVENUE", 80, day)])
    assert [(r["txn_id"], r["kind"]) for r in evidence.causal(ratio, rows, before).collect()] == [("TX-ratio", "TREATMENT")]


def test_contributing_transactions(spark):
    txns = transactions(3)
    definitions = src.definitions(["S"])
    rows = [*put("S", txns), row("S", "late", "T-late", "REVENUE", 5, datetime.date(2001, 1, 1)), row("S", "none", None, "REVENUE", 5, datetime.date(1997, 1, 1))]
    got = {}
    for r in c.contributing(definitions, frame(spark, rows)).collect():
        got.setdefault(r["definition_id"].split(":", 1)[1], set()).add(r["transaction_id"])
    of = lambda *kinds: {x[0] for x in txns if x[1] in kinds}
    related = {x[0] for x in txns if x[4] == "TRUE" and x[1] in t.RELATED_PARTY_MEMBERS}
    assert got["MIN_REVENUE"] == of("REVENUE") and got["INTEREST_COVER_RATIO"] == of("REVENUE", "OPEX", "INTEREST_EXPENSE")
    assert got["MAX_RP_AS_RATIO_OF_OPEX"] == related | of("OPEX") and got["MAX_SINGLE_OVERHEAD_LINE"] == of("LABOR", "UTILITIES")
    floor = replace(definitions[0], definition_id="S:floor", metric=src.sets("REVENUE"), floor=a.Floor("REVENUE", Decimal(100000), "USD"))
    assert {r["transaction_id"] for r in c.contributing([floor], frame(spark, rows)).collect()} == {x[0] for x in txns if x[1] == "REVENUE" and x[2] >= 100000}
