"""The bound below which no transaction can turn a verdict."""

import datetime
import random
from dataclasses import replace
from decimal import Decimal

from ledgerlens import types as t
from ledgerlens.operators import evidence
from ledgerlens.plans import algebra as a
from ledgerlens.plans import compile as c
from ledgerlens.sources import tables as src

from .test_evidence import frame, row


def cell(slot, part, total):
    return {"slot": slot, "part": part, "total": str(total), "n": 3, "low": "USD", "high": "USD", "untold": False, "foreign": False}


def drawn(d, rng):
    out = {}
    for (_, grouping, _), k in c.slots_of(d).items():
        for part in [""] if grouping == "FULL_PERIOD" else [f"1997-Q{q}" for q in rng.sample(range(1, 5), 3)]:
            out[k, part] = cell(k, part, Decimal(rng.randrange(-20000, 2000000)) / 100)
    return out


def test_no_change_within_the_bound_turns_a_verdict(spark):
    rng, settled = random.Random(5), 0
    more = [a.simple_definition(f"S:{g}{r}", "S", "1", a.PeriodAggregate(src.sets("REVENUE"), g, r), t.GTE, a.Quantity(t.MONEY, Decimal(9000), "USD"), period=src.PERIOD) for g in ("FINANCIAL_QUARTER",) for r in ("MIN", "MAX", "SUM")]
    for d in [*src.definitions(["S"]), *more] * 12:
        d = replace(d, threshold=replace(d.threshold, value=d.threshold.value * rng.randrange(1, 40) / 20))
        cells = drawn(d, rng)
        was = c.Fold(d, cells).result()[4]
        for added in (False, True):
            most = evidence.Bound(d, cells, added).most()
            if was is None or not 0 < most < 1e12:
                continue
            settled += 1
            by = Decimal(most) * Decimal("0.999999")
            for _ in range(30):
                now = {k: {**x, "total": str(Decimal(x["total"]) + by * rng.choice((-1, 0, 1)))} for k, x in cells.items() if abs(Decimal(x["total"])) > by or rng.random() < 0.5}
                if added:
                    now |= {(k, "1999-Q1"): cell(k, "1999-Q1", by * rng.choice((-1, 1))) for (_, g, _), k in c.slots_of(d).items() if g == "FINANCIAL_QUARTER"}
                assert c.Fold(d, now).result()[4] in (None, was)
    assert settled > 100


def test_transactions_that_cannot_turn_a_verdict_are_no_candidates(spark, monkeypatch):
    seen, flips = [], evidence._flips
    monkeypatch.setattr(evidence, "_flips", lambda d, cells, changes: (seen.append(changes), flips(d, cells, changes))[1])
    day = datetime.date(1997, 5, 1)
    d = [a.simple_definition("S:x", "S", "x", src.sets("REVENUE"), t.GTE, a.Quantity(t.MONEY, Decimal(2500), "USD"), period=src.PERIOD)]
    rows = [row("S", i, f"T{i}", "REVENUE", 10, day) for i in range(200)] + [row("S", "big", "T-big", "REVENUE", 1500, day)]
    before = [row("S", i, f"T{i}", "REVENUE", 9, day) for i in range(200)]
    got = evidence.causal(d, frame(spark, rows), frame(spark, before)).collect()
    assert [(r["txn_id"], r["kind"]) for r in got] == [("T-big", "ABSENCE")]
    assert [sorted({r["txn_id"] for r in x.collect()}) for x in seen] == [["T-big"], []]


def test_rows_of_one_transaction_are_bounded_together(spark):
    day = datetime.date(1997, 5, 1)
    d = [a.simple_definition("S:x", "S", "x", src.sets("REVENUE"), t.GTE, a.Quantity(t.MONEY, Decimal(100), "USD"), period=src.PERIOD)]
    rows = [row("S", i, "T-many", "REVENUE", 10, day) for i in range(10)] + [row("S", f"o{i}", f"T{i}", "REVENUE", 10, day) for i in range(5)]
    assert [r["txn_id"] for r in evidence.causal(d, frame(spark, rows)).collect()] == ["T-many"]


def test_a_definition_without_a_verdict_has_no_candidates(spark):
    day, d = datetime.date(1997, 5, 1), src.definitions(["S"], ["INTEREST_COVER_RATIO"])
    cells = evidence._cells(d, frame(spark, [row("S", i, f"T{i}", "REVENUE", 10, day) for i in range(5)]))  # nothing to divide by
    assert [r["most"] for r in evidence._bounds(d, cells, set(), frame(spark, []))[0].collect()] == [float("inf")]
