"""The algebra, its fold and the clause compiler, without Spark."""

from decimal import Decimal

import pytest

from ledgerlens import types as t
from ledgerlens.plans import algebra as a
from ledgerlens.plans import clauses
from ledgerlens.plans import compile as c
from ledgerlens.sources.tables import FAMILIES, sets

D = Decimal
usd = lambda v: a.Quantity(t.MONEY, D(v), "USD")
ratio = lambda v: a.Quantity(t.RATIO, D(v))


def cell(total, n=1, low="USD", high=None, untold=False, foreign=False):
    return {"total": total, "n": n, "low": low, "high": high or low, "untold": untold, "foreign": foreign}


def run(metric, comparator, threshold, cells, **more):
    d = a.Definition("d", "S1", "6.1", metric, comparator, threshold, **more)
    r = c.Fold(d, {(k, ""): v for k, v in cells.items()}).result()
    return dict(zip([x.split()[0] for x in c.RESULT.split(", ")], r, strict=True))


def test_sum_reaches_its_threshold():
    r = run(sets("REVENUE"), t.GTE, usd("125.50"), {0: cell("125.50", 2)})
    assert (r["status"], r["compliance"], r["value"], r["currency"], r["input_count"]) == ("RESOLVED", "COMPLIANT", "125.50", "USD", 2)


def test_empty_sum_is_a_zero_that_takes_the_threshold_currency():
    r = run(sets("REVENUE"), t.GTE, usd(1), {})
    assert (r["status"], r["compliance"], r["value"], r["currency"]) == ("RESOLVED", "BREACH", "0", "USD")


@pytest.mark.parametrize(
    ("cells", "status", "issue"),
    [
        ({0: cell("200", 2, "EUR", "USD")}, "UNRESOLVED", c.MIXED),
        ({0: cell("100", 1, untold=True)}, "UNRESOLVED", "PERIOD_MEMBERSHIP_UNDECIDABLE"),
        ({0: cell("100", 1, "EUR")}, "UNRESOLVED", c.MIXED),
    ],
)
def test_what_cannot_be_told_is_unresolved(cells, status, issue):
    r = run(sets("REVENUE"), t.GTE, usd(100), cells)
    assert (r["status"], r["compliance"], r["issues"]) == (status, None, [issue])


def test_denominators():
    m = a.Divide(sets("REVENUE"), sets("OPEX"))
    r = run(m, t.GTE, ratio(1), {0: cell("1"), 1: cell("0")})
    assert (r["status"], r["issues"]) == ("ERROR", ["ZERO_DENOMINATOR"])
    r = run(m, t.GTE, ratio(-1), {0: cell("1"), 1: cell("-2")})
    assert (r["status"], r["value"], r["compliance"], r["issues"]) == ("RESOLVED", "-0.5", "COMPLIANT", ["NEGATIVE_DENOMINATOR"])
    r = run(m, t.GTE, ratio(0), {0: cell("1"), 1: cell("3")})
    assert len(r["value"]) >= 52


def test_percentages_compare_as_ratios():
    m = a.Divide(sets("REVENUE"), sets("OPEX"))
    assert run(m, t.GTE, a.Quantity(t.PERCENT, D(50)), {0: cell("1"), 1: cell("2")})["compliance"] == "COMPLIANT"


def test_springing_covenant_that_is_not_active():
    active = a.Compare(sets("FINANCING_INFLOWS"), t.GT, a.Constant(usd(100)))
    r = run(a.Divide(sets("REVENUE"), sets("OPEX")), t.LTE, ratio(1), {0: cell("50"), 1: cell("100"), 2: cell("50")}, activation=active)
    assert (r["status"], r["activation"], r["value"], r["compliance"]) == ("NOT_ACTIVATED", "INACTIVE", "2", "COMPLIANT")


def test_connectives_stop_at_the_first_arm_that_decides():
    true, false = a.Always(), a.Not(a.Always())
    unknown = a.Compare(sets("REVENUE"), t.GT, a.Constant(usd(1)))
    fold = c.Fold(a.Definition("d", "S", "1", sets("REVENUE"), t.GT, usd(1)), {(0, ""): cell("1", untold=True)})
    truth = lambda x: fold.predicate(x)[0]
    assert truth(a.And((false, unknown))) is False and truth(a.And((unknown, false))) is None
    assert truth(a.Or((true, unknown))) is True and truth(a.Or((unknown, true))) is None


def test_period_parts():
    m = a.PeriodAggregate(sets("REVENUE"), "FINANCIAL_QUARTER", "MIN")
    d = a.Definition("d", "S", "1", m, t.GTE, usd(10))
    cells = {(0, "1997-Q1"): cell("30"), (0, "1997-Q2"): cell("7")}
    assert c.Fold(d, cells).result()[4:8] == ("BREACH", "ALWAYS", "MONEY", "7")
    assert a.blockers(d) == ["PERIOD_INPUTS_REQUIRED"]
    assert a.blockers(a.Definition("d", "S", "1", a.Divide(sets("REVENUE"), sets("REVENUE")), t.GTE, ratio(1))) == ["DUPLICATE_DEPENDENCY"]


@pytest.mark.parametrize("bad", [a.Add(sets("OPEX"), a.Constant(ratio(1))), a.Divide(a.Constant(ratio(1)), sets("OPEX")), a.Multiply(sets("OPEX"), sets("OPEX")), a.Sum(a.Constant(ratio(1))), a.Max((sets("OPEX"), a.Constant(ratio(1))))])
def test_types_that_do_not_combine(bad):
    with pytest.raises(a.TypeMismatch):
        a.quantity_type(bad)


def test_there_is_no_ne():
    assert t.NEGATED["EQ"] == "EQ" and t.NEGATED["LT"] == "GTE"


def test_rendering_and_requirements():
    m, cmp_, q, act = FAMILIES["SPRINGING_DRAWDOWN_LEVERAGE"]
    d = a.simple_definition("d", "S1", "6.1", m, cmp_, q, activation=act)
    assert a.render_definition(d) == "S1/6.1: (sum(FINANCING_INFLOWS) / (sum(REVENUE) - sum(OPEX))) <= 3 when sum(FINANCING_INFLOWS) > 1000000 USD"
    assert [x["category"] for x in a.required_facts(d)] == ["FINANCING_INFLOWS", "REVENUE", "OPEX"]
    assert a.primary_comparison(m, a.breach_of(d)) == (t.LTE, q)


DOC = """1. Definitions
EBITDA is revenue less operating expenses.
6.1 Interest cover
The interest cover ratio of EBITDA to interest expense shall be at least 1.5x from 2025-01-01 to 2025-12-31.
6.2 Capex
Capital expenditure shall not exceed USD 4,000,000 in Q2.
6.3 Springing leverage
The springing leverage of financing inflows to EBITDA shall not exceed 3.0x only if financing inflows exceed $5,000,000.
6.4 Other
Nothing that can be measured shall exceed anything.
"""


def test_clauses_compile():
    one = clauses.compile_clause(DOC, "S1", "6.1", FAMILIES).definition
    assert (one.family_id, one.comparator, one.threshold, one.period.start) == ("INTEREST_COVER_RATIO", t.GTE, ratio("1.5"), "2025-01-01")
    two = clauses.compile_clause(DOC, "S1", "6.2", FAMILIES).definition
    assert (two.family_id, two.threshold, two.period.kind, two.period.quarter) == ("MAX_CAPEX", usd(4000000), "FINANCIAL_QUARTER", 2)
    three = clauses.compile_clause(DOC, "S1", "6.3", FAMILIES).definition
    assert (three.family_id, three.threshold, three.activation.right) == ("SPRINGING_DRAWDOWN_LEVERAGE", ratio("3.0"), a.Constant(usd(5000000)))
    assert clauses.compile_clause(DOC, "S1", "6.4", FAMILIES).status == "UNSUPPORTED_FORMULA"
    assert clauses.compile_clause(DOC, "S1", "9.9", FAMILIES).status == "CLAUSE_NOT_FOUND"
