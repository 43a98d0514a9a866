"""The metric algebra: immutable expressions over selected inputs, their types and renderings.

Numeric nodes: constant, set, sum, count, min, max, add, subtract, multiply, divide, period aggregate.
Predicates: compare, and, or, not, always. A plan has an actual value, an activation and a
breach predicate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from decimal import Decimal

from .. import types as t


class TypeMismatch(ValueError):
    """The parts of an expression have quantity types that don't combine."""


@dataclass(frozen=True)
class Quantity:
    qtype: str
    value: Decimal
    currency: str | None = None

    def as_ratio(self) -> Quantity:
        """A percentage as a ratio; a ratio stays."""
        if self.qtype == t.RATIO:
            return self
        if self.qtype != t.PERCENT:
            raise TypeMismatch(f"{self.qtype} is not like a ratio")
        return Quantity(t.RATIO, self.value / 100)


@dataclass(frozen=True)
class Selector:
    category: str
    include_flags: tuple[str, ...] = ()
    exclude_flags: tuple[str, ...] = ()
    related_party_only: bool = False
    group_level: bool = False
    scope: str | None = None

    def __post_init__(self):
        if self.category not in t.CATEGORIES:
            raise ValueError(f"unknown category {self.category}")
        scope = self.scope or ("GROUP" if self.group_level else "BORROWER")
        if self.group_level and scope == "BORROWER":
            raise ValueError("a group-level selector needs another scope than BORROWER")
        object.__setattr__(self, "scope", scope)


class Expr:
    kind = ""


@dataclass(frozen=True)
class Constant(Expr):
    quantity: Quantity
    kind = "constant"


@dataclass(frozen=True)
class TransactionSet(Expr):
    selector: Selector
    kind = "transaction_set"


@dataclass(frozen=True)
class Sum(Expr):
    of: Expr
    kind = "sum"


@dataclass(frozen=True)
class Count(Expr):
    of: Expr
    kind = "count"


@dataclass(frozen=True)
class Min(Expr):
    args: tuple[Expr, ...]
    kind = "min"


@dataclass(frozen=True)
class Max(Expr):
    args: tuple[Expr, ...]
    kind = "max"


@dataclass(frozen=True)
class Add(Expr):
    left: Expr
    right: Expr
    kind = "add"


@dataclass(frozen=True)
class Subtract(Expr):
    left: Expr
    right: Expr
    kind = "subtract"


@dataclass(frozen=True)
class Multiply(Expr):
    left: Expr
    right: Expr
    kind = "multiply"


@dataclass(frozen=True)
class Divide(Expr):
    numerator: Expr
    denominator: Expr
    kind = "divide"


@dataclass(frozen=True)
class PeriodAggregate(Expr):
    """Evaluate `of` in each part of the period, then reduce: MAX over quarters reports the worst quarter of a ceiling."""

    of: Expr
    grouping: str = "FINANCIAL_QUARTER"  # or MONTH, YEAR, FULL_PERIOD
    reducer: str = "MAX"  # or MIN, SUM
    basis: str = "CASH_DATE"  # or ACCOUNTING
    kind = "period_aggregate"


@dataclass(frozen=True)
class Compare(Expr):
    left: Expr
    comparator: str
    right: Expr
    kind = "compare"


@dataclass(frozen=True)
class And(Expr):
    args: tuple[Expr, ...]
    kind = "and"


@dataclass(frozen=True)
class Or(Expr):
    args: tuple[Expr, ...]
    kind = "or"


@dataclass(frozen=True)
class Not(Expr):
    of: Expr
    kind = "not"


@dataclass(frozen=True)
class Always(Expr):
    kind = "always"


@dataclass(frozen=True)
class Period:
    kind: str = "CLOSED_INTERVAL"  # FINANCIAL_QUARTER, AS_OF, MIXED
    start: str | None = None
    end: str | None = None
    as_of: str | None = None
    start_inclusive: bool = True
    end_inclusive: bool = True
    quarter: int | None = None
    flow_start: str | None = None
    flow_end: str | None = None


@dataclass(frozen=True)
class Floor:
    """Of one category only amounts of at least value count."""

    category: str
    value: Decimal
    currency: str


@dataclass(frozen=True)
class Definition:
    definition_id: str
    scenario_id: str
    clause_id: str
    metric: Expr
    comparator: str
    threshold: Quantity
    period: Period = field(default_factory=Period)
    activation: Expr = field(default_factory=Always)
    breach: Expr | None = None  # None: the comparison of metric and threshold fails
    floor: Floor | None = None
    family_id: str = ""


def children(node: Expr) -> list[Expr]:
    out: list[Expr] = []
    for f in fields(node):
        value = getattr(node, f.name)
        out += [x for x in (value if isinstance(value, tuple) else (value,)) if isinstance(x, Expr)]
    return out


def walk(node: Expr) -> Iterator[Expr]:
    """node and all below it, depth first."""
    yield node
    for child in children(node):
        yield from walk(child)


def selectors(*nodes: Expr | None) -> list[Selector]:
    """The distinct selectors of the expressions, in order of appearance."""
    return list(dict.fromkeys(x.selector for n in nodes if n is not None for x in walk(n) if isinstance(x, TransactionSet)))


def quantity_type(node: Expr) -> str:
    """The quantity type of a numeric expression; raises TypeMismatch."""
    match node:
        case Constant():
            return node.quantity.qtype
        case TransactionSet():
            return t.MONEY
        case Sum():
            if quantity_type(node.of) != t.MONEY:
                raise TypeMismatch("sum needs money")
            return t.MONEY
        case Count():
            if not isinstance(node.of, TransactionSet):
                raise TypeMismatch("count needs a set")
            return t.COUNT
        case Min() | Max():
            kinds = {quantity_type(a) for a in node.args}
            if len(node.args) < 2 or len(kinds) != 1:
                raise TypeMismatch("min and max need two or more arguments of one type")
            return kinds.pop()
        case Add() | Subtract():
            kinds = {quantity_type(node.left), quantity_type(node.right)}
            if len(kinds) != 1 or kinds == {t.PERCENT}:
                raise TypeMismatch(f"{node.kind} of {sorted(kinds)}")
            return kinds.pop()
        case Multiply():
            pair = {quantity_type(node.left), quantity_type(node.right)}
            if pair == {t.RATIO}:
                return t.RATIO
            if pair == {t.RATIO, t.MONEY}:
                return t.MONEY
            raise TypeMismatch(f"multiply of {sorted(pair)}")
        case Divide():
            pair = (quantity_type(node.numerator), quantity_type(node.denominator))
            if pair not in ((t.MONEY, t.MONEY), (t.RATIO, t.RATIO)):
                raise TypeMismatch(f"divide of {pair}")
            return t.RATIO
        case PeriodAggregate():
            return quantity_type(node.of)
    raise TypeMismatch(f"{node.kind} is not a number")


def check_predicate(node: Expr) -> None:
    """Raises TypeMismatch unless node is a predicate whose comparisons have comparable sides."""
    match node:
        case Compare():
            left, right = quantity_type(node.left), quantity_type(node.right)
            if left != right and {left, right} != {t.RATIO, t.PERCENT}:
                raise TypeMismatch(f"compare of {left} and {right}")
        case And() | Or():
            for a in node.args:
                check_predicate(a)
        case Not():
            check_predicate(node.of)
        case Always():
            pass
        case _:
            raise TypeMismatch(f"{node.kind} is not a predicate")


def breach_of(d: Definition) -> Expr:
    return d.breach if d.breach is not None else Compare(d.metric, t.NEGATED[d.comparator], Constant(d.threshold))


def primary_comparison(metric: Expr, breach: Expr) -> tuple[str, Quantity] | None:
    """(compliance comparator, threshold) if breach is just the metric against a constant, else None."""
    if isinstance(breach, Compare) and breach.left == metric and isinstance(breach.right, Constant):
        return t.NEGATED[breach.comparator], breach.right.quantity
    return None


def simple_definition(definition_id: str, scenario_id: str, clause_id: str, metric: Expr, comparator: str, threshold: Quantity, **more) -> Definition:
    quantity_type(metric)
    check_predicate(more.get("activation", Always()))
    return Definition(definition_id, scenario_id, clause_id, metric, comparator, threshold, **more)


#: Categories that documents supply, not the ledger.
DOCUMENT_SOURCED = ("GUARANTEE_LIABILITY", "INDEMNITY_LIABILITY", "SCHEDULED_PRINCIPAL_REPAYMENT")


def required_facts(d: Definition) -> list[dict]:
    """What a definition needs: one entry per selector, with scope, basis, grouping and source."""
    groupings = [x for x in walk(d.metric) if isinstance(x, PeriodAggregate)]
    grouping, basis = (groupings[0].grouping, groupings[0].basis) if groupings else ("FULL_PERIOD", "CASH_DATE")
    return [
        {"category": s.category, "scope": s.scope, "grouping": grouping, "basis": basis, "source": "DOCUMENT" if s.category in DOCUMENT_SOURCED else "LEDGER"}
        for s in selectors(d.metric, d.activation, d.breach)
    ]


_SIGN = {"add": "+", "subtract": "-", "multiply": "*"}
_COMPARE = {t.LT: "<", t.LTE: "<=", t.GT: ">", t.GTE: ">=", t.EQ: "="}


def render(node: Expr) -> str:
    """A canonical text of an expression."""
    match node:
        case Constant():
            q = node.quantity
            return f"{format(q.value, 'f')}{' ' + q.currency if q.currency else '%' if q.qtype == t.PERCENT else ''}"
        case TransactionSet():
            s = node.selector
            marks = [*(f"+{x}" for x in s.include_flags), *(f"-{x}" for x in s.exclude_flags), *(["related"] if s.related_party_only else []), *([s.scope.lower()] if s.scope != "BORROWER" else [])]
            return s.category + (f"[{','.join(marks)}]" if marks else "")
        case Sum() | Count() | Not():
            return f"{node.kind}({render(node.of)})"
        case Min() | Max():
            return f"{node.kind}({', '.join(map(render, node.args))})"
        case Add() | Subtract() | Multiply():
            return f"({render(node.left)} {_SIGN[node.kind]} {render(node.right)})"
        case Divide():
            return f"({render(node.numerator)} / {render(node.denominator)})"
        case PeriodAggregate():
            return f"{node.reducer.lower()} by {node.grouping.lower()}({render(node.of)})"
        case Compare():
            return f"{render(node.left)} {_COMPARE[node.comparator]} {render(node.right)}"
        case And() | Or():
            return "(" + f" {node.kind} ".join(map(render, node.args)) + ")"
    return node.kind


def render_definition(d: Definition) -> str:
    when = "" if isinstance(d.activation, Always) else f" when {render(d.activation)}"
    return f"{d.scenario_id}/{d.clause_id}: {render(d.metric)} {_COMPARE[d.comparator]} {render(Constant(d.threshold))}{when}"


def blockers(d: Definition) -> list[str]:
    """Why the strict mode doesn't plan a definition: compound plans, computed thresholds, sub-periods, repeated operands."""
    out = []
    if d.breach is not None and primary_comparison(d.metric, d.breach) is None:
        out.append("COMPOUND_PREDICATE_UNSUPPORTED" if isinstance(d.breach, (And, Or, Not)) else "EXPRESSION_THRESHOLD_UNSUPPORTED")
    if any(isinstance(x, PeriodAggregate) and x.grouping != "FULL_PERIOD" for x in walk(d.metric)):
        out.append("PERIOD_INPUTS_REQUIRED")
    if any(len(c) > len(set(c)) for x in walk(d.metric) if (c := children(x))):
        out.append("DUPLICATE_DEPENDENCY")
    return out
