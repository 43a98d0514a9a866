"""Definitions compiled to one aggregation.

Every distinct (selector, floor, grouping) of a definition is a slot. All slots of all definitions
meet the inputs in one join on scenario and category and one aggregation by slot and part of the
period, with partial sums before the shuffle. What is left is a few rows per definition; the
expression is folded over them in Python decimals of 60 digits, half even, with every
number's status, currency and issues. Plan size doesn't depend on the number of definitions.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as t
from ..operators import selectors as sel
from . import algebra as a

CONTEXT = Context(prec=60, rounding=ROUND_HALF_EVEN)
#: A table of at most so many slots is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_SLOTS = 100_000
SLOTS = (
    "definition_id string, scenario_id string, slot int, category string, include_flags array<string>, exclude_flags array<string>, related_only boolean, group_level boolean, "
    "floor decimal(38,6), floor_currency string, grouping string, basis string, lo date, hi date, quarter int, as_of date"
)
RESULT = (
    "definition_id string, scenario_id string, clause_id string, status string, compliance string, activation string, qtype string, value string, currency string, "
    "issues array<string>, input_count long"
)


def slots_of(d: a.Definition) -> dict[tuple[a.Selector, str, str], int]:
    """(selector, grouping, basis) of a definition's sets, numbered."""
    out: dict[tuple[a.Selector, str, str], int] = {}

    def visit(node: a.Expr, grouping: str, basis: str) -> None:
        if isinstance(node, a.PeriodAggregate):
            grouping, basis = node.grouping, node.basis
        if isinstance(node, a.TransactionSet):
            out.setdefault((node.selector, grouping, basis), len(out))
        for child in a.children(node):
            visit(child, grouping, basis)

    for root in (d.activation, d.metric, a.breach_of(d)):
        visit(root, "FULL_PERIOD", "CASH_DATE")
    return out


def _date(x: str | None) -> datetime.date | None:
    return datetime.date.fromisoformat(x) if x else None


def bounds(p: a.Period) -> tuple[datetime.date | None, datetime.date | None, int | None, datetime.date | None]:
    """(first day, last day, calendar quarter, as of): what in_bounds() tests a flow or a stock against; all None where nothing can be told."""
    start, end = (p.flow_start or p.start, p.flow_end or p.end) if p.kind == "MIXED" else (p.start, p.end)
    whole = bool(start and end) and p.kind != "AS_OF" and (p.kind != "FINANCIAL_QUARTER" or p.quarter is not None)
    day = datetime.timedelta(1)
    lo = _date(start) + (datetime.timedelta(0) if p.start_inclusive else day) if whole else None
    hi = _date(end) - (datetime.timedelta(0) if p.end_inclusive else day) if whole else None
    return lo, hi, p.quarter if p.kind == "FINANCIAL_QUARTER" and not whole else None, _date(p.as_of)


def slot_table(spark: SparkSession, definitions: list[a.Definition]) -> DataFrame:
    rows = []
    for d in definitions:
        period = bounds(d.period)
        for (s, grouping, basis), k in slots_of(d).items():
            floor = d.floor if d.floor and d.floor.category == s.category else None
            rows.append((d.definition_id, d.scenario_id, k, s.category, list(s.include_flags), list(s.exclude_flags), s.related_party_only, s.group_level, floor and floor.value, floor and floor.currency, grouping, basis, *period))
    out = spark.createDataFrame(rows, SLOTS)
    return F.broadcast(out) if len(rows) <= BROADCAST_SLOTS else out


def keyed(inputs: DataFrame) -> DataFrame:
    """A row of inputs for each category that may select it: its memberships and, for related parties, payments to them."""
    members = F.when(F.size("selector_categories") > 0, F.col("selector_categories")).otherwise(F.array("category"))
    paid = F.when(F.col("related_party") == "TRUE", F.array(F.lit("RELATED_PARTY_PAYMENTS"))).otherwise(F.array().cast("array<string>"))
    return inputs.withColumn("key", F.explode(F.array_union(members, paid)))


def joined(slots: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs with the slots that take them; member is NULL where the period can't be told."""
    s, i = slots.alias("s"), keyed(inputs).alias("i")
    rows = i.join(s, (F.col("i.scenario_id") == F.col("s.scenario_id")) & (F.col("i.key") == F.col("s.category"))).select("i.*", "s.definition_id", "s.slot", F.col("s.category").alias("wanted"), "s.include_flags", "s.exclude_flags", "s.related_only", "s.group_level", "s.floor", "s.floor_currency", "s.grouping", "s.basis", "s.lo", "s.hi", "s.quarter", "s.as_of")
    taken = sel.matches(F.col("wanted"), F.col("related_only"), F.col("group_level"), F.col("include_flags"), F.col("exclude_flags"))
    return rows.where(taken).withColumn("member", sel.in_bounds())


def part_of() -> Column:
    """The part of the period that a joined row belongs to, by its slot's grouping and basis."""
    day = F.when(F.col("basis") == "ACCOUNTING", F.coalesce("period_start", "transaction_date")).otherwise(F.coalesce("transaction_date", "period_start"))
    part = (
        F.when(F.col("grouping") == "FINANCIAL_QUARTER", F.concat(F.year(day), F.lit("-Q"), F.quarter(day)))
        .when(F.col("grouping") == "MONTH", F.date_format(day, "yyyy-MM"))
        .when(F.col("grouping") == "YEAR", F.year(day).cast("string"))
        .otherwise(F.lit(""))
    )
    return F.coalesce(part, F.lit("?"))  # only rows whose period can't be told have no day


def kept_rows() -> Column:
    """Whether a joined row counts: in the period and not below the floor."""
    return F.col("member") & (F.col("floor").isNull() | (F.col("amount") >= F.col("floor")))


def aggregate(slots: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row per definition, slot and part: total, count, currencies (as least, greatest), what can't be told."""
    rows = joined(slots, inputs).where(F.col("member").isNull() | F.col("member"))
    part, kept = part_of(), kept_rows()
    foreign = F.col("member") & F.col("floor").isNotNull() & (F.col("currency") != F.col("floor_currency"))
    return rows.groupBy("definition_id", "slot", part.alias("part")).agg(
        F.sum(F.when(kept, F.col("amount"))).cast(t.AMOUNT).cast("string").alias("total"),
        F.count_if(kept).alias("n"),
        F.min(F.when(kept, F.col("currency"))).alias("low"),
        F.max(F.when(kept, F.col("currency"))).alias("high"),
        F.bool_or(F.col("member").isNull()).alias("untold"),
        F.coalesce(F.bool_or(foreign), F.lit(False)).alias("foreign"),
    )


class Number:
    """A value with its type, currency (None for a zero of no currency), status and issues."""

    __slots__ = ("currency", "issues", "n", "qtype", "status", "value", "warnings")

    def __init__(self, qtype, value=None, currency=None, status=t.RESOLVED, issues=(), n=0, warnings=()):
        self.qtype, self.value, self.currency, self.status, self.issues, self.n, self.warnings = qtype, value, currency, status, tuple(issues), n, tuple(warnings)


MIXED = "MIXED_CURRENCY_NO_TRUSTED_CONVERSION"


class Fold:
    """Evaluates a definition over its slots: {(slot, part): row}."""

    def __init__(self, d: a.Definition, cells: dict[tuple[int, str], dict]):
        self.d, self.cells, self.slots = d, cells, slots_of(d)

    def number(self, node: a.Expr, grouping: str = "FULL_PERIOD", basis: str = "CASH_DATE", part: str = "") -> Number:
        below = lambda x: self.number(x, grouping, basis, part)
        match node:
            case a.Constant():
                return Number(node.quantity.qtype, node.quantity.value, node.quantity.currency)
            case a.TransactionSet():
                return self.selected(node, grouping, basis, part, False)
            case a.Sum():
                return below(node.of)
            case a.Count():
                return self.selected(node.of, grouping, basis, part, True)
            case a.PeriodAggregate():
                return self.parts(node)
            case a.Min() | a.Max():
                args = [below(x) for x in node.args]
                return self.failed(args) or self.combined(args, min(args, key=lambda x: x.value) if node.kind == "min" else max(args, key=lambda x: x.value))
            case a.Add() | a.Subtract():
                args = [below(node.left), below(node.right)]
                if bad := self.failed(args):
                    return bad
                value = CONTEXT.add(args[0].value, args[1].value) if node.kind == "add" else CONTEXT.subtract(args[0].value, args[1].value)
                return self.combined(args, Number(args[0].qtype, value))
            case a.Multiply():
                args = [below(node.left), below(node.right)]
                if bad := self.failed(args):
                    return bad
                kind = t.MONEY if t.MONEY in (args[0].qtype, args[1].qtype) else t.RATIO
                return self.combined(args, Number(kind, CONTEXT.multiply(args[0].value, args[1].value)))
            case a.Divide():
                args = [below(node.numerator), below(node.denominator)]
                if bad := self.failed(args):
                    return bad
                if args[1].value == 0:
                    return Number(t.RATIO, status=t.ERROR, issues=("ZERO_DENOMINATOR",))
                out = self.combined(args, Number(t.RATIO, CONTEXT.divide(args[0].value, args[1].value)))
                if args[1].value < 0:
                    out.warnings = (*out.warnings, "NEGATIVE_DENOMINATOR")
                out.currency = None
                return out
        raise a.TypeMismatch(node.kind)

    def selected(self, node: a.TransactionSet, grouping: str, basis: str, part: str, counted: bool) -> Number:
        row = self.cells.get((self.slots[(node.selector, grouping, basis)], part))
        kind = t.COUNT if counted else t.MONEY
        if row is None:
            return Number(kind, Decimal(0))
        if row["untold"]:
            return Number(kind, status=t.UNRESOLVED, issues=("PERIOD_MEMBERSHIP_UNDECIDABLE",))
        if row["foreign"] or (not counted and row["low"] != row["high"]):
            return Number(kind, status=t.UNRESOLVED, issues=(MIXED,))
        if counted:
            return Number(kind, Decimal(row["n"]), n=row["n"])
        return Number(kind, Decimal(row["total"] or 0), row["low"], n=row["n"])

    def parts(self, node: a.PeriodAggregate) -> Number:
        mine = {self.slots[(s, node.grouping, node.basis)] for s in a.selectors(node.of)}
        seen = sorted({p for k, p in self.cells if k in mine})
        numbers = [self.number(node.of, node.grouping, node.basis, p) for p in seen] or [self.number(node.of, node.grouping, node.basis, "")]
        if bad := self.failed(numbers):
            return bad
        if node.reducer == "SUM":
            with localcontext(CONTEXT):
                return self.combined(numbers, Number(numbers[0].qtype, sum((x.value for x in numbers), Decimal(0))))
        return self.combined(numbers, (min if node.reducer == "MIN" else max)(numbers, key=lambda x: x.value))

    @staticmethod
    def failed(args: list[Number]) -> Number | None:
        bad = [x for x in args if x.status != t.RESOLVED]
        if not bad:
            return None
        status = t.ERROR if any(x.status == t.ERROR for x in bad) else t.UNRESOLVED
        return Number(args[0].qtype, status=status, issues=sorted({i for x in bad for i in x.issues}))

    @staticmethod
    def combined(args: list[Number], out: Number) -> Number:
        currencies = {x.currency for x in args if x.qtype == t.MONEY and x.currency is not None}
        if len(currencies) > 1:
            return Number(out.qtype, status=t.UNRESOLVED, issues=(MIXED,))
        currency = (currencies.pop() if currencies else None) if out.qtype == t.MONEY else None
        return Number(out.qtype, out.value, currency, n=sum(x.n for x in args), warnings=sorted({w for x in args for w in x.warnings}))

    def compared(self, left: Number, comparator: str, right: Number) -> tuple[bool | None, str | None]:
        """(verdict, issue): a percentage is compared as a ratio; a zero without a currency takes the other's."""
        x, y = left.value, right.value
        if left.qtype == t.RATIO and right.qtype == t.PERCENT:
            y = y / 100
        elif left.qtype == t.PERCENT and right.qtype == t.RATIO:
            y = y * 100
        elif left.qtype != right.qtype:
            return None, "COMPARISON_TYPE_MISMATCH"
        if left.qtype == t.MONEY and None not in (left.currency, right.currency) and left.currency != right.currency:
            return None, MIXED
        return {t.LT: x < y, t.LTE: x <= y, t.GT: x > y, t.GTE: x >= y, t.EQ: x == y}[comparator], None

    def predicate(self, node: a.Expr) -> tuple[bool | None, str, tuple[str, ...]]:
        """(truth or None, status, issues). Arms are taken from the left, and an unknown one ends the walk."""
        match node:
            case a.Always():
                return True, t.RESOLVED, ()
            case a.Not():
                truth, status, issues = self.predicate(node.of)
                return (None if truth is None else not truth), status, issues
            case a.And() | a.Or():
                ends = node.kind == "or"
                for arm in node.args:
                    truth, status, issues = self.predicate(arm)
                    if truth is None or truth is ends:
                        return truth, status, issues
                return not ends, t.RESOLVED, ()
            case a.Compare():
                left, right = self.number(node.left), self.number(node.right)
                if bad := self.failed([left, right]):
                    return None, bad.status, bad.issues
                truth, issue = self.compared(left, node.comparator, right)
                return truth, t.RESOLVED if issue is None else t.ERROR if issue == "COMPARISON_TYPE_MISMATCH" else t.UNRESOLVED, (issue,) if issue else ()
        raise a.TypeMismatch(node.kind)

    def result(self) -> tuple:
        d = self.d
        actual = self.number(d.metric)
        active, a_status, a_issues = self.predicate(d.activation)
        text = lambda x: None if x.value is None else format(x.value, "f")
        out = lambda status, compliance, activation, issues, x=actual: (d.definition_id, d.scenario_id, d.clause_id, status, compliance, activation, x.qtype, text(x), x.currency, sorted({*issues, *x.warnings}), x.n)
        if active is None:
            return out(a_status, None, "UNKNOWN", a_issues)
        if not active:
            return out(t.NOT_ACTIVATED, "COMPLIANT" if actual.status == t.RESOLVED else None, "INACTIVE", actual.issues)
        state = "ALWAYS" if isinstance(d.activation, a.Always) else "ACTIVE"
        if actual.status != t.RESOLVED:
            return out(actual.status, None, state, actual.issues)
        if d.breach is None:
            ok, issue = self.compared(actual, d.comparator, self.number(a.Constant(d.threshold)))
            if issue:
                return out(t.ERROR if issue == "COMPARISON_TYPE_MISMATCH" else t.UNRESOLVED, None, state, (issue,))
            if actual.qtype == t.MONEY and actual.currency is None:
                actual.currency = d.threshold.currency
            return out(t.RESOLVED, "COMPLIANT" if ok else "BREACH", state, ())
        broken, status, issues = self.predicate(d.breach)
        if broken is None:
            return out(status, None, state, issues)
        return out(t.RESOLVED, "BREACH" if broken else "COMPLIANT", state, ())


def evaluate(definitions: list[a.Definition], inputs: DataFrame, strict: bool = False) -> DataFrame:
    """A result per definition. strict: definitions with a blocker are UNRESOLVED with its code instead of being evaluated."""
    spark = inputs.sparkSession
    blocked = {d.definition_id: a.blockers(d) for d in definitions} if strict else {}
    by_id = {d.definition_id: d for d in definitions}
    cells = aggregate(slot_table(spark, [d for d in definitions if not blocked.get(d.definition_id)]), inputs)
    every = spark.createDataFrame([(d.definition_id,) for d in definitions], "definition_id string")
    row = F.struct("slot", "part", "total", "n", "low", "high", "untold", "foreign")
    packed = every.join(cells.groupBy("definition_id").agg(F.collect_list(row).alias("cells")), "definition_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, got in zip(batch.definition_id, batch.cells, strict=True):
                d = by_id[key]
                if blocked.get(key):
                    out.append((key, d.scenario_id, d.clause_id, t.UNRESOLVED, None, None, None, None, None, blocked[key], 0))
                else:
                    out.append(Fold(d, {(c["slot"], c["part"]): c for c in (got if got is not None else ())}).result())
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")], dtype=object)

    return packed.mapInPandas(run, RESULT)


def contributing(definitions: list[a.Definition], inputs: DataFrame) -> DataFrame:
    """(definition_id, transaction_id): the transactions that a definition's number was computed from - of all arms, in the
    period and not below the floor - as a table to join with results, so no result carries an array that grows with its rows."""
    metric = [(d.definition_id, k) for d in definitions for (s, g, b), k in slots_of(d).items() if (s, g, b) in _metric_slots(d)]
    rows = joined(slot_table(inputs.sparkSession, definitions), inputs).where(kept_rows() & F.col("transaction_id").isNotNull())
    own = inputs.sparkSession.createDataFrame(metric, "definition_id string, slot int")
    own = F.broadcast(own) if len(metric) <= BROADCAST_SLOTS else own
    return rows.join(own, ["definition_id", "slot"]).select("definition_id", "transaction_id").distinct()


def _metric_slots(d: a.Definition) -> set[tuple[a.Selector, str, str]]:
    from dataclasses import replace

    return set(slots_of(replace(d, activation=a.Always(), breach=None)))


def manifest(results: DataFrame) -> DataFrame:
    """One row of counters over results: definitions, ends, verdicts."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    return results.agg(
        F.count("*").alias("results"), of("status", t.RESOLVED).alias("resolved"), of("status", t.UNRESOLVED).alias("unresolved"), of("status", t.ERROR).alias("errors"),
        of("status", t.NOT_ACTIVATED).alias("not_activated"), of("compliance", "COMPLIANT").alias("compliant"), of("compliance", "BREACH").alias("breach"),
    )


class Traced(Fold):
    """A fold that notes what every node came to, in the order in which nodes ended."""

    def __init__(self, d: a.Definition, cells: dict[tuple[int, str], dict]):
        super().__init__(d, cells)
        self.steps: list[tuple] = []

    def number(self, node: a.Expr, grouping: str = "FULL_PERIOD", basis: str = "CASH_DATE", part: str = "") -> Number:
        out = super().number(node, grouping, basis, part)
        self.steps.append((node.kind, part, out.status, out.qtype, None if out.value is None else format(out.value, "f"), out.currency, list(out.issues)))
        return out

    def predicate(self, node: a.Expr) -> tuple[bool | None, str, tuple[str, ...]]:
        out = super().predicate(node)
        self.steps.append((node.kind, "", out[1], "BOOLEAN", None if out[0] is None else str(out[0]).lower(), None, list(out[2])))
        return out


def trace(definitions: list[a.Definition], inputs: DataFrame) -> DataFrame:
    """definition_id, step, kind, part, status, qtype, value, currency, issues of every node of every definition."""
    by_id = {d.definition_id: d for d in definitions}
    spark = inputs.sparkSession
    cells = aggregate(slot_table(spark, definitions), inputs)
    every = spark.createDataFrame([(d.definition_id,) for d in definitions], "definition_id string")
    row = F.struct("slot", "part", "total", "n", "low", "high", "untold", "foreign")
    packed = every.join(cells.groupBy("definition_id").agg(F.collect_list(row).alias("cells")), "definition_id", "left")
    schema = "definition_id string, step int, kind string, part string, status string, qtype string, value string, currency string, issues array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, got in zip(batch.definition_id, batch.cells, strict=True):
                fold = Traced(by_id[key], {(c["slot"], c["part"]): c for c in (got if got is not None else ())})
                fold.result()
                out += [(key, k, *step) for k, step in enumerate(fold.steps)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")], dtype=object)

    return packed.mapInPandas(run, schema)


def topological(dependencies: dict[str, list[str]]) -> list[str]:
    """Nodes after all that they depend on, the least id first wherever several may come; raises on a cycle or an unknown node."""
    import heapq

    if unknown := sorted({x for xs in dependencies.values() for x in xs} - set(dependencies)):
        raise ValueError(f"unknown nodes: {unknown}")
    waits = {k: set(v) for k, v in dependencies.items()}
    ready, out = [k for k, v in waits.items() if not v], []
    heapq.heapify(ready)
    while ready:
        now = heapq.heappop(ready)
        out.append(now)
        for k, v in waits.items():
            if now in v:
                v.remove(now)
                if not v:
                    heapq.heappush(ready, k)
    if len(out) < len(waits):
        raise ValueError(f"cycle among {sorted(k for k, v in waits.items() if v)}")
    return out
