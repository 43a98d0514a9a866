"""Causal evidence: the one transaction whose absence, or whose adjustment undone, turns a verdict.

A definition's totals per slot and part of its period are known from the evaluation: a few rows per definition, as many as the
definitions that the caller holds, so they go to every task. A candidate's contribution is
subtracted from them. What a transaction can move at most, in any slot and part, is the sum of its amounts; each definition
has a bound below which no such change turns a comparison, found by interval arithmetic, and only transactions that can move
more become candidates. Comparisons are then made in floating point for all candidates of a batch at once; only where one
may come out otherwise is the expression folded again in exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as t
from ..plans import algebra as a
from ..plans import compile as c
from ..sources.scratch import written


def contributions(definitions: list[a.Definition], inputs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(definition_id, txn_id, slot, part, total, n) of every row that counts for a definition, of rows with a transaction; and more columns of the inputs."""
    rows = c.joined(c.slot_table(inputs.sparkSession, definitions), inputs).where(c.kept_rows() & F.col("transaction_id").isNotNull())
    return rows.select("definition_id", F.col("transaction_id").alias("txn_id"), "slot", c.part_of().alias("part"), F.col("amount").cast(t.AMOUNT).alias("total"), F.lit(1).cast("long").alias("n"), *more)


Span = tuple[float, float]
ANY: Span = (-np.inf, np.inf)


def _hull(spans: list[Span]) -> Span:
    return min(x for x, _ in spans), max(x for _, x in spans)


class Bound:
    """What a definition's comparisons can come to when every slot and part moves by at most some amount.

    added: whether a change may add a part of the period that the definition has no rows in.
    """

    def __init__(self, d: a.Definition, cells: dict[tuple[int, str], dict], added: bool):
        self.slots, self.added = c.slots_of(d), added
        self.tests = [x for root in (d.activation, a.breach_of(d)) for x in a.walk(root) if isinstance(x, a.Compare)]
        self.totals = {k: float(Decimal(x["total"] or 0)) for k, x in cells.items()}

    def span(self, node: a.Expr, by: float, grouping: str = "FULL_PERIOD", basis: str = "CASH_DATE", part: str | None = "") -> Span:
        below = lambda x: self.span(x, by, grouping, basis, part)
        match node:
            case a.Constant():
                v = float(node.quantity.value) / (100 if node.quantity.qtype == t.PERCENT else 1)
                return v - abs(v) * 1e-12, v + abs(v) * 1e-12
            case a.TransactionSet():
                v = self.totals.get((self.slots[(node.selector, grouping, basis)], part), 0.0)
                wide = by + abs(v) * 1e-12
                return v - wide, v + wide
            case a.Sum():
                return below(node.of)
            case a.PeriodAggregate():
                return self.parts(node, by)
            case a.Min() | a.Max():
                ends, pick = [below(x) for x in node.args], min if node.kind == "min" else max
                return pick(x for x, _ in ends), pick(x for _, x in ends)
            case a.Add() | a.Subtract():
                (low, high), (x, y) = below(node.left), below(node.right)
                return (low + x, high + y) if node.kind == "add" else (low - y, high - x)
            case a.Multiply() | a.Divide():
                left, right = (below(node.left), below(node.right)) if node.kind == "multiply" else (below(node.numerator), below(node.denominator))
                if not np.isfinite([*left, *right]).all() or (node.kind == "divide" and right[0] <= 0 <= right[1]):
                    return ANY
                ends = [x * y if node.kind == "multiply" else x / y for x in left for y in right]
                return min(ends), max(ends)
        return ANY  # counts: a bound on amounts says nothing of them

    def parts(self, node: a.PeriodAggregate, by: float) -> Span:
        """Parts that may lose all their rows may be absent; without any, and if parts may be added, one without rows counts too."""
        mine = {self.slots[(s, node.grouping, node.basis)] for s in a.selectors(node.of)}
        seen = sorted({p for k, p in self.totals if k in mine})
        every = [self.span(node.of, by, node.grouping, node.basis, p) for p in seen]
        stays = [any(abs(self.totals.get((k, p), 0.0)) > by * 1.000001 + 1e-6 for k in mine) for p in seen]
        sure = [x for x, ok in zip(every, stays, strict=True) if ok]
        spare = [self.span(node.of, by, node.grouping, node.basis, None)] if self.added or not sure else []
        if node.reducer == "SUM":
            if self.added:
                return ANY
            ends = [x if ok else (min(x[0], 0.0), max(x[1], 0.0)) for x, ok in zip(every, stays, strict=True)]
            return _hull([(sum(x for x, _ in ends), sum(x for _, x in ends)), *spare])
        low, high = _hull([*every, *spare])
        if not sure:
            return low, high
        return (low, min(x for _, x in sure)) if node.reducer == "MIN" else (max(x for x, _ in sure), high)

    def settled(self, by: float) -> bool:
        """Whether no change of at most `by` in every slot and part turns a comparison."""
        for test in self.tests:
            (low, high), (x, y) = self.span(test.left, by), self.span(test.right, by)
            if not (low - y > 1e-9 or high - x < -1e-9):
                return False
        return True

    def most(self) -> float:
        """An amount by which everything may move without a comparison turning, within a factor of 1.5 of the largest one; -1 if there is none."""
        low, high = -20, 240
        if not self.settled(0.0):
            return -1.0
        if self.settled(2.0 ** (high / 2)):
            return np.inf
        if not self.settled(2.0 ** (low / 2)):
            return 0.0
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.settled(2.0 ** (middle / 2)) else (low, middle)
        return 2.0 ** (low / 2)


class Rough:
    """A definition's comparisons in floating point, for many changes at once; None where parts of the period are compared."""

    def __init__(self, d: a.Definition, cells: dict[tuple[int, str], dict]):
        self.slots = c.slots_of(d)
        nodes = [x for root in (d.activation, a.breach_of(d)) for x in a.walk(root)]
        self.tests = None if any(isinstance(x, a.PeriodAggregate) for x in nodes) else [x for x in nodes if isinstance(x, a.Compare)]
        self.cells = {k: (float(Decimal(x["total"] or 0)), float(x["n"])) for (k, part), x in cells.items() if part == ""}

    def number(self, node: a.Expr, taken: dict[int, tuple[np.ndarray, np.ndarray]], counted: bool = False):
        below = lambda x: self.number(x, taken, counted)
        match node:
            case a.Constant():
                return float(node.quantity.value) / (100 if node.quantity.qtype == t.PERCENT else 1)
            case a.TransactionSet():
                slot = self.slots[(node.selector, "FULL_PERIOD", "CASH_DATE")]
                return self.cells.get(slot, (0.0, 0.0))[counted] - taken.get(slot, (0.0, 0.0))[counted]
            case a.Sum():
                return below(node.of)
            case a.Count():
                return self.number(node.of, taken, True)
            case a.Min() | a.Max():
                out = below(node.args[0])
                for x in node.args[1:]:
                    out = (np.minimum if node.kind == "min" else np.maximum)(out, below(x))
                return out
            case a.Add():
                return below(node.left) + below(node.right)
            case a.Subtract():
                return below(node.left) - below(node.right)
            case a.Multiply():
                return below(node.left) * below(node.right)
            case a.Divide():
                return np.divide(below(node.numerator), below(node.denominator))
        raise a.TypeMismatch(node.kind)

    def unsure(self, taken: dict[int, tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        """The changes after which a comparison may come out otherwise."""
        out = np.zeros(rows, bool)
        with np.errstate(all="ignore"):
            for test in self.tests:
                left, right = (np.broadcast_to(self.number(x, taken), rows) for x in (test.left, test.right))
                before = self.number(test.left, {}) - self.number(test.right, {})
                gap = left - right
                near = np.abs(gap) <= 1e-9 * (np.abs(left) + np.abs(right)) + 1e-9
                out |= near | ~np.isfinite(gap) | ~np.isfinite(before) | (np.sign(gap) != np.sign(before))
        return out


def _cells(definitions: list[a.Definition], inputs: DataFrame) -> dict[str, dict[tuple[int, str], dict]]:
    """What each definition's slots hold: as many rows as definitions have slots and parts."""
    out: dict[str, dict[tuple[int, str], dict]] = {d.definition_id: {} for d in definitions}
    for r in c.aggregate(c.slot_table(inputs.sparkSession, definitions), inputs).collect():
        out[r["definition_id"]][(r["slot"], r["part"])] = r.asDict()
    return out


def _flips(definitions: list[a.Definition], cells: dict[str, dict], changes: DataFrame) -> DataFrame:
    """(definition_id, txn_id) of the changes (contributions to take away) that turn a verdict."""
    by_id = {d.definition_id: d for d in definitions}
    verdicts = {k: c.Fold(d, cells[k]).result()[4] for k, d in by_id.items()}
    told = [k for k, v in verdicts.items() if v is not None]
    by_id, cells = {k: by_id[k] for k in told}, {k: cells[k] for k in told}
    # one shuffle for both aggregations: what a transaction counts in each cell, then its cells
    each = changes.repartition("definition_id", "txn_id").groupBy("definition_id", "txn_id", "slot", "part").agg(F.sum("total").cast(t.AMOUNT).alias("total"), F.sum("n").alias("n"))
    own = each.groupBy("definition_id", "txn_id").agg(F.collect_list(F.struct("slot", "part", F.col("total").cast("string").alias("total"), "n")).alias("taken"))

    def changed(key: str, taken) -> str | None:
        now = {place: dict(x) for place, x in cells[key].items()}
        for x in taken:
            place = (x["slot"], x["part"])
            cell = now.get(place)
            if cell is None:
                money = by_id[key].threshold.currency
                cell = now[place] = {"slot": x["slot"], "part": x["part"], "total": "0", "n": 0, "low": money, "high": money, "untold": False, "foreign": False}
            cell["total"] = format(Decimal(cell["total"] or 0) - Decimal(x["total"]), "f")
            cell["n"] -= int(x["n"])
            if cell["n"] <= 0:  # an empty set is a zero of no currency
                del now[place]
        return c.Fold(by_id[key], now).result()[4]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rough: dict[str, Rough] = {}
        for batch in batches:
            out = []
            for key, rows in batch.groupby("definition_id", sort=False):
                if key not in by_id:
                    continue
                if key not in rough:
                    rough[key] = Rough(by_id[key], cells[key])
                look = np.ones(len(rows), bool)
                if rough[key].tests is not None:
                    taken: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                    for i, own in enumerate(rows.taken):
                        for x in own:
                            total, n = taken.setdefault(x["slot"], (np.zeros(len(rows)), np.zeros(len(rows))))
                            total[i] += float(x["total"])
                            n[i] += x["n"]
                    look = rough[key].unsure(taken, len(rows))
                for i in np.flatnonzero(look):
                    then = changed(key, rows.taken.iloc[i])
                    if then is not None and then != verdicts[key]:
                        out.append((key, rows.txn_id.iloc[i]))
            yield pd.DataFrame(out, columns=["definition_id", "txn_id"], dtype=object)

    return own.mapInPandas(run, "definition_id string, txn_id string")


def only_flip(flips: DataFrame) -> DataFrame:
    """(definition_id, txn_id) where exactly one transaction turns the verdict."""
    per = flips.groupBy("definition_id").agg(F.count_distinct("txn_id").alias("n"), F.min("txn_id").alias("txn_id"))
    return per.where("n = 1").select("definition_id", "txn_id")


def _added(definitions: list[a.Definition], cells: dict[str, dict], before: DataFrame) -> set[str]:
    """The definitions for whose parts of the period rows of before may add one."""
    of = [d for d in definitions if any(isinstance(x, a.PeriodAggregate) for root in (d.activation, a.breach_of(d)) for x in a.walk(root))]
    return {k for k, got in _cells(of, before).items() if not got.keys() <= cells[k].keys()} if of else set()


def _bounds(definitions: list[a.Definition], cells: dict[str, dict], added: set[str], inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definition_id, most) and (scenario_id, least): what a change has to exceed to matter to a definition, to any one of a scenario."""
    # a definition without a verdict has none that turns
    bears = lambda d: np.inf if c.Fold(d, cells[d.definition_id]).result()[4] is None else Bound(d, cells[d.definition_id], d.definition_id in added).most()
    spark, most = inputs.sparkSession, [bears(d) for d in definitions]
    least: dict[str, float] = {}
    for d, x in zip(definitions, most, strict=True):
        least[d.scenario_id] = min(x, least.get(d.scenario_id, np.inf))
    told = spark.createDataFrame([(d.definition_id, float(x)) for d, x in zip(definitions, most, strict=True)], "definition_id string, most double")
    per = spark.createDataFrame([(k, float(x)) for k, x in least.items()], "scenario_id string, least double")
    return tuple(F.broadcast(x) if len(definitions) <= c.BROADCAST_SLOTS else x for x in (told, per))


def _moves(inputs: DataFrame, was: bool) -> DataFrame:
    # a little more than the sum, as it is one of floating-point numbers
    size = F.coalesce(F.abs(F.col("amount").cast("double")) * 1.000001, F.lit(0.0))
    return inputs.where(F.col("transaction_id").isNotNull()).select("scenario_id", "transaction_id", size.alias("size"), F.lit(was).alias("was"))


def _narrowed(definitions: list[a.Definition], rows: DataFrame, movers: DataFrame, most: DataFrame) -> DataFrame:
    """Contributions of the transactions that can move (scenario_id, transaction_id, reach) more than a definition bears."""
    # counted, as Spark goes by the size of compressed files
    movers = F.broadcast(movers) if movers.count() <= c.BROADCAST_SLOTS else movers.hint("merge")
    some = rows.join(movers, ["scenario_id", "transaction_id"]).select(*rows.columns, "reach")
    return contributions(definitions, some, ("reach",)).join(most, "definition_id").where("reach > most").drop("reach", "most")


def causal(definitions: list[a.Definition], inputs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Evidence per definition: the one adjusted transaction whose undoing turns the verdict, else the one whose absence does.

    before: the inputs of adjusted transactions as they were, in the columns of inputs.
    """
    cells = _cells(definitions, inputs)
    most, least = _bounds(definitions, cells, set(), inputs)
    if before is None:
        movers = _moves(inputs, False).groupBy("scenario_id", "transaction_id").agg(F.sum("size").alias("reach")).join(least, "scenario_id").where("reach > least")
        here = _narrowed(definitions, inputs, written(movers.select("scenario_id", "transaction_id", "reach"), "movers"), most)
        return only_flip(_flips(definitions, cells, here)).select("definition_id", "txn_id", F.lit("ABSENCE").alias("kind"))
    most_undone, least_undone = _bounds(definitions, cells, _added(definitions, cells, before), inputs)
    per = _moves(inputs, False).unionByName(_moves(before, True)).groupBy("scenario_id", "transaction_id").agg(F.sum(F.when(~F.col("was"), F.col("size"))).alias("own"), F.sum("size").alias("both"), F.bool_or("was").alias("touched"))
    per = per.join(least, "scenario_id").join(least_undone.withColumnRenamed("least", "least_undone"), "scenario_id")
    own, both = F.col("own") > F.col("least"), F.col("touched") & (F.col("both") > F.col("least_undone"))
    movers = written(per.select("scenario_id", "transaction_id", F.when(own, F.col("own")).alias("own"), F.when(both, F.col("both")).alias("both")).where("own is not null or both is not null"), "movers")
    reach = lambda k: movers.where(F.col(k).isNotNull()).select("scenario_id", "transaction_id", F.col(k).alias("reach"))
    gone = only_flip(_flips(definitions, cells, _narrowed(definitions, inputs, reach("own"), most))).withColumn("kind", F.lit("ABSENCE")).withColumn("rank", F.lit(2))
    was = _narrowed(definitions, before, reach("both"), most_undone).withColumns({"total": (-F.col("total")).cast(t.AMOUNT), "n": -F.col("n")})
    undo = _narrowed(definitions, inputs, reach("both"), most_undone).unionByName(was)
    undone = only_flip(_flips(definitions, cells, undo)).withColumn("kind", F.lit("TREATMENT")).withColumn("rank", F.lit(1))
    best = undone.unionByName(gone).groupBy("definition_id").agg(F.min(F.struct("rank", "txn_id", "kind")).alias("b"))
    return best.select("definition_id", "b.txn_id", "b.kind")


def without(inputs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Inputs without the named transactions."""
    return inputs.join(transactions.select(F.col("txn_id").alias("transaction_id")), "transaction_id", "left_anti").select(*inputs.columns)
