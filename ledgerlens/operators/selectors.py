"""Which inputs a selector takes and whether they lie in the period, as columns over joined slot and input rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import RELATED_PARTY_MEMBERS


def matches(category: Column, related_only: Column, group_level: Column, include_flags: Column, exclude_flags: Column) -> Column:
    """The strict match of a row of calculation inputs with a selector; scope is part of identity only."""
    members = F.when(F.size("selector_categories") > 0, F.col("selector_categories")).otherwise(F.array("category"))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    related = F.coalesce(F.col("related_party") == "TRUE", F.lit(False))
    among = F.arrays_overlap(members, F.array(*map(F.lit, RELATED_PARTY_MEMBERS)))
    source = F.array_contains(flags, "GROUP_LEVEL_SOURCE")
    group = F.coalesce(F.col("entity_scope") == "GROUP", F.lit(False))
    own = F.array_contains(members, category)
    plain = (
        F.when(category == "RELATED_PARTY_PAYMENTS", related & (own | (F.col("amount") < 0) | among))
        .when(category == "GROUP_CAPEX", own & group & source)
        .when(category == "CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS", own & F.coalesce(F.col("subsidiary_status") == "UNRESTRICTED", F.lit(False)))
        .when(group_level & ~source & ~group, F.lit(False))
        .otherwise(own)
    )
    return (~related_only | related) & F.coalesce(plain, F.lit(False)) & (F.size(F.array_except(include_flags, flags)) == 0) & ~F.coalesce(F.arrays_overlap(exclude_flags, flags), F.lit(False))


def bound(value: Column, limit: Column, inclusive: Column, start: bool) -> Column:
    """value on the right side of a limit that may be inclusive."""
    return F.when(inclusive, value >= limit if start else value <= limit).otherwise(value > limit if start else value < limit)


def in_flow(value: Column, p: str = "period") -> Column:
    """In a closed interval; null where the kind of period has none or a bound is missing."""
    f = lambda n: F.col(f"{p}.{n}")
    mixed = f("kind") == "MIXED"
    start = F.when(mixed, F.coalesce(f("flow_start"), f("start"))).otherwise(f("start"))
    end = F.when(mixed, F.coalesce(f("flow_end"), f("end"))).otherwise(f("end"))
    inside = bound(value, start, f("start_inclusive"), True) & bound(value, end, f("end_inclusive"), False)
    return F.when((f("kind") == "AS_OF") | start.isNull() | end.isNull(), F.lit(None).cast("boolean")).otherwise(inside)


def in_quarter(value: Column, p: str = "period") -> Column:
    """By the quarter's bounds if there are some, else in that calendar quarter of any year."""
    f = lambda n: F.col(f"{p}.{n}")
    bounded = f("start").isNotNull() & f("end").isNotNull()
    return F.when((f("kind") != "FINANCIAL_QUARTER") | f("quarter").isNull(), F.lit(None).cast("boolean")).when(bounded, in_flow(value, p)).otherwise(F.quarter(value) == f("quarter"))


def at_or_before(value: Column, p: str = "period") -> Column:
    f = lambda n: F.col(f"{p}.{n}")
    return F.when(f("kind").isin("AS_OF", "MIXED"), value <= f("as_of"))


def in_period(p: str = "period") -> Column:
    """TRUE, FALSE or NULL (can't be told) for a row of inputs: excluded rows are out, flows go by their date or both ends, stocks by their very date."""
    flow = lambda v: F.when(F.col(f"{p}.kind") == "FINANCIAL_QUARTER", in_quarter(v, p)).otherwise(in_flow(v, p))
    start, end = flow(F.col("period_start")), flow(F.col("period_end"))
    span = F.when(F.col("period_start").isNull() | F.col("period_end").isNull() | start.isNull() | end.isNull(), F.lit(None).cast("boolean")).otherwise(start & end)
    return (
        F.when(F.coalesce("period_excluded", F.lit(False)), F.lit(False))
        .when(F.col("period_semantics") == "FLOW", F.when(F.col("transaction_date").isNotNull(), flow(F.col("transaction_date"))).otherwise(span))
        .when(F.col("period_semantics") == "AS_OF", F.col("as_of_date") == F.col(f"{p}.as_of"))
    )


def in_bounds() -> Column:
    """in_period() for a period whose inclusive bounds (lo, hi), calendar quarter of any year or as_of are columns beside the row."""
    flow = lambda v: F.when(F.col("lo").isNotNull(), (v >= F.col("lo")) & (v <= F.col("hi"))).when(F.col("quarter").isNotNull(), F.quarter(v) == F.col("quarter"))
    start, end = F.coalesce("transaction_date", "period_start"), F.coalesce("transaction_date", "period_end")
    return (
        F.when(F.coalesce("period_excluded", F.lit(False)), F.lit(False))
        .when((F.col("period_semantics") == "FLOW") & start.isNotNull() & end.isNotNull(), flow(start) & flow(end))
        .when(F.col("period_semantics") == "AS_OF", F.col("as_of_date") == F.col("as_of"))
    )
