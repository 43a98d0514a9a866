"""Dates and periods in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Period

_ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "перв": 1, "втор": 2, "трет": 3, "четв": 4}


def iso_date(raw: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(F.trim(raw), 1, 10), F.lit("yyyy-MM-dd")))


def any_date(raw: Column) -> Column:
    """yyyy-MM-dd or dd.MM.yyyy, whichever parses."""
    token = F.substring(F.trim(raw), 1, 10)
    return F.coalesce(F.to_date(F.try_to_timestamp(token, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(token, F.lit("dd.MM.yyyy"))))


def period_label(raw: Column) -> Column:
    """A quarter as YYYY-Qn, or Qn without a year; anything else as it is, trimmed."""
    text = F.trim(raw)
    low = F.lower(text)
    digit = F.regexp_extract(low, r"\bq\s*([1-4])\b", 1)
    before = F.regexp_extract(low, r"\b([1-4])\s*(?:-?й)?\s*(?:кв|quarter)", 1)
    word = F.coalesce(*[F.when(low.rlike(rf"\b{w}\w*\s+(?:quarter|квартал)"), F.lit(str(n))) for w, n in _ORDINALS.items()])
    q = F.coalesce(F.when(digit != "", digit), F.when(before != "", before), word)
    year = F.regexp_extract(low, r"\b(20\d{2}|19\d{2})\b", 1)
    return F.when(q.isNotNull(), F.when(year != "", F.concat(year, F.lit("-Q"), q)).otherwise(F.concat(F.lit("Q"), q))).when(text != "", text)


SERVICE = re.compile(r"(?:с|from)\s+(\d{4}-\d{2}-\d{2})\s+(?:по|to|until|-)\s+(\d{4}-\d{2}-\d{2})", re.IGNORECASE)
_AS_OF = re.compile(r"(?:as of|as at|по состоянию на)\s+(\d{4}-\d{2}-\d{2})", re.IGNORECASE)
_QUARTER = re.compile(r"\bQ([1-4])\b|\b(first|second|third|fourth)\s+(?:financial\s+)?quarter\b", re.IGNORECASE)


def parse_period(text: str) -> Period | None:
    """The period a clause names: a quarter, else dates of flow and of stock (mixed), else a date, else an interval."""
    span, at, quarter = SERVICE.search(text), _AS_OF.search(text), _QUARTER.search(text)
    if quarter:
        n = int(quarter[1]) if quarter[1] else _ORDINALS[quarter[2].lower()]
        return Period("FINANCIAL_QUARTER", *(span.groups() if span else (None, None)), quarter=n)
    if span and at:
        return Period("MIXED", as_of=at[1], flow_start=span[1], flow_end=span[2])
    if at:
        return Period("AS_OF", as_of=at[1])
    return Period("CLOSED_INTERVAL", span[1], span[2]) if span else None
