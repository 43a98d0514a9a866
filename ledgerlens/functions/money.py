"""Money, percentages and account tokens in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CURRENCY = {"$": "USD", "US$": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR", "£": "GBP", "GBP": "GBP", "₸": "KZT", "KZT": "KZT"}
#: A currency mark, then everything that is glued to the number.
MONEY = r"(US\$|\$|€|£|₸|\bUSD\b|\bEUR\b|\bGBP\b|\bKZT\b)\s?(\d[\d,]*(?:\.\d+)?[A-Za-z0-9]*)"
#: A complete number: groups of three or none, at most two decimals.
WHOLE = r"^(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?$"
PERCENT = r"(\d+(?:[.,]\d+)?)\s*%"


def currency(mark: Column) -> Column:
    return F.coalesce(*[F.when(mark == k, F.lit(v)) for k, v in _CURRENCY.items()])


def money_tokens(text: Column) -> Column:
    """array of struct(currency, value, malformed) in order of appearance; a number with anything glued to it is malformed, never cut short."""
    marks, numbers = F.regexp_extract_all(text, F.lit(MONEY), F.lit(1)), F.regexp_extract_all(text, F.lit(MONEY), F.lit(2))

    def one(mark: Column, number: Column) -> Column:
        number = F.rtrim(number, F.lit(","))
        good = number.rlike(WHOLE)
        return F.struct(currency(mark).alias("currency"), F.when(good, F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(20,2)")).alias("value"), (~good).alias("malformed"))

    return F.zip_with(marks, numbers, one)


def money_scan(text: Column) -> Column:
    """struct(values, malformed): the distinct (currency, value) of a text and whether any token is malformed."""
    found = money_tokens(text)
    good = F.array_distinct(F.transform(F.filter(found, lambda m: ~m["malformed"]), lambda m: F.struct(m["currency"].alias("currency"), m["value"].alias("value"))))
    return F.struct(good.alias("values"), F.exists(found, lambda m: m["malformed"]).alias("malformed"))


def first_money(text: Column) -> Column:
    """The first token that is well formed, or NULL if one before it is malformed."""
    return F.when(~F.try_element_at(money_tokens(text), F.lit(1))["malformed"], F.try_element_at(money_tokens(text), F.lit(1)))


def plain_number(raw: Column) -> Column:
    """1.234,56 and 1,234.56: the last separator is the decimal one; one separator before three digits groups."""
    s = F.replace(F.regexp_replace(raw, r"[\s ]", ""), F.lit("'"), F.lit(""))
    comma, dot = F.instr(s, ","), F.instr(s, ".")
    last_comma = F.length(s) - F.instr(F.reverse(s), ",") + 1
    last_dot = F.length(s) - F.instr(F.reverse(s), ".") + 1
    us, eu = F.replace(s, F.lit(","), F.lit("")), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    both = F.when(last_dot > last_comma, us).otherwise(eu)
    grouped = s.rlike(r"^[+-]?\d{1,3}(,\d{3})+$")
    out = F.when((comma > 0) & (dot > 0), both).when((comma > 0) & grouped, us).when(comma > 0, eu).otherwise(s)
    return out.try_cast("decimal(38,6)")


def percent(text: Column) -> Column:
    found = F.regexp_extract(text, PERCENT, 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).try_cast("decimal(12,4)"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def complete_tokens(text: Column) -> Column:
    """Runs of letters, digits, underscores and hyphens: what transaction ids are looked up among."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_-]+"), lambda x: x != "")


def fts_query(text: Column, stop: tuple[str, ...]) -> Column:
    """The quoted tokens of a full-text query, all of which must match."""
    kept = F.array_except(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+"), lambda x: x != ""), F.array(*map(F.lit, stop)))
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " AND ")
