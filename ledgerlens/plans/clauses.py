"""Clauses to definitions: locate the clause, name its formula family, comparator, threshold, period and modifiers.

Tens of short clauses are compiled, on the driver; nothing here touches a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from .. import types as t
from ..functions.periods import parse_period
from . import algebra as a

# The phrases that name a formula family, from the specific to the general.
# A family is the first whose test holds for the lower-cased text.
_RATIO_X = re.compile(r"\d+(?:\.\d+)?\s*x")
FAMILY_TESTS: tuple[tuple[str, Callable[[str], bool]], ...] = (
    ("INTEREST_COVER_RATIO", lambda s: _any(s, "покрытия процентов", "interest cover") and _any(s, "ebitda", "выручка за вычетом операционных")),
    ("SPRINGING_DRAWDOWN_LEVERAGE", lambda s: "springing" in s or _all(s, "поступлений по финансированию", "ebitda", "только при условии")),
    ("SOURCES_OVER_USES_RATIO", lambda s: _any(s, "cover of applications by sources", "выручки и поступлений по финансированию", "sources over uses")),
    ("CAPITAL_INTENSITY_RATIO", lambda s: _any(s, "capital intensity", "капиталоёмкости", "капиталоемкости")),
    ("MIN_INSURANCE_COVER_RATIO", lambda s: (_any(s, "страхово", "insurance cover")) and _any(s, "арендн", "коммунальн", "rent")),
    ("MIN_ADJ_EBITDA_MARGIN", lambda s: _all(s, "скорректированн", "ebitda", "выруч") or _all(s, "adjusted ebitda", "revenue")),
    ("MAX_GROUP_CAPEX_TO_BORROWER_EBITDA", lambda s: "капитальных затрат группы" in s or _all(s, "групп", "капитальн", "ebitda", "отношен") or _all(s, "group capex", "ebitda")),
    ("MAX_TAX_UTILITIES_TO_EBITDA", lambda s: _all(s, "налогов", "коммунальн", "ebitda") or _all(s, "tax", "utilities", "ebitda")),
    ("MAX_RP_AS_RATIO_OF_OPEX", lambda s: (_all(s, "связанным сторонам", "операционных расходов") or _all(s, "related part", "operating expenses")) and bool(_RATIO_X.search(s))),
    ("MIN_REVENUE_COVER_OF_PAYROLL_UTILITIES", lambda s: (_all(s, "оплату труда", "коммунальн", "выруч", "не менее") and "за вычетом" not in s) or _all(s, "revenue", "payroll and utilities")),
    ("MAX_CAPITAL_TRANSFERS_TO_UNRESTRICTED_SUBS_RATIO", lambda s: _all(s, "неограниченн", "дочерн", "капитальн") or _all(s, "unrestricted subsidiar", "capital")),
    ("MAX_RELATED_PARTY_RATIO_OF_REVENUE", lambda s: _any(s, "related-party", "аффилир", "связанн") and _any(s, "от выручки", "proportion of revenue") and bool(_RATIO_X.search(s))),
    ("MIN_REVENUE_MINUS_MAX_OVERHEAD", lambda s: "выручка за вычетом наибольшей" in s or _all(s, "наибольшей из величин", "выруч") or "revenue less the greater of" in s),
    ("MAX_SINGLE_OVERHEAD_LINE", lambda s: _any(s, "отдельная статья накладных", "individual overhead")),
    ("MAX_PERSONNEL_OBLIGATIONS", lambda s: "обязательства по персоналу" in s or _all(s, "personnel", "severance") or _all(s, "personnel", "выходных пособий")),
    ("MAX_RELATED_PARTY_PAYMENTS", lambda s: _any(s, "связанн", "аффилир", "related") and _any(s, "платеж", "payment") and not _any(s, "от выручки", "операционных расходов")),
    ("MAX_CAPEX", lambda s: _any(s, "капитальн", "capex", "capital expenditure") and _any(s, "превыш", "не вправе", "exceed") and not _any(s, "отношен", "групп", "неограниченн")),
    ("MIN_REVENUE_QUARTER", lambda s: _revenue_floor(s) and _any(s, "квартал", "quarter")),
    ("MIN_REVENUE", lambda s: _revenue_floor(s)),
)
COMPARATORS = (
    (t.LTE, r"не\s+долж\w*\s+превыш\w*|не\s+вправе\s+допускать.{0,80}?превыш|обязуется\s+не\s+допускать.{0,120}?превыш|не\s+превыш\w*|(?:must|shall)\s+not\s+exceed|not\s+greater\s+than|at\s+most|не\s+более|свыше\s+\$"),
    (t.GTE, r"не\s+менее|не\s+ниже|not\s+less\s+than|at\s+least|не\s+допускать\s+снижения.{0,40}?ниже"),
    (t.GT, r"must\s+exceed|greater\s+than"),
    (t.LT, r"less\s+than|ниже\s+величины"),
    (t.EQ, r"must\s+equal|равно\s+"),
)
MODIFIERS = (
    ("MATERIALITY_FLOOR", r"(?:not less than|at least|в размере не менее)\s+(?:USD|\$)\s?([\d,]+(?:\.\d{1,2})?)\s+each"),
    ("INCLUDE_RECLASSIFIED", r"including reclassified"),
    ("EXCLUDE_RECLASSIFIED", r"excluding reclassified"),
)
ROLES = (("activation", r"only\s+if|только\s+при\s+условии|where"), ("materiality", r"each"), ("compliance", r"exceed|less than|at least|превыш|менее|ниже"))
THRESHOLD = re.compile(r"(?P<ratio>\d+(?:\.\d+)?)\s*x\b|(?P<percent>\d+(?:[.,]\d+)?)\s*%|(?P<mark>US\$|\$|€|USD|EUR)\s?(?P<money>\d[\d,]*(?:\.\d{1,2})?)", re.IGNORECASE)


def _any(s: str, *parts: str) -> bool:
    return any(p in s for p in parts)


def _all(s: str, *parts: str) -> bool:
    return all(p in s for p in parts)


def _revenue_floor(s: str) -> bool:
    return _any(s, "выруч", "revenue") and _any(s, "не менее", "не ниже", "минимальн", "not less than", "at least") and "за вычетом наибольшей" not in s


def norm(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


def locate(document: str, clause_id: str, keywords: tuple[str, ...] = ("exceed", "less than", "at least", "ratio", "превыш", "менее", "коэффициент"), most: int = 5000) -> str | None:
    """The text from a heading with the clause's number to the next heading: of all such the one with most keywords, the first of equals."""
    heads = [m for m in re.finditer(r"(?m)^\s*(?:clause|section|article|пункт|статья)?\s*(\d+(?:\.\d+)*)[.)]?\s+\S", document, re.IGNORECASE)]
    best: tuple[int, str] | None = None
    for m, after in zip(heads, [*heads[1:], None], strict=True):
        if m[1] != clause_id:
            continue
        body = document[m.start() : min(after.start() if after else len(document), m.start() + most)]
        score = sum(k in body.lower() for k in keywords)
        if score and (best is None or score > best[0]):
            best = (score, body.strip())
    return best[1] if best else None


def comparator(text: str) -> str | None:
    """The first comparator whose wording occurs, ceilings before floors."""
    text = norm(text)
    return next((c for c, p in COMPARATORS if re.search(p, text, re.IGNORECASE | re.DOTALL)), None)


@dataclass(frozen=True)
class Candidate:
    quantity: a.Quantity
    role: str
    at: int


def thresholds(text: str) -> list[Candidate]:
    """Quantities of a clause with the role of the nearest cue before (or right after) each."""
    text, out = norm(text), []
    for m in THRESHOLD.finditer(text):
        if m["ratio"]:
            q = a.Quantity(t.RATIO, Decimal(m["ratio"]))
        elif m["percent"]:
            q = a.Quantity(t.PERCENT, Decimal(m["percent"].replace(",", ".")))
        else:
            q = a.Quantity(t.MONEY, Decimal(m["money"].replace(",", "")), "EUR" if m["mark"].upper() in ("€", "EUR") else "USD")
        if re.match(r"\s+each\b", text[m.end() :]):
            role = "materiality"
        else:
            cues = [(c.end(), r) for r, p in ROLES if r != "materiality" for c in re.finditer(p, text[: m.start()], re.IGNORECASE)]
            last = max(cues, default=(-1, "compliance"))
            active = [e for e, r in cues if r == "activation"]
            role = "activation" if active and not re.search(r"[.;]", text[max(active) : m.start()]) else last[1]
        out.append(Candidate(q, role, m.start()))
    return out


def select_threshold(candidates: list[Candidate], prefer_ratio: bool) -> a.Quantity | str:
    """The one compliance threshold, or MISSING_THRESHOLD / AMBIGUOUS_THRESHOLD."""
    found = [c.quantity for c in candidates if c.role == "compliance"]
    liked = [q for q in found if (q.qtype in (t.RATIO, t.PERCENT)) == prefer_ratio] or found
    distinct = list(dict.fromkeys(liked))
    return distinct[0] if len(distinct) == 1 else "AMBIGUOUS_THRESHOLD" if distinct else "MISSING_THRESHOLD"


def family(text: str) -> str | None:
    low = norm(text).lower()
    return next((name for name, test in FAMILY_TESTS if test(low)), None)


def modifiers(text: str) -> list[tuple[str, str | None]]:
    text = norm(text)
    return [(name, m[1] if m.groups() else None) for name, p in MODIFIERS if (m := re.search(p, text, re.IGNORECASE))]


def scope(text: str) -> str:
    low = text.lower()
    return "GROUP" if _any(low, "the group", "consolidated", "группы") else "BORROWER"


@dataclass(frozen=True)
class Compiled:
    definition: a.Definition | None
    status: str


def compile_clause(document: str, scenario_id: str, clause_id: str, families: dict) -> Compiled:
    """The definition of a clause, or why there is none. families: name -> (metric, comparator, threshold, activation)."""
    text = locate(document, clause_id)
    if text is None:
        return Compiled(None, "CLAUSE_NOT_FOUND")
    name = family(text)
    if name is None:
        return Compiled(None, "UNSUPPORTED_FORMULA")
    metric, usual, _, activation = families[name]
    ratio = a.quantity_type(metric) == t.RATIO
    limit = select_threshold(thresholds(text), ratio)
    if isinstance(limit, str):
        return Compiled(None, limit)
    if ratio != (limit.qtype in (t.RATIO, t.PERCENT)):
        return Compiled(None, "TYPE_MISMATCH")
    active = [c.quantity for c in thresholds(text) if c.role == "activation"]
    if isinstance(activation, a.Compare) and active:
        activation = a.Compare(activation.left, activation.comparator, a.Constant(active[0]))
    floor = next((Decimal(v.replace(",", "")) for k, v in modifiers(text) if k == "MATERIALITY_FLOOR" and v), None)
    return Compiled(
        a.Definition(
            f"{scenario_id}:{clause_id}", scenario_id, clause_id, metric, comparator(text) or usual, limit, parse_period(text) or a.Period(), activation, None,
            a.Floor("ONE_TIME_ADD_BACKS", floor, "USD") if floor is not None else None, name,
        ),
        "COMPILED",
    )


def attach_floor(d: a.Definition, adjustments_text: str) -> a.Definition:
    """A definition that uses add-backs takes the adjustments document's one materiality floor if it has none."""
    from dataclasses import replace

    uses = any(s.category == "ONE_TIME_ADD_BACKS" for s in a.selectors(d.metric))
    found = {v for k, v in modifiers(adjustments_text) if k == "MATERIALITY_FLOOR"}
    if d.floor or not uses or len(found) != 1:
        return d
    return replace(d, floor=a.Floor("ONE_TIME_ADD_BACKS", Decimal(found.pop().replace(",", "")), "USD"))
