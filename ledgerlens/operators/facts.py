"""Facts from documents: patterns per kind, validation against pages, dedupe and conflicts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import FACTS

# What the wording of each kind of fact looks like.
_MONEY = r"(?P<money>(?:\$|€|USD\s?|EUR\s?)\d[\d,]*(?:\.\d{1,2})?)"
_TXN = r"(?P<txn>[A-Z]{3}-[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+)"
_FORM = r"(?:LLP|LLC|JSC|TOO|Inc|Ltd|GmbH|АО|ТОО)"
_NAME = rf"[\"«“]?(?P<name>[A-ZА-Я](?:[\w &'?\-]|\.(?!\s)){{1,80}}?\s{_FORM})[\"»”]?"  # a name doesn't reach over the end of a sentence
PATTERNS = {
    "RECLASSIFICATION": rf"{_TXN}[^.]{{0,120}}?(?:recorded|classified|отражен\w*)\s+as\s+(?P<from>[^,\n.]{{2,60}}?)\s*,?\s*(?:is|shall be|should be)?\s*(?P<disp>reclassified|not reclassified)\s+(?:to|as)\s+(?P<to>[^,\n.]{{2,60}})",
    "PERIOD": rf"{_TXN}[^.]{{0,120}}?(?P<disp>excluded from the period|belongs to the period|assigned to the period)(?:\s+from\s+(?P<start>\d{{4}}-\d{{2}}-\d{{2}})\s+to\s+(?P<end>\d{{4}}-\d{{2}}-\d{{2}}))?",
    "OWNERSHIP": rf"{_NAME}[ \t:|]+(?P<pct>\d{{1,3}}(?:[.,]\d+)?)\s*%",
    "RELATED_PARTY_THRESHOLD": r"(?:владеет|owns)\s+(?P<pct>\d+(?:[.,]\d+)?)\s*%\s+(?:и\s+более|or\s+more|или\s+более)[^.]{0,100}?(?:связанн\w*\s+сторон\w*|related\s+part(?:y|ies))",
    "OFF_LEDGER_AMOUNT": rf"(?:выходн\w*\s+пособи\w*|severance(?:\s+liabilit\w*)?)[^.]{{0,80}}?{_MONEY}(?:[^.]{{0,80}}?(?:as\s+of|по\s+состоянию\s+на)\s+(?P<asof>\d{{4}}-\d{{2}}-\d{{2}}))?",
    "SUBSIDIARY_STATUS": rf"{_NAME}\s+(?:является|is(?:\s+an?)?)\s+(?P<status>unrestricted|restricted|неограниченн\w*|ограниченн\w*)\s+(?:subsidiar\w*|дочерн\w*)",
    "FX_RATE": r"(?:exchange\s+rate|обменн\w*\s+курс)\s+(?:of\s+|is\s+|равен\s+|составил\s+)?(?P<rate>\d+(?:[.,]\d+)?)[^.\n]{0,40}?(?P<f>[A-Z]{3})\s*/\s*(?P<t>[A-Z]{3})",
    "ONE_TIME_ADD_BACK": rf"(?:единовременн\w*|one[-\s]?time|add[-\s]?back)[^.]{{0,100}}?(?:{_NAME}[^.]{{0,40}}?)?{_MONEY}",
    "AMOUNT_CORRECTION": rf"{_TXN}[^.]{{0,120}}?(?:corrected|исправлен\w*)\s+(?:amount\s+)?(?:to|на)\s+{_MONEY}",
    "TREATMENT": rf"{_TXN}[^.]{{0,80}}?(?:is|shall be)\s+(?P<disp>excluded from|included in)\s+(?:the\s+)?(?:calculation|covenant)",
    "GROUP_CAPEX": rf"(?:group|consolidated)\s+(?:capex|capital expenditure)[^.]{{0,60}}?{_MONEY}",
    "CONTINGENT_OBLIGATION": rf"(?P<label>guarantee|indemnity)[^.]{{0,80}}?{_MONEY}",
    "SCHEDULED_PRINCIPAL": rf"scheduled\s+principal[^.]{{0,80}}?{_MONEY}",
}
_COMPILED = {k: re.compile(p, re.IGNORECASE | re.DOTALL) for k, p in PATTERNS.items()}
NONE = re.compile(r"\bno\s+(reclassifications?|adjustments?|one-time items?|related part(?:y|ies)|guarantees?)\b[^.]{0,60}(?:identified|noted|recorded|during)", re.IGNORECASE)
_PPE = {k: re.compile(p + r"\s*(\$\d[\d,]*(?:\.\d{1,2})?)", re.IGNORECASE) for k, p in {"opening": r"net\s+book\s+value\s+at\s+the\s+beginning\s+of\s+the\s+year", "depreciation": r"depreciation\s+charge\s+for\s+the\s+year", "closing": r"net\s+book\s+value\s+at\s+the\s+end\s+of\s+the\s+year"}.items()}
MOVEMENTS = ("disposals", "impairment", "revaluation", "transfers", "acquisitions", "exchange differences")
SPANS = "kind string, document_id string, page_number int, char_start int, char_end int, quote string, " + FACTS


def money(raw: str | None) -> tuple[Decimal | None, str | None]:
    if not raw:
        return None, None
    return Decimal(re.sub(r"[^\d.]", "", raw)), "EUR" if raw[0] == "€" or raw.upper().startswith("EUR") else "USD"


def roll_forward(text: str) -> tuple[Decimal | None, str]:
    """Additions = closing - opening + depreciation, only if every other kind of movement is said to be none."""
    found = {k: p.search(text) for k, p in _PPE.items()}
    if not all(found.values()):
        return None, "INCOMPLETE_PPE_ROLL_FORWARD"
    low = text.lower()
    none = "no other movements" in low or all(any(w in m for m in re.findall(r"there\s+were\s+no\s+([^.!\n]+)", low)) for w in MOVEMENTS)
    if not none:
        return None, "INCOMPLETE_PPE_ROLL_FORWARD"
    v = {k: money(m[1])[0] for k, m in found.items()}
    return v["closing"] - v["opening"] + v["depreciation"], "OK"


def _date(x: str | None):
    return pd.Timestamp(x).date() if x else None


def extract(pages: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """pages (document_id, page_number, scenario_id, raw_text) -> facts with the page, half-open span and quote they come from."""
    names = [x.strip().split()[0] for x in SPANS.replace("decimal(38,6)", "decimal").replace("decimal(9,4)", "decimal").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for kind in kinds:
                    for m in _COMPILED[kind].finditer(r.raw_text or ""):
                        g = m.groupdict()
                        amount, currency = money(g.get("money"))
                        if kind == "FX_RATE":
                            amount, currency = Decimal(g["rate"].replace(",", ".")), f"{g['f']}/{g['t']}".upper()
                        low = (g.get("disp") or "").lower()
                        disp = {"reclassified": "ACCEPTED", "not reclassified": "REJECTED", "excluded from the period": "EXCLUDE", "excluded from": "EXCLUDE", "included in": "INCLUDE"}.get(low, "ASSIGN" if low else None)
                        status = g.get("status")
                        status = None if not status else "UNRESTRICTED" if status.lower().startswith(("un", "не")) else "RESTRICTED"
                        pct = Decimal(g["pct"].replace(",", ".")) if g.get("pct") else None
                        fact_id = f"{r.document_id}:{r.page_number}:{kind}:{m.start()}"
                        out.append((kind, r.document_id, r.page_number, m.start(), m.end(), m[0], fact_id, r.scenario_id, kind, g.get("txn"), g.get("name"), g.get("name"), amount, currency, g.get("from"), g.get("to"), disp, pct, status, _date(g.get("start")), _date(g.get("end")), _date(g.get("asof")), None, g.get("label"), r.document_id))
            yield pd.DataFrame(out, columns=names, dtype=object)

    source = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), "scenario_id", "raw_text")
    return source.mapInPandas(run, SPANS)


def validated(facts: DataFrame, pages: DataFrame, authoritative: DataFrame | None = None, transactions: DataFrame | None = None) -> DataFrame:
    """Facts with the first reason why each isn't acceptable, or ACCEPTED: its document, its quote on the page, its transaction, its ranges."""
    p = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), F.col("raw_text").alias("page_text"))
    out = facts.join(p, ["document_id", "page_number"], "left")
    out = out.withColumn("trusted", F.lit(True)) if authoritative is None else out.join(authoritative.select("document_id").distinct().withColumn("trusted", F.lit(True)), "document_id", "left")
    if transactions is None:
        out = out.withColumn("txn_scenario", F.col("scenario_id"))
    else:
        out = out.join(transactions.select(F.col("txn_id").alias("transaction_id"), F.col("scenario_id").alias("txn_scenario")), "transaction_id", "left")
    at = F.substr(F.col("page_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    reason = (
        F.when(F.col("trusted").isNull(), "NOT_AUTHORITATIVE")
        .when(F.col("page_text").isNull(), "NO_SUCH_PAGE")
        .when((at != F.col("quote")) & ~F.contains("page_text", "quote"), "QUOTE_NOT_ON_PAGE")
        .when(F.col("transaction_id").isNotNull() & F.col("txn_scenario").isNull(), "UNKNOWN_TRANSACTION")
        .when(F.col("transaction_id").isNotNull() & (F.col("txn_scenario") != F.col("scenario_id")), "FACT_SCENARIO_MISMATCH")
        .when((F.col("percent") < 0) | (F.col("percent") > 100), "PERCENT_RANGE")
        .when(F.col("service_start") > F.col("service_end"), "PERIOD_RANGE")
        .otherwise("ACCEPTED")
    )
    return out.withColumn("reason", reason).drop("page_text", "trusted", "txn_scenario")


def identity_and_value() -> tuple[Column, Column]:
    """What a fact is about and what it says of it, as text; NULL for kinds that never conflict."""
    k, s = F.col("fact_kind"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    identity = (
        F.when(k.isin("RECLASSIFICATION", "PERIOD", "AMOUNT_CORRECTION", "TREATMENT"), F.col("transaction_id"))
        .when(k.isin("OWNERSHIP", "SUBSIDIARY_STATUS"), F.lower(F.trim("entity_name")))
        .when(k == "RELATED_PARTY_THRESHOLD", F.lit("threshold"))
        .when(k == "FX_RATE", s("currency"))
        .when(k.isin("GROUP_CAPEX", "SCHEDULED_PRINCIPAL"), F.concat_ws("|", s("period_label"), s("currency")))
        .when(k == "CONTINGENT_OBLIGATION", F.concat_ws("|", s("label"), s("entity_name")))
    )
    value = F.concat_ws("|", *[s(c) for c in ("to_category", "disposition", "amount", "percent", "status", "service_start", "service_end")])
    return identity, F.when(identity.isNotNull(), value)


def conflicts(facts: DataFrame) -> DataFrame:
    """(fact_kind, scenario_id, identity, values, fact_ids) where one identity has several values."""
    identity, value = identity_and_value()
    keyed = facts.withColumns({"identity": identity, "value": value}).where("identity is not null")
    per = keyed.groupBy("fact_kind", "scenario_id", "identity").agg(F.count_distinct("value").alias("values"), F.sort_array(F.collect_set("fact_id")).alias("fact_ids"))
    return per.where("values > 1")


def deduplicated(facts: DataFrame) -> DataFrame:
    """One fact per content: of equal ones that of the least id."""
    content = [c for c in facts.columns if c not in ("fact_id", "source_document_id", "document_id", "page_number", "char_start", "char_end", "quote", "kind")]
    return facts.groupBy(*content).agg(F.min("fact_id").alias("fact_id"))


def without_conflicts(facts: DataFrame, found: DataFrame) -> DataFrame:
    return facts.join(found.select(F.explode("fact_ids").alias("fact_id")).distinct(), "fact_id", "left_anti")


def requirement_states(requirements: DataFrame, facts: DataFrame, confirmed_none: DataFrame | None = None) -> DataFrame:
    """One end state per requirement (scenario_id, fact_kind, sources_read): CONFLICT, RESOLVED, CONFIRMED_NONE, ABSENT_FROM_SOURCE or UNRESOLVED."""
    per = facts.groupBy("scenario_id", "fact_kind").agg(F.count("*").alias("n"))
    odd = conflicts(facts).groupBy("scenario_id", "fact_kind").agg(F.count("*").alias("odd"))
    out = requirements.join(per, ["scenario_id", "fact_kind"], "left").join(odd, ["scenario_id", "fact_kind"], "left")
    out = out.withColumn("none", F.lit(None).cast("boolean")) if confirmed_none is None else out.join(confirmed_none.select("scenario_id", "fact_kind").distinct().withColumn("none", F.lit(True)), ["scenario_id", "fact_kind"], "left")
    state = F.when(F.col("odd") > 0, "CONFLICT").when(F.col("n") > 0, "RESOLVED").when(F.col("none"), "CONFIRMED_NONE").when(F.col("sources_read"), "ABSENT_FROM_SOURCE").otherwise("UNRESOLVED")
    return out.select("scenario_id", "fact_kind", state.alias("state"), F.lit(None).cast("string").alias("reason"))


def windows(pages: DataFrame, cues: tuple[str, ...], most: int = 12, characters: int = 6000) -> DataFrame:
    """Evidence windows: the paragraphs of a document with most of cues, percentages, legal forms and transaction ids, with their neighbours, in order."""
    cue = re.compile("|".join(map(re.escape, cues)), re.IGNORECASE)
    form, txn, pct = re.compile(_FORM), re.compile(r"\b[A-Z]{3}-[A-Za-z0-9]+-[A-Za-z0-9-]+"), re.compile(r"\d\s*%")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, n, text in zip(batch.document_id, batch.page_number, batch.raw_text, strict=True):
                parts = [x for x in re.split(r"\n\s*\n", text or "") if x.strip()]
                rank = sorted((-(2 * len(cue.findall(x)) + len(pct.findall(x)) + 3 * len(form.findall(x)) + 2 * len(txn.findall(x))), i) for i, x in enumerate(parts) if cue.search(x))
                chosen = sorted({j for _, i in rank for j in (i - 1, i, i + 1) if 0 <= j < len(parts)}, key=lambda j: (min(abs(j - i) for _, i in rank), j))[:most]
                size = 0
                for j in sorted(chosen):
                    if size + len(parts[j]) <= characters:
                        size += len(parts[j])
                        out.append((str(d), int(n), j, parts[j]))
            yield pd.DataFrame(out, columns=["document_id", "page_number", "fragment", "text"])

    return pages.select("document_id", "page_number", "raw_text").mapInPandas(run, "document_id string, page_number int, fragment int, text string")
