"""Where things stand in texts: identifiers, markers and banners with their offsets, and the metadata of a document's first page.

An identifier is a maximal run of its characters, so a vocabulary of any size is joined by equality: a longer identifier
never matches inside a still longer one, and nothing has to build an alternation of all of them.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import banner

ACCOUNT = re.compile(r"[A-Za-z0-9-]+")
TRANSACTION = re.compile(r"[A-Za-z0-9_-]+")
SPANS = "array<struct<char_start:int,char_end:int,token:string>>"
# Accounts that are one without being in any ledger, near misses of them, and the words of a negation.
ACCOUNT_FAMILY = r"^ACC-[0-9]+(-[0-9]+)*$"
ACCOUNT_NEAR_MISS = r"^ACC-([A-Za-z][A-Za-z0-9-]*|[0-9]*[A-Za-z]+[0-9A-Za-z-]*)$"
NEGATION = re.compile(r"\bnot\b(?:\s+\w+){0,3}\s+|\bне\b(?:\s+\w+){0,3}\s+|does\s+not\s+|is\s+not\s+|не\s+является\s+", re.IGNORECASE)
NEGATION_REACH = 48
SUPERSEDED = ("НЕДЕЙСТВУЮЩАЯ РЕДАКЦИЯ", "НЕ ПРИМЕНЯЕТСЯ", "заменена окончательным", "заменена и изложена", "күші жойылған", "superseded", "obsolete", "no longer in force", "not in force")
FINALITY = ("FINAL", "окончательн", "DRAFT", "черновик", "ПРОЕКТ", "preliminary", "предварительн", "ИСПОЛНИТЕЛЬНЫЙ ЭКЗЕМПЛЯР", "CURRENT")
TITLES = ("договор", "agreement", "report", "отчёт", "отчет", "kyc", "пресс", "press", "меморандум", "memorandum", "руководство", "consolidated")
_DATE = re.compile(r"(?:от\s+|dated\s+|date\s*[:=]?\s*|as of\s+|effective\s+(?:date\s*)?[:=]?\s*)?(\d{1,2}\s+[A-Za-zА-Яа-яЁёҚқҒғҮүҰұҢңӘәІіӨөҺһ]+\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})", re.IGNORECASE)
_AGREEMENT = re.compile(r"(?:займ|заём|loan|facility|agreement|договор)[^\n]{0,40}?(?:№|no\.?|#)\s*([A-Z]{2,5}-?\d[\w-]*)", re.IGNORECASE)
_ACCOUNT_NUMBER = re.compile(r"(?<![A-Za-z0-9-])(ACC-\d+)(?![A-Za-z0-9-])")
_VERSION = re.compile(r"(?:редакция|revision|version|v)\s*(?:№\s*)?([vV]?\d[\w.-]*)", re.IGNORECASE)
_REPORT = re.compile(r"(?:аудиторское дело|audit\s*(?:file|engagement)|report)\s*№?\s*([A-Z]{0,5}-?\d[\w-]*)", re.IGNORECASE)
_PERIOD = re.compile(r"(?:financial year ended|год[,\s]+закончивш\w*|period ended)\s*([^\n]{5,60})", re.IGNORECASE)
_ROLES = {"effective_date": ("effective", "вступлен", "күшіне"), "execution_date": ("executed", "исполнительн", "подписан"), "report_date": ("report", "отчёт", "отчет")}
HEAD = 2500


def runs(text: Column, of: re.Pattern = ACCOUNT) -> Column:
    """Every maximal run of an identifier's characters, with its offsets."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"char_start": m.start(), "char_end": m.end(), "token": m[0]} for m in of.finditer(t or "")])

    return found(text)


def account_spans(pages: DataFrame, vocabulary: DataFrame, keys: list[str], text_col: str = "raw_text") -> DataFrame:
    """keys, char_start, char_end, token, account, status of every account that pages name: KNOWN if the vocabulary (account) has it, FAMILY
    if it only has the form of one, MALFORMED for near misses. A token counts once, whichever of the two recognises it."""
    each = pages.select(*keys, F.explode(runs(F.col(text_col), ACCOUNT)).alias("s")).select(*keys, "s.*").withColumn("account", F.upper("token"))
    known = vocabulary.select(F.upper(F.trim("account")).alias("account")).where("account <> ''").distinct().withColumn("known", F.lit(True))
    out = each.join(known, "account", "left")
    status = F.when(F.col("known"), "KNOWN").when(F.col("token").rlike(ACCOUNT_FAMILY), "FAMILY").when(F.col("token").rlike(ACCOUNT_NEAR_MISS), "MALFORMED")
    return out.withColumn("status", status).where("status is not null").select(*keys, "char_start", "char_end", "token", "account", "status")


def prefix_collisions(accounts: DataFrame) -> DataFrame:
    """(shorter, longer): accounts that go on, after a hyphen, where another one ends. Each account's own beginnings are
    joined with the accounts, so nothing is compared pairwise."""
    every = accounts.select("account").distinct()
    parts = F.split("account", "-")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    longer = every.where(F.size(parts) > 1).select(F.col("account").alias("longer"), F.explode(starts).alias("shorter"))
    return longer.join(every.select(F.col("account").alias("shorter")), "shorter").select("shorter", "longer")


def transaction_spans(pages: DataFrame, ledger_ids: DataFrame, keys: list[str], text_col: str = "raw_text") -> DataFrame:
    """keys, char_start, char_end, txn_id of every transaction of the ledger (txn_id) that pages name as a complete token.

    Spark takes the tokens of a text for as small as a few columns of its table, so the join is told not to broadcast them.
    """
    each = pages.select(*keys, F.explode(runs(F.col(text_col), TRANSACTION)).alias("s")).select(*keys, "s.char_start", "s.char_end", F.col("s.token").alias("txn_id"))
    return each.hint("merge").join(ledger_ids.select("txn_id").distinct(), "txn_id").select(*keys, "char_start", "char_end", "txn_id")


def mentions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, txn_id, place (1 for the first named), mentions: distinct transactions in the order of the text, and how often each is named."""
    per = spans.groupBy(*keys, "txn_id").agg(F.min("char_start").alias("first_at"), F.count("*").alias("mentions"))
    order = F.array_sort(F.collect_list(F.struct("first_at", "txn_id", "mentions")))
    return per.groupBy(*keys).agg(order.alias("o")).select(*keys, F.posexplode("o").alias("n", "x")).select(*keys, "x.txn_id", (F.col("n") + 1).alias("place"), "x.mentions")


def followed_by(spans: DataFrame, pages: DataFrame, keys: list[str], pattern: str, reach: int = 200, text_col: str = "raw_text") -> DataFrame:
    """The spans after which, on the same line and within `reach` characters, pattern occurs."""
    # texts made from a key are larger than Spark takes them for: neither side is broadcast
    at = spans.join(pages.select(*keys, F.col(text_col).alias("_text")).hint("merge"), keys)
    rest = F.split(F.substr(F.col("_text"), F.col("char_end") + 1, F.lit(reach)), "\n")[0]
    return at.where(rest.rlike(pattern)).drop("_text")


def negated(text: str, start: int, end: int) -> bool:
    return NEGATION.search(text[max(0, start - NEGATION_REACH) : end + NEGATION_REACH]) is not None


#: What makes an occurrence of a marker count.
ACCEPT = {"any": lambda text, start, end: True, "banner": banner, "not negated": lambda text, start, end: not negated(text, start, end)}


def first_in(text: str, markers: tuple[str, ...], accept: str) -> tuple[int, int, int] | None:
    """(marker's number, start, end) of the first marker that occurs so that it counts, at its first such place. Letter case doesn't matter."""
    for k, marker in enumerate(markers):
        for m in re.finditer(re.escape(marker), text, re.IGNORECASE):
            if ACCEPT[accept](text, m.start(), m.end()):
                return k, m.start(), m.end()
    return None


def first_marker(pages: DataFrame, markers: tuple[str, ...], accept: str = "any") -> DataFrame:
    """document_id, marker, page_number, char_start, char_end, quote: per document the first marker of the list that some page has, on its first page."""

    @F.pandas_udf("struct<marker:int,char_start:int,char_end:int,quote:string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hit = first_in(t or "", markers, accept)
            rows.append((*hit, t[hit[1] : hit[2]]) if hit else (None, None, None, None))
        return pd.DataFrame(rows, columns=["marker", "char_start", "char_end", "quote"])

    hits = pages.select("document_id", "page_number", found(F.col("raw_text")).alias("h")).where("h.marker is not null")
    best = hits.groupBy("document_id").agg(F.min(F.struct("h.marker", "page_number", "h.char_start", "h.char_end", "h.quote")).alias("b"))
    return best.select("document_id", F.element_at(F.array(*map(F.lit, markers)), F.col("b.marker") + 1).alias("marker"), "b.page_number", "b.char_start", "b.char_end", "b.quote")


def _day(raw: str) -> str | None:
    text = " ".join(raw.split())
    for pattern, order in ((r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)), (r"(\d{1,2})[./](\d{1,2})[./](\d{4})", (3, 2, 1))):
        if m := re.fullmatch(pattern, text):
            day = pd.to_datetime("-".join(m[i] for i in order), format="%Y-%m-%d", errors="coerce")
            return None if pd.isna(day) else day.strftime("%Y-%m-%d")
    return text if len(text) >= 8 else None  # months in words stay as they are written


def described(head: str) -> dict[str, str | None]:
    """What the beginning of a document's first page says of it."""
    head = head[:HEAD]
    out: dict[str, str | None] = dict.fromkeys(("title", "agreement_number", "version", "report_number", "period", "document_date", *_ROLES))
    lines = [x.strip() for x in head.splitlines() if x.strip()]
    if lines:
        out["title"] = next((x for x in lines[:8] if any(w in x.casefold() for w in TITLES)), lines[0])[:240]
    if m := _AGREEMENT.search(head) or _ACCOUNT_NUMBER.search(head):
        out["agreement_number"] = m[1]
    for name, pattern, most in (("version", _VERSION, 80), ("report_number", _REPORT, 100), ("period", _PERIOD, 120)):
        if m := pattern.search(head):
            out[name] = m[0].strip()[:most]
    for m in _DATE.finditer(head):
        if (day := _day(m[1])) is not None:
            out["document_date"] = out["document_date"] or day
            near = head[max(0, m.start() - 40) : m.end() + 20].casefold()
            out.update({role: day for role, words in _ROLES.items() if any(w in near for w in words)})
    return out


def metadata(pages: DataFrame) -> DataFrame:
    """Per document: title, numbers, version, period and four dates from its first page, and the markers of status on any page.
    Dates with months in words stay text; of several dates with a role the last one has it."""
    names = list(described(""))

    @F.pandas_udf("struct<" + ",".join(f"{n}:string" for n in names) + ">")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([described(t or "") for t in texts], columns=names)

    first = pages.groupBy("document_id").agg(F.min_by("raw_text", "page_number").alias("head")).select("document_id", told(F.col("head")).alias("m")).select("document_id", "m.*")
    finality = first_marker(pages, FINALITY).select("document_id", F.col("quote").alias("finality_marker"))
    gone = first_marker(pages, SUPERSEDED, "banner").select("document_id", F.col("quote").alias("superseded_marker"))
    return first.join(finality, "document_id", "left").join(gone, "document_id", "left")


def date_key(effective: Column, execution: Column, document: Column, report: Column) -> Column:
    """The date by which documents of one authority and lifecycle are ordered: effective, else execution, document, report."""
    return F.coalesce(effective, execution, document, report, F.lit(""))


# Borrowers


def borrower_declarations(pages: DataFrame, accounts: DataFrame, pattern: str, reach: int = 240) -> DataFrame:
    """document_id, page_number, entity_name, account: names that pattern (group name) declares and the nearest account token within
    `reach` characters; of equally near ones the first. accounts: account_spans() of the pages."""
    compiled = re.compile(pattern)

    @F.pandas_udf(SPANS)
    def declared(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"char_start": m.start("name"), "char_end": m.end("name"), "token": m["name"]} for m in compiled.finditer(t or "")])

    names = pages.select("document_id", "page_number", F.explode(declared(F.col("raw_text"))).alias("s")).select("document_id", "page_number", F.col("s.token").alias("entity_name"), F.col("s.char_start").alias("a"), F.col("s.char_end").alias("b"))
    near = names.join(accounts.select("document_id", "page_number", "account", "char_start", "char_end"), ["document_id", "page_number"], "left")
    gap = F.when(F.col("char_start") >= F.col("b"), F.col("char_start") - F.col("b")).otherwise(F.greatest(F.col("a") - F.col("char_end"), F.lit(0)))
    best = near.withColumn("gap", gap).groupBy("document_id", "page_number", "entity_name").agg(F.min(F.when(F.col("gap") <= reach, F.struct("gap", "char_start", "account"))).alias("best"))
    return best.select("document_id", "page_number", "entity_name", F.col("best.account").alias("account"))


def anchored_borrowers(declarations: DataFrame, account_owners: DataFrame) -> DataFrame:
    """scenario_id, account, identities, status: the borrowers declared with a scenario's account; several identities of one account are a
    CONFLICT. account_owners: (account, scenario_id)."""
    from ..functions.names import identity_key

    named = declarations.where("account is not null").select("account", identity_key(F.col("entity_name")).alias("identity"))
    per = named.join(account_owners, "account").groupBy("scenario_id", "account").agg(F.sort_array(F.collect_set("identity")).alias("identities"))
    return per.select("scenario_id", "account", "identities", F.when(F.size("identities") > 1, "CONFLICT").otherwise("RESOLVED").alias("status"))
