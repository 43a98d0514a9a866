"""Document analytics over pages: quality, OCR plans, types, lifecycle, authority, chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALNUM, CONTROL = r"[\p{L}\p{N}]", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BLOCKING = ("OCR_REQUIRED", "OCR_FAILED", "IMAGE_DOMINANT", "UNREADABLE", "HEADING_WITHOUT_BODY")


def heading_only(text: Column) -> Column:
    """One to three lines, under 80 characters together, one of them short or numbered like a heading."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    chars = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    return (F.size(lines) >= 1) & (F.size(lines) <= 3) & (chars < 80) & F.exists(lines, lambda x: F.length(x) <= 40)


def page_signals(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, raw_text[, image_count, image_visibility]) with counts and ratios of the trimmed text."""
    out = pages
    for name, default in (("image_count", F.lit(0)), ("image_visibility", F.lit("KNOWN"))):
        if name not in pages.columns:
            out = out.withColumn(name, default)
    text = F.trim(F.coalesce("raw_text", F.lit("")))
    n = F.length(text)
    share = lambda k: F.when(n > 0, k / n).otherwise(0.0)
    return out.select(
        "document_id", "page_number", "image_count", "image_visibility", n.alias("char_count"),
        share(F.regexp_count(text, F.lit(ALNUM))).alias("alnum_ratio"), share(F.regexp_count(text, F.lit("�"))).alias("replacement_ratio"),
        heading_only(text).alias("heading_without_body"),
    )


def page_state() -> Column:
    """The quality state of a page from its signals."""
    n, alnum = F.col("char_count"), F.col("alnum_ratio")
    images = (F.col("image_visibility") == "KNOWN") & (F.col("image_count") >= 1)
    unknown = F.col("image_visibility") == "UNKNOWN"
    heading = F.col("heading_without_body")
    return (
        F.when(images & (n == 0), "OCR_REQUIRED")
        .when(heading & (n < 120), "OCR_REQUIRED")
        .when(images & (n < 40), "IMAGE_DOMINANT")
        .when(unknown & ((n == 0) | ((n < 25) & (alnum < 0.15))), "OCR_REQUIRED")
        .when(n == 0, "UNREADABLE")
        .when(heading, "HEADING_WITHOUT_BODY")
        .when((n < 25) | (alnum < 0.15), "LOW_TEXT")
        .when(F.col("replacement_ratio") > 0.2, "UNREADABLE")
        .otherwise("TEXT_OK")
    )


def parse_metrics(pages: DataFrame) -> DataFrame:
    """Per document: pages, empty ones, characters, character ratios, control characters, share of repeated lines."""
    text = F.coalesce("raw_text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    counted = pages.select(
        "document_id", (F.trim(text) == "").cast("int").alias("empty"), F.length(text).alias("chars"), F.regexp_count(text, F.lit(ALNUM)).alias("alnum"),
        F.regexp_count(text, F.lit("�")).alias("bad"), F.regexp_count(text, F.lit(CONTROL)).alias("control"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"),
    )
    s = lambda c: F.sum(c)
    ratio = lambda a, b: F.when(s(b) > 0, s(a) / s(b)).otherwise(0.0)
    return counted.groupBy("document_id").agg(
        F.count("*").alias("page_count"), s("empty").alias("empty_pages"), (s("empty") / F.count("*")).alias("empty_page_ratio"), s("chars").alias("total_chars"),
        ratio("alnum", "chars").alias("alnum_ratio"), ratio("bad", "chars").alias("replacement_ratio"), s("control").alias("control_chars"),
        F.when(s("lines") > 0, 1 - s("distinct_lines") / s("lines")).otherwise(0.0).alias("duplicate_line_ratio"),
    )


#: Limits of the document gate.
LIMITS = {"min_chars": 40, "empty": 0.5, "replacement": 0.02, "alnum": 0.3, "control": 50, "repeated": 0.6}


def quality_gate(metrics: DataFrame, full: bool = True, limits: dict = LIMITS) -> DataFrame:
    """decision (ACCEPT, FALLBACK_REQUIRED, HUMAN_REVIEW_REQUIRED, REJECT) and the rules that a document breaks."""
    c = F.col
    rules = F.array_compact(
        F.array(
            F.when(c("total_chars") < limits["min_chars"], F.lit("min_total_characters")),
            F.when(c("empty_page_ratio") > limits["empty"], F.lit("max_empty_page_ratio")),
            F.when(c("replacement_ratio") > limits["replacement"], F.lit("max_replacement_character_ratio")),
            F.when((c("total_chars") > 0) & (c("alnum_ratio") < limits["alnum"]), F.lit("min_alphanumeric_character_ratio")),
            F.when(c("control_chars") > limits["control"], F.lit("max_control_character_count")),
            F.when(c("duplicate_line_ratio") > limits["repeated"], F.lit("max_duplicate_line_ratio")),
        )
    )
    bad = c("replacement_ratio") > (0.5 if full else 2 * limits["replacement"])
    decision = F.when(F.size("rules") == 0, "ACCEPT").when(bad, "REJECT").otherwise("FALLBACK_REQUIRED" if full else "HUMAN_REVIEW_REQUIRED")
    return metrics.withColumn("rules", rules).select("document_id", decision.alias("decision"), F.array_join("rules", ",").alias("rules"))


def trust_gate(states: DataFrame) -> DataFrame:
    """states (document_id, state) -> FAILED without a usable page, PARTIAL with blocking pages as well, else SUCCESS."""
    blocked = F.col("state").isin(*BLOCKING)
    per = states.groupBy("document_id").agg(F.count_if(~blocked).alias("usable"), F.count_if(blocked).alias("blocking"))
    return per.select("document_id", F.when(F.col("usable") == 0, "FAILED").when(F.col("blocking") > 0, "PARTIAL").otherwise("SUCCESS").alias("status"), "usable", "blocking")


def ocr_plan(states: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages distinct blocking pages in order; the limit is what the plan is."""
    return states.where(F.col("state").isin(*BLOCKING)).select("document_id", "page_number").distinct().orderBy("document_id", "page_number").limit(max_pages)


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages with the text of (document_id, page_number, ocr_text, ok) where it succeeded."""
    out = pages.join(ocr, ["document_id", "page_number"], "left")
    good = F.coalesce(F.col("ok"), F.lit(False)) & (F.trim("ocr_text") != "")
    return out.withColumns({"raw_text": F.when(good, F.col("ocr_text")).otherwise(F.col("raw_text")), "ocr_state": F.when(good, "OCR_SUCCEEDED").when(F.col("ok").isNotNull(), "OCR_FAILED")}).drop("ocr_text", "ok")


# Words at the head of a document that name its type; the first match wins.
TYPES = (
    ("LOAN_AGREEMENT", r"\b(loan|credit|facility) agreement\b|кредитный договор|договор займа"),
    ("AGREED_UPON_PROCEDURES_REPORT", r"\bagreed[- ]upon procedures\b|согласованны\w+ процедур"),
    ("AUDITOR_REPORT", r"\bauditor'?s?'? report\b|аудиторск\w+ (отчет|отчёт|заключени\w+)"),
    ("KYC_POLICY_OR_PROCEDURE", r"\bkyc (policy|procedure)\b"),
    ("KYC_DOSSIER", r"\b(kyc|know your customer)\b|досье клиента"),
    ("GROUP_OR_CONSOLIDATED_REPORT", r"\b(consolidated|group) (financial )?(report|statements)\b|консолидированн"),
    ("TREASURY_MEMO", r"\btreasury (memo|memorandum|note)\b|казначейств"),
    ("PRESS_RELEASE", r"\bpress release\b|пресс-релиз"),
    ("HR_OR_ADMIN_DOCUMENT", r"\b(human resources|hr policy|payroll policy)\b|отдел кадров"),
    ("IT_OR_OPERATIONS_DOCUMENT", r"\b(it policy|server|incident report|runbook)\b"),
    ("BOARD_OR_INTERNAL_MEMO", r"\b(board|internal) (memo|memorandum|minutes)\b|служебная записка"),
    ("CORPORATE_REPORT", r"\bannual report\b|годовой отчет"),
)
LIFECYCLES = (
    ("SUPERSEDED", r"\b(SUPERSEDED|OBSOLETE)\b|УТРАТИЛ\w* СИЛУ"),
    ("WORKING_PAPER", r"(?i)\bworking (document|paper)\b|рабочий документ"),
    ("DRAFT", r"\b(DRAFT|Draft)\b|ПРОЕКТ|ЧЕРНОВИК"),
    ("CURRENT_EXECUTED", r"(?i)\b(executed|execution|conformed|signed) copy\b|ДЕЙСТВУЮЩАЯ РЕДАКЦИЯ|ИСПОЛНИТЕЛЬНЫЙ ЭКЗЕМПЛЯР"),
    ("FINAL", r"\bFINAL\b|ИТОГОВ"),
    ("EFFECTIVE", r"(?i)\beffective date\b"),
)
RANKS = {"CURRENT_EXECUTED": 100, "FINAL": 90, "APPROVED": 85, "EFFECTIVE": 80, "CURRENT": 75, "UNKNOWN": 20, "DRAFT": 10, "PRELIMINARY": 8, "WORKING_PAPER": 5, "SUPERSEDED": 0, "OBSOLETE": 0, "EXPIRED": 0}
DOMAINS = {
    "LOAN_AGREEMENT": "COVENANT_TERMS", "AUDITOR_REPORT": "FINANCIAL_ADJUSTMENTS", "AGREED_UPON_PROCEDURES_REPORT": "FINANCIAL_ADJUSTMENTS", "KYC_DOSSIER": "KYC_RELATIONSHIPS",
    "GROUP_OR_CONSOLIDATED_REPORT": "GROUP_STRUCTURE", "TREASURY_MEMO": "TREASURY_FACTS", "BOARD_OR_INTERNAL_MEMO": "GENERAL_CONTEXT", "CORPORATE_REPORT": "GENERAL_CONTEXT", "OTHER_BUSINESS_DOCUMENT": "GENERAL_CONTEXT",
}


def document_type(head: Column) -> Column:
    return F.coalesce(*[F.when(head.rlike(f"(?iu){p}"), F.lit(name)) for name, p in TYPES], F.lit("UNKNOWN"))


def lifecycle(head: Column) -> Column:
    return F.coalesce(*[F.when(head.rlike(p), F.lit(name)) for name, p in LIFECYCLES], F.lit("UNKNOWN"))


def lifecycle_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in RANKS.items()], F.lit(0))


def domain(doc_type: Column, status: Column) -> Column:
    """The authority domain of a type in a lifecycle; retired documents keep three domains, as candidates to be rejected."""
    by_type = F.coalesce(*[F.when(doc_type == k, F.lit(v)) for k, v in DOMAINS.items()], F.lit("NONE"))
    retired = status.isin("SUPERSEDED", "OBSOLETE", "EXPIRED", "DRAFT", "PRELIMINARY", "WORKING_PAPER")
    memo = (doc_type == "TREASURY_MEMO") & status.isin("WORKING_PAPER", "UNKNOWN")
    kept = doc_type.isin("LOAN_AGREEMENT", "AUDITOR_REPORT", "AGREED_UPON_PROCEDURES_REPORT", "KYC_DOSSIER")
    return F.when(memo, "TREASURY_FACTS").when(retired & ~kept, "NONE").otherwise(by_type)


def families(docs: DataFrame) -> DataFrame:
    """(family, documents): loans by scenario and agreement number, five other types by scenario and type."""
    loan = F.col("doc_type") == "LOAN_AGREEMENT"
    other = F.col("doc_type").isin("AUDITOR_REPORT", "AGREED_UPON_PROCEDURES_REPORT", "KYC_DOSSIER", "GROUP_OR_CONSOLIDATED_REPORT", "TREASURY_MEMO")
    key = F.when(loan, F.concat_ws("|", "scenario_id", F.lit("LOAN"), F.coalesce("agreement_number", F.lit("UNNUMBERED")))).when(other, F.concat_ws("|", "scenario_id", "doc_type"))
    return docs.withColumn("family", key).where("family is not null").groupBy("family").agg(F.count("*").alias("documents"), F.min("document_id").alias("first"))


def winners(docs: DataFrame) -> DataFrame:
    """docs (document_id, scenario_id, domain, lifecycle, date_key) -> per scenario and domain the one of highest lifecycle
    and latest date; equals are a CONFLICT, and a rank of 0 never wins.

    Two aggregates instead of a window: the best key, then who has it; a crowded domain combines before the shuffle."""
    ranked = docs.where("domain <> 'NONE'").withColumn("key", F.struct(lifecycle_rank(F.col("lifecycle")).alias("rank"), F.coalesce("date_key", F.lit("")).alias("at")))
    best = ranked.groupBy("scenario_id", "domain").agg(F.max("key").alias("best"))
    held = ranked.join(best, ["scenario_id", "domain"]).where(F.col("key") == F.col("best"))
    per = held.groupBy("scenario_id", "domain").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"), F.max("best.rank").alias("rank"))
    return per.select("scenario_id", "domain", F.when(F.col("rank") <= 0, "UNRESOLVED").when(F.col("n") > 1, "CONFLICT").otherwise("RESOLVED").alias("status"), F.when((F.col("n") == 1) & (F.col("rank") > 0), F.col("document_id")).alias("document_id"), "n")


def resolve_documents(candidates: DataFrame) -> DataFrame:
    """candidates (document_id, level, scenario_id) -> the scenarios of the best level of each document: 1 account,
    2 declaration, 3 relation, 4 name. Several at that level are a conflict, and stay linked."""
    best = candidates.groupBy("document_id").agg(F.min("level").alias("level"))
    per = candidates.join(best, ["document_id", "level"]).groupBy("document_id", "level").agg(F.sort_array(F.collect_set("scenario_id")).alias("scenario_ids"))
    return per.select("document_id", "level", F.array_join("scenario_ids", ",").alias("scenario_ids"), F.when(F.size("scenario_ids") > 1, "CONFLICT").otherwise("RESOLVED").alias("status"))


def banner(text: str, start: int, end: int) -> bool:
    """Whether the marker at [start, end) is a status stamp: not all in lower case, at a line's start or after the end of a sentence."""
    found, before = text[start:end], text[text.rfind("\n", 0, start) + 1 : start].rstrip()
    return bool(found.strip()) and found != found.lower() and (not before or before[-1] in '.;!?·|)]»"')


#: Places after which a text may be cut, from the best kind to the worst, and the least characters a cut leaves before it.
CUTS = ((re.compile(r"(?<=\n\n)"), 3), (re.compile(r"(?<=\n)"), 2), (re.compile(r"(?<=[.!?;…])(?=\s)"), 2), (re.compile(r"(?<=\s)"), 2))
STOPS = frozenset(".!?;…")


class Cuts:
    """All places where a text may be cut, sorted by kind, so that each cut is a binary search."""

    def __init__(self, text: str):
        self.text = text
        self.kinds = [([m.start() for m in pattern.finditer(text)], least) for pattern, least in CUTS]

    def before(self, start: int, limit: int) -> int:
        """The last place of the best kind that has one in (start, limit], else limit. A stop right before limit ends a sentence whatever follows."""
        for rank, (places, least) in enumerate(self.kinds):
            if rank == 2 and limit - start >= least and self.text[limit - 1] in STOPS:
                return limit
            at = bisect_right(places, limit) - 1
            if at >= 0 and places[at] >= start + least:
                return places[at]
        return limit


def split_ranges(text: str, most: int = 4000, overlap: int = 120) -> Iterator[tuple[int, int]]:
    """Half-open ranges of at most `most` characters that cover text, each but the first beginning `overlap` characters before the last one's end."""
    cuts, start, size = Cuts(text), 0, len(text)
    while size - start > most:
        end = cuts.before(start, start + most)
        yield start, end
        start = min(max(end - overlap, start + 1), end)
    if size > start:
        yield start, size


def chunks(docs: DataFrame, most: int = 4000, overlap: int = 120, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """document_id, ordinal, char_start, char_end, text, tokens (a quarter of the characters) of all chunks of whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, i, a, b, t[a:b], -(-(b - a) // 4)) for d, t in zip(batch.d, batch.t, strict=True) for i, (a, b) in enumerate(split_ranges(t or "", most, overlap))]
            yield pd.DataFrame(out, columns=["document_id", "ordinal", "char_start", "char_end", "text", "tokens"])

    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInPandas(run, f"document_id {dict(docs.dtypes)[id_col]}, ordinal int, char_start int, char_end int, text string, tokens int")


def chunk_manifest(chunked: DataFrame) -> DataFrame:
    """chunks, characters, and a digest over the chunks' digests in order per document, then over documents."""
    part = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), "ordinal", "char_start", "char_end"), 256)
    per = chunked.withColumn("h", part).groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))
    low = F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")
    return per.agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.sum("chars").alias("chars"), F.sum(low).cast("string").alias("digest_sum"))


def evidence_overlap(chunked: DataFrame, spans: DataFrame) -> DataFrame:
    """(document_id, ordinal, span_id) where half-open ranges overlap. Joined on the document and, within it, the
    range condition: both sides hash on the document, so a long document meets its own spans only."""
    a, b = chunked.alias("a"), spans.alias("b")
    on = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.char_start") < F.col("b.char_end")) & (F.col("b.char_start") < F.col("a.char_end"))
    return a.join(b, on).select("a.document_id", "a.ordinal", "b.span_id")
