"""Classification of ledger descriptions and labels as columns: rule tables become one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide a category, in the order in which they are tried.
CREDIT = (
    r"\b(?:rebate|refund(?:ed)?|credited?|credit\s+received|overpayment\s+refunded|"
    r"deposit\s+returned|budget\s+returned|overbilling|experience\s+refund|"
    r"free\s+period\s+credit|true-up|"
    r"(?:rent|sublet|utility|insurance|tax|vat|telecom)\s+received)\b"
)
INTEREST_INCOME = r"\binterest\s+(?:income|credited|earned)\b|\b(?:treasury|deposit|current\s+account)\s+interest\b"
INTEREST_REVERSAL = r"\binterest\s+(?:rebate|recovery|true-up\s+credit|refund)\b"
REVENUE = (
    r"\b(?:customer\s+(?:revenue|payment|receipt|settlement|invoice)|"
    r"sales?\s+(?:revenue|proceeds|settlement|invoice|collection)|"
    r"service\s+revenue|product\s+revenue|contract\s+revenue|"
    r"invoice\s+collection|operating\s+revenue|\brevenue\b)\b"
)
STRONG = (
    ("SEVERANCE", "SEVERANCE_LIABILITY", r"\bseverance\b"),
    ("CAPITAL_TRANSFER_UNRESTRICTED", "CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS", r"(?:capital\s+asset\s+transfer|\btransfer(?:s|red)?\b|\btransfer\s+of\b).{0,80}\bunrestricted\s+subsidiar"),
    ("CAPITAL_TRANSFER_SUBSIDIARY", "CAPITAL_ASSET_TRANSFER", r"(?:(?:\btransfer(?:s|red)?\b|\btransfer\s+of\b).{0,80}(?:\bsubsidiar|\bgroup\s+entity\b|\bintra-group\b)|\bintra-group\s+transfer\b)"),
    ("GROUP_CAPEX", "GROUP_CAPEX", r"\bgroup\s+capex\b|\bconsolidated\s+capex\b"),
    ("ONE_TIME_ADD_BACK", "ONE_TIME_ADD_BACKS", r"\bone[-\s]?time\s+add[-\s]?back\b"),
    ("FINANCING_INFLOW", "FINANCING_INFLOWS", r"\bdrawdown\b|\bfinancing\s+inflow\b|\bequity\s+injection\b|\bcapital\s+contribution\b|\bloan\s+facility\s+draw|\bpromissory\s+note\s+proceeds\b"),
    (
        "CAPEX",
        "CAPEX",
        r"\bcapex\b|\bcapital\s+expenditure|\bequipment\s+purchase\b|\bpurchase\s+of\b.{0,60}\bequipment\b|\bfixed\s+asset\b|"
        r"\bcapitalis(?:ed|ed)\b|\bplant\s+machinery\b|\b(?:machinery|equipment|silo|conveyor)\s+upgrade\b|"
        r"\b(?:grain\s+silo|kiln\s+conveyor|rolling)\s+equipment\b|\b(?:grain\s+)?silo\b.{0,40}\bequipment\b|\baeration\s+equipment\b|"
        r"\b(?:refrigeration|concentrator|rolling)?\s*machinery\s+instalment\b|\bmachinery\s+instalment\b|\bnon-recurring\b.{0,40}\b(?:refurbishment|network)\b",
    ),
    ("INSURANCE", "INSURANCE_PREMIUMS", r"\binsurance\b|\bpremium\b"),
    (
        "INTEREST_EXPENSE",
        "INTEREST_EXPENSE",
        r"\binterest\s+on\b|\brevolver\s+interest\b|\binterest\s+(?:charge|payment|expense|coupon|true-up)\b|"
        r"\boverdraft\s+interest\b|\bcredit\s+facility\s+interest\b|\bterm\s+loan\s+interest\b|\bquarterly\s+interest\b",
    ),
    (
        "TAXES",
        "TAXES",
        r"\b(?:income|franchise|withholding|excise|profit|property|vehicle|municipal|emissions|environmental)\s+tax\b|"
        r"\bVAT\b|\bestimated\s+tax\b|\btax\s+(?:instalment|remittance|assessment|filing|audit|penalty|levy|payment)\b|\bcustoms\s+duty\b",
    ),
    ("LEASE", "LEASE_PAYMENTS", r"\blease\b|\bleasing\b|\bleased\s+line\b"),
    ("RENT", "RENT", r"\brent\b|\brental\b"),
    ("LABOR", "LABOR", r"\bpayroll\b|\bsalary\b|\bwages\b|\blabor\b|\bstaff\b.{0,30}\b(?:settlement|payroll|compensation)\b"),
    (
        "UTILITIES",
        "UTILITIES",
        r"\butilities\b|\butility\b|\belectricity\b|\bdistrict\s+heating\b|\bwater\s+(?:and\s+sewer\s+)?(?:supply|charge)s?\b|"
        r"\bsewer\s+(?:discharge|charge|levy|fee)s?\b|\bgas\s+supply\b|\bwaste\s+water\b|\btelecom\b",
    ),
    ("REVENUE", "REVENUE", REVENUE),
    ("OPEX_STATEMENT_LINE", "OPEX", r"\boperating\s+(?:and\s+maintenance\s+)?expenses?\b|\b(?:servicing\s+and\s+)?operating\s+costs?\b|\boperational\s+expenses?\b"),
    (
        "OPEX_DIRECT_OPERATIONS",
        "OPEX",
        r"\b(?:catalyst|equipment|plant|machinery|turbine|pump|kiln|refinery)\b.{0,60}\b(?:servicing|maintenance|repair|regeneration)\b|"
        r"\b(?:servicing|maintenance|repair|regeneration)\b.{0,60}\b(?:catalyst|equipment|plant|machinery|turbine|pump|kiln|refinery)\b",
    ),
    ("MARKETING", "OTHER_EXPENSE", r"\bmarketing\b|\bad\s+campaign\b|\badvertis(?:ing|ement)?\b|\bsponsorship\b|\bmedia\s+buy\b|\bbrand\s+relaunch\b"),
    ("CONSULTING", "OTHER_EXPENSE", r"\bconsulting\b|\badvisory\b(?:\s+fees?\b|\s+engagement\b|\s+retainer\b)?|\bprofessional\s+(?:fees?|services?)\b|\blegal\s+and\s+consulting\b"),
    ("SCHEDULED_PRINCIPAL", "OTHER_EXPENSE", r"\b(?:term\s+loan\s+)?principal\s+repayment\b|\bscheduled\s+principal\b|\bamortis(?:ation|ation)\s+of\s+principal\b"),
)
WEAK = (
    "OTHER_EXPENSE_WEAK",
    "OTHER_EXPENSE",
    r"\bretainer\b|\bservicing\b|\bsupplies\b|\bmaintenance\b|\brepair\b|\binspection\b|\bsurvey\b|\bmanagement\b|\bbroker\b|\bcleaning\b|\bclearance\b",
)
CREDIT_FAMILIES = (
    ("INSURANCE_CREDIT", "INSURANCE_PREMIUMS", r"\binsurance\b|\bpremium\b"),
    ("TAX_CREDIT", "TAXES", r"\btax\b|\bVAT\b|\bexcise\b|\bcustoms\b"),
    ("UTILITY_CREDIT", "UTILITIES", r"\butility\b|\belectricity\b|\bwater\b|\btelecom\b|\bheating\b"),
    ("RENT_CREDIT", "RENT", r"\brent\b|\brental\b|\bsublet\b"),
    ("LEASE_CREDIT", "LEASE_PAYMENTS", r"\blease\b|\bleasing\b"),
    ("LABOR_CREDIT", "LABOR", r"\bpayroll\b|\bsalary\b|\bwages\b|\blabor\b|\bstaff\b"),
    ("INTEREST_CREDIT", "INTEREST_EXPENSE", r"\binterest\b"),
    ("OTHER_EXPENSE_CREDIT", "OTHER_EXPENSE", r"\bmarketing\b|\bad\s+campaign\b|\badvertis|\badvisory\b|\bservicing\b|\bsupplies\b"),
)
CAPITALISED_INTEREST, LEASED_LINE = r"\bcapitalis(?:ed|ed)\s+interest\b", r"\bleased\s+line\b"
INCOME_TAX = r"\b(?:corporate\s+)?(?:income|profit)\s+tax\b|\badvance\s+(?:corporate\s+)?(?:income|profit)\s+tax\b|\bналог\s+на\s+прибыль\b"
OPERATING_TAX = (
    r"\b(?:payroll|social|property|land|vehicle|municipal|environmental|emissions|excise|customs|mineral\s+extraction|use|franchise|withholding|VAT)\s+tax\b|"
    r"\bcustoms\s+duty\b|\bVAT\b"
)
PROPERTY_RENT = (
    r"\b(?:land|warehouse|premises|office|yard|garage|store|property|ground)\b.{0,40}\b(?:lease|rent)\b|"
    r"\b(?:lease|rent)\b.{0,40}\b(?:land|warehouse|premises|office|yard|garage|store|property|ground)\b"
)
# Labels of documents and their categories; the first that contains or is contained wins.
LABELS = (
    ("revenue", "REVENUE"), ("выручка", "REVENUE"), ("capex", "CAPEX"), ("капитальн", "CAPEX"), ("opex", "OPEX"), ("operating expenses", "OPEX"), ("операционные расходы", "OPEX"),
    ("консультационные услуги", "OTHER_EXPENSE"), ("consulting", "OTHER_EXPENSE"), ("consulting expenses", "OTHER_EXPENSE"), ("consulting fees", "OTHER_EXPENSE"),
    ("маркетинг", "OTHER_EXPENSE"), ("маркетинговые расходы", "OTHER_EXPENSE"), ("marketing", "OTHER_EXPENSE"), ("marketing expenses", "OTHER_EXPENSE"), ("marketing expense", "OTHER_EXPENSE"),
    ("scheduled principal", "OTHER_EXPENSE"), ("principal repayment", "OTHER_EXPENSE"), ("interest expense", "INTEREST_EXPENSE"), ("interest_expense", "INTEREST_EXPENSE"),
    ("процентные расходы", "INTEREST_EXPENSE"), ("lease payments", "LEASE_PAYMENTS"), ("lease_payments", "LEASE_PAYMENTS"), ("related party payments", "RELATED_PARTY_PAYMENTS"),
    ("related_party_payments", "RELATED_PARTY_PAYMENTS"), ("labor", "LABOR"), ("utilities", "UTILITIES"), ("taxes", "TAXES"), ("insurance premiums", "INSURANCE_PREMIUMS"),
    ("insurance_premiums", "INSURANCE_PREMIUMS"), ("страховые премии", "INSURANCE_PREMIUMS"), ("rent", "RENT"), ("financing inflows", "FINANCING_INFLOWS"), ("financing_inflows", "FINANCING_INFLOWS"),
    ("severance liability", "SEVERANCE_LIABILITY"), ("severance_liability", "SEVERANCE_LIABILITY"), ("group capex", "GROUP_CAPEX"), ("group_capex", "GROUP_CAPEX"),
    ("one time add backs", "ONE_TIME_ADD_BACKS"), ("one_time_add_backs", "ONE_TIME_ADD_BACKS"), ("capital asset transfers to unrestricted subs", "CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS"),
)
FLAG_TOKENS = (
    ("MARKETING", ("marketing", "маркетинг", "advertis", "sponsorship", "media buy")),
    ("CONSULTING", ("consulting", "консульт", "advisory", "professional fee", "professional service")),
    ("SCHEDULED_PRINCIPAL", ("scheduled principal", "principal repayment", "основного долга")),
)


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: as a lambda's variable, which no rewrite can copy into every use."""
    return F.transform(F.array(value), body)[0]


def _hits(text: Column, rules: tuple) -> Column:
    """The rules that match, as an array of (rule, category) in table order."""
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category"))) for r, c, when in ((r, c, has(text, p) if isinstance(p, str) else p) for r, c, p in rules)]))


def _outcome(status: str, category: Column | None, rule: Column | None, competing: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(status).alias("status"),
        (none if category is None else category).alias("category"),
        (none if rule is None else rule).alias("rule"),
        (F.array().cast("array<string>") if competing is None else competing).alias("competing"),
    )


def classify(description: Column) -> Column:
    """struct(status, category, rule, competing) of a ledger description: CLASSIFIED, CONFLICT or UNRESOLVED.

    Reversed interest and interest income come first, then credits, which never are revenue; then
    all strong rules at once, where several categories are a conflict unless one of five
    pairs decides it; then the weak rule.
    """
    text = F.coalesce(description, F.lit(""))
    found = F.struct(
        has(text, CREDIT).alias("credit"),
        has(text, INTEREST_INCOME).alias("income"),
        has(text, INTEREST_REVERSAL).alias("reversal"),
        has(text, REVENUE).alias("revenue"),
        has(text, WEAK[2]).alias("weak"),
        has(text, CAPITALISED_INTEREST).alias("capitalised"),
        has(text, LEASED_LINE).alias("leased"),
        _hits(text, CREDIT_FAMILIES).alias("families"),
        _hits(text, STRONG).alias("strong"),
    )
    return let(found, _decide)


def _several(hits: Column, specific: Column | None) -> Column:
    """One rule, or several of one category, or those of the one specific category, else a conflict."""
    names = F.array_sort(hits["rule"])
    kinds = F.array_distinct(hits["category"])
    out = F.when(F.size(hits) == 1, _outcome("CLASSIFIED", hits[0]["category"], hits[0]["rule"]))
    out = out.when(F.size(kinds) == 1, _outcome("CLASSIFIED", kinds[0], F.array_join(names, "+")))
    if specific is not None:
        out = out.when(F.size(F.array_distinct(specific["category"])) == 1, _outcome("CLASSIFIED", specific[0]["category"], specific[0]["rule"]))
    return out.otherwise(_outcome("CONFLICT", None, None, names))


def _decide(f: Column) -> Column:
    families, credit, income = f["families"], f["credit"], f["income"]
    orphan = F.when(f["revenue"], F.lit("CREDIT_BLOCKS_REVENUE")).otherwise(F.lit("CREDIT_WITHOUT_EXPENSE_FAMILY"))
    credited = F.when(F.size(families) == 0, _outcome("UNRESOLVED", None, orphan)).otherwise(_several(families, F.filter(families, lambda h: h["category"] != "OTHER_EXPENSE")))
    # a credit is no revenue, and interest income no expense
    barred = lambda h: ((h["rule"] == "REVENUE") & (credit | income)) | ((h["rule"] == "INTEREST_EXPENSE") & income)
    strong = F.filter(f["strong"], lambda h: ~barred(h))
    rule = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), strong["rule"])) == 0
    decided = (
        F.when(rule("CAPEX", "INTEREST_EXPENSE") & f["capitalised"], _outcome("CLASSIFIED", F.lit("INTEREST_EXPENSE"), F.lit("INTEREST_CAPITALISED")))
        .when(rule("CAPITAL_TRANSFER_UNRESTRICTED"), _outcome("CLASSIFIED", F.lit("CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS"), F.lit("CAPITAL_TRANSFER_UNRESTRICTED")))
        .when(rule("CAPITAL_TRANSFER_SUBSIDIARY", "CAPEX"), _outcome("CLASSIFIED", F.lit("CAPITAL_ASSET_TRANSFER"), F.lit("CAPITAL_TRANSFER_SUBSIDIARY")))
        .when(rule("LEASE", "UTILITIES") & f["leased"], _outcome("CLASSIFIED", F.lit("UTILITIES"), F.lit("TELECOM_LEASED_LINE")))
        .when(rule("SEVERANCE", "LABOR"), _outcome("CLASSIFIED", F.lit("SEVERANCE_LIABILITY"), F.lit("SEVERANCE")))
        .otherwise(_several(strong, None))
    )
    weak = F.when(f["weak"], _outcome("CLASSIFIED", F.lit(WEAK[1]), F.lit(WEAK[0]))).otherwise(_outcome("UNRESOLVED", None, None))
    return (
        F.when(f["reversal"], _outcome("CLASSIFIED", F.lit("INTEREST_EXPENSE"), F.lit("INTEREST_EXPENSE_REVERSAL")))
        .when(income, _outcome("CLASSIFIED", F.lit("NON_OPERATING_INCOME"), F.lit("INTEREST_INCOME_NON_OPERATING")))
        .when(credit, credited)
        .when(F.size(strong) == 0, weak)
        .when(F.size(strong) == 1, _several(strong, None))
        .otherwise(decided)
    )


def memberships(category: Column, description: Column) -> Column:
    """The categories a row counts for: its own, RENT for leases of property, CAPEX for capital transfers."""
    return F.array_compact(
        F.array(
            category,
            F.when((category == "LEASE_PAYMENTS") & has(description, PROPERTY_RENT), F.lit("RENT")),
            F.when(category.isin("CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS", "CAPITAL_ASSET_TRANSFER"), F.lit("CAPEX")),
        )
    )


def operating_tax(description: Column) -> Column:
    return ~has(description, INCOME_TAX) & has(description, OPERATING_TAX)


def membership_reasons(category: Column, description: Column) -> Column:
    tax = (
        F.when(operating_tax(description), F.lit("OPERATING_TAX_IN_OPEX"))
        .when(has(description, INCOME_TAX), F.lit("INCOME_OR_PROFIT_TAX_EXCLUDED_FROM_OPEX"))
        .otherwise(F.lit("TAX_SUBTYPE_NOT_PROVEN_OPERATING"))
    )
    return F.array_compact(F.array(F.lit("PRIMARY_CATEGORY"), F.when(category == "TAXES", tax)))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def label_category(label: Column) -> Column:
    """The category that a document's label names: exactly, by alias, or by the first alias that contains it or is contained."""
    from ..types import CATEGORIES

    low = folded(label)
    exact = F.when(F.trim(label).isin(*CATEGORIES), F.trim(label))
    alias = F.coalesce(*[F.when(low == k, F.lit(c)) for k, c in LABELS])
    near = F.coalesce(*[F.when(F.contains(low, F.lit(k)) | F.contains(F.lit(k), low), F.lit(c)) for k, c in LABELS])
    return F.when(low != "", F.coalesce(exact, alias, near))


def label_flag(label: Column) -> Column:
    low = folded(label)
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(low, t)), F.lit(flag)) for flag, tokens in FLAG_TOKENS])


def rule_flag(rule: Column) -> Column:
    up = F.upper(rule)
    return (
        F.when(up.contains("MARKETING"), F.lit("MARKETING"))
        .when(up.contains("CONSULTING"), F.lit("CONSULTING"))
        .when(up.contains("SCHEDULED_PRINCIPAL") | (up == "PRINCIPAL_REPAYMENT"), F.lit("SCHEDULED_PRINCIPAL"))
    )
