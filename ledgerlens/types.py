"""Fixed vocabularies and record schemas. The names are fixed values of the data model."""

from __future__ import annotations

CATEGORIES = (
    "REVENUE", "CAPEX", "OPEX", "INTEREST_EXPENSE", "LEASE_PAYMENTS", "RELATED_PARTY_PAYMENTS", "LABOR", "UTILITIES", "TAXES", "INSURANCE_PREMIUMS", "RENT",
    "FINANCING_INFLOWS", "SEVERANCE_LIABILITY", "CAPITAL_ASSET_TRANSFER", "CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS", "GROUP_CAPEX", "ONE_TIME_ADD_BACKS",
    "MARKETING", "CONSULTING_SERVICES", "SCHEDULED_PRINCIPAL_REPAYMENT", "FINANCIAL_DEBT", "GUARANTEE_LIABILITY", "INDEMNITY_LIABILITY", "RESTRICTED_PAYMENTS",
    "ASSET_DISPOSALS", "OTHER_EXPENSE", "NON_OPERATING_INCOME",
)
INFLOWS = ("REVENUE", "FINANCING_INFLOWS", "NON_OPERATING_INCOME")
POSITIVE_MAGNITUDE = ("SEVERANCE_LIABILITY", "GROUP_CAPEX")
#: What a related-party payment may be a member of, besides its own category.
RELATED_PARTY_MEMBERS = ("OPEX", "OTHER_EXPENSE", "LABOR", "RENT", "LEASE_PAYMENTS", "INSURANCE_PREMIUMS", "UTILITIES", "TAXES", "INTEREST_EXPENSE", "CAPEX")

MONEY, RATIO, PERCENT, COUNT = "MONEY", "RATIO", "PERCENT", "COUNT"
LT, LTE, GT, GTE, EQ = "LT", "LTE", "GT", "GTE", "EQ"
#: There is no NE: what fails an EQ covenant is named EQ as well.
NEGATED = {LT: GTE, LTE: GT, GT: LTE, GTE: LT, EQ: EQ}
RESOLVED, UNRESOLVED, ERROR, NOT_ACTIVATED = "RESOLVED", "UNRESOLVED", "ERROR", "NOT_ACTIVATED"

AMOUNT = "decimal(38,6)"
LEDGER = "row_index long, txn_id string, date string, account_id string, counterparty string, description string, amount string, currency string"
CALC_INPUTS = (
    "input_id string, scenario_id string, source_kind string, transaction_id string, category string, selector_categories array<string>, amount decimal(38,6), "
    "source_amount decimal(38,6), currency string, period_semantics string, transaction_date date, period_start date, period_end date, as_of_date date, "
    "period_excluded boolean, related_party string, entity_scope string, subsidiary_status string, flags array<string>"
)
FACTS = (
    "fact_id string, scenario_id string, fact_kind string, transaction_id string, counterparty string, entity_name string, amount decimal(38,6), currency string, "
    "from_category string, to_category string, disposition string, percent decimal(9,4), status string, service_start date, service_end date, as_of_date date, "
    "period_label string, label string, source_document_id string"
)
