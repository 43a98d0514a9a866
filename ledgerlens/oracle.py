"""SQL for the registered queries, written for DuckDB over the same tables.

Joins, aggregates and folds are written anew. Tables of wording (classification patterns, labels, document types, stop words, made-up
descriptions) are the operators' own, so a wrong pattern would be wrong on both sides; tests hold literal cases against those.
"""

from __future__ import annotations

from .functions import text as rules
from .operators import documents as docs
from .operators import retrieval
from .sources.tables import DESCRIPTIONS, FAMILIES
from .types import CATEGORIES, RELATED_PARTY_MEMBERS


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + pattern)})"


LEDGER = f"""
ledger AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS row_index,
         CASE WHEN l_orderkey % 97 = 0 THEN 'REV-' WHEN l_orderkey % 193 = 0 THEN 'txn-' ELSE 'TXN-' END || 'N' || c_nationkey || '-' || l_orderkey || '-' || l_linenumber AS txn_id,
         CASE WHEN l_orderkey % 227 = 0 AND c_nationkey % 4 = 1 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
         ' acc-' || o_custkey || ' ' AS account_id,
         'Supplier ' || l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN ' LLP' ELSE ' JSC' END AS counterparty,
         list_extract([{', '.join(q(x) for _, x in DESCRIPTIONS)}], (l_partkey % {len(DESCRIPTIONS)} + 1)::INT) AS description,
         CASE WHEN l_orderkey % 211 = 0 THEN '' WHEN l_orderkey % 223 = 0 THEN 'n/a'
              ELSE (l_extendedprice::DECIMAL(18,2) * list_extract([{', '.join(str(s) for s, _ in DESCRIPTIONS)}], (l_partkey % {len(DESCRIPTIONS)} + 1)::INT)::INT)::DECIMAL(18,2)::VARCHAR END AS amount,
         CASE WHEN c_nationkey % 7 = 3 AND l_partkey % 48 = 1 THEN 'EUR' ELSE 'USD' END AS currency
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

SCENARIOS = "universe AS (SELECT 'N' || n_nationkey AS scenario_id FROM nation WHERE n_nationkey % 8 <> 7)"

LINKS = f"""{LEDGER},
{SCENARIOS},
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trim(txn_id) ORDER BY row_index, counterparty, amount) AS rn FROM ledger) WHERE rn = 1),
named AS (SELECT f.*, upper(trim(account_id)) AS account, u.scenario_id AS token
          FROM firsts f LEFT JOIN universe u ON u.scenario_id = regexp_extract(trim(txn_id), '^TXN-([^-]+)(-[^-]+)+$', 1)),
anchors AS (SELECT account, list_sort(list(DISTINCT token)) AS claims FROM named WHERE token IS NOT NULL GROUP BY account),
links AS (SELECT n.*, CASE WHEN token IS NOT NULL AND len(claims) = 1 THEN 'TXN_ID_PREFIX' WHEN token IS NOT NULL THEN 'TXN_ID_ACCOUNT_CONFLICT'
                           WHEN len(claims) = 1 THEN 'ACCOUNT_ID_FALLBACK' ELSE 'UNRESOLVED' END AS method,
                 CASE WHEN len(claims) = 1 THEN claims[1] END AS scenario_id
          FROM named n LEFT JOIN anchors a USING (account))"""


def _hits(table, guards=None) -> str:
    guards = guards or {}
    return "list_filter([" + ", ".join(f"CASE WHEN {has('x', p)}{guards.get(r, '')} THEN {{'rule': {q(r)}, 'category': {q(k)}}} END" for r, k, p in table) + "], lambda h: h IS NOT NULL)"


def _classes() -> str:
    """d(description, status, category, rule, competing) for all descriptions."""
    both = f" AND NOT {has('x', rules.CREDIT)} AND NOT {has('x', rules.INTEREST_INCOME)}"
    guards = {"REVENUE": both, "INTEREST_EXPENSE": f" AND NOT {has('x', rules.INTEREST_INCOME)}"}
    row = lambda s, k, r, o="''": f"{{'status': {q(s)}, 'category': {k}, 'rule': {r}, 'competing': {o}}}"
    names = lambda h: f"list_sort(list_transform({h}, lambda e: e.rule))"
    kinds = lambda h: f"list_distinct(list_transform({h}, lambda e: e.category))"
    tests = lambda *n: " AND ".join(f"list_contains(list_transform(s, lambda e: e.rule), {q(x)})" for x in n)

    def several(h: str, specific: str | None) -> str:
        out = f"CASE WHEN len({h}) = 1 THEN {row('CLASSIFIED', f'{h}[1].category', f'{h}[1].rule')} WHEN len({kinds(h)}) = 1 THEN {row('CLASSIFIED', f'{h}[1].category', f"array_to_string({names(h)}, '+')")} "
        if specific:
            out += f"WHEN len({kinds(specific)}) = 1 THEN {row('CLASSIFIED', f'({specific})[1].category', f'({specific})[1].rule')} "
        return out + f"ELSE {row('CONFLICT', 'NULL', 'NULL', f"array_to_string({names(h)}, ',')")} END"

    narrow = "list_filter(f, lambda e: e.category <> 'OTHER_EXPENSE')"
    return f"""
dd AS (SELECT DISTINCT description AS x FROM ledger),
hh AS (SELECT x, {_hits(rules.CREDIT_FAMILIES)} AS f, {_hits(rules.STRONG, guards)} AS s FROM dd),
kk AS (SELECT x AS description, CASE
  WHEN {has('x', rules.INTEREST_REVERSAL)} THEN {row('CLASSIFIED', "'INTEREST_EXPENSE'", "'INTEREST_EXPENSE_REVERSAL'")}
  WHEN {has('x', rules.INTEREST_INCOME)} THEN {row('CLASSIFIED', "'NON_OPERATING_INCOME'", "'INTEREST_INCOME_NON_OPERATING'")}
  WHEN {has('x', rules.CREDIT)} AND len(f) = 0 THEN {row('UNRESOLVED', 'NULL', f"CASE WHEN {has('x', rules.REVENUE)} THEN 'CREDIT_BLOCKS_REVENUE' ELSE 'CREDIT_WITHOUT_EXPENSE_FAMILY' END")}
  WHEN {has('x', rules.CREDIT)} THEN {several('f', narrow)}
  WHEN len(s) = 0 AND {has('x', rules.WEAK[2])} THEN {row('CLASSIFIED', q(rules.WEAK[1]), q(rules.WEAK[0]))}
  WHEN len(s) = 0 THEN {row('UNRESOLVED', 'NULL', 'NULL')}
  WHEN {tests('CAPEX', 'INTEREST_EXPENSE')} AND {has('x', rules.CAPITALISED_INTEREST)} THEN {row('CLASSIFIED', "'INTEREST_EXPENSE'", "'INTEREST_CAPITALISED'")}
  WHEN len(s) > 1 AND {tests('CAPITAL_TRANSFER_UNRESTRICTED')} THEN {row('CLASSIFIED', "'CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS'", "'CAPITAL_TRANSFER_UNRESTRICTED'")}
  WHEN {tests('CAPITAL_TRANSFER_SUBSIDIARY', 'CAPEX')} THEN {row('CLASSIFIED', "'CAPITAL_ASSET_TRANSFER'", "'CAPITAL_TRANSFER_SUBSIDIARY'")}
  WHEN {tests('LEASE', 'UTILITIES')} AND {has('x', rules.LEASED_LINE)} THEN {row('CLASSIFIED', "'UTILITIES'", "'TELECOM_LEASED_LINE'")}
  WHEN {tests('SEVERANCE', 'LABOR')} THEN {row('CLASSIFIED', "'SEVERANCE_LIABILITY'", "'SEVERANCE'")}
  ELSE {several('s', None)} END AS k FROM hh),
d AS (SELECT description, k.status AS status, k.category AS category, k.rule AS rule, k.competing AS competing FROM kk)"""


CLASSES = _classes()
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$"
CLASSIFIED = f"""{LINKS}, {CLASSES},
rows_ AS (SELECT l.row_index, trim(l.txn_id) AS txn_id, l.scenario_id, l.counterparty, l.description, l.currency, try_cast(substr(trim(l.date), 1, 10) AS DATE) AS day,
               CASE WHEN regexp_matches(l.amount, '{NUMBER}') THEN try_cast(trim(l.amount) AS DECIMAL(18,2)) END AS source_amount,
               CASE WHEN l.amount IS NULL OR trim(l.amount) = '' THEN 'AMOUNT_MISSING' WHEN NOT regexp_matches(l.amount, '{NUMBER}') THEN 'AMOUNT_INVALID' ELSE 'OK' END AS amount_state,
               d.status AS class_status, d.category, d.rule
        FROM links l JOIN d USING (description))"""

OWNERS = """
thr0 AS (SELECT 'N' || n_nationkey AS scenario_id, 25.0 AS p FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 'N' || n_nationkey, 30.0 FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 6 = 5),
thr AS (SELECT scenario_id, min(p) AS threshold FROM thr0 GROUP BY scenario_id HAVING count(DISTINCT p) = 1),
own AS (SELECT 'N' || s_nationkey AS scenario_id, s_suppkey,
               CASE WHEN s_suppkey % 15 = 1 THEN 'Sup?lier ' ELSE 'Supplier ' END || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' LLP' ELSE ' JSC' END AS entity_name, ((s_suppkey * 7) % 60)::DOUBLE AS percent,
               s_suppkey % 15 = 1 AS damaged FROM supplier WHERE s_suppkey % 5 < 2),
owners AS (SELECT own.*, threshold FROM own JOIN thr USING (scenario_id) WHERE percent >= threshold)"""

RELATED = f"""{OWNERS},
parties AS (SELECT DISTINCT scenario_id, counterparty FROM links WHERE scenario_id IS NOT NULL),
matched AS (SELECT scenario_id, lower(entity_name) AS identity, count(*) AS n, count(DISTINCT entity_name) AS named FROM owners WHERE NOT damaged GROUP BY ALL),
unclear AS (SELECT DISTINCT p.scenario_id, p.counterparty FROM parties p JOIN owners o ON p.scenario_id = o.scenario_id AND o.damaged AND replace(lower(o.entity_name), 'sup?lier', 'supplier') = lower(p.counterparty)
            UNION SELECT DISTINCT p.scenario_id, p.counterparty FROM parties p JOIN owners o ON p.scenario_id = o.scenario_id AND o.damaged AND substr(lower(p.counterparty), 9) = substr(lower(o.entity_name), 9)),
rel AS (SELECT p.scenario_id, p.counterparty,
               CASE WHEN t.threshold IS NULL THEN 'MISSING_THRESHOLD' WHEN NOT EXISTS (SELECT 1 FROM own WHERE own.scenario_id = p.scenario_id) THEN 'MISSING_OWNERSHIP'
                    WHEN m.named > 1 THEN 'AMBIGUOUS_IDENTITY' WHEN m.n = 1 THEN 'OWNERSHIP_THRESHOLD' WHEN u.counterparty IS NOT NULL THEN 'DAMAGED_OWNERSHIP_IDENTITY' ELSE 'NO_IDENTITY_MATCH' END AS basis
        FROM parties p LEFT JOIN thr t USING (scenario_id) LEFT JOIN matched m ON m.scenario_id = p.scenario_id AND m.identity = lower(p.counterparty)
        LEFT JOIN unclear u ON u.scenario_id = p.scenario_id AND u.counterparty = p.counterparty),
related AS (SELECT *, CASE basis WHEN 'OWNERSHIP_THRESHOLD' THEN 'TRUE' WHEN 'NO_IDENTITY_MATCH' THEN 'FALSE' ELSE 'UNKNOWN' END AS related_party FROM rel)"""

STATUS = """
st0 AS (SELECT 'N' || s_nationkey AS scenario_id, 'supplier ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' llp' ELSE ' jsc' END AS identity, CASE WHEN s_suppkey % 2 = 0 THEN 'UNRESTRICTED' ELSE 'RESTRICTED' END AS status FROM supplier WHERE s_suppkey % 3 < 2
        UNION ALL SELECT 'N' || s_nationkey, 'supplier ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' llp' ELSE ' jsc' END, CASE WHEN s_suppkey % 5 = 0 THEN 'UNRESTRICTED' ELSE 'RESTRICTED' END FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 7 = 0),
st AS (SELECT scenario_id, identity, CASE WHEN count(DISTINCT status) > 1 THEN 'CONFLICT' ELSE min(status) END AS status FROM st0 GROUP BY ALL),
subs AS (SELECT p.scenario_id, p.counterparty, coalesce(st.status, 'UNKNOWN') AS subsidiary_status FROM parties p LEFT JOIN st ON st.scenario_id = p.scenario_id AND st.identity = lower(p.counterparty))"""

_INFLOW = "('REVENUE', 'FINANCING_INFLOWS', 'NON_OPERATING_INCOME', 'SEVERANCE_LIABILITY', 'GROUP_CAPEX')"
INPUTS = f"""{CLASSIFIED}, {RELATED}, {STATUS},
inputs AS (
  SELECT 'LEDGER:' || txn_id AS input_id, txn_id, r.scenario_id, category, currency, day, coalesce(related_party, 'UNKNOWN') AS related_party, coalesce(subsidiary_status, 'UNKNOWN') AS subsidiary_status,
         list_filter([category, CASE WHEN category = 'LEASE_PAYMENTS' AND {has('description', rules.PROPERTY_RENT)} THEN 'RENT' END,
                      CASE WHEN category IN ('CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS', 'CAPITAL_ASSET_TRANSFER') THEN 'CAPEX' END], lambda m: m IS NOT NULL) AS members,
         CASE WHEN category IN {_INFLOW} THEN source_amount ELSE -source_amount END AS amount,
         CASE WHEN contains(rule, 'MARKETING') THEN 'MARKETING' WHEN contains(rule, 'CONSULTING') THEN 'CONSULTING' WHEN contains(rule, 'SCHEDULED_PRINCIPAL') THEN 'SCHEDULED_PRINCIPAL' ELSE '' END AS flags
  FROM rows_ r LEFT JOIN related USING (scenario_id, counterparty) LEFT JOIN subs USING (scenario_id, counterparty)
  WHERE r.scenario_id IS NOT NULL AND class_status <> 'CONFLICT' AND category IS NOT NULL AND source_amount IS NOT NULL)"""

_AMONG = ", ".join(q(x) for x in RELATED_PARTY_MEMBERS)


def match(k: str) -> str:
    """SQL for whether an input belongs to a plain selector of category k."""
    own = f"list_contains(members, {k})"
    return (
        f"CASE {k} WHEN 'RELATED_PARTY_PAYMENTS' THEN related_party = 'TRUE' AND ({own} OR amount < 0 OR list_has_any(members, [{_AMONG}])) WHEN 'GROUP_CAPEX' THEN false "
        f"WHEN 'CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS' THEN {own} AND subsidiary_status = 'UNRESTRICTED' ELSE {own} END"
    )


#: A slot per scenario and category: what falls in the period, and whether any date can't be told.
SLOTS = f"""{INPUTS},
wanted(k) AS (VALUES {', '.join(f'({q(x)})' for x in CATEGORIES)}),
slots AS (
  SELECT scenario_id, k, coalesce(sum(amount) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'), 0)::DOUBLE AS v,
         count(*) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') AS n,
         min(currency) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') AS lo, max(currency) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') AS hi, bool_or(day IS NULL) AS untold
  FROM inputs JOIN wanted ON {match('k')} GROUP BY ALL),
full_ AS (SELECT u.scenario_id, w.k, coalesce(v, 0) AS v, coalesce(n, 0) AS n, lo, hi, coalesce(untold, false) AS untold FROM universe u CROSS JOIN wanted w LEFT JOIN slots USING (scenario_id, k))"""

_SETS = {
    "INTEREST_COVER_RATIO": ("(REVENUE - OPEX) / INTEREST_EXPENSE", ">= 1.5"),
    "SOURCES_OVER_USES_RATIO": ("(REVENUE + FINANCING_INFLOWS) / (OPEX + CAPEX)", ">= 1.1"),
    "CAPITAL_INTENSITY_RATIO": ("CAPEX / (OPEX + LEASE_PAYMENTS)", "<= 0.6"),
    "MIN_INSURANCE_COVER_RATIO": ("INSURANCE_PREMIUMS / (RENT + UTILITIES)", ">= 0.1"),
    "MIN_ADJ_EBITDA_MARGIN": ("(REVENUE - OPEX + ONE_TIME_ADD_BACKS) / REVENUE", ">= 0.1"),
    "MAX_GROUP_CAPEX_TO_BORROWER_EBITDA": ("GROUP_CAPEX / (REVENUE - OPEX)", "<= 0.5"),
    "MAX_TAX_UTILITIES_TO_EBITDA": ("(TAXES + UTILITIES) / (REVENUE - OPEX)", "<= 4"),
    "MAX_RP_AS_RATIO_OF_OPEX": ("RELATED_PARTY_PAYMENTS / OPEX", "<= 0.2"),
    "MIN_REVENUE_COVER_OF_PAYROLL_UTILITIES": ("REVENUE / (LABOR + UTILITIES)", ">= 0.75"),
    "MAX_CAPITAL_TRANSFERS_TO_UNRESTRICTED_SUBS_RATIO": ("CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS / CAPEX", "<= 0.3"),
    "MAX_RELATED_PARTY_RATIO_OF_REVENUE": ("RELATED_PARTY_PAYMENTS / REVENUE", "<= 0.25"),
    "MIN_REVENUE_MINUS_MAX_OVERHEAD": ("REVENUE - greatest(LABOR, TAXES)", ">= 100000"),
    "MAX_SINGLE_OVERHEAD_LINE": ("greatest(LABOR, UTILITIES)", "<= 3000000"),
    "MAX_PERSONNEL_OBLIGATIONS": ("LABOR + SEVERANCE_LIABILITY", "<= 5000000"),
    "MAX_RELATED_PARTY_PAYMENTS": ("RELATED_PARTY_PAYMENTS", "<= 2000000"),
    "MAX_CAPEX": ("CAPEX", "<= 4000000"),
    "MIN_REVENUE": ("REVENUE", ">= 1000000"),
    "SPRINGING_DRAWDOWN_LEVERAGE": ("FINANCING_INFLOWS / (REVENUE - OPEX)", "<= 3"),
}


def _family(name: str) -> str:
    """One row per scenario: status, value and verdict of a formula family."""
    import re

    formula, test = _SETS[name]
    used = sorted(set(re.findall(r"[A-Z_]{4,}", formula)))
    left, _, right = formula.partition(" / ")
    of = lambda e: re.sub(r"[A-Z_]{4,}", lambda m: f"m['{m[0]}'].v", e)
    each = lambda f: [f(f"m['{u}']") for u in used]
    untold = " OR ".join(each(lambda x: f"{x}.untold"))
    mixed = " OR ".join(each(lambda x: f"coalesce({x}.lo <> {x}.hi, false)"))
    signs = f"list_distinct(list_filter([{', '.join(each(lambda x: f'{x}.lo'))}], lambda c: c IS NOT NULL))"
    zero = f"{of(right)} = 0" if right else "false"
    value = f"CASE WHEN {zero} THEN NULL ELSE ({of(left)}) / ({of(right)}) END" if right else of(left)
    money = not right
    own = f"coalesce({signs}[1], 'USD')" if money else "NULL"
    foreign = f"{own} <> 'USD'" if money else "false"
    untold_i = f"CASE WHEN {untold} THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' END"
    mixed_i = f"CASE WHEN ({mixed}) THEN 'MIXED_CURRENCY_NO_TRUSTED_CONVERSION' END"
    # a set that can't be told reports that alone; sets of one currency each that differ meet only where both sides are known
    slot_issue = lambda x: f"CASE WHEN {x}.untold THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' WHEN {x}.lo <> {x}.hi THEN 'MIXED_CURRENCY_NO_TRUSTED_CONVERSION' END"
    issues = f"list_sort(list_distinct(list_filter([{', '.join(each(slot_issue))}], lambda i: i IS NOT NULL)))"
    del untold_i, mixed_i
    bad = f"len({issues}) > 0"
    differ = f"len({signs}) > 1"
    negative = f"({of(right)}) < 0" if right else "false"
    active = "true"
    activation = "'ALWAYS'"
    if name == "SPRINGING_DRAWDOWN_LEVERAGE":
        f = "m['FINANCING_INFLOWS']"
        active = f"CASE WHEN {f}.untold OR coalesce({f}.lo <> {f}.hi, false) OR coalesce({f}.lo, 'USD') <> 'USD' THEN NULL ELSE {f}.v > 1000000 END"
        activation = "CASE WHEN act IS NULL THEN 'UNKNOWN' WHEN act THEN 'ACTIVE' ELSE 'INACTIVE' END"
        act_issue = f"CASE WHEN {f}.untold THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' ELSE 'MIXED_CURRENCY_NO_TRUSTED_CONVERSION' END"
    else:
        act_issue = "''"
    return f"""
  SELECT scenario_id || ':{name}' AS definition_id, scenario_id,
         CASE WHEN act IS NULL THEN 'UNRESOLVED' WHEN NOT act THEN 'NOT_ACTIVATED' WHEN state <> 'RESOLVED' THEN state WHEN foreign_ THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status,
         CASE WHEN act IS NULL OR state <> 'RESOLVED' THEN NULL WHEN NOT act THEN 'COMPLIANT' WHEN foreign_ THEN NULL WHEN value {test} THEN 'COMPLIANT' ELSE 'BREACH' END AS compliance,
         {activation} AS activation, CASE WHEN state = 'RESOLVED' THEN own END AS currency, CASE WHEN state = 'RESOLVED' THEN round(value, 6) END AS actual,
         CASE WHEN act IS NULL THEN array_to_string(list_sort(list_distinct(list_filter([act_issue, CASE WHEN state = 'RESOLVED' AND negative THEN 'NEGATIVE_DENOMINATOR' END], lambda i: i IS NOT NULL))), ',')
              WHEN state <> 'RESOLVED' THEN array_to_string(all_issues, ',')
              ELSE array_to_string(list_filter([CASE WHEN act AND foreign_ THEN 'MIXED_CURRENCY_NO_TRUSTED_CONVERSION' END, CASE WHEN negative THEN 'NEGATIVE_DENOMINATOR' END], lambda i: i IS NOT NULL), ',') END AS issues
  FROM (SELECT scenario_id, {active} AS act, {act_issue} AS act_issue,
               CASE WHEN {bad} THEN 'UNRESOLVED' WHEN {differ} THEN 'UNRESOLVED' WHEN {zero} THEN 'ERROR' ELSE 'RESOLVED' END AS state,
               CASE WHEN {bad} THEN {issues} WHEN {differ} THEN ['MIXED_CURRENCY_NO_TRUSTED_CONVERSION'] WHEN {zero} THEN ['ZERO_DENOMINATOR'] ELSE []::VARCHAR[] END AS all_issues,
               {value} AS value, {own} AS own, {foreign} AS foreign_, {negative} AS negative
        FROM per)"""


_PER = "per AS (SELECT scenario_id, map_from_entries(list((k, {'v': v, 'n': n, 'lo': lo, 'hi': hi, 'untold': untold}))) AS m0 FROM full_ GROUP BY scenario_id)"
_PER = (
    "per AS (SELECT scenario_id, {"
    + ", ".join(f"'{k}': max(CASE WHEN k = '{k}' THEN {{'v': v, 'n': n, 'lo': lo, 'hi': hi, 'untold': untold}} END)" for k in CATEGORIES)
    + "} AS m FROM full_ GROUP BY scenario_id)"
)
_SHOWN = "definition_id, scenario_id, status, compliance, activation, currency, actual, issues"

_QUARTERS = f"""
pq AS (SELECT scenario_id, year(day) * 10 + quarter(day) AS p, sum(amount)::DOUBLE AS v, min(currency) AS lo, max(currency) AS hi FROM inputs
       WHERE list_contains(members, 'REVENUE') AND day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL),
un AS (SELECT scenario_id FROM inputs WHERE list_contains(members, 'REVENUE') AND day IS NULL GROUP BY ALL),
qq AS (SELECT u.scenario_id, coalesce(min(v), 0) AS v, bool_or(lo <> hi) AS mixed, count(DISTINCT lo) AS kinds, min(lo) AS lo, max(un.scenario_id) AS untold FROM universe u LEFT JOIN pq USING (scenario_id) LEFT JOIN un ON un.scenario_id = u.scenario_id GROUP BY ALL)"""
_QUARTER_ROWS = """
  SELECT scenario_id || ':MIN_REVENUE_QUARTER' AS definition_id, scenario_id, CASE WHEN untold IS NOT NULL OR mixed OR kinds > 1 OR lo <> 'USD' THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status,
         CASE WHEN untold IS NOT NULL OR mixed OR kinds > 1 OR lo <> 'USD' THEN NULL WHEN v >= 10000 THEN 'COMPLIANT' ELSE 'BREACH' END AS compliance, 'ALWAYS' AS activation,
         CASE WHEN untold IS NULL AND NOT coalesce(mixed, false) AND kinds <= 1 THEN coalesce(lo, 'USD') END AS currency, CASE WHEN untold IS NULL AND NOT coalesce(mixed, false) AND kinds <= 1 THEN round(v, 6) END AS actual,
         array_to_string(list_filter([CASE WHEN coalesce(mixed, false) OR kinds > 1 OR lo <> 'USD' THEN 'MIXED_CURRENCY_NO_TRUSTED_CONVERSION' END, CASE WHEN untold IS NOT NULL THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' END], lambda i: i IS NOT NULL), ',') AS issues
  FROM qq"""
EVALUATED = f"WITH {SLOTS}, {_PER}, {_QUARTERS}, results AS ({' UNION ALL '.join([*map(_family, (k for k in FAMILIES if k in _SETS)), _QUARTER_ROWS])})"

SQL: dict[str, str] = {
    "a1_ledger": f"WITH {LEDGER} SELECT * FROM ledger",
    "s14_route": f"""WITH {LINKS} SELECT trim(txn_id) AS txn_id, row_index, account AS account_id_normalized, CASE WHEN method IN ('TXN_ID_PREFIX', 'ACCOUNT_ID_FALLBACK') THEN scenario_id END AS scenario_id, token AS scenario_token, method,
        CASE method WHEN 'TXN_ID_PREFIX' THEN 'EXACT' WHEN 'ACCOUNT_ID_FALLBACK' THEN 'DERIVED' ELSE 'UNRESOLVED' END AS confidence FROM links""",
    "w3_duplicates": f"WITH {LEDGER} SELECT row_index, txn_id FROM (SELECT *, row_number() OVER (PARTITION BY trim(txn_id) ORDER BY row_index, counterparty, amount) AS rn FROM ledger) WHERE rn > 1",
    "w7_conflicts": f"""WITH {LINKS} SELECT 'SCENARIO_WITH_MULTIPLE_ACCOUNTS' AS kind, token AS subject, '' AS detail, count(*) AS rows FROM links WHERE token IS NOT NULL GROUP BY token HAVING count(DISTINCT account) > 1
        UNION ALL SELECT 'TRANSACTION_ACCOUNT_CONFLICT', account, array_to_string(list_sort(list(DISTINCT token)), ','), count(*) FROM links WHERE token IS NOT NULL GROUP BY account HAVING count(DISTINCT token) > 1
        UNION ALL SELECT 'DUPLICATE_TRANSACTION_ID', txn_id, '', count(*) - 1 FROM (SELECT trim(txn_id) AS txn_id FROM ledger) GROUP BY txn_id HAVING count(*) > 1""",
    "a5_f4_scenarios": f"""WITH {LINKS}, p AS (SELECT scenario_id, count(*) AS n, count(DISTINCT account) AS a FROM links WHERE scenario_id IS NOT NULL GROUP BY ALL)
        SELECT scenario_id, row_number() OVER (ORDER BY scenario_id) - 1 AS ordinal, coalesce(n, 0) AS txn_count, coalesce(a, 0) AS account_count FROM universe LEFT JOIN p USING (scenario_id)""",
    "f1_counterparties": f"WITH {LINKS} SELECT counterparty AS counterparty_raw, count(*) AS txn_count, coalesce(array_to_string(list_sort(list(DISTINCT scenario_id) FILTER (WHERE scenario_id IS NOT NULL)), ','), '') AS scenario_ids, count(DISTINCT account) AS account_count FROM links GROUP BY ALL",
    "c11_account_owners": f"WITH {LINKS} SELECT account AS account_id_normalized, array_to_string(list_sort(list(DISTINCT scenario_id)), ',') AS scenario_ids FROM links WHERE scenario_id IS NOT NULL GROUP BY ALL",
    "s1_s2_s3_classify": f"WITH {LEDGER}, {CLASSES} SELECT description, count(*) AS n, status, category, rule, competing FROM ledger JOIN d USING (description) GROUP BY ALL",
    "s4_s5_s6_memberships": f"""WITH {LEDGER}, {CLASSES}, o AS (SELECT *, NOT {has('description', rules.INCOME_TAX)} AND {has('description', rules.OPERATING_TAX)} AS op FROM d WHERE category IS NOT NULL)
        SELECT description, category, category || CASE WHEN category = 'LEASE_PAYMENTS' AND {has('description', rules.PROPERTY_RENT)} THEN ',RENT' ELSE '' END || CASE WHEN category LIKE 'CAPITAL_ASSET_TRANSFER%' THEN ',CAPEX' ELSE '' END AS memberships,
        'PRIMARY_CATEGORY' || CASE WHEN category <> 'TAXES' THEN '' WHEN op THEN ',OPERATING_TAX_IN_OPEX' WHEN {has('description', rules.INCOME_TAX)} THEN ',INCOME_OR_PROFIT_TAX_EXCLUDED_FROM_OPEX' ELSE ',TAX_SUBTYPE_NOT_PROVEN_OPERATING' END AS reasons, op::VARCHAR AS operating_tax FROM o""",
    "s7_s8_s9_labels": f"""WITH l AS (SELECT p_partkey, lower(p_name) || ' ' || list_extract(['Marketing Expenses', 'Group CAPEX', 'Operating  expenses', 'Advisory fees', 'REVENUE', 'other'], (p_partkey % 6 + 1)::INT) AS a FROM part),
        m AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN regexp_replace(a, '^[^ ]* [^ ]* ', '') ELSE a END AS label FROM l), n AS (SELECT *, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS low FROM m)
        SELECT p_partkey, CASE WHEN low = '' THEN NULL ELSE coalesce(CASE WHEN trim(label) IN ({', '.join(map(q, CATEGORIES))}) THEN trim(label) END, CASE low {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in rules.LABELS)} END,
        CASE {' '.join(f'WHEN contains(low, {q(k)}) OR contains({q(k)}, low) THEN {q(v)}' for k, v in rules.LABELS)} END) END AS category,
        CASE {' '.join('WHEN ' + ' OR '.join(f'contains(low, {q(x)})' for x in ts) + f' THEN {q(f)}' for f, ts in rules.FLAG_TOKENS)} END AS flag FROM n""",
    "m7_amounts": f"""WITH {LEDGER}, s AS (SELECT CASE WHEN amount IS NULL OR trim(amount) = '' THEN 'AMOUNT_MISSING' WHEN NOT regexp_matches(amount, '{NUMBER}') THEN 'AMOUNT_INVALID' ELSE 'OK' END AS state, try_cast(amount AS DECIMAL(18,2)) AS v, date FROM ledger)
        SELECT state, count(*) AS n, sum(v)::DOUBLE AS total, count(date) AS dated FROM s GROUP BY state""",
    "m8_m9_signs": f"""WITH {CLASSIFIED} SELECT category, CASE WHEN category IN ('SEVERANCE_LIABILITY', 'GROUP_CAPEX') THEN 'POSITIVE_MAGNITUDE_AS_IS' WHEN category IN {_INFLOW} THEN 'INFLOW_AS_IS' ELSE 'EXPENSE_NEGATE_SOURCE' END AS rule,
        count(*) AS n, sum(CASE WHEN category IN {_INFLOW} THEN source_amount ELSE -source_amount END)::DOUBLE AS total FROM rows_ WHERE category IS NOT NULL AND source_amount IS NOT NULL GROUP BY ALL""",
    "b13_drop_reasons": f"""WITH {CLASSIFIED} SELECT CASE WHEN scenario_id IS NULL THEN 'NO_SCENARIO' WHEN class_status = 'CONFLICT' THEN 'CLASSIFICATION_CONFLICT' WHEN category IS NULL THEN 'UNCLASSIFIED' WHEN source_amount IS NULL THEN amount_state ELSE 'KEPT' END AS reason, count(*) AS n FROM rows_ GROUP BY ALL""",
    "r1_calculation_inputs": f"WITH {INPUTS} SELECT input_id, scenario_id, category, array_to_string(members, ',') AS memberships, amount::DOUBLE AS amount, currency, day::VARCHAR AS day, related_party, subsidiary_status, flags FROM inputs",
    "f2_manifest": f"WITH {INPUTS} SELECT 'category' AS kind, category AS name, count(*) AS n FROM inputs GROUP BY ALL UNION ALL SELECT 'membership', mm, count(*) FROM (SELECT unnest(members) AS mm FROM inputs) GROUP BY ALL UNION ALL SELECT 'related_party', related_party, count(*) FROM inputs GROUP BY ALL",
    "c5_c9_owners": f"WITH {OWNERS} SELECT scenario_id, entity_name, lower(entity_name) AS identity, percent, damaged::VARCHAR AS damaged FROM owners",
    "c6_related_party": f"WITH {LINKS}, {RELATED} SELECT scenario_id, counterparty, related_party, basis FROM related",
    "c7_c8_recovered": f"""WITH {LINKS}, {OWNERS}, p AS (SELECT DISTINCT scenario_id, counterparty FROM links WHERE scenario_id IS NOT NULL)
        SELECT p.scenario_id, entity_name, counterparty, lower(counterparty) AS identity FROM owners o JOIN p ON o.scenario_id = p.scenario_id AND damaged AND replace(entity_name, 'p?l', 'ppl') = counterparty""",
    "c10_subsidiaries": f"WITH {LINKS}, parties AS (SELECT DISTINCT scenario_id, counterparty FROM links WHERE scenario_id IS NOT NULL), {STATUS} SELECT * FROM subs",
    "s10_s11_s12_names": """SELECT s_suppkey, lower(s_name) || list_extract([' llp', ' jsc', ' jsc', ''], (s_suppkey % 4 + 1)::INT) AS identity, lower(s_name) AS base, list_extract(['llp', 'jsc', 'jsc', NULL], (s_suppkey % 4 + 1)::INT) AS form FROM supplier""",
    "e13_evaluate": f"{EVALUATED} SELECT {_SHOWN} FROM results",
    "e12_springing": f"WITH {SLOTS}, {_PER} SELECT {_SHOWN} FROM ({_family('SPRINGING_DRAWDOWN_LEVERAGE')})",
    "e13_strict": f"""WITH {SLOTS}, {_PER} SELECT {_SHOWN} FROM ({_family('MAX_CAPEX')}) UNION ALL SELECT scenario_id || ':MIN_REVENUE_QUARTER', scenario_id, 'UNRESOLVED', NULL, NULL, NULL, NULL, 'PERIOD_INPUTS_REQUIRED' FROM universe""",
    "b1_b2_selectors": f"""WITH {INPUTS}, w(k) AS (VALUES {', '.join(f'({q(x)})' for x in CATEGORIES)}), r(o) AS (VALUES (false), (true))
        SELECT k AS wanted, o::VARCHAR AS related_only, count(*) AS n, sum(amount)::DOUBLE AS total FROM inputs CROSS JOIN w CROSS JOIN r WHERE {match('k')} AND (NOT o OR related_party = 'TRUE') AND flags <> 'MARKETING' GROUP BY ALL""",
    "b3_b4_b5_b6_periods": f"""WITH {INPUTS}, m AS (
          SELECT 'closed' AS name, day > DATE '1997-03-01' AND day <= DATE '1997-09-30' AS member, NULL::BOOLEAN AS ab FROM inputs
          UNION ALL SELECT 'quarter', quarter(day) = 2, NULL FROM inputs UNION ALL SELECT 'asof', NULL, day <= DATE '1997-06-30' FROM inputs
          UNION ALL SELECT 'mixed', day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31', day <= DATE '1998-01-01' FROM inputs)
        SELECT name, member::VARCHAR AS member, ab::VARCHAR AS at_or_before, count(*) AS n FROM m GROUP BY ALL""",
    "c13_f7_coverage": "",
    "r8_universe": f"""WITH {INPUTS}, known AS (SELECT scenario_id FROM universe WHERE scenario_id <> (SELECT min(scenario_id) FROM universe) UNION ALL SELECT 'N99')
        SELECT 'DUPLICATE_INPUT_ID' AS kind, input_id AS subject FROM inputs GROUP BY input_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'SCENARIO_WITHOUT_DEFINITION', scenario_id FROM inputs WHERE scenario_id NOT IN (SELECT scenario_id FROM known)
        UNION ALL SELECT 'DEFINITION_WITHOUT_INPUTS', scenario_id FROM known WHERE scenario_id NOT IN (SELECT scenario_id FROM inputs)""",
    "c14_c15_only_period": """SELECT (o_custkey % 50)::VARCHAR AS scenario_id, o_orderpriority AS category, CASE WHEN count(DISTINCT year(o_orderdate)) = 1 THEN min(year(o_orderdate))::VARCHAR END AS start, CASE WHEN count(DISTINCT year(o_orderdate)) = 1 THEN 'x' END AS "end",
        CASE WHEN count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END) = 1 THEN min(CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END) END AS as_of FROM orders GROUP BY 1, 2""",
    "c16_submission": f"""{EVALUATED}, cells AS (SELECT scenario_id, unnest(range(21))::VARCHAR AS clause_id FROM universe), fam(name, clause_id) AS (VALUES {', '.join(f"({q(k)}, '{i}')" for i, k in enumerate(FAMILIES))}),
        r AS (SELECT scenario_id, clause_id, CASE WHEN status = 'RESOLVED' THEN compliance WHEN status = 'NOT_ACTIVATED' AND actual IS NOT NULL THEN 'COMPLIANT' END AS v, actual FROM results JOIN fam ON definition_id = scenario_id || ':' || name)
        SELECT cells.scenario_id, cells.clause_id, v AS status, CASE WHEN v IS NOT NULL THEN round(abs(actual), 2) END AS actual FROM cells LEFT JOIN r USING (scenario_id, clause_id)""",
}
del SQL["c13_f7_coverage"]

_CELLS = """t AS (SELECT 'N' || c_nationkey AS scenario_id, c_custkey AS k, c_acctbal::DECIMAL(38,6) AS ta, CASE WHEN c_acctbal::DECIMAL(38,6) > 0 THEN 'COMPLIANT' ELSE 'BREACH' END AS ts, CASE WHEN c_custkey % 3 = 0 THEN 'T' || c_custkey END AS te FROM customer),
s AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'BREACH' ELSE ts END AS ss, ta::DOUBLE * (1 + (k % 5) / 100.0) AS sa, CASE WHEN k % 6 = 0 THEN 'T' || k END AS se FROM t WHERE k % 13 <> 0),
e AS (SELECT t.*, ss, se, coalesce(greatest(0, 1 - (CASE WHEN ta = 0 THEN CASE WHEN sa = 0 THEN 0 END ELSE abs(sa - ta::DOUBLE) / abs(ta::DOUBLE) END) / 0.05), 0) AS f FROM t LEFT JOIN s USING (k)),
g AS (SELECT *, coalesce(ss = ts, false) AS ok, CASE WHEN te IS NULL THEN 0.2 * f WHEN se = te THEN 0.2 ELSE 0 END AS p FROM e),
scored AS (SELECT scenario_id, k::VARCHAR AS clause_id, CASE WHEN ok THEN 0.5 + 0.3 * f + p ELSE 0 END AS score, ok, CASE WHEN ok THEN 0.3 * f ELSE 0 END AS a, CASE WHEN ok THEN p ELSE 0 END AS b FROM g)"""
_TEXT_PAGES = """lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
pages_ AS (SELECT document_id, (n // 10)::INT AS page_number, string_agg(line, chr(10) ORDER BY n) AS raw_text FROM lines GROUP BY ALL)"""
_STATES = f"""{_TEXT_PAGES},
sig AS (SELECT document_id, page_number, document_id % 3 AS images, document_id % 5 = 0 AS unknown, trim(raw_text) AS t, length(trim(raw_text)) AS n FROM pages_),
sig2 AS (SELECT *, CASE WHEN n > 0 THEN length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / n ELSE 0.0 END AS alnum, CASE WHEN n > 0 THEN (n - length(replace(t, chr(65533), ''))) / n ELSE 0.0 END AS bad,
         list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM sig),
sig3 AS (SELECT *, len(ls) BETWEEN 1 AND 3 AND list_sum(list_transform(ls, lambda x: length(x))) < 80 AND len(list_filter(ls, lambda x: length(x) <= 40)) > 0 AS heading FROM sig2),
states AS (SELECT document_id, page_number, n AS char_count, round(alnum, 6) AS alnum_ratio, CASE WHEN NOT unknown AND images >= 1 AND n = 0 THEN 'OCR_REQUIRED' WHEN coalesce(heading, false) AND n < 120 THEN 'OCR_REQUIRED' WHEN NOT unknown AND images >= 1 AND n < 40 THEN 'IMAGE_DOMINANT'
            WHEN unknown AND (n = 0 OR (n < 25 AND alnum < 0.15)) THEN 'OCR_REQUIRED' WHEN n = 0 THEN 'UNREADABLE' WHEN coalesce(heading, false) THEN 'HEADING_WITHOUT_BODY' WHEN n < 25 OR alnum < 0.15 THEN 'LOW_TEXT' WHEN bad > 0.2 THEN 'UNREADABLE' ELSE 'TEXT_OK' END AS state FROM sig3)"""
_METRICS = f"""{_TEXT_PAGES},
pm AS (SELECT document_id, trim(raw_text) = '' AS empty, length(raw_text) AS chars, length(regexp_replace(raw_text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum, length(raw_text) - length(replace(raw_text, chr(65533), '')) AS bad,
       length(raw_text) - length(regexp_replace(raw_text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS control, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pages_),
metrics AS (SELECT document_id, count(*) AS page_count, sum(empty::INT) AS empty_pages, sum(empty::INT) / count(*) AS empty_ratio, sum(chars) AS total_chars, CASE WHEN sum(chars) > 0 THEN sum(alnum) / sum(chars) ELSE 0 END AS alnum, CASE WHEN sum(chars) > 0 THEN sum(bad) / sum(chars) ELSE 0 END AS bad,
            sum(control) AS control_chars, CASE WHEN sum(len(ls)) > 0 THEN 1 - sum(len(list_distinct(ls))) / sum(len(ls)) ELSE 0 END AS repeated FROM pm GROUP BY document_id)"""
_BLOCKING = ", ".join(map(q, docs.BLOCKING))
_POSTS = """w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_-]+'), lambda x: x <> '') AS w FROM documents),
posts AS (SELECT id, len(w) AS length, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM w) GROUP BY ALL),
qs AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_-]+'), lambda x: x <> '' AND x NOT IN (STOP))) AS t FROM benchmark WHERE item_id % 50 = 0),
qt AS (SELECT query_id, unnest(t) AS term FROM qs), stats AS (SELECT count(*) AS docs, avg(length) AS mean FROM (SELECT DISTINCT id, length FROM posts)), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
sc AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score, count(*) AS found FROM qt JOIN posts USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY ALL)""".replace("STOP", ", ".join(map(q, retrieval.STOP)))

_HEADS = "['LOAN AGREEMENT executed copy', 'Auditor''s report FINAL', 'KYC dossier', 'Treasury memo - working document', 'Loan agreement DRAFT', 'Press release', 'SUPERSEDED loan agreement']"
SQL |= {
    "m20_m21_score_cells": f"WITH {_CELLS} SELECT scenario_id, clause_id, round(score, 9) AS score, ok::VARCHAR AS status_ok, round(a, 9) AS actual_part, round(b, 9) AS evidence_part FROM scored",
    "c17_f19_totals": f"WITH {_CELLS} SELECT count(*) AS cells, round(sum(score), 6) AS score, round(avg(score), 6) AS uniform, round(avg(score), 6) AS weighted FROM scored",
    "i2_i3_keys": "SELECT 'N' || c_nationkey AS scenario_id, c_custkey::VARCHAR AS clause_id, 'MISSING' AS side FROM customer WHERE c_custkey % 13 = 0",
    "r7_reproduction": "SELECT count(*) AS rows_a, count(*) AS rows_b, 'true' AS equal FROM orders",
    "e22_e23_m22_verdicts": """WITH o AS (SELECT o_orderkey % 3 AS s, (o_totalprice::DECIMAL(18,4) / 7)::DECIMAL(38,14) AS v, (o_totalprice::DECIMAL(18,4)) AS p FROM orders), c AS (SELECT *, CASE WHEN p <= 140000 THEN 'COMPLIANT' ELSE 'BREACH' END AS c FROM o)
        SELECT CASE s WHEN 0 THEN c WHEN 1 THEN 'COMPLIANT' END AS verdict, CASE WHEN c = 'BREACH' AND p <= 147000 THEN 'COMPLIANT' ELSE c END AS soft, count(*) AS n, sum(round(p / 7.0::DOUBLE, 2)::DECIMAL(18,2))::DOUBLE AS total FROM c GROUP BY ALL""",
    "m15_m16_m17_fx": f"""WITH {INPUTS}, rate AS (SELECT 'N' || n_nationkey AS scenario_id, 1.1 + n_regionkey * 0.01 AS rate FROM nation WHERE n_nationkey % 7 = 3), c AS (SELECT i.scenario_id, CASE WHEN currency = 'EUR' AND rate IS NOT NULL THEN 'USD' ELSE currency END AS currency, CASE WHEN currency = 'EUR' AND rate IS NOT NULL THEN amount * rate ELSE amount END AS amount FROM inputs i LEFT JOIN rate USING (scenario_id))
        SELECT scenario_id, currency, count(*) AS n, round(sum(amount)::DOUBLE, 4) AS total FROM c GROUP BY ALL""",
    "n1_n2_page_states": f"WITH {_STATES} SELECT * FROM states",
    "n4_trust": f"WITH {_STATES} SELECT document_id, CASE WHEN count(*) FILTER (WHERE state NOT IN ({_BLOCKING})) = 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE state IN ({_BLOCKING})) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, count(*) FILTER (WHERE state NOT IN ({_BLOCKING})) AS usable, count(*) FILTER (WHERE state IN ({_BLOCKING})) AS blocking FROM states GROUP BY document_id",
    "h6_ocr_plan": f"WITH {_STATES} SELECT document_id, page_number FROM states WHERE state IN ({_BLOCKING}) ORDER BY 1, 2 LIMIT 25",
    "f10_parse_metrics": f"WITH {_METRICS} SELECT document_id, page_count, empty_pages, total_chars, round(alnum, 6) AS alnum_ratio, control_chars, round(repeated, 6) AS duplicate_line_ratio FROM metrics",
    "n3_gate": f"""WITH {_METRICS}, r AS (SELECT *, list_filter([CASE WHEN total_chars < 40 THEN 'min_total_characters' END, CASE WHEN empty_ratio > 0.5 THEN 'max_empty_page_ratio' END, CASE WHEN bad > 0.02 THEN 'max_replacement_character_ratio' END, CASE WHEN total_chars > 0 AND alnum < 0.3 THEN 'min_alphanumeric_character_ratio' END,
        CASE WHEN control_chars > 50 THEN 'max_control_character_count' END, CASE WHEN repeated > 0.6 THEN 'max_duplicate_line_ratio' END], lambda x: x IS NOT NULL) AS rules FROM metrics) SELECT document_id, CASE WHEN len(rules) = 0 THEN 'ACCEPT' WHEN bad > 0.5 THEN 'REJECT' ELSE 'FALLBACK_REQUIRED' END AS decision, array_to_string(rules, ',') AS rules FROM r""",
    "n6_n7_n8_w4_authority": f"""WITH h AS (SELECT p_partkey AS document_id, 'N' || p_size AS scenario_id, p_brand AS dk, p_partkey % 7 AS k FROM part),
        c AS (SELECT *, CASE WHEN k IN (0, 4, 6) THEN 'COVENANT_TERMS' WHEN k = 1 THEN 'FINANCIAL_ADJUSTMENTS' WHEN k = 2 THEN 'KYC_RELATIONSHIPS' WHEN k = 3 THEN 'TREASURY_FACTS' END AS domain, CASE k WHEN 0 THEN 100 WHEN 1 THEN 90 WHEN 2 THEN 20 WHEN 3 THEN 5 WHEN 4 THEN 10 WHEN 6 THEN 0 END AS rank FROM h WHERE k <> 5),
        b AS (SELECT *, max({{'rank': rank, 'dk': dk}}) OVER (PARTITION BY scenario_id, domain) AS best FROM c)
        SELECT scenario_id, domain, CASE WHEN max(rank) <= 0 THEN 'UNRESOLVED' WHEN count(*) > 1 THEN 'CONFLICT' ELSE 'RESOLVED' END AS status, CASE WHEN count(*) = 1 AND max(rank) > 0 THEN min(document_id) END AS document_id, count(*) AS n FROM b WHERE {{'rank': rank, 'dk': dk}} = best GROUP BY ALL""",
    "n10_families": """WITH d AS (SELECT p_partkey AS id, 'N' || p_size AS s, p_partkey % 3 AS k, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS a FROM part WHERE p_partkey % 3 < 2)
        SELECT CASE WHEN k = 0 THEN s || '|LOAN|' || coalesce(a, 'UNNUMBERED') ELSE s || '|KYC_DOSSIER' END AS family, count(*) AS documents, min(id) AS first FROM d GROUP BY 1""",
    "c12_document_scenarios": """WITH c AS (SELECT o_custkey AS document_id, substr(o_orderpriority, 1, 1)::INT AS level, 'N' || (o_orderkey % 25) AS s FROM orders), b AS (SELECT *, min(level) OVER (PARTITION BY document_id) AS best FROM c)
        SELECT document_id, level, array_to_string(list_sort(list(DISTINCT s)), ',') AS scenario_ids, CASE WHEN count(DISTINCT s) > 1 THEN 'CONFLICT' ELSE 'RESOLVED' END AS status FROM b WHERE level = best GROUP BY document_id, level""",
    "c20_evidence_overlap": """WITH c AS (SELECT doc_id, unnest(range(0, n_chars + 1, 1000)) AS a, n_chars FROM documents) SELECT doc_id AS document_id, (a / 1000)::INT AS ordinal, 's' || doc_id AS span_id FROM c WHERE a < floor(n_chars / 3 + 700) AND floor(n_chars / 3) < a + 1000""",
    "h2_bm25_or": f"WITH {_POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sc) SELECT query_id, id, round(score, 6) AS score FROM r WHERE rn <= 10",
    "h3_bm25_and": f"WITH {_POSTS}, n AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY ALL), r AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sc JOIN n USING (query_id) WHERE found = terms) SELECT query_id, id, round(score, 6) AS score FROM r WHERE rn <= 10",
    "h1_h4_h5_cosine": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.id AS query_id, e.id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS score FROM e CROSS JOIN e q WHERE q.id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) SELECT query_id, id, score, rank FROM r WHERE rank <= 5""",
    "w1_w2_rrf": """WITH a AS (SELECT event_type AS query_id, 'v' AS l, user_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS p FROM events UNION ALL SELECT event_type, 't', user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) FROM events),
        f AS (SELECT query_id, l, id, min(p) AS p FROM a GROUP BY ALL) SELECT query_id, id, round(sum(1.0 / (60 + p)), 9) AS score FROM f GROUP BY query_id, id""",
    "m18_m19_ir_metrics": """WITH r AS (SELECT user_id AS q, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), v AS (SELECT user_id AS q, event_id AS id, (event_id % 4)::DOUBLE AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id) AS n FROM events WHERE event_id % 5 = 0),
        i AS (SELECT q, count(*) AS c, sum(CASE WHEN n <= 10 THEN (pow(2, g) - 1) / log2(n + 1) ELSE 0 END) AS ideal FROM v GROUP BY q), h AS (SELECT q, count(*) AS f, min(rank) AS first, sum((pow(2, g) - 1) / log2(rank + 1)) AS dcg FROM v JOIN r USING (q, id) WHERE rank <= 10 GROUP BY q)
        SELECT q AS query_id, round(coalesce(f, 0) / c, 9) AS recall, round(coalesce(1.0 / first, 0), 9) AS mrr, CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END AS hit, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 9) AS ndcg FROM i LEFT JOIN h USING (q)""",
    "b9_filters": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2') AND (doc_id % 7 IN (3, 10) OR doc_id % 11 IN (3, 10))",
    "r11_vectors": "SELECT CASE WHEN vec_id % 9 = 0 THEN 'DIMENSION' WHEN vec_id % 10 = 0 THEN 'NOT_FINITE' ELSE 'OK' END AS state, count(*) AS n FROM embeddings GROUP BY ALL",
    "stream_sums": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL",
    "m5_m6_m12_numbers": """WITH n AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS v, CASE o_orderkey % 4 WHEN 0 THEN 'Paid $' || format('{:,.2f}', o_totalprice) || ' on call.' WHEN 1 THEN 'Sum EUR ' || o_totalprice::DECIMAL(18,2) || ' due' WHEN 2 THEN 'Fee of USD ' || o_totalprice::DECIMAL(18,2) || 'abc was void' ELSE 'Rates of ' || (o_orderkey % 40) || '.5 % apply' END AS note FROM orders)
        SELECT o_orderkey, v::DOUBLE AS us, v::DOUBLE AS eu, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey % 40 + 0.5 END AS pct, ceil(length(note) / 4)::INT AS tokens FROM n""",
    "m1_m4_money": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency, CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice::DECIMAL(18,2)::DOUBLE END AS value, (o_orderkey % 4 = 2)::VARCHAR AS malformed, CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE 0 END AS n FROM orders""",
    "p1_p3_p5_dates": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS dotted, NULL::VARCHAR AS bad, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) WHEN 1 THEN 'Q3' ELSE 'FY ' || year(o_orderdate) END AS label FROM orders""",
    "d16_counts": f"""WITH {INPUTS}, c AS (SELECT u.scenario_id, k, count(*) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') AS n, coalesce(bool_or(day IS NULL AND list_contains(members, k)), false) AS untold FROM universe u CROSS JOIN (VALUES ('LABOR'), ('TAXES'), ('RENT')) w(k) LEFT JOIN inputs i ON i.scenario_id = u.scenario_id AND list_contains(members, k) GROUP BY ALL)
        SELECT scenario_id || ':COUNT:' || k AS definition_id, scenario_id, CASE WHEN untold THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, CASE WHEN untold THEN NULL WHEN n <= 20 THEN 'COMPLIANT' ELSE 'BREACH' END AS compliance, 'ALWAYS' AS activation, NULL::VARCHAR AS currency, CASE WHEN NOT untold THEN n::DOUBLE END AS actual, CASE WHEN untold THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' ELSE '' END AS issues FROM c""",
    "b8_materiality": f"""WITH {INPUTS}, c AS (SELECT u.scenario_id, coalesce(sum(amount) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND amount >= 50000), 0)::DOUBLE AS v, coalesce(bool_or(day IS NULL AND input_id IS NOT NULL), false) AS untold FROM universe u LEFT JOIN inputs i ON i.scenario_id = u.scenario_id AND list_contains(members, 'UTILITIES') GROUP BY ALL)
        SELECT scenario_id || ':FLOOR' AS definition_id, scenario_id, CASE WHEN untold THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, CASE WHEN untold THEN NULL WHEN v <= 400000 THEN 'COMPLIANT' ELSE 'BREACH' END AS compliance, 'ALWAYS' AS activation, CASE WHEN NOT untold THEN 'USD' END AS currency, CASE WHEN NOT untold THEN round(v, 6) END AS actual, CASE WHEN untold THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' ELSE '' END AS issues FROM c""",
    "d11_period_aggregate": f"""WITH {INPUTS}, u0 AS (SELECT * FROM inputs WHERE list_contains(members, 'UTILITIES')), p AS (SELECT scenario_id, g, part, sum(amount) AS v FROM (SELECT scenario_id, amount, unnest([strftime(day, 'M%Y-%m'), strftime(day, 'Y%Y'), 'Q' || year(day) || quarter(day)]) AS part FROM u0 WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') CROSS JOIN (SELECT 1) z(g) GROUP BY ALL),
        a AS (SELECT u.scenario_id, r, CASE r WHEN 'MAX' THEN max(v) WHEN 'SUM' THEN sum(v) ELSE min(v) END AS v FROM universe u CROSS JOIN (VALUES ('MAX', 'M'), ('SUM', 'Y'), ('MIN', 'Q')) t(r, l) LEFT JOIN p ON p.scenario_id = u.scenario_id AND left(part, 1) = l GROUP BY u.scenario_id, r), b AS (SELECT a.scenario_id, r, coalesce(v, 0)::DOUBLE AS v, EXISTS (SELECT 1 FROM u0 WHERE u0.scenario_id = a.scenario_id AND day IS NULL) AS untold FROM a)
        SELECT scenario_id || ':' || r AS definition_id, scenario_id, CASE WHEN untold THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, CASE WHEN untold THEN NULL WHEN v <= 400000 THEN 'COMPLIANT' ELSE 'BREACH' END AS compliance, 'ALWAYS' AS activation, CASE WHEN NOT untold THEN 'USD' END AS currency, CASE WHEN NOT untold THEN round(v, 6) END AS actual, CASE WHEN untold THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' ELSE '' END AS issues FROM b""",
}

# Facts on transactions

_FACTS = f"""{LINKS},
facts1 AS (SELECT 'F' || row_index AS fact_id, CASE WHEN row_index % 9 = 0 THEN 'N0' ELSE regexp_extract(txn_id, '^[A-Za-z]+-([^-]+)-', 1) END AS scenario_id, trim(txn_id) AS txn,
                  ['AMOUNT_CORRECTION', 'RECLASSIFICATION', 'PERIOD', 'TREATMENT'][(row_index % 4 + 1)::INT] AS fact_kind, CASE WHEN row_index % 4 = 0 THEN 1250 END AS amount FROM firsts),
facts AS (SELECT * FROM facts1 UNION ALL SELECT fact_id || 'b', scenario_id, txn, fact_kind, 999 FROM facts1 WHERE fact_id LIKE '%0' AND fact_kind = 'AMOUNT_CORRECTION')"""
_ORDER_LINES = "lines_ AS (SELECT *, l_extendedprice::DECIMAL(18,2) AS v, 'N' || c_nationkey AS scenario_id, 'supplier ' || l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN ' llp' ELSE ' jsc' END AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
SQL |= {
    "c2_fact_links": f"""WITH {_FACTS} SELECT fact_id, fact_kind, CASE WHEN l.scenario_id IS NULL THEN 'UNUSED' WHEN l.scenario_id <> f.scenario_id THEN 'FACT_SCENARIO_MISMATCH' ELSE 'LINKED' END AS link_status
        FROM facts f LEFT JOIN links l ON trim(l.txn_id) = f.txn""",
    "f13_f14_fact_conflicts": f"""WITH {_FACTS} SELECT fact_kind, scenario_id, txn AS identity, count(DISTINCT coalesce(amount, -1)) AS "values", array_to_string(list_sort(list(DISTINCT fact_id)), ',') AS fact_ids
        FROM facts GROUP BY fact_kind, scenario_id, txn HAVING count(DISTINCT coalesce(amount, -1)) > 1""",
    "f15_fact_dedupe": f"WITH {_FACTS}, twice AS (SELECT * FROM facts UNION ALL SELECT 'Z' || fact_id, scenario_id, txn, fact_kind, amount FROM facts) SELECT min(fact_id) AS fact_id, fact_kind FROM twice GROUP BY scenario_id, txn, fact_kind, amount",
    "f17_m10_corrected": f"""WITH {CLASSIFIED}, {_FACTS.removeprefix(LINKS + ',')},
        ok AS (SELECT f.txn, f.fact_kind AS k, count(DISTINCT f.amount) AS n, min(f.amount) AS v FROM facts f JOIN links l ON trim(l.txn_id) = f.txn AND l.scenario_id = f.scenario_id GROUP BY ALL)
        SELECT txn_id, CASE WHEN k = 'RECLASSIFICATION' THEN 'CAPEX' ELSE category END AS category,
               (CASE WHEN k = 'AMOUNT_CORRECTION' AND n = 1 THEN CASE WHEN coalesce(source_amount < 0, category NOT IN {_INFLOW}, false) THEN -v ELSE v END ELSE source_amount END)::DOUBLE AS source_amount,
               (k = 'PERIOD')::VARCHAR AS period_excluded, CASE WHEN k = 'TREATMENT' THEN 'EXCLUDE' END AS treatment, CASE WHEN n > 1 THEN 'new_amount' END AS fact_conflict
        FROM rows_ JOIN ok ON txn = txn_id""",
    "c3_reclass_targets": f"""WITH {CLASSIFIED}, {_ORDER_LINES},
        f AS (SELECT 'R' || l_orderkey AS fact_id, scenario_id, CASE WHEN l_orderkey % 2 = 0 THEN 'TXN-' || scenario_id || '-' || l_orderkey || '-' || l_linenumber END AS txn, v, name
              FROM lines_ QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, v) = 1),
        hits AS (SELECT fact_id, txn_id FROM f JOIN rows_ r ON r.scenario_id = f.scenario_id AND r.txn_id = f.txn
                 UNION ALL SELECT fact_id, txn_id FROM f JOIN rows_ r ON f.txn IS NULL AND r.scenario_id = f.scenario_id AND abs(r.source_amount) = f.v AND lower(r.counterparty) = f.name)
        SELECT f.fact_id, CASE count(DISTINCT txn_id) WHEN 0 THEN 'UNUSED' WHEN 1 THEN 'LINKED' ELSE 'FACT_LINK_AMBIGUOUS' END AS status, CASE WHEN count(DISTINCT txn_id) = 1 THEN min(txn_id) END AS txn_id FROM f LEFT JOIN hits USING (fact_id) GROUP BY f.fact_id""",
    "c4_add_backs": f"""WITH {CLASSIFIED}, {_ORDER_LINES},
        f AS (SELECT 'AB-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS fact_id, scenario_id, v, name, CASE WHEN l_linenumber % 3 = 0 THEN (l_shipdate::DATE + 5)::DATE END AS start FROM lines_),
        hits AS (SELECT fact_id, count(DISTINCT txn_id) AS n, min(txn_id) AS txn_id FROM f JOIN rows_ r ON r.scenario_id = f.scenario_id AND abs(r.source_amount) = f.v AND lower(r.counterparty) = f.name AND (start IS NULL OR r.day >= start) GROUP BY fact_id)
        SELECT f.fact_id, CASE WHEN n = 1 THEN 'ATTACHED' WHEN n > 1 THEN 'FACT_LINK_AMBIGUOUS' ELSE 'DERIVED' END AS status, CASE WHEN n = 1 THEN txn_id END AS txn_id FROM f LEFT JOIN hits USING (fact_id)""",
}

# Coverage, compound predicates, compiled clauses


def _slot_rows() -> str:
    """Slots of each formula family: its categories in the order in which they first occur."""
    import re

    out = []
    for name in FAMILIES:
        used = list(dict.fromkeys(re.findall(r"[A-Z_]{4,}", _SETS[name][0]))) if name in _SETS else ["REVENUE"]
        out += [f"({q(name)}, {k}, {q(c)})" for k, c in enumerate(used)]
    return ", ".join(out)


_COVERED = f"""{INPUTS}, sl(family, slot, category) AS (VALUES {_slot_rows()}),
of_scenario AS (SELECT scenario_id, count(*) FILTER (WHERE related_party = 'UNKNOWN') AS unknown FROM inputs GROUP BY ALL),
of_category AS (SELECT scenario_id, category AS k, 0 AS n FROM sl, universe GROUP BY ALL),
hit AS (SELECT i.scenario_id, w.k, count(*) AS n FROM inputs i JOIN (SELECT DISTINCT category AS k FROM sl) w ON {match('w.k')} GROUP BY ALL),
whole AS (SELECT 'N' || n_nationkey AS scenario_id FROM nation WHERE n_nationkey % 2 = 0),
cov0 AS (SELECT u.scenario_id || ':' || family AS definition_id, u.scenario_id, slot, category, coalesce(n, 0) AS n, coalesce(unknown, 0) AS unknown, w.scenario_id IS NOT NULL AND category = 'CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS' AS complete,
         CASE category WHEN 'RELATED_PARTY_PAYMENTS' THEN 'RELATED_PARTY_IDENTITY' WHEN 'GROUP_CAPEX' THEN 'GROUP_SOURCE' WHEN 'CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS' THEN 'SUBSIDIARY_STATUS'
              WHEN 'ONE_TIME_ADD_BACKS' THEN 'FACT_AUGMENTED' WHEN 'SEVERANCE_LIABILITY' THEN 'FACT_ONLY' ELSE 'LEDGER_ONLY' END AS source
  FROM universe u CROSS JOIN sl LEFT JOIN hit ON hit.scenario_id = u.scenario_id AND hit.k = category LEFT JOIN of_scenario o ON o.scenario_id = u.scenario_id LEFT JOIN whole w ON w.scenario_id = u.scenario_id),
cov1 AS (SELECT *, CASE WHEN n > 0 THEN 'OK' WHEN source = 'RELATED_PARTY_IDENTITY' AND unknown > 0 THEN 'RELATED_PARTY_IDENTITY_UNKNOWN' WHEN source IN ('FACT_ONLY', 'FACT_AUGMENTED', 'GROUP_SOURCE', 'SUBSIDIARY_STATUS') AND NOT complete THEN 'UNRESOLVED_SOURCE_QUALITY'
              WHEN category = 'GROUP_CAPEX' THEN 'NO_GROUP_CAPEX_INPUTS' WHEN category = 'CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS' THEN 'NO_UNRESTRICTED_TRANSFER_INPUTS' ELSE 'NO_MATCHING_INPUTS' END AS reason_code FROM cov0),
cov AS (SELECT *, CASE WHEN reason_code = 'OK' THEN 'READY' WHEN reason_code LIKE 'NO\\_%' ESCAPE '\\' THEN 'TRUE_ZERO' ELSE 'UNRESOLVED' END AS status FROM cov1)""".replace("\\\\", "\\")


def _compound() -> str:
    """Breach if revenue is below a limit, or labour above taxes and utilities above a limit; arms from the left, an unknown one ends the walk."""
    r, l, x, u = (f"m['{k}']" for k in ("REVENUE", "LABOR", "TAXES", "UTILITIES"))
    issue = lambda c: f"CASE WHEN {c}.untold THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' WHEN {c}.lo <> {c}.hi THEN '{mixed}' END"
    mixed = "MIXED_CURRENCY_NO_TRUSTED_CONVERSION"
    some = lambda *cs: f"list_sort(list_distinct(list_filter([{', '.join(map(issue, cs))}], lambda i: i IS NOT NULL)))"
    return f"""WITH {SLOTS}, {_PER},
    arms AS (SELECT scenario_id, {r}.v AS v, {r}.lo AS own, {some(r)} AS i0,
        CASE WHEN coalesce({r}.lo, 'USD') = 'USD' THEN {r}.v < 500000 END AS a1,
        CASE WHEN len({some(l, x)}) = 0 AND NOT coalesce({l}.lo <> {x}.lo, false) THEN {l}.v > {x}.v END AS a2, CASE WHEN len({some(l, x)}) > 0 THEN {some(l, x)} ELSE ['{mixed}'] END AS i2,
        CASE WHEN len({some(u)}) = 0 AND coalesce({u}.lo, 'USD') = 'USD' THEN NOT ({u}.v <= 900000) END AS a3, CASE WHEN len({some(u)}) > 0 THEN {some(u)} ELSE ['{mixed}'] END AS i3 FROM per),
    told AS (SELECT *, len(i0) = 0 AS known, CASE WHEN len(i0) > 0 OR a1 IS NULL THEN NULL WHEN a1 THEN true WHEN a2 IS NULL THEN NULL WHEN NOT a2 THEN false ELSE a3 END AS broken,
        CASE WHEN len(i0) > 0 THEN i0 WHEN a1 IS NULL THEN ['{mixed}'] WHEN a1 THEN [] WHEN a2 IS NULL THEN i2 WHEN NOT a2 THEN [] WHEN a3 IS NULL THEN i3 ELSE [] END AS issues FROM arms)
    SELECT scenario_id || ':COMPOUND' AS definition_id, scenario_id, CASE WHEN broken IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, CASE WHEN broken THEN 'BREACH' WHEN NOT broken THEN 'COMPLIANT' END AS compliance, 'ALWAYS' AS activation,
           CASE WHEN known THEN own END AS currency, CASE WHEN known THEN round(v, 6) END AS actual, array_to_string(issues, ',') AS issues FROM told"""


_CLAUSES = (("6.1", "INTEREST_COVER_RATIO"), ("6.2", "MAX_CAPEX"), ("6.3", "CAPITAL_INTENSITY_RATIO"))
SQL |= {
    "c13_f7_coverage": f"WITH {_COVERED} SELECT definition_id, scenario_id, slot, category, source, status, reason_code, n AS matching_input_count FROM cov",
    "f6_readiness": f"""WITH {_COVERED}, r AS (SELECT definition_id, scenario_id, coalesce(array_to_string(list_sort(list(DISTINCT category || ':' || reason_code) FILTER (WHERE status = 'UNRESOLVED')), ','), '') AS unresolved FROM cov GROUP BY ALL)
        SELECT definition_id, scenario_id, CASE WHEN unresolved = '' THEN 'READY' ELSE 'UNRESOLVED' END AS status, CASE WHEN unresolved = '' THEN 'OK' ELSE 'UNRESOLVED_INPUT' END AS reason_code, unresolved FROM r""",
    "e4_e5_compound": _compound(),
    "k10_compiled_clauses": f"WITH {SLOTS}, {_PER} " + " UNION ALL ".join(f"SELECT scenario_id || ':{k}' AS definition_id, {_SHOWN.removeprefix('definition_id, ')} FROM ({_family(f)})" for k, f in _CLAUSES),
}

# Chunks: the last paragraph, line, sentence or word end in a window, else its end

_CHUNKS = r"""RECURSIVE c AS (
  SELECT doc_id, t, 0 AS ordinal, 0 AS a, CASE WHEN length(t) > 4000 THEN NULL ELSE length(t) END AS b FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, CASE WHEN b IS NULL THEN ordinal ELSE ordinal + 1 END, CASE WHEN b IS NULL THEN a ELSE least(greatest(b - 120, a + 1), b) END,
         CASE WHEN b IS NULL THEN a + cut ELSE CASE WHEN length(t) - least(greatest(b - 120, a + 1), b) > 4000 THEN NULL ELSE length(t) END END
  FROM (SELECT *, CASE WHEN para > 0 THEN para WHEN line > 0 THEN line WHEN sentence > 0 THEN sentence WHEN word > 0 THEN word ELSE 4000 END AS cut FROM (
    SELECT *, length(regexp_extract(w, '(?s)^(.+\n\n)', 1)) AS para, length(regexp_extract(w, '(?s)^(.+\n)', 1)) AS line,
           length(regexp_extract(w, '(?s)^(.+[.!?;…])(?:\s.*)?$', 1)) AS sentence, length(regexp_extract(w, '(?s)^(.+\s)', 1)) AS word
    FROM (SELECT *, CASE WHEN b IS NULL THEN substr(t, a + 1, 4000) ELSE '' END AS w FROM c)))
  WHERE b IS NULL OR b < length(t)),
chunks AS (SELECT doc_id AS document_id, ordinal, a AS char_start, b AS char_end, CAST(ceil((b - a) / 4) AS INT) AS tokens FROM c WHERE b IS NOT NULL)"""
SQL |= {
    "n14_chunks": f"WITH {_CHUNKS} SELECT * FROM chunks",
    "f12_chunk_manifest": f"""WITH {_CHUNKS}, p AS (SELECT document_id, count(*) AS n, sum(char_end - char_start) AS chars, sha256(string_agg(sha256(document_id || '|' || ordinal || '|' || char_start || '|' || char_end), '' ORDER BY ordinal)) AS h FROM chunks GROUP BY ALL)
        SELECT count(*) AS documents, sum(n)::BIGINT AS chunks, sum(chars)::BIGINT AS chars, sum(('0x' || substr(h, 1, 12))::BIGINT::HUGEINT)::VARCHAR AS digest_sum FROM p""",
}

# Facts that report pages state: the six bodies and what each says

SQL["n26_n38_facts"] = """
WITH o AS (SELECT o_orderkey::VARCHAR AS d, o_orderkey % 6 AS k, 'TXN-N' || (o_custkey % 25) || '-' || o_orderkey || '-1' AS txn, o_totalprice::DECIMAL(18,2)::DOUBLE AS v FROM orders),
f AS (
  SELECT d, 'RECLASSIFICATION' AS fact_kind, txn, NULL AS name, NULL::DOUBLE AS amount, NULL::DOUBLE AS percent, 'ACCEPTED' AS disposition, NULL AS status FROM o WHERE k = 0
  UNION ALL SELECT d, 'RELATED_PARTY_THRESHOLD', NULL, NULL, NULL, 25, NULL, NULL FROM o WHERE k = 1
  UNION ALL SELECT d, 'AMOUNT_CORRECTION', txn, NULL, v, NULL, NULL, NULL FROM o WHERE k = 2
  UNION ALL SELECT d, 'OFF_LEDGER_AMOUNT', NULL, NULL, v, NULL, NULL, NULL FROM o WHERE k = 3
  UNION ALL SELECT d, 'PERIOD', txn, NULL, NULL, NULL, 'EXCLUDE', NULL FROM o WHERE k = 4
  UNION ALL SELECT d, 'SUBSIDIARY_STATUS', NULL, 'Aktau Trade LLP', NULL, NULL, NULL, 'UNRESTRICTED' FROM o WHERE k = 5
  UNION ALL SELECT d, 'OWNERSHIP', NULL, 'Borat Steel JSC', NULL, 41.5, NULL, NULL FROM o WHERE k = 5)
SELECT d AS document_id, fact_kind, txn AS transaction_id, name AS entity_name, amount, percent, disposition, status, 'ACCEPTED' AS reason FROM f"""

SQL["r12_hybrid"] = f"""WITH {_POSTS},
lexical AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM sc QUALIFY p <= 50),
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), asked AS (SELECT item_id AS query_id, v FROM benchmark JOIN e ON e.id = item_id WHERE item_id % 50 = 0),
vector AS (SELECT query_id, e.id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(e.v, a.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(a.v, a.v))) DESC, e.id) AS p FROM asked a CROSS JOIN e QUALIFY p <= 50),
every AS (SELECT * FROM lexical WHERE query_id IN (SELECT query_id FROM asked) UNION ALL SELECT * FROM vector),
fused AS (SELECT query_id, id, sum(1.0 / (60 + p)) AS score FROM every GROUP BY ALL)
SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10"""


# Profiles: one pass per column


def _profile(source: str, columns: dict[str, str], prefix: str = "") -> str:
    parts = [f"SELECT '{c}' AS column_name, {k} AS position, ({e})::VARCHAR AS value FROM {source}" for k, (c, e) in enumerate(columns.items())]
    cut = lambda x: f"CASE WHEN length({x}) > 80 THEN substr({x}, 1, 79) || '…' ELSE {x} END"
    return f"""WITH {prefix} cells AS ({' UNION ALL '.join(parts)}),
    kinds AS (SELECT column_name, position, value, value IS NOT NULL AND trim(value) <> '' AS filled, trim(value) AS s, lower(trim(value)) AS low, replace(trim(value), ',', '') AS bare FROM cells),
    typed AS (SELECT *, CASE WHEN NOT filled THEN NULL WHEN low IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'BOOLEAN' WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN 'INTEGER'
        WHEN regexp_full_match(bare, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CASE WHEN regexp_matches(s, '[.,]') THEN 'DECIMAL' ELSE 'INTEGER' END
        WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z?') THEN 'DATETIME' WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'DATE' ELSE 'STRING' END AS kind FROM kinds),
    per AS (SELECT column_name, position, count(*) AS rows, count(*) FILTER (WHERE NOT filled) AS nulls, count(DISTINCT value) FILTER (WHERE filled) AS distinct_values, min(value) FILTER (WHERE filled) AS lo, max(value) FILTER (WHERE filled) AS hi, list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)) AS ks FROM typed GROUP BY ALL)
    SELECT column_name, position, rows, nulls, distinct_values, {cut('lo')} AS least, {cut('hi')} AS greatest,
           CASE WHEN coalesce(len(ks), 0) = 0 THEN 'NULL' WHEN len(ks) = 1 THEN ks[1] WHEN ks = ['DECIMAL', 'INTEGER'] THEN 'DECIMAL' WHEN ks = ['DATE', 'DATETIME'] THEN 'DATETIME' ELSE 'MIXED' END AS type FROM per""".replace("\\\\", "\\")


_LEDGER_COLUMNS = ("row_index", "txn_id", "date", "account_id", "counterparty", "description", "amount", "currency")
SQL["f11_profile_ledger"] = _profile("ledger", {c: c for c in _LEDGER_COLUMNS}, f"{LEDGER},")
SQL["f11_profile"] = _profile("orders", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority": "o_orderpriority"})

# Evidence of monthly sums, and the transactions behind each number

_PLAIN = "('CAPEX'), ('LABOR'), ('UTILITIES'), ('TAXES'), ('OPEX'), ('INSURANCE_PREMIUMS'), ('INTEREST_EXPENSE'), ('LEASE_PAYMENTS')"


def _monthly(rows: str, named: str) -> str:
    """What each transaction adds to each monthly sum, and sums that no row without a day leaves open and one currency holds."""
    return f"""
    {named}x AS (SELECT scenario_id, k, strftime(day, '%Y-%m') AS m, txn_id, sum(amount) AS a, count(*) AS n, min(currency) AS lo, max(currency) AS hi FROM {rows} CROSS JOIN (VALUES {_PLAIN}) w(k)
        WHERE list_contains(members, k) AND day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL),
    {named}u AS (SELECT DISTINCT scenario_id, k FROM {rows} CROSS JOIN (VALUES {_PLAIN}) w(k) WHERE list_contains(members, k) AND day IS NULL)"""


_FLIPPED = "HAVING count(*) = 1"
_CORRECTED_INPUTS = f"""
done AS (SELECT txn, k, n, v FROM (SELECT f.txn, f.fact_kind AS k, count(DISTINCT f.amount) AS n, min(f.amount) AS v FROM facts f JOIN links l ON trim(l.txn_id) = f.txn AND l.scenario_id = f.scenario_id GROUP BY ALL)),
changed AS (SELECT r.* REPLACE (CASE WHEN k = 'RECLASSIFICATION' THEN 'CAPEX' ELSE category END AS category,
                CASE WHEN k = 'AMOUNT_CORRECTION' THEN CASE WHEN coalesce(source_amount < 0, category NOT IN {_INFLOW}, false) THEN -v ELSE v END ELSE source_amount END AS source_amount)
            FROM rows_ r LEFT JOIN done ON txn = txn_id WHERE coalesce(k, '') NOT IN ('TREATMENT', 'PERIOD') AND NOT (coalesce(k, '') = 'AMOUNT_CORRECTION' AND n > 1)),
after_ AS (SELECT txn_id, r.scenario_id, currency, day,
               list_filter([category, CASE WHEN category = 'LEASE_PAYMENTS' AND {has('description', rules.PROPERTY_RENT)} THEN 'RENT' END, CASE WHEN category IN ('CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS', 'CAPITAL_ASSET_TRANSFER') THEN 'CAPEX' END], lambda m: m IS NOT NULL) AS members,
               CASE WHEN category IN {_INFLOW} THEN source_amount ELSE -source_amount END AS amount
           FROM changed r WHERE scenario_id IS NOT NULL AND class_status <> 'CONFLICT' AND category IS NOT NULL AND source_amount IS NOT NULL),
before_ AS (SELECT * FROM inputs WHERE txn_id IN (SELECT txn FROM done))"""
SQL["r2_w9_evidence"] = f"""WITH {INPUTS}, {_monthly('inputs', '')},
    s AS (SELECT *, sum(a) OVER p AS total, min(lo) OVER p AS l, max(hi) OVER p AS h FROM x ANTI JOIN u USING (scenario_id, k) WINDOW p AS (PARTITION BY scenario_id, k, m)),
    f AS (SELECT * FROM s WHERE l = h AND l = 'USD' AND (total <= 60000) <> (total - a <= 60000))
    SELECT scenario_id || ':' || k || ':' || m AS definition_id, min(txn_id) AS txn_id, 'ABSENCE' AS kind FROM f GROUP BY scenario_id, k, m {_FLIPPED}"""
SQL["r2_r4_treatment"] = f"""WITH {INPUTS}, {_FACTS.removeprefix(LINKS + ',')}, {_CORRECTED_INPUTS}, {_monthly('after_', '')}, {_monthly('before_', 'b')},
    months AS (SELECT strftime(d, '%Y-%m') AS m FROM generate_series(DATE '1997-01-01', DATE '1998-12-01', INTERVAL 1 MONTH) t(d)),
    cell AS (SELECT scenario_id, k, m, sum(a) AS total, min(lo) AS l, max(hi) AS h FROM x GROUP BY ALL),
    whole AS (SELECT sc.scenario_id, w.k, mo.m, coalesce(total, 0) AS total FROM universe sc CROSS JOIN (VALUES {_PLAIN}) w(k) CROSS JOIN months mo LEFT JOIN cell c ON c.scenario_id = sc.scenario_id AND c.k = w.k AND c.m = mo.m
              WHERE (l IS NULL OR (l = h AND l = 'USD')) AND NOT EXISTS (SELECT 1 FROM u WHERE u.scenario_id = sc.scenario_id AND u.k = w.k)),
    gone AS (SELECT scenario_id, k, m, min(txn_id) AS txn_id FROM whole JOIN x USING (scenario_id, k, m) WHERE (total <= 60000) <> (total - a <= 60000) GROUP BY ALL {_FLIPPED}),
    moved AS (SELECT scenario_id, k, m, txn_id, sum(a) AS a FROM (SELECT scenario_id, k, m, txn_id, a FROM x WHERE txn_id IN (SELECT txn_id FROM before_) UNION ALL SELECT scenario_id, k, m, txn_id, -a FROM bx) GROUP BY ALL),
    undone AS (SELECT scenario_id, k, m, min(txn_id) AS txn_id FROM whole JOIN moved USING (scenario_id, k, m) WHERE (total <= 60000) <> (total - a <= 60000) GROUP BY ALL {_FLIPPED})
    SELECT scenario_id || ':' || k || ':' || m AS definition_id, coalesce(t.txn_id, g.txn_id) AS txn_id, CASE WHEN t.txn_id IS NOT NULL THEN 'TREATMENT' ELSE 'ABSENCE' END AS kind FROM undone t FULL JOIN gone g USING (scenario_id, k, m)"""
SQL["d24_contributing"] = f"""WITH {INPUTS}, sl(family, slot, category) AS (VALUES {_slot_rows()}), w AS (SELECT DISTINCT family, category AS k FROM sl)
    SELECT DISTINCT scenario_id || ':' || family AS definition_id, txn_id AS transaction_id FROM inputs JOIN w ON {match('w.k')} WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"""

# Spans, metadata, tables of documents, counters and traces

_TXN_SPANS = f"""{LEDGER}, k AS (SELECT o_orderkey, 'TXN-N1-' || o_orderkey || '-1' AS one, 'TXN-N2-' || o_orderkey || '-2' AS two, 'TXN-N3-' || o_orderkey AS three, length('TXN-N1-' || o_orderkey || '-1') AS n FROM orders),
named AS (SELECT o_orderkey, one AS txn_id, 4 AS char_start, false AS reversed FROM k UNION ALL SELECT o_orderkey, two, n + 7, false FROM k UNION ALL SELECT o_orderkey, three, 2 * n + 13, false FROM k UNION ALL SELECT o_orderkey, one, 3 * n + 13, true FROM k),
spans AS (SELECT o_orderkey, char_start::INT AS char_start, (char_start + length(txn_id))::INT AS char_end, txn_id, reversed FROM named WHERE txn_id IN (SELECT trim(txn_id) FROM ledger))"""
_ACCOUNT_SPANS = """o AS (SELECT o_orderkey, 'acc-' || o_custkey AS a, 'ACC-' || (o_custkey + 7) || '-8' AS b, 'ACC-' || (o_custkey + 7) AS c FROM orders),
s AS (SELECT o_orderkey, unnest([{'t': a, 's': 5}, {'t': b, 's': 5 + length(a) + 4}, {'t': 'ACC-X', 's': 5 + length(a) + 4 + length(b) + 4}, {'t': c, 's': 5 + length(a) + 4 + length(b) + 4 + 5 + 2}]) AS x FROM o),
spans AS (SELECT o_orderkey, x.s::INT AS char_start, (x.s + length(x.t))::INT AS char_end, x.t AS token, upper(x.t) AS account,
    CASE WHEN upper(x.t) IN (SELECT 'ACC-' || c_custkey FROM customer) THEN 'KNOWN' WHEN x.t = 'ACC-X' THEN 'MALFORMED' ELSE 'FAMILY' END AS status FROM s WHERE x.t LIKE 'ACC-%' OR upper(x.t) IN (SELECT 'ACC-' || c_custkey FROM customer))"""
_GRID = """l AS (SELECT l_orderkey AS table_id, l_linenumber AS n, l_linenumber || ' | ' || max(l_returnflag) || ' | ' || CASE WHEN max(l_partkey) % 3 > 0 THEN max(l_partkey)::VARCHAR ELSE '' END AS line FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _trace() -> str:
    """The steps of a sum, and of the greater of two: each set, its sum, the choice, the activation and, if there is a number, the threshold."""
    mixed = "MIXED_CURRENCY_NO_TRUSTED_CONVERSION"
    bad = lambda c: f"({c}.untold OR coalesce({c}.lo <> {c}.hi, false))"
    issue = lambda c: f"CASE WHEN {c}.untold THEN 'PERIOD_MEMBERSHIP_UNDECIDABLE' WHEN {c}.lo <> {c}.hi THEN '{mixed}' ELSE '' END"
    step = lambda name, k, kind, status, amount, currency, issues, qtype="MONEY", where="true": f"SELECT scenario_id || ':{name}' AS definition_id, {k} AS step, '{kind}' AS kind, {status} AS status, '{qtype}' AS qtype, {amount} AS amount, {currency} AS currency, {issues} AS issues FROM per WHERE {where}"
    of_set = lambda name, k, kind, c: step(name, k, kind, f"CASE WHEN {bad(c)} THEN 'UNRESOLVED' ELSE 'RESOLVED' END", f"CASE WHEN NOT {bad(c)} THEN round({c}.v, 4) END", f"CASE WHEN NOT {bad(c)} THEN {c}.lo END", issue(c))
    x, l, u = "m['CAPEX']", "m['LABOR']", "m['UTILITIES']"
    either, differ = f"({bad(l)} OR {bad(u)})", f"coalesce({l}.lo <> {u}.lo, false)"
    fine = f"NOT {either} AND NOT {differ}"
    both = f"array_to_string(list_sort(list_distinct(list_filter([{issue(l)}, {issue(u)}], lambda i: i <> ''))), ',')"
    one, two = "MAX_CAPEX", "MAX_SINGLE_OVERHEAD_LINE"
    always = lambda name, k: step(name, k, "always", "'RESOLVED'", "NULL", "NULL", "''", "BOOLEAN")
    return " UNION ALL ".join([
        of_set(one, 0, "transaction_set", x), of_set(one, 1, "sum", x), always(one, 2), step(one, 3, "constant", "'RESOLVED'", "4000000", "'USD'", "''", where=f"NOT {bad(x)}"),
        of_set(two, 0, "transaction_set", l), of_set(two, 1, "sum", l), of_set(two, 2, "transaction_set", u), of_set(two, 3, "sum", u),
        step(two, 4, "max", f"CASE WHEN {fine} THEN 'RESOLVED' ELSE 'UNRESOLVED' END", f"CASE WHEN {fine} THEN round(greatest({l}.v, {u}.v), 4) END", f"CASE WHEN {fine} THEN coalesce({l}.lo, {u}.lo) END", f"CASE WHEN {either} THEN {both} WHEN {differ} THEN '{mixed}' ELSE '' END"),
        always(two, 5), step(two, 6, "constant", "'RESOLVED'", "3000000", "'USD'", "''", where=fine),
    ])


SQL |= {
    "s19_txn_spans": f"WITH {_TXN_SPANS} SELECT o_orderkey, char_start, char_end, txn_id FROM spans",
    "s20_s21_txn_mentions": f"""WITH {_TXN_SPANS}, g AS (SELECT o_orderkey, txn_id, min(char_start) AS f, count(*) AS mentions FROM spans GROUP BY ALL) SELECT o_orderkey, txn_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY f) AS place, mentions FROM g""",
    "s22_txn_near_pattern": f"WITH {_TXN_SPANS} SELECT o_orderkey, char_start, char_end, txn_id FROM spans WHERE reversed",
    "s13_s16_s17_accounts": f"WITH {_ACCOUNT_SPANS} SELECT * FROM spans",
    "s18_prefix_collisions": "SELECT DISTINCT 'ACC-' || (o_custkey + 7) AS shorter, 'ACC-' || (o_custkey + 7) || '-8' AS longer FROM orders",
    "n9_metadata": """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS t, strftime(DATE '1997-01-01' + (p_partkey % 700)::INT, '%Y-%m-%d') AS day FROM part)
        SELECT k AS document_id, ['Loan Agreement no. LA-', 'Annual report RP-', 'KYC dossier '][t + 1] || k AS title, CASE WHEN t = 0 THEN 'LA-' || k END AS agreement_number, 'Version 2.' || (k % 4) AS version, CASE WHEN t = 1 THEN 'report RP-' || k END AS report_number,
               'Period ended 31 December 1997' AS period, day AS document_date, '31 December 1997' AS effective_date, NULL::VARCHAR AS execution_date, CASE WHEN t = 1 THEN day END AS report_date, CASE WHEN k % 2 = 0 THEN 'DRAFT' END AS finality_marker, CASE WHEN k % 5 = 0 THEN 'SUPERSEDED' END AS superseded_marker FROM p""",
    "s28_n41_markers": "SELECT p_partkey AS document_id, 'superseded' AS marker, 2 AS page_number, 18 AS char_start, 28 AS char_end, 'SUPERSEDED' AS quote, unnest(['banner', 'not negated']) AS accept FROM part WHERE p_partkey % 5 = 0",
    "n12_n40_borrowers": """WITH d AS (SELECT DISTINCT c_custkey % 700 AS a, 'client ' || (c_custkey % 900) || ' llp' AS identity FROM customer)
        SELECT 'N' || c_nationkey AS scenario_id, 'ACC-' || a AS account, array_to_string(list_sort(list(DISTINCT identity)), ',') AS identities, CASE WHEN count(DISTINCT identity) > 1 THEN 'CONFLICT' ELSE 'RESOLVED' END AS status FROM d JOIN customer ON c_custkey = a GROUP BY c_nationkey, a""",
    "n17_tables": f"""WITH {_GRID}, b AS (SELECT table_id, 'Columns: line | flag | part' || chr(10) || 'Row 0: line | flag | part' || chr(10) || string_agg('Row ' || n || ': ' || line, chr(10) ORDER BY n) AS body FROM l GROUP BY table_id)
        SELECT o_orderkey AS table_id, CASE WHEN body IS NULL AND o_orderkey % 2 = 1 THEN 'Table: ' || o_orderkey ELSE concat_ws(chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'Caption: Order ' || o_orderkey END, body) END AS text FROM orders LEFT JOIN b ON table_id = o_orderkey""",
    "n18_rows": f"""WITH {_GRID} SELECT table_id, n::INT AS row_index, 'Columns: line | flag | part' || chr(10) || 'Row ' || n || ': ' || line AS text FROM l UNION ALL SELECT DISTINCT table_id, 0, 'Row 0: line | flag | part' FROM l""",
    "f3_manifest": f"""{EVALUATED} SELECT count(*) AS results, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved, count(*) FILTER (WHERE status = 'UNRESOLVED') AS unresolved, count(*) FILTER (WHERE status = 'ERROR') AS errors, count(*) FILTER (WHERE status = 'NOT_ACTIVATED') AS not_activated,
        count(*) FILTER (WHERE compliance = 'COMPLIANT') AS compliant, count(*) FILTER (WHERE compliance = 'BREACH') AS breach FROM results""",
    "e14_trace": f"WITH {SLOTS}, {_PER} {_trace()}",
}
