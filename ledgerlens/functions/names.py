"""Legal names: a key that keeps the legal form, a key without it, and the form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms and the class each belongs to.
FORMS = {"jsc": "jsc", "ao": "jsc", "ао": "jsc", "llp": "llp", "llc": "llc", "too": "too", "тоо": "too", "inc": "inc", "ltd": "ltd", "gmbh": "gmbh"}
_QUOTES = "\u2018\u2019\u201c\u201d\u00ab\u00bb\u201e\u201f\"'`"
_MARK = "\ue000"


def tokens(raw: Column) -> Column:
    """Lower-cased tokens without quotes; punctuation ends a token; dotted forms are compact; a legal form is named by its class."""
    plain = F.translate(F.lower(F.trim(raw)), _QUOTES, "")
    compact = F.regexp_replace(plain, r"\b(l)\.\s*(l)\.\s*(p|c)\.?", "$1$2$3")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(compact, r"\s*([,;:!/\\|&+])\s*", " "), r"\s+", " "))
    cleaned = F.filter(F.transform(F.split(spaced, " "), lambda x: F.regexp_replace(x, r"\.+$", "")), lambda x: x != "")
    form = F.create_map(*[F.lit(v) for kv in FORMS.items() for v in kv])
    last, first = F.try_element_at(cleaned, F.lit(-1)), F.try_element_at(cleaned, F.lit(1))
    n = F.size(cleaned)
    rest = F.when(F.element_at(form, last).isNotNull() & (n > 1), F.concat(F.slice(cleaned, F.lit(1), n - 1), F.array(F.element_at(form, last))))
    return rest.when(F.element_at(form, first).isNotNull() & (n > 1), F.concat(F.slice(cleaned, F.lit(2), n - 1), F.array(F.element_at(form, first)))).otherwise(cleaned)


def identity_key(raw: Column) -> Column:
    return F.array_join(tokens(raw), " ")


def is_form(word: Column) -> Column:
    return word.isin(*set(FORMS.values()))


def legal_form(raw: Column) -> Column:
    last = F.try_element_at(tokens(raw), F.lit(-1))
    return F.when(is_form(last), last)


def base_key(raw: Column) -> Column:
    t = tokens(raw)
    return F.array_join(F.when(legal_form(raw).isNotNull(), F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t), " ")


def damaged(raw: Column) -> Column:
    return raw.contains("?") | raw.contains("\ufffd")


def masked(raw: Column) -> Column:
    """A damaged name with its marks of damage as one character that is part of a word."""
    return F.translate(raw, "?\ufffd", _MARK * 2)


def may_be(damaged_name: Column, candidate: Column) -> Column:
    """Whether candidate may be the damaged name: same form, as many tokens, equal where no mark of damage stands, at least one mark."""
    hidden = masked(damaged_name)
    a, b = tokens(hidden), tokens(candidate)
    same = F.forall(F.zip_with(a, b, lambda x, y: x.contains(_MARK) | (x == y)), lambda ok: F.coalesce(ok, F.lit(False)))
    return damaged(damaged_name) & legal_form(candidate).isNotNull() & legal_form(hidden).eqNullSafe(legal_form(candidate)) & (F.size(a) == F.size(b)) & same


def hidden_places(damaged_name: Column) -> Column:
    """Which tokens of a damaged name have a mark of damage: an array of booleans."""
    return F.transform(tokens(masked(damaged_name)), lambda x: x.contains(_MARK))


def open_key(words: Column, places: Column) -> Column:
    """tokens() as one text in which those at hidden places are the same mark. A damaged name and a candidate with a legal form have equal
    keys at the damaged name's places exactly if may_be()."""
    return F.array_join(F.zip_with(words, places, lambda x, hidden: F.when(hidden, F.lit(_MARK)).otherwise(x)), " ")


def account_key(raw: Column) -> Column:
    return F.upper(F.trim(raw))


def meaningful(raw: Column) -> Column:
    """Whether a name says more than a legal form: two letters or digits are left of it without quotes, punctuation and form."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"""^[\s"'«„“,.;:]+|[\s"'»“”,.;:]+$""", "")
    base = F.regexp_replace(bare, r"(?i)(^|[\s,.]+)(LLP|JSC|Inc\.?|LLC|Ltd\.?|PLC|GmbH|ТОО|АО|AO|ООО|TOO|ZAO|ЗАО|ПАО|PAO)\s*$", "")
    return F.length(F.regexp_replace(base, r"[^\p{L}\p{N}_]", "")) >= 2
