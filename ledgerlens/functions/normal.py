"""Text normalisation that Spark has no function for: Unicode forms, mojibake and offsets, as Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1251, read again; unchanged unless the whole text turns and Cyrillic letters result."""
    if not re.search(r"[РС][Ѐ-ӿ°-¿]", text):
        return text
    try:
        again = text.encode("cp1251").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text
    return again if re.search(r"[а-яё]", again, re.IGNORECASE) else text


@F.pandas_udf(T.StringType())
def mojibake(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else repaired(x))


def squeezed(text: str) -> tuple[str, list[int]]:
    """text with runs of white space as one space, and the offset in text of each character left."""
    out, at, gap = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(" ")
            at.append(i - 1)
            gap = False
        out.append(c)
        at.append(i)
    return "".join(out), at
