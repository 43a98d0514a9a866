"""Source files: ledgers, templates, archives and manifests, read by Spark."""

from __future__ import annotations

import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What the columns of a ledger are called.
ALIASES = {
    "txn_id": ("txn_id", "transaction_id", "transaction id", "txn id", "transactionid"),
    "date": ("date", "transaction_date", "transaction date", "txn_date", "posting_date"),
    "account_id": ("account_id", "account id", "account", "account_code", "account code"),
    "counterparty": ("counterparty", "counter_party", "vendor", "customer", "контрагент"),
    "description": ("description", "details", "narrative", "memo", "описание", "назначение"),
    "amount": ("amount", "value", "transaction_amount", "transaction amount", "сумма"),
    "currency": ("currency", "ccy", "currency_code", "currency code", "валюта"),
}
REQUIRED = ("txn_id", "date", "account_id", "counterparty", "amount", "currency")


def header(columns: list[str]) -> dict[str, str]:
    """field -> column; a field that two columns name, or a required one that none does, is an error."""
    out = {}
    for field, names in ALIASES.items():
        found = [c for c in columns if c.replace("﻿", "").strip().lower() in names]
        if len(found) > 1:
            raise ValueError(f"{field} is named by several columns: {found}")
        if found:
            out[field] = found[0]
    missing = [f for f in REQUIRED if f not in out]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return out


def sniff(first_line: str) -> str:
    """The delimiter that occurs most in a header line."""
    return max((",", ";", "\t", "|"), key=lambda d: (first_line.count(d), -",;\t|".index(d)))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger file, by its suffix. row_index counts all body rows in file order, blank ones too; those are dropped."""
    return ledger_xlsx(spark, path) if path.lower().endswith((".xlsx", ".xlsm")) else ledger_csv(spark, path)


def ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path).limit(1).collect()[0][0]
    raw = spark.read.csv(path, header=True, sep=sniff(first), quote='"', escape='"', multiLine=True, inferSchema=False, encoding="UTF-8")
    rows = raw.withColumn("_at", F.monotonically_increasing_id())  # one file, read in order by one task: multi-line quotes can't be split
    return _named(rows, header([c for c in raw.columns]))


def _named(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    text = lambda f: F.coalesce(F.col(f"`{fields[f]}`").cast("string"), F.lit("")) if f in fields else F.lit("")
    out = rows.select(F.col("_at").alias("row_index"), *[text(f).alias(f) for f in ALIASES])
    return out.where(F.concat(*[F.trim(f) for f in ALIASES]) != "")


def ledger_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The active sheet's values; needs openpyxl on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import openpyxl

        for batch in batches:
            for content in batch.content:
                rows = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True).active.iter_rows(values_only=True)
                head = [str(c or "") for c in next(rows)]
                at = {f: head.index(n) for f, n in header(head).items()}
                out = [(i, *[("" if f not in at or r[at[f]] is None else str(r[at[f]])) for f in ALIASES]) for i, r in enumerate(rows)]
                yield pd.DataFrame(out, columns=["row_index", *ALIASES])

    got = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_index long, " + ", ".join(f"{f} string" for f in ALIASES))
    return got.where(F.concat(*[F.trim(f) for f in ALIASES]) != "")


def template(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, clause_id, ordinal) of a template's cells; ordinals number scenarios in code-point order."""
    text = spark.read.text(path, wholetext=True)
    shape = "struct<scenarios:map<string,struct<covenants:map<string,string>>>>"
    cells = text.select(F.from_json("value", shape).alias("j")).select(F.explode("j.scenarios").alias("scenario_id", "s")).select("scenario_id", F.explode_outer("s.covenants").alias("clause_id", "cell"))
    cells = cells.select(F.trim("scenario_id").alias("scenario_id"), F.trim("clause_id").alias("clause_id"))
    return cells.withColumn("ordinal", F.dense_rank().over(Window.orderBy("scenario_id")) - 1)


def template_faults(cells: DataFrame) -> DataFrame:
    """(kind, subject): empty names and repeated cells of a template."""
    empty = cells.where("coalesce(scenario_id, '') = '' or coalesce(clause_id, '') = ''").select(F.lit("EMPTY").alias("kind"), F.concat_ws("/", "scenario_id", "clause_id").alias("subject"))
    twice = cells.groupBy("scenario_id", "clause_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("DUPLICATE").alias("kind"), F.concat_ws("/", "scenario_id", "clause_id").alias("subject"))
    return empty.unionByName(twice)


def format_of(content: Column, path: Column) -> Column:
    """A file's format by its first bytes, else by its suffix."""
    head = F.hex(F.substring(content, 1, 8))
    low = F.lower(path)
    return (
        F.when(head.startswith("25504446"), "PDF")
        .when(head.startswith("504B0304"), F.when(low.endswith(".xlsx"), "XLSX").when(low.endswith(".docx"), "DOCX").otherwise("ZIP"))
        .when(head.startswith("89504E47") | head.startswith("FFD8FF"), "IMAGE")
        .when(low.endswith(".csv") | low.endswith(".tsv"), "CSV")
        .when(low.endswith(".jsonl"), "JSONL")
        .when(low.endswith(".json"), "JSON")
        .when(low.endswith(".txt") | low.endswith(".md"), "TXT")
        .otherwise("UNKNOWN")
    )


def member_path(raw: str, most: int = 240) -> str:
    """A safe relative path in NFC, or ValueError: nothing absolute, no drive, share or parent step, no control characters."""
    path = unicodedata.normalize("NFC", raw).replace("\\", "/")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or re.match(r"^[A-Za-z]:", path) or ".." in parts or not parts or re.search(r"[\x00-\x1f]", path) or len(path) > most:
        raise ValueError(f"unsafe path {raw!r}")
    return "/".join(parts)


def inventory(spark: SparkSession, path: str, most_bytes: int = 1 << 28, most_ratio: float = 200.0) -> DataFrame:
    """Members of zip archives: (archive, path, bytes, compressed, sha256, fault)."""
    shape = "archive string, path string, bytes long, compressed long, sha256 string, fault string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                out = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if m.is_dir():
                            continue
                        fault = digest = None
                        try:
                            safe = member_path(m.filename)
                        except ValueError:
                            safe, fault = m.filename, "UNSAFE_PATH"
                        if m.file_size > most_bytes:
                            fault = fault or "TOO_LARGE"
                        elif m.file_size / max(1, m.compress_size) > most_ratio:
                            fault = fault or "COMPRESSION_RATIO"
                        if fault is None:
                            digest = hashlib.sha256(z.read(m)).hexdigest()
                        out.append((name, safe, m.file_size, m.compress_size, digest, fault))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, shape)


def archive_faults(members: DataFrame, most_files: int = 10_000, most_total: int = 1 << 31) -> DataFrame:
    """(archive, kind, subject): repeated or case-colliding paths, too many files, too many bytes in all."""
    folded = members.groupBy("archive", F.lower("path").alias("subject")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("m")).where("n > 1")
    same = folded.select("archive", F.when(F.col("m") > 1, "CASE_COLLISION").otherwise("DUPLICATE_PATH").alias("kind"), "subject")
    size = members.groupBy("archive").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return same.unionByName(size.where(f"n > {most_files}").select("archive", F.lit("TOO_MANY_FILES").alias("kind"), F.col("n").cast("string").alias("subject"))).unionByName(
        size.where(f"b > {most_total}").select("archive", F.lit("TOO_MANY_BYTES").alias("kind"), F.col("b").cast("string").alias("subject"))
    )


def verified(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """manifest (path, bytes, sha256) -> with state OK, MISSING, SIZE or DIGEST of the files in folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = read.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.length("content").alias("found_bytes"), F.sha2("content", 256).alias("found"))
    out = manifest.join(files, "path", "left")
    return out.select("path", F.when(F.col("found").isNull(), "MISSING").when(F.col("found_bytes") != F.col("bytes"), "SIZE").when(F.col("found") != F.col("sha256"), "DIGEST").otherwise("OK").alias("state"))


def allowed(paths: DataFrame, banned: DataFrame) -> DataFrame:
    """paths that no entry of banned names."""
    return paths.join(banned.select("path"), "path", "left_anti")


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """(path, quarantined): JSON files that are shaped like an answer key."""
    from ..operators.profile import answer_key

    @F.pandas_udf("boolean")
    def shaped(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> bool:
            try:
                return answer_key(json.loads(raw))
            except ValueError:
                return False

        return content.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith(".json")).select("path", shaped("content").alias("quarantined"))
