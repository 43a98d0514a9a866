"""Sinks: Parquet and JSON lines, published by a rename so that readers see a whole output or the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def publish(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Write all tables below folder: staged beside it, then swapped in; the old output comes back if the swap fails."""
    spark = next(iter(tables.values())).sparkSession
    fs, path = _fs(spark, folder)
    stage, old = f"{folder.rstrip('/')}.stage-{uuid.uuid4().hex}", f"{folder.rstrip('/')}.old-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.format(form).save(f"{stage}/{name}")
    had = fs.exists(path(folder))
    if had and not fs.rename(path(folder), path(old)):
        raise OSError(f"cannot move {folder}")
    if not fs.rename(path(stage), path(folder)):
        if had:
            fs.rename(path(old), path(folder))
        raise OSError(f"cannot publish {folder}")
    if had:
        fs.delete(path(old), True)


def submission(cells: DataFrame, folder: str) -> None:
    """cells.jsonl, sorted, and unresolved.jsonl. A template has few cells: one file each."""
    row = F.to_json(F.struct("scenario_id", "clause_id", "status", F.col("actual").cast("string").alias("actual"), "evidence_txn_id"), {"ignoreNullFields": "false"}).alias("value")
    publish_text = lambda df, name: df.orderBy("scenario_id", "clause_id").coalesce(1).select(row).write.mode("overwrite").text(f"{folder}/{name}")
    publish_text(cells, "cells.jsonl")
    publish_text(cells.where("status is null"), "unresolved.jsonl")


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or partitioning."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    low = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), low(1).alias("a"), low(13).alias("b")).first()
    return f"{r['n']}-{r['a']}-{r['b']}"


def index(folder: str, chunks: DataFrame, posts: DataFrame, vectors: DataFrame | None = None) -> None:
    """A retrieval index: chunks, postings by term and vectors, published together."""
    parts = {"chunks": chunks, "postings": posts.repartitionByRange("term")}
    publish(parts | ({"vectors": vectors} if vectors is not None else {}), folder)
