"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracle import SQL
from .queries import QUERIES

ORACLE_SQL: dict[str, str] = {name: SQL[name] for name in QUERIES if name in SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of all formula families for all scenarios."""
    return QUERIES["e13_evaluate"](spark, sf_dir)
