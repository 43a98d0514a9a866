"""Helpers that several corpus operators use: scratch tables, text defaults, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import path as scratch_path
from ..sources.scratch import written as cut

__all__ = ["components", "cut", "drop_path", "or_empty", "scratch_path", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) as (node, root), root being the least node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the
    edges are disjoint stars. Each step is one minimum per node and one join on a
    written table, so a hub of any degree is a splittable skewed join, never one task.
    Nodes without an edge to another node are not returned.
    """

    def least_of(links: DataFrame, keep: str) -> DataFrame:
        return cut(links.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low") if keep == "large" else F.col("low")), "low")

    now = cut(
        edges.where("a <> b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # a star forest: every child has one parent, and no parent is a child
        several = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chained = now.select("b").join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).select(F.lit(0).alias("a"), F.lit(0).alias("n"))
        if not several.unionByName(chained).take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = cut(
            both.join(least_of(both, "large"), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(),
            "large",
        )
        low = least_of(now, "small")
        joined = now.join(low, "a")
        now = cut(
            joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
            .distinct(),
            "small",
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
