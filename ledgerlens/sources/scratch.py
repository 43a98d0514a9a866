"""Tables written once to the folder that all executors share, where a plan reads something several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named, a local master gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    out = f"{root(spark)}/ledgerlens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def written(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write df once and read it back: its lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = at or path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)
