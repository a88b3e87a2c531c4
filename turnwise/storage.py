"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session has none (tests on local[*]), one is made under the machine's temp folder and
    kept in the session; a session on a cluster must name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("turnwise.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="turnwise-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set("turnwise.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a table in shared storage: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
