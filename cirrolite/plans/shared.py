"""The folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; under a temporary one where the session names none (local runs only)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_cirrolite_work", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = spark._cirrolite_work = tempfile.mkdtemp(prefix="cirrolite-")
    return f"{base.rstrip('/')}/cirrolite-run-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a new folder that all executors see."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
