"""Small helpers for stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free hash of all columns, by name."""
    cols = sorted(df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols]).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], str(r["h"])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    fs, place = _place(spark, path)
    return fs.exists(place)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path, on any file system that Spark reads; none if there is no such path."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.delete(place, True)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that must not be there yet; False if it is."""
    from py4j.protocol import Py4JJavaError

    fs, place = _place(spark, path)
    try:
        out = fs.create(place, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
