"""Helpers that several operators share: the shared folder, packed shuffles, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one named by spark.checkpoint.dir. Only a local session may do without that setting: it takes a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_cirrolite_shared", None)
        if base is None:
            base = spark._cirrolite_shared = tempfile.mkdtemp(prefix="cirrolite-")
    return f"{base.rstrip('/')}/cirrolite-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(rows: DataFrame, row_bytes: int = 16, most_bytes: int = 8 << 20) -> DataFrame:
    """rows (a written table), to be broadcast if all of them take at most most_bytes; else a join with them shuffles."""
    return F.broadcast(rows) if rows.count() * row_bytes <= most_bytes else rows


def without(rows: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """rows whose id is not in ids; ids reach the tasks by broadcast while they are few, else by a shuffle."""
    return rows.join(small(written(ids.select(id).distinct())), id, "left_anti")


def tagged(rows: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """rows (id, text) with a tag, so that id and tag name a text: 0 where the id has one text, a hash of the text where it has several or is null.

    Rows without id are so dealt by their texts in a shuffle by both. Ids with several texts are broadcast while they are few; if they aren't, all rows have their text's hash.
    """
    name = F.xxhash64(F.coalesce("text", F.lit("")))
    by_id = rows.filter("id is not null").select("id", name.alias("name")).groupBy("id").agg(F.min("name").alias("low"), F.max("name").alias("high"))
    several = written(by_id.filter("low < high").select("id", F.lit(True).alias("several")))
    n = several.count()
    if 24 * n > most_bytes:
        return rows.withColumn("tag", name)
    if not n:
        return rows.withColumn("tag", F.when(F.col("id").isNull(), name).otherwise(0))
    marked = rows.join(F.broadcast(several), "id", "left")
    return marked.withColumn("tag", F.when(F.col("id").isNull() | F.col("several"), name).otherwise(0)).drop("several")


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of texts of at most `size` bytes: a task holds a few of them at a time. A smaller setting is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if not 0 < now <= size:
        spark.conf.set(key, str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string or binary column as bytes."""
    for v in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield v.as_py()


# ---- packed shuffles: many small fixed-size entries travel as one binary per shard ----

PACKED = "shard int, entries binary"


def pack(entries: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """One row per shard that has entries, which lie column by column in it: that compresses better on its way."""
    order = np.argsort(shard, kind="stable")
    entries, shard = entries[order], shard[order].astype(np.int32)
    at = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else [0]
    blobs = [b"".join([entries[n][a:b].tobytes() for n in entries.dtype.names]) for a, b in zip(at, at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(shard[at[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "entries"])


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> dict[int, np.ndarray]:
    """The entries that reached this task, by shard."""
    found: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for s, blob in zip(b.column("shard").to_pylist(), buffers(b.column("entries"))):
            n, at = len(blob) // dtype.itemsize, 0
            e = np.empty(n, dtype)
            for name in dtype.names:
                e[name] = np.frombuffer(blob, dtype[name], n, at)
                at += n * dtype[name].itemsize
            found.setdefault(s, []).append(e)
    return {s: np.concatenate(found.pop(s)) for s in sorted(found)}


def dealt(packed: DataFrame, shards: int) -> DataFrame:
    """One task per shard."""
    return packed.repartitionById(shards, "shard")


# ---- connected components ----


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges(a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond"): each is one group-by with map-side minima and one join, a logarithmic number of rounds in
    practice, and no group is ever gathered, so a component may be of any size.
    """
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    last = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node link to the smallest one around it
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        large = written(large)
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        e = low.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = written(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
