"""Windows over radials, events, samples and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import running_sums

#: Radial states that begin a sweep.
SWEEP_STARTS = (0, 3, 5, 80, 83, 85)


def sweeps(radials: DataFrame) -> DataFrame:
    """Adds radial_seq (from 1 in each volume) and sweep (from 1): a start state or another elevation begins a new one."""
    by = Window.partitionBy("volume_id").orderBy("radial_key")
    new = F.coalesce(F.col("radial_status").isin(*SWEEP_STARTS) | (F.lag("elevation_number").over(by) != F.col("elevation_number")), F.lit(False)) | F.lag("elevation_number").over(by).isNull()
    rows = radials.withColumn("radial_seq", F.row_number().over(by).cast("bigint")).withColumn("new", new.cast("bigint"))
    return rows.withColumn("sweep", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def order_violations(events: DataFrame, *key: str) -> DataFrame:
    """Events whose ticks lie below those of the event before them with the same key."""
    by = Window.partitionBy(*key).orderBy("event_seq")
    return events.withColumn("previous_ticks", F.lag("message_ticks").over(by)).filter(F.col("message_ticks") < F.col("previous_ticks"))


def payload_offsets(events: DataFrame) -> DataFrame:
    """Where each event's payload begins in its batch: the sum of the lengths before it."""
    by = Window.partitionBy("batch_seq").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("payload_offset", F.coalesce(F.sum("gate_count").over(by), F.lit(0)))


def rolling_pressure(samples: DataFrame, key: str, seq: str, score: str, size: int = 8, least: int = 3) -> DataFrame:
    """Adds the mean score of the last `size` samples, their number and whether they are enough."""
    by = Window.partitionBy(key).orderBy(seq).rowsBetween(1 - size, 0)
    return samples.withColumn("samples", F.count("*").over(by)).withColumn("mean_score", F.avg(score).over(by)).withColumn("eligible", F.col("samples") >= least)


def capped_prefix(files: DataFrame, order: list[str], most_files: int, most_bytes: int) -> DataFrame:
    """Files in order, with their number and bytes so far, until a limit would be passed; nothing after that file. Sizes are not negative, so the sums say where that is."""
    rows = running_sums(files, order, {"n": F.lit(1), "total_bytes": F.col("size_bytes")})
    return rows.filter((F.col("n") <= most_files) & (F.col("total_bytes") <= most_bytes))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter("_rank = 1").drop("_rank")


def released(deltas: DataFrame, key: str = "handler", seq: str = "sequence", first: int = 0) -> DataFrame:
    """Adds released: whether all sequences from `first` up to this one have arrived."""
    by = Window.partitionBy(key).orderBy(seq)
    return deltas.withColumn("released", F.col(seq) - first == F.dense_rank().over(by) - 1)


def blocking(deltas: DataFrame, key: str = "handler", seq: str = "sequence", first: int = 0) -> DataFrame:
    """Per key: how many deltas are released and the first sequence that is missing."""
    r = released(deltas, key, seq, first)
    return r.groupBy(key).agg(F.count_if("released").alias("released"), F.count_if(~F.col("released")).alias("waiting"), (F.coalesce(F.max(F.when(F.col("released"), F.col(seq))) + 1, F.lit(first))).cast("bigint").alias("blocking_sequence"))


def running_values(values: DataFrame) -> DataFrame:
    """Running sum per source and field after each delta."""
    by = Window.partitionBy("source_id", "field").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("running", F.sum("value").over(by))
