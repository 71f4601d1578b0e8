"""Streams over folders of batches, and the ordered merging of deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.history import exists, folders


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet batches as a stream, oldest files first."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").parquet(path)


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, in as many micro-batches as the source makes."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _summed(rows: DataFrame) -> DataFrame:
    by = [c for c in ("handler", "source_id", "field", "type") if c in rows.columns]
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("value", "int64_value", "double_value") if c in rows.columns])


def delta_merger(folder: str) -> Callable[[DataFrame, int], None]:
    """Merges deltas (handler, sequence, delta_id, source_id, field, value, content; or type, int64_value and double_value in place of value), one epoch a trigger, in each handler's order of sequence from 0 on.

    A delta that was delivered before with the same content is a no-op, one with other content is kept under rejected/. Accepted deltas wait until all sequences before theirs are there: each
    trigger moves the handlers' cursors over the newly gap-free prefix, writes what that prefix adds (applied/, a row per handler, source and field that it touches)
    and keeps the rest under pending/. So a trigger writes what arrived and what it released, not what was merged before. The files of an epoch are written anew if it runs again;
    cursors/ comes last and makes the epoch count. An epoch whose predecessor has no cursors is an error.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        if epoch and not exists(spark, f"{folder}/cursors/epoch={epoch - 1}/_SUCCESS"):
            raise ValueError(f"epoch {epoch - 1} was never merged in {folder}")

        def before(name: str, empty: DataFrame) -> DataFrame:
            return spark.read.schema(empty.schema).parquet(f"{folder}/{name}/epoch={epoch - 1}") if epoch else empty.limit(0)

        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(path := f"{folder}/{name}/epoch={epoch}")
            return spark.read.schema(df.schema).parquet(path)

        by = ["handler", "sequence"]
        ledger = rows.select(*by, F.col("content").alias("stored")).distinct()
        known = spark.read.schema(ledger.schema.add("epoch", "long")).parquet(f"{folder}/ledger").filter(F.col("epoch") < epoch).drop("epoch") if epoch else ledger.limit(0)
        chosen = rows.groupBy(*by).agg(F.min("content").alias("chosen"))
        judged = rows.join(chosen.join(known, by, "left"), by)
        judged = judged.withColumn("status", F.when(F.col("stored").isNull() & (F.col("content") == F.col("chosen")), "Accepted").when(F.col("content") == F.coalesce("stored", "chosen"), "Duplicate").otherwise("Rejected"))
        new = put("arrived", judged.filter("status = 'Accepted'").select(*rows.columns).dropDuplicates())
        put("rejected", judged.filter("status = 'Rejected'").select(*rows.columns))
        put("ledger", new.select(*by, F.col("content").alias("stored")).distinct())

        # the cursors move over what is there without a gap; one small row per waiting delta
        cursors = rows.select("handler", F.col("sequence").alias("next")).limit(0)
        cursors = before("cursors", cursors)
        waiting = before("pending", rows).unionByName(new)
        ready = waiting.select(*by).distinct().join(cursors, "handler", "left").withColumn("next", F.coalesce("next", F.lit(0)).cast("bigint"))
        place = F.row_number().over(Window.partitionBy("handler").orderBy("sequence")) - 1 + F.col("next")
        moved = ready.withColumn("place", place).filter("sequence = place").groupBy("handler").agg((F.max("sequence") + 1).cast("bigint").alias("next"))
        now = cursors.unionByName(moved).groupBy("handler").agg(F.max("next").alias("next"))
        now = put("moved", now)
        due = waiting.join(now, "handler", "left").withColumn("due", F.coalesce(F.col("sequence") < F.col("next"), F.lit(False)))
        put("applied", _summed(due.filter("due")))
        put("pending", due.filter("not due").select(*rows.columns))
        put("cursors", now)

    return write


def _merged_epochs(spark: SparkSession, folder: str) -> int:
    done = [int(name.partition("=")[2]) for name in folders(spark, f"{folder}/cursors") if name.startswith("epoch=")]
    return max((e for e in done if exists(spark, f"{folder}/cursors/epoch={e}/_SUCCESS")), default=-1)


def merged_values(spark: SparkSession, folder: str) -> DataFrame:
    """handler, source_id, field and value (or the typed value's columns): all that was released so far, by merged epochs alone."""
    last = _merged_epochs(spark, folder)
    rows = spark.read.parquet(f"{folder}/applied").filter(F.col("epoch") <= last)
    return _summed(rows)


def cursors(spark: SparkSession, folder: str) -> DataFrame:
    """handler, next: the sequence that each handler waits for."""
    return spark.read.parquet(f"{folder}/cursors/epoch={_merged_epochs(spark, folder)}")
