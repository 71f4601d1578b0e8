"""From decoded archives to stream events: the moment blocks of volume files become identified events with payloads, one batch per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import Universe
from ..functions.payload import EPOCH_TICKS, azimuth_bucket, band_slices, elevation_slot, expected_length, raw_sum
from .dictionary import normalise

#: Events of a batch are numbered within 2 ** 32, so that event_seq orders them across batches, too.
BATCH = 1 << 32


def block_events(blocks: DataFrame, universe: Universe) -> DataFrame:
    """One row per moment block and range band that gets gates, identified as far as the rules allow (see normalise: error, ids).

    blocks: the rows of moment_blocks. Files count in order of their paths, blocks in the order of their file; a radar or moment is registered by its first block.
    """
    rows = blocks.withColumns({
        "elevation_slot": elevation_slot(F.col("elevation_number")), "azimuth_bucket": azimuth_bucket(F.col("radial_seq"), universe.azimuths).cast("int"),
        "slice": F.explode(band_slices("gates", universe.bands))}).drop("gates")
    ticks = lambda ms: F.col(ms) * 10_000 + EPOCH_TICKS
    rows = rows.select(
        "path", "record_seq", "message_seq", "radial_seq", "block_seq", "elevation_slot", "azimuth_bucket", F.col("slice.band").alias("range_band"), F.col("slice.start").alias("gate_start"),
        F.col("radar_id").alias("radar_code"), "moment_name", "word_size", "scale", "offset", ticks("volume_ms").alias("volume_ticks"), ticks("message_ms").alias("message_ticks"), F.col("slice.gates").alias("gates"))
    rows = rows.withColumns({"gate_count": F.size("gates"), "raw_sum": raw_sum(F.col("gates"))}).withColumn("payload_length", expected_length(F.col("gate_count"), F.col("word_size")))
    return normalise(rows, "radar_code", "moment_name", universe, F.struct("path", "radial_seq", "block_seq", "range_band"))


def stream_events_from(blocks: DataFrame, universe: Universe) -> tuple[DataFrame, DataFrame]:
    """(events, rejected): the events of all files in batches, and the blocks whose identity fails with their error.

    Adds batch_seq (the file's place among those with events, from 0), event_seq and payload_offset. The files are ranked by their paths alone; a batch is
    ordered within its file.
    """
    rows = block_events(blocks, universe)
    good = rows.filter("error is null").drop("error")
    files = good.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint").alias("batch_seq"))
    by = Window.partitionBy("path").orderBy("radial_seq", "block_seq", "range_band")
    ordered = good.withColumn("at", F.row_number().over(by) - 1).withColumn("payload_offset", F.coalesce(F.sum("payload_length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    events = ordered.join(files, "path").withColumn("event_seq", F.col("batch_seq") * BATCH + F.col("at")).drop("at")
    return events, rows.filter("error is not null")
