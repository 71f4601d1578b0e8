"""Aggregates over stream and gate events: batches, sources, key buckets, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bucket_of, bucket_ranges, shard_of
from ..functions.payload import STATUS, scaled


def batch_metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("batch_seq").agg(F.count("*").alias("event_count"), F.sum("gate_count").alias("payload_bytes"), F.sum("gate_count").alias("value_count"), F.sum("raw_sum").alias("raw_checksum"))


def source_rollup(events: DataFrame) -> DataFrame:
    """State of each source that occurs: counts, checksum and last ticks. Partial sums are combined before the one shuffle."""
    return events.groupBy("source_id").agg(F.count("*").alias("event_count"), F.sum("gate_count").alias("value_count"), F.sum("raw_sum").alias("raw_checksum"), F.max("message_ticks").alias("last_ticks"))


def run_metrics(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("batch_seq").alias("batches"), F.countDistinct("source_id").alias("active_sources"), F.count("*").alias("event_count"), F.sum("gate_count").alias("value_count"), F.sum("raw_sum").alias("raw_checksum"))


def batch_deltas(events: DataFrame) -> DataFrame:
    """What each batch does to each source that it touches."""
    return events.groupBy("batch_seq", "source_id").agg(F.count("*").alias("event_count"), F.sum("gate_count").alias("value_count"), F.sum("raw_sum").alias("raw_checksum"), F.min("message_ticks").alias("first_ticks"), F.max("message_ticks").alias("last_ticks"))


def assignments(spark: SparkSession, sources: int, buckets: int, shards: int) -> DataFrame:
    """One row per key bucket: as many as the configuration says."""
    return spark.createDataFrame(bucket_ranges(sources, buckets, shards), "bucket_id bigint, shard_id bigint, first_source bigint, end_source bigint")


def bucket_load(events: DataFrame, sources: int, buckets: int, shards: int) -> DataFrame:
    """Counts per key bucket; buckets without events are there with zeros. Sources are summed first, so their number needs no distinct count."""
    each = source_rollup(events).groupBy(bucket_of(F.col("source_id"), sources, buckets).alias("bucket_id"))
    got = each.agg(F.sum("event_count").alias("n"), F.sum("value_count").alias("v"), F.sum("raw_checksum").alias("c"), F.count("source_id").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return assignments(events.sparkSession, sources, buckets, shards).join(got, "bucket_id", "left").select("bucket_id", "shard_id", zero("n").alias("event_count"), zero("v").alias("value_count"), zero("c").alias("raw_checksum"), zero("s").alias("active_sources"))


def shard_load(events: DataFrame, sources: int, buckets: int, shards: int) -> DataFrame:
    b = bucket_load(events, sources, buckets, shards)
    return b.groupBy("shard_id").agg(*[F.sum(c).alias(c) for c in ("event_count", "value_count", "raw_checksum")], F.count_if(F.col("event_count") > 0).alias("active_buckets"))


def hottest(load: DataFrame, id: str) -> DataFrame:
    """The id with most events, the lowest of equals; -1 when nothing came."""
    best = F.max_by(F.col(id), F.struct(F.col("event_count"), -F.col(id)))
    return load.filter("event_count > 0").agg(F.coalesce(best, F.lit(-1).cast("bigint")).alias(f"hot_{id}"), F.coalesce(F.max("event_count"), F.lit(0)).alias("event_count"))


def range_join(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each source's bucket by its range [first_source, end_source): both sides are cut into bins of one width, joined on the bin, and filtered.

    The width is the ranges' mean (one small aggregate), so ranges of any lengths lie in at most three bins on average. Only distinct sources are binned; the events join them on the source.
    """
    span = ranges.filter("end_source > first_source").agg(F.ceil(F.sum(F.col("end_source") - F.col("first_source")) / F.count("*")).alias("width")).first()["width"]
    width = F.lit(max(1, int(span or 1)))
    bin_of = lambda c: F.floor(c / width).cast("bigint")
    binned = ranges.filter("end_source > first_source").withColumn("bin", F.explode(F.sequence(bin_of(F.col("first_source")), bin_of(F.col("end_source") - 1))))
    owned = events.select("source_id").distinct().withColumn("bin", bin_of(F.col("source_id"))).join(binned, "bin")
    owned = owned.filter((F.col("source_id") >= F.col("first_source")) & (F.col("source_id") < F.col("end_source")))
    return events.join(owned.select("source_id", "bucket_id", "shard_id"), "source_id")


def all_sources(state: DataFrame, sources: int) -> DataFrame:
    """Every source of the universe; inactive ones with zeros."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    base = state.sparkSession.range(sources).withColumnRenamed("id", "source_id")
    return base.join(state.withColumn("active", F.lit(True)), "source_id", "left").select("source_id", F.coalesce("active", F.lit(False)).alias("active"), *[zero(c) for c in ("event_count", "value_count", "raw_checksum", "last_ticks")])


def status_counts(gates: DataFrame, *by: str) -> DataFrame:
    cols = [F.count_if(F.col("status") == i).alias(f"n_{i}_{name.lower()}") for i, name in enumerate(STATUS)]
    return gates.groupBy(*by).agg(F.count("*").alias("gates"), *cols, F.when(F.count("*") > 0, F.count_if(F.col("status") == 0) / F.count("*")).alias("valid_share"))


def calibrated_stats(gates: DataFrame, *by: str) -> DataFrame:
    good = F.when(~F.isnan("calibrated") & (F.abs("calibrated") != float("inf")), F.col("calibrated"))
    return gates.groupBy(*by).agg(F.count(good).alias("values"), F.min(good).alias("least"), F.max(good).alias("most"), F.coalesce(F.sum(scaled(good)), F.lit(0)).alias("scaled_sum"), F.sum("raw_value").alias("raw_sum"))


def unevenness(gates: DataFrame, kinds: dict[str, str], within: str | None = None) -> DataFrame:
    """For each kind of bucket (kind -> column of whole numbers) the buckets with least and most valid share; equal shares go to the smallest bucket.

    One pass over grouping sets. With `within`, a column that determines all buckets (a radial), gates are summed by it first, so the sets expand one row per radial, not the gates.
    """
    counts = [F.count("*").alias("gates"), F.count_if(F.col("status") == 0).alias("valid")]
    rows = gates.select("status", *([F.col(within).alias("_within")] if within else []), *[F.col(c).cast("bigint").alias(f"_{k}") for k, c in kinds.items()])
    columns = [f"_{k}" for k in kinds]
    rows = rows.groupBy(*(["_within"] if within else []), *columns).agg(*counts)
    level = F.grouping_id()
    sets = rows.groupingSets([[c] for c in columns], *columns).agg(level.alias("level"), F.sum("gates").alias("gates"), F.sum("valid").alias("valid"))
    # the grouping id has a bit for each column that is summed over, the first column's highest
    whole = (1 << len(columns)) - 1
    of = [F.col("level") == whole - (1 << (len(columns) - 1 - n)) for n in range(len(columns))]
    kind = F.coalesce(*[F.when(o, F.lit(k)) for o, k in zip(of, kinds)])
    bucket = F.coalesce(*[F.when(o, F.col(c)) for o, c in zip(of, columns)])
    each = sets.select(kind.alias("kind"), bucket.alias("bucket"), "gates", "valid")
    each = each.withColumn("share", F.col("valid") / F.col("gates"))
    return each.groupBy("kind").agg(
        F.count("*").alias("buckets"), F.min_by("bucket", F.struct("share", "bucket")).alias("least_bucket"), F.min("share").alias("least_share"),
        F.max_by("bucket", F.struct(F.col("share"), -F.col("bucket"))).alias("most_bucket"), F.max("share").alias("most_share"), F.min("valid").alias("least_valid"), F.max("valid").alias("most_valid"))


def moment_summary(blocks: DataFrame) -> DataFrame:
    """Per moment: radials, gates and the bounds of the six fields of the headers. blocks: one row per moment block of a radial."""
    fields = ("gate_count", "word_size", "first_km", "spacing_km", "scale", "offset")
    return blocks.groupBy("moment_name").agg(F.count("*").alias("radials"), F.sum("gate_count").alias("gates"), *[f(c).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max))])


def sweep_summary(radials: DataFrame) -> DataFrame:
    """radials: volume_id, sweep, radial_key, radial_status, elevation_number, elevation_angle, cut_sector, moments (array of names) and the counts of constant blocks."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("elevation_angle", "cut_sector") for n, f in (("min", F.min), ("max", F.max))]
    return radials.groupBy("volume_id", "sweep").agg(
        F.count("*").alias("radials"), F.min("elevation_number").alias("elevation_number"), F.avg(F.col("elevation_angle").cast("double")).alias("avg_elevation_angle"), *bounds,
        F.min("radial_key").alias("first_radial"), F.max("radial_key").alias("last_radial"), F.min_by("radial_status", "radial_key").alias("start_status"), F.max_by("radial_status", "radial_key").alias("end_status"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("moments")))).alias("moments"), *[F.sum(c).alias(c) for c in ("volume_blocks", "elevation_blocks", "radial_blocks")])


def manifest_summary(files: DataFrame) -> DataFrame:
    return files.groupBy(F.upper("radar_id").alias("radar_id")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


#: The states of a ledger's entries.
STATES = ("Pending", "Claimed", "Completed", "Committed", "Failed", "Poison", "Abandoned", "Canceled", "Released")


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """ledger: sequence, state, attempt. Counts by state, retries, the oldest entry not committed and the first one that blocks."""
    done = F.col("state").isin("Committed", "Released")
    blocks = F.col("state").isin("Failed", "Poison")
    return ledger.agg(
        F.count("*").alias("entries"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES], F.coalesce(F.sum(F.greatest(F.lit(0), F.col("attempt") - 1)), F.lit(0)).alias("retries"),
        F.min(F.when(~done, F.col("sequence"))).alias("oldest_open"), F.min(F.when(blocks, F.col("sequence"))).alias("first_blocking"), F.min_by(F.when(blocks, F.col("state")), F.when(blocks, F.col("sequence"))).alias("blocking_reason"))
