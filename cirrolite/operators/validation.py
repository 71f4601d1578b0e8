"""Data-quality jobs: batches, processing input, state commits and outputs. Failures are rows, in the order in which the rules apply."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import Universe


def batch_errors(events: DataFrame, universe: Universe, catalog_size: tuple[int, int] | None = None, schema_version: int = 1, dictionary_version: int = 1, expected: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """One row per batch: error (null if valid), event_index (-1 for rules on the whole batch).

    Header rules come first, then the first event that fails and its first rule, then the payload's tail, then the expected metrics. events: batch_seq,
    event_seq, message_ticks, gate_count, payload_length, payload_offset, batch_bytes, raw_sum, source_id, the key's dimensions, schema_version,
    universe_version, dictionary_version and, with catalog_size (radars, moments), moment_id. expected: batch_seq, event_count, value_count, raw_checksum and, where they are
    told, payload_bytes and metadata_checksum; the latter is compared with that of `metadata` (batch_seq, metadata_checksum), the fold over the header and the events.
    """
    by = Window.partitionBy("batch_seq").orderBy("event_seq")
    before = F.coalesce(F.sum("payload_length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rules = (
        F.when(F.col("message_ticks") < F.lag("message_ticks").over(by), "ChronologyOrderViolation")
        .when(F.col("payload_length") != F.col("gate_count") * F.col("word_size") / 8, "PayloadLengthMismatch")
        .when(F.col("payload_offset") > F.col("batch_bytes") - F.col("payload_length"), "PayloadReferenceOutsidePayload")
        .when(F.col("payload_offset") != before, "PayloadReferenceNotContiguous")
        .when(~_inside(universe), "SourceIdOutsideUniverse")
        .when(~F.coalesce(universe.contains(), F.lit(False)), "SourceKeyOutsideUniverse")
        .when(universe.encode() != F.col("source_id"), "SourceKeyMismatch")
    )
    if catalog_size:
        rules = rules.when(F.col("radar_ordinal") >= catalog_size[0], "RadarOrdinalOutsideDictionary").when(F.col("moment_id") >= catalog_size[1], "MomentIdOutsideDictionary")
    rows = events.withColumn("index", F.row_number().over(by) - 1).withColumn("rule", rules)
    bad = F.col("rule").isNotNull()
    each = rows.groupBy("batch_seq").agg(
        F.max("schema_version").alias("sv"), F.max("universe_version").alias("uv"), F.max("dictionary_version").alias("dv"), F.max("batch_bytes").alias("bytes"), F.sum("payload_length").alias("used"),
        F.count("*").alias("n"), F.sum("gate_count").alias("v"), F.sum("raw_sum").alias("c"), F.min(F.when(bad, F.struct("index", "rule"))).alias("first"))
    header = F.when(F.col("sv") != schema_version, "UnsupportedStreamSchemaVersion").when(F.col("uv") != universe.version, "SourceUniverseVersionMismatch").when(F.col("dv") != dictionary_version, "DictionarySnapshotVersionMismatch")
    metrics = F.lit(None).cast("string")
    if expected is not None:
        counted = {"event_count": "n", "value_count": "v", "raw_checksum": "c", "payload_bytes": "bytes", "metadata_checksum": "fold"}
        if "metadata_checksum" in expected.columns:
            if metadata is None:
                raise ValueError("expected has metadata_checksum, but there is no metadata to compare it with")
            each = each.join(metadata.select("batch_seq", F.col("metadata_checksum").alias("fold")), "batch_seq", "left")
        told = [c for c in counted if c in expected.columns]
        each = each.join(expected.select("batch_seq", F.struct(*told).alias("want")), "batch_seq", "left")
        same = [F.col(f"want.{c}").eqNullSafe(F.col(counted[c])) for c in told]
        metrics = F.when(F.col("want").isNotNull() & ~reduce(and_, same), "MetricsMismatch")
    error = F.coalesce(header, F.col("first.rule"), F.when(F.col("used") != F.col("bytes"), "PayloadTailNotReferenced"), metrics)
    return each.select("batch_seq", error.alias("error"), F.when(header.isNull() & F.col("first").isNotNull(), F.col("first.index")).otherwise(-1).cast("bigint").alias("event_index"))


def _inside(universe: Universe) -> Column:
    return F.coalesce(F.col("source_id").between(0, universe.sources - 1), F.lit(False))


def accepted_batches(events: DataFrame, universe: Universe, schema_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) batches for processing, each with events and payload_values; the first rule that fails rejects the whole batch and event_index is the event's that broke it (-1: the header).

    Rules on the versions (where the events carry schema_version and universe_version), then on the source ids and their dimensions in order of the events,
    then on each source's ticks, which must not step back.
    """
    back = F.col("message_ticks") < F.lag("message_ticks").over(Window.partitionBy("batch_seq", "source_id").orderBy("event_seq"))
    owner = F.when(~_inside(universe), "SourceIdOutsideUniverse").when(~F.coalesce(universe.encode() == F.col("source_id"), F.lit(False)), "SourceOwnershipMismatch")
    heads = [F.when(F.max(c) != wanted, name) for c, wanted, name in (("schema_version", schema_version, "UnsupportedStreamSchemaVersion"), ("universe_version", universe.version, "SourceUniverseVersionMismatch")) if c in events.columns]
    rows = events.withColumn("owner", owner).withColumn("back", back)
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("batch_seq").orderBy("event_seq")) - 1)
    each = rows.groupBy("batch_seq").agg(
        F.count("*").alias("events"), F.sum("gate_count").cast("bigint").alias("payload_values"), (F.coalesce(*heads) if heads else F.lit(None)).cast("string").alias("head"),
        F.min(F.when(F.col("owner").isNotNull(), F.struct("index", F.col("owner").alias("rule")))).alias("first"), F.min(F.when(F.col("back"), F.col("index"))).alias("late"))
    error = F.coalesce("head", "first.rule", F.when(F.col("late").isNotNull(), "SourceOrderViolation"))
    index = F.when(F.col("head").isNotNull(), -1).otherwise(F.coalesce("first.index", "late")).cast("bigint")
    each = each.select("batch_seq", "events", "payload_values", error.alias("error"), index.alias("event_index"))
    return each.filter("error is null").drop("error", "event_index"), each.filter("error is not null")


def commit_errors(deltas: DataFrame, state: DataFrame) -> DataFrame:
    """Touched sources whose first ticks lie below the stored last ticks."""
    return deltas.join(state.select("source_id", F.col("last_ticks").alias("stored_ticks")), "source_id").filter(F.col("first_ticks") < F.col("stored_ticks"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Differences of two snapshots: missing, unexpected, duplicate and changed keys."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias(f"n_{tag}"), F.min(F.struct(*metrics)).alias(tag))

    both = side(expected, "e").join(side(actual, "a"), key, "full")
    problem = F.when(F.col("n_a").isNull(), "Missing").when(F.col("n_e").isNull(), "Unexpected").when(F.col("n_a") > 1, "Duplicate").when(~F.col("e").eqNullSafe(F.col("a")), "Changed")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def first_difference(left: DataFrame, right: DataFrame, metrics: list[str]) -> DataFrame:
    """Two one-row tables: the first metric that differs as text, else null."""
    l, r = left.select(F.struct(*metrics).alias("l")), right.select(F.struct(*metrics).alias("r"))
    both = l.withColumn("one", F.lit(1)).join(r.withColumn("one", F.lit(1)), "one")
    say = [F.when(~F.col(f"l.{m}").eqNullSafe(F.col(f"r.{m}")), F.concat(F.lit(f"{m}: "), F.col(f"l.{m}").cast("string"), F.lit(" and "), F.col(f"r.{m}").cast("string"))) for m in metrics]
    return both.select(F.coalesce(*say).alias("difference"))


def totals_agree(load: DataFrame, events: DataFrame) -> DataFrame:
    """Whether the counts by bucket add up to those of the events."""
    a = load.agg(*[F.sum(c).alias(c) for c in ("event_count", "value_count", "raw_checksum")])
    b = events.agg(F.count("*").alias("event_count"), F.sum("gate_count").alias("value_count"), F.sum("raw_sum").alias("raw_checksum"))
    return first_difference(a, b, ["event_count", "value_count", "raw_checksum"])
