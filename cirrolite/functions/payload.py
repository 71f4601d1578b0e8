"""Payload and gate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of 100 ns from the first day of year 1 to 1970.
EPOCH_TICKS = 621355968000000000
STATUS = ["Valid", "BelowThreshold", "RangeFolded", "ClutterFilterNotApplied", "PointClutterFilterApplied", "DualPolarizationFiltered", "Reserved", "Unsupported"]


def raw_sum(gates: Column) -> Column:
    return F.aggregate(gates, F.lit(0).cast("bigint"), lambda a, x: a + x)


def expected_length(gate_count: Column, word_size: Column) -> Column:
    return gate_count * F.floor(word_size / 8).cast("int")


def gates_of(payload: Column, start: Column, count: Column, word_size: Column) -> Column:
    """The gates of an event as an array: big-endian words of 8 or 16 bits from byte `start` (from 0)."""
    word = (word_size / 8).cast("int")
    at = lambda i: F.conv(F.hex(F.substring(payload, start + i * word + 1, word)), 16, 10).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<int>"))


def gate_status(moment: Column, raw: Column, scale: Column) -> Column:
    usable = (scale != 0) & ~F.isnan(scale) & (F.abs(scale) != float("inf"))
    clutter = F.when(raw == 0, 3).when(raw == 1, 4).when(raw == 2, 5).when(raw < 8, 6)
    other = F.when(raw == 0, 1).when(raw == 1, 2)
    return F.coalesce(F.when(moment == "CFP", clutter).otherwise(other), F.when(usable, 0).otherwise(7))


def calibrated(raw: Column, scale: Column, offset: Column, status: Column) -> Column:
    """(raw - offset) / scale in single precision, widened; null unless valid."""
    return F.when(status == 0, ((raw.cast("float") - offset) / scale).cast("float").cast("double"))


def range_km(first: Column, spacing: Column, gate: Column) -> Column:
    return (first.cast("float") + (gate.cast("float") * spacing.cast("float")).cast("float")).cast("float")


def scaled(value: Column) -> Column:
    """Thousandths, halves away from zero: sums of them don't depend on order."""
    return F.round(value * 1000).cast("bigint")


def band_slices(gates: str = "gates", bands: int = 4) -> Column:
    """Array of (band, start, gates) for the bands that get gates: band b holds [b n / B, (b + 1) n / B)."""
    n = F.size(gates)
    cell = lambda b: F.struct(b.alias("band"), F.floor(b * n / bands).cast("int").alias("start"), F.slice(gates, F.floor(b * n / bands).cast("int") + 1, (F.floor((b + 1) * n / bands) - F.floor(b * n / bands)).cast("int")).alias("gates"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), cell), lambda s: F.size(s.gates) > 0)


def elevation_slot(elevation: Column) -> Column:
    return F.greatest(elevation - 1, F.lit(0))


def azimuth_bucket(radial_seq: Column, buckets: int) -> Column:
    """Radials in order (from 1) fill the buckets in turn."""
    return (radial_seq - 1) % buckets


def slice_error(payload: Column, offset: Column, length: Column, gates: Column, word_size: Column) -> Column:
    """Why an event's payload can't be taken from its batch's, else null."""
    whole = F.length(payload)
    return (
        F.when(~word_size.isin(8, 16), "word size").when(length != expected_length(gates, word_size), "length").when(length <= 0, "empty")
        .when((offset < 0) | (offset > whole) | (length > whole - offset), "outside")
    )


def payload_slice(payload: Column, offset: Column, length: Column, gates: Column, word_size: Column) -> Column:
    """An event's bytes; a slice that can't be taken is an error when the row is computed."""
    error = slice_error(payload, offset, length, gates, word_size)
    return F.when(error.isNull(), F.substring(payload, offset + 1, length)).otherwise(F.raise_error(F.concat(F.lit("payload slice: "), error)).cast("binary"))


def pressure(events: Column, values: Column, checksum: Column, weights: tuple[float, float, float] = (1.0, 0.001, 0.0)) -> Column:
    return events * F.lit(weights[0]) + values * F.lit(weights[1]) + checksum * F.lit(weights[2])


def static_band(score: Column, cold: float = 0.0, warm: float = 10_000.0, hot: float = 50_000.0, super_hot: float = 100_000.0) -> Column:
    return F.when(score >= super_hot, "SuperHot").when(score >= hot, "Hot").when(score >= warm, "Warm").when(score <= cold, "Cold").otherwise("Normal")


def identity_error(text: Column, least: int, most: int, letters: str) -> Column:
    """Null for a canonical text, else the first thing wrong; nothing is trimmed or folded. letters: a character class without brackets."""
    bad = F.regexp_instr(text, F.lit(f"[^{letters}]"))
    return F.when(text.isNull(), "missing").when(F.length(text) < least, "too short").when(F.length(text) > most, "too long").when(bad > 0, F.concat(F.lit("character "), bad))


def normal_radar(text: Column) -> Column:
    """Trimmed upper-case radar id of four letters or digits, else null."""
    up = F.upper(F.trim(text))
    return F.when(up.rlike("^[A-Z0-9]{4}$"), up)


def julian_timestamp(day: Column, ms: Column) -> Column:
    """Day 1 is 1970-01-01."""
    return F.timestamp_millis((day.cast("bigint") - 1) * 86_400_000 + ms)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)
