"""Dictionary encoding: dense ids in first-seen order, versions and deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import positions, running_sums


def assign_ids(rows: DataFrame, text: str, order: str | Column) -> DataFrame:
    """(text, id): ids from 0 in order of the smallest `order` of each text. Distinct texts are placed by a distributed prefix sum."""
    seen = rows.groupBy(F.col(text).alias("text")).agg(F.min(order).alias("first_seen"))
    return positions(seen, ["first_seen", "text"]).select("text", (F.col("position") - 1).alias("id"), "first_seen")


def lookup(rows: DataFrame, catalog: DataFrame, text: str, as_: str) -> DataFrame:
    """Left join to the catalog; unknown texts get null. Spark broadcasts the catalog if it is small enough."""
    return rows.join(catalog.select(F.col("text").alias(text), F.col("id").alias(as_)), text, "left")


def snapshot(catalog: DataFrame, version: int) -> DataFrame:
    """The entries of a version; version 1 is empty and each entry adds one."""
    if version < 1 or version > 1 + catalog.count():
        raise ValueError(f"no version {version}")
    return catalog.filter(F.col("id") < version - 1)


def delta(catalog: DataFrame, since: int, until: int) -> DataFrame:
    if not 1 <= since <= until:
        raise ValueError(f"no delta from {since} to {until}")
    return catalog.filter((F.col("id") >= since - 1) & (F.col("id") < until - 1))


def apply_delta(base: DataFrame, change: DataFrame, since: int) -> DataFrame:
    """base must be the snapshot that the delta starts from; where both name their catalog (column catalog), the names must be the same."""
    if base.count() != since - 1:
        raise ValueError(f"the delta starts at version {since}, the snapshot is another one")
    if "catalog" in base.columns and "catalog" in change.columns and base.select("catalog").union(change.select("catalog")).distinct().limit(2).count() > 1:
        raise ValueError("the delta is of another catalog")
    return base.unionByName(change)


def density(catalog: DataFrame) -> DataFrame:
    """One row: entries, whether ids are dense and whether texts and ids are unique."""
    return catalog.agg(F.count("*").alias("entries"), (F.count("*") == F.coalesce(F.max("id") + 1, F.lit(0))).alias("dense"), ((F.countDistinct("text") == F.count("*")) & (F.countDistinct("id") == F.count("*"))).alias("unique"))


def combined_versions(rows: DataFrame, kinds: dict[str, str], order: str) -> DataFrame:
    """One row per newly seen text of any kind (column name -> kind): version and how many of each kind are visible then."""
    first = None
    for rank, (column, kind) in enumerate(kinds.items()):
        seen = rows.groupBy(F.col(column).alias("text")).agg(F.min(order).alias("first_seen")).select(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "text", "first_seen")
        first = seen if first is None else first.unionByName(seen)
    kept = {f"{k}_count": (F.col("kind") == k).cast("int") for k in kinds.values()}
    placed = running_sums(first, ["first_seen", "rank", "text"], {"position": F.lit(1)} | kept)
    return placed.select((F.col("position") + 1).alias("version"), "kind", "text", *kept)


#: Fixed value: ids and dimensions of an event are unsigned 16-bit numbers.
MOST_ID = 65_535


def normalise(rows: DataFrame, radar: str, moment: str, universe, order: str | Column = "event_seq", most: int = MOST_ID) -> DataFrame:
    """Adds error (the first of the ordered rules that fails, else null), radar_ordinal, moment_id and source_id.

    Texts and dimensions are checked first. Radars of the rows that pass register in order of their first row, as far as the universe has room; moments
    register from rows whose radar did. Only distinct texts are ranked, so the catalogs stay small.
    """
    from ..functions.payload import identity_error

    dims = {"elevation_slot": universe.elevations, "azimuth_bucket": universe.azimuths, "range_band": universe.bands}
    outside = ~F.coalesce(_all(F.col(c).between(0, n - 1) for c, n in dims.items()), F.lit(False))
    text = (
        F.when(identity_error(F.col(radar), 4, 4, "A-Z0-9").isNotNull(), "InvalidRadarCode").when(identity_error(F.col(moment), 1, 8, "A-Z0-9_").isNotNull(), "InvalidMomentName")
        .when(outside, "SourceOutOfRange").when(~_all(F.col(c) <= most for c in dims), "SourceDimensionOutsideStreamEventRange")
    )
    ok = F.when(F.col("error").isNull(), F.col(radar))
    rows = rows.drop("radar_ordinal", "moment_id", "source_id").withColumn("error", text)
    radars = assign_ids(rows.filter("error is null"), radar, order).select(F.col("text").alias("_radar"), F.col("id").alias("radar_ordinal"))
    rows = rows.join(radars, ok == F.col("_radar"), "left").drop("_radar")
    room = F.when(F.col("radar_ordinal") >= universe.radars, "RadarOrdinalOutsideSourceUniverse").when(F.col("radar_ordinal") > most, "RadarOrdinalOutsideStreamEventRange")
    rows = rows.withColumn("error", F.coalesce("error", room))
    moments = assign_ids(rows.filter("error is null"), moment, order).select(F.col("text").alias("_moment"), F.col("id").alias("moment_id"))
    rows = rows.join(moments, F.when(F.col("error").isNull(), F.col(moment)) == F.col("_moment"), "left").drop("_moment")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("moment_id") > most, "MomentIdOutsideStreamEventRange")))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return rows.withColumn("radar_ordinal", good(F.col("radar_ordinal"))).withColumn("moment_id", good(F.col("moment_id"))).withColumn("source_id", good(universe.encode()))


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def normal_ids(rows: DataFrame, column: str) -> Column:
    return F.upper(F.trim(F.col(column)))
