"""Source keys: a four-dimensional key space with dense ids, and its split into contiguous buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Universe:
    radars: int
    elevations: int
    azimuths: int
    bands: int
    version: int = 1

    @property
    def sources(self) -> int:
        return self.radars * self.elevations * self.azimuths * self.bands

    def encode(self, radar: str = "radar_ordinal", elevation: str = "elevation_slot", azimuth: str = "azimuth_bucket", band: str = "range_band") -> Column:
        """The dense id; null outside the universe."""
        r, e, a, b = (F.col(c).cast("bigint") for c in (radar, elevation, azimuth, band))
        return F.when(self.contains(radar, elevation, azimuth, band), ((r * self.elevations + e) * self.azimuths + a) * self.bands + b)

    def contains(self, radar: str = "radar_ordinal", elevation: str = "elevation_slot", azimuth: str = "azimuth_bucket", band: str = "range_band") -> Column:
        return F.col(radar).between(0, self.radars - 1) & F.col(elevation).between(0, self.elevations - 1) & F.col(azimuth).between(0, self.azimuths - 1) & F.col(band).between(0, self.bands - 1)

    def decode(self, source: Column) -> dict[str, Column]:
        whole = lambda by: F.floor(source / by).cast("bigint")
        return {
            "radar_ordinal": whole(self.elevations * self.azimuths * self.bands), "elevation_slot": whole(self.azimuths * self.bands) % self.elevations,
            "azimuth_bucket": whole(self.bands) % self.azimuths, "range_band": source % self.bands,
        }

    def radar_block(self, ordinal: int) -> tuple[int, int]:
        """First id of a radar and the first one after it."""
        size = self.elevations * self.azimuths * self.bands
        return ordinal * size, (ordinal + 1) * size

    def compatible(self, other: Universe) -> bool:
        """The same version must mean the same layout; other versions may have any."""
        layout = lambda u: (u.radars, u.elevations, u.azimuths, u.bands)
        return self.version != other.version or layout(self) == layout(other)


def bucket_of(source: Column, sources: int, buckets: int) -> Column:
    """Balanced contiguous ranges; the first sources % buckets of them are one id longer."""
    small, longer = divmod(sources, buckets)
    edge = longer * (small + 1)
    return F.when(source < edge, F.floor(source / (small + 1))).otherwise(longer + F.floor((source - edge) / max(small, 1))).cast("bigint")


def shard_of(bucket: Column, buckets: int, shards: int) -> Column:
    return F.floor(bucket * shards / buckets).cast("bigint")


def bucket_ranges(sources: int, buckets: int, shards: int) -> list[tuple[int, int, int, int]]:
    """(bucket, shard, first id, first id after) of every bucket."""
    small, longer = divmod(sources, buckets)
    first = [b * small + min(b, longer) for b in range(buckets + 1)]
    return [(b, b * shards // buckets, first[b], first[b + 1]) for b in range(buckets)]
