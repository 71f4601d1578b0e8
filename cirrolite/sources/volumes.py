"""Volume files as a Spark data source whose partitions are byte ranges of the files.

`spark.read.format("volume_records")` yields one row per compressed record. A partition is a range of one file, planned from the file's size alone. Its task follows the control
words from the volume header on - four bytes each, by seeks - and reads only the records whose control word begins inside its range, so no task holds a file and each record has one owner. Files are opened
through pyarrow, as are object stores and HDFS; for_pyarrow() maps the schemes that Hadoop names otherwise.

decoded() decompresses the records and cuts them into messages; records are dealt evenly first, so a long file is decoded by many tasks. A record that can't be decompressed or read costs its own messages alone: it
becomes a row with a diagnostic. Where a control word is bad, or the file ends inside a record, what follows has no known beginning: one diagnostic row, from the task that owns the place. A message that the
record ends before its declared length is left out; the record and the file go on.

numbered() numbers a volume's radials across its records by a prefix sum over the records' counts.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..plans.shared import written
from .archive import RADIAL, VOLUME_HEADER, messages_of, radial_of

RECORD = pa.schema([("path", pa.string()), ("radar_id", pa.string()), ("volume_ms", pa.int64()), ("record_seq", pa.int64()), ("record_offset", pa.int64()), ("packed", pa.binary()), ("diagnostic", pa.string())])
DDL = "path string, radar_id string, volume_ms bigint, record_seq bigint, record_offset bigint, packed binary, diagnostic string"


def for_pyarrow(path: str) -> str:
    """A path as pyarrow names it: without scheme it is local, s3a and s3n are s3, abfss is abfs."""
    scheme, sep, rest = path.partition("://")
    if not sep:
        return f"file://{path[5:]}" if path.startswith("file:") else f"file://{path}"
    return {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + sep + rest


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, size: int):
        self.path, self.begin, self.end, self.size = path, begin, end, size


def records_of(source, path: str, begin: int, end: int, size: int) -> Iterator[tuple]:
    """Rows of the records whose control word begins in [begin, end). source: an open file."""
    head = source.read(VOLUME_HEADER)
    if len(head) < VOLUME_HEADER or head[:4] != b"AR2V":
        if begin == 0:
            yield path, None, None, None, 0, None, "no volume header"
        return
    day, ms = struct.unpack_from(">ii", head, 12)
    try:
        radar = head[20:24].decode("ascii").rstrip("\0 ")
    except UnicodeDecodeError:
        radar = None
    volume = radar, (day - 1) * 86_400_000 + ms
    at, seq = VOLUME_HEADER, 0
    while at < min(end, size):
        source.seek(at)
        word = source.read(4)
        number = struct.unpack(">i", word)[0] if len(word) == 4 else None
        mine = at >= begin
        if number in (None, 0, -(2**31)):
            if mine:
                yield path, *volume, seq, at, None, f"record {seq} is cut short" if number is None else f"control word {number} at {at}"
            return
        if mine:
            packed = source.read(abs(number))
            if len(packed) < abs(number):
                yield path, *volume, seq, at, None, f"record {seq} is cut short"
                return
            yield path, *volume, seq, at, packed, None
        at, seq = at + 4 + abs(number), seq + 1


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 4 << 20))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(for_pyarrow(self.path))
        info = system.get_file_info(place)
        some = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
        uri = for_pyarrow(self.path)
        prefix = uri[: len(uri) - len(place)] if uri.endswith(place) else uri.partition("://")[0] + "://"
        files = sorted((f for f in some if f.type == fs.FileType.File), key=lambda f: f.path)
        return [Range(prefix + f.path, at, min(f.size, at + self.split), f.size) for f in files for at in range(0, max(1, f.size), self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(part.path)
        with system.open_input_file(place) as source:
            for row in records_of(source, part.path, part.begin, part.end, part.size):
                yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, row))], schema=RECORD)


class VolumeRecords(DataSource):
    """Options: path (a file or a folder), splitBytes (4 MB unless given)."""

    @classmethod
    def name(cls) -> str:
        return "volume_records"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> VolumeReader:
        return VolumeReader({k.lower(): v for k, v in self.options.items()})


def records(spark: SparkSession, path: str, split_bytes: int = 4 << 20) -> DataFrame:
    """One row per record of the volumes under a path: volume, place and packed bytes, or a diagnostic."""
    spark.dataSource.register(VolumeRecords)
    return spark.read.format("volume_records").option("splitBytes", split_bytes).load(path)


MESSAGE = pa.schema([("path", pa.string()), ("radar_id", pa.string()), ("volume_ms", pa.int64()), ("record_seq", pa.int64()), ("message_seq", pa.int64()), ("message_type", pa.int32()), ("message_ms", pa.int64()), ("radial_in_record", pa.int64()), ("body", pa.binary()), ("diagnostic", pa.string())])
MESSAGE_DDL = "path string, radar_id string, volume_ms bigint, record_seq bigint, message_seq bigint, message_type int, message_ms bigint, radial_in_record bigint, body binary, diagnostic string"


def _messages(path: str, radar: str, volume_ms: int, seq: int, packed: bytes | None, diagnostic: str | None) -> Iterator[tuple]:
    place, n, radials = (path, radar, volume_ms, seq), 0, 0
    if packed is not None:
        try:
            for m in messages_of(bz2.decompress(packed)):
                n += 1
                day, ms = struct.unpack_from(">HI", m, 6)
                radial = m[3] == RADIAL and radial_of(m) is not None
                radials += radial
                yield *place, n, m[3], (day - 1) * 86_400_000 + ms, radials if radial else None, m, None
        except (ValueError, OSError, EOFError, struct.error) as e:
            diagnostic = str(e) or type(e).__name__
    if diagnostic is not None or not n:
        yield *place, None, None, None, None, None, diagnostic


def decoded(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per message of each record, one without message for a record that has none, and one with a diagnostic where something was wrong. radial_in_record counts a record's radials from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                found = list(_messages(r["path"], r["radar_id"], r["volume_ms"], r["record_seq"], r["packed"], r["diagnostic"]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), MESSAGE)], schema=MESSAGE)

    dealt = rows.repartition(tasks, "path", "record_seq") if tasks else rows.repartition("path", "record_seq")
    return dealt.select("path", "radar_id", "volume_ms", "record_seq", "packed", "diagnostic").mapInArrow(run, MESSAGE_DDL)


def numbered(message_rows: DataFrame) -> DataFrame:
    """The columns of archive.messages: radial_seq numbers a volume's radials from 1, over all its records. Messages are written once; the prefix sum runs over one small row per record."""
    rows = written(message_rows)
    counts = rows.groupBy("path", "record_seq").agg(F.max("radial_in_record").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("record_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("path").alias("p"), F.col("record_seq").alias("r"), before.alias("before"))
    out = rows.join(starts, (F.col("path") == F.col("p")) & F.col("record_seq").eqNullSafe(F.col("r")), "left")
    return out.select("path", "radar_id", "volume_ms", "record_seq", "message_seq", "message_type", "message_ms", (F.col("radial_in_record") + F.col("before")).alias("radial_seq"), "body", "diagnostic")


def volume_messages(spark: SparkSession, path: str, split_bytes: int = 4 << 20, tasks: int | None = None) -> DataFrame:
    """All messages of the volumes under a path, with radials numbered by volume."""
    return numbered(decoded(records(spark, path, split_bytes), tasks))
