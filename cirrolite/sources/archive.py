"""Archives of volume files: listing, classification, decoding to messages, moment blocks and gates, and manifests.

Files are read by Spark's binaryFile source and decoded one file per row in Arrow batches; what cannot be decoded becomes a diagnostic row, never a failed job.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator
from datetime import date
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VOLUME_HEADER, MESSAGE_HEADER, RADIAL_HEADER, POINTERS, MOST_POINTERS, BLOCK_HEADER = 24, 16, 72, 32, 10, 28
CHANNELS, MOST_MESSAGE, RADIAL = (0, 1, 2, 8), 1 << 20, 31
CONSTANT_BLOCKS = (b"RVOL", b"RELV", b"RRAD")


def scan_files(spark: SparkSession, folder: str, day: date | None = None, radar: str | None = None, most: int | None = None) -> DataFrame:
    """path, length, modificationTime and content of the files under folder, by path. Filters are on the path, so other files are not opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    if radar:
        rows = rows.filter(F.upper(name).startswith(radar.upper()) | F.array_contains(F.split(F.upper("path"), "/"), radar.upper()))
    if day:
        rows = rows.filter((F.substring(name, 5, 8) == day.strftime("%Y%m%d")) | F.col("path").contains(day.strftime("/%Y/%m/%d/")))
    return rows.orderBy("path").limit(most) if most else rows


#: What inspection says of each kind.
KIND_TEXT = {
    "short": "Archive Two signature is present, but the file is shorter than the 24-byte volume header.",
    "CompressedStream": "File does not start with an Archive Two volume header and should not be parsed as base-data volume.",
    "Unknown": "File signature is not recognized as a supported NEXRAD archive file kind.",
}


def _signs(content: Column, path: Column) -> tuple[Column, Column, Column]:
    """Whether a file has the volume signature, the whole volume header, and the marks of a compressed stream: its name, or a bzip2 signature somewhere in its first 4096 bytes."""
    head = F.substring(content, 1, 4096)
    pairs = F.concat(F.lit(" "), F.regexp_replace(F.hex(head), "(..)", "$1 "))  # bytes apart, so that a match begins at one
    packed = F.upper(F.element_at(F.split(path, "/"), -1)).contains("_MDM") | F.contains(pairs, F.lit(" 42 5A 68 "))
    return F.hex(F.substring(content, 1, 4)) == "41523256", F.length(content) >= VOLUME_HEADER, packed


def file_kind(content: Column, path: Column) -> Column:
    signed, whole, packed = _signs(content, path)
    return F.when(signed & whole, "BaseData").when(signed, "Unknown").when(packed, "CompressedStream").otherwise("Unknown")


def file_diagnostic(content: Column, path: Column) -> Column:
    """What inspection says of a file that is no volume; null for volumes, whose diagnostics come from decoding."""
    signed, whole, packed = _signs(content, path)
    return F.when(signed, F.when(~whole, KIND_TEXT["short"])).when(packed, KIND_TEXT["CompressedStream"]).otherwise(KIND_TEXT["Unknown"])


MESSAGES = pa.schema([("path", pa.string()), ("radar_id", pa.string()), ("volume_ms", pa.int64()), ("record_seq", pa.int64()), ("message_seq", pa.int64()), ("message_type", pa.int32()), ("message_ms", pa.int64()), ("radial_seq", pa.int64()), ("body", pa.binary()), ("diagnostic", pa.string())])
MESSAGES_DDL = "path string, radar_id string, volume_ms bigint, record_seq bigint, message_seq bigint, message_type int, message_ms bigint, radial_seq bigint, body binary, diagnostic string"


def message_length(data: bytes, at: int) -> int | None:
    """The length of the message whose header stands at `at`, if it is plausible."""
    if at + MESSAGE_HEADER > len(data):
        return None
    half, channel, kind, _, day, ms = struct.unpack_from(">HBBHHI", data, at)
    if not 1 <= kind <= 33 or channel not in CHANNELS or not 1 <= day <= 50_000 or ms > 86_400_000:
        return None
    if half == 0xFFFF:
        n = struct.unpack_from(">I", data, at + 12)[0]
    else:
        count, number = struct.unpack_from(">HH", data, at + 12)
        if not 1 <= count <= 4096 or not 1 <= number <= count:
            return None
        n = half * 2
    return n if MESSAGE_HEADER <= n <= MOST_MESSAGE else None


def messages_of(data: bytes) -> Iterator[bytes]:
    """Messages of a decompressed record, with zero padding between them; the last one is left out if the record ends inside it."""
    at = 0
    while at + MESSAGE_HEADER <= len(data):
        n = message_length(data, at)
        if n is None:
            if data[at]:
                raise ValueError("bytes before a message header are not padding")
            at += 1
            continue
        if at + n > len(data):
            return
        yield data[at : at + n]
        at += n


def _volume(path: str, content: bytes) -> Iterator[tuple]:
    radar, start, record, radials = None, None, -1, 0
    try:
        if len(content) < VOLUME_HEADER or content[:4] != b"AR2V":
            raise ValueError("no volume header")
        day, ms = struct.unpack_from(">ii", content, 12)
        radar, start = content[20:24].decode("ascii").rstrip("\0 "), (day - 1) * 86_400_000 + ms
        at = VOLUME_HEADER
        while at < len(content):
            (word,) = struct.unpack_from(">i", content, at)
            if word in (0, -(2**31)):
                raise ValueError(f"control word {word} at {at}")
            record += 1
            packed = content[at + 4 : at + 4 + abs(word)]
            if len(packed) < abs(word):
                raise ValueError(f"record {record} is cut short")
            at += 4 + abs(word)
            seq = 0
            for seq, m in enumerate(messages_of(bz2.decompress(packed)), 1):
                d, t = struct.unpack_from(">HI", m, 6)
                radial = m[3] == RADIAL and radial_of(m) is not None
                radials += radial
                yield path, radar, start, record, seq, m[3], (d - 1) * 86_400_000 + t, radials if radial else None, m, None
            if not seq:
                yield path, radar, start, record, None, None, None, None, None, None
    except (ValueError, OSError, EOFError, struct.error, UnicodeDecodeError) as e:
        yield path, radar, start, record if record >= 0 else None, None, None, None, None, None, str(e)


def messages(files: DataFrame) -> DataFrame:
    """One row per message of each file, one without message for a record that has none, and one with a diagnostic where decoding ended early.

    radial_seq numbers a file's radials from 1, in the order of the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                for rows in batched(_volume(path, content.as_py()), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows)), MESSAGES)], schema=MESSAGES)

    return files.select("path", "content").mapInArrow(run, MESSAGES_DDL)


def radial_of(m: bytes) -> bytes | None:
    """The radial behind the message header, cut to the length that it states; None if it is too short."""
    data = m[MESSAGE_HEADER:]
    if len(data) < RADIAL_HEADER:
        return None
    n = struct.unpack_from(">H", data, 18)[0]
    data = data[:n] if n else data
    return data if len(data) >= POINTERS else None


def pointed(radial: bytes) -> Iterator[bytes]:
    """The radial from each place on that it points to."""
    count = struct.unpack_from(">H", radial, 30)[0]
    for i in range(min(count, MOST_POINTERS, (len(radial) - POINTERS) // 4)):
        (p,) = struct.unpack_from(">i", radial, POINTERS + 4 * i)
        if 0 < p <= len(radial) - 4:
            yield radial[p:]


def moment_header(block: bytes) -> tuple | None:
    """(name, gates, first km, spacing km, word size, scale, offset) of a moment block, else None."""
    name = block[1:4].decode("ascii", "replace").rstrip("\0 ")
    if block[:1] != b"D" or len(block) < BLOCK_HEADER or not name:
        return None
    gates, first, spacing = struct.unpack_from(">HHH", block, 8)
    return name, gates, float(np.float32(first) / np.float32(1000)), float(np.float32(spacing) / np.float32(1000)), block[19], *struct.unpack_from(">ff", block, 20)


MOMENT = [("moment_name", pa.string()), ("gate_count", pa.int32()), ("first_km", pa.float32()), ("spacing_km", pa.float32()), ("word_size", pa.int32()), ("scale", pa.float32()), ("offset", pa.float32())]
MOMENT_DDL = "moment_name string, gate_count int, first_km float, spacing_km float, word_size int, scale float, offset float"
PLACE = ("path", "radar_id", "volume_ms", "record_seq", "message_seq", "message_ms", "radial_seq")
PLACE_DDL = "path string, radar_id string, volume_ms bigint, record_seq bigint, message_seq bigint, message_ms bigint, radial_seq bigint"


def _of_radials(message_rows: DataFrame, rows_of, fields: list, ddl: str) -> DataFrame:
    """rows_of(radial) under the place of each radial."""
    kinds = [(f.name, f.type) for f in MESSAGES if f.name in PLACE]
    schema = pa.schema([*kinds, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = zip(*(b.column(c).to_pylist() for c in PLACE))
            found = ((*place, *row) for place, body in zip(places, b.column("body")) for row in rows_of(radial_of(body.as_py())))
            for rows in batched(found, 2000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return message_rows.filter("radial_seq is not null").select(*PLACE, "body").mapInArrow(run, f"{PLACE_DDL}, {ddl}")


def radials(message_rows: DataFrame) -> DataFrame:
    """One row per radial: state, elevation, cut sector, the headers of its moment blocks and how many constant blocks it points to."""

    def one(r: bytes) -> Iterator[tuple]:
        blocks = list(pointed(r))
        names = [b[:4] for b in blocks]
        heads = [dict(zip((n for n, _ in MOMENT), h)) for h in map(moment_header, blocks) if h]
        yield r[21], r[22], r[23], struct.unpack_from(">f", r, 24)[0], heads, *(names.count(n) for n in CONSTANT_BLOCKS)

    counts = ("volume_blocks", "elevation_blocks", "radial_blocks")
    fields = [("radial_status", pa.int32()), ("elevation_number", pa.int32()), ("cut_sector", pa.int32()), ("elevation_angle", pa.float32()), ("headers", pa.list_(pa.struct(MOMENT))), *[(c, pa.int64()) for c in counts]]
    return _of_radials(message_rows, one, fields, "radial_status int, elevation_number int, cut_sector int, elevation_angle float, headers array<struct<" + MOMENT_DDL.replace(" ", ":").replace(",:", ",") + ">>, " + ", ".join(f"{c} bigint" for c in counts))


def moment_headers(radial_rows: DataFrame) -> DataFrame:
    """One row per moment block, as AG9's summary takes them."""
    return radial_rows.select(*PLACE, F.posexplode("headers").alias("block_seq", "h")).select(*PLACE, F.col("block_seq").cast("bigint").alias("block_seq"), "h.*")


def moment_blocks(message_rows: DataFrame) -> DataFrame:
    """One row per moment block whose gates are whole 8-bit or 16-bit words, with its gates; block_seq counts a radial's blocks from 0."""

    def some(r: bytes) -> Iterator[tuple]:
        for i, block in enumerate(pointed(r)):
            head = moment_header(block)
            if head is None or head[4] not in (8, 16) or len(block) - BLOCK_HEADER < head[1] * head[4] // 8:
                continue
            yield r[21], r[22], i, *head, np.frombuffer(block, ">u2" if head[4] == 16 else "u1", head[1], BLOCK_HEADER).astype(np.int32)

    fields = [("radial_status", pa.int32()), ("elevation_number", pa.int32()), ("block_seq", pa.int64()), *MOMENT, ("gates", pa.list_(pa.int32()))]
    return _of_radials(message_rows, some, fields, f"radial_status int, elevation_number int, block_seq bigint, {MOMENT_DDL}, gates array<int>")


def gates_from(blocks: DataFrame) -> DataFrame:
    """One row per gate with status, calibrated value and range."""
    from ..functions.payload import calibrated, gate_status, range_km

    rows = blocks.select("*", F.posexplode("gates").alias("gate_index", "raw_value")).drop("gates")
    rows = rows.withColumn("status", gate_status(F.col("moment_name"), F.col("raw_value"), F.col("scale")))
    return rows.withColumn("calibrated", calibrated(F.col("raw_value"), F.col("scale"), F.col("offset"), F.col("status"))).withColumn("range_km", range_km(F.col("first_km"), F.col("spacing_km"), F.col("gate_index")))


def message_histogram(message_rows: DataFrame) -> DataFrame:
    return message_rows.filter("message_type is not null").groupBy("message_type").agg(F.count("*").alias("messages"))


def constant_blocks(radial_rows: DataFrame) -> DataFrame:
    """How many constant blocks of the volume, the elevation and the radial there are."""
    return radial_rows.agg(*[F.coalesce(F.sum(f"{c}_blocks"), F.lit(0)).alias(c) for c in ("volume", "elevation", "radial")])


def inventory(files: DataFrame, message_rows: DataFrame | None = None) -> DataFrame:
    """One row: files by kind and bytes; with the messages also files with a diagnostic, records, messages, radials and estimated gate events.

    Estimated are the gates that moment headers announce, whether or not they can be decoded.
    """
    kinds = files.select("length", file_kind(F.col("content"), F.col("path")).alias("kind"))
    totals = kinds.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("BaseData", "CompressedStream", "Unknown")])
    if message_rows is None:
        return totals
    each = message_rows.groupBy("path").agg(F.max(F.col("record_seq") + 1).alias("records"), F.count("message_type").alias("messages"), F.count("diagnostic").alias("bad"))
    seen = each.agg(F.count_if(F.col("bad") > 0).alias("with_diagnostic"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "messages")])
    gates = F.aggregate("headers", F.lit(0).cast("bigint"), lambda a, h: a + h.gate_count)
    found = radials(message_rows).agg(F.count("*").alias("radials"), F.coalesce(F.sum(gates), F.lit(0)).alias("estimated_events"))
    return totals.withColumn("one", F.lit(1)).join(seen.withColumn("one", F.lit(1)), "one").join(found.withColumn("one", F.lit(1)), "one").drop("one")


def parsed_key(path: Column) -> dict[str, Column]:
    """yyyy/MM/dd/RADAR/file to typed columns; the volume's time is null unless its date is that of the path."""
    part = F.split(path, "/")
    day = F.try_to_date(F.concat_ws("-", part[0], part[1], part[2]), "yyyy-MM-dd")
    stamp = F.try_to_timestamp(F.regexp_extract(F.element_at(part, -1), r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))
    ok = (F.size(part) == 5) & day.isNotNull()
    return {"archive_date": F.when(ok, day), "radar_id": F.when(ok, part[3]), "file_name": F.when(ok, F.element_at(part, -1)), "volume_timestamp": F.when(ok & (stamp.cast("date") == day), stamp)}


MANIFEST = "date date, files array<struct<radarId:string,archiveDate:date,archivePath:string,fileName:string,sizeBytes:bigint,lastModified:timestamp,volumeTimestamp:timestamp>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select("date", F.explode("files").alias("f")).select("date", "f.*")


def write_manifest(files: DataFrame, path: str) -> None:
    """files: the columns of read_manifest; one document per date, so a date's listing is one row."""
    names = ["radarId", "archiveDate", "archivePath", "fileName", "sizeBytes", "lastModified", "volumeTimestamp"]
    files.groupBy("date").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("files")).write.json(path)


def of_radars(files: DataFrame, radars: DataFrame | None) -> DataFrame:
    """Files of the wanted radars; no radars wanted means all."""
    return files if radars is None or radars.isEmpty() else files.join(radars.select(F.upper("radar_id").alias("radar_id")).distinct(), "radar_id", "left_semi")
