"""Volume files built byte by byte."""

from __future__ import annotations

import bz2
import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from cirrolite.functions.keys import Universe
from cirrolite.operators import rollups, runs, validation, windows
from cirrolite.operators.handlers import COUNTER
from cirrolite.operators.projection import stream_events_from
from cirrolite.sources import archive


def header(body: int, kind: int, ms: int) -> bytes:
    return struct.pack(">HBBHHIHH", (16 + body) // 2, 0, kind, 0, 20578, ms, 1, 1)


def block(name: bytes, values: list[int], word: int, scale: float, offset: float) -> bytes:
    data = struct.pack(f">{len(values)}{'H' if word == 16 else 'B'}", *values)
    return b"D" + name + bytes(4) + struct.pack(">HHH", len(values), 2125, 250) + bytes(5) + bytes([word]) + struct.pack(">ff", scale, offset) + data


def radial(elevation: int, blocks: list[bytes], ms: int, status: int = 3) -> bytes:
    """A message header, then the radial; lengths and pointers count from the radial's first byte."""
    start, pointers = 72, []
    body = b""
    for b in blocks:
        pointers.append(start + len(body))
        body += b + bytes(len(b) % 2)
    data = bytearray(start) + body
    struct.pack_into(">H", data, 18, len(data))
    data[21], data[22], data[23] = status, elevation, elevation % 3
    struct.pack_into(">f", data, 24, elevation / 2)
    struct.pack_into(">H", data, 30, len(pointers))
    for i, p in enumerate(pointers):
        struct.pack_into(">i", data, 32 + 4 * i, p)
    return header(len(data), 31, ms) + bytes(data)


def volume(records: list[bytes]) -> bytes:
    out = b"AR2V0006.001" + struct.pack(">ii", 20578, 164018) + b"KTLX"
    for r in records:
        p = bz2.compress(r)
        out += struct.pack(">i", -len(p)) + p
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    day = root / "2026/05/05/KTLX"
    day.mkdir(parents=True)
    plain = header(4, 2, 1000) + bytes(4)
    a = radial(1, [block(b"REF", [0, 1, 2, 70], 8, 2.0, 66.0), block(b"VEL", [129, 300], 16, 2.0, 129.0)], 2000)
    b = radial(2, [block(b"CFP", [0, 1, 2, 5, 9], 8, 1.0, 8.0)], 3000)
    (day / "KTLX20260505_000244_V06").write_bytes(volume([plain + bytes(20), a + bytes(6) + b]))
    (day / "KTLX20260505_000744_V06").write_bytes(volume([a])[:-7])
    (day / "KTLX20260505_000844_V06_MDM").write_bytes(b"\0\0\0\x01BZh9")
    (root / "other.bin").write_bytes(b"nothing here")
    return str(root)


def test_scan_and_kinds(spark, folder):
    assert archive.scan_files(spark, folder).count() == 4
    assert archive.scan_files(spark, folder, radar="ktlx").count() == 3
    assert archive.scan_files(spark, folder, day=date(2026, 5, 5), most=2).count() == 2
    assert archive.inventory(archive.scan_files(spark, folder)).select("files", "basedata", "compressedstream", "unknown").first() == (4, 2, 1, 1)


def test_messages_and_gates(spark, folder):
    m = archive.messages(archive.scan_files(spark, folder, radar="KTLX")).cache()
    assert {r["message_type"]: r["messages"] for r in archive.message_histogram(m).collect()} == {2: 1, 31: 2}
    bad = m.filter("diagnostic is not null").collect()
    assert len(bad) == 2 and any("cut short" in r["diagnostic"] for r in bad) and any("no volume header" in r["diagnostic"] for r in bad)
    assert m.filter("message_type = 2").select("radar_id", "volume_ms", "message_ms").first() == ("KTLX", 20577 * 86_400_000 + 164018, 20577 * 86_400_000 + 1000)
    g = archive.gates_from(archive.moment_blocks(m))
    got = {(r["moment_name"], r["gate_index"]): (r["raw_value"], r["status"], r["calibrated"], round(r["range_km"], 3)) for r in g.collect()}
    assert got == {
        ("REF", 0): (0, 1, None, 2.125), ("REF", 1): (1, 2, None, 2.375), ("REF", 2): (2, 0, -32.0, 2.625), ("REF", 3): (70, 0, 2.0, 2.875),
        ("VEL", 0): (129, 0, 0.0, 2.125), ("VEL", 1): (300, 0, 85.5, 2.375),
        ("CFP", 0): (0, 3, None, 2.125), ("CFP", 1): (1, 4, None, 2.375), ("CFP", 2): (2, 5, None, 2.625), ("CFP", 3): (5, 6, None, 2.875), ("CFP", 4): (9, 0, 1.0, 3.125),
    }
    assert archive.constant_blocks(archive.radials(m)).first() == (0, 0, 0)
    assert [(r["path"][-3:], r["radial_seq"]) for r in m.filter("message_type = 31").orderBy("path", "radial_seq").collect()] == [("V06", 1), ("V06", 2)]
    total = archive.inventory(archive.scan_files(spark, folder), m).select("files", "with_diagnostic", "records", "messages", "radials", "estimated_events").first()
    assert total == (4, 2, 3, 3, 2, 11)


def test_keys_and_manifest(spark, folder, tmp_path):
    keys = spark.createDataFrame([("2026/05/05/KTLX/KTLX20260505_000244_V06",), ("2026/05/06/KTLX/KTLX20260505_000244_V06",), ("2026/13/05/KTLX/x",), (None,)], "path string")
    got = [(str(r["archive_date"]), r["radar_id"], r["volume_timestamp"] is not None) for r in keys.select(*[c.alias(n) for n, c in archive.parsed_key(F.col("path")).items()]).collect()]
    assert got == [("2026-05-05", "KTLX", True), ("2026-05-06", "KTLX", False), ("None", None, False), ("None", None, False)]
    files = spark.createDataFrame([("2026-05-05", "KTLX", "2026-05-05", "p", "f", 5)], "d string, radarId string, a string, archivePath string, fileName string, sizeBytes bigint").select(
        F.col("d").cast("date").alias("date"), "radarId", F.col("a").cast("date").alias("archiveDate"), "archivePath", "fileName", "sizeBytes", F.lit(None).cast("timestamp").alias("lastModified"), F.lit(None).cast("timestamp").alias("volumeTimestamp"))
    archive.write_manifest(files, str(tmp_path / "m"))
    assert archive.read_manifest(spark, str(tmp_path / "m")).drop("lastModified", "volumeTimestamp").collect() == files.drop("lastModified", "volumeTimestamp").collect()
    assert archive.of_radars(spark.createDataFrame([("KTLX",), ("KINX",)], "radar_id string"), spark.createDataFrame([], "radar_id string")).count() == 2


def block_of_gates() -> bytes:
    return block(b"REF", list(b"RVOLRELVRRAD"), 8, 2.0, 66.0)


def archived(spark, files: dict[str, list[bytes]]):
    """Messages of volumes that hold the records."""
    rows = [(path, bytearray(volume(records))) for path, records in files.items()]
    return archive.messages(spark.createDataFrame(rows, "path string, content binary")).cache()


def test_summaries_of_radials(spark):
    """Constant blocks count where a pointer leads, not in gate data; sweeps end with the elevation."""
    a = radial(1, [b"RVOL" + bytes(40), b"RRAD" + bytes(24), block_of_gates()], 5)
    b = radial(1, [b"RELV" + bytes(8), block(b"VEL", [1], 8, 1.0, 3.0)], 6, status=1)
    c = radial(2, [block(b"REF", [1, 2], 16, 4.0, 60.0)], 7, status=1)
    m = archived(spark, {"x": [a + b, c]})
    r = archive.radials(m)
    assert archive.constant_blocks(r).first() == (1, 1, 1)
    got = {x["moment_name"]: x for x in rollups.moment_summary(archive.moment_headers(r)).collect()}
    assert (got["REF"]["radials"], got["REF"]["gates"], got["REF"]["min_gate_count"], got["REF"]["max_word_size"], got["REF"]["min_scale"], got["REF"]["max_offset"]) == (2, 14, 2, 16, 2.0, 66.0)
    names = F.transform("headers", lambda h: h.moment_name)
    sweeps = rollups.sweep_summary(windows.sweeps(r.withColumns({"volume_id": F.col("path"), "radial_key": F.col("radial_seq"), "moments": names}))).orderBy("sweep").collect()
    assert [(x["radials"], x["avg_elevation_angle"], x["min_cut_sector"], x["start_status"], x["end_status"], x["moments"], x["volume_blocks"], x["elevation_blocks"]) for x in sweeps] == [
        (2, 0.5, 1, 3, 1, ["REF", "VEL"], 1, 1), (1, 1.0, 2, 1, 1, ["REF"], 0, 0)]


def test_archive_to_run(spark, tmp_path):
    """Blocks become events of range bands with ids, payload places and batches, and a run's five tables."""
    ref, vel = block(b"REF", [1, 2, 3, 4, 5], 8, 2.0, 66.0), block(b"VEL", [300, 301], 16, 2.0, 129.0)
    m = archived(spark, {"b": [radial(1, [vel], 30)], "a": [radial(1, [ref, vel], 10) + radial(2, [ref], 20)], "c": [radial(9, [ref], 40)]})
    universe = Universe(2, 4, 2, 2)
    events, rejected = stream_events_from(archive.moment_blocks(m), universe)
    got = [tuple(r) for r in events.orderBy("event_seq").select("path", "batch_seq", "radial_seq", "moment_name", "moment_id", "elevation_slot", "azimuth_bucket", "range_band", "gate_start", "gates", "payload_offset", "payload_length", "source_id").collect()]
    assert got == [
        ("a", 0, 1, "REF", 0, 0, 0, 0, 0, [1, 2], 0, 2, 0), ("a", 0, 1, "REF", 0, 0, 0, 1, 2, [3, 4, 5], 2, 3, 1), ("a", 0, 1, "VEL", 1, 0, 0, 0, 0, [300], 5, 2, 0), ("a", 0, 1, "VEL", 1, 0, 0, 1, 1, [301], 7, 2, 1),
        ("a", 0, 2, "REF", 0, 1, 1, 0, 0, [1, 2], 9, 2, 6), ("a", 0, 2, "REF", 0, 1, 1, 1, 2, [3, 4, 5], 11, 3, 7), ("b", 1, 1, "VEL", 1, 0, 0, 0, 0, [300], 0, 2, 0), ("b", 1, 1, "VEL", 1, 0, 0, 1, 1, [301], 2, 2, 1)]
    events.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    assert [r["error"] for r in rejected.collect()] == ["SourceOutOfRange"] * 2
    checked = events.withColumns({"batch_bytes": F.when(F.col("batch_seq") == 0, 14).otherwise(4), **{c: F.lit(1) for c in ("schema_version", "universe_version", "dictionary_version")}})
    assert [r["error"] for r in validation.batch_errors(checked, universe, (1, 2)).collect()] == [None, None]
    good, bad = validation.accepted_batches(checked, universe)
    assert (good.count(), bad.count()) == (2, 0)
    done = rollups.batch_metrics(events).withColumn("status", F.lit("Succeeded"))
    runs.store(spark, runs.run_tables("r", 1, events, done, universe.sources, [COUNTER]), str(tmp_path))
    assert runs.of_run(spark, str(tmp_path), "sources", "r", active=True).count() == 4
    assert runs.latest_run(spark, str(tmp_path)).select("batch_count", "event_count", "value_count").first() == (2, 8, 14)
    assert runs.of_run(spark, str(tmp_path), "handler_values", "r", field="raw_checksum", source_id=1).first()["int64_value"] == 3 + 4 + 5 + 301 + 301
    assert runs.of_run(spark, str(tmp_path), "diagnostics", "r").first()["complete"]
