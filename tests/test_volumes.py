"""Volumes read by byte ranges."""

from __future__ import annotations

import bz2
import struct

import pytest
from pyspark.sql import functions as F

from cirrolite.sources import archive, volumes

from .test_archive import block, header, radial, volume


def radials(n: int, first: int = 0) -> bytes:
    return b"".join(radial(1 + k % 3, [block(b"REF", list(range(40 + k % 5)), 8, 2.0, 66.0)], 1000 * (first + k)) + bytes(k % 4) for k in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("volumes")
    many = [header(4, 2, 500) + bytes(4) + bytes(10), *[radials(n, 20 * i) for i, n in enumerate([3, 0, 7, 1, 12, 5, 9, 2, 4, 6])]]
    many[2] = bytes(40)  # a record of padding
    whole = volume(many)
    (root / "a_whole").write_bytes(whole)
    place = 24
    for _ in range(4):
        place += 4 + abs(struct.unpack_from(">i", whole, place)[0])
    bad = bytearray(whole)
    bad[place + 20 : place + 40] = bytes(20)  # the fifth record can't be decompressed
    (root / "b_record").write_bytes(bytes(bad))
    (root / "c_word").write_bytes(whole[:place] + bytes(4) + whole[place + 4 :])
    (root / "d_cut").write_bytes(whole[: place + 30])
    (root / "e_message").write_bytes(volume([radials(2), radials(3)[:-30], radials(4)]))
    (root / "f_none").write_bytes(b"AR2V")
    (root / "g_noise").write_bytes(volume([radials(1), b"\x07" + radials(2), radials(2)]))
    (root / "sub").mkdir()
    (root / "sub/h_deep").write_bytes(volume([radials(2)]))
    (root / "i_empty").write_bytes(b"")
    return root


def of(df, name):
    return df.filter(F.col("path").endswith(name))


@pytest.mark.parametrize("split", [1, 50, 333, 1 << 20])
def test_each_record_has_one_owner(spark, folder, split):
    if split == 1:  # a partition for each byte of a small file
        folder = folder / "sub"
    got = volumes.records(spark, str(folder), split)
    assert got.groupBy("path", "record_seq").count().filter("count > 1").isEmpty()
    if split > 1:
        packed = [r["packed"] for r in of(got, "a_whole").orderBy("record_seq").collect()]
        assert len(packed) == 11 and bytes(packed[2]) == bz2.compress(bytes(40))
        assert {r["path"].rsplit("/", 1)[1]: r["diagnostic"] for r in got.filter("diagnostic is not null").collect()} == {
            "c_word": r"control word 0 at %d" % of(got, "c_word").agg(F.max("record_offset")).first()[0], "d_cut": "record 4 is cut short", "f_none": "no volume header", "i_empty": "no volume header"}
    assert of(got, "h_deep").count() == 1


def test_tasks_hold_ranges(spark, folder):
    rows = volumes.records(spark, str(folder / "a_whole"), 200).withColumn("task", F.spark_partition_id())
    per = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert len(per) > 5 and sum(per) == 11


def test_messages_are_those_of_whole_files(spark, folder):
    """Where nothing is bad inside, the same rows as by decoding files as a whole."""
    got = volumes.volume_messages(spark, str(folder), 100, tasks=7).cache()
    cols = ["record_seq", "message_seq", "message_type", "message_ms", "radial_seq", "radar_id", "volume_ms"]
    whole = archive.messages(archive.scan_files(spark, str(folder)).filter("length > 30")).cache()
    for name, radial_count in (("a_whole", 49), ("h_deep", 2), ("e_message", 8)):
        mine = sorted(map(str, of(got, name).select(*cols, F.md5("body")).collect()))
        assert mine == sorted(map(str, of(whole, name).select(*cols, F.md5("body")).collect()))
        assert of(got, name).agg(F.max("radial_seq"), F.count("radial_seq")).first() == (radial_count, radial_count)
    assert of(got, "a_whole").filter("diagnostic is not null").isEmpty() and of(got, "a_whole").filter("message_seq is null").count() == 1
    assert archive.gates_from(archive.moment_blocks(of(got, "a_whole"))).count() == archive.gates_from(archive.moment_blocks(of(whole, "a_whole"))).count() > 1000


def test_a_bad_record_costs_that_record(spark, folder):
    got = volumes.volume_messages(spark, str(folder), 100).cache()
    bad = of(got, "b_record").filter("diagnostic is not null").collect()
    assert [(r["record_seq"], r["message_seq"]) for r in bad] == [(4, None)]
    assert of(got, "b_record").agg(F.max("radial_seq"), F.max("record_seq")).first() == (49 - 1, 10)  # the fifth record had one radial
    assert [(r["record_seq"], r["message_seq"]) for r in of(got, "g_noise").orderBy("record_seq", "message_seq").collect()] == [(0, 1), (1, None), (2, 1), (2, 2)]
    assert of(got, "c_word").agg(F.max("record_seq"), F.count("diagnostic")).first() == (4, 1) and of(got, "d_cut").filter("diagnostic is not null").first()["diagnostic"] == "record 4 is cut short"
    assert of(got, "e_message").filter("record_seq = 1").count() == 2 and of(got, "e_message").filter("record_seq = 2").count() == 4  # the message that its record ends is left out
    assert of(got, "f_none").select("radar_id", "diagnostic").first() == (None, "no volume header")


def test_paths_for_pyarrow():
    assert [volumes.for_pyarrow(p) for p in ("/a/b", "file:/a", "file:///a", "s3a://k/x", "hdfs://h/x", "abfss://c@a/x")] == ["file:///a/b", "file:///a", "file:///a", "s3://k/x", "hdfs://h/x", "abfs://c@a/x"]


def test_kinds_and_diagnostics(spark):
    rows = [("a/short", b"AR2V0006"), ("a/whole", b"AR2V" + bytes(20)), ("a/x_mdm", b"x"), ("a/late", b"\x04\x25\xa6\x84\x25\xa6\x80BZh"), ("a/odd", bytes.fromhex("0425a680")), ("a/none", b""), ("a/far", bytes(4094) + b"BZh"), ("a/near", bytes(4093) + b"BZh")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r[0][2:]: (r[1], r[2]) for r in df.select("path", archive.file_kind(F.col("content"), F.col("path")), archive.file_diagnostic(F.col("content"), F.col("path"))).collect()}
    packed, unknown = ("CompressedStream", archive.KIND_TEXT["CompressedStream"]), ("Unknown", archive.KIND_TEXT["Unknown"])
    assert got == {"short": ("Unknown", archive.KIND_TEXT["short"]), "whole": ("BaseData", None), "x_mdm": packed, "late": packed, "odd": unknown, "none": unknown, "far": unknown, "near": packed}
