"""WARC archives: a writer with payload revisits and a splittable reader.

An archive is a folder of files of gzip members, one record each. Spark's text writer puts them down, so task retries and commits are Spark's
own and any file system of Spark serves; the line separator is an empty gzip member, which keeps each file one valid
gzip stream. The reader cuts files into byte ranges: a task looks for the gzip magic in its range, takes a candidate for a
record if it decodes to a header that starts with `WARC/`, owns every record that starts inside the range and reads past the
range's end to finish the last one.

Defined results: a null payload is empty; a null id gives an empty id that reads back as null; a null url gives no
WARC-Target-URI. Of the rows with equal payloads of at least revisit_bytes bytes those with the largest id are responses (rows
that repeat that id too; if all ids are null, all of them), the others revisits. Empty tables give an empty archive. A record is held in memory as a whole, by the
writer and by the reader.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, partitions, small, small_batches, written

MAGIC = b"\x1f\x8b\x08"
NOTHING = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"  # an empty gzip member
ID = "<urn:page:{}>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
BATCH_BYTES = 8 << 20


def member(page: int | None, url: bytes | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    block = HTTP % size + (b"" if revisit else payload)
    head = ["WARC/1.1", "WARC-Type: " + ("revisit" if revisit else "response"), "WARC-Record-ID: " + ID.format("" if page is None else page), "WARC-Date: " + date]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url.decode("utf-8", "replace")))
    if revisit:
        head += ["WARC-Refers-To: " + ID.format("" if refers_to is None else refers_to), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def write_archive(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record per row of pages under path."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
    copies = rows.select("page", "digest", "size").filter(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # few groups of copies reach the tasks by broadcast, so that payloads don't travel
    rows = rows.join(small(written(copies), 100), ["digest", "size"], "left").withColumn("revisit", F.coalesce(~F.col("page").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    rows = rows.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            col = {n: b.column(n) for n in ("page", "digest", "size", "first", "revisit")}
            for i, (u, p) in enumerate(zip(buffers(b.column("url")), buffers(b.column("payload")))):
                v = {n: c[i].as_py() for n, c in col.items()}
                out.append(member(v["page"], u, p or b"", v["digest"], v["size"], v["first"], v["revisit"], date))
                held += len(out[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    gz = rows.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    gz.write.option("lineSep", NOTHING).option("encoding", "ISO-8859-1").text(path)


RECORDS = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])


class Window:
    """A file's bytes from `start` on, read piece by piece; what lies before a position can be let go."""

    def __init__(self, file: pa.NativeFile, start: int, piece: int = 1 << 20):
        self.file, self.at, self.piece, self.data, self.ended = file, start, piece, bytearray(), False
        file.seek(start)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(self.piece)
        self.ended = not got
        self.data += got
        return bool(got)

    def forget(self, before: int) -> None:
        del self.data[: before - self.at]
        self.at = before

    def find(self, what: bytes, start: int, end: int) -> int:
        """The first place of `what` in [start, end), or -1."""
        while True:
            p = self.data.find(what, start - self.at)
            if p >= 0:
                return p + self.at if p + self.at < end else -1
            start = max(start, self.at + len(self.data) - len(what) + 1)
            if start >= end or not self.more():
                return -1

    def inflate(self, start: int) -> tuple[bytes, int] | None:
        """The gzip member at start and where it ends, if it is a WARC record."""
        gz, out, at = zlib.decompressobj(31), [], start
        try:
            while not gz.eof:
                if at - self.at >= len(self.data) and not self.more():
                    return None
                piece = bytes(self.data[at - self.at : at - self.at + (4096 if not out else self.piece)])
                out.append(gz.decompress(piece))
                at += len(piece)
                if len(head := b"".join(out[:2])[:5]) == 5 and head != b"WARC/":
                    return None
        except zlib.error:
            return None
        whole = b"".join(out)
        return (whole, at - len(gz.unused_data)) if whole.startswith(b"WARC/") else None


def parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    number = lambda name: int(m[1]) if (m := re.search(r"(-?\d+)>$", field.get(name, ""))) else None
    block = rest[: int(field.get("content-length", len(rest)))]
    payload = block.partition(b"\r\n\r\n")[2] if field.get("content-type", "").startswith("application/http") else block
    if revisit := field.get("warc-type") == "revisit":
        digest, size = base64.b32decode(field.get("warc-payload-digest", "").rpartition(":")[2]).hex(), int(field.get("warc-payload-length", 0))
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"record_id": number("warc-record-id"), "record_type": field.get("warc-type"), "target_uri": field.get("warc-target-uri"), "refers_to": number("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload}


def _file(path: str) -> pa.NativeFile:
    fs, name = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(name)


def ranged(paths: list[str]) -> bool:
    """Whether tasks can read byte ranges of these files themselves; else Spark reads them whole."""
    try:
        for p in paths[:1]:
            _file(p).close()
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def read_archive(spark: SparkSession, path: str, split_bytes: int = 16 << 20, payloads: bool = True, ranges: bool | None = None) -> DataFrame:
    """The records under path: record_id, record_type, target_uri, refers_to, payload_digest (SHA-1 of what was read; of a revisit the
    one it states), payload_bytes, payload (null for revisits, or without `payloads`), file, offset.

    ranges: tasks open byte ranges of the files; where only Spark can open them (None finds out), each file is one range that Spark's
    binaryFile source hands over whole.
    """
    small_batches(spark)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    if ranges is None:
        ranges = ranged([r["path"] for r in every.select("path").limit(1).collect()])
    if ranges:
        starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
        splits = every.select("path", "length", starts).repartition(partitions(spark)).select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"), F.lit(None).cast("binary").alias("content"))
    else:
        splits = every.select("path", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), "content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for k, (name, start, end) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")))):
                whole = b.column("content")[k]
                with pa.BufferReader(whole.as_buffer()) if whole.is_valid else _file(name) as f:
                    w, at = Window(f, start), start
                    while (at := w.find(MAGIC, at, end)) >= 0:
                        w.forget(at)
                        if (got := w.inflate(at)) is None:
                            at += 1
                            continue
                        row = parsed(got[0]) | {"file": name, "offset": at}
                        held += len(row["payload"] or b"") + 500
                        out.append(row if payloads else row | {"payload": None})
                        at = got[1]
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(out, RECORDS)
                            out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, RECORDS)

    return splits.mapInArrow(scan, "record_id bigint, record_type string, target_uri string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, file string, offset bigint")
