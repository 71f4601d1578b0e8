"""Order-sensitive checksums: 64-bit FNV-1a folds, as hex.

A fold is sequential within its key (batch or source), so keys are the parallelism: many keys at once, one numpy step per position. The chronology
checksum is associative and folds per slice of the order, to be combined in a second, small step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of FNV-1a.
BASIS, PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)

EVENT = [("message_ticks", 8), ("source_id", 4), ("record", 4), ("message", 4), ("radial_seq", 4), ("moment_id", 2), ("gate_start", 2), ("gate_count", 2), ("gate_count", 8), ("raw_sum", 8)]
METADATA = [("volume_ticks", 8), ("message_ticks", 8), ("source_id", 4), ("record", 4), ("message", 4), ("radial_seq", 4), ("payload_offset", 4), ("gate_count", 4), ("scale_bits", 4), ("offset_bits", 4),
            ("radar_ordinal", 2), ("moment_id", 2), ("elevation_slot", 2), ("azimuth_bucket", 2), ("range_band", 2), ("gate_start", 2), ("gate_count", 2), ("word_size", 1), ("status_model", 1)]


def fold(hash_: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Appends the little-endian bytes of values, element by element."""
    v = values.astype(np.int64).astype(np.uint64)
    for i in range(size):
        hash_ = (hash_ ^ ((v >> np.uint64(8 * i)) & np.uint64(255))) * PRIME
    return hash_


def hexed(h: np.uint64) -> str:
    return f"{int(h):016x}"


def fold_keys(rows: DataFrame, key: str, order: str, fields: list[tuple[str, int]], header: list[tuple[str, int]] | None = None) -> DataFrame:
    """(key, rows, checksum): the fold over each key's rows in order, after the header's fields of its first row. Rows without key have no fold.

    Spark deals and sorts the rows; a task folds the keys of a batch side by side, position by position, and carries the last key's hash into the next batch,
    so a key of any size takes no more memory than a batch.
    """
    header = header or []
    names = list(dict.fromkeys(c for c, _ in [*header, *fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, n, h) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array([hexed(x) for x in h], pa.string())], [key, "rows", "checksum"])

        last = None  # key, rows and hash of the key that may go on
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy(zero_copy_only=False)
            column = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            h, n = np.full(len(first), BASIS), size.astype(np.int64)
            for c, width in header:
                h = fold(h, column[c][first], width)
            if last and last[0] == keys[0]:
                n[0], h[0] = n[0] + last[1], last[2]
            elif last:
                yield out(*([x] for x in last))
            longest = np.argsort(-size, kind="stable")
            falling = -size[longest]
            for j in range(int(size.max())):
                live = longest[: np.searchsorted(falling, -j)]
                at, x = first[live] + j, h[live]
                for c, width in fields:
                    x = fold(x, column[c][at], width)
                h[live] = x
            last = (keys[-1], n[-1], h[-1])
            yield out(keys[first[:-1]], n[:-1], h[:-1])
        if last:
            yield out(*([x] for x in last))

    dealt = rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return dealt.select(F.col(key).cast("bigint").alias(key), *[c for c in names if c != key]).mapInArrow(run, f"{key} bigint, rows bigint, checksum string")


def source_checksums(events: DataFrame) -> DataFrame:
    """Per source: the fold over its events in order of event_seq."""
    return fold_keys(events, "source_id", "event_seq", EVENT).drop("rows")


def batch_checksums(events: DataFrame, versions: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Per batch: the fold over its header (versions, number of events, payload length), then its events."""
    whole = Window.partitionBy("batch_seq")
    head = {"_schema": F.lit(versions[0]), "_universe": F.lit(versions[1]), "_dictionary": F.lit(versions[2]), "_events": F.count("*").over(whole), "_bytes": F.sum("gate_count").over(whole)}
    return fold_keys(events.withColumns(head), "batch_seq", "event_seq", METADATA, list(zip(head, (4, 8, 4, 4, 4)))).drop("rows")


# ---- one long fold in parallel ----
#
# Appending a byte changes the lowest eight bits of the hash by the byte and multiplies: the low byte runs on its own, and what lies above it is only multiplied.
# So the fold of a range is known once its results for the 256 possible low bytes are: from a hash h with low byte l it leads to table[l] + (h - l) * PRIME ** bytes.


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(PRIME), n, 1 << 64))


def composed(first: np.ndarray, then: np.ndarray, bytes_then: int) -> np.ndarray:
    """The table of two ranges in a row."""
    low = first & np.uint64(255)
    return then[low.astype(np.int64)] + (first - low) * power(bytes_then)


def fold_table(column: dict[str, np.ndarray], fields: list[tuple[str, int]], lanes: int = 64) -> tuple[np.ndarray, int]:
    """The table of all rows in order and their bytes: `lanes` slices of them side by side, then one after the other."""
    n, width = len(column[fields[0][0]]), sum(w for _, w in fields)
    at = np.arange(min(lanes, n) + 1) * n // max(1, min(lanes, n))
    first, size = at[:-1], np.diff(at)
    tables = np.tile(np.arange(256, dtype=np.uint64), (len(first), 1))
    for j in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > j)
        h = tables[live]
        for c, w in fields:
            h = fold(h, column[c][first[live] + j][:, None], w)
        tables[live] = h
    whole = np.arange(256, dtype=np.uint64)
    for t, k in zip(tables, size):
        whole = composed(whole, t, int(k) * width)
    return whole, n * width


def fold_ordered(rows: DataFrame, order: str, fields: list[tuple[str, int]], slices: int = 64) -> DataFrame:
    """One row: rows and checksum of the fold over all rows by `order`, which must be unique. Ranges of the order fold in parallel; at most `slices` tables of 2 KB meet in the last step."""
    names = [c for c, _ in fields]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, table, size, n = None, np.arange(256, dtype=np.uint64), 0, 0
        for b in batches:
            if b.num_rows:
                begin = b.column("_order")[0].as_py() if begin is None else begin
                t, k = fold_table({c: b.column(c).to_numpy(zero_copy_only=False) for c in names}, fields)
                table, size, n = composed(table, t, k), size + k, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int64()), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([table.tobytes()], pa.binary())], ["begin", "n", "size", "fold"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        h = int(BASIS)
        for t, k in frame.sort_values("begin")[["fold", "size"]].itertuples(index=False):
            h = (int(np.frombuffer(t, np.uint64)[h & 255]) + (h - (h & 255)) * int(power(k))) % (1 << 64)
        return pd.DataFrame({"rows": [int(frame["n"].sum())], "checksum": [f"{h:016x}"]})

    dealt = rows.select(F.col(order).cast("bigint").alias("_order"), *dict.fromkeys(names)).repartitionByRange(slices, "_order").sortWithinPartitions("_order")
    return dealt.mapInArrow(part, "begin bigint, n bigint, size bigint, fold binary").groupBy().applyInPandas(whole, "rows bigint, checksum string")


def run_checksum(state: DataFrame) -> DataFrame:
    """The fold over the active sources in order of id."""
    fields = [("source_id", 4), ("event_count", 8), ("value_count", 8), ("raw_checksum", 8), ("last_ticks", 8), ("folded", 8)]
    low = lambda at: F.conv(F.substring("checksum", at, 8), 16, 10).cast("bigint")
    rows = state.withColumn("folded", F.shiftleft(low(1), 32).bitwiseOR(low(9)))
    return fold_ordered(rows, "source_id", fields).withColumnRenamed("rows", "sources")


CHRONOLOGY = ["radial_key", "gate_index", "elevation_number", "raw_value", "status"]


def chronology(events: DataFrame, order: list[str], slices: int = 64) -> DataFrame:
    """h = h * PRIME + hash(event) over all events in order: each range of the order folds on its own, (count, hash) pairs are combined."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.full(b.num_rows, BASIS)
            for c in CHRONOLOGY:
                h = (h ^ b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)) * PRIME
            power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(len(h) - 1, 0), PRIME))))[::-1]
            first = b.slice(0, 1)
            if len(h):
                with np.errstate(over="ignore"):
                    total = (h * power[: len(h)]).sum()
                yield pa.RecordBatch.from_arrays([*[first.column(c).cast(pa.int64()) for c in order], pa.array([len(h)], pa.int64()), pa.array([int(total)], pa.uint64()).cast(pa.decimal128(20, 0))], [*order, "n", "h"])

    schema = ", ".join(f"{c} bigint" for c in order) + ", n bigint, h decimal(20,0)"
    parts = events.select(*order, *[c for c in CHRONOLOGY if c not in order]).repartitionByRange(slices, *order).sortWithinPartitions(*order).mapInArrow(part, schema)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        h = 0
        for n, x in zip(frame["n"], frame["h"]):
            h = (h * pow(int(PRIME), int(n), 2**64) + int(x)) % 2**64
        return pd.DataFrame({"events": [int(frame["n"].sum())], "checksum": [f"{h:016x}"]})

    return parts.groupBy().applyInPandas(whole, "events bigint, checksum string")


def sampled_checksum(events: DataFrame, samples: int = 16, keep: str = "event_seq") -> DataFrame:
    """(keep, work): the low 20 bits of a fold over an event's numbers and up to `samples` bytes from both ends of its payload, big-endian words of word_size bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.full(b.num_rows, BASIS)
            for c, n in (("message_ticks", 8), ("volume_ticks", 8), ("radial_seq", 4), ("gate_count", 8), ("raw_sum", 8)):
                h = fold(h, b.column(c).to_numpy(zero_copy_only=False), n)
            gates = b.column("gates")
            flat, at = gates.flatten().to_numpy(zero_copy_only=False), gates.offsets.to_numpy() - gates.offsets[0].as_py()
            word = b.column("word_size").to_numpy(zero_copy_only=False).astype(np.int64) // 8
            size = np.diff(at) * word
            step = np.maximum(1, size // samples)
            for k in range(samples):
                i = np.minimum(size - 1, k * step)
                some = size > 0
                for j in (i, size - 1 - i):
                    value = flat[(at[:-1] + j // word)[some]] >> (8 * (word - 1 - j % word))[some]
                    h[some] = fold(h[some], value & 255, 1)
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array((h & np.uint64(0xFFFFF)).astype(np.int64))], [keep, "work"])

    return events.select(keep, "message_ticks", "volume_ticks", "radial_seq", "gate_count", "raw_sum", "gates", "word_size").mapInArrow(run, f"{keep} bigint, work bigint")


def dictionary_checksum(catalogs: DataFrame, version: int, order: tuple[str, ...] = ("radar", "moment")) -> DataFrame:
    """One row: entries and the fold over a dictionary's catalogs. catalogs: catalog, id, text - distinct names only, so one group is small.

    Folded are the version, then for each catalog its name, its version (1 + entries) and entries, and of each entry id and text; a text as its length
    and its UTF-16 units.
    """

    def text(h: np.ndarray, s: str) -> np.ndarray:
        units = np.frombuffer(s.encode("utf-16-le"), "<u2").astype(np.int64)
        h = fold(h, np.array([len(units)]), 4)
        for u in units:
            h = fold(h, np.array([u]), 2)
        return h

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        h = fold(np.array([BASIS], np.uint64), np.array([version]), 8)
        for name in order:
            rows = frame[frame["catalog"] == name].sort_values("id")
            h = fold(fold(text(h, name), np.array([len(rows) + 1]), 8), np.array([len(rows)]), 4)
            for i, t in zip(rows["id"], rows["text"]):
                h = text(fold(h, np.array([i]), 4), t)
        return pd.DataFrame({"entries": [len(frame)], "checksum": [hexed(h[0])]})

    return catalogs.groupBy().applyInPandas(one, "entries bigint, checksum string")
