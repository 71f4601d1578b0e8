"""Per-key state across micro-batches, by transformWithState: typed values, lists and maps in RocksDB, which survive a restart from the checkpoint.

Rows of a key reach a processor in Arrow batches. Each trigger's rows are put in order before they are folded; what comes in a later trigger is later.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.checksums import BASIS, EVENT, PRIME
from ..operators.pressure import evaluate, next_band

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIZES = {2: "H", 4: "I", 8: "Q"}
LAYOUT, MASK = struct.Struct("<" + "".join(SIZES[n] for _, n in EVENT)), [(1 << 8 * n) - 1 for _, n in EVENT]
FIELDS = [c for c, _ in EVENT]


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """transformWithState needs the RocksDB store; the caller's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def appended_checksum(h: int, row: tuple) -> int:
    """The fold of one event's fields onto a source's checksum."""
    prime = int(PRIME)
    for byte in LAYOUT.pack(*[int(v) & m for v, m in zip(row, MASK)]):
        h = ((h ^ byte) * prime) & 0xFFFFFFFFFFFFFFFF
    return h


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class SourceTotals(StatefulProcessor):
    """Counts, sums, last ticks and the ordered checksum of each source; rows per moment in a map. Late events, below the last ticks, are counted and change nothing else.

    With idle_ms, a source's state expires that long after its last update (processing time), and the next event begins anew.
    """

    OUT = "source_id bigint, event_count bigint, value_count bigint, raw_checksum bigint, last_ticks bigint, late bigint, moments bigint, checksum string"

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "event_count bigint, value_count bigint, raw_checksum bigint, last_ticks bigint, late bigint, checksum bigint", self.idle_ms)
        self.moments = handle.getMapState("moments", "moment_id bigint", "events bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, v, c, last, late, h = self.totals.get() if self.totals.exists() else (0, 0, 0, -1, 0, signed(int(BASIS)))
        h, seen = h & 0xFFFFFFFFFFFFFFFF, {}
        frame = pd.concat(list(rows)).sort_values("event_seq", kind="stable")
        for row in frame[FIELDS].itertuples(index=False, name=None):
            if row[0] < last:  # message_ticks come first
                late += 1
                continue
            event = dict(zip(FIELDS, row))
            n, v, c, last = n + 1, v + event["gate_count"], c + event["raw_sum"], row[0]
            seen[event["moment_id"]] = seen.get(event["moment_id"], 0) + 1
            h = appended_checksum(h, row)
        self.totals.update((int(n), int(v), int(c), int(last), int(late), signed(h)))
        for moment, count in seen.items():
            at = (int(moment),)
            self.moments.updateValue(at, (count + (self.moments.getValue(at)[0] if self.moments.containsKey(at) else 0),))
        kinds = sum(1 for _ in self.moments.keys())
        yield pd.DataFrame({"source_id": [key[0]], "event_count": [n], "value_count": [v], "raw_checksum": [c], "last_ticks": [last], "late": [late], "moments": [kinds], "checksum": [f"{h:016x}"]})

    def close(self) -> None:
        pass


class Pressure(StatefulProcessor):
    """Rolling mean of a key's last scores, which a list holds, and its band, a value."""

    OUT = "key bigint, seq bigint, samples bigint, mean_score double, eligible boolean, band string"

    def __init__(self, size: int = 8, least: int = 3, scale: float = 1.0):
        self.size, self.least, self.scale = size, least, scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", "score double")
        self.band = handle.getValueState("band", "band string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scores = [x[0] for x in self.scores.get()] if self.scores.exists() else []
        band = self.band.get()[0] if self.band.exists() else "Normal"
        out = []
        for seq, score in pd.concat(list(rows)).sort_values("seq", kind="stable")[["seq", "score"]].itertuples(index=False, name=None):
            scores = [*scores, float(score)][-self.size :]
            mean = sum(scores) / len(scores)
            band = next_band(mean, band, self.scale)
            out.append((key[0], seq, len(scores), mean, len(scores) >= self.least, band))
        self.scores.put([(x,) for x in scores])
        self.band.update((band,))
        yield pd.DataFrame(out, columns=["key", "seq", "samples", "mean_score", "eligible", "band"])

    def close(self) -> None:
        pass


class Health(StatefulProcessor):
    """Transitions of a key's health."""

    OUT = "key bigint, seq bigint, before string, after string, reason string, age bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "status string, start bigint, baseline double, cool int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = dict(zip(("status", "start", "baseline", "cool"), self.now.get() if self.now.exists() else ("None", None, None, 0)))
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            was, began = now["status"], now["start"]
            if reason := evaluate(now, int(r.seq), r.observed, r.band, float(r.pressure)):
                out.append((key[0], r.seq, was, now["status"], reason, r.seq - began if began is not None else 0))
        self.now.update((now["status"], now["start"], now["baseline"], now["cool"]))
        yield pd.DataFrame(out, columns=["key", "seq", "before", "after", "reason", "age"])

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, key: str, processor: StatefulProcessor, mode: str = "Update", times: str = "None") -> DataFrame:
    """times: ProcessingTime where the processor's state expires."""
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.OUT, mode, times)


def source_totals(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """events: source_id, event_seq and the fields of the source checksum."""
    some = events.select("source_id", "event_seq", *[c for c in dict.fromkeys(FIELDS) if c != "source_id"])
    return keyed(some.withColumn("_key", some["source_id"]), "_key", SourceTotals(idle_ms), times="None" if idle_ms is None else "ProcessingTime")


def run_keyed(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Everything that is there now, with the state that the checkpoint holds. For state that does not expire: where it does, there is a next trigger always, and the query runs until it is stopped."""
    with rocks(stream.sparkSession):
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
