"""Handlers: user-defined aggregates per source, with typed fields, merge contracts and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MERGEABLE, SNAPSHOT, UNSUPPORTED = "Mergeable", "SnapshotOnly", "Unsupported"


@dataclass(frozen=True)
class Fold:
    """An ordered fold that no column aggregate can say: init makes a source's state, step takes it over some of the source's events, in order, to the next state, finish makes the fields of it.

    A source's events come in parts, as batches cut them, so the state must carry all that step needs from earlier parts.
    """

    init: Callable[[], object]
    step: Callable[[object, pd.DataFrame], object]
    finish: Callable[[object], dict]


@dataclass(frozen=True)
class Handler:
    """fields: name -> (type, aggregate). An opaque handler has a `fold` instead, over the columns that it `needs` (all, if none are named)."""

    name: str
    fields: dict[str, tuple[str, Callable[[], Column] | None]]
    kind: str = SNAPSHOT
    version: str = "1"
    fold: Fold | None = None
    needs: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("a handler needs a name")
        if not self.fields and self.kind != UNSUPPORTED:
            raise ValueError(f"{self.name}: no fields")
        for f, (kind, _) in self.fields.items():
            if kind not in ("bigint", "double"):
                raise ValueError(f"{self.name}.{f}: {kind} is neither bigint nor double")


def checked(handlers: list[Handler]) -> list[Handler]:
    """Field names must be unique over all handlers."""
    seen: set[str] = set()
    for h in handlers:
        for f in h.fields:
            if f in seen:
                raise ValueError(f"field {f} occurs twice")
            seen.add(f)
    return handlers


def posture(handlers: list[Handler]) -> str:
    kinds = {h.kind for h in handlers}
    return "Blocked" if UNSUPPORTED in kinds else "Sequential" if SNAPSHOT in kinds else "Merge"


def contract(spark: SparkSession, handlers: list[Handler]) -> DataFrame:
    rows = [(h.name, h.version, h.kind, f, kind, slot) for h in handlers for slot, (f, (kind, _)) in enumerate(h.fields.items())]
    return spark.createDataFrame(rows, "handler string, version string, kind string, field string, type string, slot int")


COUNTER = Handler("CounterChecksum", {
    "events": ("bigint", lambda: F.count("*")), "values": ("bigint", lambda: F.sum("gate_count")), "raw_checksum": ("bigint", lambda: F.sum("raw_sum"))}, MERGEABLE)
HEAVY = Handler("HeavySampled", {"heavy_events": ("bigint", lambda: F.count("*")), "heavy_work": ("bigint", lambda: F.sum("work"))}, MERGEABLE, needs=("work",))
COUNTING = Handler("SnapshotCounting", {"snapshot_events": ("bigint", lambda: F.count("*"))})
REFUSED = Handler("Unsupported", {}, UNSUPPORTED)
SETS = {"None": [], "CounterChecksum": [COUNTER], "CounterChecksumHeavy": [COUNTER, HEAVY], "SnapshotCounting": [COUNTING], "Unsupported": [REFUSED]}


def handler_set(name: str) -> list[Handler]:
    if name not in SETS:
        raise ValueError(f"no handler set {name}")
    return checked(SETS[name])


def snapshots(events: DataFrame, handlers: list[Handler]) -> DataFrame:
    """(source_id, handler, field, type, int64_value, double_value). All column aggregates share one group-by."""
    if posture(handlers) == "Blocked":
        raise ValueError("an unsupported handler blocks the set")
    columns = [h for h in handlers if h.fold is None]
    out = None
    if columns:
        wide = events.groupBy("source_id").agg(*[make().cast(kind).alias(f) for h in columns for f, (kind, make) in h.fields.items()])
        cells = [F.struct(F.lit(h.name).alias("handler"), F.lit(f).alias("field"), F.lit(kind).alias("type"), *_values(F.col(f), kind)) for h in columns for f, (kind, _) in h.fields.items()]
        out = wide.select("source_id", F.explode(F.array(*cells)).alias("x")).select("source_id", "x.*")
    for h in handlers:
        if h.fold is not None:
            got = _folded(events, h)
            out = got if out is None else out.unionByName(got)
    return out


def _values(c: Column, kind: str) -> list[Column]:
    return [(c if kind == "bigint" else F.lit(None)).cast("bigint").alias("int64_value"), (c if kind == "double" else F.lit(None)).cast("double").alias("double_value")]


def _folded(events: DataFrame, h: Handler) -> DataFrame:
    """Spark deals sources and sorts their events; a task carries the state of the source at hand from batch to batch, so a source of any size takes one batch of memory."""

    def rows_of(source: int, state: object) -> pd.DataFrame:
        got = h.fold.finish(state)
        if set(got) != set(h.fields):
            raise ValueError(f"{h.name} returned {sorted(got)}")
        rows = [(source, h.name, f, kind, int(got[f]) if kind == "bigint" else None, float(got[f]) if kind == "double" else None) for f, (kind, _) in h.fields.items()]
        return pd.DataFrame(rows, columns=["source_id", "handler", "field", "type", "int64_value", "double_value"]).astype({"int64_value": "Int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state = None, None
        for frame in frames:
            ids = frame["source_id"].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            done = []
            for lo, hi in zip(cuts, cuts[1:]):
                if source is None or ids[lo] != source:
                    if source is not None:
                        done.append(rows_of(source, state))
                    source, state = int(ids[lo]), h.fold.init()
                state = h.fold.step(state, frame.iloc[lo:hi])
            if done:
                yield pd.concat(done)
        if source is not None:
            yield rows_of(source, state)

    some = events.select("source_id", "event_seq", *[c for c in h.needs if c not in ("source_id", "event_seq")]) if h.needs else events
    dealt = some.filter("source_id is not null").repartition("source_id").sortWithinPartitions("source_id", "event_seq")
    return dealt.mapInPandas(run, "source_id bigint, handler string, field string, type string, int64_value bigint, double_value double")


TYPED = ["type", "int64_value", "double_value"]


def deltas(events: DataFrame, handlers: list[Handler]) -> DataFrame:
    """Partial aggregates of each batch: (sequence, source_id, handler, field, type, int64_value, double_value). A value stands in the column of its type, so 64-bit sums stay exact beside doubles."""
    if posture(handlers) != "Merge":
        raise ValueError("only mergeable handlers have deltas")
    wide = events.groupBy(F.col("batch_seq").alias("sequence"), "source_id").agg(*[make().cast(kind).alias(f) for h in handlers for f, (kind, make) in h.fields.items()])
    cells = [F.struct(F.lit(h.name).alias("handler"), F.lit(f).alias("field"), F.lit(kind).alias("type"), *_values(F.col(f), kind)) for h in handlers for f, (kind, _) in h.fields.items()]
    return wide.select("sequence", "source_id", F.explode(F.array(*cells)).alias("x")).select("sequence", "source_id", "x.*")


def merged(delta_rows: DataFrame) -> DataFrame:
    return delta_rows.groupBy("handler", "source_id", "field", "type").agg(F.sum("int64_value").alias("int64_value"), F.sum("double_value").alias("double_value"))


def applied(state: DataFrame, values: DataFrame, contract_rows: DataFrame) -> DataFrame:
    """state (handler, source_id, field and the typed value's columns) with merged values put in.

    A field outside the contract, one whose type differs from the contract's, and a value in the other type's column raise when the rows are computed, whichever columns are read.
    """
    known = contract_rows.select("handler", "field", F.col("type").alias("wanted"))
    wrong = (
        F.when(F.col("wanted").isNull(), F.concat(F.lit("unknown field "), F.col("field"))).when(~F.col("type").eqNullSafe(F.col("wanted")), F.concat(F.lit("field "), F.col("field"), F.lit(" is of type "), F.col("wanted")))
        .when(F.when(F.col("wanted") == "bigint", F.col("double_value")).otherwise(F.col("int64_value")).isNotNull(), F.concat(F.lit("field "), F.col("field"), F.lit(" has a value that is not of type "), F.col("wanted")))
    )
    kind = {c: t for c, t in values.dtypes if c in TYPED}
    held = F.struct(*[F.when(wrong.isNull(), F.col(c)).otherwise(F.raise_error(wrong).cast(kind[c])).alias(c) for c in TYPED])
    new = values.join(known, ["handler", "field"], "left").select("handler", "source_id", "field", held.alias("new"))
    old = state.select("handler", "source_id", "field", F.struct(*TYPED).alias("old"))
    return old.join(new, ["handler", "source_id", "field"], "full").select("handler", "source_id", "field", F.coalesce("new", "old").alias("x")).select("handler", "source_id", "field", "x.*")


def delta_id(handler: str = "handler", version: str = "contract_version", sequence: str = "sequence", batch: str = "batch_id") -> Column:
    parts = [F.col(handler), F.col(version), F.col(sequence).cast("string"), F.coalesce(F.col(batch), F.lit("none")), *[F.col(c).cast("string") for c in ("event_count", "source_count", "payload_value_count", "input_checksum")]]
    return F.concat_ws("|", *parts)


def delta_errors(rows: DataFrame, handler: str, version: str, schema: int = 1) -> DataFrame:
    """Adds error: the first rule that a delta breaks, else null. Repeated (source, field) pairs are looked for inside each delta's values."""
    pairs = F.transform("values", lambda v: F.struct(v.source_id, v.field))
    error = (
        F.when(F.col("handler") != handler, "HandlerMismatch").when(F.col("contract_version") != version, "ContractVersionMismatch").when(F.col("schema_version") != schema, "SchemaVersionMismatch")
        .when(F.col("delta_id") != delta_id(), "DeltaIdMismatch").when(F.exists("values", lambda v: ~v.source_id.between(0, F.col("source_count") - 1)), "SourceOutside").when(F.size(F.array_distinct(pairs)) < F.size(pairs), "DuplicateField")
    )
    return rows.withColumn("error", error)


def redelivery(rows: DataFrame) -> DataFrame:
    """Adds status to deltas (handler, sequence, arrival, delta_id, content): Accepted, Duplicate (same content) or Rejected (other content)."""
    from pyspark.sql.window import Window

    first = F.first("content").over(Window.partitionBy("handler", "sequence").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(Window.partitionBy("handler", "sequence").orderBy("arrival"))
    return rows.withColumn("status", F.when(n == 1, "Accepted").when(F.col("content") == first, "Duplicate").otherwise("Rejected"))
