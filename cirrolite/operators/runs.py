"""Run tables - runs, batches, sources, handler values, diagnostics - and the queries over them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .handlers import Handler, snapshots
from .rollups import all_sources, batch_metrics, source_rollup

TABLES = ("runs", "batches", "sources", "handler_values", "diagnostics")


def counted_write(events: DataFrame, path: str, first: Column) -> dict[str, int]:
    """Writes events and counts them on their way, in the same pass: batches (rows where `first` holds, one a batch), events, bytes, values and checksum."""
    seen = Observation("written")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = {"batches": F.count_if(first), "events": F.count(F.lit(1)), "bytes": whole("gate_count"), "values": whole("gate_count"), "checksum": whole("raw_sum")}
    events.observe(seen, *[c.alias(k) for k, c in totals.items()]).write.parquet(path)
    return seen.get


def batch_outcomes(accepted: DataFrame, processed: DataFrame) -> DataFrame:
    """Full join of accepted batches and results on batch_seq; what one side lacks is 0 or ''."""
    a = accepted.select("batch_seq", F.col("event_count").alias("accepted_events"), F.col("value_count").alias("accepted_values"))
    p = processed.select("batch_seq", "status", F.col("event_count").alias("processed_events"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return a.join(p, "batch_seq", "full").select("batch_seq", zero("accepted_events"), zero("accepted_values"), F.coalesce("status", F.lit("")).alias("status"), zero("processed_events"))


def diagnostics(outcomes: DataFrame, finished: bool = True) -> DataFrame:
    ok = F.count_if(F.col("status") == "Succeeded")
    taken = F.count_if(F.col("accepted_events") > 0)
    return outcomes.agg(taken.alias("accepted"), ok.alias("succeeded"), F.count_if(F.col("status") == "Failed").alias("failed"), (F.lit(finished) & (taken == ok)).alias("complete"))


def run_tables(run_id: str, version: int, events: DataFrame, processed: DataFrame, sources: int, handlers: list[Handler]) -> dict[str, DataFrame]:
    """The five tables of a run; every row carries run_id."""
    outcomes = batch_outcomes(batch_metrics(events), processed)
    tagged = lambda df: df.select(F.lit(run_id).alias("run_id"), "*")
    found = {"batches": outcomes, "sources": all_sources(source_rollup(events), sources), "diagnostics": diagnostics(outcomes)}
    if handlers:
        found["handler_values"] = snapshots(events, handlers)
    found["runs"] = outcomes.agg(F.count("*").alias("batch_count"), F.sum("accepted_events").alias("event_count"), F.sum("accepted_values").alias("value_count")).withColumn("version", F.lit(version).cast("bigint"))
    return {k: tagged(v) for k, v in found.items()}


# ---- stored runs ----
#
# A run's tables are written under data/<attempt>/<table>; then one record, commits/<number>.json, names them all. The run is there once its record is, with all tables or none: what a
# writer left behind that failed in between is named by no record. Records are created, never replaced: of two writers that take the same number, one fails, looks again, and meets the other's run.

SCHEMA_VERSION = 1
RECORD = "number bigint, run_id string, version bigint, schema_version int, batch_count bigint, event_count bigint, value_count bigint, tables map<string,struct<path:string,schema:string,rows:bigint,hash:string>>"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored run."""
    from ..sources.history import exists

    return spark.read.schema(RECORD).json(f"{folder}/commits") if exists(spark, f"{folder}/commits") else spark.createDataFrame([], RECORD)


def _record(spark: SparkSession, folder: str, run_id: str):
    found = records(spark, folder).filter(F.col("run_id") == run_id).orderBy("number").first()
    if found and found["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"run {run_id} is stored with schema version {found['schema_version']}; this library reads {SCHEMA_VERSION}")
    return found


def store(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> str:
    """Appends a run: Stored, or Unchanged when the same run with the same content is there; other content under the same id is an error.

    A run is as large as its universe and its batches; its content hashes are aggregates, nothing is collected.
    """
    from ..sources.history import content_hash, created

    head = tables["runs"].first()
    run_id, attempt = head["run_id"], uuid.uuid4().hex

    def stored_before() -> bool:
        old = _record(spark, folder, run_id)
        if old is None:
            return False
        if {k: (t["rows"], t["hash"]) for k, t in old["tables"].items()} != {k: content_hash(v) for k, v in tables.items()}:
            raise ValueError(f"run {run_id} is stored with other content")
        return True

    if stored_before():
        return "Unchanged"
    said = {}
    for k, rows in tables.items():
        rows.write.parquet(path := f"{folder}/data/{attempt}/{k}")
        back = spark.read.schema(rows.schema).parquet(path)
        n, h = content_hash(back)
        said[k] = {"path": f"data/{attempt}/{k}", "schema": json.dumps(rows.schema.jsonValue()), "rows": n, "hash": h}
    while True:
        number = (records(spark, folder).agg(F.max("number")).first()[0] or 0) + 1
        record = {"number": number, "run_id": run_id, "version": head["version"], "schema_version": SCHEMA_VERSION, **{c: head[c] for c in ("batch_count", "event_count", "value_count")}, "tables": said}
        if created(spark, f"{folder}/commits/{number:012d}.json", json.dumps(record)):
            return "Stored"
        if stored_before():  # another writer was faster with this run
            return "Unchanged"


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Of runs that were stored more than once at the same time, the first counts."""
    rows = records(spark, folder)
    first = rows.groupBy("run_id").agg(F.min_by(F.struct("batch_count", "event_count", "value_count", "version"), "number").alias("r"))
    return first.select("run_id", "r.*").orderBy("version", "run_id")


def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return list_runs(spark, folder).orderBy(F.desc("version"), F.desc("run_id")).limit(1)


def of_run(spark: SparkSession, folder: str, table: str, run_id: str, **where) -> DataFrame:
    """Rows of one run: its record names the table's path and schema, so no other run is listed and nothing is inferred. The filters reach the scan."""
    found = _record(spark, folder, run_id)
    if found is None:
        raise ValueError(f"no run {run_id}")
    if table not in found["tables"]:
        raise ValueError(f"run {run_id} has no table {table}")
    at = found["tables"][table]
    rows = spark.read.schema(StructType.fromJson(json.loads(at["schema"]))).parquet(f"{folder}/{at['path']}")
    for c, v in where.items():
        rows = rows.filter(F.col(c) == v)
    return rows


def capacity(outcomes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts of the batches at each step, and the ticks from the first start to the last end. jobs: batch_seq, started_ticks, ended_ticks of processed batches."""
    both = outcomes.join(jobs.select("batch_seq", "started_ticks", "ended_ticks"), "batch_seq", "left")
    counts = [F.count_if(c).alias(n) for n, c in (("accepted_batches", F.col("accepted_events") > 0), ("processed_batches", F.col("status") != ""), ("committed_batches", F.col("status") == "Succeeded"))]
    return both.agg(*counts, F.sum("accepted_events").alias("accepted_events"), (F.max("ended_ticks") - F.min("started_ticks")).alias("elapsed_ticks"))
