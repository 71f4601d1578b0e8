"""Ordered commits of micro-batches into a state table that is kept by key buckets.

A batch is committed after all batches before it (by epoch, then by sequence), and only if none of its sources steps back behind what was committed before; else it is
rejected whole and changes nothing. Which batches of an epoch those are is settled in rounds (ordered_verdicts), so the state is the same however the batches are grouped into epochs.

The state of a source lies in the bucket of its hash. A commit rewrites the buckets that its batches touch, under state/version=<epoch>/bucket=<k>, and then writes one small record,
commits/epoch=<epoch>, which names the version of every bucket: a commit is there once its record is. What it writes grows with the touched buckets, not with the state.
An epoch that runs again reads the record before it and overwrites its own files, so redelivery changes nothing. expire() removes what no recent record names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.rollups import batch_deltas
from ..operators.validation import accepted_batches
from ..plans.shared import written
from ..sources.history import exists, folders, remove

STATE = "source_id bigint, event_count bigint, value_count bigint, raw_checksum bigint, last_ticks bigint"
SUMS, COLUMNS = ("event_count", "value_count", "raw_checksum"), ("source_id", "event_count", "value_count", "raw_checksum", "last_ticks")
RECORD = "bucket int, version bigint, buckets int"


def ordered_verdicts(deltas: DataFrame, state: DataFrame) -> DataFrame:
    """(batch_seq, accepted) for the batches of deltas (batch_seq, source_id, first_ticks, last_ticks) that are committed in order of batch_seq on top of state (source_id, last_ticks).

    A batch goes if a source of it begins below the last ticks of the state or of an accepted earlier batch. A round decides all batches that this leaves no doubt about: those below
    what is certainly committed before them are out, those not below anything that may be committed before them are in. The first undecided batch is always decided, so rounds
    end; they are as many as the longest chain of batches whose rejection lets the next one pass, two where nothing steps back.
    """
    stored = state.select("source_id", F.col("last_ticks").alias("stored"))
    rows = written(deltas.select("batch_seq", "source_id", "first_ticks", "last_ticks").join(stored, "source_id", "left"))
    verdict = rows.select("batch_seq").distinct().withColumn("accepted", F.lit(None).cast("boolean"))
    before = Window.partitionBy("source_id").orderBy("batch_seq").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        known = rows.join(verdict, "batch_seq")
        sure = F.greatest("stored", F.max(F.when(F.col("accepted"), F.col("last_ticks"))).over(before))
        maybe = F.greatest("stored", F.max(F.when(F.coalesce("accepted", F.lit(True)), F.col("last_ticks"))).over(before))
        known = known.withColumn("out", F.coalesce(F.col("first_ticks") < sure, F.lit(False))).withColumn("fits", F.coalesce(F.col("first_ticks") >= maybe, F.lit(True)))
        each = known.groupBy("batch_seq").agg(F.first("accepted").alias("accepted"), F.bool_or("out").alias("out"), F.bool_and("fits").alias("fits"))
        verdict = written(each.select("batch_seq", F.coalesce("accepted", F.when(F.col("out"), False).when(F.col("fits"), True)).alias("accepted")))
        if verdict.filter("accepted is null").isEmpty():
            return verdict


class BucketedState:
    """The state table under a folder. The number of buckets is fixed by the first commit."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("source_id"), F.lit(self.buckets)).cast("int")

    def newest(self) -> int | None:
        """The last committed epoch."""
        epochs = [int(name.partition("=")[2]) for name in folders(self.spark, f"{self.folder}/commits") if name.startswith("epoch=")]
        return max((e for e in epochs if self._committed(e)), default=None)

    def _committed(self, epoch: int) -> bool:
        return exists(self.spark, f"{self.folder}/commits/epoch={epoch}/_SUCCESS")

    def record(self, epoch: int) -> dict[int, int]:
        """Version by bucket as of an epoch: a row per bucket at most. Epoch -1 is the empty state; any other that was not committed is an error."""
        if epoch < 0:
            return {}
        if not self._committed(epoch):
            raise ValueError(f"epoch {epoch} was never committed in {self.folder}")
        rows = self.spark.read.schema(RECORD).parquet(f"{self.folder}/commits/epoch={epoch}").collect()
        if other := {r["buckets"] for r in rows} - {self.buckets}:
            raise ValueError(f"the state has {other.pop()} buckets, not {self.buckets}")
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, record: dict[int, int], some: list[int] | None = None) -> DataFrame:
        """The state of some buckets, or of all."""
        paths = [f"{self.folder}/state/version={v}/bucket={k}" for k, v in record.items() if some is None or k in some]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def touched(self, deltas: DataFrame) -> list[int]:
        return [r[0] for r in deltas.select(self.bucket().alias("bucket")).distinct().collect()]

    def commit(self, epoch: int, deltas: DataFrame, record: dict[int, int], some: list[int]) -> None:
        """Folds deltas, whose sources lie in the buckets `some`, into the state of `record`."""
        if some:
            both = self.read(record, some).unionByName(deltas.select(*COLUMNS)).withColumn("bucket", self.bucket()).repartition("bucket")
            both = both.groupBy("bucket", "source_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("last_ticks").alias("last_ticks"))
            both.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/state/version={epoch}")
        record = record | {k: epoch for k in some}
        rows = [(k, v, self.buckets) for k, v in sorted(record.items())]
        self.spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/epoch={epoch}")

    def expire(self, keep: int = 2) -> int:
        """Removes commit records but the last `keep`, and the versions of buckets that none of these names. Returns how many folders went."""
        last, gone = self.newest(), 0
        if last is None:
            return 0
        kept = [e for e in range(max(0, last - keep + 1), last + 1) if self._committed(e)]
        used = {(v, k) for e in kept for k, v in self.record(e).items()}
        for name in folders(self.spark, f"{self.folder}/commits"):
            if name.startswith("epoch=") and int(name[6:]) < kept[0]:
                gone += remove(self.spark, f"{self.folder}/commits/{name}")
        for version in folders(self.spark, f"{self.folder}/state"):
            at = int(version.partition("=")[2])
            names = [n for n in folders(self.spark, f"{self.folder}/state/{version}") if n.startswith("bucket=")]
            old = [n for n in names if at <= last and (at, int(n[7:])) not in used]
            gone += sum(remove(self.spark, f"{self.folder}/state/{version}/{n}") for n in old)
            if len(old) == len(names) and at <= last:
                remove(self.spark, f"{self.folder}/state/{version}")
        return gone


def committer(folder: str, universe, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Validates a micro-batch and commits its valid batches in order on top of the epoch before it.

    Deltas are computed in parallel. A batch with a bad source id, with ticks that step back inside it, or with ticks below what its source has seen, is rejected whole and kept
    with its reason under rejected/.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        state = BucketedState(rows.sparkSession, folder, buckets)
        record = state.record(epoch - 1)
        rows = rows.persist()
        try:
            good, bad = accepted_batches(rows, universe)
            deltas = written(batch_deltas(rows.join(good.select("batch_seq"), "batch_seq", "left_semi")))
            verdicts = ordered_verdicts(deltas, state.read(record, state.touched(deltas)))
            late = verdicts.filter("not accepted").select("batch_seq", F.lit("SourceOrderViolation").alias("error"))
            bad.select("batch_seq", "error").unionByName(late).write.mode("overwrite").parquet(f"{folder}/rejected/epoch={epoch}")
            kept = deltas.join(verdicts.filter("accepted").select("batch_seq"), "batch_seq", "left_semi")
            state.commit(epoch, kept, record, state.touched(kept))
        finally:
            rows.unpersist()

    return write


def last_state(spark: SparkSession, folder: str, buckets: int = 64) -> DataFrame:
    """The state as of the newest commit."""
    state = BucketedState(spark, folder, buckets)
    epoch = state.newest()
    return state.read({} if epoch is None else state.record(epoch))
