"""Handlers, run tables, pressure and streams."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from cirrolite.functions import keys as K
from cirrolite.functions.payload import gates_of, payload_slice
from cirrolite.operators import checksums, dictionary, handlers, pressure, runs, validation, windows
from cirrolite.plans import queries as Q
from cirrolite.plans.bindings import UNIVERSE, detailed, stream_events
from cirrolite.streaming import commits, keyed, pipeline

from .conftest import DATA


@pytest.mark.parametrize("sources,buckets,shards", [(640, 24, 4), (10, 3, 2), (7, 7, 7), (5, 8, 3)])
def test_buckets_agree_with_ranges(spark, sources, buckets, shards):
    ranges = K.bucket_ranges(sources, buckets, shards)
    assert ranges[0][2] == 0 and ranges[-1][3] == sources
    got = {r[0]: (r[1], r[2]) for r in spark.range(sources).select("id", K.bucket_of(F.col("id"), sources, buckets).alias("b")).select("id", "b", K.shard_of(F.col("b"), buckets, shards)).collect()}
    assert got == {i: (b, s) for b, s, first, end in ranges for i in range(first, end)}


def test_universe():
    u = K.Universe(1, 32, 720, 1)
    assert u.sources == 23040 and u.radar_block(0) == (0, 23040)
    assert u.compatible(K.Universe(1, 32, 720, 1)) and not u.compatible(K.Universe(1, 32, 720, 2))
    assert u.compatible(K.Universe(1, 32, 720, 1, version=2)) and u.compatible(K.Universe(1, 32, 720, 2, version=2))


def test_big_endian_gates(spark):
    df = spark.createDataFrame([(bytearray([1, 2, 0, 3, 0, 4]),)], "p binary")
    assert df.select(gates_of(F.col("p"), F.lit(0), F.lit(2), F.lit(8)), gates_of(F.col("p"), F.lit(2), F.lit(2), F.lit(16)), gates_of(F.col("p"), F.lit(0), F.lit(0), F.lit(8))).first() == ([1, 2], [3, 4], [])


def test_versions(spark):
    c = spark.createDataFrame([("a", 0), ("b", 1)], "text string, id bigint")
    assert dictionary.snapshot(c, 1).count() == 0 and dictionary.snapshot(c, 3).count() == 2
    for bad in (0, 4):
        with pytest.raises(ValueError):
            dictionary.snapshot(c, bad)
    with pytest.raises(ValueError):
        dictionary.apply_delta(dictionary.snapshot(c, 2), dictionary.delta(c, 1, 2), 1)


def test_handler_rules(spark):
    with pytest.raises(ValueError):
        handlers.checked([handlers.COUNTER, handlers.COUNTER])
    with pytest.raises(ValueError):
        handlers.Handler("x", {"f": ("string", None)})
    assert [handlers.posture(handlers.handler_set(n)) for n in ("None", "CounterChecksum", "SnapshotCounting", "Unsupported")] == ["Merge", "Merge", "Sequential", "Blocked"]
    with pytest.raises(ValueError):
        handlers.handler_set("other")
    with pytest.raises(ValueError):
        handlers.snapshots(stream_events(spark, DATA), [handlers.REFUSED])
    state = spark.createDataFrame([("h", 1, "f", "bigint", 1, None)], "handler string, source_id bigint, field string, type string, int64_value bigint, double_value double")
    known = lambda f, kind: spark.createDataFrame([("h", f, kind)], "handler string, field string, type string")
    assert handlers.applied(state, state, known("f", "bigint")).count() == 1
    with pytest.raises(Exception, match="unknown field"):
        handlers.applied(state, state, known("g", "bigint")).collect()
    with pytest.raises(Exception, match="is of type double"):
        handlers.applied(state, state, known("f", "double")).select("int64_value").collect()
    with pytest.raises(Exception, match="not of type double"):
        handlers.applied(state, state.withColumn("type", F.lit("double")), known("f", "double")).select("type").collect()


def test_redelivery(spark):
    rows = spark.createDataFrame([("h", 0, 1, "x"), ("h", 0, 2, "x"), ("h", 0, 3, "y"), ("h", 1, 1, "z")], "handler string, sequence bigint, arrival int, content string")
    assert [r["status"] for r in handlers.redelivery(rows).orderBy("sequence", "arrival").collect()] == ["Accepted", "Duplicate", "Rejected", "Accepted"]


def test_run_store(spark, tmp_path):
    tables = runs.run_tables("a", 1, stream_events(spark, DATA), Q.processed(spark, DATA), 640, [handlers.COUNTER])
    folder = str(tmp_path / "runs")
    assert runs.store(spark, tables, folder) == "Stored"
    assert runs.store(spark, tables, folder) == "Unchanged"
    other = runs.run_tables("a", 1, stream_events(spark, DATA).filter("event_seq > 9"), Q.processed(spark, DATA), 640, [handlers.COUNTER])
    with pytest.raises(ValueError):
        runs.store(spark, other, folder)
    assert runs.store(spark, runs.run_tables("b", 2, stream_events(spark, DATA), Q.processed(spark, DATA), 640, [handlers.COUNTER]), folder) == "Stored"
    assert [r["run_id"] for r in runs.list_runs(spark, folder).collect()] == ["a", "b"] and runs.latest_run(spark, folder).first()["run_id"] == "b"
    assert runs.of_run(spark, folder, "sources", "a", source_id=3).count() == 1


def test_window_bands_are_those_of_the_rule(spark):
    rnd = random.Random(3)
    scores = [0.0, 9000.0, 10000.0, 8500.0, 7000.0, 120000.0, 81000.0, 79000.0, 45000.0, 39000.0, 8000.0, 0.0] + [rnd.choice([0.0, 7999.0, 8000.0, 10000.0, 39999.0, 40000.0, 50000.0, 79999.0, 80000.0, 100000.0]) for _ in range(400)]
    band, want = "Normal", []
    for s in scores:
        band = pressure.next_band(s, band)
        want.append(band)
    assert want[:5] == ["Cold", "Normal", "Warm", "Warm", "Normal"]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "key bigint, seq bigint, score double")
    assert [r["band"] for r in pressure.hysteresis(rows, "key", "seq", "score").orderBy("seq").collect()] == want


def test_every_batch_error_occurs(spark):
    got = {r["error"] for r in Q.va1_batch_errors(spark, DATA.replace("sf0.001", "sf0.01")).select("error").distinct().collect()}
    assert got == {None, "UnsupportedStreamSchemaVersion", "SourceUniverseVersionMismatch", "DictionarySnapshotVersionMismatch", "ChronologyOrderViolation", "PayloadLengthMismatch", "PayloadReferenceOutsidePayload", "PayloadReferenceNotContiguous",
                   "SourceIdOutsideUniverse", "SourceKeyOutsideUniverse", "SourceKeyMismatch", "RadarOrdinalOutsideDictionary", "MomentIdOutsideDictionary", "PayloadTailNotReferenced", "MetricsMismatch"}


def test_payload_slices(spark):
    df = spark.createDataFrame([(bytearray(b"abcdef"),)], "p binary")
    take = lambda at, n, gates, word: df.select(payload_slice(F.col("p"), F.lit(at), F.lit(n), F.lit(gates), F.lit(word)).alias("x")).first()["x"]
    assert bytes(take(2, 4, 2, 16)) == b"cdef"
    for bad in ((3, 4, 2, 16), (-1, 2, 2, 8), (0, 3, 2, 8), (0, 0, 0, 8), (0, 2, 1, 12)):
        with pytest.raises(Exception, match="payload slice"):
            take(*bad)


def test_delta_of_another_catalog(spark):
    c = spark.createDataFrame([("radar", "a", 0), ("radar", "b", 1)], "catalog string, text string, id bigint")
    other = dictionary.delta(c, 2, 3).withColumn("catalog", F.lit("moment"))
    assert dictionary.apply_delta(dictionary.snapshot(c, 2), dictionary.delta(c, 2, 3), 2).count() == 2
    with pytest.raises(ValueError, match="another catalog"):
        dictionary.apply_delta(dictionary.snapshot(c, 2), other, 2)


def test_health_lifecycle(spark):
    rows = [(1, 0, "Quarantined", "Hot", 100.0), (1, 1, "Quarantined", "Normal", 100.0), (1, 2, "x", "Cold", 100.0), (1, 3, "x", "Cold", 100.0), (2, 0, "Quarantined", "Hot", 100.0), (2, 1, "x", "Hot", 130.0), (2, 2, "Quarantined", "Hot", 130.0), (2, 70, "x", "Hot", 130.0), (2, 71, "MovableHot", "Hot", 130.0)]
    s = spark.createDataFrame(rows, "key bigint, seq bigint, observed string, band string, pressure double")
    got = [(r["key"], r["seq"], r["reason"], r["age"]) for r in pressure.health(s, "key", "seq").orderBy("key", "seq").collect()]
    assert got == [(1, 0, "EnteredQuarantine", 0), (1, 3, "ClearedBySustainedCooling", 3), (2, 0, "EnteredQuarantine", 0), (2, 1, "MarkedRetryEligibleByPressureChange", 1), (2, 2, "ReenteredQuarantine", 2), (2, 70, "MarkedRetryEligibleByTtl", 68), (2, 71, "ClearedByEffectiveRelief", 69)]


def test_health_stream_is_the_batch(spark, tmp_path):
    ev = Q.evidence(spark, DATA)
    want = sorted(map(tuple, pressure.health(ev, "key", "seq").collect()))
    ev.repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in"))
    keyed.run_keyed(keyed.keyed(pipeline.replay(spark, str(tmp_path / "in"), 3), "key", keyed.Health(), "Append"), Q.appended(str(tmp_path)), str(tmp_path / "check"), "append")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("epoch").collect())) == want


def test_micro_batches_reject_late_batches_whole(spark, tmp_path):
    rows = Q.shaken(spark, DATA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = pipeline.replay(spark, str(tmp_path / "in"), 100)
    pipeline.run_once(stream, commits.committer(str(tmp_path), UNIVERSE), str(tmp_path / "check"))
    good, bad = validation.accepted_batches(rows, UNIVERSE)
    from cirrolite.operators.rollups import source_rollup

    want = source_rollup(rows.join(good.select("batch_seq"), "batch_seq", "left_semi"))
    cols = ["source_id", "event_count", "value_count", "raw_checksum", "last_ticks"]
    assert sorted(map(tuple, commits.last_state(spark, str(tmp_path)).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == bad.count()


def test_commit_order_over_epochs(spark, tmp_path):
    write = commits.committer(str(tmp_path), UNIVERSE)
    v = stream_events(spark, DATA)
    write(v.filter("batch_seq = 1"), 0)
    write(v.filter("batch_seq in (0, 2)"), 1)  # batch 0 comes late
    write(v.filter("batch_seq in (0, 2)"), 1)  # and again
    late = [r["batch_seq"] for r in spark.read.parquet(str(tmp_path / "rejected")).collect()]
    assert late == [0]
    assert commits.last_state(spark, str(tmp_path)).agg(F.sum("event_count")).first()[0] == v.filter("batch_seq in (1, 2)").count()


def test_deltas_arrive_in_any_order(spark, tmp_path):
    write = pipeline.delta_merger(str(tmp_path))
    d = lambda *rows: spark.createDataFrame([("h", s, f"id{s}", 1, "f", v, c) for s, v, c in rows], "handler string, sequence bigint, delta_id string, source_id bigint, field string, value bigint, content string")
    write(d((2, 5, "c")), 0)
    write(d((0, 1, "a"), (2, 5, "c")), 1)
    write(d((1, 2, "b"), (0, 9, "other")), 2)
    got = spark.read.parquet(str(tmp_path / "arrived")).drop("epoch")
    assert sorted(r["sequence"] for r in got.collect()) == [0, 1, 2]
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == [9]
    assert windows.blocking(got).first()["blocking_sequence"] == 3


def test_deltas_keep_doubles(spark):
    h = handlers.Handler("Mean", {"half": ("double", lambda: F.sum(F.col("gate_count") * 0.5)), "rows": ("bigint", lambda: F.count("*"))}, handlers.MERGEABLE)
    rows = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (1, 1, 4)], "batch_seq bigint, source_id bigint, gate_count int")
    got = {r["field"]: (r["type"], r["int64_value"], r["double_value"]) for r in handlers.merged(handlers.deltas(rows, [h])).collect()}
    assert got == {"half": ("double", None, 3.5), "rows": ("bigint", 3, None)}


def test_typed_deltas_are_released_live(spark, tmp_path):
    """64-bit sums above 2^53 and doubles side by side, over a gap."""
    write = pipeline.delta_merger(str(tmp_path))
    kinds = "handler string, sequence bigint, delta_id string, source_id bigint, field string, type string, int64_value bigint, double_value double, content string"
    d = lambda s, n, x: spark.createDataFrame([("h", s, f"id{s}", 1, "n", "bigint", n, None, "c"), ("h", s, f"id{s}", 1, "x", "double", None, x, "c")], kinds)
    write(d(1, 3, 0.25), 0)
    write(d(0, 2**60, 0.5), 1)
    got = {r["field"]: (r["type"], r["int64_value"], r["double_value"]) for r in pipeline.merged_values(spark, str(tmp_path)).collect()}
    assert got == {"n": ("bigint", 2**60 + 3, None), "x": ("double", None, 0.75)}


def test_expected_metrics_in_full(spark):
    """Each of the five metrics is compared; metadata folds need their actual values."""
    from pyspark.sql.window import Window

    same = {"payload_length": F.col("gate_count"), "batch_bytes": F.sum("gate_count").over(Window.partitionBy("batch_seq")), "word_size": F.lit(8), "schema_version": F.lit(1), "universe_version": F.lit(1), "dictionary_version": F.lit(1)}
    rows = windows.payload_offsets(stream_events(spark, DATA)).withColumns(same)
    fold = checksums.batch_checksums(detailed(stream_events(spark, DATA))).select("batch_seq", F.col("checksum").alias("metadata_checksum"))
    good = [r["batch_seq"] for r in validation.batch_errors(rows, UNIVERSE).filter("error is null").collect()]
    size = rows.groupBy("batch_seq").agg(F.max("batch_bytes").alias("payload_bytes"), F.count("*").alias("event_count"), F.sum("gate_count").alias("value_count"), F.sum("raw_sum").alias("raw_checksum"))
    full = size.join(fold, "batch_seq")
    check = lambda want: {r["error"] for r in validation.batch_errors(rows, UNIVERSE, expected=want, metadata=fold).filter(F.col("batch_seq").isin(good)).collect()}
    assert good and check(full) == {None}
    for c in ("payload_bytes", "event_count", "value_count", "raw_checksum"):
        assert check(full.withColumn(c, F.col(c) + 1)) == {"MetricsMismatch"}
    assert check(full.withColumn("metadata_checksum", F.concat("metadata_checksum", F.lit("0")))) == {"MetricsMismatch"}
    with pytest.raises(ValueError, match="no metadata"):
        validation.batch_errors(rows, UNIVERSE, expected=full)


def test_reconcile_tells_all_problems(spark):
    side = lambda *rows: spark.createDataFrame(rows, "source_id bigint, n bigint")
    got = validation.reconcile(side((1, 1), (2, 2), (3, 3), (4, 4)), side((1, 1), (2, 9), (4, 5), (4, 4), (5, 5)), "source_id", ["n"])
    assert {r["source_id"]: r["problem"] for r in got.collect()} == {2: "Changed", 3: "Missing", 4: "Duplicate", 5: "Unexpected"}


def ticked(spark, rows):
    """Events of (batch, source, ticks)."""
    return spark.createDataFrame([(n, b, s, t) for n, (b, s, t) in enumerate(rows)], "event_seq bigint, batch_seq bigint, source_id bigint, message_ticks bigint").withColumns({
        "radar_ordinal": F.lit(0), "elevation_slot": F.lit(0), "azimuth_bucket": F.floor(F.col("source_id") / 2).cast("int"), "range_band": (F.col("source_id") % 2).cast("int"), "gate_count": F.lit(2), "raw_sum": F.col("message_ticks") % 97})


def in_order(rows):
    """State and rejected batches by plain Python, batch by batch."""
    state, out = {}, []
    for b in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == b]
        last, ok = {}, True
        for _, s, t in mine:
            ok &= t >= max(last.get(s, 0), state[s][3] if s in state else 0)
            last[s] = t
        if not ok:
            out.append(b)
            continue
        for _, s, t in mine:
            n, v, c, _ = state.get(s, (0, 0, 0, 0))
            state[s] = (n + 1, v + 2, c + t % 97, t)
    return sorted((s, *x) for s, x in state.items()), out


@pytest.mark.parametrize("epochs", [[range(40)], [range(0, 1), range(1, 40)], [range(0, 13), range(13, 27), range(27, 40)]])
def test_state_does_not_depend_on_epochs(spark, tmp_path, epochs):
    rnd = random.Random(11)
    rows = [(b, rnd.randrange(12), 100 * b + rnd.choice([0, 3, 3, 5, -150, -400, 900])) for b in range(40) for _ in range(3)]
    want, late = in_order(rows)
    assert 5 < len(late) < 35
    write = commits.committer(str(tmp_path), UNIVERSE, buckets=5)
    for e, some in enumerate(epochs):
        write(ticked(spark, [r for r in rows if r[0] in some]), e)
        if e == 1:
            write(ticked(spark, [r for r in rows if r[0] in some]), e)  # delivered again
    assert sorted(map(tuple, commits.last_state(spark, str(tmp_path), 5).collect())) == want
    assert sorted(r["batch_seq"] for r in spark.read.parquet(str(tmp_path / "rejected")).collect()) == late


def test_a_late_batch_inside_one_epoch(spark, tmp_path):
    rows = [(0, 1, 100), (1, 1, 50), (2, 1, 70), (3, 1, 100), (3, 2, 5), (4, 2, 4), (4, 3, 9)]
    for name, epochs in (("one", [range(5)]), ("many", [[0], [1], [2], [3], [4]])):
        write = commits.committer(str(tmp_path / name), UNIVERSE)
        for e, some in enumerate(epochs):
            write(ticked(spark, [r for r in rows if r[0] in some]), e)
        assert sorted(r["batch_seq"] for r in spark.read.parquet(str(tmp_path / name / "rejected")).collect()) == [1, 2, 4]
        assert sorted((r["source_id"], r["last_ticks"]) for r in commits.last_state(spark, str(tmp_path / name)).collect()) == [(1, 100), (2, 5)]


def test_a_rejected_batch_lets_later_ones_pass(spark):
    """Batch 1 is late for source 1 and would make batch 2 late for source 2, and that batch 3 for source 3: each verdict hangs on the one before."""
    deltas = spark.createDataFrame([(0, 1, 10, 10), (1, 1, 5, 5), (1, 2, 90, 90), (2, 2, 50, 50), (2, 3, 80, 80), (3, 3, 40, 40), (4, 3, 80, 81)], "batch_seq bigint, source_id bigint, first_ticks bigint, last_ticks bigint")
    state = lambda *rows: spark.createDataFrame(list(rows), "source_id bigint, last_ticks bigint")
    verdicts = lambda s: {r["batch_seq"]: r["accepted"] for r in commits.ordered_verdicts(deltas, s).collect()}
    assert verdicts(state()) == {0: True, 1: False, 2: True, 3: False, 4: True}
    assert verdicts(state((2, 60))) == {0: True, 1: False, 2: False, 3: True, 4: True}


def test_commits_write_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path)
    write = commits.committer(folder, UNIVERSE, buckets=16)
    write(ticked(spark, [(0, s, 1) for s in range(20)]), 0)
    for e in range(1, 5):
        write(ticked(spark, [(e, 7, e + 1)]), e)
        assert len([p for p in (tmp_path / f"state/version={e}").iterdir() if p.name.startswith("bucket=")]) == 1
    before = sorted(map(tuple, commits.last_state(spark, folder, 16).collect()))
    assert len(before) == 20 and dict((r[0], r[1]) for r in before)[7] == 5
    state = commits.BucketedState(spark, folder, 16)
    assert state.expire(keep=2) == 3 + 1 + 2  # three records, the bucket's version 0, 1 and 2
    assert sorted(map(tuple, commits.last_state(spark, folder, 16).collect())) == before and state.newest() == 4 and state.expire(keep=2) == 0
    with pytest.raises(ValueError, match="never committed"):
        write(ticked(spark, [(9, 7, 9)]), 9)  # an epoch is missing
    with pytest.raises(ValueError, match="never committed"):
        write(ticked(spark, [(1, 7, 9)]), 1)  # the commit before it has expired
    with pytest.raises(ValueError, match="buckets"):
        commits.last_state(spark, folder, 8)
    assert commits.last_state(spark, str(tmp_path / "none")).count() == 0


def out_of(folder):
    return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")


def test_keyed_state_survives_a_restart(spark, tmp_path):
    """Three parts of the events, each in a query of its own on the same checkpoint; then one whose ticks step back."""
    folder, ev = str(tmp_path), detailed(stream_events(spark, DATA)).cache()
    before = spark.conf.get(keyed.PROVIDER)
    for k in range(3):
        ev.filter(F.floor(F.col("event_seq") / 400) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        keyed.run_keyed(keyed.source_totals(pipeline.replay(spark, f"{folder}/in", 1)), out_of(folder), f"{folder}/check")
    assert spark.conf.get(keyed.PROVIDER) == before
    last = windows.latest(spark.read.parquet(f"{folder}/out"), "source_id", "epoch").cache()
    from cirrolite.operators.rollups import source_rollup

    want = source_rollup(ev).join(checksums.source_checksums(ev), "source_id").join(ev.groupBy("source_id").agg(F.count_distinct("moment_id").alias("moments")), "source_id")
    cols = ["source_id", "event_count", "value_count", "raw_checksum", "last_ticks", "moments", "checksum"]
    assert sorted(map(tuple, last.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect())) and last.agg(F.max("late")).first()[0] == 0
    one = last.orderBy("source_id").first()
    last.unpersist()  # the folder is read again below
    ev.filter(F.col("source_id") == one["source_id"]).limit(1).withColumns({"message_ticks": F.lit(5).cast("bigint"), "event_seq": F.lit(10**6).cast("bigint")}).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    keyed.run_keyed(keyed.source_totals(pipeline.replay(spark, f"{folder}/in", 1)), out_of(folder), f"{folder}/check")
    late = windows.latest(spark.read.parquet(f"{folder}/out"), "source_id", "epoch").filter(F.col("source_id") == one["source_id"]).first()
    assert (late["late"], late["checksum"], late["event_count"]) == (1, one["checksum"], one["event_count"])


def test_idle_state_expires(spark, tmp_path):
    """The same events twice, with state that lives for a millisecond: the second time everything begins anew. Such a query has a next trigger always, so it is stopped."""
    folder, ev = str(tmp_path), detailed(stream_events(spark, DATA)).filter("event_seq < 20")
    want = {r["source_id"]: r["checksum"] for r in checksums.source_checksums(ev).collect()}
    for k in range(2):
        ev.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        seen = []
        with keyed.rocks(spark):
            run = keyed.source_totals(pipeline.replay(spark, f"{folder}/in", 1), idle_ms=1).writeStream.outputMode("update").foreachBatch(lambda rows, epoch: seen.extend(rows.collect()))
            run = run.option("checkpointLocation", f"{folder}/check").trigger(processingTime="1 second").start()
            until = time.time() + 60
            while not seen and time.time() < until:
                time.sleep(0.5)
            run.stop()
        assert {r["source_id"]: r["checksum"] for r in seen} == want


def deltas_of(spark, *rows):
    return spark.createDataFrame([("h", s, f"id{s}", source, "f", v, c) for s, source, v, c in rows], "handler string, sequence bigint, delta_id string, source_id bigint, field string, value bigint, content string")


def test_gaps_hold_deltas_back_until_they_are_filled(spark, tmp_path):
    folder = str(tmp_path)
    write = pipeline.delta_merger(folder)
    now = lambda: ({r["source_id"]: r["value"] for r in pipeline.merged_values(spark, folder).collect()}, {r["handler"]: r["next"] for r in pipeline.cursors(spark, folder).collect()})
    write(deltas_of(spark, (1, 1, 5, "b"), (1, 2, 6, "b"), (3, 1, 70, "d")), 0)
    assert now() == ({}, {})
    write(deltas_of(spark, (0, 1, 1, "a"), (1, 1, 5, "b"), (1, 2, 6, "b")), 1)  # 0 fills the gap; 1 comes again
    assert now() == ({1: 6, 2: 6}, {"h": 2})
    write(deltas_of(spark, (0, 1, 1, "a"), (5, 1, 900, "f"), (1, 1, 8, "other")), 2)
    assert now() == ({1: 6, 2: 6}, {"h": 2}) and [r["value"] for r in spark.read.parquet(f"{folder}/rejected").collect()] == [8]
    for _ in range(2):  # delivered twice
        write(deltas_of(spark, (2, 2, 10, "c")), 3)
        assert now() == ({1: 76, 2: 16}, {"h": 4})
    write(deltas_of(spark, (4, 3, 1000, "e")), 4)
    assert now() == ({1: 976, 2: 16, 3: 1000}, {"h": 6}) and spark.read.parquet(f"{folder}/pending/epoch=4").count() == 0
    assert spark.read.parquet(f"{folder}/applied/epoch=3").count() == 2  # what was released then, no more
    with pytest.raises(ValueError, match="never merged"):
        write(deltas_of(spark, (9, 3, 1, "z")), 9)


@pytest.mark.parametrize("size", [3, 10_000])
def test_ordered_folds_carry_their_state_over_batches(spark, size):
    """The longest rise of a source's values: it depends on every event before. Batches cut the sources anywhere."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def step(state, frame):
        last, now, best = state
        for v in frame["v"]:
            now = now + 1 if v > last else 1
            last, best = v, max(best, now)
        return last, now, best

    rise = handlers.Handler("Rise", {"rise": ("bigint", None), "half": ("double", None)}, fold=handlers.Fold(lambda: (-1, 0, 0), step, lambda s: {"rise": s[2], "half": s[2] / 2}), needs=("v",))
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), n, rnd.randrange(50)) for n in range(500)]
    want = {}
    for s in (1, 2, 3):
        want[s] = step((-1, 0, 0), {"v": [v for x, _, v in rows if x == s]})[2]
    spark.conf.set(key, size)
    try:
        got = handlers.snapshots(spark.createDataFrame(rows, "source_id bigint, event_seq bigint, v bigint"), [rise]).collect()
    finally:
        spark.conf.set(key, before)
    assert {(r["source_id"], r["field"]): r["int64_value"] if r["field"] == "rise" else r["double_value"] for r in got} == {(s, f): n if f == "rise" else n / 2 for s, n in want.items() for f in ("rise", "half")}
    wrong = handlers.Handler("Wrong", {"a": ("bigint", None)}, fold=handlers.Fold(lambda: 0, lambda s, f: s, lambda s: {"b": 1}))
    with pytest.raises(Exception, match="Wrong returned"):
        handlers.snapshots(spark.createDataFrame(rows, "source_id bigint, event_seq bigint, v bigint"), [wrong]).collect()


def test_range_join_of_uneven_ranges(spark):
    from cirrolite.operators.rollups import range_join

    ranges = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 1, 3), (2, 1, 3, 500), (3, 1, 500, 500), (4, 1, 700, 100_000)], "bucket_id int, shard_id int, first_source bigint, end_source bigint")
    events = spark.createDataFrame([(i,) for i in (-1, 0, 1, 2, 3, 499, 500, 650, 700, 99_999, 100_000, None)] * 2, "source_id bigint")
    joined = range_join(events, ranges)
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    assert sorted((r["source_id"], r["bucket_id"]) for r in joined.collect()) == sorted([(0, 0), (1, 1), (2, 1), (3, 2), (499, 2), (700, 4), (99_999, 4)] * 2)
    assert range_join(events, ranges.limit(0)).count() == 0


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_running_sums_over_slices(spark, slices):
    from cirrolite.operators.prefix import positions, running_sums

    rnd = random.Random(6)
    rows = [(rnd.randrange(20), n, rnd.choice([None, 0, 7, rnd.randrange(1 << 40)])) for n in range(300)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, v bigint").repartition(6)
    total, want = 0, []
    for k, (a, b, v) in enumerate(sorted(rows, key=lambda r: r[:2]), 1):
        total += v or 0
        want.append((a, b, v, total, k))
    made = running_sums(df, ["a", "b"], {"total": F.col("v"), "k": F.lit(1)}, slices)
    assert [tuple(r) for r in made.orderBy("a", "b").collect()] == want
    assert "SinglePartition" not in made._jdf.queryExecution().toString()
    assert positions(df.limit(0), ["a", "b"]).collect() == []


def test_a_write_counts_what_it_writes(spark, tmp_path):
    ev = detailed(stream_events(spark, DATA))
    totals = runs.counted_write(ev, str(tmp_path / "out"), F.col("message") == 0)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert totals == back.agg(F.count_distinct("batch_seq").alias("batches"), F.count("*").alias("events"), F.sum("gate_count").alias("bytes"), F.sum("gate_count").alias("values"), F.sum("raw_sum").alias("checksum")).first().asDict()
    assert runs.counted_write(ev.limit(0), str(tmp_path / "none"), F.col("message") == 0)["events"] == 0


def a_run(spark, run_id="a", version=1, some="event_seq >= 0"):
    return runs.run_tables(run_id, version, stream_events(spark, DATA).filter(some), Q.processed(spark, DATA), 640, [handlers.COUNTER])


def test_a_run_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    folder, tables = str(tmp_path), a_run(spark)
    poison = tables | {"diagnostics": tables["diagnostics"].withColumn("x", F.raise_error(F.lit("disk full")).cast("string"))}
    with pytest.raises(Exception, match="disk full"):
        runs.store(spark, poison, folder)
    assert runs.list_runs(spark, folder).collect() == [] and runs.latest_run(spark, folder).collect() == []
    with pytest.raises(ValueError, match="no run a"):
        runs.of_run(spark, folder, "sources", "a")
    assert runs.store(spark, tables, folder) == "Stored" and runs.of_run(spark, folder, "sources", "a").count() == 640
    with pytest.raises(ValueError, match="no table"):
        runs.of_run(spark, folder, "other", "a")


def test_stored_runs_of_another_schema_are_refused(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    monkeypatch.setattr(runs, "SCHEMA_VERSION", 2)
    runs.store(spark, a_run(spark), folder)
    monkeypatch.undo()
    for use in (lambda: runs.store(spark, a_run(spark), folder), lambda: runs.of_run(spark, folder, "sources", "a")):
        with pytest.raises(ValueError, match="schema version 2"):
            use()


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    """Another writer takes the record's number while this one writes its tables: a different run is no harm, the same run is found."""
    from cirrolite.sources import history

    folder, real = str(tmp_path), history.created

    def meanwhile(other):
        def first_other(spark_, path, text):
            if history.created is not real:  # once
                monkeypatch.setattr(history, "created", real)
                assert runs.store(spark, other, folder) == "Stored"
            return real(spark_, path, text)

        monkeypatch.setattr(history, "created", first_other)

    meanwhile(a_run(spark, "b", 2))
    assert runs.store(spark, a_run(spark), folder) == "Stored"
    assert [(r["run_id"], r["version"]) for r in runs.list_runs(spark, folder).collect()] == [("a", 1), ("b", 2)]
    meanwhile(a_run(spark, "c", 3))
    assert runs.store(spark, a_run(spark, "c", 3), folder) == "Unchanged"
    meanwhile(a_run(spark, "d", 4, "event_seq > 9"))
    with pytest.raises(ValueError, match="other content"):
        runs.store(spark, a_run(spark, "d", 4), folder)
    assert runs.latest_run(spark, folder).first()["run_id"] == "d" and runs.records(spark, folder).count() == 4
