"""Folds against plain Python integers."""

from __future__ import annotations

import struct

import pytest

from pyspark.sql import functions as F

from cirrolite.operators import checksums as C
from cirrolite.operators import rollups
from cirrolite.plans.bindings import detailed, stream_events
from cirrolite.plans.queries import gates

from .conftest import DATA

BASIS, PRIME, M = int(C.BASIS), int(C.PRIME), 2**64


def fnv(data: bytes, h: int = BASIS) -> int:
    for b in data:
        h = (h ^ b) * PRIME % M
    return h


def packed(row, fields) -> bytes:
    return b"".join(int(row[c]).to_bytes(n, "little", signed=False) for c, n in fields)


def test_source_and_run(spark):
    v = detailed(stream_events(spark, DATA).filter("event_seq < 600")).cache()
    want: dict[int, int] = {}
    for r in sorted(v.collect(), key=lambda r: r["event_seq"]):
        want[r["source_id"]] = fnv(packed(r, C.EVENT), want.get(r["source_id"], BASIS))
    got = C.source_checksums(v)
    assert {r["source_id"]: int(r["checksum"], 16) for r in got.collect()} == want
    h = BASIS
    state = {r["source_id"]: r for r in rollups.source_rollup(v).collect()}
    for s in sorted(state):
        r = state[s]
        h = fnv(struct.pack("<iqqqqQ", s, r["event_count"], r["value_count"], r["raw_checksum"], r["last_ticks"], want[s]), h)
    assert C.run_checksum(rollups.source_rollup(v).join(got, "source_id")).first()["checksum"] == f"{h:016x}"


def test_batch(spark):
    v = detailed(stream_events(spark, DATA).filter("event_seq < 500"))
    rows = sorted(v.collect(), key=lambda r: r["event_seq"])
    for got in C.batch_checksums(v).collect():
        mine = [r for r in rows if r["batch_seq"] == got["batch_seq"]]
        h = fnv(struct.pack("<iqiii", 1, 1, 1, len(mine), sum(r["gate_count"] for r in mine)))
        for r in mine:
            h = fnv(packed(r, C.METADATA), h)
        assert got["checksum"] == f"{h:016x}"


def test_chronology_does_not_depend_on_slices(spark):
    g = gates(spark, DATA).filter("radial_key < 400").cache()
    h = 0
    rows = sorted(g.collect(), key=lambda r: (r["radial_key"], r["gate_index"]))
    for r in rows:
        e = BASIS
        for c in C.CHRONOLOGY:
            e = (e ^ (int(r[c]) % M)) * PRIME % M
        h = (h * PRIME + e) % M
    for slices in (1, 5, 32):
        got = C.chronology(g, ["radial_key", "gate_index"], slices).first()
        assert (got["events"], got["checksum"]) == (len(rows), f"{h:016x}")


@pytest.mark.parametrize("word", [8, 16])
def test_sampled(spark, word):
    v = detailed(stream_events(spark, DATA).filter("event_seq < 300"))
    v = v.withColumn("word_size", F.lit(word)).withColumn("gates", F.transform("gates", lambda g: g * (257 if word == 16 else 1) % (1 << word)))
    got = {r["event_seq"]: r["work"] for r in C.sampled_checksum(v).collect()}
    for r in v.collect():
        h = fnv(struct.pack("<qqiqq", r["message_ticks"], r["volume_ticks"], r["radial_seq"], r["gate_count"], r["raw_sum"]))
        p = struct.pack(f">{len(r['gates'])}{'H' if word == 16 else 'B'}", *r["gates"])
        step = max(1, len(p) // 16)
        for k in range(16):
            i = min(len(p) - 1, k * step)
            h = fnv(bytes([p[i], p[len(p) - 1 - i]]), h)
        assert got[r["event_seq"]] == h & 0xFFFFF


def test_dictionary(spark):
    rows = [("radar", 0, "KTLX"), ("radar", 1, "KINX"), ("moment", 0, "RÉF")]
    want = fnv(struct.pack("<q", 4))
    for name, texts in (("radar", ["KTLX", "KINX"]), ("moment", ["RÉF"])):
        say = lambda t: struct.pack("<i", len(t)) + t.encode("utf-16-le")
        want = fnv(say(name) + struct.pack("<qi", len(texts) + 1, len(texts)), want)
        for i, t in enumerate(texts):
            want = fnv(struct.pack("<i", i) + say(t), want)
    got = C.dictionary_checksum(spark.createDataFrame(rows, "catalog string, id bigint, text string"), 4).first()
    assert (got["entries"], got["checksum"]) == (3, f"{want:016x}")


def test_a_fold_in_parallel_is_the_fold(spark):
    """Ranges of any size, also fewer rows than lanes, and rows whose ids step far."""
    import numpy as np

    r = np.random.default_rng(2)
    fields = [("a", 4), ("b", 8), ("c", 1)]
    for n in (1, 2, 63, 64, 65, 1000):
        column = {"a": r.integers(0, 2**31, n), "b": r.integers(-(2**62), 2**62, n), "c": r.integers(0, 255, n)}
        h = np.array([C.BASIS], np.uint64)
        for k in range(n):
            for c, w in fields:
                h = C.fold(h, column[c][k : k + 1], w)
        table, size = C.fold_table(column, fields)
        low = int(C.BASIS) & 255
        assert size == 13 * n and (int(table[low]) + (int(C.BASIS) - low) * int(C.power(size))) % 2**64 == int(h[0])
        df = spark.createDataFrame([(k * k, int(x), int(y), int(z)) for k, (x, y, z) in enumerate(zip(column["a"], column["b"], column["c"]))], "k bigint, a bigint, b bigint, c bigint")
        assert [tuple(x) for x in C.fold_ordered(df, "k", fields, slices=7).collect()] == [(n, C.hexed(h[0]))]
