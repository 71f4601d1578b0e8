"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct five-word shingles. Each size band spreads shingles over blocks and XORs the hashes of those that fall into a block:
a parity sketch. A shingle in one set only changes one block, so the number of blocks in which two sketches differ is at most the
symmetric difference, and that is at most (|A| + |B|) (1 - t) / (1 + t) at similarity t. By the pigeonhole principle two
linked sets agree in all other blocks: under one global order of the keys (blocks of many shingles first, as they are rarest) the first
d + 1 + s keys of each share at least s + 1. Every text emits that many keys, packed by shard.

A key with few texts gives its pairs with the number of keys they share; pairs that can't reach s + 1 go. A key with many texts (a frequent
passage, a family of copies) gives none: only texts with more than s such keys can be linked by them alone, and those are tied to the smallest of
their key. What is so tied forms candidate families, which are compared exactly by shingle sets: whole families of up to `tile` texts in one
place, larger ones by pairs of tiles of compatible sizes, so no task holds more than two tiles and every link is found.

Texts with equal sets are one node from the start. A link leaves a task as an edge to the smallest text of its group, never as all pairs.

Defined results: null and empty texts, and those of white space only, have an empty set and link with nothing; rows that repeat are copies; a set
all of whose ids are null links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, components, dealt, mix, pack, partitions, small, small_batches, unpack, written
from .embedding_dedup import roots
from .shingles import shingle_hashes, word_hashes

ENTRY = np.dtype([("key", "<u4"), ("set", "<u8"), ("need", "u1")])
FEW = 16


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def set_name(h: np.ndarray) -> int:
    """64 bits that stand for the set."""
    if not len(h):
        return 0
    both = np.array([np.bitwise_xor.reduce(h), mix(h).sum(), len(h)], np.uint64)
    return int(mix(np.array([(mix(both) * both[::-1]).sum()]))[0].view(np.int64))


def keys_of(h: np.ndarray, threshold: float) -> list[tuple[np.ndarray, int]]:
    """For each band in which the set may meet a partner: its keys, and how many of them a partner shares at least."""
    n, bands = len(h), []
    band = (n.bit_length() - 1) // 2
    limit = (1 - threshold) / (1 + threshold)
    for b, partner in ((band, min(n / threshold, 4 ** (band + 1) - 1)), (band + 1, n / threshold)):
        if b > band and partner < 4**b:
            break
        differ = int((n + partner) * limit)
        if b < 3:  # small sets: a block for each shingle
            keys, count = mix(h + np.uint64(b)), np.ones(n, np.int64)
        else:
            blocks = np.uint64(4 ** (b + 1) // 2)
            block = h % blocks
            order = np.argsort(block, kind="stable")
            block, value = block[order], mix(h[order] ^ np.uint64(0x5851F42D4C957F2D))
            at = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))
            count = np.diff(np.concatenate((at, [n])))
            keys = mix(np.bitwise_xor.reduceat(value, at) + block[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b))
        slack = max(0, min(4 + n // 32, len(keys) - differ - 1, 250))
        take = differ + 1 + slack
        if take < len(keys):
            keys = keys[np.lexsort((keys, -count))[:take]]
        bands.append((keys, slack + 1))
    return bands


KEYS = "shard int, entries binary, id bigint, n bigint, set bigint"


def _keys(threshold: float, shards: int):
    """One pass over the texts: a row (id, n, set) for each, and the packed keys of each distinct set."""

    def packed(parts: list) -> pa.RecordBatch:
        b = pack(np.concatenate([e for e, _ in parts]), np.concatenate([s for _, s in parts]))
        return pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, pa.int64())] * 3], ["shard", "entries", "id", "n", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            n, names, parts, held = [], [], [], 0
            for t in buffers(b.column("text")):
                h = shingle_set(t)
                name = set_name(h)
                n.append(len(h))
                names.append(name)
                if len(h) and name not in seen:
                    seen.add(name)
                    for keys, need in keys_of(h, threshold):
                        e = np.empty(len(keys), ENTRY)
                        e["key"], e["set"], e["need"] = keys & np.uint64(0xFFFFFFFF), np.int64(name).view(np.uint64), need
                        parts.append((e, (keys >> np.uint64(32)) % np.uint64(shards)))
                        held += len(keys)
                    if held > 400_000:
                        yield packed(parts)
                        parts, held = [], 0
            if parts:
                yield packed(parts)
            place = (mix(np.array(names, np.int64).view(np.uint64)) + np.arange(len(names), dtype=np.uint64)) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.nulls(len(n), pa.binary()), b.column("id"), pa.array(n, pa.int64()), pa.array(names, pa.int64())], ["shard", "entries", "id", "n", "set"])

    return run


MET = ("a", "b", "shared", "need", "hot", "id", "n", "set")


def _meet_and_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _meet makes of the keys, and the rows (id, n, set) as they came."""
    rest = []
    for b in batches:
        named = pa.compute.is_valid(b.column("n"))
        some = b.filter(named)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(some.num_rows, pa.int64())] * 5, *[some.column(c) for c in ("id", "n", "set")]], list(MET))
        rest.append(b.filter(pa.compute.invert(named)))
    for b in _meet(iter(rest)):
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, pa.int64())] * 3], list(MET))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this task's keys: pairs of sets with the number of keys they share, or (many texts) the sets of each key."""
    left, right, need, hot_key, hot_set, hot_need = [], [], [], [], [], []
    for s, e in unpack(batches, ENTRY).items():
        e = e[np.lexsort((e["set"], e["key"]))]
        e = e[np.concatenate(([True], (np.diff(e["key"].astype(np.int64)) != 0) | (np.diff(e["set"]) != 0)))]
        at = np.concatenate(([0], np.flatnonzero(np.diff(e["key"].astype(np.int64))) + 1))
        size = np.diff(np.concatenate((at, [len(e)])))
        for k in range(2, FEW + 1):
            first = at[size == k]
            for i in range(k):
                for j in range(i + 1, k):
                    left.append(e["set"][first + i])
                    right.append(e["set"][first + j])
                    need.append(np.minimum(e["need"][first + i], e["need"][first + j]))
        for a, k in zip(at[size > FEW], size[size > FEW]):
            hot_key.append(np.full(k, (s << 32) + int(e["key"][a]), np.int64))
            hot_set.append(e["set"][a : a + k])
            hot_need.append(e["need"][a : a + k])
    none = np.empty(0, np.uint64)
    if left:
        pairs, need = np.stack([np.concatenate(left), np.concatenate(right)], 1), np.concatenate(need)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs, need = pairs[order], need[order]
        head = np.flatnonzero(np.concatenate(([True], (np.diff(pairs, axis=0) != 0).any(1))))
        pairs, shared, least = pairs[head], np.diff(np.concatenate((head, [len(pairs)]))), np.minimum.reduceat(need, head)
    else:
        pairs, shared, least = np.empty((0, 2), np.uint64), none, none
    hk, hs, hn = (np.concatenate(x) if x else none for x in (hot_key, hot_set, hot_need))
    long = lambda x: pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))
    step = 1 << 20
    for i in range(0, max(len(pairs), 1), step):
        p = pairs[i : i + step]
        yield pa.RecordBatch.from_arrays([long(p[:, 0]), long(p[:, 1]), long(shared[i : i + step]), long(least[i : i + step]), pa.nulls(len(p), pa.int64())], ["a", "b", "shared", "need", "hot"])
    for i in range(0, len(hk), step):
        k = len(hk[i : i + step])
        yield pa.RecordBatch.from_arrays([long(hs[i : i + step]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), long(hn[i : i + step]), pa.array(hk[i : i + step])], ["a", "b", "shared", "need", "hot"])


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact links between the sets of left and right, or (right None) within left."""
    sets = left if right is None else left + right
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    word = word.reshape(-1)
    rank = np.cumsum(count > 1) - 1  # shingles of one set alone meet nothing
    keep = count[word] > 1
    owner, word = owner[keep], rank[word[keep]]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    nl, columns = len(left), 4096
    both = np.zeros((nl, nl if right is None else len(right)), np.float32)
    for c in range(0, int(word[-1]) + 1 if len(word) else 0, columns):
        lo, hi = np.searchsorted(word, (c, c + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[lo:hi], word[lo:hi] - c] = 1
        both += m[:nl] @ (m[:nl] if right is None else m[nl:]).T
    rs = size[:nl] if right is None else size[nl:]
    union = size[:nl, None] + rs[None, :] - both
    i, j = np.nonzero((both > 0) & (both * 100.0 >= round(threshold * 100) * union.astype(np.float64)))
    return (i[i < j], j[i < j]) if right is None else (i, j)


def _compare(threshold: float):
    def groups(batches):
        group, rows = None, []
        for b in batches:
            for g, side, node, t in zip(b.column("g").to_pylist(), b.column("side").to_pylist(), b.column("set").to_pylist(), buffers(b.column("grams"))):
                if g != group and rows:
                    yield rows
                    rows = []
                group = g
                rows.append((side, node, np.frombuffer(t, np.uint64)))
        if rows:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in groups(batches):
            rows = sorted({r[:2]: r for r in rows}.values(), key=lambda r: r[:2])  # rows that repeat an id count once
            left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
            i, j = linked([r[2] for r in left], [r[2] for r in right] or None, threshold)
            if right:
                j = j + len(left)
            node = np.array([r[1] for r in rows])
            lead = roots(len(rows), i, j)
            far = lead != np.arange(len(rows))
            a.append(node[far])
            b.append(node[lead[far]])
            if len(a) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, out, held = [], [], 0
        for t in buffers(b.column("text")):
            h = shingle_set(t)
            names.append(set_name(h))
            out.append(h.tobytes())
            held += len(out[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["set", "grams"])
                names, out, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["set", "grams"])


def ngram_components(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.75, tile: int = 512) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    shards = partitions(spark)
    met = written(dealt(rows.mapInArrow(_keys(threshold, shards), KEYS), shards).mapInArrow(_meet_and_names, ", ".join(f"{c} bigint" for c in MET)))
    sets = met.filter("n is not null").select("id", "n", "set")
    met = met.filter("n is null").select("a", "b", "shared", "need", "hot")
    first = sets.filter("n > 0").groupBy("set").agg(F.min("id").alias("node"), F.first("n").alias("n")).filter("node is not null")
    # keys with many texts: how many of them a set has
    hot = met.filter("hot is not null").select(F.col("a").alias("set"), "hot", "need")
    hots = written(hot.groupBy("set").agg(F.count("*").alias("hots"), F.max("need").alias("need")))
    pairs = met.filter("hot is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    own = lambda side: hots.select(F.col("set").alias(side), F.col("hots").alias(f"hots_{side}"))
    pairs = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").filter(F.col("shared") + F.coalesce(F.least("hots_a", "hots_b"), F.lit(0)) * F.when(F.col("hots_a").isNotNull() & F.col("hots_b").isNotNull(), 1).otherwise(0) >= F.col("need"))
    heavy = hot.join(hots.filter("hots >= need").select("set"), "set", "left_semi")
    tied = heavy.join(heavy.groupBy("hot").agg(F.min("set").alias("b")), "hot").select(F.col("set").alias("a"), "b").filter("a <> b").distinct()
    families = written(components(pairs.select("a", "b").union(tied)).select(F.col("node").alias("set"), F.col("component").alias("family")).join(first, "set"))
    # tiles: the members of a family in order of size
    sizes = families.groupBy("family").agg(F.count("*").alias("f"), F.min("n").alias("least"), F.max("n").alias("most"))
    dealt_out = families.join(sizes.filter(F.col("f") <= tile).select("family"), "family").select("set", F.concat(F.lit("f"), "family").alias("g"), F.lit(0).alias("side"))
    large = families.join(sizes.filter(F.col("f") > tile).select("family"), "family")
    if not large.isEmpty():
        # a family's sizes in classes of 8 %, each class cut by a hash into tiles of about half the limit
        large = large.withColumn("c", F.floor(F.log("n") / F.log(F.lit(1.08))).cast("int"))
        cut = large.groupBy("family", "c").agg(F.ceil(F.count("*") / (tile / 2)).cast("int").alias("cuts"))
        large = written(large.join(cut, ["family", "c"]).withColumn("cut", F.pmod(F.xxhash64("set"), F.col("cuts")).cast("int")))
        a, b = cut.select("family", F.col("c").alias("c1"), F.col("cuts").alias("k1")), cut.select("family", F.col("c").alias("c2"), F.col("cuts").alias("k2"))
        reach = int(np.ceil(np.log(1 / threshold) / np.log(1.08))) + 1
        near = cut.select("family", F.col("c").alias("c1"), F.col("cuts").alias("k1"), F.explode(F.sequence(F.col("c"), F.col("c") + reach)).alias("c2")).join(b, ["family", "c2"])
        near = near.withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("k1") - 1))).withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("k2") - 1))).filter("c1 < c2 or t1 <= t2")
        near = near.withColumn("g", F.concat_ws(":", F.lit("t"), "family", "c1", "t1", "c2", "t2"))
        one = near.select("family", F.col("c1").alias("c"), F.col("t1").alias("cut"), "g", F.lit(0).alias("side"))
        two = near.filter("c1 < c2 or t1 < t2").select("family", F.col("c2").alias("c"), F.col("t2").alias("cut"), "g", F.lit(1).alias("side"))
        dealt_out = dealt_out.unionByName(large.join(one.unionByName(two), ["family", "c", "cut"]).select("set", "g", "side"))
    # one text of each set in question; ids reach the tasks by broadcast only while they are few
    wanted = small(written(families.select(F.col("node").alias("id")).distinct()))
    grams = rows.join(wanted, "id").mapInArrow(_grams, "set bigint, grams binary")
    grouped = grams.join(dealt_out, "set").repartition(partitions(spark), "g").sortWithinPartitions("g")
    joined = components(grouped.mapInArrow(_compare(threshold), "a bigint, b bigint")).withColumnRenamed("node", "set")
    least = written(first.join(joined, "set", "left").withColumn("component", F.coalesce("component", "set")).select("set", "component", "node"))
    least = least.join(least.groupBy("component").agg(F.min("node").alias("component_id")), "component").select("set", "component_id")
    found = sets.join(least, "set", "left")
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))
