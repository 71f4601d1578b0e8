"""Exact substring dedup by longest-previous-factor arrays.

Goal: remove each byte that lies in a `length`-byte string which also starts in a document with a smaller id.

1. Copies. Whole texts that repeat are found by their hash; only the first of each goes on.
2. Anchors. The GRAM-byte string with the smallest hash in every `length`-byte window is an anchor, so equal windows have equal anchors at
   equal places. An anchor travels, packed by shard, as its hash with hashes of the bytes around it that windows
   through it can reach: its whole context, and the half contexts to the left and right. Occurrences of one context that overlap in a document
   travel as one (a run of blanks is one entry), and of those that documents of one batch share only the first document's travels: the others lose the context at once.
3. Occurrences with equal contexts share all windows: those of later documents lose the whole context at once. Only the first
   occurrence of each context is looked at further, and only if a half context is shared with another one (two equal
   windows through an anchor share at least one half).
4. The snippets of those occurrences meet by anchor. A suffix array of the snippets, to the depth of one window, gives longest-previous-factor values:
   going through the sorted suffixes, the previous and next smaller positions are the neighbours with the nearest
   earlier document, and the longer of the two common prefixes is the longest earlier match; where it reaches `length`, the window goes.
5. The removed intervals of each document are united.

Only hashes, positions and the snippets at the ends of matches are shuffled, not texts. Hashes of 64 bits stand for equality of contexts under one anchor;
matches inside a context are decided by the longest-previous-factor arrays, on bytes.

Defined results: a null text is empty; rows of equal ids never remove bytes from each other, and each loses what its own text repeats: intervals
go by id and text (`tagged`); rows with a null id neither lose nor remove bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, dealt, mix, pack, partitions, small, small_batches, tagged, unpack, written

GRAM = 16
ENTRY = np.dtype([("key", "<u4"), ("context", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("extent", "<u4"), ("before", "u1"), ("after", "u1")])
SNIPPET = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("extent", "<u4"), ("before", "u1"), ("after", "u1")])
BLOCK = 1 << 20
B = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64) -> np.ndarray:
    p = np.full(BLOCK + 4096, base)
    p[0] = 1
    return np.multiply.accumulate(p)


POWER, INVERSE = _powers(B), _powers(np.uint64(pow(int(B), -1, 2**64)))
BYTE = mix(np.arange(1, 257))


def prefix_hashes(x: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of bytes: see run_hash."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[x] * POWER[: len(x)], dtype=np.uint64)))


def run_hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * INVERSE[a] + (b - a).astype(np.uint64))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of `width` values."""
    done, out = 1, x
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1])


def anchors(text: bytes, length: int) -> dict[str, np.ndarray] | None:
    """The anchors of a text: where they are, their hash and those of their contexts."""
    n, reach = len(text), length - GRAM
    if n < length:
        return None
    found = []
    x = np.frombuffer(text, np.uint8)
    for lo in range(0, n - length + 1, BLOCK):  # blocks overlap by all that a window or context can reach
        a, b = max(0, lo - reach), min(n, lo + BLOCK + 2 * length)
        total = prefix_hashes(x[a:b])
        i = np.arange(b - a - GRAM + 1)
        h = run_hash(total, i, i + GRAM)
        low = sliding(h, reach + 1, np.minimum)
        first, last = lo - a, min(lo + BLOCK, n - length + 1) - a  # the windows of this block
        m = low[first:last]
        padded = np.concatenate((np.zeros(reach, np.uint64), m, np.zeros(reach, np.uint64)))
        top = sliding(padded, reach + 1, np.maximum)  # for each gram the largest minimum of the windows over it
        at = np.flatnonzero(top == h[first : first + len(top)]) + first
        before, after = np.minimum(at + a, reach), np.minimum(n - (at + a) - GRAM, reach)
        half = reach // 2
        left, right = np.minimum(before, half), np.minimum(after, half)
        found.append((at + a, h[at], run_hash(total, at - before, at + GRAM + after), run_hash(total, at - left, at + GRAM), run_hash(total, at, at + GRAM + right), before, after))
    at, h, context, lh, rh, before, after = (np.concatenate(c) for c in zip(*found))
    _, keep = np.unique(at, return_index=True)
    return {n: v[keep] for n, v in (("at", at), ("hash", h), ("context", context), ("left", lh), ("right", rh), ("before", before), ("after", after))}


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _folded(e: np.ndarray, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(entries, shards, decided spans) of a batch: overlapping occurrences of a context become one, and those of documents after the first are decided."""
    name = e["context"] ^ mix(e["key"].astype(np.uint64) | shard.astype(np.uint64) << np.uint64(32))
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    often = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(e) else np.zeros(0, bool)
    alone, x, name = order[~often], order[often], name[order[often]]
    again = np.lexsort((e["at"][x], e["tag"][x], e["doc"][x], name))
    x, name = x[again], name[again]
    r = e[x]
    step = np.diff(r["at"].astype(np.int64))
    head = _heads(name, r["doc"], r["tag"], r["before"], r["after"], np.concatenate(([0], np.cumsum((step < 0) | (step > length)))) if len(r) else name)
    if len(r):
        r["extent"][head] = r["at"][np.append(head[1:], len(r)) - 1] - r["at"][head]
    r, x, name = r[head], x[head], name[head]
    first = _heads(name)
    least = np.repeat(r["doc"][first], np.diff(np.append(first, len(r))))
    later = r["doc"] > least
    d = r[later]
    spans = d["doc"], d["tag"], d["at"] - d["before"], d["at"] + d["extent"] + GRAM + d["after"]
    return np.concatenate([e[alone], r[~later]]), np.concatenate([shard[alone], shard[x[~later]]]), spans


ANCHORS = "shard int, entries binary, doc bigint, tag bigint, spans binary"


def _anchors(length: int, shards: int):
    def done(parts: list) -> Iterator[pa.RecordBatch]:
        e, shard, (doc, tag, a, b) = _folded(np.concatenate([e for e, _ in parts]), np.concatenate([s for _, s in parts]), length)
        for batch in _by_document(doc, tag, np.stack([a, b], 1).astype("<u4"), "spans", "looks"):
            place = mix(batch.column("doc").to_numpy()) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.nulls(len(place), pa.binary()), *batch.select(["doc", "tag", "spans"]).columns], ["shard", "entries", "doc", "tag", "spans"])
        packed = pack(e, shard)
        yield pa.RecordBatch.from_arrays([*packed.columns, pa.nulls(packed.num_rows, pa.int64()), pa.nulls(packed.num_rows, pa.int64()), pa.nulls(packed.num_rows, pa.binary())], ["shard", "entries", "doc", "tag", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for doc, tag, t in zip(b.column("id").to_pylist(), b.column("tag").to_pylist(), buffers(b.column("text"))):
                if (f := anchors(t or b"", length)) is None:
                    continue
                e = np.zeros(len(f["at"]), ENTRY)
                e["key"], e["doc"], e["tag"], e["context"] = f["hash"] & np.uint64(0xFFFFFFFF), doc, tag, f["context"]
                for name in ("left", "right"):
                    e[name] = f[name] >> np.uint64(48)
                for name in ("at", "before", "after"):
                    e[name] = f[name]
                parts.append((e, (f["hash"] >> np.uint64(32)) % np.uint64(shards)))
                held += len(e)
                if held > 600_000:
                    yield from done(parts)
                    parts, held = [], 0
        if parts:
            yield from done(parts)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tag, spans, looks): removed intervals, and places to look at further with their anchor's key."""
    gone, look, packed = [], [], []
    for b in batches:
        told = pa.compute.is_valid(b.column("doc"))
        some = b.filter(told)
        yield pa.RecordBatch.from_arrays([*some.select(["doc", "tag", "spans"]).columns, pa.nulls(some.num_rows, pa.binary())], ["doc", "tag", "spans", "looks"])
        packed.append(b.filter(pa.compute.invert(told)))
    for s, e in unpack(iter(packed), ENTRY).items():
        e = e[np.lexsort((e["doc"], e["context"], e["key"]))]
        head = _heads(e["key"], e["context"])
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(e))))
        later = e["doc"] > e["doc"][head][of]
        d = e[later]
        gone.append((d["doc"], d["tag"], d["at"] - d["before"], d["at"] + d["extent"] + GRAM + d["after"]))
        # contexts, each with its first document: of keys with several contexts in several documents, those that share a half
        r = e[head]
        group = _heads(r["key"])
        count = np.diff(np.append(group, len(r)))
        low, high = np.minimum.reduceat(r["doc"], group), np.maximum.reduceat(r["doc"], group)
        open_ = np.flatnonzero(np.repeat((count > 1) & (low < high), count))
        shared = np.zeros(len(r), bool)
        for name in ("left", "right"):
            q = r[open_]
            order = np.lexsort((q[name], q["key"]))
            at = _heads(q["key"][order], q[name][order])
            n = np.diff(np.append(at, len(q)))
            shared[open_[order]] |= np.repeat(n > 1, n)
        r = e[~later & shared[of]]
        p, tags = np.empty(len(r), SNIPPET), r["tag"]
        p["key"] = r["key"].astype(np.uint64) | np.uint64(s) << np.uint64(32)
        for name in ("doc", "at", "extent", "before", "after"):
            p[name] = r[name]
        look.append((p, tags))
    doc, tag, a, b = (np.concatenate(c) for c in zip(*gone)) if gone else (np.empty(0, np.int64),) * 4
    yield from _by_document(doc, tag, np.stack([a, b], 1).astype("<u4") if len(doc) else np.empty((0, 2), "<u4"), "spans", "looks")
    p, tag = (np.concatenate(c) for c in zip(*look)) if look else (np.empty(0, SNIPPET), np.empty(0, np.int64))
    yield from _by_document(p["doc"].copy(), tag, p, "looks", "spans")


def _by_document(doc: np.ndarray, tag: np.ndarray, rows: np.ndarray, name: str, other: str) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((tag, doc))
    doc, tag, rows = doc[order], tag[order], rows[order]
    at = np.append(_heads(doc, tag), len(doc)) if len(doc) else np.zeros(1, np.int64)
    for i in range(0, len(at) - 1, 50_000):
        some = at[i : i + 50_001]
        values = pa.array([rows[a:b].tobytes() for a, b in zip(some[:-1], some[1:])], pa.binary())
        yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[some[:-1]]), "tag": pa.array(tag[some[:-1]]), name: values, other: pa.nulls(len(values), pa.binary())}).select(["doc", "tag", "spans", "looks"])


SNIPPETS = "key bigint, doc bigint, tag bigint, at bigint, extent bigint, snippet binary"


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {n: [] for n in ("key", "doc", "tag", "at", "extent", "snippet")}
        for doc, tag, t, looks in zip(b.column("id").to_pylist(), b.column("tag").to_pylist(), buffers(b.column("text")), b.column("looks").to_pylist()):
            done = set()
            for raw in looks:
                p = np.frombuffer(raw, SNIPPET)
                for key, at, extent, before, after in zip(*(p[c].tolist() for c in ("key", "at", "extent", "before", "after"))):
                    if (key, at) not in done:
                        done.add((key, at))
                        for n, v in (("key", key), ("doc", doc), ("tag", tag), ("at", at - before), ("extent", extent), ("snippet", t[at - before : at + GRAM + after])):
                            out[n].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["tag"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["extent"], pa.int64()), pa.array(out["snippet"], pa.binary())], list(out))


def previous_factors(suffixes: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix (a row of depth bytes) the longest prefix that it shares with a suffix of a smaller doc.

    In suffix order the candidates are the nearest neighbours on either side with a smaller doc: previous and next smaller values, by a stack; the
    common prefix with them is the minimum of the neighbours' common prefixes in between.
    """
    n = len(suffixes)
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{depth}").reshape(-1), kind="stable") if n else np.empty(0, np.int64)
    s, d = suffixes[order], doc[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), depth) if n > 1 else np.empty(0, np.int64)
    best = np.zeros(n, np.int64)
    for forward in (True, False):
        dd, cc = (d, common) if forward else (d[::-1], common[::-1])
        dd, cc, got = dd.tolist(), cc.tolist(), [0] * n
        stack: list[tuple[int, int]] = []  # (doc, common prefix with the entry below)
        for i in range(n):
            reach = cc[i - 1] if i else 0
            while stack and stack[-1][0] >= dd[i]:
                reach = min(reach, stack.pop()[1])
            got[i] = reach if stack else 0
            stack.append((dd[i], reach))
        best = np.maximum(best, np.array(got if forward else got[::-1], np.int64))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _factors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, tag, at, extent, text = [], [], [], [], [], []
        for b in batches:
            key += b.column("key").to_pylist()
            doc += b.column("doc").to_pylist()
            tag += b.column("tag").to_pylist()
            at += b.column("at").to_pylist()
            extent += b.column("extent").to_pylist()
            text += list(buffers(b.column("snippet")))
        d, g, a, b2 = ([np.empty(0, np.int64)] for _ in range(4))
        step = 20_000  # snippets whose suffixes are sorted together; a key's snippets stay together while it has fewer
        order = sorted(range(len(key)), key=lambda i: key[i])
        for some in _whole_keys(order, key, step):
            n = np.array([len(text[i]) for i in some])
            flat = np.frombuffer(b"".join([text[i] for i in some]) + bytes(length), np.uint8)
            starts = np.cumsum(n) - n
            own = np.repeat(np.arange(len(some)), n)
            offset = np.arange(n.sum()) - np.repeat(starts, n)
            full = offset + length <= np.repeat(n, n)
            own, offset = own[full], offset[full]
            rows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts[own] + offset]
            docs = np.array([doc[i] for i in some])[own]
            hit = previous_factors(rows, docs, length) >= length
            d.append(docs[hit])
            g.append(np.array([tag[i] for i in some])[own][hit])
            a.append((np.array([at[i] for i in some])[own] + offset)[hit])
            b2.append(a[-1] + length + np.array([extent[i] for i in some])[own][hit])
        doc_, tag_, a_, b_ = (np.concatenate(c) for c in (d, g, a, b2))
        for batch in _by_document(doc_, tag_, np.stack([a_, b_], 1).astype("<u4"), "spans", "looks"):
            yield batch.select(["doc", "tag", "spans"])

    return run


def _whole_keys(order: list[int], key: list[int], step: int) -> Iterator[list[int]]:
    some: list[int] = []
    for i in order:
        if len(some) >= step and key[some[-1]] != key[i]:
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def united(spans: list[bytes]) -> np.ndarray:
    """Disjoint maximal intervals, in order."""
    s = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in spans]).astype(np.int64) if spans else np.empty((0, 2), np.int64)
    if not len(s):
        return s
    s = s[np.argsort(s[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    new = np.concatenate(([True], s[1:, 0] > end[:-1]))
    at = np.flatnonzero(new)
    return np.stack([s[at, 0], np.concatenate((end[at[1:] - 1], end[-1:]))], 1)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, held = [], 0
        for doc, t, whole, spans in zip(b.column("id").to_pylist(), buffers(b.column("text")), b.column("copy").to_pylist(), b.column("spans").to_pylist()):
            t = t or b""
            s = np.array([[0, len(t)]]) if whole and len(t) else united(spans or [])
            kept, at = [], 0
            for x, y in s.tolist():
                kept.append(t[at:x])
                at = y
            kept = b"".join([*kept, t[at:]])
            rows.append((doc, len(t), len(t) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept, [{"start": x, "end": y} for x, y in s.tolist()]))
            held += len(kept)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows)), CUT)], schema=CUT)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows)), CUT)], schema=CUT)


CUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and spans (start, end in bytes)."""
    if not 2 * GRAM <= length <= GRAM + 255:
        raise ValueError(f"length is {length}; matches of {2 * GRAM} to {GRAM + 255} bytes can be found")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = tagged(rows)
    named = rows.select("id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n"))
    long = named.filter(f"id is not null and n >= {length}")
    # a copy is a row whose text an earlier document has
    first = long.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    copies = written(long.join(first, "sha").filter("id > first").select("id", "sha").distinct())
    copies = small(copies, 100)
    marked = rows.withColumn("sha", F.sha2("text", 256))
    told = marked.join(copies, ["id", "sha"], "left_anti")
    shards = partitions(spark)
    entries = told.filter("id is not null").select("id", "tag", "text").mapInArrow(_anchors(length, shards), ANCHORS)
    met = written(dealt(entries, shards).mapInArrow(_contexts, "doc bigint, tag bigint, spans binary, looks binary"))
    looks = met.filter("looks is not null").groupBy(F.col("doc").alias("id"), "tag").agg(F.collect_list("looks").alias("looks"))
    near = rows.join(small(written(looks.select("id", "tag"))), ["id", "tag"], "left_semi")
    snippets = near.join(looks, ["id", "tag"]).mapInArrow(_snippets, SNIPPETS)
    more = snippets.repartition(shards, "key").mapInArrow(_factors(length), "doc bigint, tag bigint, spans binary")
    spans = met.filter("spans is not null").select("doc", "tag", "spans").unionByName(more)
    spans = spans.groupBy(F.col("doc").alias("id"), "tag").agg(F.collect_list("spans").alias("spans"))
    marked = marked.join(copies.withColumn("copy", F.lit(True)), ["id", "sha"], "left").drop("sha")
    out = marked.join(spans, ["id", "tag"], "left").select("id", "text", "copy", "spans").mapInArrow(_apply, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id)
