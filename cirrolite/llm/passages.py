"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. Under one hash function every stretch of shingles has the hash of its smallest one as its signature, and
the nodes of the Cartesian tree over the hashes group the stretches: node c with range [l, r] stands for all stretches from [l, c] to [c, r]. A
compact window is a node whose range holds at least `least_words` words; there are about two per such length and function. They travel,
packed by shard, under their hash.

Windows under keys that several documents have travel once more with the shingles around c, as far as the shortest passages with c reach. Windows with the
same shingles form a class, whose first document stands for the others, and each class meets the earlier ones that share the threshold's part of a
shortest passage with it, less those whose common shingles are all among another one's (a passage goes if one earlier document has it). A key of many documents is cut into tiles,
and each pair of tiles meets on its own, so no partner is dropped and no task holds more than two tiles. These pairs are
verified on their whole texts: windows of both are joined by hash, an interval join gathers those that overlap on both sides and keeps
places with windows of at least `agree` hash functions, and in each place the densest stretches of common shingles are accepted if both sides hold
`least_words` words, begin and end with common words, and the Jaccard similarity of their shingle sets reaches `threshold`. A text's partners come one after another, the one with most in common first;
parts that accepted stretches cover already are left out with the later ones, as they could add nothing.

The later document (by id) loses the words of the passage, the earlier one keeps them; all is judged on the input. A whole text whose words repeat an earlier document's goes entirely,
if it has `least_words` words, without taking part in the search.

Defined results: null and empty texts and those of fewer words lose nothing; rows that share an id lose nothing to each other, and each loses what its own text repeats
(places go by id and text); rows with a null id neither lose nor remove words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, buffers, dealt, mix, pack, partitions, small, small_batches, tagged, unpack, written
from .shingles import P, batch_shingle_hashes
from .suffix_dedup import sliding, united

GRAM = 5
FUNCTIONS = 6
TILE = 2048
CHUNK = 1 << 20  # bytes of text
LONG = 1 << 13  # shingles of a text whose places are kept by shingle
ENTRY = np.dtype([("key", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("c", "<u4"), ("left", "<u2"), ("right", "<u2")])
KEY = np.dtype([("key", "<u8"), ("c", "<u4"), ("left", "<u2"), ("right", "<u2")])
BASE = np.uint64(0x9E3779B97F4A7C15)
SEEDS = mix(np.arange(1, FUNCTIONS + 1) * 7919)


def windows(texts: list[np.ndarray], width: int, functions: int = FUNCTIONS) -> dict[str, np.ndarray]:
    """Compact windows of at least `width` shingles: text, function, value, l, c, r (positions within the text), for the first `functions` functions."""
    found = []
    n = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(n + 1) - n  # a zero before each text, smaller than all hashes, ends every range
    whole = np.zeros(int((n + 1).sum()) + 1, np.uint64)
    own = np.repeat(np.arange(len(texts)), n)
    place = start[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    ends = np.append(start + n, len(whole) - 1) if len(texts) else np.empty(0, np.int64)
    ends = np.unique(np.concatenate((start - 1, ends)))
    ends = ends[ends >= 0]
    for f in range(functions):
        whole[place] = mix(flat ^ SEEDS[f]) | np.uint64(1)
        if len(whole) < width:
            break
        # by the upper halves, which take half the time: all nodes are among them, and what else there is has a range too narrow
        upper = (whole >> np.uint64(32)).astype(np.uint32)
        edge = np.zeros(width - 1, np.uint32)
        low = np.concatenate((edge, sliding(upper, width, np.minimum), edge))
        c = np.flatnonzero((sliding(low, width, np.maximum) == upper) & (whole > 0))
        v = whole[c]
        # the nearest smaller values to either side are nodes themselves, or the zero between texts
        pos = np.sort(np.concatenate((c, ends)))
        value, k = whole[pos], np.searchsorted(pos, c)
        at = np.arange(len(pos))
        less, l, r = at - 1, at - 1, at + 1
        for link in (less, r):
            rest = k
            while len(rest := rest[value[link[rest]] >= value[rest]]):
                link[rest] = link[link[rest]]  # none between a value and the one it is linked to are smaller
        # to the left equal values count too: those over them go past all equal ones at once
        rest = k
        while len(rest := rest[value[l[rest]] > value[rest]]):
            l[rest] = less[l[rest]]
        l, r = pos[l[k]] + 1, pos[r[k]] - 1
        wide = r - l + 1 >= width
        text = np.searchsorted(start, c, "right") - 1
        base = start[text]
        found.append([x[wide] for x in (text, np.full(len(c), f), v, l - base, c - base, r - base)])
    if not found:
        return {k: np.empty(0, np.int64) for k in ("text", "f", "v", "l", "c", "r")}
    return dict(zip(("text", "f", "v", "l", "c", "r"), (np.concatenate(x) for x in zip(*found))))


def contents(texts: list[np.ndarray], w: dict[str, np.ndarray], width: int) -> np.ndarray:
    """A hash of each window's shingles up to width - 1 places before and after c, and of c's place among them."""
    n = np.array([len(x) for x in texts])
    first = (np.cumsum(n) - n)[w["text"]]
    l, r = first + np.maximum(w["l"], w["c"] - width + 1), first + np.minimum(w["r"], w["c"] + width - 1)
    flat = np.concatenate(texts)
    power = np.full(len(flat) + 1, BASE)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat * power[: len(flat)])))
    return mix((total[r + 1] - total[l]) * power[len(flat) - l] + (first + w["c"] - l).astype(np.uint64))


def _windows(width: int, shards: int, functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, docs, tags, held = [], [], [], 0
            for k, (doc, tag, t) in enumerate(zip(b.column("id").to_pylist(), b.column("tag").to_pylist(), buffers(b.column("text")))):
                texts.append(t)
                docs.append(doc)
                tags.append(tag & 0xFFFFFFFF)
                held += len(t or b"")
                if held > CHUNK or k == b.num_rows - 1:
                    hashes = batch_shingle_hashes(texts)
                    wide = [i for i, x in enumerate(hashes) if len(x) >= width]
                    found = windows([hashes[i] for i in wide], width, functions)
                    e = np.empty(len(found["v"]), ENTRY)
                    v = mix(found["v"] + found["f"].astype(np.uint64))
                    e["key"], e["doc"], e["tag"] = v & np.uint64(0xFFFFFFFF), np.array(docs)[wide][found["text"]], np.array(tags, np.uint32)[wide][found["text"]]
                    e["c"], e["left"], e["right"] = found["c"], np.minimum(found["c"] - found["l"], width - 1), np.minimum(found["r"] - found["c"], width - 1)
                    if len(e):
                        yield pack(e, ((v >> np.uint64(32)) % np.uint64(shards)).astype(np.int32))
                    texts, docs, tags, held = [], [], [], 0

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, half, keys): the windows of document a (its tag's lower half) under keys that other documents have too. A key holds its shard and the number of tiles that its windows are cut into."""
    docs, tags, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, KEY)]
    for shard, e in unpack(batches, ENTRY).items():
        e = e[np.lexsort((e["doc"], e["key"]))]
        head = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
        last = np.append(head[1:], len(e)) - 1
        size = last - head + 1
        many = np.repeat(e["doc"][head] != e["doc"][last], size)
        new = np.concatenate(([True], (e["key"][1:] != e["key"][:-1]) | (e["doc"][1:] != e["doc"][:-1])))
        size = np.repeat(np.add.reduceat(new, head, dtype=np.int64), size)[many]  # documents
        e = e[many]
        k = np.empty(len(e), KEY)
        k["key"] = e["key"] | np.uint64(shard << 32) | np.minimum(-(-size // TILE), 0xFFFF).astype(np.uint64) << np.uint64(48)
        for name in ("c", "left", "right"):
            k[name] = e[name]
        docs.append(e["doc"].copy())
        tags.append(e["tag"].copy())
        keys.append(k)
    doc, tag, key = np.concatenate(docs), np.concatenate(tags), np.concatenate(keys)
    order = np.lexsort((tag, doc))
    doc, tag, key = doc[order], tag[order], key[order]
    at = np.append(np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))), len(doc)) if len(doc) else np.empty(0, np.int64)
    for i in range(0, len(at) - 1, 1 << 14):
        cuts = at[i : i + (1 << 14) + 1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), pa.array(tag[cuts[:-1]].astype(np.int64)), pa.array([key[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], ["a", "half", "keys"])


def near_entry(width: int) -> np.dtype:
    """`near`: the low 32 bits of the shingles from width - 1 before to width - 1 after c, zero outside the window."""
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("near", f"V{4 * (2 * width - 1)}")])


def _near_windows(width: int, shards: int):
    """The windows under shared keys with the shingles around c, packed by shard."""
    kind, off = near_entry(width), np.arange(1 - width, width)
    low = np.uint64((1 << 32) - 1)

    def near_of(flat: np.ndarray, doc: np.ndarray, k: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = k["c"].astype(np.int64)[:, None] + off
        inside = (off >= -k["left"].astype(np.int64)[:, None]) & (off <= k["right"].astype(np.int64)[:, None])
        near = np.where(inside, flat[np.where(inside, at + first[:, None], 0)].astype("<u4") | np.uint32(1), np.uint32(0))
        # what a text says again in the same surroundings counts once
        _, one = np.unique(mix(k["key"] ^ mix(doc)) + (near * mix(off)).sum(1, dtype=np.uint64), return_index=True)
        e, key = np.empty(len(one), kind), k["key"][one]
        e["doc"], e["near"] = doc[one], np.ascontiguousarray(near[one]).view(kind["near"])[:, 0]
        # a key with many windows: its documents are dealt to tiles, and each pair of tiles meets on its own
        shard, tiles = key >> np.uint64(32) & np.uint64(0xFFFF), key >> np.uint64(48)
        part = (mix(e["doc"]) >> np.uint64(32)) % np.maximum(tiles, 1)
        for other in range(int(tiles.max(initial=1))):
            some = np.flatnonzero(tiles > other)
            tile = np.minimum(part[some], other).astype(np.uint64) * np.uint64(0x10001) + np.maximum(part[some], other).astype(np.uint64)
            x = e[some]
            x["key"] = key[some] & low | mix(tile) >> np.uint64(32) << np.uint64(32)
            yield pack(x, (shard[some] + tile) % np.uint64(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, texts, keys, held = [], [], [], 0
            for k, (doc, t, found) in enumerate(zip(b.column("id").to_pylist(), buffers(b.column("text")), b.column("keys").to_pylist())):
                docs.append(doc)
                texts.append(t)
                keys.append(np.frombuffer(b"".join(found), KEY))
                held += len(t or b"")
                if held > CHUNK or k == b.num_rows - 1:
                    hashes = batch_shingle_hashes(texts)
                    size = np.array([len(x) for x in hashes])
                    of = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
                    flat, ks = np.concatenate(hashes), np.concatenate(keys)
                    here = np.flatnonzero(ks["c"] + ks["right"].astype(np.int64) < size[of])  # else of another text of this id, whose tag is equal in the lower half
                    d, ks, first = np.array(docs)[of[here]], ks[here], (np.cumsum(size) - size)[of[here]]
                    for i in range(0, len(ks), 1 << 14):
                        yield from near_of(flat, d[i : i + (1 << 14)], ks[i : i + (1 << 14)], first[i : i + (1 << 14)])
                    docs, texts, keys, held = [], [], [], 0

    return run


def partners(key: np.ndarray, doc: np.ndarray, near: np.ndarray, least: int, room: int = 1 << 22) -> np.ndarray:
    """Of windows sorted by key and doc: the pairs (a, b) that stand for all pairs under one key with at least `least` common shingles."""
    weight = mix(np.arange(near.shape[1]) + 1)
    _, first, kind = np.unique(mix(key) + (near * weight).sum(1, dtype=np.uint64), return_index=True, return_inverse=True)
    out = [np.stack([doc, doc[first][kind]], 1)]
    first.sort()
    key, doc, near = key[first], doc[first], near[first]
    # postings: which windows hold a shingle, and how often
    bits = np.uint64(max(len(doc) - 1, 1).bit_length())  # the row stands in the low bits of its shingles' hashes
    value = (mix(key)[:, None] + near * P[0])[near > 0] >> bits << bits | np.repeat(np.arange(len(doc), dtype=np.uint64), np.count_nonzero(near, 1))
    value.sort()
    at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.empty(0, np.int64)
    times, value = np.diff(np.append(at, len(value))), value[at]
    row, value = (value & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), value >> bits
    head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(value)))
    some = np.repeat(size, size) > 1  # shingles that no other window under the key has say nothing
    times, row, size = times[some], row[some], size[size > 1]
    # earlier windows of other documents with this shingle: they begin at `lead`
    lead = np.repeat(np.cumsum(size) - size, size)
    new = np.concatenate(([True], (lead[1:] != lead[:-1]) | (doc[row[1:]] != doc[row[:-1]])))[: len(row)]
    before = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) - lead
    able = np.bincount(row, weights=times * (before > 0), minlength=len(doc)) >= least
    post = np.flatnonzero(able[row])
    post = post[np.argsort(row[post].astype(np.uint16) if len(doc) <= 1 << 16 else row[post], kind="stable")]
    at = np.searchsorted(row[post], np.arange(len(doc) + 1))
    start = np.searchsorted(key, key, "left")  # where the windows of a key begin
    rows = np.flatnonzero(able)
    rows = rows[np.argsort((rows - start[rows]), kind="stable")]  # those with few windows before them come together

    cost = np.maximum(rows - start[rows], 1) * 64 if len(rows) else rows
    part = np.cumsum(cost) // room if len(rows) else rows
    for chunk in np.split(rows, np.flatnonzero(np.diff(part)) + 1) if len(rows) else []:
        base, wide = start[chunk], int((chunk - start[chunk]).max())
        # the windows' postings p, and the cells (window, earlier one) in which they meet
        n = at[chunk + 1] - at[chunk]
        own = np.repeat(np.arange(len(chunk)), n)
        p = post[np.repeat(at[chunk] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        k = before[p]
        end = np.cumsum(k)
        cell = row[np.repeat(lead[p] - end + k, k) + np.arange(k.sum())] + np.repeat(own * wide - base[own], k)
        weight = times[p]
        common = np.bincount(cell, weights=np.repeat(weight, k) if (weight > 1).any() else None, minlength=len(chunk) * wide).reshape(len(chunk), wide)
        common[common < least] = 0
        best = common.argmax(1)
        most = common[np.arange(len(chunk)), best]
        out.append(np.stack([doc[chunk], doc[base + best]], 1)[most > 0])
        # windows with several possible partners: how many of their shingles any of those has
        first, able = np.cumsum(n) - n, common > 0
        for j in np.flatnonzero((np.count_nonzero(able, 1) > 1) & (most < np.bincount(own, weights=weight, minlength=len(chunk)))).tolist():
            mine = slice(first[j], first[j] + n[j])
            found, ks, x = np.flatnonzero(able[j]), k[mine], cell[end[mine.start] - k[mine.start] : end[mine.stop - 1]] - j * wide
            slots = -(-len(ks) // 64) * 64
            has = np.zeros((len(found) + 1) * slots, bool)  # those that aren't possible share the last row
            has[np.where(able[j], np.cumsum(able[j]) - 1, len(found))[x] * slots + np.repeat(np.arange(len(ks)), ks)] = True
            has = has.reshape(-1, slots)[:-1]
            if weight[mine][has.any(0)[: len(ks)]].sum() == most[j]:
                continue
            # others whose common shingles are not all among another one's
            bits = np.packbits(has, 1).view(np.uint64)
            rest, chosen = np.argsort(-common[j, found], kind="stable"), []
            while len(rest):
                chosen.append(rest[0])
                rest = rest[((bits[rest] & ~bits[rest[0]]) != 0).any(1)]
            out.append(np.stack([np.full(len(chosen), doc[chunk[j]]), doc[base[j] + found[chosen]]], 1))
    pairs = np.concatenate(out)
    return pairs[pairs[:, 1] < pairs[:, 0]]


def _pairs(width: int, threshold: float):
    kind, least = near_entry(width), int(np.ceil(threshold * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in unpack(batches, kind).values():
            e = e[np.lexsort((e["doc"], e["key"]))]
            found = [np.empty((0, 2), np.int64)]
            for some in _key_runs(e["key"], 1 << 13):
                near = np.ascontiguousarray(e["near"][some]).view("<u4").reshape(some.stop - some.start, -1)
                found.append(_distinct(partners(e["key"][some], e["doc"][some], near, least)))
            rows = _distinct(np.concatenate(found))
            for i in range(0, len(rows), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + (1 << 20), 0]), pa.array(rows[i : i + (1 << 20), 1])], ["a", "b"])

    return run


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))] if len(pairs) else pairs


def _key_runs(key: np.ndarray, step: int) -> Iterator[slice]:
    """Slices of whole keys, of about `step` rows or one key."""
    head = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key)) if len(key) else np.zeros(1, np.int64)
    i = 0
    while head[i] < len(key):
        j = max(i + 1, int(np.searchsorted(head, head[i] + step, "right")) - 1)
        yield slice(head[i], head[j])
        i = j


def sums(common: np.ndarray, loss: float) -> np.ndarray:
    """The sums of all beginnings, where a common shingle counts 1 and another one -loss."""
    s = np.zeros(len(common) + 1)
    np.cumsum(np.where(common, 1.0, -loss), out=s[1:])
    return s


def densest(common: np.ndarray, loss: float, least: int) -> tuple[int, int]:
    """Of the stretches [i, j) of at least `least` shingles that begin and end with a common one that with the largest sum, where a common shingle counts 1 and
    another one -loss; (0, 0) if there is none."""
    if len(common) < least:
        return 0, 0
    if common.all():
        return 0, len(common)
    s = sums(common, loss)
    start = np.where(common[: len(common) - least + 1], s[: len(s) - least], np.inf)
    gain = np.where(common[least - 1 :], s[least:] - np.minimum.accumulate(start), -np.inf)
    j = int(np.argmax(gain))
    return (int(np.argmin(start[: j + 1])), j + least) if np.isfinite(gain[j]) else (0, 0)


def dense(common: np.ndarray, loss: float, least: int) -> bool:
    """Whether the sum of some stretch of at least `least` shingles is not negative."""
    n = int(np.count_nonzero(common))
    if len(common) < least or n * (1 + loss) < loss * least - 1e-6:  # too few for the shortest stretch
        return False
    if n >= loss * (len(common) - n):  # all of it is one
        return True
    s = sums(common, loss)
    return bool((s[least:] >= np.minimum.accumulate(s[: len(s) - least]) - 1e-9).any())


def grown(x: np.ndarray, y: np.ndarray, at: tuple[int, int, int, int], shared: np.ndarray, threshold: float, similar: Callable[[np.ndarray, np.ndarray], bool]) -> tuple[int, int]:
    """(x, y: small numbers.) The longest stretch of x around [p, q) that begins and ends with runs of common shingles and is similar to one of y around [u, v); at: p, q, u, v.

    Runs beside the stretch are looked for on y's side of [u, v), nearest to the place that they have in x. Candidates are taken by length, shorter by a sixteenth at least after each failure.
    """
    p, q, u, v = at
    s = sums(shared, threshold / (1 - threshold) if threshold < 1 else 1e3)
    edge = np.diff(np.concatenate(([False], shared, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge[:p] == 1), np.flatnonzero(edge[q + 1 :] == -1) + q + 1
    starts, ends = starts[s[starts] <= s[q:].max()], ends[s[ends] >= s[: p + 1].min()]  # too many gaps on x's side alone
    if not len(starts) + len(ends):
        return p, q
    place = np.sort(y * len(y) + np.arange(len(y)))  # the places of each shingle, one after another

    def there(t: np.ndarray, low: int, high: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x's shingles at t y has in [low, high), and where: each at the place nearest to near."""
        if not len(t) or low >= high:
            return t[:0], t[:0]
        first = x[t] * len(y)
        k = np.searchsorted(place, first + np.clip(near, low, high - 1))
        down, up = place[np.maximum(k - 1, 0)] - first, place[np.minimum(k, len(place) - 1)] - first
        below, above = (k > 0) & (down >= low), (k < len(place)) & (up < high)
        found = np.flatnonzero(below | above)
        nearer = below & (~above | (np.abs(down - near) <= np.abs(up - near)))
        return found, np.where(nearer, down, up)[found]

    i, c = there(starts, 0, u, u - p + starts)
    a, c = np.append(p, starts[i]), np.append(u, c)
    i, d = there(ends - 1, v, len(y), v - q + ends - 1)
    b, d = np.append(q, ends[i]), np.append(v, d + 1)
    total = np.concatenate(([0], np.cumsum(shared)))
    common, wide = total[b] - total[a][:, None], b - a[:, None]
    i, j = np.nonzero(common >= threshold * (wide + (d - c[:, None]) - common))
    limit = np.inf
    for k in np.argsort(-wide[i, j], kind="stable"):
        p2, q2, u2, v2 = (int(z) for z in (a[i[k]], b[j[k]], c[i[k]], d[j[k]]))
        if q2 - p2 <= q - p:
            break
        if q2 - p2 <= limit:
            if similar(x[p2:q2], y[u2:v2]):
                return p2, q2
            limit = (q2 - p2) * 15 / 16
    return p, q


def foreign(x: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` shingles of x: how many different ones it has that the other text hasn't."""
    at = np.flatnonzero(~shared)
    at = at[np.argsort(x[at], kind="stable")]
    same = x[at[1:]] == x[at[:-1]]
    before = np.concatenate(([-1], np.where(same, at[:-1], -1)))[: len(at)]  # the place before this one of the same shingle
    step = np.bincount(np.maximum(np.maximum(before, at - width) + 1, 0), minlength=len(x) + 1) - np.bincount(at + 1, minlength=len(x) + 1)
    return np.cumsum(step)[: max(len(x) - width + 1, 0)]


def stretches(shared: np.ndarray, width: int, threshold: float, known: np.ndarray) -> list[tuple[int, int]]:
    """Where passages can lie, by which shingles the other text has: where nothing is common for longer than a passage's gaps can be, no passage goes on. Those known throughout are left out."""
    common = np.flatnonzero(shared)
    cuts = np.flatnonzero(np.diff(common) > width) + 1
    open_ = [(int(c[0]), int(c[-1]) + 1) for c in np.split(common, cuts) if len(c) >= threshold * width]
    return [(i, j) for i, j in open_ if j - i >= width and not known[i:j].all() and dense(shared[i:j], threshold / (1 - threshold) if threshold < 1 else 1e3, width)]


def accepted(a: np.ndarray, b: np.ndarray, width: int, threshold: float, known: np.ndarray | None = None, table: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """The stretches [i, j) of a that are near-duplicates of stretches of b: the densest one, then those before and after it; if it fails, those of either half.

    Each part of a is held against the parts of b that have enough of its shingles, so the work goes down with the parts. What is accepted grows on both sides as far as the similarity holds.
    known: marks shingles of a that lie in accepted stretches; parts of which all are known could only yield stretches within those, so they are not searched. It is marked as stretches are found.
    table: for shingles that are small numbers, a place for each; they needn't be sorted then.
    """
    known = np.zeros(len(a), bool) if known is None else known
    share = 2 * threshold / (1 + threshold)  # of common shingles at the threshold, for sides of equal size
    # stretches that are dense on this side; if they don't make it, denser ones; at last those with the fewest gaps
    losses = (*(x / (1 - x) for x in (threshold, share) if x < 1), 1e3)
    both = np.concatenate((a, b))
    if table is None:
        _, both = np.unique(both, return_inverse=True)
    else:
        table[both] = np.arange(len(both))  # each number becomes one of its places
        both = table[both]
    a, b = both[: len(a)], both[len(a) :]

    def there(x: np.ndarray) -> np.ndarray:
        flags = np.zeros(len(both), bool)
        flags[x] = True
        return flags

    if len(b) > LONG:  # the places of b by shingle, so that the work on a part goes by its shingles, not by b
        order = np.argsort(b, kind="stable")
        first = np.searchsorted(b[order], np.arange(len(both) + 1))

    def where(x: np.ndarray) -> np.ndarray:
        """The places of b with x's shingles."""
        if len(b) <= LONG:
            return np.flatnonzero(there(x)[b])
        k = np.flatnonzero(there(x))
        n = first[k + 1] - first[k]
        return np.sort(order[np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])

    def beside(x: np.ndarray) -> Iterator[np.ndarray]:
        """The parts of b that have enough of x's shingles in twice its length, the one with most of them first."""
        pos = where(x)
        room = 2 * max(len(x), width)
        count = np.searchsorted(pos, pos + room) - np.arange(len(pos))
        while len(pos) and count.max() >= threshold * width:
            best = int(count.argmax())
            yield b[max(0, pos[best] - width) : pos[best] + room + width]
            count[np.searchsorted(pos, pos[best] - room // 2) : np.searchsorted(pos, pos[best] + room)] = 0

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        one, two = there(x), there(y)
        return bool(np.count_nonzero(one & two) >= threshold * np.count_nonzero(one | two) - 1e-9)

    def stretch(x: np.ndarray, y: np.ndarray) -> tuple[int, int, bool]:
        """The stretch of x that is a near-duplicate of one of y (0, 0 if there is none), and whether both sides are dense enough for one."""
        # a result needs a stretch on either side with the threshold's share of common shingles, and on one side with that of equal sides
        sides = there(y)[x], there(x)[y]
        if not (dense(sides[1], losses[0], width) if dense(sides[0], losses[-2], width) else dense(sides[1], losses[-2], width) and dense(sides[0], losses[0], width)):
            return 0, 0, False
        for loss in losses:
            p, q = densest(sides[0], loss, width)
            u, v = densest(there(x[p:q])[y], loss, width)
            core = np.flatnonzero(there(y[u:v])[x[p:q]])  # a passage begins and ends with words that both have
            if not len(core) or core[-1] - core[0] < width - 1:
                continue
            p, q = p + int(core[0]), p + int(core[-1]) + 1
            if similar(x[p:q], y[u:v]):
                return *grown(x, y, (p, q, u, v), sides[0], threshold, similar), True
        return 0, 0, True

    shared = there(b)[a]
    others: list[np.ndarray] = []

    def possible(i: int, j: int) -> bool:
        """Whether any stretch of a[i:j] can be similar to one of b: a union holds what is common and what either side has alone, and each side has some of that in every stretch."""
        if not others:
            others.extend((foreign(a, shared, width), foreign(b, there(a)[b], width)))
        own, other = others
        common = np.count_nonzero(there(a[i:j][shared[i:j]]))
        return len(other) > 0 and common >= threshold * (common + own[i : j - width + 1].min() + other.min()) - 1e-9

    open_ = stretches(shared, width, threshold, known)
    fresh = len(open_)  # those are known to be dense
    while open_:
        i, j = open_.pop()
        fresh, checked = min(fresh, len(open_)), len(open_) < fresh
        if j - i < width or known[i:j].all() or not (checked or dense(shared[i:j], losses[0], width)):
            continue
        x = a[i:j]
        p = int((b == x[0]).argmax()) if len(b) <= LONG else order[first[x[0]]] if shared[i] else 0
        if np.array_equal(b[p : p + len(x)], x):  # word for word
            known[i:j] = True
            yield i, j
            continue
        hope = False
        for y in beside(x):
            p, q, able = stretch(x, y)
            hope |= able
            if q:
                known[i + p : i + q] = True
                yield i + p, i + q
                open_ += [(i, i + p), (i + q, j)]
                break
        else:
            if j - i > (2 if hope else 4) * width and possible(i, j):
                open_ += [(i, (i + j + width) // 2), ((i + j - width) // 2, j)]


def places(first: dict[str, np.ndarray], second: dict[str, np.ndarray], width: int, agree: int) -> list[tuple[int, int, int, int]]:
    """Interval join of two texts' windows: joined by hash, then gathered where they overlap by `width` on both sides, if `agree` functions do."""
    if "order" not in second:
        # a text may say a thing many times: of places with equal hash and contents the earlier document's first stands for all
        both = second["key"] * P[0] + second["around"]
        order = np.argsort(both)
        head = np.flatnonzero(np.concatenate(([True], np.diff(both[order]) != 0))) if len(order) else order
        order = np.minimum.reduceat(order, head) if len(order) else order  # the windows of a function come in the order of c
        second["order"] = order[np.argsort(second["key"][order])]
    order = second["order"]
    key = second["key"][order]
    lo, hi = np.searchsorted(key, first["key"], "left"), np.searchsorted(key, first["key"], "right")
    n = hi - lo
    i = np.repeat(np.arange(len(n)), n)
    j = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(i))]
    l, r, u, v, f = first["l"][i], first["r"][i], second["l"][j], second["r"][j], 1 << first["f"][i]

    def runs(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(low[rows])]
        cuts = np.flatnonzero(low[rows[1:]] > np.maximum.accumulate(high[rows[:-1]]) - width + 1) + 1
        return np.split(rows, cuts) if len(cuts) else [rows]

    found = []
    for part in runs(np.arange(len(i)), l, r) if len(i) else []:
        for piece in runs(part, u, v):
            if int(np.bitwise_or.reduce(f[piece])).bit_count() >= agree:
                found.append((int(l[piece].min()), int(r[piece].max()), int(u[piece].min()), int(v[piece].max())))
    return found


def passages(texts: list[np.ndarray], pairs: list[tuple[int, int]], width: int, agree: int, threshold: float, known: dict[int, np.ndarray] | None = None) -> list[np.ndarray]:
    """For each pair (a, b) of texts near-duplicate stretches [i, j) of a; together those of one a cover what all its partners have. known: see accepted(), by a."""
    known = {} if known is None else known
    for a, _ in pairs:
        known.setdefault(a, np.zeros(len(texts[a]), bool))
    # texts as numbers of their shingles, so that a table of flags says what a text or part has
    number = np.split(np.unique(np.concatenate(texts), return_inverse=True)[1], np.cumsum([len(x) for x in texts])[:-1])
    flags, table = np.zeros(sum(map(len, texts)) + 1, bool), np.empty(sum(map(len, texts)) + 1, np.int64)

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        flags[y] = True
        got = flags[x]
        flags[y] = False
        return got

    def open_(k: int) -> bool:
        a, b = pairs[k]
        return bool(stretches(shared(number[a], number[b]), width, threshold, known[a]))

    # of one text's partners the one that has most of it comes first, so that it leaves the others less to do
    most = np.array([np.count_nonzero(shared(number[a], number[b])) for a, b in pairs])
    order = np.argsort(-most, kind="stable").tolist()
    head = {pairs[k][0]: k for k in reversed(order)}
    out: list[np.ndarray] = [np.empty((0, 2), np.int64)] * len(pairs)
    of: dict[int, dict[str, np.ndarray]] = {}
    for some in ([k for k in order if head[pairs[k][0]] == k], [k for k in order if head[pairs[k][0]] != k]):
        some = [k for k in some if open_(k)]
        seen = {k: np.count_nonzero(known[pairs[k][0]]) for k in some}
        new = sorted({t for k in some for t in pairs[k]} - of.keys())
        if new:
            w = windows([texts[t] for t in new], width)
            w["key"], w["around"] = mix(w["v"] + w["f"].astype(np.uint64)), contents([texts[t] for t in new], w, width)
            by_text = np.argsort(w["text"], kind="stable")
            w = {n: v[by_text] for n, v in w.items()}
            at = np.searchsorted(w["text"], np.arange(len(new) + 1))
            of |= {t: {n: v[at[i] : at[i + 1]] for n, v in w.items()} for i, t in enumerate(new)}
        for k in some:
            a, b = pairs[k]
            if np.count_nonzero(known[a]) > seen[k] and not open_(k):
                continue
            got = set()
            for la, ra, lb, rb in places(of[a], of[b], width, agree):
                if stretches(shared(number[a][la : ra + 1], number[b][lb : rb + 1]), width, threshold, known[a][la : ra + 1]):
                    got |= {(la + i, la + j) for i, j in accepted(number[a][la : ra + 1], number[b][lb : rb + 1], width, threshold, known[a][la : ra + 1], table)}
            out[k] = np.array(sorted(got), np.int64).reshape(-1, 2)
    return out


def _verify(width: int, agree: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple, np.ndarray] = {}  # what is known of the last text, whose partners may go on in the next chunk
        for b in batches:
            texts, docs, pairs, at, held = [], [], [], {}, 0
            for k, (doc, tag, other, s, t) in enumerate(zip(b.column("a").to_pylist(), b.column("tag").to_pylist(), b.column("b").to_pylist(), buffers(b.column("text_a")), buffers(b.column("text_b")))):
                for name, text in (((doc, s), s), ((other, t), t)):
                    if name not in at:  # each text's windows are made once for all of its pairs here
                        at[name] = len(texts)
                        texts.append(text)
                        held += len(text or b"")
                docs.append((doc, tag))
                pairs.append((at[doc, s], at[other, t]))
                if held > CHUNK or k == b.num_rows - 1:
                    known = {at[name]: x for name, x in last.items() if name in at}
                    found = [(d, (x + [0, GRAM - 1]).astype("<u4").tobytes()) for d, x in zip(docs, passages(batch_shingle_hashes(texts), pairs, width, agree, threshold, known)) if len(x)]
                    yield pa.RecordBatch.from_arrays([pa.array([d for (d, _), _ in found], pa.int64()), pa.array([g for (_, g), _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["id", "tag", "spans"])
                    last = {(doc, s): known[at[doc, s]]}
                    texts, docs, pairs, at, held = [], [], [], {}, 0

    return run


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CUT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def cut(text: bytes, spans: np.ndarray) -> tuple[int, list[dict], bytes]:
    """The number of words, the removed spans in characters, and what is left."""
    at = [m.span() for m in WORD.finditer(text)]
    chars = np.cumsum(np.concatenate(([0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    left, end, out = [], 0, []
    for i, j in spans.tolist():
        x, y = at[i][0], at[j - 1][1]
        left.append(text[end:x])
        end = y
        out.append({"start": int(chars[x]), "end": int(chars[y])})
    return len(at), out, b"".join([*left, text[end:]])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = {f.name: [] for f in CUT}
        for t, whole, spans in zip(buffers(b.column("text")), b.column("copy").to_pylist(), b.column("spans").to_pylist()):
            n = len(t.split()) if t else 0
            s = np.array([[0, n]]) if whole else united(spans) if spans else np.empty((0, 2), np.int64)
            s = s[s[:, 1] <= n]
            n, removed, kept = cut(t, s) if len(s) else (n, [], t)
            for k, v in (("n_words", n), ("n_removed", int((s[:, 1] - s[:, 0]).sum())), ("spans", removed), ("kept", kept.decode() if kept is not None else None)):
                col[k].append(v)
        yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(col[f.name], f.type) for f in CUT]], ["row", *CUT.names])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits that stand for a text's words, and their number."""
    import xxhash

    for b in batches:
        words = [(t or b"").lower().split() for t in buffers(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tag"), pa.array([xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words]), pa.array([len(w) for w in words], pa.int64())], ["id", "tag", "name", "n"])


def cut_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", least_words: int = 50, agree: int = 3, threshold: float = 0.75, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """All columns of docs (the text cut) and n_words, n_removed (words) and removed_spans (start, end in characters of the whole text)."""
    spark, width = docs.sparkSession, least_words - GRAM + 1
    functions = FUNCTIONS - agree + 1  # at least `agree` of all functions agree on a passage, so one of these does
    small_batches(spark)
    marked = tagged(docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"), F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")))
    rows = marked.select("id", "tag", "text")
    names = written(rows.filter("id is not null").mapInArrow(_names, "id bigint, tag bigint, name string, n bigint")).filter(F.col("n") >= least_words)
    first = names.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    copies = written(names.join(first, "name").filter("id > first").select("id", "tag").distinct())
    copies = small(copies, 24)
    told = rows.filter("id is not null").join(copies, ["id", "tag"], "left_anti")
    shards = partitions(spark)
    met = written(dealt(told.mapInArrow(_windows(width, shards, functions), PACKED), shards).mapInArrow(_shared, "a bigint, half bigint, keys binary"))
    keys = met.groupBy(F.col("a").alias("id"), "half").agg(F.collect_list("keys").alias("keys"))
    near = told.withColumn("half", F.col("tag").bitwiseAND(0xFFFFFFFF)).join(keys, ["id", "half"]).mapInArrow(_near_windows(width, shards), PACKED)
    pairs = written(dealt(near, shards).mapInArrow(_pairs(width, threshold), "a bigint, b bigint").distinct())
    wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    near = told.join(small(wanted), "id", "left_semi")
    # the texts are small next to the work on them: more tasks than their size asks for
    # rows of one id with several texts give a pair each
    both = pairs.join(near.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").repartition(4 * shards, "a")
    both = both.join(near.select(F.col("id").alias("a"), "tag", F.col("text").alias("text_a")), "a")
    both = both.select("a", "tag", "b", "text_a", "text_b").sortWithinPartitions("a", "tag", "b")
    found = written(both.mapInArrow(_verify(width, agree, threshold), "id bigint, tag bigint, spans binary"))
    spans = found.groupBy("id", "tag").agg(F.collect_list("spans").alias("spans"))
    size = found.agg(F.coalesce(F.sum(F.octet_length("spans") + 24), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if size <= broadcast_bytes else spans
    marked = marked.join(copies.withColumn("copy", F.lit(True)), ["id", "tag"], "left").join(spans, ["id", "tag"], "left").select("row", "text", "copy", "spans")
    kinds = f"row {marked.schema['row'].dataType.simpleString()}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
    done = marked.mapInArrow(_apply, kinds)
    return done.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns], "n_words", "n_removed", F.col("spans").alias("removed_spans"))
