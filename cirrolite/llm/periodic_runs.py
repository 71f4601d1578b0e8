"""Periodic runs of words, by string synchronising sets.

A run is a maximal stretch of words in which words q apart are identical, q its smallest period, of at least four periods. Texts of an Arrow batch are laid
one behind the other as word numbers, with a number of its own between two texts, so that nothing crosses them and numpy works on all of them at once.

Periods below SMALL are found directly: stretches where a word equals the one q further on. Longer periods go by scales tau = SMALL, 2 SMALL, ...; each
finds the periods in [tau, 2 tau):

* A position has an identity, the hash of its tau words, unless it lies in a run of period at most tau / 4 that covers these words: such positions have none.
* A position is selected if its identity is the smallest of some tau neighbouring positions. Selection depends on the words around it alone, so a run of
  period q >= tau selects the same positions in each period, and selects some: tau neighbours without identity would be one stretch of period tau / 4 at most,
  which by Fine and Wilf's theorem cannot be as long as that without being the run's period.
* Of the selected positions with the same 2 tau > q words, neighbouring ones that are q in [tau, 2 tau) apart propose the period q. Within a run such contexts
  recur after exactly q words, since the period is primitive.
* Proposals that overlap are joined, extended and checked word by word. A multiple of a run's period, proposed at its border, covers the same stretch as the run and goes.

What small scales found is what large scales leave out, so the selected positions stay about n / tau. Texts shorter than 4 tau take no part in a scale.

Defined results: a null or empty text, or one of blanks alone, has no words and no runs; its collapsed text is empty. Rows are judged one by one: repeated rows, repeated
or null ids and equal texts get equal results. A text is held in memory as a whole, at about 100 bytes a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix, small_batches

SMALL = 4
PAIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def joined_names(names: np.ndarray, half: int) -> np.ndarray:
    """Names of 2 * half words each, from the names of half words."""
    n = len(names) - half
    return mix(names[:n] * PAIR[0] + mix(names[half : half + n] + PAIR[1]))


def sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each `size` neighbours of x, by block-wise running minima from both sides."""
    pick, rest = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x) - size + 1
    whole = np.full(-(-len(x) // size) * size, rest, np.uint64)
    whole[: len(x)] = x
    blocks = whole.reshape(-1, size)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[size - 1 : size - 1 + n])


def selected(identity: np.ndarray, tau: int) -> np.ndarray:
    """Positions whose identity is the smallest of some tau neighbouring positions; the greatest number stands for no identity."""
    none = np.uint64(2**64 - 1)
    if len(identity) < tau:
        return np.zeros(0, np.int64)
    lows = sliding(identity, tau, least=True)
    padded = np.concatenate([np.zeros(tau - 1, np.uint64), lows, np.zeros(tau - 1, np.uint64)])
    return np.flatnonzero((sliding(padded, tau, least=False) == identity) & (identity != none))


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def extended(words: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, block: int) -> np.ndarray:
    """How far from `at` on, in direction step (1 or -1), words equal those a period later. Ends of `words` match nothing."""
    length, live, span = np.zeros(len(at), np.int64), np.arange(len(at)), np.arange(block)
    while len(live):
        place = at[live, None] + step * (length[live, None] + span)
        inside = (place >= 0) & (place + period[live, None] < len(words))
        place = np.where(inside, place, 0)
        same = inside & (words[place] == words[np.minimum(place + period[live, None], len(words) - 1)])
        run = np.where(same.all(1), block, same.argmin(1))
        length[live] += run
        live = live[run == block]
    return length


def proposals(words: np.ndarray, names: np.ndarray, longer: np.ndarray, tau: int, found: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) with periods in [tau, 2 tau). names, longer: names of tau and of 2 tau words. found: the runs of smaller periods."""
    identity = np.minimum(names, np.uint64(2**64 - 2))
    low = found[(found[:, 2] * 4 <= tau) & (found[:, 1] - found[:, 0] >= tau)]
    if len(low):
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, low[:, 0], 1)
        np.add.at(cover, low[:, 1] - tau + 1, -1)
        identity[np.cumsum(cover)[: len(identity)] > 0] = np.uint64(2**64 - 1)
    at = selected(identity, tau)
    at = at[at < len(longer)]
    context = longer[at]
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    gap = np.diff(at)
    hit = np.flatnonzero((np.diff(context) == 0) & (gap >= tau) & (gap < 2 * tau))
    at, period = at[hit], gap[hit]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(period) != 0) | (np.diff(at) > 2 * tau)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    low, high, period = at[first], at[last] + 2 * tau, period[first]
    high = high + extended(words, high, period, 1, 2 * tau)
    low = low - extended(words, low - 1, period, -1, 2 * tau)
    keep = high - low >= 3 * period
    rows = np.unique(np.stack([low[keep], high[keep] + period[keep], period[keep]], 1), axis=0)
    # hashes proposed them; words decide
    return np.array([r for r in rows.tolist() if np.array_equal(words[r[0] : r[1] - r[2]], words[r[0] + r[2] : r[1]])], np.int64).reshape(-1, 3)


def runs_of(words: np.ndarray, most: int) -> np.ndarray:
    """(start, end, smallest period) of all stretches of at least four periods; most: the length of the longest text in words."""
    found = []
    for q in range(1, SMALL):
        low, high = stretches(words[:-q] == words[q:]) if len(words) > q else (np.zeros(0, np.int64),) * 2
        keep = high - low >= 3 * q
        found.append(np.stack([low[keep], high[keep] + q, np.full(keep.sum(), q)], 1))
    found = np.concatenate(found)
    tau, names = 1, mix(words.astype(np.uint64))
    while 4 * tau <= most and len(names) > tau:
        longer = joined_names(names, tau)
        if tau >= SMALL:
            found = np.concatenate([found, proposals(words, names, longer, tau, found)])
        tau, names = 2 * tau, longer
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    first = np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(1)]) if len(found) else np.zeros(0, bool)
    return found[first]


def runs_of_texts(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """Rows (start, length, period) by start, then period, of each text given as words."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    size = np.array([len(t) for t in texts], np.int64)
    number = defaultdict(count().__next__)
    coded = {k: np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for k, t in enumerate(texts) if len(t) >= least}
    # texts of about the same length go together: large scales skip the short ones
    by: dict[int, list[int]] = defaultdict(list)
    for k in coded:
        by[int(size[k]).bit_length()].append(k)
    for some in by.values():
        parts, start, at = [], [], 0
        for k in some:
            start.append(at)
            parts += [coded[k], np.array([-1 - k])]
            at += int(size[k]) + 1
        found = runs_of(np.concatenate(parts), int(size[some].max()))
        found = found[found[:, 1] - found[:, 0] >= np.maximum(least, 4 * found[:, 2])]
        home = np.searchsorted(start, found[:, 0], side="right") - 1
        rows = np.stack([found[:, 0] - np.array(start)[home], found[:, 1] - found[:, 0], found[:, 2]], 1)
        rows, home = (x[np.lexsort((rows[:, 2], rows[:, 0], home))] for x in (rows, home))
        for k, r in zip(some, np.split(rows, np.searchsorted(home, np.arange(1, len(some))))):
            out[k] = r
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)])


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 6) -> DataFrame:
    """Per row of docs: the id, n_words, runs (start, length and period in words, by start, then period; at least `least` words and four periods long) and the
    collapsed text, which keeps of each run the first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or b"").split() for t in buffers(b.column("text"))]
            found = runs_of_texts(texts, least)
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"]))
            kept = pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(t) for t in texts], pa.int64()), runs.cast(RUN), kept], ["id", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("id", id)
