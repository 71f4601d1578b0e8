"""Spelling variants: words one inserted, deleted or replaced letter apart, by k-d trees over letter counts.

One edit moves the letter counts of a word by at most two (a replaced letter) or by one (an inserted or deleted letter) in L1 distance. A word's counts are kept as a thermometer:
32 groups of letters (a to z, and six for the others), four bits each, the first c of them set for a count of c (more than four count as four). L1 distances become
numbers of differing bits, which never exceed the true distance, and a box of counts becomes its lowest and highest thermometer.

Words meet by pairs of lengths: a word of length L is searched in the trees of the lengths L and L + 1. The upper levels of a length's tree are built on the driver from a
bounded sample of its words and split them into cells; a word goes home to its cell and visits the cells whose box is near enough (those of its own length only
if they come later, so that a pair meets once). Cells that stay too large, since their words have the same letters, are dealt in tiles, each of which is visited. In a task, the cell's words
form the lower levels of the tree; searches drop boxes that are too far off, compare the counts of the words in the leaves, then verify the order of letters.
A task returns one row per word with its number of near words and the best of them, never the pairs.

Defined results: null and empty texts have no words; rows that repeat count as often as they occur; a null id reads as an empty one in the hash. Words of equal
counts and more than one near word of the same n go by code-point order. An empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small, written

GROUPS, STEPS, LEAF, CHUNK, MOST_PAIRS = 32, 4, 16, 1024, 1 << 21
#: Letters are single bytes of Latin-1: a to z have groups of their own, the others share six.
GROUP_OF = np.array([b - 97 if 97 <= b < 123 else 26 + b % 6 for b in range(256)])


def _mask(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def thermometers(letters: np.ndarray) -> np.ndarray:
    """letters: a row of Latin-1 bytes per word, all of one length. Two 64-bit numbers per word."""
    counts, at = np.zeros((len(letters), GROUPS), np.int32), np.arange(len(letters))
    for column in GROUP_OF[letters.T]:
        counts[at, column] += 1
    return _mask((counts[:, :, None] > np.arange(STEPS)).reshape(len(letters), GROUPS * STEPS))


def bits_of(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes.view(np.uint8), axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def outside(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far counts lie outside boxes."""
    return np.bitwise_count((codes & ~high) | (low & ~codes)).sum(-1, dtype=np.int64)


def balanced_bit(bits: np.ndarray) -> tuple[int, int]:
    """The count comparison (a bit) that splits the words most evenly, and how many fall on the smaller side."""
    ones = bits.sum(0, dtype=np.int64)
    side = np.minimum(ones, len(bits) - ones)
    return int(side.argmax()), int(side.max())


class Cells:
    """The upper levels of one length's tree: boxes that do not overlap and cover everything; word to cell by the box that holds it."""

    def __init__(self, sample: np.ndarray, cells: int, least: int = 32):
        whole = np.zeros(GROUPS * STEPS, np.uint8)
        todo, done = [(sample, whole, 1 - whole)], []
        while todo:
            todo.sort(key=lambda x: len(x[0]))
            words, low, high = todo.pop()
            bit, side = balanced_bit(bits_of(words)) if len(words) else (0, 0)
            if len(todo) + len(done) + 1 >= cells or side * 2 < least:
                done.append((low, high))
                continue
            group, step = divmod(bit, STEPS)
            more, fewer = low.copy(), high.copy()
            more[group * STEPS : group * STEPS + step + 1] = 1
            fewer[group * STEPS + step : (group + 1) * STEPS] = 0
            on = bits_of(words)[:, bit] == 1
            todo += [(words[on], more, high), (words[~on], low, fewer)]
        self.low, self.high = (_mask(np.array([d[k] for d in done])) for k in (0, 1))

    def far(self, codes: np.ndarray) -> np.ndarray:
        """Distance of each word from each cell."""
        return outside(codes[:, None], self.low, self.high)


ONE = Cells(np.zeros((0, 2), np.uint64), 1)


class Tree:
    """The lower levels: nodes with tight boxes, leaves of about LEAF words."""

    def __init__(self, codes: np.ndarray):
        self.codes, bits = codes, bits_of(codes)
        self.order = np.arange(len(codes))
        low, high, first, begin, end = [], [], [], [], []
        todo = [(0, len(codes))]
        for lo, hi in todo:  # grows meanwhile
            some = self.order[lo:hi]
            low.append(np.bitwise_and.reduce(codes[some], axis=0))
            high.append(np.bitwise_or.reduce(codes[some], axis=0))
            begin.append(lo)
            end.append(hi)
            bit, side = balanced_bit(bits[some]) if hi - lo > LEAF else (0, 0)
            if not side:
                first.append(-1)
                continue
            on = bits[some, bit] == 1
            self.order[lo:hi] = np.concatenate([some[on], some[~on]])
            first.append(len(todo))
            todo += [(lo, lo + int(on.sum())), (lo + int(on.sum()), hi)]
        self.low, self.high, self.first, self.begin, self.end = np.array(low), np.array(high), np.array(first), np.array(begin), np.array(end)

    def near(self, codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) whose counts are at most `most` apart, in parts of bounded size."""
        for at in range(0, len(codes), CHUNK):
            q = np.arange(at, min(at + CHUNK, len(codes)))
            node, leaves = np.zeros(len(q), np.int64), []
            while len(q):
                ok = outside(codes[q], self.low[node], self.high[node]) <= most
                q, node = q[ok], node[ok]
                inner = self.first[node] >= 0
                leaves.append((q[~inner], node[~inner]))
                q, node = np.repeat(q[inner], 2), (self.first[node[inner]][:, None] + [0, 1]).ravel()
            q, node = (np.concatenate(x) for x in zip(*leaves))
            size = self.end[node] - self.begin[node]
            part = np.cumsum(size) // MOST_PAIRS
            for cut in np.split(np.arange(len(q)), np.flatnonzero(np.diff(part)) + 1):
                n = size[cut]
                left = np.repeat(q[cut], n)
                right = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[node[cut]], n)]
                ok = differing(codes[left], self.codes[right]) <= most
                yield left[ok], right[ok]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a's words are one letter shorter than b's."""
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def verified(test, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = max(1, (MOST_PAIRS << 3) // max(1, right.shape[1]))
    ok = [test(left[i[k : k + step]], right[j[k : k + step]]) for k in range(0, len(i), step)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


# ---- counting ----


def varied_words(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """word, n: letter runs of at least least_length code points, A-Z lower-cased, found at least least_n times. Of each run whose hash with its document's id `every` divides,
    one letter is left out first."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), 1)
    runs = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    gap = (h % F.length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(F.col("run").substr(F.lit(1), gap), F.col("run").substr(gap + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


# ---- meeting ----

SENT = "length int, cell int, tile int, part int, kind int, letters binary, ns binary"
FOUND = "word string, n_near bigint, best struct<less:bigint,word:string>"
HOME, SAME, SHORTER = 0, 1, 2


def _by_length(words: list[str], ns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Letters and counts of the words of each length."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    start = np.cumsum(size) - size
    for length in np.unique(size):
        some = np.flatnonzero(size == length)
        yield int(length), flat[start[some][:, None] + np.arange(length)], ns[some]


def _tile(letters: np.ndarray, tiles: int) -> np.ndarray:
    h = np.zeros(len(letters), np.uint64)
    for column in letters.T:
        h = (h ^ column) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(tiles)).astype(np.int64)


def _send(trees: dict[int, Cells], tiles: dict[tuple[int, int], int], parts: dict[int, int]):
    """Words to their home and to the cells they visit."""

    def rows(length: int, letters: np.ndarray, ns: np.ndarray) -> Iterator[tuple]:
        codes, tree = thermometers(letters), trees.get(length, ONE)
        far = tree.far(codes)
        home = (far == 0).argmax(1)
        for cell in range(far.shape[1]):
            some = np.flatnonzero(home == cell)
            many = tiles.get((length, cell), 1)
            at = _tile(letters[some], many)
            share = _tile(letters[some][:, ::-1], parts.get(length, 1))
            for tile in range(many):
                here = some[at == tile]
                for part in range(parts.get(length, 1)):
                    yield length, cell, tile, part, HOME, here
                    yield length, cell, tile, part, SAME, some[(at < tile) & (share == part)]
            some = np.flatnonzero((home < cell) & (far[:, cell] <= 2))
            share = _tile(letters[some][:, ::-1], parts.get(length, 1))
            for tile in range(many):
                for part in range(parts.get(length, 1)):
                    yield length, cell, tile, part, SAME, some[share == part]
        far = trees.get(length + 1, ONE).far(codes)
        for cell in range(far.shape[1]):
            some = np.flatnonzero(far[:, cell] <= 1)
            share = _tile(letters[some][:, ::-1], parts.get(length + 1, 1))
            for tile in range(tiles.get((length + 1, cell), 1)):
                for part in range(parts.get(length + 1, 1)):
                    yield length + 1, cell, tile, part, SHORTER, some[share == part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for length, letters, ns in _by_length(b.column("word").to_pylist(), b.column("n").to_numpy(zero_copy_only=False)):
                out += [(*place, letters[some].tobytes(), ns[some].tobytes()) for *place, some in rows(length, letters, ns) if len(some)]
            if out:
                kinds = [pa.int32()] * 5 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)], [x.split()[0] for x in SENT.split(", ")])

    return run


def _ranks(letters: list[np.ndarray]) -> list[np.ndarray]:
    """Places of all words in code-point order."""
    flat = np.concatenate([x.view(f"S{x.shape[1]}").ravel() if len(x) else np.zeros(0, "S1") for x in letters])
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(flat, kind="stable")] = np.arange(len(flat))
    return np.split(rank, np.cumsum([len(x) for x in letters])[:-1])


def meet(key: tuple, sent: pa.Table) -> pa.Table:
    """Near words within a cell's tile and between it and its visitors: one row per word that has any."""
    length, part = key[0].as_py(), key[3].as_py()
    letters, ns = [], []
    for kind in (HOME, SAME, SHORTER):
        rows, wide = sent.filter(pa.compute.equal(sent.column("kind"), kind)), length - (kind == SHORTER)
        letters.append(np.frombuffer(b"".join(rows.column("letters").to_pylist()), np.uint8).reshape(-1, max(1, wide)))
        ns.append(np.frombuffer(b"".join(rows.column("ns").to_pylist()), np.int64))
    base = np.cumsum([0, *map(len, ns)])
    left, right = [], []
    if len(ns[HOME]):
        codes = [thermometers(x) for x in letters]
        tree = Tree(codes[HOME])
        for kind, most in ((HOME, 2), (SAME, 2), (SHORTER, 1)):
            if kind == HOME and part:
                continue
            for i, j in tree.near(codes[kind], most):
                if kind == HOME:
                    i, j = i[i < j], j[i < j]
                i, j = verified(one_inserted if kind == SHORTER else one_replaced, letters[kind], letters[HOME], i, j)
                left.append(base[kind] + i)
                right.append(j)
    if not left or not sum(map(len, left)):
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best": pa.array([], pa.struct([("less", pa.int64()), ("word", pa.string())]))})
    a, b = (np.concatenate(x) for x in ([*left, *right], [*right, *left]))
    n, rank = np.concatenate(ns), np.concatenate(_ranks(letters))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0]))
    spelled = lambda at: [letters[k][x - base[k]].tobytes().decode("latin-1") for x, k in zip(at, np.searchsorted(base, at, side="right") - 1)]
    best = pa.StructArray.from_arrays([pa.array(-n[b[first]]), pa.array(spelled(b[first]), pa.string())], ["less", "word"])
    return pa.table({"word": pa.array(spelled(a[first]), pa.string()), "n_near": np.diff([*first, len(a)]), "best": best})


def near_words(words: DataFrame, cell: int = 16384, sample: int = 50_000) -> DataFrame:
    """word, n_near, best (less: minus its n, word) of the words (word, n; a written table) that have near words. At most `sample` words and one row per length with more than
    `cell` words, and per cell with more than twice as many, reach the driver."""
    size = F.length("word").alias("length")
    large = {r["length"]: r["n"] for r in words.groupBy(size).agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    trees, tiles, parts = {}, {}, {}
    if large:
        some = words.filter(F.length("word").isin(list(large)))
        rate = min(1.0, sample / 2 / sum(large.values()))
        picked = some.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("word").orderBy(F.xxhash64("word"), "word").limit(sample).toPandas()["word"].tolist()
        codes = {length: thermometers(letters) for length, letters, _ in _by_length(picked, np.zeros(len(picked), np.int64))}
        trees = {k: Cells(codes.get(k, np.zeros((0, 2), np.uint64)), 1 << (-(-n // cell) - 1).bit_length()) for k, n in large.items()}
        parts = {k: 1 + len(t.low).bit_length() ** 2 // 32 for k, t in trees.items()}

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for length, letters, _ in _by_length(b.column("word").to_pylist(), np.zeros(b.num_rows)):
                    cells, n = np.unique((trees[length].far(thermometers(letters)) == 0).argmax(1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([length] * len(cells), pa.int32()), pa.array(cells, pa.int32()), pa.array(n)], ["length", "cell", "n"])

        full = some.select("word").mapInArrow(homes, "length int, cell int, n bigint").groupBy("length", "cell").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * cell)
        tiles = {(r["length"], r["cell"]): -(-r["n"] // cell) for r in full.collect()}
    sent = words.select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(_send(trees, tiles, parts), SENT)
    return sent.groupBy("length", "cell", "tile", "part").applyInArrow(meet, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(words: DataFrame, ratio: int = 10, rounds: int = 64, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n). The form is the near word of largest n, if that is at least `ratio` (above 1) times the word's own.
    Forms grow by that ratio, so chains are short; their ends are found by doubling."""
    words = written(words)
    found = words.join(near_words(words, **sizes), "word", "left")
    form_n = -F.col("best.less")
    formed = F.coalesce(form_n >= ratio * F.col("n"), F.lit(False))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, form_n).alias("form_n")))
    links = written(found.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = small(links.select(F.col("word").alias("root"), F.col("root").alias("next")), 64)
        nexts = written(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = nexts.select("word", "root")
        if nexts.filter("moved").isEmpty():
            break
    out = found.join(small(links, 64), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
