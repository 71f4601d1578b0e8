"""Packing tokenised texts into fixed-length sequences by vector bin packing.

A piece has a vector of sizes (tokens, segments, loss-bearing tokens) and a sequence a limit on each. Sequences are filled one at a
time: of the pieces that still fit under all limits, the one whose sizes have the largest dot product with the room left goes in, each dimension
weighted by its share of the demand. Pieces are dealt into groups of about `group_rows` by a hash, so any number of pieces packs in bounded
memory and a sequence never spans groups; only lengths and checksums travel, unless the ids are asked for.

Defined results: a null or empty text is its end-of-text id alone; texts longer than a sequence are cut at every `capacity` ids;
rows that repeat are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, small_batches, written

CACHE_WORDS = 1_200_000
TEXT_CHARS = 1 << 23
#: White space to Python alone; marks of special tokens; letters whose lower case depends on their place or is two characters.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|", "\u03a3", "\u0130")

SPACE, STOP, PLAIN = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", b",.", b"abcdefghijklmnopqrstuvwxyz0123456789"))


class WordTokens:
    """Token ids of whole texts as little-endian 32-bit bytes. The words of several texts are numbered in one go, and only different ones are looked up, in a cache.

    Right for tokenizers that drop white space, never join tokens across it and end each word's last token with `</w>`; texts in which
    that may not hold (control characters that only Python calls white space, special tokens' marks) go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        """cache: a word's row; its ids are ids[at[row] : at[row + 1]]."""
        self.cache: dict[str, int] = {}
        self.ids, self.at = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> dict[str, bytes]:
        made = {}
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            count = [1 if w.isascii() and w.isalpha() else len(self.parts.findall(w.lower())) for w in some]
            ids = np.frombuffer(self.whole([" ".join(some)])[0], "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == sum(count) and min(count) > 0:
                at = (np.concatenate(([0], cuts))[np.concatenate(([0], np.cumsum(count)))] * 4).tolist()
                raw = ids.tobytes()
                made.update(zip(some, [raw[a:b] for a, b in zip(at, at[1:])]))
            else:
                made.update(zip(some, self.whole(some)))
        return made

    def rows(self, words: list[str]) -> np.ndarray:
        """Where the ids of different words are kept; those of new words are made."""
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        rows = [self.cache.get(w, -1) for w in words]
        if new := [w for w, k in zip(words, rows) if k < 0]:
            made = self.encode(new)
            ids = [made[w] for w in new]
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(x) // 4 for x in ids])))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), "<u4")))
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
            rows = [self.cache[w] if k < 0 else k for w, k in zip(words, rows)]
        return np.array(rows, np.int64)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, some, data = [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            if any(x in t for x in ODD):
                out[i] = self.whole([t])[0]
            elif t:
                some.append(i)
                data.append((t.lower() if t.isascii() or unicodedata.is_normalized("NFC", t) else t).encode())
        raw = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
        blank = SPACE[raw]
        edge = np.flatnonzero(np.diff(blank)) + 1
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return out
        # a comma or stop at the end, behind a letter or digit, shares no token with them: it is a word of its own, which saves most forms of words
        tail = STOP[raw[end - 1]] & PLAIN[raw[end - 2]] & (end - start > 1)
        last = np.cumsum(1 + tail) - 1
        size = np.repeat(end - start, 1 + tail)
        size[last[tail]] = 1
        size[last[tail] - 1] -= 1
        bounds = np.concatenate(([0], np.cumsum(size)))
        coded = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(raw[~blank])).dictionary_encode()
        row = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = self.at[row + 1] - self.at[row]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[row] - ends + n, n) + np.arange(ends[-1])]
        # the first word of each text, then its first id
        word = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(x) + 1 for x in data]))))
        at = np.concatenate(([0], ends))[np.concatenate(([0], last + 1))[word]].tolist()
        for i, x, y in zip(some, at, at[1:]):
            out[i] = ids[x:y].tobytes()
        return out


_tokens: dict[str, WordTokens] = {}


def tokenised(tokens: WordTokens, b: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """Each row's id and token ids; about TEXT_CHARS of text are taken together."""
    some, chars = [], 0
    for i, t in zip(b.column("id").to_pylist(), b.column("text")):
        some.append((i, t.as_py() or ""))
        chars += len(some[-1][1])
        if chars > TEXT_CHARS:
            yield from zip((i for i, _ in some), tokens([t for _, t in some]))
            some, chars = [], 0
    yield from zip((i for i, _ in some), tokens([t for _, t in some]))


def token_pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of each row's ids (those of the text, then end_id): the id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokens:
            _tokens[tokenizer] = WordTokens(tokenizer)
        tokens, last = _tokens[tokenizer], np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows, held = [], 0
            for i, ids in tokenised(tokens, b):
                ids += last
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    rows.append((i, s, len(piece) // 4, zlib.crc32(piece), n) + ((np.frombuffer(piece, "<i4"),) if with_ids else ()))
                held += len(ids)
                if with_ids and held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    kinds = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, kinds).withColumnRenamed("id", id)


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sizes its bin and its order within the bin. No row exceeds the limits alone."""
    kinds, kind, count = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kind = kind.reshape(-1)
    rows = np.argsort(kind, kind="stable")  # the rows of each kind, in order
    nxt = np.concatenate(([0], np.cumsum(count)))
    stop, nxt = nxt[1:].copy(), nxt[:-1].copy()
    share = kinds / limits
    weight = (share * count[:, None]).sum(0)
    gain = (share * (weight / max(weight.sum(), 1e-12)) / limits).T.copy()
    size = kinds.T.astype(np.float64).copy()
    bins, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    live, b = np.arange(len(kinds)), 0
    while len(live):
        room, n = limits.astype(np.float64), 0
        c, g = size, gain
        while True:
            score = np.where((c[0] <= room[0]) & (c[1] <= room[1]) & (c[2] <= room[2]), g[0] * room[0] + g[1] * room[1] + g[2] * room[2], -1.0)
            p = int(score.argmax()) if len(score) else 0
            if not len(score) or score[p] < 0:
                break
            k = live[p]
            r = rows[nxt[k]]
            bins[r], place[r] = b, n
            nxt[k] += 1
            n += 1
            room -= c[:, p]
            if nxt[k] == stop[k]:
                live = np.delete(live, p)
                size, gain = np.delete(size, p, 1), np.delete(gain, p, 1)
                c, g = size, gain
        b += 1
    return bins, place


def pack(pieces: DataFrame, tokens: str = "length", loss: str | None = None, capacity: int = 2048, segments: int = 256, loss_limit: int | None = None, group_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id, offset (the tokens before the piece in its sequence), sequence_tokens and padded_tokens to pieces.

    Limits: `capacity` tokens, `segments` pieces and `loss_limit` tokens of the column `loss` (all tokens bear loss without it). A piece beyond a limit
    by itself is an error. A sequence is padded to the capacity unless its tokens are a power of two.
    """
    limits = np.array([capacity, segments, loss_limit or capacity], np.int64)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "sequence_tokens", "padded_tokens")]
    loss_of = F.col(loss) if loss else F.col(tokens)
    # the table is read twice (counted, then dealt out); a row's place in it keeps equal rows from falling into one group
    pieces = written(pieces)
    groups = max(1, -(-pieces.count() // group_rows))
    sized = pieces.select(F.struct(*names).alias("row"), F.col(tokens).cast("bigint").alias("t"), F.coalesce(loss_of.cast("bigint"), F.lit(0)).alias("l"), F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups)).alias("g"))

    def one(table: pa.Table) -> pa.Table:
        t, ls, g = (table.column(c).to_numpy() for c in ("t", "l", "g"))
        sizes = np.stack([t, np.ones(len(t), np.int64), ls], 1)
        if (sizes > limits).any():
            raise ValueError(f"a piece is larger than a sequence: {sizes.max(0).tolist()} of {limits.tolist()}")
        bins, place = fill(sizes, limits)
        order = np.lexsort((place, bins))
        sorted_t, sorted_b = t[order], bins[order]
        before = np.cumsum(sorted_t) - sorted_t
        head = np.concatenate(([True], np.diff(sorted_b) > 0))
        offset = before - before[head][np.cumsum(head) - 1]
        total = np.bincount(bins, weights=t).astype(np.int64)[sorted_b]
        padded = np.where((total & (total - 1)) == 0, total, capacity)
        made = table.take(pa.array(order))
        return pa.table({"row": made.column("row"), "sequence_id": g[order].astype(np.int64) * 2**32 + sorted_b, "offset": offset, "sequence_tokens": total, "padded_tokens": padded})

    schema = f"row {sized.schema['row'].dataType.simpleString()}, sequence_id bigint, offset bigint, sequence_tokens bigint, padded_tokens bigint"
    packed = sized.groupBy("g").applyInArrow(one, schema)
    return packed.select("row.*", "sequence_id", "offset", "sequence_tokens", "padded_tokens")
