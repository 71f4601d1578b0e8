"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and any non-ASCII characters. A window is 13 consecutive
words of an item; an item of fewer words, but at least one, is one window. The automaton holds all distinct windows, built once
per Python worker, and each text is scanned once; hits become word positions, then character spans of the original text.

The benchmark is the small side: it reaches the tasks as one broadcast value while its texts take at most
`automaton_bytes`; a larger benchmark is cut into slices of that size, each with its own automaton and scan, whose hits are united.

Defined results: null and empty texts have no words and no hits; null or wordless items have no windows; rows that repeat a
doc_id are judged each on their own; item ids are compared as strings, null ids are left out of the list but their windows
still count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import buffers, small_batches

WINDOW = 13
#: Each byte to itself, A-Z to a-z, the separators to a space; bytes over 127 belong to non-ASCII characters and are kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def automaton_of(items: list[tuple[str | None, bytes]], window: int = WINDOW):
    """Windows, in Latin-1 to have one character per byte, to (number of words, item ids)."""
    import ahocorasick

    at: dict[bytes, set] = {}
    for item, text in items:
        for w in windows_of(words_of(text), window):
            at.setdefault(w, set()).add(item)
    if not at:
        return None
    a = ahocorasick.Automaton()
    for w, ids in at.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, frozenset(ids)))
    a.make_automaton()
    return a


def scan(text: bytes | None, automaton) -> tuple[int, np.ndarray, set]:
    """Number of words, which of them are hit, and the items that occur."""
    words = words_of(text)
    hit, items = np.zeros(len(words), bool), set()
    if automaton is None or not words:
        return len(words), hit, items
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ends = None
    for end, (n, ids) in automaton.iter(line):
        if ends is None:  # the space after each word
            ends = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(ends, end))
        hit[last - n + 1 : last + 1] = True
        items |= ids
    return len(words), hit, items


def spans_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Character spans of the original text, from the first to the last word of each run of hit words."""
    folded = text.translate(FOLD)
    at, starts, ends = 0, [], []
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    chars = np.cumsum(np.concatenate(([0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


_built: dict[str, object] = {}


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs: the id, n_words, n_hit, items (sorted strings), spans (start, end in characters of the original text)."""
    rows = docs.select(F.col(id).cast("bigint").alias("row"), F.col(text).cast("string").alias("text"))
    found = _scanned(rows, benchmark, item, item_text, window, automaton_bytes, ["n_words", "hit", "items", "spans"])
    return found.select(F.col("row").alias(id), "n_words", F.size("hit").cast("bigint").alias("n_hit"), "items", "spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = 20, automaton_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, with all their columns, of whose words less than one in `one_in` are hit. Each row is judged by its own text, whatever its id: rows pass through the scan, nothing is joined."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select((F.struct(*others) if others else F.lit(None).cast("int")).alias("row"), F.col(text).cast("string").alias("text"))
    found = _scanned(rows, benchmark, item, item_text, window, automaton_bytes, ["text", "n_words", "hit"])
    clean = found.filter((F.size("hit") == 0) | (one_in * F.size("hit") < F.col("n_words")))
    return clean.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def _scanned(rows: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, automaton_bytes: int, wanted: list[str]) -> DataFrame:
    """rows (row of any type, text) with what is wanted of FOUND."""
    spark = rows.sparkSession
    small_batches(spark)
    b = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    total = b.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    slices = max(1, -(-total // automaton_bytes))
    kept, row = ["text", "hit", "items"], rows.schema["row"]
    rows = rows.withColumns({c: F.lit(None).cast(FOUND[c]) for c in ("hit", "items")})
    for k in range(slices):  # each slice adds its hits to those of the slices before it
        part = b if slices == 1 else b.filter(F.pmod(F.xxhash64("item", "t"), F.lit(slices)) == k)
        found = sorted({(r["item"] is None, r["item"] or "", r["t"].encode()) for r in part.collect()})
        items = spark.sparkContext.broadcast([(None if none else i, t) for none, i, t in found])
        key = hashlib.sha1(repr((found, window)).encode()).hexdigest()
        columns = wanted if k == slices - 1 else kept
        rows = rows.mapInArrow(_scanner(items, key, window, columns), StructType([row, *[StructField(c, FOUND[c]) for c in columns]]))
    return rows


FOUND = {
    "text": StringType(), "n_words": LongType(), "hit": ArrayType(IntegerType()), "items": ArrayType(StringType()),
    "spans": ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])),
}
ARROW = {"n_words": pa.int64(), "hit": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def _scanner(items, key: str, window: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = automaton_of(items.value, window)
        automaton = _built[key]
        for b in batches:
            made: dict[str, list] = {c: [] for c in ARROW}
            before = zip(b.column("hit").to_pylist(), b.column("items").to_pylist())
            for t, (earlier, names) in zip(buffers(b.column("text")), before):
                n, hit, ids = scan(t, automaton)
                if earlier is not None:
                    hit[earlier] = True
                    ids = ids | set(names)
                made["n_words"].append(n)
                made["hit"].append(np.flatnonzero(hit).tolist())
                made["items"].append(sorted(x for x in ids if x is not None))
                made["spans"].append(spans_of(t, hit) if "spans" in columns and hit.any() else [])
            arrays = [b.column("row"), *[b.column("text") if c == "text" else pa.array(made[c], ARROW[c]) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, ["row", *columns])

    return run
