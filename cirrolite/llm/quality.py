"""A quality classifier from zstandard dictionaries.

Two dictionaries are trained, one on good and one on bad labelled texts. A text is cut into pieces of PIECE bytes and each piece is
compressed with both; the difference of the compressed sizes over the piece's size says which kind of text it resembles. The mean and the extremes over
all pieces go through a logistic calibration, fitted on what dictionaries say that did not see the row: the labelled rows are dealt to folds, and each fold is
measured with dictionaries of the others.

The fit takes at most `per_class` rows of each label (those whose id hashes lowest): the bound of what reaches the driver is 2 * per_class whole
texts. Scoring reads all texts.

Defined results: a null or empty text has no pieces and gets the calibrated score of the labelled rows' mean difference; so do all texts of equal
score stay equal (ties are not broken). Labels that are null or neither 0 nor 1 are left out of the fit, as are ids labelled both ways; of rows that repeat a labelled id
the one with the smallest text counts. With fewer than `least_rows` rows of either label there is nothing to train on: fitting raises. An empty table
has no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, small_batches

PIECE = 1024
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    means: list[float]


def _compressors(model: Model):
    import zstandard

    made = []
    for d in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(d)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def features(text: bytes | None, good, bad) -> list[float] | None:
    if not text:
        return None
    d, size = [], []
    for i in range(0, len(text), PIECE):
        piece = text[i : i + PIECE]
        d.append(len(bad.compress(piece)) - len(good.compress(piece)))
        size.append(len(piece))
    d, size = np.array(d, float), np.array(size, float)
    n, each = size.sum(), d / (size + 300)
    # differences of short texts say little: they shrink, and the text's length has a weight of its own
    return [float(x) for x in (d.sum() / (n + 100), d.sum() / (n + 600), each.min(), each.max(), 100 / (n + 100), 300 / (n + 300))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(labelled: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, least_rows: int = 8, dictionary_bytes: int = 65536, folds: int = 8) -> Model:
    """labelled: id and label (0 or 1). Only the sampled ids meet docs, as a broadcast of at most 2 * per_class rows."""
    import zstandard

    known = labelled.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    known = known.withColumn("at", F.xxhash64("id"))
    picked = [known.filter(F.col("label") == k).orderBy("at", "id").limit(per_class) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    pairs = docs.select(F.col(id).alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t")).join(F.broadcast(picked), "id")
    pairs = pairs.filter(F.octet_length("t") > 0).groupBy("at", "id", "label").agg(F.min("t").alias("t"))
    rows = sorted((r["at"], r["id"], r["label"], bytes(r["t"])) for r in pairs.collect())
    y = np.array([r[2] for r in rows], float)
    texts = {k: [r[3] for r in rows if r[2] == k] for k in (0, 1)}
    if min(map(len, texts.values())) < least_rows:
        raise ValueError(f"{len(texts[1])} good and {len(texts[0])} bad labelled texts; at least {least_rows} of each are needed")

    def dictionary(samples: list[bytes]) -> bytes:
        pieces = [t[i : i + PIECE] for t in samples for i in range(0, len(t), PIECE)]
        try:
            return zstandard.train_dictionary(min(dictionary_bytes, max(1024, sum(map(len, pieces)) // 4)), pieces).as_bytes()
        except zstandard.ZstdError:  # too few or too uniform samples: their end is the dictionary
            return b"".join(pieces)[-dictionary_bytes:]

    # each text is measured with dictionaries of the other folds' texts; those of the model are built from all of them
    held = []
    for fold in range(folds):
        good, bad = _compressors(Model(*[dictionary([t for n, t in enumerate(texts[k]) if n % folds != fold]) for k in (1, 0)], [], []))
        held += [(features(t, good, bad), k) for k in (0, 1) for t in texts[k][fold::folds]]
    model = Model(dictionary(texts[1]), dictionary(texts[0]), [], [])
    x, y = np.array([f for f, _ in held]), np.array([k for _, k in held], float)
    # the sample is balanced by its limits; weigh the constant back to the share of the labels
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    w = _logistic(x, y)
    w[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum())
    model.weights, model.means = w.tolist(), x.mean(0).tolist()
    return model


def _score(m: Model, f: list[float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.dot(m.weights[:-1], f) + m.weights[-1], -30, 30))))


def quality_scores(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and score (0 to 1, higher: better) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        made = _compressors(m)
        for b in batches:
            scores = [_score(m, features(t, *made) or m.means) for t in buffers(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`. Texts are scored and rows dropped in one pass."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        made = _compressors(m)
        for b in batches:
            score = [_score(m, features(t, *made) or m.means) for t in buffers(b.column(at))]
            yield b.filter(pa.array([s >= least for s in score], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
