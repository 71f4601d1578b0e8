"""Exact top-k search by inner product, by elimination with a table of distances to pivots.

Vectors become integers, floor(scale * x). With d the distance of a query q and a vector v, 2 q.v = |q|^2 + |v|^2 - d^2, so a lower bound of d is an upper bound of the score. The distances of q and v to
all pivots fix the parts of q and v that lie in the pivots' span, and the lengths of what is left; the greatest lower bound that they allow together is reached when what is left points the same way:
d^2 >= |c(q) - c(v)|^2 + (r(q) - r(v))^2, with c the coordinates in the span and r the length outside it. It is never below the greatest of the bounds |d(q, p) - d(v, p)| of single pivots, which
leave out almost nothing where vectors point in all directions. The table holds c and r of each vector (by an orthonormal basis of the span, which gives what the distances give with less rounding), computed once.

Rows of equal dimension are one space. Rows go to the cell of their nearest pivot, large cells to several blocks by row number, so that a block has about `block` rows whatever the
cell's share. A block is one row of a table: its vectors, their table rows, and the range of their distances to each pivot. The queries of a block find their best k in it first; that is a floor
of their k-th score. Then blocks of queries meet the blocks of vectors: pairs whose ranges bound all scores below all floors go before their vectors travel; in the others,
each query takes the vectors that the bounds leave in the order of the bounds, in steps, and stops when the next bound is below its k-th score. Equal bounds are still looked at, so
ties go to the smaller id exactly.

The pivots (at most `pivots` for each dimension) come from a bounded sample: each next one is the vector furthest from those taken. They decide the speed alone.

Defined results: rows without id or vector, and vectors with null or non-finite components, take no part. Vectors of other dimensions than the query's are no candidates;
empty vectors have score 0 with each other. Rows that repeat an id are rows of their own: each is a query if its id is one, and a candidate for the other. Vectors whose squared length reaches
2**60 raise an error, since scores must fit 64 bits. Fewer than k candidates give fewer rows, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

STEP, EXACT, PART_BYTES = 64, 2**52, 32 << 20
HITS = {"query_row": "bigint", "query_id": "bigint", "vec_id": "bigint", "score": "bigint"}
SIDE = {"n": "int", "numbers": "binary", "ids": "binary", "type": "string", "vectors": "binary", "table": "binary"}
RANGE = {"most": "double", "low": "array<double>", "high": "array<double>"}
ASKED = {f"{c}_q": t for c, t in (SIDE | RANGE).items()} | {"floors": "binary", "floor": "bigint"} | {f"hit_{c}": "binary" for c in HITS}
BLOCK = {"dim": "int", "block": "bigint"} | SIDE | RANGE | ASKED
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in fields.items())


def integers(embedding: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * embedding.astype(np.float64)).astype(np.int64)


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each row of x to each row of p. The squares are exact below 2**53; margin() covers the rest."""
    x, p = x.astype(np.float64), p.astype(np.float64)
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T))


def margin(norms: np.ndarray | float) -> np.ndarray | float:
    """What rounding (the table travels as 32-bit floats) may take from a bound on scores of vectors of at most that squared length."""
    return 4e-6 * norms + 1e-3


def chosen(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots: each next one is furthest from those before."""
    if not len(sample):
        return sample
    taken, near = [0], distances(sample, sample[:1])[:, 0]
    while len(taken) < most and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[taken[-1:]])[:, 0])
    return sample[taken]


def span(pivots: np.ndarray) -> np.ndarray:
    """An orthonormal basis, as columns, of a space that holds the pivots."""
    return np.linalg.qr(pivots.astype(np.float64).T)[0]


def pivot_table(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """c and, in the last column, r of each vector."""
    x = x.astype(np.float64)
    c = x @ basis
    return np.column_stack([c, np.sqrt(np.maximum(0, (x * x).sum(1) - (c * c).sum(1)))])


def scores(q: np.ndarray, x: np.ndarray, norms: float) -> np.ndarray:
    """Exact inner products: in doubles where every sum stays below 2**53."""
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if norms < EXACT else x @ q


class Best:
    """The k best (score, smaller id first) of one query."""

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.score, self.id, self.floor = k, np.zeros(0, np.int64), np.zeros(0, np.int64), floor

    def add(self, score: np.ndarray, id: np.ndarray) -> None:
        score, id = np.concatenate([self.score, score]), np.concatenate([self.id, id])
        best = np.lexsort((id, -score))[: self.k]
        self.score, self.id = score[best], id[best]
        if len(best) == self.k:
            self.floor = int(self.score[-1]) if self.floor is None else max(self.floor, int(self.score[-1]))


def search(best: Best, q: np.ndarray, q_table: np.ndarray, q_norm: float, x: np.ndarray, table: np.ndarray, norms: np.ndarray, ids: np.ndarray, skip: int = -1) -> int:
    """Candidates in the order of their bounds until none can enter; the row `skip` is the query itself. Returns how many scores were computed."""
    top = float(max(q_norm, norms.max()))
    upper = table @ q_table + margin(top)  # |q|^2 + |v|^2 less the least squared distance, halved
    if skip >= 0:
        upper[skip] = -np.inf
    left = np.flatnonzero(upper >= (best.floor if best.floor is not None else -np.inf))
    left = left[left != skip]
    left = left[np.argsort(-upper[left], kind="stable")]
    step, at = STEP, 0
    while at < len(left) and (best.floor is None or upper[left[at]] >= best.floor):
        some = left[at : at + step]
        best.add(scores(q, x[some], top), ids[some])
        at, step = at + step, step * 2
    return min(at, len(left))


def _side(numbers: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, norms: np.ndarray, away: np.ndarray) -> dict:
    kind = next(t for t in (np.int16, np.int32, np.int64) if t == np.int64 or np.abs(x).max(initial=0) <= np.iinfo(t).max)
    travels = {"n": len(x), "numbers": numbers.tobytes(), "ids": ids.tobytes(), "type": np.dtype(kind).str, "vectors": x.astype(kind).tobytes(), "table": table.astype(np.float32).tobytes()}
    return travels | {"most": float(norms.max()), "low": away.min(0).tolist(), "high": away.max(0).tolist()}


def _read(row: dict, dim: int, tag: str = "") -> tuple[np.ndarray, ...]:
    n = row["n" + tag]
    numbers, ids = (np.frombuffer(row[c + tag], np.int64) for c in ("numbers", "ids"))
    x = np.frombuffer(row["vectors" + tag], row["type" + tag]).reshape(n, dim).astype(np.int64)
    return numbers, ids, x, np.frombuffer(row["table" + tag], np.float32).reshape(n, -1).astype(np.float64), np.einsum("ij,ij->i", x, x).astype(np.float64)


def _hits(found: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    n = [len(b.id) for *_, b in found]
    cat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([r for r, *_ in found], np.int64), n)), pa.array(np.repeat(np.array([i for _, i, _ in found], np.int64), n)), pa.array(cat([b.id for *_, b in found])), pa.array(cat([b.score for *_, b in found]))], list(HITS))


def _packed(k: int):
    """The rows of a block as one row, with its queries and what they find in it."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("number")
        x, table, away = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1) for c, kind in (("x", np.int64), ("t", np.float64), ("d", np.float64)))
        numbers, ids, asks = (part.column(c).to_numpy() for c in ("number", "id", "asks"))
        norms = np.einsum("ij,ij->i", x, x).astype(np.float64)
        row = {"dim": key[0].as_py(), "block": key[1].as_py()} | _side(numbers, ids, x, table, norms, away)
        some, found = np.flatnonzero(asks), []
        for i in some:
            search(best := Best(k), x[i], table[i], norms[i], x, table, norms, ids, skip=int(i))
            found.append((int(numbers[i]), int(ids[i]), best))
        if found:
            floors, hits = np.array([-(2**63) if b.floor is None else b.floor for *_, b in found], np.int64), _hits(found)
            row |= {f"{c}_q": v for c, v in _side(numbers[some], ids[some], x[some], table[some], norms[some], away[some]).items()} | {"floors": floors.tobytes(), "floor": int(floors.min())}
            row |= {f"hit_{c}": hits.column(c).to_numpy().tobytes() for c in HITS}
        return pa.Table.from_pylist([row], schema=pa.schema([(c, ARROW[t]) for c, t in BLOCK.items()]))

    return run


def _compared(k: int):
    """A block's vectors with the queries of other blocks."""

    def run(key: tuple, blocks: pa.Table, asks: pa.Table) -> pa.Table:
        dim, found = key[0].as_py(), []
        for block in blocks.to_pylist():
            _, ids, x, table, norms = _read(block, dim)
            for at in range(asks.num_rows):
                row = asks.slice(at, 1).to_pylist()[0]
                numbers, own, q, q_table, q_norms = _read(row, dim, "_q")
                for i, floor in enumerate(np.frombuffer(row["floors"], np.int64).tolist()):
                    search(best := Best(k, None if floor == -(2**63) else floor), q[i], q_table[i], q_norms[i], x, table, norms, ids)
                    found.append((int(numbers[i]), int(own[i]), best))
        return pa.Table.from_batches([_hits(found)])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.column(f"hit_{c}")[at].as_py(), np.int64)) for c in HITS], list(HITS))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, pivots: int = 48, block: int = 4096, sample: int = 2000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product with each row of vectors for which is_query, a condition on its columns, holds. At most `sample` vectors of a dimension reach the driver."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).cast(kind).alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("e"))
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()))

    # pivots of each dimension, from distinct vectors
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"))
    thin = rows.join(F.broadcast(dims), "dim").filter(F.pmod(F.xxhash64("e", F.lit(3)), F.col("n")) <= 2 * sample).select("dim", "e").distinct()
    picked = thin.withColumn("at", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("e"), "e"))).filter(F.col("at") <= sample).select("dim", "e").toPandas()
    spaces = {int(d): chosen(integers(np.array(g["e"].tolist()).reshape(len(g), int(d)), scale), pivots) for d, g in picked.groupby("dim")}
    bases = {d: span(p) for d, p in spaces.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                part = b.take(pa.array(np.flatnonzero(dim == d)))
                x = integers(part.column("e").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d), scale)
                if (np.square(x.astype(np.float64)).sum(1) >= 2**60).any():
                    raise ValueError("a vector is too long for scores of 64 bits")
                away = distances(x, spaces[d])
                made = [pa.array(away.argmin(1).astype(np.int32)), *[pa.array([r.tobytes() for r in y], pa.binary()) for y in (x, pivot_table(x, bases[d]), away)]]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("number", "id", "asks", "dim")], *made], ["number", "id", "asks", "dim", "cell", "x", "t", "d"])

    points = written(rows.mapInArrow(placed, "number bigint, id bigint, asks boolean, dim int, cell int, x binary, t binary, d binary"))
    sizes = points.groupBy("dim", "cell").agg(F.count("*").alias("n"))  # at most `pivots` rows a dimension
    share = F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / block))
    made = written(points.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("block", F.xxhash64("cell", share)).groupBy("dim", "block").applyInArrow(_packed(k), ddl(BLOCK)))

    # pairs of blocks, by their ranges alone
    asks = made.filter("n_q is not null").withColumnRenamed("block", "block_q")
    left = asks.select("dim", "block_q", "most_q", "floor", "low_q", "high_q")
    gaps = F.zip_with(F.zip_with("low", "high_q", lambda a, b: a - b), F.zip_with("low_q", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    gap = F.coalesce(F.array_max(gaps), F.lit(0.0))
    bound = (F.col("most") + F.col("most_q") - gap * gap) / 2 + margin(F.greatest("most", "most_q"))
    queries = made.agg(F.sum(F.coalesce("n_q", F.lit(0)) * (F.col("dim") * 2 + pivots * 4 + 24))).first()[0] or 0
    part = F.pmod(F.col("block_q"), F.lit(1 + int(queries) // PART_BYTES)).alias("part")  # the queries that meet a block at a time take about PART_BYTES
    pairs = written(left.join(made.select("dim", "block", *RANGE), "dim").filter((F.col("block") != F.col("block_q")) & (bound >= F.col("floor"))).select("dim", "block", "block_q", part))
    # a block travels once for each part of the queries, the queries to each block that they need
    candidates = pairs.select("dim", "block", "part").distinct().join(made.select("dim", "block", *SIDE), ["dim", "block"])
    asking = pairs.join(asks.select("dim", "block_q", *[f"{c}_q" for c in SIDE], "floors"), ["dim", "block_q"]).drop("block_q")
    by = ["dim", "block", "part"]
    asking = asking.withColumnsRenamed({c: f"{c}_a" for c in by})
    found = candidates.groupBy(*by).cogroup(asking.groupBy(*[f"{c}_a" for c in by])).applyInArrow(_compared(k), ddl(HITS))
    own = asks.select(*[f"hit_{c}" for c in HITS]).mapInArrow(_opened, ddl(HITS))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return own.unionByName(found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
