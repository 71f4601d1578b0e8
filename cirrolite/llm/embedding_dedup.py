"""Embedding near-duplicates: exact threshold pairs by a dual traversal of cover trees.

Vectors are scaled to length 1, where cosine c is Euclidean distance sqrt(2 - 2c). Vectors that are equal, within a label, are one point with a
count. The upper levels of each label's tree are Spark tables. A node with more than `leaf` points gets children around the centres of a net: a
bounded sample of its points, thinned so that centres lie further apart than a step, which halves from level to level. If the net covers most of the sample
within the step, points join the nearest centre within it and the others form a node of their own, which is split again; where it doesn't (points that
lie far from each other in all directions), all points join the nearest centre. Each node records its real covering radius. A node whose radius is at most half the
threshold's distance is tight: all its points are linked, it is never split and never compared with itself.

Pairs of nodes are expanded level by level. A pair goes when the distance of its centres exceeds both radii and the threshold together, and is taken as a whole
when all of them stay below the threshold. The leaf nodes, in blocks of about `leaf` points, hold the lower levels of the tree - nets with halving radii, made
once - and each pair of blocks that stays is one task row, which traverses them in the same way, down to points. A task returns a count per point and edges
to the smallest point of a group, never all pairs.

Defined results: a null label, id or vector, a zero vector, and null or non-finite components link with nothing; vectors link only with
vectors of as many components. Rows that repeat are vectors of their own (n_links counts them); rows that share an id share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, small, written

FEW = 48
SLACK = 1e-6
NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("first", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))


def net(x: np.ndarray, step: float) -> list[tuple[np.ndarray, float]]:
    """Members and radius of each cell: a centre is the first point that no earlier centre has within step, and takes the free ones within step."""
    alive, out, cut = np.ones(len(x), bool), [], 1 - step * step / 2
    for at in range(0, len(x), 256):
        some = at + np.flatnonzero(alive[at : at + 256])
        for i, row in zip(some, x[some] @ x.T):
            if alive[i]:
                near = alive & (row >= cut)
                near[i] = True
                members = np.flatnonzero(near)
                alive[members] = False
                out.append((members, float(np.sqrt(max(0.0, 2 - 2 * min(1.0, row[members].min()))))))
    return out


def grow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cover tree: an order of the points in which each node is a run that begins with its centre, and the nodes, children after parents."""
    order = np.arange(len(x))
    nodes, steps = [[0, len(x), 0, 0, float(apart(x, x[:1]).max())]], [1.0]
    for node, step in zip(nodes, steps):  # both grow meanwhile
        lo, hi, radius = node[0], node[1], node[4]
        while step >= radius and step > SLACK:
            step /= 2
        if hi - lo <= FEW or step <= SLACK:
            continue
        points = order[lo:hi]
        cells = net(x[points], step)
        order[lo:hi] = points[np.concatenate([m for m, _ in cells])]
        node[2], node[3] = len(nodes), len(cells)
        for members, r in cells:
            nodes.append([lo, lo + len(members), 0, 0, r])
            steps.append(step / 2)
            lo += len(members)
    return order, np.array([tuple(n) for n in nodes], NODE)


class Links:
    """Counts per point and edges between points, as a traversal finds them; y may be x itself."""

    def __init__(self, x: np.ndarray, n: np.ndarray, y: np.ndarray | None, m: np.ndarray | None, cosine: float):
        self.same = y is None
        self.x, self.n, self.y, self.m = x, n, x if self.same else y, n if self.same else m
        self.cosine, self.reach = cosine, float(np.sqrt(2 - 2 * cosine))
        self.shift = 0 if self.same else len(x)
        self.count = np.zeros(self.shift + len(self.y), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen = self.gone = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Single links i of x with j of y."""
        np.add.at(self.count, i, self.m[j])
        np.add.at(self.count, self.shift + j, self.n[i])
        self.edges.append((i, self.shift + j))

    def whole(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """All of the run a of x with all of the run b of y."""
        i, j = np.arange(*a), self.shift + np.arange(*b)
        if self.same and a == b:
            self.count[i] += self.n[a[0] : a[1]].sum() - self.n[i]
        else:
            self.count[i] += self.m[b[0] : b[1]].sum()
            self.count[j] += self.n[a[0] : a[1]].sum()
        self.edges.append((np.full(len(j), a[0]), j))
        self.edges.append((i, np.full(len(i), self.shift + b[0])))

    def traverse(self, left: np.ndarray, right: np.ndarray) -> None:
        stack = [(0, 0)]
        while stack:
            p, q = stack.pop()
            a, b = left[p], right[q]
            own = self.same and p == q
            if not (a["children"] or b["children"]) or (a["hi"] - a["lo"]) * (b["hi"] - b["lo"]) <= FEW * FEW:
                hit = self.x[a["lo"] : a["hi"]] @ self.y[b["lo"] : b["hi"]].T >= self.cosine
                i, j = np.nonzero(np.triu(hit, 1) if own else hit)
                if len(i):
                    self.add(a["lo"] + i, b["lo"] + j)
                continue
            ours = np.arange(a["first"], a["first"] + a["children"]) if a["children"] else np.array([p])
            theirs = np.arange(b["first"], b["first"] + b["children"]) if b["children"] else np.array([q])
            # the children's centres against each other, some rows at a time
            for at in range(0, len(ours), 512):
                u, v = left[ours[at : at + 512]], right[theirs]
                dot = self.x[u["lo"]] @ self.y[v["lo"]].T
                d, bound = np.sqrt(np.maximum(0, 2 - 2 * dot)), u["radius"][:, None] + v["radius"][None, :]
                keep = d <= bound + self.reach + SLACK
                if own:
                    keep &= ours[at : at + 512, None] <= theirs[None, :]
                self.seen += keep.size if not own else int((ours[at : at + 512, None] <= theirs[None, :]).sum())
                self.gone += (keep.size if not own else int((ours[at : at + 512, None] <= theirs[None, :]).sum())) - int(keep.sum())
                one = (u["hi"] - u["lo"] == 1)[:, None] & (v["hi"] - v["lo"] == 1)[None, :]
                i, j = np.nonzero(keep & one & (dot >= self.cosine))
                i, j = u["lo"][i], v["lo"][j]
                if own:
                    i, j = i[i != j], j[i != j]
                if len(i):
                    self.add(i, j)
                for r, s in zip(*np.nonzero(keep & ~one)):
                    if d[r, s] + bound[r, s] <= self.reach - SLACK:
                        self.whole((u["lo"][r], u["hi"][r]), (v["lo"][s], v["hi"][s]))
                    else:
                        stack.append((ours[at + r], theirs[s]))

    def roots(self) -> np.ndarray:
        i, j = (np.concatenate(x) for x in zip(*self.edges)) if self.edges else (np.empty(0, np.int64),) * 2
        return roots(len(self.count), i, j)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


# ---- upper levels ----


def chosen(x: np.ndarray, step: float, fanout: int, reach: float) -> tuple[np.ndarray, float]:
    """Of a sample the centres of a net that covers most of it and its step; step 0: no net does, the centres are for the nearest points."""
    first = None
    while step > reach / 8:
        cells = sorted(net(x, step), key=lambda c: -len(c[0]))
        first = first or cells
        top = cells[:fanout]
        if sum(len(m) for m, _ in top) >= len(x) / 2 and (len(top) > 1 or step <= reach / 2):
            return x[[m[0] for m, _ in top]], step
        step /= 2
    return x[[m[0] for m, _ in (first or net(x, reach / 8))[:fanout]]], 0.0


def _centres(fanout: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, step, n, sample in zip(*(b.column(c).to_pylist() for c in ("node", "step", "centres", "sample"))):
                c, s = chosen(unit(sample), step, n, reach)
                yield pa.RecordBatch.from_pydict({"node": [node], "step": pa.array([s], pa.float64()), "centres": pa.array([c.tolist()], pa.list_(pa.list_(pa.float64())))})

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The child of each point of a block: the nearest centre's number; -1 beyond the step, with the distance from the first centre."""
    for b in batches:
        for k in range(b.num_rows):
            points, step, centres = b.column("points")[k].values, b.column("step")[k].as_py(), b.column("centres")[k].as_py()
            e = points.field("embedding")
            x = unit(e.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1))
            d = apart(x, np.array(centres))
            child = d.argmin(1)
            if step:
                child[d[np.arange(len(x)), child] > step] = -1
            dist = d[np.arange(len(x)), np.maximum(child, 0)]
            names = [b.column("node")[k].as_py() + "/" + ("r" if c < 0 else str(c)) for c in child.tolist()]
            yield pa.RecordBatch.from_arrays([points.field("key"), points.field("id"), points.field("n"), e, pa.array(names), pa.array(np.maximum(child, 0).astype(np.int32)), pa.array(dist)], ["key", "id", "n", "embedding", "node", "centre", "dist"])


POINT = ("key", "id", "n", "embedding")


def _levels(points: DataFrame, leaf: int, fanout: int, reach: float, most: int = 60) -> tuple[DataFrame, list[DataFrame]]:
    """(points of the leaf nodes with `node`; the tables of each level: node, parent, centre, radius, points)."""
    kinds = dict(points.dtypes)
    now, step = points, F.lit(1.0)
    sizes = written(now.groupBy("node").agg(F.count("*").alias("points"))).withColumn("step", step)
    done, levels = [], []
    for _ in range(most):
        open_ = written(sizes.filter(F.col("points") > leaf).select("node", "points", "step"))
        if open_.isEmpty():
            break
        inner = now.join(small(open_, 64), "node")
        done.append(now.join(small(open_.select("node"), 64), "node", "left_anti"))
        # about 8 candidates for each centre, by a hash: their number doesn't grow with the node
        wanted = F.least(F.lit(fanout), F.ceil(F.col("points") / leaf) + 1).cast("int")
        draw = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) * F.col("points").cast("double") < wanted * float(8 << 30)
        sample = inner.groupBy("node").agg(F.first("step").alias("step"), F.first(wanted).alias("centres"), F.collect_list(F.when(draw, F.col("embedding"))).alias("sample"), F.min_by("embedding", "key").alias("any"))
        sample = sample.withColumn("sample", F.when(F.size("sample") > 0, F.col("sample")).otherwise(F.array("any"))).drop("any")
        centres = written(sample.mapInArrow(_centres(fanout, reach), "node string, step double, centres array<array<double>>"))
        blocks = inner.groupBy("node", F.pmod(F.xxhash64("key", F.lit(3)), F.ceil(F.col("points") / 1024)).alias("block")).agg(F.collect_list(F.struct(*POINT)).alias("points"))
        moved = written(blocks.join(small(centres, 64 << 10), "node").mapInArrow(_children, f"key bigint, id bigint, n bigint, embedding {kinds['embedding']}, node string, centre int, dist double"))
        found = moved.groupBy("node").agg(F.count("*").alias("points"), F.max("dist").alias("radius"), F.first("centre").alias("k"))
        parent = F.regexp_replace("node", "/[^/]*$", "")
        found = found.withColumn("parent", parent).join(centres.select(F.col("node").alias("parent"), "centres", F.col("step").alias("s")), "parent")
        found = found.join(open_.select(F.col("node").alias("parent"), F.col("points").alias("was"), F.col("step").alias("before")), "parent")
        # the step halves; a node that a net left as large as it was goes on with half the step
        after = F.when(F.endswith("node", F.lit("/r")), F.when(F.col("points") > 0.9 * F.col("was"), F.col("before") / 2).otherwise(F.col("before"))).otherwise(F.when(F.col("s") > 0, F.col("s") / 2).otherwise(F.when(F.col("points") > 0.9 * F.col("was"), F.col("before") / 2).otherwise(F.col("before"))))
        level = written(found.select("node", "parent", F.get("centres", "k").alias("centre"), "radius", "points", after.alias("step")))
        levels.append(level)
        # tight nodes stay as they are, as do those that no step can split any more
        sizes = level.filter((F.col("radius") > reach / 2 - SLACK) & (F.col("step") > reach / 8))
        now = moved.select("node", *POINT)
    done.append(now)
    leaves = done[0].select("node", *POINT)
    for d in done[1:]:
        leaves = leaves.unionByName(d.select("node", *POINT))
    return leaves, levels


def _verdicts(reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ca, cb = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("ca", "cb"))
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", ca, cb)))
            bound = b.column("ra").to_numpy() + b.column("rb").to_numpy()
            kind = np.where(d > bound + reach + SLACK, 0, np.where(d + bound <= reach - SLACK, 2, 1))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(kind.astype(np.int32))], ["a", "b", "kind"])

    return run


def node_pairs(roots_: DataFrame, levels: list[DataFrame], cosine: float) -> DataFrame:
    """Pairs (a, b, kind) of leaf nodes that may hold links (kind 1) or consist of links (2), a <= b; and kind 0, those that the bounds removed, at the level where they went."""
    reach, gone, info = float(np.sqrt(2 - 2 * cosine)), [], None
    pairs = roots_.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1).alias("kind"))
    for level in levels:
        left = level.select(F.col("parent").alias("a"), F.col("node").alias("a2"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
        right = level.select(F.col("parent").alias("b"), F.col("node").alias("b2"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
        # pairs with a node that has no children here stay as they are on that side
        met = pairs.filter("kind > 0").join(small(left, 2048), "a", "left").join(small(right, 2048), "b", "left")
        met = written(met.withColumn("new", F.coalesce("a2", "b2").isNotNull()).withColumn("own", F.col("a") == F.col("b")).withColumn("a", F.coalesce("a2", "a")).withColumn("b", F.coalesce("b2", "b")).filter("not own or a <= b").select("a", "b", "kind", "new"))
        info = level if info is None else info.unionByName(level)
        about = info.select("node", "centre", "radius")
        old = met.filter("not new").select("a", "b", "kind")
        tested = met.filter("new").join(small(about.select(F.col("node").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra")), 2048), "a").join(small(about.select(F.col("node").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb")), 2048), "b")
        judged = written(tested.mapInArrow(_verdicts(reach), "a string, b string, kind int").unionByName(old))
        gone.append(judged.filter("kind = 0"))
        pairs = judged.filter("kind > 0")
    for g in gone:
        pairs = pairs.unionByName(g)
    return pairs


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's points in the order of its tree, and the tree."""
    for b in batches:
        for k in range(b.num_rows):
            points = b.column("points")[k].values
            raw = points.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)
            order, nodes = grow(unit(raw))
            values = [raw[order].tobytes(), str(raw.dtype), nodes.tobytes(), *(points.field(c).to_numpy()[order].astype("<i8").tobytes() for c in ("key", "id", "n"))]
            yield pa.RecordBatch.from_arrays([b.column("node").slice(k, 1), b.column("block").slice(k, 1), *[pa.array([v]) for v in values]], ["node", "block", "x", "type", "tree", "keys", "ids", "ns"])


TREE = ("x", "type", "tree", "keys", "ids", "ns")


def read_tree(row: dict, tag: str) -> tuple[np.ndarray, ...]:
    keys, ids, n = (np.frombuffer(row[c + tag], "<i8") for c in ("keys", "ids", "ns"))
    return unit(np.frombuffer(row["x" + tag], row["type" + tag]).reshape(len(n), -1)), np.frombuffer(row["tree" + tag], NODE), keys, ids, n


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                x, left, keys, ids, n = read_tree(row, "_a")
                if row["x_b"] is None:
                    links = Links(x, n, None, None, cosine)
                    links.traverse(left, left)
                else:
                    y, right, more, ids2, m = read_tree(row, "_b")
                    links = Links(x, n, y, m, cosine)
                    links.traverse(left, right)
                    keys, ids = np.concatenate([keys, more]), np.concatenate([ids, ids2])
                hit, root = links.count > 0, links.roots()
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(links.count[hit]), pa.array(ids[hit]), pa.array(ids[root[hit]])], ["key", "links", "id", "root"])

    return run


def near_links(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, leaf: int = 2048, fanout: int = 16) -> DataFrame:
    """One row per row of vectors: the id, n_links (other rows linked directly), component_id (smallest id reachable by links, itself included)."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("embedding"), F.col(label).cast("string").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # two 64-bit hashes name a vector of a label
    named = rows.withColumn("good", good).withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "embedding"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(1), "embedding", "label")))
    able = named.filter("good")
    points = able.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    points = written(points.withColumn("key", F.xxhash64("h1", "h2")).withColumn("node", F.concat(F.col("label"), F.lit(":"), F.size("embedding"))))
    reach = float(np.sqrt(2 - 2 * cosine))
    leaves, levels = _levels(points.select("node", *POINT), leaf, fanout, reach)
    pairs = node_pairs(points.select("node").distinct(), levels, cosine).filter("kind > 0")
    if levels:
        leaves, pairs = written(leaves), written(pairs)

    # pairs of nodes that consist of links
    whole = pairs.filter("kind = 2")
    weight = leaves.groupBy("node").agg(F.sum("n").alias("w"), F.min("id").alias("least"))
    both = whole.join(weight.select(F.col("node").alias("a"), F.col("w").alias("wa"), F.col("least").alias("la")), "a").join(weight.select(F.col("node").alias("b"), F.col("w").alias("wb"), F.col("least").alias("lb")), "b")
    sides = both.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.col("wa").alias("w"), F.lit(1).alias("own"), F.col("la").alias("least")))).otherwise(F.array(F.struct(F.col("a").alias("node"), F.col("wb").alias("w"), F.lit(0).alias("own"), F.least("la", "lb").alias("least")), F.struct(F.col("b").alias("node"), F.col("wa").alias("w"), F.lit(0).alias("own"), F.least("la", "lb").alias("least"))))).alias("s")).select("s.*")
    if levels:
        per = written(sides.groupBy("node").agg(F.sum("w").alias("w"), F.max("own").alias("own"), F.min("least").alias("root")))
        taken = leaves.join(small(per, 64), "node").select("key", (F.col("w") - F.when(F.col("own") == 1, F.col("n")).otherwise(0)).alias("links"), "id", "root")
        taken = taken.unionByName(both.select(F.lit(None).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("links"), F.col("la").alias("id"), F.col("lb").alias("root")))

    # blocks of leaf nodes with their trees, and the pairs of blocks to compare
    sized = leaves.join(small(written(leaves.groupBy("node").agg(F.ceil(F.count("*") / leaf).alias("blocks"))), 64), "node")
    blocks = sized.groupBy("node", F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list(F.struct(*POINT)).alias("points"))
    trees = written(blocks.mapInArrow(_trees, "node string, block int, x binary, type string, tree binary, keys binary, ids binary, ns binary"))
    names = trees.select("node", "block")
    meet = pairs.filter("kind = 1").join(names.select(F.col("node").alias("a"), F.col("block").alias("i")), "a").join(names.select(F.col("node").alias("b"), F.col("block").alias("j")), "b").filter("a <> b or i <= j")
    side = lambda tag, node, block: trees.select(F.col("node").alias(node), F.col("block").alias(block), *[F.col(c).alias(c + tag) for c in TREE])
    meet = meet.select("a", "i", "b", "j").repartition(partitions(spark), "a", "i", "b", "j").join(side("_a", "a", "i"), ["a", "i"])
    own = meet.filter("a = b and i = j").select("*", *[F.lit(None).cast(trees.schema[c].dataType).alias(c + "_b") for c in TREE])
    meet = own.unionByName(meet.filter("a <> b or i <> j").join(side("_b", "b", "j"), ["b", "j"]), allowMissingColumns=True)
    found = meet.select(*[c + t for t in ("_a", "_b") for c in TREE]).mapInArrow(_compare(cosine), "key bigint, links bigint, id bigint, root bigint")
    found = written(found.unionByName(taken) if levels else found)

    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    linked = points.join(found.filter("key is not null").groupBy("key").agg(F.sum("links").alias("links")), "key", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("id").alias("first"))
    linked = linked.join(joined.select(F.col("node").alias("first"), "component"), "first", "left").select("h1", "h2", "n_links", F.coalesce("component", "first").alias("component_id"))
    out = named.select("id", "h1", "h2").join(linked, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
