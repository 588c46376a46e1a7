"""Near-duplicate vectors by a forest of random-projection trees.

The trees are fitted on a bounded sample: each inner node draws a random direction and splits its
sample at a random quantile near the middle. Every vector then goes down every tree; near a split
it takes both sides (spill), so that close vectors seldom part in all trees. The spill zone is at least
as wide as linked vectors can lie apart, and a node that no direction parts without sending many
rows both ways is a dense group and stays one leaf. Vectors that share a leaf and a label are
compared exactly, in blocks, and links join into components.

Equal vectors of a label are one class and only classes are compared. Where two classes share several
leaves only the first counts the link, so no pair list is made: a block returns, per class, its
number of links found and one neighbour through which the block's linked classes hang together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameweave.llm.components import components
from frameweave.plans.staging import materialise, small_side

#: Vectors that the trees are fitted on at most, the first by a hash of their components.
SAMPLE = 50_000
TREES = 10
#: Sample vectors in a leaf at most.
LEAF = 48
#: Share of a node's sample on each side of the split that takes both ways.
SPILL = 0.03
#: Share of a node's sample that may take both ways besides; a node with more is a dense group and stays a leaf.
BOTH = 0.2
#: Directions tried before a node stays a leaf.
TRIES = 8
#: Classes of one leaf and label that a task holds on each side of a comparison.
BLOCK = 2048


class Forest:
    """Trees as arrays: direction, lower and upper bound of the spill zone, and children.

    `reach` is the least half width of the spill zone; directions have components of variance 1, so a
    pair of unit vectors at distance d lies d apart on one in the root mean square.

    A child below zero is leaf number -child - 1; leaves are numbered over all trees.
    """

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 5, reach: float = 0.0):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1] if sample.ndim == 2 else 0
        self.roots, self.n_leaves, self.tree_of = [], 0, []
        self._dirs, self.low, self.high, self.left, self.right = [], [], [], [], []
        for tree in range(trees):
            self.roots.append(self._grow(sample, rng, leaf, spill, reach, tree))
        self.dirs = np.array(self._dirs).reshape(-1, self.dim)
        del self._dirs

    def _grow(self, rows: np.ndarray, rng, leaf: int, spill: float, reach: float, tree: int) -> int:
        found = self._split(rows, rng, spill, reach) if len(rows) > leaf else None
        if found is None:
            self.tree_of.append(tree)
            self.n_leaves += 1
            return -self.n_leaves
        direction, low, high, goes_left, goes_right = found
        node = len(self._dirs)
        self._dirs.append(direction)
        for column, v in zip((self.low, self.high, self.left, self.right), (low, high, 0, 0)):
            column.append(v)
        self.left[node] = self._grow(rows[goes_left], rng, leaf, spill, reach, tree)
        self.right[node] = self._grow(rows[goes_right], rng, leaf, spill, reach, tree)
        return node

    @staticmethod
    def _split(rows: np.ndarray, rng, spill: float, reach: float):
        """Direction, spill zone and sides; None where each direction tried sends too many rows both ways."""
        for _ in range(TRIES):
            direction = rng.standard_normal(rows.shape[1])
            at = rows @ direction
            split = rng.uniform(0.4, 0.6)
            low, middle, high = np.quantile(at, [split - spill, split, split + spill])
            low, high = min(low, middle - reach), max(high, middle + reach)
            goes_left, goes_right = at <= high, at >= low
            if goes_left.sum() + goes_right.sum() <= (1 + 2 * spill + BOTH) * len(rows):
                return direction, low, high, goes_left, goes_right
        return None

    def leaves(self, rows: np.ndarray) -> list[list[int]]:
        """Sorted leaf numbers of each row, over all trees."""
        out: list[list[int]] = [[] for _ in range(len(rows))]
        todo = [(root, np.arange(len(rows))) for root in self.roots]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                for i in at:
                    out[i].append(-node - 1)
                continue
            place = rows[at] @ self.dirs[node]
            todo.append((self.left[node], at[place <= self.high[node]]))
            todo.append((self.right[node], at[place >= self.low[node]]))
        return [sorted(x) for x in out]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaling by the largest component first avoids overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def read_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, x, key): x in doubles; key tells equal vectors, null if the row links with nothing."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    some = F.exists("x", lambda v: v != 0)
    good = F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))
    key = F.sha2(F.concat_ws(",", F.transform("x", lambda v: (v + F.lit(0.0)).cast("string"))), 256)
    return rows.withColumn("key", F.when(good, key))


def fit_forests(classes: DataFrame, sample: int = SAMPLE, **options) -> dict[int, Forest]:
    """One forest per vector length, fitted on at most `sample` classes."""
    drawn = classes.orderBy(F.xxhash64("key"), "key").limit(sample).select("x").toArrow()  # bounded
    by_length: dict[int, list] = {}
    for row in drawn.column("x").to_pylist():
        by_length.setdefault(len(row), []).append(row)
    return {d: Forest(_unit(np.array(rows)), **options) for d, rows in by_length.items()}


def _find_leaves(classes: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """Adds the unit vector and the leaves. A length that the sample lacks has one leaf of its own."""
    sent = classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.array([len(v) for v in batch.column(3)])
            for d in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == d))
                part = batch.take(at)
                rows = _unit(_matrix(part.column(3)))
                forest = sent.value.get(int(d))
                leaves = forest.leaves(rows) if forest else [[-1]] * len(rows)
                unit = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), int(d)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([int(d)] * len(rows), pa.int32()), unit, pa.array(leaves, pa.list_(pa.int32()))],
                    ["node", "label", "size", "dim", "x", "leaves"],
                )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "label", "size", "x").mapInArrow(
        run, f"node long, label {label}, size long, dim int, x array<double>, leaves array<int>"
    )


def _compare(least: float):
    """Function over one block pair: (node, links, near) for each class with a link in it."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        size = table.column("size").to_numpy()
        leaf = table.column("leaf")[0].as_py()
        x = _matrix(table.column("x").combine_chunks())
        leaves = _padded(table.column("leaves").to_pylist())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inner = not len(b)
        b = a if inner else b
        links, group = np.zeros(len(node), np.int64), np.arange(len(node))
        step = max(1, (2 << 20) // max(1, len(b)))
        for s in range(0, len(a), step):
            rows = a[s : s + step]
            dots = x[rows] @ x[b].T
            i, j = np.nonzero(dots >= least - 1e-9)
            p, q, dot = rows[i], b[j], dots[i, j]
            new = p < q if inner else np.ones(len(p), bool)
            close = np.flatnonzero(new & (np.abs(dot - least) <= 1e-9))
            new[close] = [float(np.dot(x[p[k]], x[q[k]])) >= least for k in close]
            p, q = p[new], q[new]
            first = ~_met_before(leaves, p, q, leaf)  # else counted in an earlier leaf
            p, q = p[first], q[first]
            np.add.at(links, p, size[q])
            np.add.at(links, q, size[p])
            group = _joined(group, p, q)
        linked = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[linked]), "links": pa.array(links[linked]), "near": pa.array(node[group[linked]])})

    return run


def _joined(group: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Groups after joining those of p and q; each member points at the least of its group."""
    while True:
        a, b = group[p], group[q]
        apart = a != b
        if not apart.any():
            return group
        np.minimum.at(group, np.maximum(a, b)[apart], np.minimum(a, b)[apart])  # first members only
        while (group[group] != group).any():
            group = group[group]


def _padded(lists: list[list[int]]) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), -2, np.int64)
    for row, leaves in zip(out, lists):
        row[: len(leaves)] = leaves
    return out


def _met_before(leaves: np.ndarray, p: np.ndarray, q: np.ndarray, leaf: int) -> np.ndarray:
    """True where rows p and q share a leaf of a lower number."""
    out = np.zeros(len(p), bool)
    for s in range(0, len(p), 8192):
        a, b = leaves[p[s : s + 8192]][:, :, None], leaves[q[s : s + 8192]][:, None, :]
        out[s : s + 8192] = ((a == b) & (a < leaf) & (a != -2)).any(axis=(1, 2))
    return out


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    sample: int = SAMPLE,
    block: int = BLOCK,
    **options,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors of the same label link when their cosine in double precision is at least `least` and they
    share a leaf of the forest; no pair below links. Labels that are null, and vectors that are
    null, empty, zero or hold null or non-finite components, link with nothing; vectors of
    different lengths never link. component_id is the least vec_id reached, kept tells whether it is
    the row's own. Repeated rows are further copies and count as links; rows without an id take
    part, and their component_id is null if no member has an id. An empty table gives no rows.
    `options` go to the Forest.

    A leaf with more classes of a label than `block` is cut into blocks that are compared pair
    by pair in tasks of their own, so its members all meet and no task holds more than two blocks.
    """
    rows = materialise(read_vectors(vectors, vec_id, vector, label))
    good = rows.where("key is not null")
    classes = good.groupBy("label", "key").agg(
        F.first("x").alias("x"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("min_id")
    )
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by the write
    options = {"reach": math.sqrt(max(0.0, 2 - 2 * least)) / 2} | options  # half the distance of the farthest link
    placed = materialise(_find_leaves(classes, fit_forests(classes, sample, **options)))
    spots = placed.select("node", "label", "dim", F.explode("leaves").alias("leaf"))
    sizes = spots.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialise(sizes.withColumn("grid", F.ceil(F.col("n") / F.lit(block / 2)).cast("int")))

    # Block i of a leaf meets block j >= i in the group (i, j); half-full blocks leave room for
    # uneven hashing.
    spots = placed.withColumn("leaf", F.explode("leaves")).join(small_side(sizes), ["label", "dim", "leaf"])
    own = F.pmod(F.xxhash64("node"), F.col("grid")).cast("int")
    spots = spots.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    spots = spots.select(
        "label", "dim", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "node", "size", "x", "leaves",
    )
    found = spots.groupBy("label", "dim", "leaf", "i", "j").applyInArrow(_compare(least), "node long, links long, near long")
    found = materialise(found)
    roots = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))

    named = classes.drop("x").join(small_side(materialise(roots)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = named.join(groups, "root").join(links, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("size") - 1
    named = materialise(named.select("label", "key", n_links.cast("long").alias("n_links"), "component_id"))
    linked = good.select("vec_id", "label", "key").join(named, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
