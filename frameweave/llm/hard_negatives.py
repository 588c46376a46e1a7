"""Hard negatives by a cover tree over norm-augmented vectors.

A vector v of squared norm s gets one more component sqrt(M - s), where M is the largest squared
norm, so all lie on a sphere; an anchor gets a 0 there. Then for a node with centre c and covering
radius r (the largest distance from c to a vector below it), every inner product with an anchor q
below the node lies between q.c - |q| r and q.c + |q| r, and as the distance from q is at least
D = |q - c| - r, it is at most (|q|^2 + M - D^2) / 2 too.

* **Index.** The tree's top is fitted on a bounded sample; its leaves are the cells. Every vector goes
  to the nearest cell centre, covering radii are measured over all vectors, and cells are stored in
  blocks of bounded size. A task that reads a block grows the lower levels of the tree over it.
* **Search.** A query asks for the k best rows in each of some score windows. Each query first goes to
  the cells with the highest bounds; what it finds there raises its windows' lower ends, and then
  it goes to all other cells whose bounds reach a window. Inside a block it descends best first,
  skips nodes outside its windows and verifies leaves exactly. No row inside a window is missed.

The positives are a search with the anchor's own label, the negatives one with other labels and a
window for each positive.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.plans.ordering import order_rows, top_rows
from frameweave.plans.staging import materialise, small_side

#: Vectors and numbers that the top of the tree is fitted on at most, the first by a hash.
SAMPLE, SAMPLE_NUMBERS = 32_768, 1 << 21
#: Children of a node at most, sample vectors in a cell, vectors in a leaf below it.
FANOUT, CELL, LEAF = 16, 64, 256
#: Vectors in a block (twice as many at most), and queries that visit it together.
BLOCK, QUERIES = 8_192, 4_096
#: Cells that a query visits before its windows are narrowed.
FIRST = 2
#: Squared norms (of whole numbers) from which on a score might need more than 64 bits.
LARGEST = float(1 << 55)

_LOW, _HIGH = -(1 << 62), 1 << 62


# ---- the tree -----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as arrays. `low` and `high` delimit a node's rows in `order`; leaves have no children.

    A parent has a lower number than its children; `centre` is a row number, `radius` the largest
    distance from it to a row of the node.
    """

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list[list[int]]


def grow(points: np.ndarray, leaf: int, fanout: int = FANOUT) -> Tree:
    """Cover tree of the rows: from level to level, centres are added farthest first until the radius
    has halved or a node has `fanout` children; every row goes to its nearest centre.

    The first child keeps its parent's centre. Equal rows are never split, so a leaf of one point may
    hold any number of them.
    """
    order = np.arange(len(points))
    centre, radius, low, high, children = [], [], [], [], []

    def node(c: int, r: float, a: int, b: int) -> int:
        for column, v in zip((centre, radius, low, high, children), (c, r, a, b, [])):
            column.append(v)
        return len(centre) - 1

    if len(points):
        away = _distances(points, points[0])
        todo = [(node(0, float(away.max()), 0, len(points)), away)]
    else:
        todo = []
    while todo:
        at, away = todo.pop()
        a, b = low[at], high[at]
        if b - a <= leaf or radius[at] == 0:
            continue
        rows = order[a:b].copy()
        chosen, nearest, owner = [centre[at]], away.copy(), np.zeros(b - a, int)
        while len(chosen) < fanout and nearest.max() > radius[at] / 2:
            new = int(nearest.argmax())
            d = _distances(points[rows], points[rows[new]])
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(chosen)
            chosen.append(int(rows[new]))
        sort = np.argsort(owner, kind="stable")
        order[a:b] = rows[sort]
        ends = np.cumsum(np.bincount(owner, minlength=len(chosen)))
        for c, s, e in zip(chosen, np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            if e > s:
                part = nearest[sort[s:e]]
                child = node(c, float(part.max()), a + s, a + e)
                children[at].append(child)
                todo.append((child, part))
    return Tree(points, order, np.array(centre, int), np.array(radius), np.array(low, int), np.array(high, int), children)


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(axis=1))


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that brings them to squared norm `most`."""
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]])


def reach(dots: np.ndarray, radius: np.ndarray, size, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of a query of squared norm `size` below nodes of these radii,
    from its inner products with their centres; widened by more than rounding can amount to.
    """
    radius = radius * (1 + 1e-9) + 1e-6 * np.sqrt(most)
    away = np.sqrt(size) * radius
    apart = np.sqrt(np.maximum(size + most - 2 * dots, 0))
    from_distance = (size + most - np.maximum(apart - radius, 0) ** 2) / 2
    slack = 1 + 1e-9 * (np.abs(dots) + away + most)
    return dots - away - slack, np.minimum(dots + away, from_distance) + slack


# ---- tables -------------------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(row, vec_id, label, x, dim) of the rows that take part; x in whole numbers."""
    c = F.transform(F.col(vector), lambda v: v.cast("double") * F.lit(float(scale)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), c.alias("c"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST))) & (F.size("c") > 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    rows = rows.withColumn("x", F.transform("c", lambda v: F.floor(v).cast("long")))
    size = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return rows.where(size < F.lit(LARGEST)).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x", F.size("x").alias("dim")
    )


@dataclass
class Top:
    """Cells of one vector length: augmented centres, measured radii, smallest and largest label, blocks."""

    most: float
    centres: np.ndarray
    radius: np.ndarray | None = None
    labels: np.ndarray | None = None
    blocks: np.ndarray | None = None


@dataclass
class Index:
    """`rows` holds the blocks (cell and block beside each row); `tops` one Top per vector length."""

    rows: DataFrame
    tops: dict[int, Top]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, x) by vector length, at most 2,048 rows at once."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            where = np.flatnonzero(dims == dim)
            for s in range(0, len(where), 2048):
                part = batch.take(pa.array(where[s : s + 2048]))
                yield dim, part, _matrix(part.column("x"), dim)


def build_index(rows: DataFrame, sample: int = SAMPLE, block: int = BLOCK, cell: int = CELL) -> Index:
    """Cells and blocks of all `rows`; the top is fitted on at most `sample` of them.

    A cell holds `cell` sample rows, or more where that would leave it far below a block of rows.
    """
    size = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    lengths = rows.groupBy("dim").agg(F.max(size).alias("most"), F.count(F.lit(1)).alias("n")).collect()  # one row a length
    most = {r.dim: r.most for r in lengths}
    hashed = rows.select("dim", "x", F.xxhash64("x").alias("h"), "row").orderBy("h", "row")
    take = max(1, min(sample, SAMPLE_NUMBERS // max(most, default=1)))
    drawn = hashed.limit(take).select("dim", "x").toArrow()
    cell = max(cell, take * block // (2 * max(take, sum(r.n for r in lengths))))
    tops = {}
    for dim, m in most.items():
        mine = [v for d, v in zip(drawn.column("dim").to_pylist(), drawn.column("x").to_pylist()) if d == dim]
        # A length that the sample lacks has one cell around zero.
        points = augmented(np.array(mine or [[0] * dim]), m)
        tree = grow(points, cell)
        leaves = [i for i, c in enumerate(tree.children) if not c]
        tops[dim] = Top(m, points[tree.centre[leaves]])
    sent = rows.sparkSession.sparkContext.broadcast(tops)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in _by_dim(batches):
            top = sent.value[dim]
            points = augmented(x, top.most)
            cells = (top.centres @ points.T * -2 + (top.centres**2).sum(axis=1)[:, None]).argmin(axis=0)
            away = np.sqrt(((points - top.centres[cells]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(cells, pa.int32()), pa.array(away)], ["row", "vec_id", "label", "x", "dim", "cell", "away"]
            )

    placed = materialise(
        rows.mapInArrow(place, "row long, vec_id long, label long, x array<long>, dim int, cell int, away double")
    )
    stats = placed.groupBy("dim", "cell").agg(
        F.max("away").alias("radius"), F.min("label").alias("least"), F.max("label").alias("largest"), F.count(F.lit(1)).alias("n")
    )
    for top in tops.values():
        k = len(top.centres)
        top.radius, top.blocks, top.labels = np.zeros(k), np.zeros(k, np.int32), np.zeros((k, 2), np.int64)
    for r in stats.collect():  # one row per cell
        top = tops[r.dim]
        top.radius[r.cell], top.blocks[r.cell], top.labels[r.cell] = r.radius, -(-r.n // block), (r.least, r.largest)
    sent = rows.sparkSession.sparkContext.broadcast({d: t.blocks for d, t in tops.items()})

    @F.arrow_udf("int")
    def blocks_of(dim: pa.Array, cell: pa.Array) -> pa.Array:
        return pa.array([sent.value[d][c] for d, c in zip(dim.to_pylist(), cell.to_pylist())], pa.int32())

    own = F.pmod(F.xxhash64("row"), blocks_of("dim", "cell")).cast("int")
    return Index(placed.select("row", "vec_id", "label", "x", "dim", "cell", own.alias("block")), tops)


# ---- searching ----------------------------------------------------------------------------------

#: A query: its row (not found itself), group of queries that go together, label and windows of scores.
_QUERY = {"row": "long", "slice": "long", "label": "long", "x": "array<long>", "dim": "int", "low": "array<long>", "high": "array<long>"}
_PLACE = ["dim", "cell", "block", "slice"]


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(map(" ".join, columns.items()))


def _visits(index: Index, queries: DataFrame, same: bool, first: bool) -> DataFrame:
    """`queries` once for each block to visit: of the FIRST best cells, or of all others that reach a window."""
    sent = queries.sparkSession.sparkContext.broadcast(index.tops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in _by_dim(batches):
            top, q = sent.value[dim], x.astype(float)
            least, largest = reach(q @ top.centres[:, :-1].T, top.radius, (q * q).sum(axis=1)[:, None], top.most)
            label = part.column("label").to_numpy()[:, None]
            if same:
                some = (top.labels[:, 0] <= label) & (label <= top.labels[:, 1])
            else:
                some = (top.labels[:, 0] != label) | (top.labels[:, 1] != label)
            some &= top.blocks > 0
            # The order depends on labels and bounds alone, so both visits split the cells alike.
            rank = np.argsort(np.argsort(np.where(some, -largest, np.inf), axis=1, kind="stable"), axis=1, kind="stable")
            meets = np.zeros_like(some)
            for i, windows in enumerate(zip(part.column("low").to_pylist(), part.column("high").to_pylist())):
                for a, b in zip(*windows):
                    meets[i] |= (largest[i] >= a) & (least[i] <= b)
            i, c = np.nonzero(some & meets & ((rank < FIRST) == first))
            times = top.blocks[c]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            i, c = np.repeat(i, times), np.repeat(c, times)
            for s in range(0, len(i), 4096):
                columns = part.select(list(_QUERY)).take(pa.array(i[s : s + 4096])).columns
                places = [pa.array(v[s : s + 4096], pa.int32()) for v in (c, block)]
                yield pa.RecordBatch.from_arrays([*columns, *places], [*_QUERY, "cell", "block"])

    return queries.select(*_QUERY).mapInArrow(run, _ddl(_QUERY | {"cell": "int", "block": "int"}))


class _Best:
    """The k best rows of each window of a query; a full window's lower end rises to its last score."""

    def __init__(self, low: list[int], high: list[int], k: int):
        self.windows = [[a, b] for a, b in zip(low, high)]
        self.k, self.found = k, [[] for _ in low]

    def meets(self, least: float, largest: float) -> bool:
        return any(largest >= a and least <= b and a <= b for a, b in self.windows)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for (a, b), found, window in zip(list(self.windows), self.found, self.windows):
            at = np.flatnonzero((scores >= a) & (scores <= b))
            if len(at) > self.k:
                at = at[np.lexsort((rows[at], ids[at], -scores[at]))[: self.k]]
            if len(at):
                found += zip((-scores[at]).tolist(), ids[at].tolist(), rows[at].tolist())
                found.sort()
                del found[self.k :]
                if len(found) == self.k:
                    window[0] = max(a, -found[-1][0])


class _Block:
    """A block's rows in the order of its tree."""

    def __init__(self, table: pa.Table, most: float, leaf: int):
        dim = table.column("dim")[0].as_py()
        x = _matrix(table.column("x").combine_chunks(), dim)
        points = augmented(x, most)
        self.tree, self.most = grow(points, leaf), most
        order = self.tree.order
        # Whole numbers below 2^53 are exact in doubles.
        self.x = (x.astype(float) if most < 1 << 53 else x)[order]
        self.row, self.id, self.label = (table.column(c).to_numpy()[order] for c in ("row", "vec_id", "label"))
        self.centres = points[self.tree.centre][:, :-1]

    def descend(self, q: np.ndarray, row: int, label: int, same: bool, best: _Best) -> int:
        """Best-first search of one query; returns the number of vectors verified."""
        tree, exact, verified = self.tree, q.astype(self.x.dtype), 0
        q = q.astype(float)
        least, largest = reach(self.centres @ q, tree.radius, float(q @ q), self.most)
        least, largest = least.tolist(), largest.tolist()
        heap = [(-largest[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not best.meets(least[node], largest[node]):
                continue
            for child in tree.children[node]:
                if best.meets(least[child], largest[child]):
                    heapq.heappush(heap, (-largest[child], child))
            if not tree.children[node]:
                part = slice(tree.low[node], tree.high[node])
                scores = (self.x[part] @ exact).astype(np.int64)
                verified += len(scores)
                lowest, highest = min(a for a, _ in best.windows), max(b for _, b in best.windows)
                fair = (scores >= lowest) & (scores <= highest) & ((self.label[part] == label) == same) & (self.row[part] != row)
                at = np.flatnonzero(fair)
                if len(at):
                    best.add(scores[at], self.id[part][at], self.row[part][at])
        return verified


_FOUND = {"row": "long", "slot": "int", "score": "long", "vec_id": "long", "found": "long"}


def _search_block(tops: dict[int, float], k: int, same: bool, leaf: int):
    """Function over the queries and the rows of one block: what each query finds there."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            dim = rows.column("dim")[0].as_py()
            block = _Block(rows, tops[dim], leaf)
            q = _matrix(queries.column("x").combine_chunks(), dim)
            each = zip(q, *(queries.column(c).to_pylist() for c in ("row", "label", "low", "high")))
            for x, row, label, low, high in each:
                best = _Best(low, high, k)
                block.descend(x, row, label, same, best)
                out += [(row, slot, -s, i, f) for slot, found in enumerate(best.found) for s, i, f in found]
        columns = zip(*out) if out else [[]] * len(_FOUND)
        types = [pa.int32() if t == "int" else pa.int64() for t in _FOUND.values()]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], list(_FOUND))

    return run


def search(index: Index, queries: DataFrame, k: int, same: bool, leaf: int = LEAF) -> DataFrame:
    """(row, slot, rank, score, vec_id, found): for each query and window the k best rows in it.

    `queries` are of the form _QUERY; slot numbers the windows from 0 and found is the row number of what
    was found. Rows have the query's label if `same`, another one otherwise. Higher scores come first,
    ties by smaller vec_id, and the result is exact.
    """
    tops = {d: t.most for d, t in index.tops.items()}

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        visits = materialise(_visits(index, queries, same, first))
        # A block is copied once for each group of queries that visits it.
        wanted = materialise(visits.select(*_PLACE).distinct())
        rows = index.rows.join(small_side(wanted), _PLACE[:3])
        pairs = visits.groupBy(*_PLACE).cogroup(rows.groupBy(*_PLACE))
        found = pairs.applyInArrow(_search_block(tops, k, same, leaf), _ddl(_FOUND))
        return materialise(found)

    order = [F.col("score").desc(), "vec_id", "found"]
    near = visit(queries, True)
    last = top_rows(near, ["row", "slot"], order, k).where(F.col("rank") == k)
    full = last.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("full"))
    raised = F.transform("low", lambda a, i: F.greatest(a, F.coalesce(F.element_at("full", i), a)))
    narrowed = queries.join(full, "row", "left").withColumn("low", F.when(F.col("full").isNull(), F.col("low")).otherwise(raised))
    far = visit(materialise(narrowed.drop("full")), False)
    return top_rows(near.unionByName(far), ["row", "slot"], order, k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    scale: int = 256,
    sample: int = SAMPLE,
    block: int = BLOCK,
    leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * c) and the score of two rows is their inner product. Rows where
    `anchor` (a condition on vec_id, given as a column of that name) holds are anchors. Each one's
    positives are its `positives` best other rows of the same label; for each of them the
    `negatives` best rows of other labels whose score is from least to most percent of the
    positive's are returned, by falling score and then vec_id; none if no row qualifies.

    Rows without an id, a label (a whole number), a vector or one of its components, with components that
    are not finite or an empty vector, or whose squared norm after scaling reaches 2^55, take no part.
    Vectors of different lengths never meet. Repeated rows are rows of their own: a copy of the
    anchor can be its positive, and a repeated anchor repeats its result. Other columns are not
    read. An empty table gives no rows.
    """
    rows = materialise(whole_vectors(vectors, vec_id, vector, label, scale))
    index = build_index(rows, sample, block)
    anchors = index.rows.where(F.coalesce(anchor, F.lit(False)))
    # Neighbouring anchors go together.
    together = order_rows(anchors.drop("block"), [], ["dim", "cell", "row"], "slice").df
    together = materialise(together.withColumn("slice", F.floor(F.col("slice") / QUERIES)))

    ends = {"low": F.array(F.lit(_LOW)), "high": F.array(F.lit(_HIGH))}
    good = materialise(search(index, together.withColumns(ends), positives, True, leaf))
    low = F.ceil(F.col("score").cast("decimal(20,0)") * least / most).cast("long")
    high = F.floor(F.col("score").cast("decimal(20,0)") * most / 100).cast("long")
    windows = good.select("row", F.struct((F.col("rank") - 1).alias("slot"), low.alias("low"), high.alias("high")).alias("w"))
    windows = windows.groupBy("row").agg(F.array_sort(F.collect_list("w")).alias("w"))  # `positives` at most
    asked = together.join(windows, "row").withColumns({"low": F.col("w.low"), "high": F.col("w.high")})
    bad = search(index, materialise(asked.drop("w")), negatives, False, leaf)

    ids = together.select("row", F.col("vec_id").alias("anchor_id"))
    good = good.select("row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bad = bad.select("row", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = bad.join(good, ["row", "slot"]).join(ids, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
