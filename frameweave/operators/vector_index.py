"""A stored inverted-file index: vectors in one folder per coarse cell, searched cell by cell.

Cell centres are fitted on a bounded sample; every row goes to its nearest centre. A search reads only
the folders of the cells it visits: the nearest `probes` of each query first, and then, for an exact
result, the cells that could still hold something nearer than what was found, by the cells' radii and
the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameweave.functions.vectors import doubles, unit
from frameweave.operators.retrieval import _matrix, _top
from frameweave.plans.ordering import top_rows
from frameweave.plans.staging import materialise, small_side

#: Rows and numbers that centres are fitted on at most, the first by a hash of the id.
SAMPLE, SAMPLE_NUMBERS = 20_000, 1 << 22
#: Rows of a block of a cell (about), and queries that are compared with it in one task (about).
BLOCK, QUERIES = 16_384, 4_096


def fit_centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """At most `cells` centres by k-means on a matrix; an empty one is dropped."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        label, _ = _nearest_centre(x, centres)
        mass = np.bincount(label, minlength=len(centres))
        total = np.stack([np.bincount(label, c, len(centres)) for c in x.T], axis=1)
        centres = total[mass > 0] / mass[mass > 0, None]
    return centres


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and the distance from it."""
    label = np.empty(len(x), int)
    for s in range(0, len(x), 4096):
        label[s : s + 4096] = ((centres**2).sum(axis=1) - 2 * x[s : s + 4096] @ centres.T).argmin(axis=1)
    return label, np.sqrt(((x - centres[label]) ** 2).sum(axis=1))


@dataclass
class VectorIndex:
    """`path` holds centres/ (cell, centre), cells/ (cell, radius, n, blocks; a row per cell and append)
    and rows/cell=c/ (row_id, v, block). Vectors have one length; `metric` is l2 or cosine.
    """

    spark: SparkSession
    path: str
    metric: str = "l2"
    block: int = BLOCK

    def __post_init__(self) -> None:
        if self.metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric {self.metric!r}")

    def _vectors(self, df: DataFrame, row_id: str, vector: str, name: str) -> DataFrame:
        # Of vectors of length 1 the cosine falls as the distance grows.
        values = unit(vector) if self.metric == "cosine" else doubles(vector)
        return df.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias(name), values.alias("v"))

    def create(self, rows: DataFrame, row_id: str, vector: str, cells: int = 256, sample: int = SAMPLE) -> "VectorIndex":
        """Fit the centres on at most `sample` of `rows` and store all of them. Null vectors are left out."""
        rows = self._vectors(rows, row_id, vector, "row_id")
        width = rows.select(F.size("v")).first()
        drawn = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(min(sample, SAMPLE_NUMBERS // max(1, width[0])) if width else 1)
        x = drawn.select("v").toArrow().column("v").combine_chunks()
        centres = fit_centres(_matrix(x), cells) if len(x) else np.zeros((0, 0))
        table = self.spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>")
        table.write.mode("errorifexists").parquet(f"{self.path}/centres")
        return self._store(rows)

    def append(self, rows: DataFrame, row_id: str, vector: str) -> "VectorIndex":
        """Store further rows under the centres as they are; cells grow and may widen."""
        return self._store(self._vectors(rows, row_id, vector, "row_id"))

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres").collect()  # one per cell
        return np.array([r.centre for r in sorted(rows)])

    def _store(self, rows: DataFrame) -> "VectorIndex":
        sent = self.spark.sparkContext.broadcast(self._centres())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, away = _nearest_centre(_matrix(batch.column(1)), sent.value)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], ["row_id", "v", "cell", "away"]
                    )

        placed = materialise(rows.mapInArrow(place, "row_id long, v array<double>, cell int, away double"))
        stats = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
        stats = materialise(stats.withColumn("blocks", F.ceil(F.col("n") / self.block).cast("int")))
        before = self._cells().groupBy("cell").agg(F.sum("blocks").alias("old"))
        spots = stats.select("cell", "blocks").join(before, "cell", "left")
        # A cell is written by as many tasks as it has blocks.
        own = F.coalesce("old", F.lit(0)) + F.pmod(F.xxhash64("row_id"), "blocks")
        rows = placed.join(F.broadcast(spots), "cell").select("row_id", "v", own.cast("int").alias("block"), "cell")
        rows.repartition("cell", "block").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        stats.coalesce(1).write.mode("append").parquet(f"{self.path}/cells")
        return self

    def _cells(self) -> DataFrame:
        schema = "cell int, radius double, n long, blocks int"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cells")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """Stored rows; of `cells` only their folders are read."""
        schema = "row_id long, v array<double>, block int, cell int"
        table = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        return table if cells is None else table.where(F.col("cell").isin(cells))

    def search(
        self, queries: DataFrame, k: int, query_id: str, vector: str, probes: int = 4, exact: bool = True, skip_self: bool = False
    ) -> DataFrame:
        """`k` nearest rows of each query: query_id, row_id, score (smaller is nearer), rank; ties by row_id.

        With `exact` nothing nearer is missed; else only the `probes` nearest cells of each query are
        looked at. Null query vectors find nothing.
        """
        asked = materialise(self._vectors(queries, query_id, vector, "query_id").withColumn("limit", F.lit(None).cast("double")))
        total = self._cells().groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("blocks").alias("blocks"))
        found, centres = total.collect(), self._centres()  # one row per cell
        radius, blocks = np.zeros(len(centres)), np.zeros(len(centres), int)
        for r in found:
            radius[r.cell], blocks[r.cell] = r.radius, r.blocks
        cells = (centres, radius, blocks)
        near = self._visit(asked, cells, k, probes, True, skip_self)
        out = near
        if exact:
            last = top_rows(near, ["query_id"], ["score", "row_id"], k).where(F.col("rank") == k)
            limited = asked.drop("limit").join(last.select("query_id", F.col("score").alias("limit")), "query_id", "left")
            out = near.unionByName(self._visit(materialise(limited), cells, k, probes, False, skip_self))
        out = top_rows(out, ["query_id"], ["score", "row_id"], k)
        if self.metric == "cosine":  # |a - b|^2 = 2 (1 - cos)
            out = out.withColumn("score", F.round(F.col("score") * F.col("score") / 2, 12))
        return out

    def _visit(self, asked: DataFrame, cells: tuple, k: int, probes: int, first: bool, skip_self: bool) -> DataFrame:
        """What queries find in their nearest cells, or in all others within `limit` (null: any)."""
        sent = self.spark.sparkContext.broadcast(cells)
        slices = max(1, -(-asked.count() // QUERIES))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius, blocks = sent.value
            for batch in batches:
                if not batch.num_rows or not len(centres):
                    continue
                q = _matrix(batch.column("v"))
                away = np.sqrt(np.maximum(((q[:, None, :] - centres) ** 2).sum(axis=2), 0))
                away = np.where(blocks > 0, away, np.inf)
                rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1, kind="stable")
                limit = batch.column("limit").to_numpy(zero_copy_only=False).astype(float)
                limit = np.where(np.isnan(limit), np.inf, limit)
                within = away - radius <= (limit * (1 + 1e-9) + 1e-9)[:, None]
                i, c = np.nonzero((rank < probes if first else (rank >= probes) & within) & np.isfinite(away))
                times = blocks[c]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                i, c = np.repeat(i, times), np.repeat(c, times)
                for s in range(0, len(i), 4096):
                    part = batch.select(["query_id", "v"]).take(pa.array(i[s : s + 4096]))
                    places = [pa.array(x[s : s + 4096], pa.int32()) for x in (c, block)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *places], ["query_id", "v", "cell", "block"])

        visits = asked.mapInArrow(run, "query_id long, v array<double>, cell int, block int")
        visits = materialise(visits.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices))))
        wanted = materialise(visits.select("cell", "block", "slice").distinct())
        visited = [r.cell for r in wanted.select("cell").distinct().collect()]  # at most the cells
        place = ["cell", "block", "slice"]
        rows = self.rows(visited).join(small_side(wanted), ["cell", "block"])

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["query_id", "row_id", "score"]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
            qids, ids = left.column("query_id").to_numpy(), right.column("row_id").to_numpy()
            queries, matrix = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
            q, r, score = _top(qids, queries, ids, matrix, k, "l2", skip_self)
            return pa.table([pa.array(qids[q]), pa.array(ids[r]), pa.array(score)], names)

        pairs = visits.groupBy(*place).cogroup(rows.groupBy(*place))
        return materialise(pairs.applyInArrow(compare, "query_id long, row_id long, score double"))
