"""Whitening of embeddings from exact polarised sums of squares.

1. Every entry becomes a whole number x. One pass gives the number of vectors n and the sums S.
2. A second pass adds up, as whole numbers of any size, the squares of d_i = n*x_i - S_i for every
   dimension and of d_i + d_j for every pair. No product of two different dimensions is formed: as
   (d_i + d_j)^2 = d_i^2 + d_j^2 + 2 d_i d_j, differences of these sums give n^3 times twice each
   cross-covariance without rounding (polarisation).
3. One task per vector length assembles the covariance and takes its eigenvectors.
4. Vectors are projected in slices; a pass over the projections measures how far their covariance
   is from the identity.

Tasks emit d*(d+1)/2 sums each, whatever their rows; only means and the kept components (at most
`keep` times d numbers per vector length) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Components returned for each vector at most.
KEEP = 32
#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no exact whole number of 64 bits and count as not finite.
LARGEST = float(1 << 55)
#: Vectors that are held as numbers at once.
SLICE = 1024
#: Columns of the result.
OUT = {
    "vec_id": "long", "component": "int", "n": "long", "deviation": "decimal(38,0)",
    "whitened": "double", "explained": "double", "identity_error": "double",
}
#: Components whose variance is below this share of the largest have none but rounding.
FLAT = 1e-13

_LIMB = 21
_PART = 10**30  # exact sums travel as two decimals, quotient and remainder by this
_DECIMAL = pa.decimal128(38, 0)


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, x) of usable rows: no null vector, no null, non-finite or too large entry, not empty."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c"))
    good = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST)))
    rows = rows.where(good & (F.size("c") > 0))
    x = F.transform("c", lambda v: F.floor(v * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    return rows.select("vec_id", F.size("c").alias("dim"), x.alias("x"))


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, matrix) of at most SLICE rows of one vector length; column `at` holds the vectors."""
    for batch in batches:
        lengths = np.diff(batch.column(at).offsets.to_numpy()) if batch.num_rows else np.array([], int)
        for dim in np.unique(lengths).tolist():
            where = np.flatnonzero(lengths == dim)
            for s in range(0, len(where), SLICE):
                part = batch.take(pa.array(where[s : s + SLICE]))
                yield dim, part, np.asarray(part.column(at).flatten()).reshape(-1, dim)


def first_sums(rows: DataFrame) -> DataFrame:
    """(dim, i, n, s): vectors of each length, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for dim, _, x in _slices(batches, 0):
            total = found.setdefault(dim, [0, [0] * dim])
            total[0] += len(x)
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total[1] = [t + (h << 32) + l for t, h, l in zip(total[1], high, low)]
        for dim, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(sums, _DECIMAL)],
                ["dim", "i", "n", "s"],
            )

    each = rows.select("x").mapInArrow(run, "dim int, i int, n long, s decimal(38,0)")
    return each.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


@dataclass
class Centre:
    """Means of the vectors of one length as whole part and remainder: S = n * base + rest."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S; 64-bit numbers where a sum of two surely fits, else Python's."""
        away = x - self.base
        most = max(1, int(np.abs(away).max(initial=0)))
        if self.n * (most + 1) < 1 << 61:
            return away * self.n - self.rest
        return away.astype(object) * self.n - self.rest.astype(object)

    def means_from(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles, rounded once."""
        return (x - self.base) - self.rest / self.n


def centres(rows: DataFrame) -> dict[int, Centre]:
    """One Centre per vector length."""
    found: dict[int, list] = {}
    for r in first_sums(rows).collect():  # one row per dimension of each length
        found.setdefault(r.dim, []).append((r.i, r.n, int(r.s)))
    out = {}
    for dim, sums in found.items():
        sums.sort()
        n = sums[0][1]
        whole = [divmod(s, n) for _, _, s in sums]
        out[dim] = Centre(n, np.array([w[0] for w in whole], np.int64), np.array([w[1] for w in whole], np.int64))
    return out


def square_sums(a: np.ndarray, axis: int) -> list[int]:
    """Exact sums of squares along `axis` as Python numbers; at most 2^20 terms each."""
    if a.dtype == object:
        return [int(v) for v in (a * a).sum(axis)]
    limbs = []
    while np.abs(a).max(initial=0) >= 1 << (_LIMB - 1):
        limbs.append(a & ((1 << _LIMB) - 1))
        a = a >> _LIMB
    limbs.append(a)
    total = [0] * a.shape[1 - axis]
    for p, left in enumerate(limbs):
        for q in range(p, len(limbs)):
            part = (left * limbs[q]).sum(axis).tolist()
            shift = _LIMB * (p + q) + (p != q)
            total = [t + (v << shift) for t, v in zip(total, part)]
    return total


def polarised_sums(rows: DataFrame, known: dict[int, Centre]) -> DataFrame:
    """(dim, i, j, high, low): sum of d_i^2 where i = j, of (d_i + d_j)^2 where i < j."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[list[int]]] = {}
        for dim, _, x in _slices(batches, 0):
            d = sent.value[dim].deviations(x)
            totals = found.setdefault(dim, [[0] * (dim - i) for i in range(dim)])
            for i in range(dim):
                pair = d[:, i : i + 1] + d[:, i:]
                pair[:, 0] = d[:, i]
                totals[i] = [t + v for t, v in zip(totals[i], square_sums(pair, 0))]
        for dim, totals in found.items():
            for i, row in enumerate(totals):
                high, low = zip(*(divmod(v, _PART) for v in row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dim] * len(row), pa.int32()), pa.array([i] * len(row), pa.int32()),
                        pa.array(range(i, dim), pa.int32()), pa.array(high, _DECIMAL), pa.array(low, _DECIMAL),
                    ],
                    ["dim", "i", "j", "high", "low"],
                )

    each = rows.select("x").mapInArrow(run, "dim int, i int, j int, high decimal(38,0), low decimal(38,0)")
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")]
    return each.groupBy("dim", "i", "j").agg(*sums)


def _eigen(known: dict[int, Centre], keep: int):
    """Function over the sums of one vector length: its components as (dim, component, value, explained, vector)."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        n = known[dim].n
        high, low = (table.column(c).to_pylist() for c in ("high", "low"))
        sums = [int(a) * _PART + int(b) for a, b in zip(high, low)]
        i, j = (table.column(c).to_numpy() for c in "ij")
        own = [0] * dim
        for a, b, v in zip(i.tolist(), j.tolist(), sums):
            if a == b:
                own[a] = v
        cov, cube = np.zeros((dim, dim)), n**3
        for a, b, v in zip(i.tolist(), j.tolist(), sums):
            # Whole numbers until one division, which rounds once.
            cov[a, b] = cov[b, a] = v / cube if a == b else (v - own[a] - own[b]) / (2 * cube)
        value, vector = np.linalg.eigh(cov)
        value, vector = value[::-1][:keep], vector.T[::-1][:keep]
        flat = value <= FLAT * max(value[0], 0.0)
        value = np.where(flat, 0.0, value)
        trace = sum(own) / cube
        explained = value / trace if trace > 0 else np.zeros(len(value))
        return pa.table(
            {
                "dim": pa.array([dim] * len(value), pa.int32()),
                "component": pa.array(range(1, len(value) + 1), pa.int32()),
                "value": pa.array(value),
                "explained": pa.array(explained),
                "vector": pa.array(vector.tolist(), pa.list_(pa.float64())),
            }
        )

    return run


@dataclass
class Components:
    """Kept components of one vector length, by falling variance; one without variance has scale nan."""

    centre: Centre
    explained: np.ndarray
    matrix: np.ndarray
    scale: np.ndarray
    error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.means_from(x) @ self.matrix.T * self.scale


def fit(rows: DataFrame, keep: int = KEEP) -> dict[int, Components]:
    """Components of each vector length, with the measured error of the whitened covariance."""
    known = centres(rows)
    sums = polarised_sums(rows, known)
    found = sums.groupBy("dim").applyInArrow(
        _eigen(known, keep), "dim int, component int, value double, explained double, vector array<double>"
    )
    parts: dict[int, list] = {}
    for r in found.collect():  # at most `keep` rows per vector length
        parts.setdefault(r.dim, []).append(r)
    models = {}
    for dim, part in parts.items():
        part.sort(key=lambda r: r.component)
        value = np.array([r.value for r in part])
        scale = np.where(value > 0, 1 / np.sqrt(np.where(value > 0, value, 1.0)), np.nan)
        models[dim] = Components(known[dim], np.array([r.explained for r in part]), np.array([r.vector for r in part]), scale)
    for dim, error in identity_errors(rows, models).items():
        models[dim].error = error
    return models


def identity_errors(rows: DataFrame, models: dict[int, Components]) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened values - identity), by vector length.

    Measured on the values that are returned; components without variance take no part.
    """
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for dim, _, x in _slices(batches, 0):
            z = sent.value[dim].whiten(x)
            total = found.setdefault(dim, [0.0, 0.0])
            total[0] += z.sum(0)
            total[1] += z.T @ z
        for dim, (s, zz) in found.items():
            k = len(s)
            i, j = np.divmod(np.arange(k * (k + 1)), k)  # row k holds the sums
            flat = np.concatenate([zz.ravel(), s])
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(flat), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(flat)],
                ["dim", "i", "j", "v"],
            )

    each = rows.select("x").mapInArrow(run, "dim int, i int, j int, v double")
    grids = {dim: np.zeros((len(m.scale) + 1, len(m.scale))) for dim, m in models.items()}
    for r in each.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():  # at most keep * (keep + 1) a length
        grids[r.dim][r.i, r.j] = r.v
    out = {}
    for dim, grid in grids.items():
        n, good = models[dim].centre.n, ~np.isnan(models[dim].scale)
        mean = grid[-1] / n
        away = (grid[:-1] / n - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(good, good)]
        out[dim] = float(np.abs(away).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: int = KEEP) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1, by falling variance), n,
    deviation decimal(38,0) (sum over dimensions of (n*x - S)^2, exact), whitened, explained,
    identity_error.

    Rows whose vector is null, empty, or holds null, non-finite or too large entries (2^55 and more)
    are left out; an empty table gives no rows. Vectors of each length are fitted on their own.
    Repeated rows count each time, a null id is kept, other columns are not read. A component without
    variance (a constant table, or more components than independent vectors) has whitened null
    and explained 0. A deviation of 38 digits or more, beyond any 64-bit n and entry below 2^30, is null.
    """
    rows = whole_vectors(vectors, vec_id, vector)
    sent = rows.sparkSession.sparkContext.broadcast(fit(rows, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in _slices(batches, 1):
            model = sent.value[dim]
            z, k = model.whiten(x), len(model.scale)
            deviation = [v if v < 10**38 else None for v in square_sums(model.centre.deviations(x), 1)]
            at = pa.array(np.repeat(np.arange(len(x)), k))
            bad = np.isnan(z).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(at), model.centre.n)), pa.array(deviation, _DECIMAL).take(at),
                    pa.array(z.ravel(), mask=bad), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(at), model.error)),
                ],
                list(OUT),
            )

    return rows.select("vec_id", "x").mapInArrow(run, ", ".join(map(" ".join, OUT.items())))


def whitening_report(vectors: DataFrame) -> DataFrame:
    """`whiten` with the deviation as long, null where it needs more than 64 bits."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
