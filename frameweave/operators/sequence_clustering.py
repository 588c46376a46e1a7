"""k-means of sequences under soft-DTW, a distance that is no column expression.

Centres are few short sequences and go to every task. One pass over the sequences assigns each to
its nearest centre and adds up, per task and centre, what the next centres need: the members' sum for
the mean, or the gradient of the members' distances for a barycentre step. Only these sums, k times a
centre's size, leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameweave.functions.hashing import u
from frameweave.operators.clustering import VECTORS, soft_dtw_values
from frameweave.plans.staging import materialise

#: Sequences of one length that are compared with a centre at once.
STACK = 256


def soft_dtw_gradient(a: np.ndarray, b: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft-DTW of a stack of sequences `a` (count, n, dim) with a centre `b` (m, dim), and its gradient by `b`."""
    gap = a[:, :, None, :] - b[None, None, :, :]
    d = (gap**2).sum(axis=3)
    count, n, m = d.shape
    r = np.full((count, n + 2, m + 2), np.inf)
    r[:, 0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            before = np.stack([r[:, i - 1, j - 1], r[:, i - 1, j], r[:, i, j - 1]])
            low = before.min(axis=0)
            r[:, i, j] = d[:, i - 1, j - 1] + low - gamma * np.log(np.exp(-(before - low) / gamma).sum(axis=0))
    value = r[:, n, m].copy()
    # Share of all soft paths that pass a cell, from the end backwards.
    e = np.zeros((count, n + 2, m + 2))
    e[:, n + 1, m + 1] = 1.0
    r[:, :, m + 1], r[:, n + 1, :] = -np.inf, -np.inf
    r[:, n + 1, m + 1] = value
    cost = np.zeros((count, n + 2, m + 2))
    cost[:, 1 : n + 1, 1 : m + 1] = d
    for i in range(n, 0, -1):
        for j in range(m, 0, -1):
            for p, q in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                e[:, i, j] += e[:, p, q] * np.exp((r[:, p, q] - r[:, i, j] - cost[:, p, q]) / gamma)
    return value, -2 * np.einsum("cij,cijd->jd", e[:, 1 : n + 1, 1 : m + 1], gap)


def _distances(x: np.ndarray, centres: list[np.ndarray], gamma: float) -> np.ndarray:
    """(sequences, centres) for a stack of equally long sequences."""
    out = np.empty((len(x), len(centres)))
    for s in range(0, len(x), STACK):
        part = x[s : s + STACK]
        for j, c in enumerate(centres):
            out[s : s + STACK, j] = soft_dtw_values(((part[:, :, None, :] - c[None, None]) ** 2).sum(axis=3), gamma)
    return out


def _stacks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, stack) of the sequences of each length."""
    lengths = np.array([len(v) for v in column])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(at)).flatten()
        yield at, np.asarray(flat.flatten(), dtype=float).reshape(len(at), n, -1)


@dataclass
class SequenceClusters:
    """`centres` by label; `labels`: the id, label, distance; `inertia`; `iterations` done."""

    centres: list[np.ndarray]
    labels: DataFrame
    inertia: float
    iterations: int


def sequence_kmeans(
    sequences: DataFrame,
    row_id: str,
    x: str,
    k: int,
    gamma: float = 0.001,
    update: str = "mean",
    start: list[np.ndarray] | None = None,
    max_iter: int = 10,
    tol: float = 1e-4,
    rate: float = 0.1,
    seed: int = 42,
) -> SequenceClusters:
    """Clusters of sequences (array of vectors) by their soft-DTW to k centres.

    `update="mean"` takes the members' mean, position by position, for sequences of one length (ValueError
    otherwise). `update="barycentre"` moves each centre along the mean gradient of its members'
    distances by `rate`, falling with the iterations, and takes sequences of any lengths. Centres start as
    the k sequences that come first by a seeded hash, or as those nearest to `start`; one that loses all
    members becomes a random sequence. Iterations end after `max_iter` or when the squared sum of
    the centres' shifts is below `tol`. Null and empty sequences are left out; fewer than k
    sequences give fewer centres.
    """
    if update not in ("mean", "barycentre"):
        raise ValueError(f"unknown update {update!r}")
    if k < 1 or max_iter < 1:
        raise ValueError("k and max_iter must be positive")
    rows = sequences.select(F.col(row_id).alias("id"), F.col(x).cast(VECTORS).alias("x")).where(F.size("x") > 0)
    rows = materialise(rows)

    def drawn(n: int, name: str) -> list[np.ndarray]:
        got = rows.orderBy(u(name, "id"), "id").limit(n).select("x").collect()  # k at most
        return [np.array(r.x) for r in got]

    centres = drawn(k, str(seed))
    if start is not None:
        centres = _nearest_sequences(rows, start, gamma)
    done = 0
    for done in range(1, max_iter + 1):
        sums = _pass(rows, centres, gamma, update)
        new = []
        fresh = drawn(k, f"{seed}/{done}") if any(j not in sums for j in range(len(centres))) else []
        for j, old in enumerate(centres):
            if j not in sums:
                new.append(fresh[j % len(fresh)])
                continue
            n, total = sums[j]
            new.append(total / n if update == "mean" else old - rate / done**0.5 * total / n)
        shift = sum(np.linalg.norm(a - b) if a.shape == b.shape else np.inf for a, b in zip(new, centres))
        centres = new
        if shift**2 < tol:
            break
    labels = materialise(_label(rows, centres, gamma).withColumnRenamed("id", row_id))
    inertia = labels.agg(F.sum("distance")).first()[0] or 0.0
    return SequenceClusters(centres, labels, inertia, done)


def _label(rows: DataFrame, centres: list[np.ndarray], gamma: float) -> DataFrame:
    """(id, label, distance): the nearest centre, of equals the first."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, x in _stacks(batch.column(1)):
                d = _distances(x, sent.value, gamma)
                label[at], away[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(away)], ["id", "label", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, label long, distance double")


def predict_sequences(sequences: DataFrame, row_id: str, x: str, centres: list[np.ndarray], gamma: float = 0.001) -> DataFrame:
    """`row_id`, label, distance of each sequence under given centres."""
    rows = sequences.select(F.col(row_id).alias("id"), F.col(x).cast(VECTORS).alias("x")).where(F.size("x") > 0)
    return _label(rows, centres, gamma).withColumnRenamed("id", row_id)


def _nearest_sequences(rows: DataFrame, start: list[np.ndarray], gamma: float) -> list[np.ndarray]:
    """The sequence nearest to each of `start`, of equals the one of the least id."""
    out = []
    for c in start:
        near = _label(rows, [np.asarray(c, float)], gamma).orderBy("distance", "id").limit(1)
        out += [np.array(r.x) for r in rows.join(F.broadcast(near), "id").limit(1).collect()]
    return out


def _pass(rows: DataFrame, centres: list[np.ndarray], gamma: float, update: str) -> dict[int, tuple[int, np.ndarray]]:
    """Members and summed sequences or gradients of each centre that has members."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in _stacks(batch.column(0)):
                label = _distances(x, sent.value, gamma).argmin(axis=1)
                for j in np.unique(label).tolist():
                    mine, centre = x[label == j], sent.value[j]
                    if update == "mean":
                        if mine.shape[1:] != centre.shape:
                            raise ValueError("the mean needs sequences of one length; use update='barycentre'")
                        part = mine.sum(axis=0)
                    else:
                        steps = range(0, len(mine), STACK)
                        part = sum(soft_dtw_gradient(mine[s : s + STACK], centre, gamma)[1] for s in steps)
                    total = held.setdefault(j, [0, 0.0])
                    total[0], total[1] = total[0] + len(mine), total[1] + part
        for j, (n, total) in held.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * len(flat), pa.int64()), pa.array(range(len(flat)), pa.int64()), pa.array([n] * len(flat), pa.int64()), pa.array(flat)],
                ["label", "place", "n", "total"],
            )

    parts = rows.select("x").mapInArrow(run, "label long, place long, n long, total double")
    sums = parts.groupBy("label", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # the centres' size
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in sums:
        out.setdefault(r.label, (r.n, np.zeros(centres[r.label].size)))[1][r.place] = r.total
    return {j: (n, total.reshape(centres[j].shape)) for j, (n, total) in out.items()}
