"""Soft-DTW clustering against plain loops, and seeding in logarithmic passes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.operators import clustering as C
from frameweave.operators import sequence_clustering as S


def plain_dtw(a, b, gamma):
    r = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            before = [r.get(p, math.inf) for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1))]
            low = min(before)
            soft = low - gamma * math.log(sum(math.exp(-(v - low) / gamma) for v in before))
            r[i, j] = float(((a[i - 1] - b[j - 1]) ** 2).sum()) + soft
    return r[len(a), len(b)]


def sequences(n, seed, lengths=(5,)):
    rng = np.random.default_rng(seed)
    shapes = [np.sin(np.arange(9) * f)[:, None] * [1.0, 0.5] * s for f, s in ((0.3, 3), (1.2, 2), (2.2, 4))]
    out = []
    for i in range(n):
        size = int(rng.choice(lengths))
        out.append((i, (shapes[rng.integers(3)][:size] + rng.normal(size=(size, 2)) * 0.3).tolist()))
    return out


SCHEMA = "id long, x array<array<double>>"


def test_labels_equal_a_plain_version(spark):
    rows = sequences(200, 1)
    x = [np.array(v) for _, v in rows]
    begin = [x[0], x[1], x[2]]
    centres, done = [c.copy() for c in begin], 0
    for done in range(1, 7):
        label = [int(np.argmin([plain_dtw(v, c, 0.1) for c in centres])) for v in x]
        new = [np.mean([v for v, j in zip(x, label) if j == g], axis=0) for g in range(3)]
        shift = sum(np.linalg.norm(a - b) for a, b in zip(new, centres))
        centres = new
        if shift**2 < 1e-4:
            break
    label = [int(np.argmin([plain_dtw(v, c, 0.1) for c in centres])) for v in x]
    table = spark.createDataFrame([*rows, (900, None), (901, [])], SCHEMA).repartition(5)
    fit = S.sequence_kmeans(table, "id", "x", 3, gamma=0.1, start=begin, max_iter=6)
    assert fit.iterations == done and all(np.allclose(a, b) for a, b in zip(fit.centres, centres))
    got = {r.id: r for r in fit.labels.collect()}
    assert [got[i].label for i in range(200)] == label and len(got) == 200
    assert fit.inertia == pytest.approx(sum(plain_dtw(v, centres[j], 0.1) for v, j in zip(x, label)))
    again = {r.id: r.label for r in S.predict_sequences(table, "id", "x", fit.centres, 0.1).collect()}
    assert again == {i: r.label for i, r in got.items()}


def test_gradient():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(4, 5, 2)), rng.normal(size=(3, 2))
    value, gradient = S.soft_dtw_gradient(a, b, 0.5)
    assert np.allclose(value, [plain_dtw(v, b, 0.5) for v in a])
    for i in range(3):
        for d in range(2):
            step = np.zeros_like(b)
            step[i, d] = 1e-6
            up, down = (sum(plain_dtw(v, b + s, 0.5) for v in a) for s in (step, -step))
            assert gradient[i, d] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_barycentres_of_unequal_lengths(spark):
    table = spark.createDataFrame(sequences(120, 2, (4, 5, 7)), SCHEMA)
    with pytest.raises(ValueError):
        S.sequence_kmeans(table, "id", "x", 2, update="median")
    first = S.sequence_kmeans(table, "id", "x", 3, gamma=0.5, update="barycentre", max_iter=1, rate=0.0)
    fit = S.sequence_kmeans(table, "id", "x", 3, gamma=0.5, update="barycentre", max_iter=12, rate=0.05)
    assert fit.inertia < 0.9 * first.inertia and fit.labels.count() == 120
    few = S.sequence_kmeans(table.where("id < 2"), "id", "x", 3, gamma=0.5, update="barycentre", max_iter=2)
    assert len(few.centres) == 2 and few.labels.count() == 2


def test_parallel_seeding(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 4)) * 8
    rows = [(i % 2, i, (middles[i % 12] + rng.normal(size=4)).tolist()) for i in range(1800)]
    p = spark.createDataFrame([*rows, (9, 5000, [0.0] * 4), (9, 5001, [1.0] * 4)], "g long, id long, x array<double>")

    def inertia(init, seed):
        fit = C.kmeans(p, "g", "id", "x", 6, init=init, distance="sql2", max_iter=8, seed=seed)
        assert fit.labels.count() == 1802
        return fit.inertia.agg(F.sum("inertia")).first()[0]

    serial, parallel = (min(inertia(init, s) for s in (1, 2)) for init in ("k-means++", "k-means||"))
    assert parallel <= 1.05 * serial
