"""Whitening against whole-number brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from frameweave.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) and abs(c) < 2.0**55 for c in v)


def brute(rows):
    """{dim: (ids, whole vectors, exact covariance as Fractions)}"""
    by_dim = {}
    for i, v, *_ in rows:
        if usable(v):
            x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
            by_dim.setdefault(len(x), []).append((i, x))
    out = {}
    for dim, part in by_dim.items():
        n, xs = len(part), [x for _, x in part]
        s = [sum(c) for c in zip(*xs)]
        d = [[n * c - t for c, t in zip(x, s)] for x in xs]
        cov = [[Fraction(sum(r[a] * r[b] for r in d), n**3) for b in range(dim)] for a in range(dim)]
        out[dim] = (part, s, d, cov)
    return out


def check(spark, rows, keep=32):
    got = W.whiten(spark.createDataFrame(rows, SCHEMA), keep=keep).collect()
    want = brute(rows)
    assert len(got) == sum(len(part) * min(keep, dim) for dim, (part, *_) in want.items())
    for dim, (part, s, d, cov) in want.items():
        n, k = len(part), min(keep, dim)
        v = np.array([[float(c) for c in r] for r in cov])
        values = np.linalg.eigvalsh(v)[::-1][:k]
        trace = float(sum(cov[a][a] for a in range(dim)))
        # A (deviation, id) names a row; equal ones are interchangeable.
        mine = {}
        for (i, _), r in zip(part, d):
            mine.setdefault((str(i), sum(c * c for c in r)), []).append([c / n for c in r])
        z = [g for g in got if g.n == n and (str(g.vec_id), int(g.deviation)) in mine]
        assert len(z) == n * k
        for c in range(1, k + 1):
            part_c = [g for g in z if g.component == c]
            assert len(part_c) == n
            if values[c - 1] <= 1e-12 * values[0]:
                assert all(g.whitened is None and g.explained == 0 for g in part_c)
                continue
            w = np.array([g.whitened for g in part_c])
            assert abs(w.mean()) < 1e-9 and abs((w * w).mean() - 1) < 1e-9
            assert part_c[0].explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
        assert all(g.identity_error < 1e-9 for g in z)
    return got


def vectors(n, dim, seed, first=0):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim))
    return [(first + i, [float(c) for c in np.float32(rng.standard_normal(dim) @ mix)], 0) for i in range(n)]


def test_whitened_covariance(spark):
    got = check(spark, vectors(300, 8, 1))
    z = {}
    for g in got:
        z.setdefault(g.vec_id, [0.0] * 8)[g.component - 1] = g.whitened
    m = np.array(list(z.values()))
    assert np.abs(np.cov(m.T, bias=True) - np.eye(8)).max() < 1e-9


def test_projections_are_eigenvectors(spark):
    """Up to the sign, the values are those of a decomposition of the exact covariance."""
    rows = vectors(120, 5, 2)
    (_, _, d, cov), = brute(rows).values()
    value, vec = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    want = (np.array(d, float) / len(rows)) @ vec[:, ::-1] / np.sqrt(value[::-1])
    for g in W.whiten(spark.createDataFrame(rows, SCHEMA)).collect():
        assert abs(abs(g.whitened) - abs(want[g.vec_id, g.component - 1])) < 1e-9


def test_odd_rows(spark):
    rows = vectors(40, 4, 3) + vectors(30, 3, 4, first=100)
    rows += [rows[0]] * 5 + [(None, [1.0, 2.0, 3.0, 4.0], None), (7, None, 1), (8, [], 1), (9, [1.0, None, 1.0, 1.0], 1)]
    rows += [(10, [1.0, float("nan"), 1.0, 1.0], 1), (11, [1.0, float("inf"), 1.0, 1.0], 1), (12, [2.0**60, 0.0, 0.0, 0.0], 1)]
    check(spark, rows)
    check(spark, rows, keep=2)


def test_large_entries_stay_exact(spark):
    """Entries far apart need more than 64 bits for squares, then for deviations too."""
    check(spark, vectors(50, 3, 5) + [(500, [2.0**30, -(2.0**31), 3.0], 0), (501, [5.0, 2.0**29, 2.0**33], 0)])
    big = vectors(50, 3, 6) + [(500, [2.0**54, -(2.0**53), 3.0], 0)]
    assert {int(g.deviation) for g in W.whiten(spark.createDataFrame(big, SCHEMA)).collect() if g.deviation is not None} <= {
        sum(c * c for c in r) for _, _, d, _ in brute(big).values() for r in d
    }


def test_no_variance_and_empty(spark):
    same = [(i, [1.0, 2.0], 0) for i in range(5)]
    got = check(spark, same)
    assert all(g.whitened is None and g.deviation == 0 and g.identity_error == 0 for g in got)
    line = [(i, [float(i), 2.0 * i], 0) for i in range(9)]
    assert [g.whitened is None for g in check(spark, line)] == [False, True] * 9
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == []


def test_square_sums():
    rng = np.random.default_rng(0)
    for size in (10, 1 << 20, 1 << 21, 1 << 40, 1 << 60):
        a = rng.integers(-size, size, (50, 3))
        for axis in (0, 1):
            want = [int(v) for v in (a.astype(object) ** 2).sum(axis)]
            assert W.square_sums(a, axis) == want


def test_clashing_names(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 5)], "a", 1, 2) for i in range(20)],
                                 "vec_id long, embedding array<double>, c string, dim int, x int")
    assert W.whitening_report(rows).count() == 40
    assert W.whitening_report(rows).dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
        ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
