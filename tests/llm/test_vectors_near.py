"""Forest of projection trees against brute force."""

import numpy as np
import pytest

import brute
from frameweave.llm import vector_forest as V


def brute_links(rows, least):
    def usable(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    good = [(i, np.array(v, float), lab) for i, (_, v, lab) in enumerate(rows) if lab is not None and usable(v)]
    links = []
    for n, (i, v, a) in enumerate(good):
        for j, w, b in good[:n]:
            if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links.append((i, j))
    return links


def rows_of(n, seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 5)):
            noise = rng.standard_normal(dim) * rng.choice([0, 0.02, 0.05, 0.08])
            rows.append((len(rows), [float(np.float32(c)) for c in base + noise], int(rng.integers(0, 2))))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [2048, 64])
def test_recall_and_precision(spark, block):
    rows = rows_of(1500)
    links = brute_links(rows, 0.98)
    want = np.zeros(len(rows), int)
    for i, j in links:
        want[i] += 1
        want[j] += 1
    got = {r.vec_id: r for r in V.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= want[i] for i in range(len(rows)))  # none below the threshold
    assert found >= 0.97 * 2 * len(links)
    roots = brute.components(range(len(rows)), links)
    same = sum(got[i].component_id == roots[i] for i in range(len(rows)))
    assert same >= 0.97 * len(rows)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(rows)))


def test_one_leaf_is_exact(spark):
    """With a leaf for all vectors, nothing is missed, in any number of blocks."""
    rows = rows_of(400, 7)
    links = brute_links(rows, 0.98)
    roots = brute.components(range(len(rows)), links)
    for block in (4096, 32):
        got = V.near_vectors(spark.createDataFrame(rows, SCHEMA), leaf=10**6, trees=2, block=block).collect()
        assert {r.vec_id: r.component_id for r in got} == roots
        assert sum(r.n_links for r in got) == 2 * len(links)


@pytest.mark.parametrize("size", [300, 3000])
def test_dense_group_keeps_its_links(spark, size):
    """Near vectors, all different, among others: trees do not cut the group apart."""
    rng = np.random.default_rng(4)
    group = rng.standard_normal(64) + 0.13 * rng.standard_normal((size, 64))
    x = np.vstack([rng.standard_normal((3000, 64)), group]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert np.median(want[3000:]) > size // 2
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got = {r.vec_id: r for r in V.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all()
    assert (found >= 0.9 * want).all()


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
        (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1),
        (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
        (13, [-0.0, 3e38], 3), (14, [0.0, 1e-38], 3),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as size", "3 as x", "4 as key")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in V.near_vectors(docs).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    want = [(0, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (12, 4, 1, False), (12, 4, 1, False)]
    assert got == sorted(want + alone + [(13, 1, 13, True), (14, 1, 13, False)])
    assert V.near_vectors(docs.limit(0)).count() == 0
