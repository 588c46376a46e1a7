"""Hard negatives against brute force, and the tree's bounds against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"
ANCHOR = F.col("vec_id") % 10 == 0


def brute(rows, anchor=lambda i: i % 10 == 0):
    good = []
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(c))) for c in v], lab))
    out = []
    for n, (i, x, lab) in enumerate(good):
        if not anchor(i):
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), j, other) for m, (j, y, other) in enumerate(good) if m != n and len(y) == len(x)]
        for ps, p, _ in sorted(s for s in scores if s[2] == lab)[:5]:
            fit = sorted(s for s in scores if s[2] != lab and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:5]
            out += [(i, p, r, j, -ps, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


def check(spark, rows, **options):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), ANCHOR, **options).collect()
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)
    assert got == brute(rows)
    return got


def rows_of(n, dim, seed, spread=0.3, labels=4):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((12, dim))
    return [
        (i, [float(np.float32(c)) for c in middles[rng.integers(12)] + spread * rng.standard_normal(dim)], int(rng.integers(labels)))
        for i in range(n)
    ]


@pytest.mark.parametrize("options", [{}, {"block": 40, "leaf": 4, "sample": 200}])
def test_equals_brute_force(spark, options):
    assert len(check(spark, rows_of(600, 6, 1), **options)) > 500


def test_norms_differ(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [c * float(2.0 ** rng.integers(-4, 5)) for c in v], lab) for i, v, lab in rows_of(500, 4, 2)]
    check(spark, rows, block=100, leaf=8)


def test_copies_and_ties(spark):
    rows = rows_of(200, 3, 4)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(300)]  # most rows are one vector
    rows += [rows[10]] * 3 + [(2000 + i, [0.0, 0.0, 0.0], i % 3) for i in range(25)]
    check(spark, rows, block=50, leaf=8)


def test_odd_rows(spark):
    rows = rows_of(60, 4, 5) + [(i + 100, v, lab) for i, v, lab in rows_of(40, 2, 6)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 1), (210, None, 1), (220, [], 1), (230, [1.0, None, 1.0, 1.0], 1)]
    rows += [(240, [1.0, float("nan"), 0.0, 0.0], 1), (250, [float("-inf"), 0.0, 0.0, 0.0], 1), (260, [1.0] * 4, None)]
    rows += [(270, [0.5] * 9, 1)]
    check(spark, rows)
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA), ANCHOR).collect() == []
    check(spark, rows_of(5, 3, 7))
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "x", "dim", "cell", "rank", "score")})
    assert H.hard_negatives(wide, ANCHOR).count() == len(brute(rows))


def test_large_components(spark):
    rows = [(i, [c * 2.0**16 for c in v], lab) for i, v, lab in rows_of(120, 3, 8)]
    assert max(abs(r[4]) for r in check(spark, rows)) > 2**48


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(9)
    middles = rng.integers(-4000, 4000, (40, 8))
    x = middles[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))
    most = float((x * x).sum(axis=1).max())
    points = H.augmented(x, most)
    assert np.allclose((points**2).sum(axis=1), most)
    tree = H.grow(points, 32)
    q = x[:50].astype(float)
    for node, kids in enumerate(tree.children):
        below = tree.order[tree.low[node] : tree.high[node]]
        assert H._distances(points[below], points[tree.centre[node]]).max() <= tree.radius[node] + 1e-9
        if kids:
            assert sorted(np.concatenate([tree.order[tree.low[k] : tree.high[k]] for k in kids])) == sorted(below)
            assert tree.centre[kids[0]] == tree.centre[node] and all(k > node for k in kids)
        dots = q @ x[below].T
        least, largest = H.reach(q @ points[tree.centre[node], :-1], tree.radius[node], (q * q).sum(axis=1), most)
        assert (least <= dots.min(axis=1)).all() and (dots.max(axis=1) <= largest).all()
    import pyarrow as pa

    table = pa.table({"dim": pa.array([8] * 4000, pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.int64())),
                      "row": np.arange(4000), "vec_id": np.arange(4000), "label": np.zeros(4000, np.int64)})
    block, verified = H._Block(table, most, 32), 0
    for i in range(50):
        best = H._Best([H._LOW], [H._HIGH], 5)
        verified += block.descend(x[i], i, 0, True, best)
        dots = x @ x[i]
        dots[i] = H._LOW
        assert [-s for s, *_ in best.found[0]] == sorted(dots.tolist(), reverse=True)[:5]
    assert verified < 0.25 * 50 * 4000  # most nodes are skipped where the data have structure
