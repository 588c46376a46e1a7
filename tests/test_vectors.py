"""Clustering, search and soft-DTW against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.operators import clustering as C
from frameweave.operators import retrieval as R

RNG = np.random.default_rng(3)
X = RNG.normal(size=(120, 6)) + np.repeat(np.eye(6)[:4] * 6, 30, axis=0)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i % 2, i, v.tolist(), float(1 + i % 3)) for i, v in enumerate(X)]
    return spark.createDataFrame(rows, "g long, id long, x array<double>, w double").repartition(4)


def naive_lloyd(x, w, centres, rounds):
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([(x[label == j] * w[label == j, None]).sum(0) / w[label == j].sum() for j in range(len(centres))])
    return centres


def test_kmeans_follows_plain_lloyd(spark, points):
    start = spark.createDataFrame([(g, X[g + 30 * j].tolist()) for g in (0, 1) for j in (0, 1, 2, 3)], "g long, vector array<double>")
    fit = C.kmeans(points, "g", "id", "x", 4, weight="w", start=start, max_iter=3, tol=0)
    for g in (0, 1):
        at = np.arange(g, 120, 2)
        first = np.array(sorted((X[g + 30 * j].tolist() for j in range(4))))
        want = naive_lloyd(X[at], 1 + at % 3.0, first, 3)
        got = np.array([r.centre for r in fit.centres.where(F.col("g") == g).orderBy("label").collect()])
        assert np.allclose(got, want)


@pytest.mark.parametrize("init", ["rnd", "k-means++"])
def test_kmeans_keeps_the_best_run(points, init):
    fit = C.kmeans(points, "g", "id", "x", 4, init=init, runs=3, max_iter=4)
    assert fit.labels.count() == 120
    assert {r.g: r.n for r in fit.centres.groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 4}
    single = C.kmeans(points, "g", "id", "x", 4, init=init, runs=1, max_iter=4)
    best = {r.g: r.inertia for r in fit.inertia.collect()}
    assert all(best[r.g] <= r.inertia + 1e-9 for r in single.inertia.collect())


def test_kmeans_few_points_and_bad_arguments(spark, points):
    two = spark.createDataFrame([(0, 1, [0.0]), (0, 2, [1.0])], "g long, id long, x array<double>")
    fit = C.kmeans(two, "g", "id", "x", 5)
    assert fit.centres.count() == 2 and fit.inertia.first().inertia == 0
    same = spark.createDataFrame([(0, i, [1.0]) for i in range(6)], "g long, id long, x array<double>")
    assert C.kmeans(same, "g", "id", "x", 3, max_iter=2).labels.count() == 6  # emptied clusters are refilled
    for bad in ({"k": 0}, {"k": 2, "runs": 0}, {"k": 2, "init": "nope"}):
        with pytest.raises(ValueError):
            C.kmeans(points, "g", "id", "x", **bad)


def test_chunk_kmeans(spark):
    rows = [(0, i // 40, i, v.tolist()) for i, v in enumerate(X)] + [(1, 0, i, X[i].tolist()) for i in range(3)]
    frames = spark.createDataFrame(rows, "s long, c long, i long, x array<double>")
    out = C.chunk_kmeans(frames, ["s", "c"], "i", "x", 5).collect()
    for s, c in {(r.s, r.c) for r in out}:
        mine = [r for r in out if (r.s, r.c) == (s, c)]
        members = sorted(m for r in mine for m in r.members)
        want = [i for s2, c2, i, _ in rows if (s2, c2) == (s, c)]
        assert members == want and len(mine) == min(5, len(want))
        for r in mine:
            assert np.allclose(r.centroid, X[r.members].mean(0))


def constrained_by_hand(x, w, centres):
    """Rounds of proposals, one instance at a time."""
    prio = w[:, None] / np.maximum(np.linalg.norm(x[:, None] - centres[None], axis=2), 1e-9)
    room, label, left = np.ones(len(centres)), {}, set(range(len(x)))
    while left:
        asks = {}
        for i in sorted(left):
            ok = [j for j in np.argsort(-prio[i], kind="stable") if room[j] >= w[i] - 1e-12]
            if ok:
                asks.setdefault(int(ok[0]), []).append(i)
            else:
                label[i] = -1
        left -= set(label)
        for j, askers in asks.items():
            had, load = room[j], 0.0
            for i in sorted(askers, key=lambda i: (-prio[i, j], i)):
                load += w[i]
                if load > had + 1e-12:
                    break
                label[i] = j
                room[j] -= w[i]
        left -= set(label)
    return label


@pytest.mark.parametrize("group_rows", [None, 7])
def test_constrained(spark, monkeypatch, group_rows):
    """The labels do not depend on the rows that a task may order."""
    if group_rows:
        plain = C.order_rows
        monkeypatch.setattr(C, "order_rows", lambda *a, **k: plain(*a, **k, group_rows=group_rows))
    w = np.round(0.05 + 0.1 * RNG.random(120), 3) if group_rows is None else test_constrained.w
    test_constrained.w = w
    pts = spark.createDataFrame([(i % 2, i, X[i].tolist(), float(w[i])) for i in range(120)], "g long, id long, x array<double>, w double")
    centres = np.stack([X[0], X[31], X[62], X[93]])
    cen = spark.createDataFrame([(g, j, centres[j].tolist()) for g in (0, 1) for j in range(4)], "g long, label long, centre array<double>")
    rows = C.constrained_assign(pts, cen, ["g"], "id", "x", "w").collect()
    got = {r.id: r.label for r in rows}
    assert len(rows) == 120 and -1 in got.values()
    for g in (0, 1):
        at = np.arange(g, 120, 2)
        want = constrained_by_hand(X[at], w[at], centres)
        assert {int(at[i]): j for i, j in want.items()} == {i: got[i] for i in at}
        for j in range(4):
            load = sum(w[i] for i in at if got[i] == j)
            assert load <= 1 + 1e-9
            assert all(w[i] > 1 - load - 1e-9 for i in at if got[i] == -1)


@pytest.mark.parametrize("init", ["rnd", "k-means++", "topk", "ckm++"])
def test_constrained_kmeans(spark, init):
    rows = [(0, i, X[i].tolist(), 0.03) for i in range(60)] + [(1, i, X[i].tolist(), 0.3) for i in range(20)]
    pts = spark.createDataFrame(rows, "g long, id long, x array<double>, w double")
    fit = C.constrained_kmeans(pts, "g", "id", "x", "w", 3, init=init, runs=1 if init == "topk" else 2, max_iter=3)
    flags = {r.g: r.infeasible for r in fit.instances.collect()}
    assert flags == {0: False, 1: True}
    labels = fit.labels.collect()
    assert len(labels) == 80
    load = {}
    for r in labels:
        load[r.g, r.label] = load.get((r.g, r.label), 0) + (0.03 if r.g == 0 else 0.3)
    assert all(v <= 1 + 1e-9 for (g, j), v in load.items() if j >= 0)
    assert (0, -1) not in load and load[1, -1] == pytest.approx(20 * 0.3 - 9 * 0.3)
    with pytest.raises(ValueError):
        C.constrained_kmeans(pts, "g", "id", "x", "w", 3, init="topk", runs=2)



@pytest.mark.parametrize("metric", R.METRICS)
@pytest.mark.parametrize("block", [64 << 20, 25 * 6 * 8])
def test_nearest(spark, points, metric, block):
    got = R.nearest(points, points, 4, metric, "id", "id", "x", skip_self=True, block_bytes=block).collect()
    if metric in ("l1", "l2", "lp"):
        d = np.linalg.norm(X[:, None] - X[None], axis=2, ord=1 if metric == "l1" else 2)
    else:
        n = X / np.linalg.norm(X, axis=1, keepdims=True) if metric == "cosine" else X
        d = (1 if metric == "cosine" else 0) - n @ n.T
    np.fill_diagonal(d, np.inf)
    want = {i: list(np.lexsort((np.arange(120), np.round(d[i], 12)))[:4]) for i in range(120)}
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.row_id)
    assert by == want


def test_tiles_give_the_same_top(monkeypatch):
    ids, k = np.arange(120)[::-1].copy(), 7
    rows = np.round(X, 0)  # many ties
    whole = [np.asarray(v) for v in R._top(ids, rows, ids, rows, k, "l2", True)]
    monkeypatch.setattr(R, "QUERY_TILE", 50)
    monkeypatch.setattr(R, "ROW_TILE", 16)
    tiled = R._top(ids, rows, ids, rows, k, "l2", True)
    assert all(np.array_equal(a, b) for a, b in zip(whole, tiled))
    d = np.round(np.linalg.norm(rows[:, None] - rows[None], axis=2), 12)
    np.fill_diagonal(d, np.inf)
    assert np.array_equal(tiled[1].reshape(120, k), np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k])


def slow_soft_dtw(a, b, gamma, band):
    n, m = len(a), len(b)
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if 0 < band < abs(i - j):
                continue
            z = np.array([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]])
            z = z[np.isfinite(z)]
            low = z.min() - gamma * np.log(np.exp(-(z - z.min()) / gamma).sum()) if len(z) else np.inf
            r[i, j] = ((a[i - 1] - b[j - 1]) ** 2).sum() + low
    return r[n, m]


@pytest.mark.parametrize("gamma, band, norm", [(1.0, 0, False), (0.1, 0, True), (1.0, 3, False)])
def test_soft_dtw(spark, gamma, band, norm):
    pairs = [(i, X[i : i + 5 + i % 3].tolist(), X[i + 40 : i + 46].tolist()) for i in range(12)]
    df = spark.createDataFrame(pairs, "id int, a array<array<double>>, b array<array<double>>")
    got = C.pairwise_soft_dtw(df, "a", "b", gamma=gamma, bandwidth=band, normalise=norm)
    for r in got.collect():
        a, b = np.array(r.a), np.array(r.b)
        want = slow_soft_dtw(a, b, gamma, band)
        if norm:
            want -= 0.5 * (slow_soft_dtw(a, a, gamma, band) + slow_soft_dtw(b, b, gamma, band))
        assert r.distance == pytest.approx(want)


def test_pca_orders_variance_and_shares_one_fit(points):
    out, explained = C.project(points, ["id"], "x", 3)
    assert explained == sorted(explained, reverse=True)
    p = np.array([r.point for r in out.orderBy("id").collect()])
    assert np.allclose(p.min(0), 0) and np.allclose(p.max(0), 1)


def test_soft_kmeans_moves_to_a_fixed_point(spark, points):
    cen = spark.createDataFrame([(j, X[30 * j].tolist()) for j in range(4)], "label long, centre array<double>")
    fit = C.soft_kmeans(points, cen, "x", [], max_iter=30, tol=1e-6)
    _, again = C.soft_step(points, C.centre_arrays(fit, [], "label", "centre"), "x", [])
    a = {r.label: r.centre for r in fit.collect()}
    assert all(np.allclose(r.centre, a[r.label], atol=1e-4) for r in again.collect())


def test_widen_hits_by_hand(spark):
    docs = spark.createDataFrame([(i, "a" if i < 6 else "b", "x" * n) for i, n in enumerate([5, 90, 5, 10, 5, 5, 5])], "pos long, source string, content string")
    hits = spark.createDataFrame([(1, 3, 0.5)], "query_id long, pos long, score double")
    # From 3: right 4 fits, left 2 fits; at distance 2 right 5 fits, left 1 (90) is too long;
    # at distance 3 right 6 is another source, left 0 fits.
    got = sorted(r.pos for r in R.widen_hits(hits, docs, 3, 60).collect())
    assert got == [0, 2, 3, 4, 5]
    passages = R.merge_passages(R.widen_hits(hits, docs, 3, 60), docs).orderBy("first").collect()
    assert [(p["first"], p["last"], len(p.content)) for p in passages] == [(0, 0, 5), (2, 5, 25)]


def test_hashed_vectors_shuffle_no_words(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id long, text string")
    out = R.hashed_vectors(rows, "id", "text", 8)
    got = {r.id: r.vector for r in out.collect()}
    assert sum(v * v for v in got[1]) == pytest.approx(1) and got[2] == got[3] == [0.0] * 8
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(id") <= 2  # texts, and ids for those without words


def test_l2_takes_differences_of_picked_pairs_only(monkeypatch):
    """All pairs are not held as differences; results, copies and far-off vectors included, are those of all pairs."""
    rng = np.random.default_rng(5)
    for shift in (0.0, 1e6):
        x = rng.normal(size=(600, 8)) + shift
        x[100:160] = x[7]
        ids = rng.permutation(600)
        score = np.round(R._scores(x, x, "l2"), 12)
        np.fill_diagonal(score, np.inf)
        want = [sorted(zip(score[i], ids))[:4] for i in range(600)]
        with monkeypatch.context() as m:
            m.setattr(R, "_scores", None)
            q, r, s = R._top(ids, x, ids, x, 4, "l2", True)
        assert [sorted(zip(s[q == i], ids[r[q == i]])) for i in range(600)] == want
    assert R._near_l2(np.full((2, 2), 1e200), np.full((9, 2), 1.0), 2, None) is None


@pytest.mark.parametrize("metric", R.METRICS)
def test_blocks_are_not_copied_for_the_blocks_they_meet(spark, points, monkeypatch, metric):
    """Each task writes k rows a query for its part of the index, and no row of vectors is exploded."""
    with monkeypatch.context() as m:
        m.setattr(R, "top_rows", lambda found, *a: found)
        found = R.nearest(points, points, 4, metric, "id", "id", "x", skip_self=True, block_bytes=10 * 6 * 8)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == 120 * 4
        m.setattr(R, "BLOCK_BYTES", 40 * 6 * 8)  # three parts of the index
        found = R.nearest(points, points, 4, metric, "id", "id", "x", skip_self=True, block_bytes=10 * 6 * 8)
        assert 120 * 4 < found.count() <= 120 * 4 * 3
        parts = R.nearest(points, points, 4, metric, "id", "id", "x", skip_self=True, block_bytes=10 * 6 * 8)
    parts = sorted(map(tuple, R.top_rows(parts, ["query_id"], ["score", "row_id"], 4).collect()))
    sent = R.nearest(points, points, 4, metric, "id", "id", "x", skip_self=True).collect()
    assert [(r[0], r[1], r[3]) for r in parts] == [(r[0], r[1], r[3]) for r in sorted(sent)]
    assert np.allclose([r[2] for r in parts], [r[2] for r in sorted(sent)], atol=1e-11)


def test_blocks_with_odd_ids_and_vectors(spark):
    """Ids may repeat or be null beside large ones; a vector with gaps is no one's neighbour; a ragged one is refused."""
    big = (1 << 62) + 1
    rows = [(big, [1.0, 0.0]), (None, [1.0, 0.1]), (2, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [None, 1.0]), (4, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").coalesce(1)
    got = R.nearest(df, df, 2, "cosine", "id", "id", "x", skip_self=True, block_bytes=4 * 2 * 8).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.row_id, round(r.score, 3)))
    assert by[big] == [(None, 0.005), (2, 0.9)]
    assert by[None] == [(None, 0.0), (big, 0.005)]  # without an id it is not known to be the same row
    assert by[2] == [(None, 0.802), (None, 0.9)] and by[4][0][0] == 2 and 3 not in by
    for bad in ([1.0], None):
        odd = spark.createDataFrame([*rows, (5, bad)], "id long, x array<double>")
        with pytest.raises(Exception, match="same length"):
            R.nearest(df, odd, 2, "cosine", "id", "id", "x", block_bytes=4 * 2 * 8).count()


def test_products_keep_ties_and_the_best_of_any_tile(monkeypatch):
    """Cosine and dot scores up to the k-th so far are enough, with ties, copies and rows that have no score."""
    monkeypatch.setattr(R, "ROW_TILE", 16)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(90, 3)), 0)
    x[20:50], x[7, 1], x[8] = x[3], np.nan, 0
    ids = rng.permutation(90)
    for metric in ("cosine", "dot"):
        n = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x
        d = np.round((metric == "cosine") - n @ n.T, 12)
        d[np.eye(90, dtype=bool) | np.isnan(d)] = np.inf
        q, r, s = R._top(ids, x, ids, x, 5, metric, True)
        for i in range(90):
            want = [(v, j) for v, j in sorted(zip(d[i], ids)) if v < np.inf][:5]
            assert [(v, j) for v, j in zip(s[q == i], ids[r[q == i]])] == want
