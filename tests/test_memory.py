"""Tree, forest and dialogue memory against plain simulations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.operators import memory as M
from frameweave.plans.staging import materialise, small_side
from frameweave.streaming.processors import merge_depth

RNG = np.random.default_rng(11)
VEC = RNG.normal(size=(90, 4))


@pytest.fixture(scope="module")
def frames(spark):
    rows = [("a" if i < 70 else "b", i, VEC[i].tolist(), f"t{i}") for i in range(90)]
    return spark.createDataFrame(rows, "s string, i long, x array<double>, t string")


def simulate(n_leaves, interval, fixpoint=True):
    """Roots (depth, seq) after each leaf, by the merge rule."""
    roots, number, history = [], {}, []

    def new(d):
        number[d] = number.get(d, -1) + 1
        return (d, number[d])

    for _ in range(n_leaves):
        roots.append(new(0))
        while True:
            d = merge_depth([x for x, _ in roots], interval)
            at = [i for i, (x, _) in enumerate(roots) if x == d][:interval]
            if len(at) < interval:
                break
            roots[at[0] : at[0] + interval] = [new(d + 1)]
            if not fixpoint:
                break
        history.append(list(roots))
    return history


def test_roots_as_of_a_question_follow_the_merges(spark):
    history = simulate(40, 3)
    q = spark.createDataFrame([(n, "s", n) for n in range(1, 41)], "query_id long, stream string, n long")
    got = {}
    for r in M.question_roots(q, F.col("n"), 3, 4).collect():
        got.setdefault(r.query_id, set()).add((r.depth, r.seq))
    assert got == {n: set(history[n - 1]) for n in range(1, 41)}


def test_scripted_stream_depths_never_rise():
    # One merge per update, chunk 40 and interval 3, buffers of the scripted stream.
    leaves = sum(n // 40 for n in (414, 673, 819, 943, 1486, 1667))
    for roots in simulate(leaves, 3, fixpoint=False):
        depths = [d for d, _ in roots]
        assert depths == sorted(depths, reverse=True)


@pytest.mark.parametrize("group_rows", [15, 10**6])
def test_tree(frames, group_rows):
    leaves = M.build_leaves(frames, "s", ["i"], "x", 4, text="t", group_rows=group_rows)
    nodes = {(r.stream, r.depth, r.seq): r for r in M.build_tree(leaves, 3).collect()}
    for s, part in (("a", VEC[:70]), ("b", VEC[70:])):
        level = [part[i : i + 4].mean(0) for i in range(0, len(part), 4)]
        depth = 0
        while True:
            for j, v in enumerate(level):
                assert np.allclose(nodes[(s, depth, j)].vector, v)
                assert nodes[(s, depth, j)].parent_seq == (j // 3 if len(level) > 1 else None)
            if len(level) == 1:
                break
            level = [np.mean(level[i : i + 3], axis=0) for i in range(0, len(level), 3)]
            depth += 1
        assert not any(k[0] == s and k[1] > depth for k in nodes)


def test_clustered_tree_is_bounded_and_keeps_texts(frames):
    leaves = M.build_leaves(frames, "s", ["i"], "x", 8, k=3, text="t")
    nodes = M.build_tree(leaves, 3, k=4).collect()
    assert all(1 <= len(r.centroids) <= 4 for r in nodes)
    assert all(r.text in {f"t{i}" for i in range(90)} for r in nodes)


def test_descend(spark, frames):
    leaves = M.build_leaves(frames, "s", ["i"], "x", 4, text="t")
    tree = M.build_tree(leaves, 3).cache()
    nodes = {(r.stream, r.depth, r.seq): r for r in tree.collect()}
    queries = spark.createDataFrame([(i, "ab"[i % 2], RNG.normal(size=4).tolist()) for i in range(10)], "query_id long, stream string, query array<double>")
    got = {}
    for r in M.descend(tree, queries).collect():
        got.setdefault(r.query_id, set()).add((r.depth, r.seq))

    def sim(v, q):
        return round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 12)

    for q in queries.collect():
        at = next(k for k, r in nodes.items() if k[0] == q.stream and r.parent_seq is None)
        want = set()
        while at[1] > 0:
            kids = [k for k, r in nodes.items() if k[0] == q.stream and k[1] == at[1] - 1 and r.parent_seq == at[2]]
            at = min(kids, key=lambda k: (-sim(nodes[k].vector, q.query), k[2]))
            want.add(at[1:])
        assert got[q.query_id] == want


def test_all_negative_similarity_still_finds_a_child(spark):
    rows = [("s", 0, 0, 0, [1.0], "a"), ("s", 0, 1, 0, [2.0], "b"), ("s", 1, 0, None, [1.5], "r")]
    nodes = spark.createDataFrame(rows, "stream string, depth int, seq long, parent_seq long, vector array<double>, text string")
    q = spark.createDataFrame([(1, "s", [-1.0])], "query_id long, stream string, query array<double>")
    assert [r.text for r in M.descend(nodes, q).collect()] == ["a"]


def test_short_memory_sizes_and_modes(spark):
    df = spark.createDataFrame([(k, i) for k in range(400) for i in range(30)] + [(999, 0), (999, 1)], "k long, i long")
    got = M.short_memory(df, ["k"], ["i"], "i", 20, 5, 5.0).collect()
    assert sum(r.k == 999 for r in got) == 2
    mine = [r.i for r in got if r.k != 999]
    assert len(mine) == 400 * 5 and min(mine) >= 10
    recent = [r.i for r in M.short_memory(df, ["k"], ["i"], "i", 20, 5, 5.0, mode="recent").collect() if r.k != 999]
    assert np.mean(mine) < 17 < 22 < np.mean(recent)  # literal favours the oldest of the window


def test_change_gate_ssim_fires_below(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [3.0, 1.0, 0.0])], "i int, x array<double>")
    kept = M.change_gate(df.withColumn("k", F.lit(1)), ["k"], ["i"], "x", 0.9, "ssim")
    assert sorted(r.i for r in kept.collect()) == [0, 2]


def test_forgetting_modes_and_defaults(spark):
    day = dt.date(2024, 1, 1)
    turns = spark.createDataFrame(
        [("u", day, i, 1 if i < 500 else 9, None) for i in range(1000)],
        "user string, date date, ord long, memory_strength long, last_recall_date date",
    )
    sums = spark.createDataFrame([("u", day, "s"), ("v", day, "gone")], "user string, date date, content string")
    now = F.lit(dt.date(2024, 1, 6))
    share = {}
    for mode in ("documented", "literal"):
        kept, left = M.forget(turns, sums, now, mode=mode)
        rows = kept.collect()
        share[mode] = [sum(r.memory_strength == s for r in rows) / 500 for s in (1, 9)]
        assert [r.user for r in left.collect()] == ["u"]
    assert share["documented"][0] == pytest.approx(np.exp(-1), abs=0.07)
    assert share["documented"][1] == pytest.approx(np.exp(-1 / 9), abs=0.07)
    assert share["literal"][1] < 0.02  # the written formula lets strong memories fade faster
    assert M.memory_defaults(turns.drop("last_recall_date")).first().memory_id == "u_2024-01-01_0"


def test_bank_round_trip(spark):
    bank = spark.createDataFrame(
        [("u", {"2024-01-02": [("q1", "r1"), ("q2", "r2")]}, {"2024-01-02": ("sum",)})],
        "user string, history map<string, array<struct<query: string, response: string>>>, summary map<string, struct<content: string>>",
    )
    turns, sums = M.explode_bank(bank)
    assert [(r.ord, r.query) for r in turns.orderBy("ord").collect()] == [(0, "q1"), (1, "q2")]
    assert sums.first().content == "sum"
    added = M.append_turns(turns, turns.withColumn("ord", F.col("ord") + 1))
    assert added.count() == 3
    docs = turns.select("user", "date", F.col("query").alias("content"))
    none = sums.select("user", "date", "content").limit(0)
    assert M.add_summaries(docs.limit(1), none, F.upper).first().content == "Q1"


def test_a_side_beyond_the_bound_is_not_sent_by_its_file_size(spark):
    """Files are small when compressed; Spark alone would send such a side through the driver."""
    rows = materialise(spark.range(20_000).select("id", (F.col("id") % 7).alias("v")))
    other = materialise(spark.range(20_000).select("id", F.lit("x").alias("t")))
    joined = other.join(small_side(rows, 1_000), "id")
    assert joined.count() == 20_000
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in other.join(small_side(rows), "id")._jdf.queryExecution().executedPlan().toString()
