"""Greedy jobs against brute force, and the promises of the samplers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.operators import corpus as C
from frameweave.operators import scoring

RNG = np.random.default_rng(5)


def test_length_groups(spark):
    rows = [(i, int(RNG.integers(1, 100)), i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, n long, m boolean")
    out = C.length_groups(df, "id", "n", "m", 4, 3, 1).collect()
    assert sorted(r.id for r in out) == list(range(100))
    for m in (True, False):
        for mega in {r.megabatch for r in out if r.m == m and r.megabatch >= 0}:
            part = [r for r in out if r.m == m and r.megabatch == mega]
            lanes = [[], [], []]
            for r in sorted(part, key=lambda r: (-r.length, r.id)):
                room = [i for i in range(3) if len(lanes[i]) < 4]
                lanes[min(room, key=lambda i: (sum(x.length for x in lanes[i]), i))].append(r)
            for i, lane in enumerate(lanes):
                got = sorted((r for r in part if r.lane == i), key=lambda r: r.place)
                assert [r.id for r in got] == [r.id for r in lane]


    rest = [r for r in out if r.megabatch == -1]
    assert len({(r.lane, r.place) for r in rest}) == len(rest) and {r.m for r in rest} == {True, False}
    assert len({r.turn for r in out}) == len({(r.m if r.megabatch >= 0 else None, r.megabatch) for r in out})


@pytest.mark.parametrize("group_rows", [30, 10**6])
def test_packs(spark, group_rows):
    rows = [(i, int(RNG.integers(1, 60)), int(RNG.integers(0, 4))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, n long, i long")
    out = C.pack_sequences(df, "id", F.col("n"), F.col("i"), 50, 5, 1, bucket_rows=40, group_rows=group_rows).collect()
    assert sorted(r.id for r in out) == [i for i, _, _ in rows]
    assert {r.id for r in out if r.pack is None} == {i for i, n, _ in rows if n > 50}
    out = [r for r in out if r.pack is not None]
    packs = {}
    for r in out:
        packs.setdefault((r.bucket, r.pack), []).append(r)
    for rows_in in packs.values():
        rows_in.sort(key=lambda r: r.place)
        assert sum(r.length for r in rows_in) <= 50 and sum(r.images for r in rows_in) <= 5
        assert [r.start for r in rows_in] == list(np.cumsum([0] + [r.length for r in rows_in])[:-1])
    assert max(len([r for r in out if r.bucket == b]) for b in {r.bucket for r in out}) <= 40


def test_stratified_sample_reaches_its_size(spark):
    # The pool of the published category counts, scaled down by ten.
    sizes = {"a": 106, "b": 127, "c": 103, "d": 133, "e": 34}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "id long, s string")
    out = C.stratified_sample(df, "id", "s", 30, 3, df.where("id % 5 = 0")).collect()
    assert len(out) == 30 and all(r.id % 5 for r in out)
    for s, n in sizes.items():
        assert sum(r.s == s for r in out) >= 30 * n // len(rows)


def test_order_jobs(spark):
    df = spark.createDataFrame([(i, "big" if i < 8 else "small") for i in range(12)], "id long, s string")
    names = [r.s for r in C.interleave(df, "s", ["id"], 1).orderBy("position").collect()]
    assert names[0] == "big" and all("small" in names[i : i + 4] for i in (0, 3, 6, 8))
    assert C.interleave(df, "s", ["id"], 5).count() == 10
    first = [r.id for r in C.shard_shuffle(df, "s", "id", 1, 0, 2).orderBy("position").collect()]
    again = [r.id for r in C.shard_shuffle(df, "s", "id", 1, 0, 2).orderBy("position").collect()]
    other = [r.id for r in C.shard_shuffle(df, "s", "id", 1, 1, 2).orderBy("position").collect()]
    assert first == again != other and sorted(first) == sorted(other)
    with pytest.raises(KeyError):
        C.mixture("a+b", {"a": lambda: df})


def test_running_moments_are_merged_exactly(spark):
    v = RNG.normal(1e6, 1.0, 200)  # a large mean would spoil naive sums of squares
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    for r in scoring.running_moments(df, ["k"], ["i"], "v", 16).collect():
        part = v[: min(200, (r.batch + 1) * 16)]
        assert r["mean"] == pytest.approx(part.mean(), rel=1e-12)
        assert r["std"] == pytest.approx(part.std(ddof=1), rel=1e-6)
