"""Streams cut into different micro-batches, restarted, and with late rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.streaming import processors as P
from frameweave.streaming import sources as S

START = dt.datetime(2024, 1, 1)
RNG = np.random.default_rng(2)
ROWS = [(i % 3, i, START + dt.timedelta(minutes=i), RNG.normal(size=2).tolist()) for i in range(120)]
SCHEMA = "stream long, id long, ts timestamp, vector array<double>"


def write_files(spark, folder, cuts):
    """One Parquet file per part; the parts are taken in order, one per micro-batch."""
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"f{i}"))


def run(spark, tmp_path, tag, parts, job):
    folder = tmp_path / tag
    write_files(spark, folder / "in", parts)
    frames = S.read_frames(spark, str(folder / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    S.drain(job(frames), str(folder / "out"), str(folder / "ck"))
    return spark.read.parquet(str(folder / "out"))


def cut(n):
    size = -(-len(ROWS) // n)
    return [ROWS[i : i + size] for i in range(0, len(ROWS), size)]


def test_forest_does_not_depend_on_micro_batches(spark, tmp_path):
    results = []
    for n in (1, 5):
        out = run(spark, tmp_path, f"n{n}", cut(n), lambda f: P.forest_stream(f, 3, 2))
        results.append({(r.stream, r.depth, r.seq): np.round(r.vector, 9).tolist() for r in out.collect()})
    assert results[0] == results[1]
    for s in range(3):
        mine = np.array([r[3] for r in ROWS if r[0] == s])
        level = [mine[i : i + 3].mean(0) for i in range(0, len(mine) - 2, 3)]
        depth = 0
        while level:
            for j, v in enumerate(level):
                assert np.allclose(results[0][(s, depth, j)], v)
            level = [np.mean(level[i : i + 2], axis=0) for i in range(0, len(level) - 1, 2)]
            depth += 1


def test_one_merge_per_leaf_gives_the_same_leaves(spark, tmp_path):
    out = run(spark, tmp_path, "one", cut(1), lambda f: P.forest_stream(f, 3, 2, fixpoint=False))
    rows = out.collect()
    assert sum(r.depth == 0 for r in rows) == 39  # 13 whole chunks of 3 in each of 3 streams
    assert len({(r.stream, r.depth, r.seq) for r in rows}) == len(rows)


@pytest.mark.parametrize("distance", ["l2", "l1", "cosine"])
def test_gate_survives_a_restart(spark, tmp_path, distance):
    folder = tmp_path / distance
    parts = cut(3)
    schema = spark.createDataFrame([], SCHEMA).schema

    def go():
        frames = S.read_frames(spark, str(folder / "in" / "*"), schema, files_per_trigger=1)
        S.drain(P.gate_stream(frames, 0.8, distance), str(folder / "out"), str(folder / "ck"))

    write_files(spark, folder / "in", parts[:2])
    go()
    write_files(spark, folder / "in" / "later", parts[2:])
    (folder / "in" / "later" / "f0").rename(folder / "in" / "f9")
    go()
    got = sorted(r.id for r in spark.read.parquet(str(folder / "out")).collect())
    want, last = [], {}
    for s, i, _, v in ROWS:
        v = np.array(v)
        if s in last:
            p = last[s]
            d = {
                "l2": np.linalg.norm(v - p),
                "l1": np.abs(v - p).sum(),
                "cosine": 1 - v @ p / np.linalg.norm(v) / np.linalg.norm(p),
            }[distance]
        if s not in last or d > 0.8:
            want.append(i)
        last[s] = v
    assert got == want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    late = [(0, 999, START, [0.0, 0.0])]
    parts = [ROWS[:60], ROWS[60:], late]
    folder = tmp_path / "late"
    write_files(spark, folder / "in", parts)
    frames = S.read_frames(spark, str(folder / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    query = S.append_sink(S.windowed_counts(frames, [], "20 minutes", late="5 minutes"), str(folder / "out"), str(folder / "ck"))
    query.awaitTermination()
    dropped = sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
    assert dropped == 1
    out = spark.read.parquet(str(folder / "out"))
    assert out.agg(F.max("n")).first()[0] == 20


def test_sessions_and_recalls(spark, tmp_path):
    gap = [r for r in ROWS if r[1] < 20 or r[1] >= 60]
    out = run(spark, tmp_path, "sess", [gap, [(0, 1000, START + dt.timedelta(days=2), [0.0, 0.0])]], lambda f: S.session_counts(f.withColumn("g", F.lit(1)), ["g"], "30 minutes"))
    assert sorted(r.n for r in out.collect()) == [20, 60]
    folder = tmp_path / "rec"
    write_files(spark, folder / "in", cut(4))
    frames = S.read_frames(spark, str(folder / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    recalls = P.recall_stream(frames.select(F.col("stream").alias("memory_id"), "ts"))
    rows = S.upsert_sink(recalls, str(folder / "out"), str(folder / "ck"), ["memory_id"], fold=2).read().collect()
    assert {r.memory_id: r.strength for r in rows} == {0: 41, 1: 41, 2: 41}


def test_dialogue_sink_is_idempotent(spark, tmp_path):
    folder = tmp_path / "dia"
    write_files(spark, folder / "in", [ROWS[:50], ROWS[40:]])
    frames = S.read_frames(spark, str(folder / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    S.dialogue_sink(frames, str(folder / "out"), str(folder / "ck"), ["stream", "id"])
    out = spark.read.parquet(str(folder / "out"))
    assert out.count() == 120 and out.select("id").distinct().count() == 120
