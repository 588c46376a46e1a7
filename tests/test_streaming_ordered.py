"""Streams in event time: cut into different micro-batches, out of order, late, and idle."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameweave.operators import memory as M
from frameweave.streaming import ordered as O
from frameweave.streaming import sources as S

START = dt.datetime(2024, 1, 1)
RNG = np.random.default_rng(5)
KINDS = RNG.choice([O.QUESTION, O.FRAME, O.FRAME, O.FRAME, O.TURN], 400)
ROWS = [
    (int(RNG.integers(0, 3)), i, START + dt.timedelta(minutes=i // 2), int(KINDS[i]), RNG.normal(size=2).tolist(), f"t{i}") for i in range(400)
]
SCHEMA = "stream long, id long, ts timestamp, kind int, vector array<double>, text string"


def feed(spark, folder, parts):
    """A stream of one file per part, in this order."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    return S.read_frames(spark, f"{folder}/in/*", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


def end(minutes=400):
    return [(None, None, START + dt.timedelta(minutes=minutes), None, None, None)]


def run(spark, folder, parts, job):
    """(rows, dropped late rows) of a job over the parts."""
    query = S.append_sink(job(feed(spark, folder, parts)), f"{folder}/out", f"{folder}/ck")
    query.awaitTermination()
    dropped = sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
    return sorted((str(r) for r in spark.read.parquet(f"{folder}/out").collect())), dropped


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def shaken(rows, minutes=8):
    """The rows in an order that is wrong by at most `minutes`."""
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=float(np.random.default_rng(r[1]).uniform(0, minutes))))


def answers(rows):
    return O.answers_in_order(rows, 3, 2, k=2, width=6, remember=3, every=2, recall=2, radius=1)


JOBS = {
    "answers": answers,
    "gate": lambda r: O.gate_in_order(r, 1.5),
    "scenes": lambda r: O.gate_in_order(r, 0.5, "ssim"),
    "short": lambda r: O.short_memory_in_order(r.where("kind < 2 or id is null"), 6, 3, mode="recent"),
}


@pytest.mark.parametrize("job", ["answers", "scenes"])
def test_same_for_any_micro_batches_and_arrival(spark, tmp_path, job):
    one, _ = run(spark, tmp_path / "one", [ROWS, end()], JOBS[job])
    seven, _ = run(spark, tmp_path / "seven", [*cut(shaken(ROWS), 7), end()], JOBS[job])
    assert one == seven and len(one) > 100


def test_late_rows_change_nothing_and_are_counted(spark, tmp_path):
    late = [(0, 900 + i, START, O.FRAME, [9.0, 9.0], "late") for i in range(5)]
    parts = cut(ROWS, 2)
    good, none = run(spark, tmp_path / "good", [*parts, end()], JOBS["answers"])
    got, dropped = run(spark, tmp_path / "late", [*parts, late, end()], JOBS["answers"])
    assert got == good and none == 0 and dropped == 5


def plain_answers(rows, chunk=3, interval=2, width=6, remember=3, every=2, recall=2, radius=1):
    """(query id, kind, item) of all contexts by a loop over the rows; texts and the forest by lists."""
    out = []
    for s in range(3):
        frames, turns, since = [], [], 0
        for _, i, _, kind, vector, _ in [r for r in rows if r[0] == s]:
            x = np.array(vector)
            if kind == O.FRAME:
                frames += [x] * (since % every == 0)
                since += 1
                continue
            if kind == O.QUESTION:
                since, n = 0, len(frames)
                near = sorted(range(len(turns)), key=lambda j: (round(float(np.linalg.norm(turns[j][1] - x)), 12), j))[:recall]
                wide = sorted({p for j in near for p in range(j - radius, j + radius + 1) if 0 <= p < len(turns)})
                out += [(i, "dialogue", str(turns[p][0])) for p in wide]
                w = min(n, width)
                keys = {q: np.log(O.draw(42, i, q) + 1e-12) / np.exp(-(q - n + w) / 5.0) for q in range(n - w, n)}
                out += [(i, "short", str(q)) for q in sorted(sorted(keys, key=lambda q: (-keys[q], q))[:remember])]
                levels = [[np.mean(frames[j : j + chunk], axis=0) for j in range(0, n - chunk + 1, chunk)]]
                while len(levels[-1]) >= interval:
                    below = levels[-1]
                    levels.append([np.mean(below[j : j + interval], axis=0) for j in range(0, len(below) - interval + 1, interval)])

                def pick(depth, seqs):
                    return min(seqs, key=lambda q: (-round(O._cosine(levels[depth][q], x), 12), q))

                path = []
                for d, level in enumerate(levels):
                    roots = [q for q in range(len(level)) if d + 1 == len(levels) or q // interval >= len(levels[d + 1])]
                    if d == 0 and roots:
                        path.append((0, pick(0, roots)))
                    for q in roots:
                        for e in range(d - 1, -1, -1):
                            q = pick(e, range(q * interval, (q + 1) * interval))
                            path.append((e, q))
                out += [(i, "tree", f"{d}:{q}") for d, q in sorted(path, key=lambda p: (-p[0], p[1]))]
            turns.append((i, x))
    return out


def test_answers_equal_a_plain_loop(spark, tmp_path):
    folder = tmp_path / "a"
    query = S.append_sink(JOBS["answers"](feed(spark, folder, [ROWS, end()])), f"{folder}/out", f"{folder}/ck")
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").orderBy("stream", "query_id", "place").collect()
    assert [(r.query_id, r.kind, r.item) for r in rows if r.kind != "answer"] == plain_answers(ROWS)
    by_question = {}
    for r in rows:
        by_question.setdefault(r.query_id, []).append(r)
    said = {}
    for parts in by_question.values():
        assert [p.place for p in parts] == list(range(len(parts))) and parts[-1].kind == "answer"
        assert parts[-1].text == (parts[-2].text if len(parts) > 1 else None)
        said[parts[-1].query_id] = parts[-1].text
    # A question and its answer are found by later questions.
    stored = [r for r in rows if r.kind == "dialogue" and int(r.item) in said and said[int(r.item)] is not None]
    assert stored and all(r.text == f"t{r.item}\n{said[int(r.item)]}" for r in stored)


def test_short_memory_equals_the_batch_form(spark, tmp_path):
    """A question after the last frame draws from the frames that the batch form draws from."""
    folder = tmp_path / "s"
    rows = [(*r[:3], O.FRAME, *r[4:]) for r in ROWS]
    asked = [(s, 1000 + s, START + dt.timedelta(minutes=300), O.QUESTION, None, None) for s in range(3)]
    job = O.short_memory_in_order(feed(spark, folder, [rows, asked, end()]), 20, 20)
    S.drain(job, f"{folder}/out", f"{folder}/ck")
    got = {(r.stream, r.id) for r in spark.read.parquet(f"{folder}/out").collect()}
    batch = M.short_memory(spark.createDataFrame(rows, SCHEMA), ["stream"], ["ts", "id"], "id", 20, 20)
    assert got == {(r.stream, r.id) for r in batch.collect()} and len(got) == 60


@pytest.mark.parametrize("k", [None, 2])
def test_forest_equals_the_batch_tree(spark, tmp_path, k):
    folder = tmp_path / "f"
    S.drain(O.forest_in_order(feed(spark, folder, [*cut(shaken(ROWS), 3), end()]), 4, 3, k=k), f"{folder}/out", f"{folder}/ck")
    got = {(r.stream, r.depth, r.seq): r for r in spark.read.parquet(f"{folder}/out").collect()}
    rows = spark.createDataFrame(ROWS, SCHEMA)
    leaves = M.build_leaves(rows, "stream", ["ts", "id"], "vector", 4, k=k, text="text", whole_only=True)
    want = {(r.stream, r.depth, r.seq): r for r in M.build_tree(leaves, 3, k=k, whole_only=True).collect()}
    assert got.keys() == want.keys() and max(d for _, d, _ in got) >= 2
    for key, node in want.items():
        assert np.allclose(got[key].vector, node.vector) and got[key].text == node.text
        assert np.allclose(np.array(got[key].centroids), np.array(node.centroids))


def test_summaries_are_made_once_per_node(spark, tmp_path):
    folder = tmp_path / "f"
    rows = [r for r in ROWS if r[0] == 0]
    job = O.forest_in_order(feed(spark, folder, [*cut(rows, 3), end()]), 4, 3, summarise=lambda texts: f"<{'+'.join(texts)}>")
    S.drain(job, f"{folder}/out", f"{folder}/ck")
    out = {(r.depth, r.seq): r.text for r in spark.read.parquet(f"{folder}/out").collect()}
    assert out[0, 1] == "<" + "+".join(r[5] for r in rows[4:8]) + ">"
    assert out[1, 0] == f"<{out[0, 0]}+{out[0, 1]}+{out[0, 2]}>"


def test_idle_keys_are_forgotten(spark, tmp_path):
    """After a gap a key starts anew, for any micro-batches, and its state leaves the store."""
    gap = dt.timedelta(days=3)
    later = [(s, i + 1000, ts + gap, kind, v, text) for s, i, ts, kind, v, text in ROWS if s < 2]
    hour = 3_600_000
    results, left = [], []
    for name, parts in (("one", [ROWS + later]), ("many", [*cut(ROWS, 2), *cut(later, 2)])):
        folder = tmp_path / name
        job = O.forest_in_order(feed(spark, folder, [*parts, end(60 * 24 * 3 + 400)]), 4, 3, late="10 minutes", idle=hour)
        query = S.append_sink(job, f"{folder}/out", f"{folder}/ck")
        query.awaitTermination()
        results.append(sorted(str(r) for r in spark.read.parquet(f"{folder}/out").collect()))
        left.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert results[0] == results[1]
    first = [r for r in results[0] if "stream=0, depth=0, seq=0," in r]
    assert len(first) == 2  # once before and once after the gap
    plain = tmp_path / "kept"
    query = S.append_sink(O.forest_in_order(feed(spark, plain, [ROWS, later, end(60 * 24 * 3 + 400)]), 4, 3), f"{plain}/out", f"{plain}/ck")
    query.awaitTermination()
    assert max(left) < query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] / 10


def test_log_is_folded_and_replayed(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    log = S.KeyedLog(spark, str(tmp_path / "log"), ["k"], schema, fold=4)
    assert log.read().count() == 0
    want = {}
    for n in range(19):
        rows = [(k, n * 100 + k) for k in range(n % 5, 30, 3)]
        for _ in range(2 if n in (4, 7, 8) else 1):  # some batches are written again
            log.write(spark.createDataFrame(rows, schema), n)
        want.update(rows)
    assert log.generation() == 4
    assert {r.k: r.v for r in log.read().collect()} == want
    read = log.read().inputFiles()
    assert all("generation=4" in f for f in read)  # one base and the open generation


def test_turns_sent_again_are_stored_once(spark, tmp_path):
    folder = tmp_path / "d"
    frames = feed(spark, folder, [ROWS[:100], ROWS[50:150], ROWS[:20]])
    S.dialogue_sink(frames, f"{folder}/out", f"{folder}/ck", ["stream", "id"])
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == 150 and out.select("stream", "id").distinct().count() == 150


def test_advantage_equals_the_batch_form(spark, tmp_path):
    from frameweave.operators.sequencing import prompt_advantage

    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 9)), b, b * 100 + i, float(rng.normal())) for b in range(6) for i in range(30)]
    schema = "prompt long, batch long, id long, reward double"
    for name, parts in (("one", [rows]), ("six", cut(rows, 6))):
        folder = tmp_path / name
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
        feed_ = S.read_frames(spark, f"{folder}/in/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)
        S.batch_sink(
            O.buffered_rewards(feed_, 8),
            lambda batch, n: O.batch_advantage(batch, 5).write.mode("overwrite").parquet(f"{folder}/out/n={n}"), f"{folder}/ck",
        )
        got = {r.id: r.advantage for r in spark.read.parquet(f"{folder}/out").collect()}
        want = prompt_advantage(spark.createDataFrame(rows, schema), "prompt", "batch", ["id"], "reward", 8, 5).collect()
        assert len(got) == len(want) == 180
        assert all(abs(got[r.id] - r.advantage) < 1e-6 for r in want)


def test_keys_of_a_group_do_not_meet(spark, tmp_path):
    """Keys are dealt to few groups; what each of them gives is the same for one group and for many."""
    rows = [(None if r[1] % 23 == 0 else r[1] % 19, *r[1:]) for r in ROWS]
    results = []
    for groups in (1, 64):
        def job(r, groups=groups):
            return O.apply_in_order(r, "stream", O.OrderedGate(1.5), "stream long, id long, at long", "10 minutes", groups=groups)

        results.append(run(spark, tmp_path / str(groups), [*cut(shaken(rows), 2), end()], job)[0])
    before, want = {}, 0
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        last = before.get(r[0])
        want += last is None or float(np.linalg.norm(np.array(last) - np.array(r[4]))) > 1.5
        before[r[0]] = r[4]
    assert results[0] == results[1] and len(results[0]) == want
