"""The byte network: pooling and gradients against plain loops, and held-out labels."""

import numpy as np
import pytest

from frameweave.llm import quality as Q

FOLDER = "/root/testdata/sf0.1"


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


def plain_pooled(net, data):
    """Largest answer over all windows of a text, one by one."""
    data = list(data) + [256] * max(0, Q.CHUNK - len(data))
    windows = [np.concatenate([net.numbers[b] for b in data[i : i + net.width]]) for i in range(len(data) - net.width + 1)]
    return np.maximum(np.max([w @ net.filters for w in windows], axis=0) + net.bias, 0)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 255, 256, 257, 505, 506, 2000])
def test_chunks_cover_every_window(n):
    data = np.arange(n, dtype=np.int64) % 251
    chunks = Q.chunks_of(data.astype(np.uint8))
    seen = {tuple(c[i : i + Q.WIDTH]) for c in chunks for i in range(Q.CHUNK - Q.WIDTH + 1)}
    assert {tuple(data[i : i + Q.WIDTH]) for i in range(n - Q.WIDTH + 1)} <= seen
    assert n < Q.CHUNK or not (chunks == 256).any()


def test_features_see_the_whole_text():
    net = Q.Network.start()
    texts = [as_bytes(t) for t in ("", "a", "été" * 40, "x y " * 5000, "q" * 255 + "!" * 9)]
    got = net.features(texts)
    for row, data in zip(got, texts):
        assert np.allclose(row[: Q.FILTERS], plain_pooled(net, data), atol=1e-5)
    assert np.allclose(got, np.vstack([net.features([t]) for t in texts]), atol=1e-5)
    assert net.features([]).shape == (0, 3 * Q.FILTERS + 1)
    # A sign at the very end of a very long text changes the answer.
    long = "word " * 200_000
    assert not np.allclose(net.features([as_bytes(long + "#@!")]), net.features([as_bytes(long)]))


def test_gradients():
    rng = np.random.default_rng(0)
    net = Q.Network.start()
    net.numbers, net.filters, net.bias = (v.astype(float) for v in (net.numbers, net.filters, net.bias))
    net.bias += 0.1
    net.weights = rng.standard_normal(len(net.weights))
    net.offset = np.array([0.2])
    chunks = np.vstack([Q.chunks_of(rng.integers(32, 127, 700).astype(np.uint8)) for _ in range(3)])
    owner = np.repeat(np.arange(3), 3)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        pooled = net.pooled(chunks)
        k, x = Q.FILTERS, np.zeros((3, 3 * Q.FILTERS + 1))
        for i in range(3):
            p = pooled[owner == i]
            x[i] = np.r_[p.max(0), p.mean(0), p.min(0), 1.0]
        p = Q._sigmoid(x @ net.weights + net.offset[0])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + 0.5e-4 * (net.weights**2).sum()

    got = Q._step(net, chunks, owner, y, weight)
    for value, gradient in zip((net.numbers, net.filters, net.bias, net.weights, net.offset), got):
        flat = value.reshape(-1)
        for at in rng.choice(flat.size, min(12, flat.size), replace=False):
            old = flat[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert gradient.reshape(-1)[at] == pytest.approx((up - down) / 2e-6, abs=2e-4)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_report(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 1000
    right = [r.predicted == r.quality for r in rows]
    bad = [r.predicted == 0 for r in rows if r.quality == 0]
    good = [r.predicted == 1 for r in rows if r.quality == 1]
    assert sum(right) / len(right) >= 0.98 and sum(bad) / len(bad) >= 0.9 and sum(good) / len(good) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_rule(spark):
    from zlib import crc32

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in rows.select("doc_id", Q.held_out(rows.doc_id).alias("h")).collect()}
    assert all(got[i] == (crc32(str(i).encode()) % 3 == 1) for i in range(50)) and got[None] is True


def test_odd_tables(spark):
    schema = "doc_id long, text string, score double, good int, quality_score string"
    rows = [(i, "fine words here" if i % 2 else "### *** !!!", 1.0, 2, "x") for i in range(60)]
    rows += [(None, None, None, None, None), (3, "", 1.0, 2, "x"), (3, "fine words here", 1.0, 2, "x")] + [rows[0]] * 3
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (5, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, schema)
    got = Q.quality_report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    model = Q.train(docs, labels)
    for r in Q.score_texts(docs, model, out="mine").collect():
        assert by_text.setdefault(r.text, r.mine) == r.mine  # equal texts, equal scores
    assert by_text[None] == by_text[""] and by_text["fine words here"] > 0.5 > by_text["### *** !!!"]
    with pytest.raises(ValueError):
        Q.score_texts(docs, model)
    empty = spark.createDataFrame([], schema)
    assert Q.quality_report(empty, labels).collect() == []
    assert {r.score for r in Q.quality_report(docs, labels.limit(0)).collect()} == {0.5}
    one = labels.where("quality = 1")
    assert min(r.score for r in Q.quality_report(docs, one).collect()) > 0.9


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, "text " * 10) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert Q.training_rows(docs, labels, 25).count() == 25
    assert Q.training_rows(docs, labels, 400, 500).count() == 10
