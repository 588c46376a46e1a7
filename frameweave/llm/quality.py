"""Quality of texts by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it, so that every window of
WIDTH bytes lies whole in a chunk. Each byte has a learned vector, learned filters run over all
windows, and each filter keeps its largest answer per chunk (max pooling). A text is described by
the largest, mean and least of its chunks' answers (the last tells repeated words, to which few
filters answer), and a logistic layer turns them into one probability.

Bytes, filters and a first output layer are learned together by gradient steps on a bounded sample
of labelled texts; the output layer is then fitted again on the features of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled rows and bytes of their texts that are learned from at most, the first by a hash of the id.
SAMPLE, SAMPLE_BYTES = 4_000, 24 << 20
#: Bytes in a window, numbers per byte, filters, bytes in a chunk.
WIDTH, NUMBERS, FILTERS, CHUNK = 8, 6, 16, 256
#: Chunks drawn from a text in a gradient step, texts in a step, rounds over the sample, step size.
DRAWN, BATCH, ROUNDS, RATE = 4, 32, 4, 4e-3
#: Chunks whose windows are held at once when texts are scored.
AT_ONCE = 32
_PAD = 256  # stands after the end of a text


def chunks_of(data: np.ndarray, width: int = WIDTH, chunk: int = CHUNK) -> np.ndarray:
    """Bytes as rows of `chunk` numbers that overlap by width - 1 or more, the last ending with the text.

    A text shorter than a chunk is filled up with the end sign.
    """
    if len(data) < chunk:
        return np.pad(data.astype(np.int16), (0, chunk - len(data)), constant_values=_PAD)[None]
    step = chunk - width + 1
    starts = np.r_[np.arange(0, len(data) - chunk, step), len(data) - chunk]
    return np.lib.stride_tricks.sliding_window_view(data, chunk)[starts].astype(np.int16)


def _largest(a: np.ndarray) -> np.ndarray:
    """Maximum over the middle axis, by halving it, which keeps the inner loops long."""
    while (n := a.shape[1]) > 8:
        half = n // 2
        top = np.maximum(a[:, :half], a[:, half : 2 * half])
        if n % 2:
            np.maximum(top[:, :1], a[:, -1:], out=top[:, :1])
        a = top
    return a.max(axis=1)


@dataclass
class Network:
    """Byte vectors (257, NUMBERS), filters (WIDTH * NUMBERS, FILTERS), their bias, and the output layer."""

    numbers: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    @staticmethod
    def start(seed: int = 3, width: int = WIDTH, numbers: int = NUMBERS, filters: int = FILTERS) -> "Network":
        rng = np.random.default_rng(seed)
        table = rng.standard_normal((_PAD + 1, numbers)).astype(np.float32) * 0.5
        table[_PAD] = 0
        kernel = rng.standard_normal((width * numbers, filters)).astype(np.float32) * (1.5 / np.sqrt(width * numbers))
        zeros = np.zeros(filters, np.float32)
        return Network(table, kernel, zeros, np.zeros(3 * filters + 1), 0.0)

    @property
    def width(self) -> int:
        return len(self.filters) // self.numbers.shape[1]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, width * numbers): the byte vectors of each window."""
        seen = np.take(self.numbers, chunks.astype(np.intp), axis=0)
        n, length, k = seen.shape
        views = np.lib.stride_tricks.sliding_window_view(seen.reshape(n, length * k), self.width * k, axis=1)
        return np.ascontiguousarray(views[:, ::k])

    def answers(self, windows: np.ndarray) -> np.ndarray:
        """(chunks, positions, filters): answers of all filters before pooling."""
        return (windows.reshape(-1, windows.shape[2]) @ self.filters).reshape(*windows.shape[:2], -1)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each chunk, at least 0."""
        return np.maximum(_largest(self.answers(self.windows(chunks))) + self.bias, 0)

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest, mean and least pooled answer over all chunks of each text, and the share of a chunk it fills.

        AT_ONCE chunks are held at a time, whatever the length of the texts.
        """
        k = self.filters.shape[1]
        top, total, least = np.zeros((len(texts), k)), np.zeros((len(texts), k)), np.full((len(texts), k), np.inf)
        held: list[tuple[int, np.ndarray]] = []
        room = AT_ONCE

        def settle() -> None:
            owner = np.repeat([i for i, _ in held], [len(c) for _, c in held])
            got = self.pooled(np.concatenate([c for _, c in held]))
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            who = owner[starts]
            top[who] = np.maximum(top[who], np.maximum.reduceat(got, starts))
            total[who] += np.add.reduceat(got.astype(float), starts)
            least[who] = np.minimum(least[who], np.minimum.reduceat(got, starts))
            held.clear()

        counts = np.ones((len(texts), 1))
        for i, data in enumerate(texts):
            rows, at = chunks_of(data, self.width), 0
            counts[i] = len(rows)
            while at < len(rows):
                part = rows[at : at + room]
                held.append((i, part))
                at, room = at + len(part), room - len(part)
                if not room:
                    settle()
                    room = AT_ONCE
        if held:
            settle()
        fill = np.minimum([[len(d)] for d in texts], CHUNK) / CHUNK if texts else np.zeros((0, 1))
        return np.hstack([top, total / counts, least, fill])

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        # Summed row by row: a product of the whole matrix may round equal rows apart.
        return _sigmoid((self.features(texts) * self.weights).sum(axis=1) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# ---- learning -----------------------------------------------------------------------------------


class _Steps:
    """Gradient steps with running means of gradients and their squares (Adam)."""

    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.mean, self.square = ([np.zeros_like(v) for v in values] for _ in range(2))

    def take(self, gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for v, g, m, q in zip(self.values, gradients, self.mean, self.square):
            m += 0.1 * (g - m)
            q += 0.001 * (g * g - q)
            v -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(q / (1 - 0.999**self.t)) + 1e-8)).astype(v.dtype)


def _step(net: Network, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss by (numbers, filters, bias, weights, offset); `owner` numbers the texts."""
    n, k = len(y), net.filters.shape[1]
    windows = net.windows(chunks)
    answers = net.answers(windows)
    best = answers.argmax(axis=1)
    chunk, f = np.arange(len(chunks))[:, None], np.arange(k)
    raw = answers[chunk, best, f] + net.bias
    pooled = np.maximum(raw, 0)
    sizes = np.bincount(owner, minlength=n)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    top, low = np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts)
    fill = (chunks != _PAD).mean(axis=1)[starts]
    x = np.hstack([top, np.add.reduceat(pooled, starts) / sizes[:, None], low, fill[:, None]])
    away = weight * (_sigmoid(x @ net.weights + net.offset[0]) - y) / n
    dx = away[:, None] * net.weights
    dpool = (dx[:, k : 2 * k] / sizes[:, None])[owner]
    for edge, d in ((top, dx[:, :k]), (low, dx[:, 2 * k : 3 * k])):
        held = pooled == edge[owner]
        dpool = dpool + (d / np.add.reduceat(held.astype(float), starts))[owner] * held
    dpool = (dpool * (raw > 0)).astype(np.float32)
    # Only the winning window of each chunk and filter has a gradient.
    won = windows[chunk, best]
    dfilters = np.einsum("cfw,cf->wf", won, dpool)
    dwon = (dpool[:, :, None] * net.filters.T[None]).reshape(len(chunks), k, net.width, -1)
    where = chunks[chunk[:, :, None], best[:, :, None] + np.arange(net.width)]
    at, each = where.ravel(), dwon.reshape(-1, dwon.shape[3])
    dnumbers = np.stack([np.bincount(at, c, _PAD + 1) for c in each.T], axis=1)
    return [dnumbers, dfilters, dpool.sum(0), x.T @ away + 1e-4 * net.weights, np.array([away.sum()])]


def learn(texts: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> Network:
    """Network from texts (as bytes) and labels 0 or 1; both classes weigh the same while filters are learned."""
    net = Network.start(seed)
    rng = np.random.default_rng(seed)
    net.weights = rng.standard_normal(len(net.weights)) * 0.1
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    net.offset = np.zeros(1)
    steps = _Steps([net.numbers, net.filters, net.bias, net.weights, net.offset], RATE)
    total, done = rounds * -(-len(texts) // BATCH), 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            part = order[s : s + BATCH]
            rows = [chunks_of(texts[i]) for i in part]
            rows = [r if len(r) <= DRAWN else r[rng.choice(len(r), DRAWN, replace=False)] for r in rows]
            owner = np.repeat(np.arange(len(part)), [len(r) for r in rows])
            steps.take(_step(net, np.concatenate(rows), owner, y[part], weight[part]), RATE * (1 - done / total))
            done += 1
    net.weights, net.offset = fit_output(net.features(texts), y)
    return net


def fit_output(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic layer by Newton's method, with a ridge in units of each feature's spread."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge * len(x) ** 0.5), 1e-6]
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w = w + move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-7:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


# ---- tables -------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that no label is learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, good) of at most `sample` labelled rows and `most_bytes` bytes, in the order of a hash of the id.

    Rows without an id or a label are left out; of several labels of one id the larger counts. The
    bounds hold for rows of `documents`, so ids that repeat there cannot exceed them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it is broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    rows = rows.withColumn("size", F.octet_length("text")).orderBy(*order).limit(sample)
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # `sample` rows at most
    return rows.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("text", "good")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, **options) -> Network:
    """Network from the bounded sample. Without labels of both classes every text gets the only class's score, or 0.5."""
    got = training_rows(docs, labels, sample, most_bytes).toArrow()
    texts, good = _bytes(got.column("text").combine_chunks()), got.column("good").to_numpy(zero_copy_only=False).astype(float)
    if not len(good) or good.min() == good.max():
        net = Network.start()
        net.offset = 4.0 * (2 * good[0] - 1) if len(good) else 0.0
        return net
    return learn(texts, good, **options)


def _bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each text, without a copy; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(at, at[1:])]


def score_texts(docs: DataFrame, model: Network, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Adds `out` (double, 0 to 1) from the whole text alone; null counts as empty.

    A column named `out` must not exist (ValueError). Rows are scored one by one, so repeated rows, null
    ids, empty tables and other columns pass unchanged.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(sent.value.scores(_bytes(column)), pa.float64())

    return docs.withColumn(out, scores(F.col(text)))


def quality_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every document."""
    model = train(docs, labels, sample, most_bytes)
    scored = score_texts(docs.select("doc_id", "text"), model, out="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
