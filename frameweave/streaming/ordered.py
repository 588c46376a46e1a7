"""Keyed state in event time: rows of a key are applied in their order, whatever order they arrive in.

A row waits in state until the watermark has passed it; then no earlier row can come any more, so
results depend neither on the arrival order nor on how rows fall into micro-batches. Rows behind the
watermark are dropped by Spark, which counts them (`numRowsDroppedByWatermark`). A key that gets no rows
for `idle` milliseconds of event time leaves the store.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from frameweave.operators.clustering import lloyd

#: Kinds of rows; of rows at one time and id a question comes first, as it sees what was before it.
QUESTION, FRAME, TURN = 0, 1, 2


#: Groups that the keys are dealt to by hash. A call of Python and a trip to the store cost far more than a
#: row, so a processor is called for a group of keys. A checkpoint keeps the number it began with.
GROUPS = 2048


class InOrder(StatefulProcessor):
    """Subclasses set `fields` (name: type of what a row holds after key, at and id), `held` (name: type of the
    bounded state of a key) and `out` (the output's columns), and define `apply`.

    `apply(key, rows, held)` gets the rows of a key that have become final, as tuples (at, id, *fields) in
    order, and what the key holds, None at first; it returns what the key holds now and output rows as
    tuples. What a key holds is read and written once a call. `drop` removes what else it keeps.
    """

    fields: dict[str, str] = {}
    held: dict[str, str] = {}
    out: tuple[str, ...] = ()
    types: dict[str, str] = {}

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waits = {"key": "long", "at": "long", "id": "long", **self.fields}
        self.whole = [t in ("int", "long") for t in waits.values()]
        self.waiting = handle.getListState("waiting", _schema(waits))
        #: The group's timer, and a time that no key becomes idle before.
        self.clock = handle.getValueState("clock", "timer long, idle long")
        self.cells = handle.getMapState("cells", "key long", _schema({"last": "long", **self.held}))
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the subclass."""

    def apply(self, key, rows: list[tuple], held: tuple | None) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def drop(self, key, held: tuple) -> None:
        pass

    def _wait(self, old: int | None, first: int | None, idle: int | None) -> None:
        """One timer per group: the earlier of the first waiting row's and the idle one."""
        times = [t for t in (first, idle) if t is not None]
        timer = min(times) if times else None
        if old is not None and old != timer:
            self.handle.deleteTimer(old)
        if timer is None:
            self.clock.clear()
            return
        if old != timer:
            self.handle.registerTimer(timer)
        self.clock.update((timer, idle))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["key", "at", "id", *self.fields]
        new = [
            tuple(int(v) if w and v is not None else v for v, w in zip(map(_plain, row), self.whole))
            for part in rows
            for row in part[names].itertuples(index=False, name=None)
        ]
        if new:
            self.waiting.appendList(new)
            first = math.ceil(min(r[1] for r in new) / 1000)
            timer, idle = self.clock.get() if self.clock.exists() else (None, None)
            if timer is None or first < timer:
                self._wait(timer, first, idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        ready: dict[int | None, list[tuple]] = {}
        rest: list[tuple] = []
        for row in self.waiting.get() if self.waiting.exists() else ():
            if row[1] <= reached * 1000:
                ready.setdefault(row[0], []).append(tuple(row[1:]))
            else:
                rest.append(tuple(row))
        idle = self.clock.get()[1] if self.clock.exists() else None
        made: list[tuple] = []
        for one, rows in ready.items():
            last = self._run(one, sorted(rows, key=_place), made)
            if self.idle is not None:
                idle = last // 1000 + self.idle if idle is None else min(idle, last // 1000 + self.idle)
            if len(made) >= 10_000:
                yield self._frame(made)
                made = []
        if made:
            yield self._frame(made)
        if ready or not rest:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if idle is not None and idle <= reached:
            idle = self._sweep(reached, {r[0] for r in rest})
        # The timer that has expired is gone.
        self._wait(None, math.ceil(min(r[1] for r in rest) / 1000) if rest else None, idle)

    def _run(self, key, rows: list[tuple], made: list[tuple]) -> int:
        """Apply a key's rows; returns the time of its last one."""
        cell = self.cells.getValue((key,))
        last, held = (cell[0], tuple(cell[1:])) if cell is not None else (0, None)
        run: list[tuple] = []

        def flush():
            nonlocal held
            if run:
                held, out = self.apply(key, run, held)
                made.extend(out)

        for row in rows:
            # A gap in event time ends what a key holds, wherever micro-batches are cut.
            if self.idle is not None and last and row[0] - last >= self.idle * 1000:
                flush()
                if held is not None:
                    self.drop(key, held)
                held, run = None, []
            run.append(row)
            last = max(last, row[0])
        flush()
        self.cells.updateValue((key,), (last, *held))
        return last

    def _sweep(self, reached: int, waiting: set) -> int | None:
        """Forget keys that got no rows for `idle`; returns when the next one may become idle."""
        following = None
        for one, cell in list(self.cells.iterator()):
            until = cell[0] // 1000 + self.idle
            if one[0] in waiting:
                continue  # its rows come first, and set a new time
            if until > reached:
                following = until if following is None else min(following, until)
            else:
                self.drop(one[0], tuple(cell[1:]))
                self.cells.removeKey((one[0],))
        return following

    def _frame(self, made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(made, columns=list(self.out)).astype(self.types)

    def close(self) -> None:
        pass


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(map(" ".join, columns.items()))


def _grouped(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """`key` as `key`, and the group it is dealt to. Rows without a key have a group of their own."""
    dealt = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(groups))).otherwise(F.lit(-1))
    return rows.withColumns({"key": F.col(key), "_group": dealt.cast("long")})


def _plain(v):
    """Values as the state encoder takes them: Python numbers, lists and None."""
    if isinstance(v, np.ndarray):
        return [float(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else v


def _place(row: tuple) -> tuple:
    return row[:3] if len(row) > 2 and isinstance(row[2], int) else row[:2]


def apply_in_order(rows: DataFrame, key: str, processor: InOrder, schema: str, late: str, groups: int = GROUPS) -> DataFrame:
    """`rows` (ts timestamp, id long, `key` and the processor's fields) through a processor; rows more than
    `late` behind the newest are dropped.
    """
    timed = _grouped(rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts")), key, groups)
    timed = timed.select("_group", "key", "ts", "at", "id", *processor.fields)
    return timed.groupBy("_group").transformWithStateInPandas(processor, schema, "Append", "eventTime")


def draw(seed: int, *ids) -> float:
    """`functions.hashing.u` for one row."""
    text = ":".join(map(str, (seed, *ids)))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


# ---- gate ---------------------------------------------------------------------------------------


def _ssim(a: np.ndarray, b: np.ndarray, span: float = 1.0) -> float:
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = a.mean(), b.mean()
    spread = (a * a).mean() - ma * ma + (b * b).mean() - mb * mb
    return ((2 * ma * mb + c1) * (2 * ((a * b).mean() - ma * mb) + c2)) / ((ma * ma + mb * mb + c1) * (spread + c2))


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size > 0 else 0.0


#: Whether frame b has changed from frame a beyond a threshold.
MOVED: dict[str, Callable[[np.ndarray, np.ndarray, float], bool]] = {
    "l1": lambda a, b, t: np.abs(a - b).sum() > t,
    "l2": lambda a, b, t: np.sqrt(((a - b) ** 2).sum()) > t,
    "cosine": lambda a, b, t: 1 - _cosine(a, b) > t,
    "ssim": lambda a, b, t: _ssim(a, b) < t,
}


class OrderedGate(InOrder):
    """Frames that differ from the frame before them; the twin of `operators.memory.change_gate`."""

    fields = {"vector": "array<double>"}
    held = {"before": "array<double>"}
    out = ("stream", "id", "at")

    def __init__(self, threshold: float, distance: str = "l2", idle: int | None = None):
        super().__init__(idle)
        if distance not in MOVED:
            raise ValueError(f"unknown distance {distance!r}")
        self.threshold, self.distance = threshold, distance

    def apply(self, key, rows, held):
        before = np.array(held[0]) if held is not None else None
        kept = []
        for at, i, vector in rows:
            vector = np.array(vector)
            if before is None or MOVED[self.distance](before, vector, self.threshold):
                kept.append((key, i, at))
            before = vector
        return (before.tolist(),), kept


def gate_in_order(frames: DataFrame, threshold: float, distance: str = "l2", late: str = "10 minutes", idle: int | None = None) -> DataFrame:
    """(stream, id, at) of changed frames of `frames` (stream, id, ts, vector)."""
    return apply_in_order(frames, "stream", OrderedGate(threshold, distance, idle), "stream long, id long, at long", late)


# ---- recall strength ----------------------------------------------------------------------------


class OrderedRecalls(InOrder):
    """One row per recall: the memory's strength and last recall after it. Strength starts at 1."""

    held = {"n": "long"}
    out = ("memory_id", "id", "strength", "at")

    def apply(self, key, rows, held):
        n = held[0] if held is not None else 1
        return (n + len(rows),), [(key, i, n + j, at) for j, (at, i) in enumerate(rows, 1)]


def recalls_in_order(recalls: DataFrame, late: str = "10 minutes", idle: int | None = None) -> DataFrame:
    """(memory_id, id, strength, at) after each recall of `recalls` (memory_id, id, ts)."""
    return apply_in_order(recalls, "memory_id", OrderedRecalls(idle), "memory_id long, id long, strength long, at long", late)


# ---- window, forest, dialogue -------------------------------------------------------------------


class Window:
    """The last `width` frames of a stream, and draws from them as `operators.memory.short_memory` makes them."""

    def __init__(self, width: int, remember: int, tau: float, seed: int, mode: str):
        if mode not in ("literal", "recent"):
            raise ValueError(f"unknown mode {mode!r}")
        self.width, self.remember, self.tau, self.seed, self.mode = width, remember, tau, seed, mode

    held = {"seen": "long", "window": "array<struct<id:long,text:string>>"}

    def load(self, held: tuple | None) -> None:
        seen, rows = held if held is not None else (0, [])
        self.seen, self.rows = seen, [tuple(r) for r in rows]

    def add(self, i: int, text: str | None) -> None:
        self.rows.append((i, text))
        self.seen += 1
        del self.rows[: -self.width]

    def save(self) -> tuple:
        return self.seen, self.rows

    def chosen(self, *ids) -> list[tuple]:
        """(seq, id, text) of at most `remember` frames by retention weight, oldest first; `ids` seed the draw."""
        n, scored = len(self.rows), []
        for j, (i, text) in enumerate(self.rows):
            seq, age = self.seen - n + j, j if self.mode == "literal" else n - 1 - j
            key = math.log(draw(self.seed, *ids, seq) + 1e-12) / math.exp(-age / self.tau)
            scored.append((-key, seq, i, text))
        return sorted(s[1:] for s in sorted(scored, key=lambda s: s[:2])[: self.remember])


class Nodes:
    """A forest that grows by frames: leaves of `chunk`, parents of `interval`, all merges done.

    Every node has the mean of its children's vectors, at most `k` centroids of theirs (its frames'
    vectors, or just its own vector without `k`), and a text: that of the child nearest to the mean, or
    what `summarise` makes of all of them, called once when the node is closed. The twin of
    `operators.memory.build_tree(whole_only=True)`.
    """

    def __init__(self, chunk: int, interval: int, k: int | None = None, summarise: Callable[[list], str] | None = None, seed: int = 42):
        if interval < 2:
            raise ValueError("interval must be at least 2")
        self.chunk, self.interval, self.k, self.summarise, self.seed = chunk, interval, k, summarise, seed

    held = {"leaves": "long", "open": "array<struct<vector:array<double>,text:string>>"}

    def open(self, handle) -> None:
        self.nodes = handle.getMapState("nodes", "key long, depth int, seq long", "vector array<double>, centroids array<array<double>>, text string")

    def load(self, key, held: tuple | None) -> None:
        self.key = key
        leaves, rows = held if held is not None else (0, [])
        self.leaves, self.rows = leaves, [(np.array(r[0]), r[1]) for r in rows]
        self.near: dict[tuple, tuple] = {}

    def save(self) -> tuple:
        return self.leaves, [(v.tolist(), t) for v, t in self.rows]

    def drop(self, key, leaves: int) -> None:
        depth, count = 0, leaves
        while count:
            for seq in range(count):
                self.nodes.removeKey((key, depth, seq))
            depth, count = depth + 1, count // self.interval

    def get(self, depth: int, seq: int) -> tuple:
        """(vector, centroids, text) of a node; each is read from the store once per call."""
        if (depth, seq) not in self.near:
            vector, centroids, text = self.nodes.getValue((self.key, depth, seq))
            self.near[depth, seq] = np.array(vector), [list(c) for c in centroids], text
        return self.near[depth, seq]

    def _close(self, depth: int, seq: int, children: list[tuple]) -> tuple:
        vectors = np.stack([c[0] for c in children])
        mean = vectors.mean(axis=0)
        if self.summarise is not None:
            text = self.summarise([c[-1] for c in children])
        else:
            text = children[int(np.round(((vectors - mean) ** 2).sum(axis=1), 12).argmin())][-1]
        if depth:
            centroids = [c for _, part, _ in children for c in part] if self.k is not None else [mean.tolist()]
        else:
            centroids = vectors.tolist()
        if self.k is not None and len(centroids) > self.k:
            x = np.array(centroids)
            order = np.random.default_rng(self.seed).permutation(len(x))
            centroids = lloyd(x, np.ones(len(x)), order, self.k)[0].tolist()
        self.near[depth, seq] = mean, centroids, text
        self.nodes.updateValue((self.key, depth, seq), (mean.tolist(), centroids, text))
        return depth, seq, mean.tolist(), centroids, text

    def add(self, vector: np.ndarray, text: str | None) -> list[tuple]:
        """The nodes that a frame closes, finest first, as (depth, seq, vector, centroids, text)."""
        self.rows.append((np.asarray(vector, float), text))
        if len(self.rows) < self.chunk:
            return []
        made = [self._close(0, self.leaves, self.rows)]
        self.rows, self.leaves = [], self.leaves + 1
        depth, count = 0, self.leaves
        while count % self.interval == 0:
            children = [self.get(depth, s) for s in range(count - self.interval, count)]
            depth, count = depth + 1, count // self.interval
            made.append(self._close(depth, count - 1, children))
        return made

    def roots(self) -> list[tuple[int, int]]:
        """(depth, seq) of the nodes without a parent: the digits of the leaf count in base `interval`."""
        out, depth, count = [], 0, self.leaves
        while count:
            out += [(depth, s) for s in range(count - count % self.interval, count)]
            depth, count = depth + 1, count // self.interval
        return out

    def descend(self, query: np.ndarray, score: Callable[[np.ndarray, np.ndarray], float]) -> list[tuple[int, int, str]]:
        """(depth, seq, text) of the best child at each step from each root, and of the best root that is a leaf; coarse first."""
        def best(nodes: list[tuple[int, int]]) -> tuple[int, int]:
            return min(nodes, key=lambda n: (-round(score(self.get(*n)[0], query), 12), n[1]))

        roots, path = self.roots(), []
        flat = [r for r in roots if r[0] == 0]
        if flat:
            path.append(best(flat))
        for depth, seq in roots:
            while depth:
                depth, seq = best([(depth - 1, s) for s in range(seq * self.interval, (seq + 1) * self.interval)])
                path.append((depth, seq))
        return [(d, s, self.get(d, s)[2]) for d, s in sorted(path, key=lambda n: (-n[0], n[1]))]


SCORES: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "cosine": _cosine,
    "dot": lambda a, b: float(a @ b),
    "l2": lambda a, b: -float(np.sqrt(((a - b) ** 2).sum())),
}


class MemoryForest(InOrder):
    """Node rows with centroids and text, as they are closed."""

    fields = {"vector": "array<double>", "text": "string"}
    held = Nodes.held
    out = ("stream", "depth", "seq", "vector", "centroids", "text")
    types = {"depth": "int32"}

    def __init__(self, forest: Nodes, idle: int | None = None):
        super().__init__(idle)
        self.forest = forest

    def start(self, handle) -> None:
        self.forest.open(handle)

    def drop(self, key, held) -> None:
        self.forest.drop(key, held[0])

    def apply(self, key, rows, held):
        self.forest.load(key, held)
        made = [(key, *n) for _, _, vector, text in rows for n in self.forest.add(vector, text)]
        return self.forest.save(), made


FOREST_SCHEMA = "stream long, depth int, seq long, vector array<double>, centroids array<array<double>>, text string"


def forest_in_order(
    frames: DataFrame, chunk: int, interval: int, k: int | None = None, summarise=None, seed: int = 42,
    late: str = "10 minutes", idle: int | None = None,
) -> DataFrame:
    """Nodes of each stream's forest from `frames` (stream, id, ts, vector, text); the parent of (d, s) is (d + 1, s // interval)."""
    return apply_in_order(frames, "stream", MemoryForest(Nodes(chunk, interval, k, summarise, seed), idle), FOREST_SCHEMA, late)


class ShortMemory(InOrder):
    """At each question what the short memory holds: a weighted draw from the last frames before it."""

    fields = {"kind": "int", "text": "string"}
    held = Window.held
    out = ("stream", "query_id", "seq", "id", "text")

    def __init__(self, window: Window, idle: int | None = None):
        super().__init__(idle)
        self.window = window

    def apply(self, key, rows, held):
        self.window.load(held)
        out = []
        for _, i, kind, text in rows:
            if kind == FRAME:
                self.window.add(i, text)
            else:
                out += [(key, i, *chosen) for chosen in self.window.chosen(i)]
        return self.window.save(), out


def short_memory_in_order(
    rows: DataFrame, width: int = 20, remember: int = 5, tau: float = 5.0, seed: int = 42, mode: str = "literal",
    late: str = "10 minutes", idle: int | None = None,
) -> DataFrame:
    """(stream, query_id, seq, id, text) for the questions in `rows` (stream, id, ts, kind, text)."""
    processor = ShortMemory(Window(width, remember, tau, seed, mode), idle)
    return apply_in_order(rows, "stream", processor, "stream long, query_id long, seq long, id long, text string", late)


#: Turns of a stream that are stored and read together.
PAGE_TURNS = 64


class StreamAnswers(InOrder):
    """Questions answered where they stand in the stream, from all memories that it has by then.

    * A frame enters the window and the forest if it is one of every `every` frames since the last question.
    * A turn of a dialogue is stored with its vector.
    * A question recalls the `recall` stored turns nearest to it, with `radius` turns on both sides of each,
      draws from the window, descends the forest, and gets an answer from these texts in this order,
      the finest last. Question and answer are then stored as a turn, so later questions find them.

    The window and a forest's open chunk are bounded; nodes and pages of turns stay in the store until the
    stream has been idle, are read by key, and a question reads a node per child on its path.
    """

    fields = {"kind": "int", "vector": "array<double>", "text": "string"}
    held = {**Window.held, **Nodes.held, "since": "long", "said": "long"}
    out = ("stream", "query_id", "place", "kind", "depth", "item", "text")
    types = {"place": "int32", "depth": "Int32"}

    def __init__(
        self, window: Window, forest: Nodes, every: int = 1, recall: int = 3, radius: int = 0, score: str = "cosine",
        answer: Callable[[str | None, Sequence[str | None]], str | None] | None = None, idle: int | None = None,
    ):
        super().__init__(idle)
        self.window, self.forest, self.every, self.recall, self.radius = window, forest, every, recall, radius
        self.score, self.answer = score, answer or finest

    def start(self, handle) -> None:
        self.forest.open(handle)
        self.turns = handle.getMapState("turns", "key long, page long", "rows array<struct<id:long,vector:array<double>,text:string>>")

    def drop(self, key, held) -> None:
        self.forest.drop(key, held[2])
        for page in range(-(-held[5] // PAGE_TURNS)):
            self.turns.removeKey((key, page))

    def _recalled(self, turns: list[tuple], query: np.ndarray) -> list[tuple]:
        """Turns near the question, in the order they were said."""
        if not turns or not self.recall:
            return []
        gaps = np.round(np.sqrt(((np.stack([t[1] for t in turns]) - query) ** 2).sum(axis=1)), 12)
        hits = np.argsort(gaps, kind="stable")[: self.recall]
        places = {p for h in hits.tolist() for p in range(h - self.radius, h + self.radius + 1)}
        return [turns[p] for p in sorted(places) if 0 <= p < len(turns)]

    def apply(self, key, rows, held):
        self.window.load(held[:2] if held is not None else None)
        self.forest.load(key, held[2:4] if held is not None else None)
        since, known = held[4:] if held is not None else (0, 0)
        pages = [self.turns.getValue((key, page))[0] for page in range(-(-known // PAGE_TURNS))]
        turns = [(t[0], np.array(t[1]), t[2]) for page in pages for t in page]
        out = []
        for _, i, kind, vector, text in rows:
            vector = np.array(vector, float)
            if kind == FRAME:
                if since % self.every == 0:
                    self.window.add(i, text)
                    self.forest.add(vector, text)
                since += 1
                continue
            if kind == QUESTION:
                since = 0
                context = [("dialogue", None, str(t[0]), t[2]) for t in self._recalled(turns, vector)]
                context += [("short", None, str(seq), t) for seq, _, t in self.window.chosen(i)]
                context += [("tree", d, f"{d}:{s}", t) for d, s, t in self.forest.descend(vector, SCORES[self.score])]
                said = self.answer(text, [c[-1] for c in context])
                out += [(key, i, place, *c) for place, c in enumerate([*context, ("answer", None, str(i), said)])]
                text = "\n".join(t for t in (text, said) if t is not None)
            turns.append((i, vector, text))
        for page in range(known // PAGE_TURNS, -(-len(turns) // PAGE_TURNS)) if len(turns) > known else ():
            part = turns[page * PAGE_TURNS : (page + 1) * PAGE_TURNS]
            self.turns.updateValue((key, page), ([(i, v.tolist(), t) for i, v, t in part],))
        return (*self.window.save(), *self.forest.save(), since, len(turns)), out


def finest(question: str | None, texts: Sequence[str | None]) -> str | None:
    """Stand-in for a model: the finest text of the context."""
    return texts[-1] if texts else None


ANSWERS = "stream long, query_id long, place int, kind string, depth int, item string, text string"


def answers_in_order(
    rows: DataFrame, chunk: int = 40, interval: int = 10, k: int | None = None, width: int = 20, remember: int = 5, tau: float = 5.0,
    every: int = 1, recall: int = 3, radius: int = 0, score: str = "cosine", answer=None, summarise=None, seed: int = 42,
    mode: str = "literal", late: str = "10 minutes", idle: int | None = None,
) -> DataFrame:
    """Context items and answers of all questions: one streaming query over `rows` (stream, id, ts, kind, vector, text).

    Items of a question are numbered by `place`; the last one is its answer.
    """
    window, forest = Window(width, remember, tau, seed, mode), Nodes(chunk, interval, k, summarise, seed)
    processor = StreamAnswers(window, forest, every, recall, radius, score, answer, idle)
    return apply_in_order(rows, "stream", processor, ANSWERS, late)


# ---- advantage ----------------------------------------------------------------------------------


class RewardBuffer(StatefulProcessor):
    """Mean and spread of a prompt's last `size` rewards, as known once a batch of rewards is in.

    A batch must arrive in one micro-batch; a micro-batch may hold several.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "key long", "rewards array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["key", "batch", "id"], ignore_index=True)
        prompts = rows["key"].tolist()
        batches, rewards = rows["batch"].to_numpy(), rows["reward"].tolist()
        new = np.flatnonzero((rows["key"].ne(rows["key"].shift()) | rows["batch"].ne(rows["batch"].shift())).to_numpy())
        if pd.isna(prompts[0]):  # rows without a key are a group of their own
            prompts, new = [None] * len(rows), np.flatnonzero(rows["batch"].ne(rows["batch"].shift()).to_numpy())
        ends = [*new[1:].tolist(), len(rows)]
        known, mean, std = np.empty(len(rows), np.int64), np.empty(len(rows)), np.empty(len(rows))
        for a, b in zip(new.tolist(), ends):
            if a == 0 or prompts[a] != prompts[a - 1]:
                prompt = prompts[a]
                cell = self.last.getValue((prompt,))
                last = list(cell[0]) if cell is not None else []
            last = (last + rewards[a:b])[-self.size :]
            known[a:b], mean[a:b], std[a:b] = len(last), np.mean(last), np.std(last)
            if b == len(rows) or prompts[b] != prompt:
                self.last.updateValue((prompt,), (last,))
        yield pd.DataFrame(
            {"prompt": prompts, "batch": batches, "id": rows["id"], "reward": rows["reward"], "known": known, "mean": mean, "std": std}
        )

    def close(self) -> None:
        pass


def buffered_rewards(rewards: DataFrame, size: int, groups: int = GROUPS) -> DataFrame:
    """`rewards` (prompt long, batch long, id long, reward double) with the buffer's known, mean and std."""
    schema = "prompt long, batch long, id long, reward double, known long, mean double, std double"
    dealt = _grouped(rewards, "prompt", groups).select("_group", "key", "batch", "id", "reward")
    return dealt.groupBy("_group").transformWithStateInPandas(RewardBuffer(size), schema, "Append", "None")


def batch_advantage(buffered: DataFrame, min_count: int) -> DataFrame:
    """(prompt, batch, id, advantage) of one micro-batch of `buffered_rewards`, to be called by its sink.

    A prompt that knows fewer than `min_count` rewards is measured by its whole batch, which is
    complete in the micro-batch.
    """
    whole = buffered.groupBy("batch").agg(F.avg("reward").alias("_m"), F.stddev_pop("reward").alias("_s"))
    own = F.col("known") >= min_count
    mean, std = F.when(own, F.col("mean")).otherwise(F.col("_m")), F.when(own, F.col("std")).otherwise(F.col("_s"))
    joined = buffered.join(F.broadcast(whole), "batch")  # one row per batch of a micro-batch
    return joined.select("prompt", "batch", "id", ((F.col("reward") - mean) / (std + 1e-6)).alias("advantage"))
