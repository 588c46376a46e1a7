"""Keyed state for unbounded streams, applied as rows arrive: change gate, forest, recall strength.

Rows of a micro-batch are put in order of (ts, id) before they are applied, and a row that comes in a
later micro-batch counts as newer. `ordered` has the forms that keep event time, with late rows
dropped and idle keys forgotten. The number of rows per micro-batch is bounded by the source
(`maxFilesPerTrigger` and the like).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    if not parts:
        return pd.DataFrame()
    return pd.concat(parts).sort_values(["ts", "id"], ignore_index=True)


class ChangeGate(StatefulProcessor):
    """Emit a frame when it is further than `threshold` from the frame before it."""

    def __init__(self, threshold: float, distance: str = "l2"):
        self.threshold, self.distance = threshold, distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "vector array<double>")

    def _moved(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row, whether the distance exceeds the threshold."""
        if self.distance == "l1":
            gap = np.abs(a - b).sum(axis=1)
        elif self.distance == "cosine":
            size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            gap = 1 - np.divide((a * b).sum(axis=1), size, out=np.zeros(len(a)), where=size > 0)
        else:
            gap = np.sqrt(((a - b) ** 2).sum(axis=1))
        return gap > self.threshold

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows)
        if batch.empty:
            return
        vectors = np.stack([np.asarray(v, float) for v in batch["vector"]])
        before = np.asarray(self.last.get()[0], float) if self.last.exists() else None
        earlier = np.vstack([vectors[:1] if before is None else before[None], vectors[:-1]])
        keep = self._moved(earlier, vectors)
        if before is None:
            keep[0] = True
        self.last.update((vectors[-1].tolist(),))
        kept = batch[keep]
        if len(kept):
            yield pd.DataFrame({"stream": key[0], "id": kept["id"], "ts": kept["ts"]})

    def close(self) -> None:
        pass


GATE_SCHEMA = "stream long, id long, ts timestamp"


def gate_stream(frames: DataFrame, threshold: float, distance: str = "l2") -> DataFrame:
    """`frames`: stream long, id long, ts timestamp, vector array<double>."""
    return frames.groupBy("stream").transformWithStateInPandas(
        ChangeGate(threshold, distance), GATE_SCHEMA, "Append", "None"
    )


class Forest(StatefulProcessor):
    """Leaves from `chunk` frames each, merged `interval` at a time as they come.

    State: the open chunk's sum and count, the roots in order with their depth, number and vector,
    and the next number per depth. The unit of update is a completed leaf, so results do not depend
    on how frames fall into micro-batches. `fixpoint=False` makes at most one merge per leaf.
    """

    def __init__(self, chunk: int, interval: int, fixpoint: bool = True):
        self.chunk, self.interval, self.fixpoint = chunk, interval, fixpoint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "total array<double>, n long")
        self.roots = handle.getListState("roots", "depth int, seq long, vector array<double>")
        self.next = handle.getMapState("next", "depth int", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows)
        if batch.empty:
            return
        total, n = None, 0
        if self.open.exists():
            saved = self.open.get()
            total, n = np.asarray(saved[0], float), saved[1]
        roots = [(r[0], r[1], np.asarray(r[2], float)) for r in self.roots.get()] if self.roots.exists() else []
        made = []
        for vector in batch["vector"]:
            vector = np.asarray(vector, float)
            total, n = (vector if n == 0 else total + vector), n + 1
            if n == self.chunk:
                leaf = (0, self._number(0), total / n)
                roots.append(leaf)
                made.append(leaf)
                n = 0
                made.extend(self._merge(roots))
        self.open.update(((np.zeros(1) if n == 0 else total).tolist(), n))
        if roots:
            self.roots.put([(d, s, v.tolist()) for d, s, v in roots])
        if made:
            yield pd.DataFrame(
                {
                    "stream": key[0],
                    "depth": pd.array([d for d, _, _ in made], dtype="int32"),
                    "seq": [s for _, s, _ in made],
                    "vector": [v.tolist() for _, _, v in made],
                }
            )

    def _number(self, depth: int) -> int:
        seq = self.next.getValue((depth,))[0] if self.next.containsKey((depth,)) else 0
        self.next.updateValue((depth,), (seq + 1,))
        return seq

    def _merge(self, roots: list) -> list:
        made = []
        while True:
            depth = merge_depth([d for d, _, _ in roots], self.interval)
            at = [i for i, (d, _, _) in enumerate(roots) if d == depth][: self.interval]
            if len(at) < self.interval:
                return made
            if at != list(range(at[0], at[0] + self.interval)):
                raise ValueError("roots of one depth are not neighbours")
            node = (depth + 1, self._number(depth + 1), np.mean([roots[i][2] for i in at], axis=0))
            roots[at[0] : at[0] + self.interval] = [node]
            made.append(node)
            if not self.fixpoint:
                return made

    def close(self) -> None:
        pass


def merge_depth(depths: list[int], interval: int) -> int:
    """Highest depth whose number of roots is a positive multiple of `interval`, else 0."""
    full = [d for d in set(depths) if depths.count(d) % interval == 0]
    return max(full, default=0)


FOREST_SCHEMA = "stream long, depth int, seq long, vector array<double>"


def forest_stream(frames: DataFrame, chunk: int, interval: int, fixpoint: bool = True) -> DataFrame:
    """Node rows as they come to be; the parent of (d, s) is (d + 1, s // interval)."""
    return frames.groupBy("stream").transformWithStateInPandas(
        Forest(chunk, interval, fixpoint), FOREST_SCHEMA, "Append", "None"
    )


class RecallStrength(StatefulProcessor):
    """Strength and last recall of each memory; every recall adds 1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "strength long, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = 0, None
        for part in rows:
            n += len(part)
            newest = part["ts"].max()
            last = newest if last is None or newest > last else last
        strength = 1
        if self.state.exists():
            saved = self.state.get()
            strength, last = saved[0], max(pd.Timestamp(saved[1]), last)
        self.state.update((strength + n, last.to_pydatetime()))
        yield pd.DataFrame({"memory_id": [key[0]], "strength": [strength + n], "last": [last]})

    def close(self) -> None:
        pass


RECALL_SCHEMA = "memory_id long, strength long, last timestamp"


def recall_stream(recalls: DataFrame) -> DataFrame:
    """`recalls`: memory_id long, ts timestamp. One updated row per touched memory and batch."""
    return recalls.groupBy("memory_id").transformWithStateInPandas(
        RecallStrength(), RECALL_SCHEMA, "Update", "None"
    )
