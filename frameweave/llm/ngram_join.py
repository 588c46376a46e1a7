"""Near-duplicate texts by an exact Jaccard join over word n-grams.

1. Sets. A text becomes the sorted array of its n-gram hashes. Equal sets are one class, and only
   classes are compared from here on.
2. Tiles. Two sets above the threshold share one of the first few n-grams of each in any common
   order. N-grams found in many texts come last in that order, so that shared passages seldom open
   a tile; the order only affects the work, not the result. Within an n-gram, classes are tiled by
   size bands, as sizes must not differ by more than the threshold.
3. Neighbours. Each class is first compared with the neighbour it shares most n-grams with, if these
   are more than chance would give. What is linked then is a component; only pairs from different
   components are taken up from here on, which leaves out no pair that could join two of them.
4. Blocks. Each class has a home, its most frequent first n-gram. The classes of a home and size band
   are cut into blocks, large components into blocks of their own, and a task takes the classes of two
   blocks that meet in some n-gram. Tables hold classes per pair of blocks, never pairs of classes.
5. Bounds. The first n-grams that a class shares with a block are counted: with the rest of a set
   they bound the overlap from above. Then bitmaps of hashed n-grams are compared: bits of one
   that the other lacks bound the overlap again. Classes without a pair that could reach the
   threshold go no further.
6. Check. The sorted arrays of the remaining classes of a pair of blocks are intersected exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frameweave.llm.chunks import release
from frameweave.llm.columns import shielded
from frameweave.llm.components import components
from frameweave.plans.staging import materialise, small_side

#: Bits of a bitmap for each n-gram, and its least 64-bit words.
BITS, WORDS = 2, 8
#: Neighbours are compared first where they met in one of this many of the first n-grams, or more.
MET = 8
#: An n-gram in more than this share of the texts of a task comes last in the order.
FREQUENT = 0.0008
#: N-grams that may come last, the most frequent ones; bounds what is broadcast to 1.6 MB.
MAX_FREQUENT = 200_000
#: Classes in a block whose candidates are checked together.
FAMILY = 64
#: Classes of a block in which components meet, and n-grams of all of them.
BLOCK, BLOCK_NGRAMS = 512, 1 << 18
#: N-grams that a task counts at once.
_COUNTED = 2_000_000
#: Cells of the matrices that a task multiplies at once, 4 bytes each.
_CELLS = 1 << 22

# ---- hashing ------------------------------------------------------------------------------------

_CHUNK = 1 << 20  # bytes hashed at once
_rng = np.random.default_rng(20240501)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[_SPACE] = 0
_RADIX = int(_rng.integers(1 << 62, 1 << 63)) | 1
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _power_tables() -> list[np.ndarray]:
    """Powers of the radix and of its inverse modulo 2^64."""
    if not _powers:
        for base in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            steps = np.full(_CHUNK, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word of a text in UTF-8, in order; A-Z count as a-z."""
    if len(data) > _CHUNK:
        parts, at = [], 0
        while at < len(data):
            end = min(at + _CHUNK, len(data))
            if end < len(data):
                cut = max(data.rfind(bytes([c]), at, end) for c in (9, 10, 11, 12, 13, 32))
                if cut <= at:
                    return np.array([_long_word(w) for w in data.split()], np.uint64)
                end = cut
            parts.append(word_hashes(data[at:end]))
            at = end
        return np.concatenate(parts)
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables()
    sums = np.add.reduceat(_BYTE[raw] * up[: len(raw)], starts)
    return _mix(sums * down[starts])


def _long_word(word: bytes) -> int:
    """The same hash for a word of any length."""
    up, _ = _power_tables()
    total, shift = 0, 1
    for i in range(0, len(word), _CHUNK):
        raw = np.frombuffer(word[i : i + _CHUNK], np.uint8)
        total += shift * int((_BYTE[raw] * up[: len(raw)]).sum(dtype=np.uint64))
        shift = shift * pow(_RADIX, len(raw), 1 << 64) % (1 << 64)
    return int(_mix(np.array([total % (1 << 64)], np.uint64))[0])


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams; a shorter text is one sequence, none is empty."""
    words = word_hashes(data)
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _PLACES[i]
    return np.unique(_mix(total + np.uint64(width)))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """64-bit words in which each hash sets one bit; their number is a power of two that fits the set."""
    words = max(WORDS, 1 << (BITS * len(hashes) // 64).bit_length())
    bits = np.zeros(words * 64, np.uint8)
    bits[(hashes >> np.uint64(24)) % np.uint64(words * 64)] = 1
    return np.packbits(bits).view(np.int64)


def _up(x, y: int):
    """x / y rounded up, of a column or of numbers."""
    return F.ceil(x / F.lit(y)) if isinstance(x, Column) else -(-x // y)


@dataclass(frozen=True)
class Threshold:
    """Two sets link when den * |intersection| >= num * |union|."""

    num: int
    den: int

    def prefix(self, n: int) -> int:
        """N-grams of a set of `n` of which any partner must have one among its own first ones."""
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a, b):
        """Least intersection of linked sets of these sizes, which are columns or numbers."""
        return _up(self.num * (a + b), self.num + self.den)

    def rest(self, n):
        """N-grams of a set of `n` beyond its first ones."""
        return _up(self.num * n, self.den) - 1

    def shared(self, a, b):
        """Least number of their first n-grams that linked sets of these sizes share.

        Take the set whose first n-grams end earlier in the order: those it shares at all are among
        the first ones of the other set too, so the overlap is at most their number and its rest.
        """
        larger = F.greatest if isinstance(a, Column) else np.maximum
        return self.overlap(a, b) - larger(self.rest(a), self.rest(b))

    def shared_within(self, n: Column, least: Column, most: Column) -> Column:
        """No more than `shared` of `n` and any size from `least` to `most`.

        Up to `n`, the number grows with the other size; from there on it falls, but for rounding.
        """
        ends = F.least(self.shared(n, least), self.shared(n, most))
        return F.when(least == most, ends).otherwise(ends - 1)

    def sizes_fit(self, small: Column, large: Column) -> Column:
        return small * self.den >= large * self.num

    def band(self, n: Column) -> Column:
        """Sizes that can link are in the same or in neighbouring bands."""
        base = math.log(self.den / self.num) * (1 + 1e-9) if self.num < self.den else math.log(2)
        return F.floor(F.log(n.cast("double")) / base).cast("int")


# ---- passes over the texts ----------------------------------------------------------------------


def _fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def read_sets(docs: DataFrame, k: int, doc_id: str, text: str, row: Column | None = None) -> DataFrame:
    """Rows (doc_id, n, print, row) of each document and rows (token, found) of frequent n-grams.

    `row` is a binary column that is passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            tokens, found = np.unique(np.concatenate(held), return_counts=True)
            many = found >= max(3, FREQUENT * len(held))
            tokens, found = tokens[many], found[many]
            none = pa.nulls(len(tokens))
            return pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(tokens.view(np.int64)), pa.array(found), none.cast(pa.binary())],
                names,
            )

        release()
        names = ["doc_id", "n", "print", "token", "found", "row"]
        size = 0
        for batch in batches:
            ns, prints = [], []
            for value in batch.column(1):
                hashes = shingles(value.as_py() or b"", k)
                ns.append(len(hashes))
                prints.append(_fingerprint(hashes))
                held.append(hashes)
                size += len(hashes)
            none = pa.nulls(len(ns)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int32()), pa.array(prints, pa.binary()), none, none, batch.column(2)], names
            )
            if size >= _COUNTED:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    row = F.lit(None).cast("binary") if row is None else row
    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary"), row)
    return columns.mapInArrow(run, "doc_id long, n int, print binary, token long, found long, row binary")


def frequent_tokens(rows: DataFrame) -> np.ndarray:
    """The most frequent n-grams, most frequent last."""
    totals = rows.where("token is not null").groupBy("token").agg(F.sum("found").alias("found"))
    top = totals.orderBy(F.desc("found"), "token").limit(MAX_FREQUENT).toArrow()
    return top.column("token").to_numpy().view(np.uint64)[::-1].copy()


def first_tokens(docs: DataFrame, k: int, limit: Threshold, frequent, doc_id: str, text: str) -> DataFrame:
    """(print, n, bits, tokens): the n-grams by which a set is found; a task names each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        many = frequent.value
        order = np.argsort(many)
        known, seen = many[order], set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value in batch.column(0):
                hashes = shingles(value.as_py() or b"", k)
                if not len(hashes):
                    continue
                mark = _fingerprint(hashes)
                if mark in seen:
                    continue
                seen.add(mark)
                p = limit.prefix(len(hashes))
                first = hashes
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    common = known[at] == hashes
                    first = hashes[~common]
                    if len(first) < p:
                        last = at[common][np.argsort(order[at[common]], kind="stable")]
                        first = np.concatenate([first, known[last]])
                for column, v in zip(out, (mark, len(hashes), bitmap(hashes), first[:p].view(np.int64))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64())),
                ],
                ["print", "n", "bits", "tokens"],
            )

    return docs.select(F.col(text).cast("binary")).mapInArrow(
        run, "print binary, n int, bits array<long>, tokens array<long>"
    )


def packed_texts(docs: DataFrame, wanted: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(node, packed) for the classes in `wanted` (node, print, min_id): one text of each, compressed.

    A text is smaller than its array of hashes and gives it back at once. An id may belong to
    several texts, so the fingerprint is compared; a task sends each class once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            nodes, packs = [], []
            for node, mark, value in zip(*batch.columns):
                node, data = node.as_py(), value.as_py() or b""
                if node not in seen and _fingerprint(shingles(data, k)) == mark.as_py():
                    seen.add(node)
                    nodes.append(node)
                    packs.append(compress(data))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packs, pa.binary())], ["node", "packed"])

    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    rows = texts.join(small_side(wanted), F.col("_id").eqNullSafe(F.col("min_id")))
    return rows.select("node", "print", "_text").mapInArrow(run, "node long, packed binary")


# ---- the join -----------------------------------------------------------------------------------


def intersection(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each array of `xs` with each of `ys`; arrays hold no repeats.

    What occurs on both sides is numbered, and the rows of zeros and ones over these numbers are
    multiplied, some columns at a time.
    """
    out = np.zeros((len(xs), len(ys)), np.int64)
    both = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    if not len(both):
        return out

    def numbered(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(arrays)
        rows = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        found = both[at] == values
        order = np.argsort(at[found], kind="stable")
        return at[found][order], rows[found][order]

    sides = [numbered(xs), numbered(ys)]
    step = max(1, _CELLS // (len(xs) + len(ys)))
    for start in range(0, len(both), step):
        ones = []
        for (at, rows), size in zip(sides, out.shape):
            cut = slice(*np.searchsorted(at, (start, start + step)))
            m = np.zeros((size, min(step, len(both) - start)), np.float32)
            m[rows[cut], at[cut] - start] = 1
            ones.append(m)
        out += (ones[0] @ ones[1].T).astype(np.int64)
    return out


def most_overlap(n_a: np.ndarray, bits_a: list[np.ndarray], n_b: np.ndarray, bits_b: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of the intersections: each bit that only one side has is an n-gram of its own.

    Longer bitmaps are folded to the length of the shortest.
    """
    words = min(len(x) for x in bits_a + bits_b)
    fold = lambda x: np.bitwise_or.reduce(x.view(np.uint64).reshape(-1, words), axis=0)
    x, y = (np.array([fold(row) for row in side]) for side in (bits_a, bits_b))
    common = np.array([np.bitwise_count(row & y).sum(axis=1, dtype=np.int64) for row in x])
    own_x, own_y = (np.bitwise_count(side).sum(axis=1, dtype=np.int64) for side in (x, y))
    return np.minimum((n_a - own_x)[:, None], (n_b - own_y)[None, :]) + common


def _exact_links(k: int, limit: Threshold):
    """Function over one pair of blocks: the linked pairs among its candidates."""

    def run(table: pa.Table) -> pa.Table:
        texts = {}
        for node, packed in zip(table.column("a").to_pylist(), table.column("packed")):
            if packed.is_valid:
                texts[node] = packed
        sets: dict[int, np.ndarray] = {}

        def read(node: int) -> np.ndarray:
            if node not in sets:
                sets[node] = shingles(zstandard.decompress(texts[node].as_py()), k)
            return sets[node]

        out: list[tuple[int, int]] = []
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            if b is None:
                continue
            x, y = read(a), read(b)
            both = intersection(x, y)
            if both * limit.den >= (len(x) + len(y) - both) * limit.num:
                out.append((a, b))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


class _Sides:
    """The classes of two blocks, or of one, as index arrays `a` and `b` and the pairs `open` to a link."""

    def __init__(self, table: pa.Table, limit: Threshold):
        column = lambda c: table.column(c).to_numpy()
        self.node, self.n, self.root, block = (column(c) for c in ("node", "n", "root", "block"))
        self.n = self.n.astype(np.int64)
        self.i, self.j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        self.a, self.b = np.flatnonzero(block == self.i), np.flatnonzero(block == self.j)
        self.n_a, self.n_b = self.n[self.a][:, None], self.n[self.b][None, :]
        fits = np.minimum(self.n_a, self.n_b) * limit.den >= np.maximum(self.n_a, self.n_b) * limit.num
        self.open = fits & (self.root[self.a][:, None] != self.root[self.b][None, :])

    def narrow(self) -> bool:
        """Leave out classes without open pairs; false if none are left."""
        rows, columns = self.open.any(axis=1), self.open.any(axis=0)
        self.a, self.b, self.open = self.a[rows], self.b[columns], self.open[rows][:, columns]
        self.n_a, self.n_b = self.n_a[rows], self.n_b[:, columns]
        return self.open.size > 0


def _bounded(limit: Threshold):
    """Function over one pair of blocks: the classes with a pair that the bounds leave open."""

    def run(table: pa.Table) -> pa.Table:
        sides = _Sides(table, limit)
        array = lambda c, at: [table.column(c)[int(x)].values.to_numpy() for x in at]
        left = sides.narrow()
        if left:
            most = most_overlap(sides.n_a[:, 0], array("bits", sides.a), sides.n_b[0], array("bits", sides.b))
            sides.open &= most >= limit.overlap(sides.n_a, sides.n_b)
            left = sides.narrow()
        nodes = np.unique(sides.node[np.concatenate([sides.a, sides.b])]) if left else np.zeros(0, np.int64)
        size = len(nodes)
        return pa.table({"i": np.full(size, sides.i, np.int64), "j": np.full(size, sides.j, np.int64), "node": nodes})

    return run


def _joined(k: int, limit: Threshold):
    """Function over one pair of blocks: links that join the components its linked pairs join."""

    def run(table: pa.Table) -> pa.Table:
        sides, links = _Sides(table, limit), []
        if sides.narrow():
            kept = np.union1d(sides.a, sides.b)
            sets = {int(x): shingles(zstandard.decompress(table.column("packed")[int(x)].as_py()), k) for x in kept}
            both = overlaps([sets[int(x)] for x in sides.a], [sets[int(x)] for x in sides.b])
            linked = sides.open & (both * limit.den >= (sides.n_a + sides.n_b - both) * limit.num)
            x, y = np.nonzero(linked)
            ends = np.unique(np.stack([sides.root[sides.a[x]], sides.root[sides.b[y]]], axis=1), axis=0)
            above: dict[int, int] = {}

            def top(node: int) -> int:
                while node in above:
                    above[node] = node = above.get(above[node], above[node])
                return node

            for a, b in ends.tolist():
                u, v = top(a), top(b)
                if u != v:
                    above[max(u, v)] = min(u, v)
                    links.append((a, b))
        return pa.table({s: pa.array([e[at] for e in links], pa.int64()) for at, s in enumerate("ab")})

    return run


def _blocks(tiles: DataFrame) -> DataFrame:
    """(node, n, root, block) of the classes in `tiles` (token, band, node, n, root)."""
    found = materialise(tiles.groupBy("token").agg(F.count(F.lit(1)).alias("found")))
    home = tiles.join(small_side(found), "token").groupBy("node", "n", "root", "band")
    home = home.agg(F.max(F.struct("found", "token")).alias("home"))
    home = materialise(home.withColumn("home", F.col("home.token")))
    weight = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_NGRAMS))
    per = home.groupBy("home", "band", "root").agg(weight.alias("weight"))
    per = per.withColumn("own", F.when(F.col("weight") >= 1, F.col("root")).otherwise(-1))
    parts = per.groupBy("home", "band", "own").agg(F.ceil(F.sum("weight")).alias("parts"))
    per = materialise(per.join(parts, ["home", "band", "own"]).drop("weight"))
    part = F.pmod(F.xxhash64(F.when(F.col("own") < 0, F.col("root")).otherwise(F.col("node"))), F.col("parts"))
    placed = home.join(small_side(per), ["home", "band", "root"])
    return placed.select("node", "n", "root", F.xxhash64("home", "band", "own", part).alias("block"))


def _links_across(
    tiles: DataFrame, nodes: DataFrame, sets: DataFrame, docs: DataFrame, k: int, limit: Threshold, doc_id: str, text: str
) -> DataFrame:
    """Links (a, b) that join the components in `tiles` (token, band, node, n, root) wherever two of their classes link."""
    placed = materialise(_blocks(tiles))
    rows = materialise(tiles.join(small_side(placed.select("node", "block")), "node"))
    cells = rows.groupBy("token", "band", "block").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    cells = cells.select("token", near, F.col("block").alias("other"), "x", "y", "least", "most")
    meet = rows.join(cells, ["token", "band"]).where((F.col("x") != F.col("root")) | (F.col("y") != F.col("root")))
    # A class goes on if it shares as many first n-grams with the other block as sizes there ask for.
    meet = meet.groupBy("block", "other", "node", "n").agg(
        F.count(F.lit(1)).alias("met"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    meet = meet.where(F.col("met") >= limit.shared_within(F.col("n"), F.col("least"), F.col("most")))
    meet = meet.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block")
    meet = materialise(meet)
    # Both blocks must have such classes, a block on its own two of them.
    both = meet.groupBy("i", "j").agg(F.min("block").alias("x"), F.max("block").alias("y"), F.count(F.lit(1)).alias("c"))
    both = materialise(both.where("c > 1 and x = i and y = j").select("i", "j"))
    meet = materialise(meet.join(small_side(both), ["i", "j"]).select("i", "j", "node"))

    def marked(node: DataFrame) -> DataFrame:
        return materialise(nodes.join(small_side(node.select("node").distinct()), "node").select("node", "print", "min_id"))

    first = sets.join(small_side(marked(meet).select("node", "print")), "print").select("node", "bits")
    first = materialise(first.dropDuplicates(["node"]).join(placed, "node"))
    left = meet.join(first, "node").groupBy("i", "j").applyInArrow(_bounded(limit), "i long, j long, node long")
    left = materialise(left)
    packs = materialise(packed_texts(docs, marked(left), k, doc_id, text).dropDuplicates(["node"]).join(placed, "node"))
    links = left.join(packs, "node").groupBy("i", "j").applyInArrow(_joined(k, limit), "a long, b long")
    return materialise(links)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, limit: Threshold, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b).

    Classes with the same least candidate are a family. Families are cut into blocks of about FAMILY
    classes, and a task takes the candidates between two blocks: each text is sent to it once, not
    once for each candidate.
    """
    pairs = materialise(pairs)
    # The least candidate of a class names its family, which all members of a dense group agree on.
    ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    family = materialise(ends.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    sizes = family.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAMILY)).alias("grid"))
    placed = family.join(small_side(materialise(sizes)), "root")
    block = F.struct("root", F.pmod(F.xxhash64("node"), F.col("grid")).alias("part"))
    placed = materialise(placed.select("node", block.alias("block")))
    wanted = materialise(nodes.join(small_side(placed.select("node")), "node").select("node", "print", "min_id"))
    packs = materialise(packed_texts(docs, wanted, k, doc_id, text))
    side = lambda s: placed.select(F.col("node").alias(s), F.col("block").alias(f"block_{s}"))
    keyed = pairs.join(small_side(side("a")), "a").join(small_side(side("b")), "b")
    keyed = materialise(
        keyed.select(F.least("block_a", "block_b").alias("i"), F.greatest("block_a", "block_b").alias("j"), "a", "b")
    )
    # Distinct on each side first, so that a class with many candidates is one row of a task early.
    members = [keyed.select("i", "j", F.col(s).alias("node")).distinct() for s in ("a", "b")]
    texts = members[0].union(members[1]).distinct().join(packs, "node")
    rows = texts.select("i", "j", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "packed").union(
        keyed.select("i", "j", "a", "b", F.lit(None).cast("binary"))
    )
    return materialise(rows.groupBy("i", "j").applyInArrow(_exact_links(k, limit), "a long, b long"))


def near_duplicates(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: groups of texts linked directly or in a chain.

    Words are runs without space and \\t..\\r, with A-Z lower-cased. A text's set holds its distinct
    k-word sequences; one with fewer words is a single sequence; one without words, or null, is
    empty and linked with nothing. Texts link when den * |intersection| >= num * |union|.
    component_id is the smallest id of the group. Rows without an id take part; their component_id is
    the smallest id of their group, null if it has none. Repeated rows each give a row. An
    empty table gives no rows; other columns are not read.
    """
    grouped = _grouped(docs, k, num, den, doc_id, text)
    return grouped.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _grouped(
    docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text", row: Column | None = None
) -> DataFrame:
    """(doc_id, n, row, root, component_id) of every row; root tells groups apart, null without words."""
    limit = Threshold(num, den)
    spark = docs.sparkSession
    rows = materialise(read_sets(docs, k, doc_id, text, row))
    frequent = spark.sparkContext.broadcast(frequent_tokens(rows))
    texts = rows.where("print is not null").select("doc_id", "n", "print", "row")
    nodes = texts.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("min_id"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))  # fixed by the write
    sets = materialise(first_tokens(docs, k, limit, frequent, doc_id, text))

    # N-grams met in one class only are left out by looking at the next and the previous row.
    token = Window.partitionBy("token").orderBy("n", "key")
    tokens = sets.select(F.explode("tokens").alias("token"), "n", F.xxhash64("print").alias("key"))
    tokens = tokens.withColumns({"before": F.lag("key").over(token), "after": F.lead("key").over(token)})
    shared = tokens.where("before <> key or after <> key").select("token", "n", "key").distinct()
    keyed = nodes.select(F.xxhash64("print").alias("key"), "node")
    shared = materialise(shared.join(small_side(keyed), "key").select("token", "n", "node"))

    # Neighbours by size in each n-gram; of those, the one met in most n-grams for each class.
    token = Window.partitionBy("token").orderBy("n", "node")
    chain = shared.withColumns({"m": F.lag("n").over(token), "other": F.lag("node").over(token)})
    chain = chain.where(F.col("other").isNotNull() & (F.col("other") != F.col("node")) & limit.sizes_fit(F.col("m"), F.col("n")))
    met = chain.groupBy("node", "n", "other", "m").agg(F.count(F.lit(1)).alias("met"))
    firsts = F.least("n", "m") - limit.rest(F.least("n", "m"))
    best = met.where(F.col("met") * MET >= firsts).groupBy("node").agg(F.max(F.struct("met", "other")).alias("b"))
    best = best.select("node", F.col("b.other").alias("other"))
    best = materialise(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    links = _verified(best, nodes, docs, k, limit, doc_id, text)
    roots = materialise(components(links))

    # All other pairs of a tile that are not yet in one component, by blocks of classes.
    rooted = shared.join(small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    mixed = materialise(mixed)
    open_rows = rooted.join(small_side(mixed), "token")
    tiles = materialise(open_rows.withColumn("band", limit.band(F.col("n"))))
    links = links.union(_links_across(tiles, nodes, sets, docs, k, limit, doc_id, text))
    roots = materialise(components(links))

    named = nodes.join(small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = materialise(named.join(groups, "root").select("print", "root", "component_id"))
    found = texts.where("n > 0").join(named, "print").select("doc_id", "n", "row", "root", "component_id")
    none = F.lit(None).cast("long").alias("root")
    alone = texts.where("n = 0").select("doc_id", "n", "row", none, F.col("doc_id").alias("component_id"))
    return found.union(alone)


@shielded("doc_id", "text")
def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with exactly one row of each group, that of the smallest id; same columns.

    Rows are told apart by id and text, as ids may repeat; of several texts with the smallest id the
    one of the least SHA-256 stays, of repeats of one text any. Rows without an id come last in a
    group. Documents without words stay.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = _grouped(docs, k, num, den, row=digest).where("root is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    rows = materialise(rows.groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies")))
    first = rows.groupBy("root").agg(F.min(place).alias("first"))
    rows = rows.join(first, "root").withColumn("stays", place.eqNullSafe(F.col("first")))
    rows = materialise(
        rows.select(F.col("doc_id").alias("_id"), F.col("row").alias("_print"), "stays", "copies").where("not stays or copies > 1")
    )
    keyed = docs.withColumn("_row", digest)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_print"))
    out = keyed.join(small_side(rows.select("_id", "_print")), same, "left_anti")
    repeated = rows.where("stays").select("_id", "_print")
    if not repeated.isEmpty():
        once = keyed.join(small_side(repeated), same, "left_semi").dropDuplicates(["doc_id", "_row"])
        out = out.union(once)
    return out.drop("_row")
