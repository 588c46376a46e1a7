"""Exact nearest-neighbour search, neighbour expansion and text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.functions.vectors import doubles, minmax, unit
from frameweave.plans.ordering import order_rows, top_rows
from frameweave.plans.staging import materialise, small_batches

# Bytes of vectors that one side may bring to a task.
BLOCK_BYTES = 64 << 20
# Bytes of vectors in one row of packed vectors, and of queries that one task compares with its part of the index.
PACK_BYTES, QUERY_BYTES = 2 << 20, 4 << 20

# Bytes of text that one task cuts into words.
TEXT_BYTES = 8 << 20

METRICS = ("l1", "l2", "lp", "cosine", "dot")
# Queries and rows of one tile of scores.
QUERY_TILE, ROW_TILE = 1024, 4096


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str, p: float = 2) -> np.ndarray:
    """Distances by l1, l2 or lp."""
    # Differences rather than the expanded square, so that equal vectors are at exactly 0.
    out = np.empty((len(queries), len(rows)))
    step = max(1, (1 << 20) // max(rows.size, 1))
    for i in range(0, len(queries), step):
        gap = queries[i : i + step, None, :] - rows[None, :, :]
        if metric == "l2":
            out[i : i + step] = np.sqrt(np.einsum("qnd,qnd->qn", gap, gap))
        elif metric == "l1":
            out[i : i + step] = np.abs(gap).sum(axis=2)
        else:
            out[i : i + step] = (np.abs(gap) ** p).sum(axis=2) ** (1 / p)
    return out


def _scaled(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors of length 1 for cosine, so that its similarity is a product."""
    if metric != "cosine":
        return vectors
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _near_product(
    queries: np.ndarray, rows: np.ndarray, k: int, metric: str, own: tuple | None, limit: np.ndarray
) -> tuple:
    """(query, row, score) of every pair that could be among a query's best `k`, ties at 12 digits included.

    The score is 1 - cosine similarity of scaled vectors, or the negative dot product. Only pairs up to
    the query's `limit`, its k-th score so far, are rounded; a query without one gets the k-th of `rows`.
    """
    score = queries @ rows.T
    np.subtract(1.0 if metric == "cosine" else 0.0, score, out=score)
    if own is not None:
        score[own] = np.inf
    new = np.flatnonzero(np.isinf(limit))
    if len(new) and len(rows) > k:
        kth = np.partition(score[new], k - 1, axis=1)[:, k - 1]
        limit = limit.copy()
        limit[new] = np.where(np.isfinite(kth), kth, np.inf)
    at = np.flatnonzero(score <= (limit + 2e-12)[:, None])  # much faster than by two dimensions
    q, r = np.divmod(at, len(rows))
    s = np.round(score.ravel()[at], 12)
    keep = np.isfinite(s)
    return q[keep], r[keep], s[keep]


def _near_l2(queries: np.ndarray, rows: np.ndarray, k: int, own: tuple | None) -> tuple | None:
    """(query, row, distance) of every pair that could be among a query's best `k`, ties at 12 digits included.

    The expanded square picks the pairs by a matrix product; what it may be wrong by is added to the
    limit, and distances of the picked pairs are taken from differences. None if a number overflows.
    """
    qq, rr = np.einsum("qd,qd->q", queries, queries), np.einsum("nd,nd->n", rows, rows)
    rough = queries @ rows.T
    rough *= -2
    rough += qq[:, None]
    rough += rr
    if not np.isfinite(rough).all():
        return None
    if own is not None:
        rough[own] = np.inf
    error = 8 * (rows.shape[1] + 8) * np.finfo(float).eps * (qq + rr.max())[:, None]
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
    limit = limit + 2 * error + 4e-12 * (np.sqrt(np.maximum(limit, 0) + error) + 1)
    q, r = np.nonzero((rough <= limit) & np.isfinite(rough))
    s = np.empty(len(q))
    for i in range(0, len(q), 1 << 14):
        gap = queries[q[i : i + (1 << 14)]] - rows[r[i : i + (1 << 14)]]
        s[i : i + (1 << 14)] = np.sqrt(np.einsum("nd,nd->n", gap, gap))
    return q, r, np.round(s, 12)


def _own(qids: np.ndarray, ids: np.ndarray) -> tuple | None:
    """Positions of the pairs of equal ids."""
    at = np.flatnonzero(np.isin(ids, qids))
    if not len(at):
        return None
    q, r = np.nonzero(qids[:, None] == ids[at])
    return q, at[r]


def _picked(
    queries: np.ndarray, rows: np.ndarray, own: tuple | None, limit: np.ndarray, k: int, metric: str, p: float
) -> tuple:
    """(query, row, score) of the pairs of a tile that could be among a query's best `k`, without those in `own`."""
    if metric in ("cosine", "dot"):
        return _near_product(queries, rows, k, metric, own, limit)
    picked = _near_l2(queries, rows, k, own) if metric == "l2" and len(rows) > k else None
    if picked is not None:
        return picked
    score = np.round(_scores(queries, rows, metric, p), 12)
    if own is not None:
        score[own] = np.inf
    if score.shape[1] > k:
        nth = np.partition(score, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero((score <= nth) & np.isfinite(score))
    else:
        q, r = np.nonzero(np.isfinite(score))
    return q, r, score[q, r]


def _merged(best: tuple | None, found: tuple, limit: np.ndarray, k: int) -> tuple:
    """Best `k` per query of both lots of (query, score, id, ..), by score and id; `limit` gets the k-th scores."""
    near = found[1] <= limit[found[0]]
    found = tuple(x[near] for x in found)
    if best is not None:
        if not len(found[0]):
            return best
        found = tuple(np.concatenate(x) for x in zip(best, found))
    order = np.lexsort((found[2], found[1], found[0]))
    q = found[0][order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    limit[q[nth == k - 1]] = found[1][order[nth == k - 1]]
    return tuple(x[order[nth < k]] for x in found)


def _top(qids, queries, ids, rows, k: int, metric: str, skip_self: bool, p: float = 2) -> tuple:
    """Best `k` rows per query as (query position, row position, score), nearest first by id.

    Scores are made tile by tile. Of each tile only scores up to the k-th of their query are sorted,
    together with the best so far, so a task holds a few tiles however many rows it reads.
    """
    qids, ids = np.asarray(qids), np.asarray(ids)
    queries, rows = _scaled(queries, metric), _scaled(rows, metric)
    out: list[tuple] = []
    for i in range(0, len(queries), QUERY_TILE):
        part, names = queries[i : i + QUERY_TILE], qids[i : i + QUERY_TILE]
        best, limit = None, np.full(len(part), np.inf)
        for j in range(0, len(rows), ROW_TILE):
            near = ids[j : j + ROW_TILE]
            own = _own(names, near) if skip_self else None
            q, r, s = _picked(part, rows[j : j + ROW_TILE], own, limit, k, metric, p)
            best = _merged(best, (q, s, near[r], r + j), limit, k)
        if best is not None:
            out.append((best[0] + i, best[3], best[1]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def nearest(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    metric: str = "l2",
    query_id: str = "query_id",
    row_id: str = "row_id",
    vector: str = "vector",
    skip_self: bool = False,
    block_bytes: int = BLOCK_BYTES,
    p: float = 2,
    scale: str | None = None,
) -> DataFrame:
    """Exact `k` nearest index rows of each query: query_id, row_id, score, rank.

    Metrics: l1, l2, lp (with `p`), cosine, dot. `scale` normalises both sides row by row first:
    `minmax` or `unit`; centring on the index's mean changes no distance and is left out.

    Ids are integers. Queries of a checked total size are sent to every index partition, which
    keeps its best `k` per query; only those are shuffled. More queries are cut into blocks, as is
    the index, and pairs of blocks are compared one at a time. A task takes some blocks of queries and
    `BLOCK_BYTES` of the index, and again emits at most `k` rows per query, so neither a pair list nor
    copies of a block for the blocks it meets are ever written.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if scale not in (None, "minmax", "unit"):
        raise ValueError(f"unknown normalisation {scale!r}")
    values = {None: doubles, "minmax": minmax, "unit": unit}[scale](vector)
    queries = queries.select(F.col(query_id).cast("long").alias("query_id"), values.alias("q"))
    index = index.select(F.col(row_id).cast("long").alias("row_id"), values.alias("v"))
    probe = queries.select(F.size("q")).first()
    if probe is None:
        return queries.select("query_id", F.lit(0).cast("long").alias("row_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    block = max(1, block_bytes // (8 * max(probe[0], 1)))
    sent = queries.limit(block + 1).toArrow()  # at most one block and a row
    options = (k, metric, skip_self, p)
    if sent.num_rows <= block:
        found = _search_sent(sent, index, options)
    else:
        found = _search_blocks(queries, index, options, block, probe[0])
    return top_rows(found, ["query_id"], ["score", "row_id"], k)


SCHEMA = "query_id long, row_id long, score double"


def _search_sent(rows: pa.Table, index: DataFrame, options: tuple) -> DataFrame:
    rows = rows.sort_by("query_id")
    qids = rows.column("query_id").to_numpy()
    matrix = _matrix(rows.column("q").combine_chunks())
    sent = index.sparkSession.sparkContext.broadcast((qids, matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, vec_q = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            q, r, s = _top(ids_q, vec_q, ids, _matrix(batch.column(1)), *options)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_q[q]), pa.array(ids[r]), pa.array(s)], ["query_id", "row_id", "score"]
            )

    return index.mapInArrow(search, SCHEMA)


PACKED = "tile long, n long, ids array<long>, vectors binary"


def _packed(df: DataFrame, rows: int, dim: int, metric: str) -> DataFrame:
    """Ids and vectors of `df` in rows of up to `rows` each, written once."""
    rows = max(1, min(rows, PACK_BYTES // (8 * max(dim, 1))))

    def tile(number: int, part: pa.Table) -> pa.RecordBatch:
        ids, vectors = (c.combine_chunks() for c in part.columns)
        if vectors.null_count or pc.any(pc.not_equal(pc.list_value_length(vectors), dim)).as_py():
            raise ValueError("all vectors must have the same length")
        matrix = _scaled(_matrix(vectors), metric)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([len(ids)]),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([matrix.tobytes()], pa.binary()),
            ],
            ["tile", "n", "ids", "vectors"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows >= rows:
                yield tile(number, held.slice(0, rows))
                number, held = number + 1, held.slice(rows)
        if held is not None and held.num_rows:
            yield tile(number, held)

    return materialise(df.mapInArrow(pack, PACKED))


def _search_blocks(queries: DataFrame, index: DataFrame, options: tuple, block: int, dim: int) -> DataFrame:
    """Every task reads its part of the index once and compares all of it with each of its blocks of queries.

    Vectors travel in packed rows; a worker holds a pair of these and compares their blocks pair by pair.
    """
    spark = queries.sparkSession
    small_batches(spark)  # a row is a pair of packed ones
    k, metric, skip_self, p = options
    q_block, x_block = min(block, QUERY_TILE), min(block, ROW_TILE)
    q, x = _packed(queries, QUERY_TILE, dim, metric), _packed(index, ROW_TILE, dim, metric)
    (q_rows, q_tiles), (x_rows, x_tiles) = (
        df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first() for df in (q, x)
    )
    nx = max(1, min(x_tiles, -(-x_rows * 8 * dim // BLOCK_BYTES)))
    nq = max(-(-q_rows * 8 * dim // QUERY_BYTES), -(-4 * spark.sparkContext.defaultParallelism // nx))
    q = q.select("tile", F.col("ids").alias("qids"), F.col("vectors").alias("q"))
    x = x.select("ids", F.col("vectors").alias("v"))

    def unpacked(ids: pa.Scalar, vectors: pa.Scalar) -> tuple:
        return ids.values, np.frombuffer(vectors.as_buffer(), dtype=float).reshape(len(ids.values), dim)

    def compared(queries: np.ndarray, rows: np.ndarray, own: tuple | None, limit: np.ndarray) -> tuple:
        out, inside = [], None
        for i in range(0, len(queries), q_block):
            for j in range(0, len(rows), x_block):
                if own is not None:
                    here = (own[0] // q_block == i // q_block) & (own[1] // x_block == j // x_block)
                    inside = own[0][here] - i, own[1][here] - j
                part, limits = queries[i : i + q_block], limit[i : i + q_block]
                at, r, s = _picked(part, rows[j : j + x_block], inside, limits, k, metric, p)
                out.append((at + i, r + j, s))
        return tuple(np.concatenate(c) for c in zip(*out))

    def found(qids: pa.Array, best: tuple) -> pa.RecordBatch:
        at, s, ids, none = best
        columns = [qids.take(pa.array(at)), pa.array(ids, mask=none), pa.array(s)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "row_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = best = None
        for batch in batches:
            for tile, q_ids, q_vectors, x_ids, x_vectors in zip(*batch.columns):
                if tile.as_py() != now:
                    if best is not None:
                        yield found(qids, best)
                    qids, vectors = unpacked(q_ids, q_vectors)
                    now, best, limit = tile.as_py(), None, np.full(len(qids), np.inf)
                    # A vector without an id is no other's own.
                    known = np.flatnonzero(qids.is_valid().to_numpy(zero_copy_only=False))
                    names = qids.drop_null().to_numpy()
                ids, rows = unpacked(x_ids, x_vectors)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
                own = _own(names, ids) if skip_self else None
                if own is not None:
                    own = tuple(c[~none[own[1]]] for c in (known[own[0]], own[1]))
                at, r, s = compared(vectors, rows, own, limit)
                best = _merged(best, (at, s, ids[r], none[r]), limit, k)
        if best is not None:
            yield found(qids, best)

    # The order of the pairs is by tile of queries; another order would only keep more rows for `top_rows`.
    pairs = q.repartition(max(1, min(q_tiles, nq))).hint("shuffle_replicate_nl").crossJoin(x.repartition(nx))
    return pairs.mapInArrow(search, SCHEMA)


def append_index(index_path: str, rows: DataFrame) -> None:
    """New rows of a stored index."""
    rows.write.mode("append").parquet(index_path)


def top_frames(
    frames: DataFrame, queries: DataFrame, k: int, frame_id: str, patches: str, query_id: str, tokens: str
) -> DataFrame:
    """Frames with the largest summed patch-token similarity per query.

    The sum of all pairwise products is the product of the sums, so both sides are reduced to one
    vector before the search.
    """

    def added(c: str) -> Column:
        first = F.transform(F.get(F.col(c), 0), lambda x: F.lit(0.0))
        return F.aggregate(
            F.col(c).cast("array<array<double>>"), first, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)
        )

    found = nearest(
        queries.select(F.col(query_id), added(tokens).alias("vector")),
        frames.select(F.col(frame_id), added(patches).alias("vector")),
        k,
        "dot",
        query_id,
        frame_id,
    )
    return found.withColumn("similarity", -F.col("score")).drop("score")


# ---- dialogue retrieval -----------------------------------------------------------------------


def widen_hits(
    hits: DataFrame, docs: DataFrame, radius: int, max_chars: int
) -> DataFrame:
    """Document positions around each hit: query_id, pos, score.

    `hits`: query_id, pos, score (smaller is better). `docs`: pos, source, content. Going outwards,
    the right neighbour before the left, a document of the same source joins while the total
    length stays within `max_chars`; when one is too long the other side at that distance is
    skipped. A hit has at most 2 * radius neighbours, so its fold is a bounded array.
    """
    own = docs.select("pos", F.col("source").alias("_src"), F.length("content").alias("_own"))
    base = hits.join(own, "pos")
    step = F.explode(
        F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(1, radius + 1) for s in (1, -1)])
    )
    asked = base.select("query_id", "pos", "score", "_src", "_own", step.alias("_st"))
    asked = asked.withColumn("_at", F.col("pos") + F.col("_st.d") * F.col("_st.s"))
    near = docs.select(F.col("pos").alias("_at"), "source", F.length("content").alias("_len"))
    # Right comes before left at the same distance: order by (distance, -side).
    item = F.struct(
        F.col("_st.d").alias("d"),
        (-F.col("_st.s")).alias("side"),
        F.col("_at").alias("at"),
        F.col("_len").alias("len"),
        (F.col("source") == F.col("_src")).alias("same"),
    )
    grouped = asked.join(near, "_at").groupBy("query_id", "pos", "score", "_own").agg(
        F.array_sort(F.collect_list(item)).alias("_c")
    )
    start = F.struct(
        F.col("_own").cast("long").alias("total"),
        F.lit(0).alias("stopped"),
        F.array().cast("array<bigint>").alias("ids"),
    )

    def step_over(s: Column, c: Column) -> Column:
        skip = s["stopped"] == c["d"]
        too_long = s["total"] + c["len"] > max_chars
        take = ~skip & ~too_long & c["same"]
        return F.struct(
            F.when(take, s["total"] + c["len"]).otherwise(s["total"]).alias("total"),
            F.when(~skip & too_long, c["d"]).otherwise(s["stopped"]).alias("stopped"),
            F.when(take, F.concat(s["ids"], F.array(c["at"]))).otherwise(s["ids"]).alias("ids"),
        )

    ids = F.aggregate("_c", start, step_over, lambda s: s["ids"])
    wide = grouped.select("query_id", "score", F.explode(ids).alias("pos"))
    return hits.select("query_id", "score", "pos").unionByName(wide)


def merge_passages(positions: DataFrame, docs: DataFrame) -> DataFrame:
    """Consecutive positions of a query joined to one passage with the best score among its hits."""
    best = positions.groupBy("query_id", "pos").agg(F.min("score").alias("score"))
    rows = order_rows(best, ["query_id"], ["pos"]).df
    runs = rows.withColumn("_run", F.col("pos") - F.col("seq")).join(docs, "pos")
    # A run is bounded by hits * (2 * radius + 1) documents.
    return (
        runs.groupBy("query_id", "_run")
        .agg(
            F.min("pos").alias("first"),
            F.max("pos").alias("last"),
            F.min("score").alias("score"),
            F.min_by("source", "pos").alias("source"),
            F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("_p"),
        )
        .withColumn("content", F.array_join(F.col("_p.content"), ""))
        .drop("_p", "_run")
    )


def group_by_date(passages: DataFrame, text_sep: str = "\n") -> DataFrame:
    """Passages of a query joined per date in date order, and the list of dates.

    `passages`: query_id, source, first, content.
    """
    # Retrieved passages per query are at most the hits asked for.
    per_date = passages.groupBy("query_id", "source").agg(
        F.array_sort(F.collect_list(F.struct("first", "content"))).alias("_p")
    )
    per_date = per_date.select(
        "query_id",
        F.struct("source", F.array_join(F.col("_p.content"), text_sep).alias("content")).alias("_d"),
    )
    return per_date.groupBy("query_id").agg(F.array_sort(F.collect_list("_d")).alias("_ds")).select(
        "query_id",
        F.col("_ds.content").alias("memories"),
        F.array_join(F.col("_ds.source"), ", ").alias("dates"),
    )


# ---- text vectors -----------------------------------------------------------------------------


def hashed_vectors(df: DataFrame, row_id: str, text: str, dim: int = 64, out: str = "vector") -> DataFrame:
    """Signed feature hashing of the words of a text to a unit vector; a stand-in for a model.

    Words are counted per (row, slot), so a long text costs one small row per slot and not an
    array update per word. A text without words gives the zero vector. Texts are dealt to tasks of
    some `TEXT_BYTES` before they are cut, so words are counted where they are and not shuffled.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, size // TEXT_BYTES)
    tokens = df.select(row_id, text).repartition(tasks, row_id).select(
        row_id, F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("_w")
    )
    # A word is hashed once per row it occurs in, however often it is repeated there.
    tokens = tokens.groupBy(row_id, "_w").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.md5("_w")
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)
    slots = tokens.groupBy(row_id, slot.alias("_slot")).agg(F.sum(sign * F.col("_n")).alias("_v"))
    packed = slots.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_v"))).alias("_m"))
    full = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")),
        lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0)).cast("double"),
    )
    dense = F.coalesce(full, F.array_repeat(F.lit(0.0), dim))
    return df.select(row_id).join(packed, row_id, "left").select(row_id, unit(dense).alias(out))


def text_vectors(
    df: DataFrame, row_id: str, text: str, embed: Callable[[Column], Column] | None = None, dim: int = 64
) -> DataFrame:
    """Vectors from a user-supplied column function (an Arrow UDF), hashed words by default."""
    if embed is not None:
        return df.select(row_id, embed(F.col(text)).alias("vector"))
    return hashed_vectors(df, row_id, text, dim)

