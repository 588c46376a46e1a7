"""Stream memory: change gate, short memory, memory tree, search, and the dialogue memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.functions.hashing import u
from frameweave.functions.vectors import Distance, cosine, euclidean, squared, ssim
from frameweave.operators.clustering import lloyd
from frameweave.operators.sequencing import chunk_rows
from frameweave.plans.ordering import GROUP_ROWS, last_rows, order_rows, top_rows
from frameweave.plans.staging import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    materialise,
    row_bytes,
    shuffled,
    small_side,
)
from frameweave.sources.sinks import merge_keep_saved

# ---- gate and short memory --------------------------------------------------------------------


def change_gate(
    frames: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    vector: str,
    threshold: float,
    distance: str | Distance = "l2",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Frames that differ from the frame before by more than `threshold`; the first one is kept.

    With `distance="ssim"` a frame is kept when its similarity is below the threshold.
    """
    rows = order_rows(frames, keys, order, group_rows=group_rows).shift(1, _prev=vector).df
    if distance == "ssim":
        moved = ssim(vector, "_prev") < threshold
    else:
        measure = euclidean if distance == "l2" else distance
        moved = measure(vector, "_prev") > threshold
    return rows.where(F.col("_prev").isNull() | moved).drop("_prev", "seq")


def short_memory(
    frames: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    row_id: str,
    window: int = 20,
    remember: int = 5,
    tau: float = 5.0,
    seed: int = 42,
    mode: str = "literal",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """`remember` of the last `window` frames, drawn without replacement by retention weights.

    The weight of window position i is exp(-i/tau): counted from the oldest frame in `literal`
    mode and from the newest in `recent` mode. The largest ln(u)/weight are drawn, which has the
    distribution of one draw after another. Both sizes shrink to what a stream has. A window of more
    than `group_rows` is cut by many tasks first.
    """
    tail = last_rows(frames, keys, order, window, size="_n", group_rows=group_rows)
    return _draw(tail, keys, row_id, F.least(F.col("_n"), F.lit(window)), F.col("_n"), remember, tau, seed, mode)


def _draw(tail, keys, row_id, width: Column, n: Column, remember, tau, seed, mode) -> DataFrame:
    if mode not in ("literal", "recent"):
        raise ValueError(f"unknown mode {mode!r}")
    age = F.col("seq") - (n - width) if mode == "literal" else n - 1 - F.col("seq")
    weight = F.exp(-age / F.lit(float(tau)))
    scored = tail.withColumn("_key", F.log(u(seed, *keys, row_id) + 1e-12) / weight)
    return top_rows(scored, keys, [F.col("_key").desc(), row_id], remember).drop("_key", "rank", "_n")


# ---- memory tree ------------------------------------------------------------------------------

NODE_COLUMNS = ("stream", "depth", "seq", "parent_seq", "vector", "centroids", "text", "n_children")
CENTROIDS = T.ArrayType(T.ArrayType(T.DoubleType()))


def build_leaves(
    frames: DataFrame,
    stream: str,
    order: Sequence[str],
    vector: str,
    chunk: int = 40,
    k: int | None = None,
    text: str | None = None,
    cluster_min: int = 0,
    caption: Callable[[Column], Column] | None = None,
    whole_only: bool = False,
    seed: int = 42,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One leaf per chunk of frames: mean vector, centroids, text.

    With `k`, a chunk of more than `cluster_min` frames is reduced to k centroids; otherwise every
    frame's vector is a centroid, which a chunk bounds. The text is `caption` of the chunk's texts,
    or the text of the frame nearest to the mean.
    """
    rows = chunk_rows(
        frames.select(
            F.col(stream).alias("stream"),
            *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
            F.col(vector).cast("array<double>").alias("vector"),
            (F.col(text) if text else F.lit(None).cast("string")).alias("text"),
        ),
        ["stream"],
        [f"_o{i}" for i in range(len(order))],
        chunk,
        group_rows,
    )
    if whole_only:
        rows = rows.where((F.col("chunk") + 1) * chunk <= F.col("n"))
    item = F.struct("seq", "vector", "text")
    leaves = rows.groupBy("stream", "chunk").agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        Summarizer.mean(array_to_vector("vector")).alias("_m"),
        F.count(F.lit(1)).alias("n_children"),
    )
    leaves = leaves.withColumn("vector", vector_to_array("_m"))
    centroids = F.col("_items.vector")
    if k is not None:
        reduce = reduce_centroids(k, seed)
        centroids = F.when(F.size("_items") > max(cluster_min, k), reduce(centroids)).otherwise(centroids)
    return leaves.select(
        "stream",
        F.lit(0).alias("depth"),
        F.col("chunk").alias("seq"),
        "vector",
        centroids.alias("centroids"),
        _node_text(caption).alias("text"),
        F.lit(0).cast("long").alias("n_children"),
    )


def _node_text(summarise: Callable[[Column], Column] | None) -> Column:
    if summarise is not None:
        return summarise(F.col("_items.text"))
    near = F.transform(
        "_items",
        lambda x: F.struct(
            F.round(squared(x["vector"], "vector"), 12).alias("d"), x["seq"].alias("s"), x["text"].alias("t")
        ),
    )
    return F.array_min(near)["t"]


def reduce_centroids(k: int, seed: int):
    """Arrow UDF: array of vectors -> at most k centroids; the array is bounded by the tree's width."""

    @F.pandas_udf(CENTROIDS)
    def reduce(batch: pd.Series) -> pd.Series:
        out = []
        for vectors in batch:
            x = np.stack([np.asarray(v, float) for v in vectors])
            draw = np.random.default_rng(seed).permutation(len(x))
            out.append(lloyd(x, np.ones(len(x)), draw, k)[0].tolist())
        return pd.Series(out)

    return reduce


def build_tree(
    leaves: DataFrame,
    interval: int,
    k: int | None = None,
    summarise: Callable[[Column], Column] | None = None,
    whole_only: bool = False,
    seed: int = 42,
) -> DataFrame:
    """All nodes of the trees over the leaves, built level by level from the bottom.

    A parent takes `interval` neighbouring siblings: the mean of their vectors, their centroids
    (reduced to `k` if there are more) and a summary text. Levels end with one root per stream;
    with `whole_only` just complete groups get a parent, which leaves the forest a stream has after
    all possible merges. The number of rounds is the logarithm of the longest stream, and each
    level is written out, so the lineage stays one level deep.
    """
    if interval < 2:
        raise ValueError("interval must be at least 2")
    counts = leaves.groupBy("stream").agg(F.count(F.lit(1)).alias("_n"))
    longest = counts.agg(F.max("_n")).first()[0] or 0
    level = leaves.join(small_side(counts), "stream")
    level = materialise(level)
    levels = []
    n = longest
    while True:
        levels.append(level)
        n = n // interval if whole_only else -(-n // interval) if n > 1 else 0
        if n < 1:
            break
        level = materialise(_parents(level, interval, k, summarise, whole_only, seed))
    nodes = levels[0]
    for other in levels[1:]:
        nodes = nodes.unionByName(other)
    parent = F.floor(F.col("seq") / interval)
    has_parent = parent < F.floor(F.col("_n") / interval) if whole_only else F.col("_n") > 1
    return nodes.withColumn("parent_seq", F.when(has_parent, parent)).select(*NODE_COLUMNS)


def _parents(level, interval, k, summarise, whole_only, seed) -> DataFrame:
    rows = level.where(F.col("_n") > 1)
    item = F.struct("seq", "vector", "text", "centroids")
    grouped = rows.groupBy("stream", F.floor(F.col("seq") / interval).alias("_p")).agg(
        F.array_sort(F.collect_list(item), lambda a, b: (a["seq"] - b["seq"]).cast("int")).alias("_items"),
        Summarizer.mean(array_to_vector("vector")).alias("_m"),
        F.max("depth").alias("_d"),
        F.max("_n").alias("_n"),
    )
    if whole_only:
        grouped = grouped.where(F.size("_items") == interval)
        count = F.floor(F.col("_n") / interval)
    else:
        count = F.ceil(F.col("_n") / interval)
    grouped = grouped.withColumn("vector", vector_to_array("_m"))
    centroids = F.flatten(F.col("_items.centroids"))
    if k is not None:
        centroids = F.when(F.size(centroids) > k, reduce_centroids(k, seed)(centroids)).otherwise(centroids)
    else:
        centroids = F.array(F.col("vector"))
    return grouped.select(
        "stream",
        (F.col("_d") + 1).alias("depth"),
        F.col("_p").alias("seq"),
        "vector",
        centroids.alias("centroids"),
        _node_text(summarise).alias("text"),
        F.size("_items").cast("long").alias("n_children"),
        count.alias("_n"),
    )


def split_tree(leaves: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Top-down variant: a leaf with more than `k` centroids gets `k` child clusters below it.

    Adds child rows at depth -1, one per cluster, whose parent is the leaf.
    """
    many = leaves.where(F.size("centroids") > k)
    parts = many.withColumn("_c", reduce_centroids(k, seed)("centroids")).select(
        "stream", F.col("seq").alias("parent_seq"), F.posexplode("_c").alias("_i", "vector")
    )
    return parts.select(
        "stream",
        F.lit(-1).alias("depth"),
        (F.col("parent_seq") * k + F.col("_i")).alias("seq"),
        "parent_seq",
        "vector",
        F.array("vector").alias("centroids"),
        F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_children"),
    )


def nodes_by_depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


# ---- search -----------------------------------------------------------------------------------

Score = Callable[[Column, Column], Column]


def forest_roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent_seq").isNull())


def descend(
    nodes: DataFrame,
    queries: DataFrame,
    roots: DataFrame | None = None,
    score: Score = cosine,
    single_root: bool = False,
) -> DataFrame:
    """Best path of every question down each tree of its stream.

    `queries`: query_id, stream, query (vector). From each root of depth > 0 the most similar
    child is followed to a leaf and every chosen child is emitted, the root is not; of the roots
    that are leaves the single best is emitted. `single_root` descends only the best root.
    `roots` (query_id, stream, depth, seq) limits a question to some roots, such as those that
    existed when it was asked; by default all roots of the stream count.

    One round per level. Levels of a checked size are broadcast, which the upper ones are; in the
    larger ones the parent key spreads the questions of a busy stream over many partitions.
    """
    table = nodes.select("stream", "depth", "seq", "parent_seq", "vector", "text")
    sizes = table.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(table)).alias("b"))
    small = {r.depth for r in sizes.collect() if r.n <= BROADCAST_ROWS and r.b <= BROADCAST_BYTES}

    def hinted(level: DataFrame, depth: int) -> DataFrame:
        return F.broadcast(level) if depth in small else shuffled(level)

    if roots is None:
        tops = queries.join(small_side(forest_roots(table)), "stream")
    else:
        tops = roots.join(shuffled(queries), ["query_id", "stream"]).join(small_side(table), ["stream", "depth", "seq"])
    similarity = F.round(score(F.col("vector"), F.col("query")), 12)
    tops = tops.withColumn("similarity", similarity)
    if single_root:
        tops = top_rows(tops.where("depth > 0"), ["query_id"], [F.col("similarity").desc(), "depth", "seq"], 1).drop("rank")
    tops = materialise(tops.select("query_id", "stream", "query", "depth", "seq", "similarity", "text"))
    if not single_root:
        flat = top_rows(tops.where("depth = 0"), ["query_id"], [F.col("similarity").desc(), "seq"], 1)
    deepest = tops.agg(F.max("depth")).first()[0] or 0
    frontier = tops.where("depth > 0").select(
        "query_id", "stream", "query", F.col("depth").alias("root_depth"), F.col("seq").alias("root_seq"), "depth", "seq"
    )
    out = None if single_root else flat.select(
        "query_id", "stream", F.lit(0).alias("root_depth"), F.col("seq").alias("root_seq"), "depth", "seq", "similarity", "text"
    )
    for depth in range(deepest, 0, -1):
        now, later = frontier.where(F.col("depth") == depth), frontier.where(F.col("depth") < depth)
        children = table.where(F.col("parent_seq").isNotNull() & (F.col("depth") == depth - 1)).select(
            "stream",
            F.col("parent_seq").alias("_ps"),
            F.col("depth").alias("_cd"),
            F.col("seq").alias("_cs"),
            "vector",
            "text",
        )
        children = hinted(children, depth - 1)
        step = now.withColumnRenamed("seq", "_ps").drop("depth").join(children, ["stream", "_ps"])
        best = step.groupBy("query_id", "stream", "root_depth", "root_seq").agg(
            F.min_by(
                F.struct(
                    F.col("query"),
                    F.col("_cd").alias("depth"),
                    F.col("_cs").alias("seq"),
                    similarity.alias("similarity"),
                    F.col("text"),
                ),
                F.struct(-similarity, F.col("_cs")),
            ).alias("_b")
        )
        best = materialise(best.select("query_id", "stream", "root_depth", "root_seq", "_b.*"))
        chosen = best.drop("query")
        out = chosen if out is None else out.unionByName(chosen)
        frontier = later.unionByName(best.drop("similarity", "text"))
    return out if out is not None else tops.limit(0).select(
        "query_id", "stream", F.col("depth").alias("root_depth"), F.col("seq").alias("root_seq"), "depth", "seq", "similarity", "text"
    )


def weighted_score(text_weight: float = 0.5, image_weight: float = 0.1, split: int = 32) -> Score:
    """Text and image similarity mixed; a vector holds `split` text values before the image ones."""

    def score(node: Column, query: Column) -> Column:
        def part(v: Column, which: int) -> Column:
            return F.slice(v, 1, split) if which == 0 else F.slice(v, F.lit(split + 1), F.size(v) - split)

        return cosine(part(node, 0), part(query, 0)) * text_weight + cosine(part(node, 1), part(query, 1)) * image_weight

    return score


def question_roots(questions: DataFrame, leaf_count: Column, interval: int, max_depth: int) -> DataFrame:
    """Roots a stream has after its first `leaf_count` leaves, once all merges are done.

    They are the digits of the leaf count in base `interval`: digit d tells how many complete
    nodes of depth d wait to be merged.
    """
    per = []
    for d in range(max_depth + 1):
        high = F.floor(leaf_count / F.lit(interval**d))
        low = F.floor(leaf_count / F.lit(interval ** (d + 1))) * interval
        seqs = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        per.append(_at_depth(seqs, d))
    return questions.withColumn("_r", F.explode(F.concat(*per))).select(
        "query_id", "stream", F.col("_r.depth").alias("depth"), F.col("_r.seq").alias("seq")
    )


def _at_depth(seqs: Column, depth: int) -> Column:
    level = F.lit(depth)
    return F.transform(seqs, lambda s: F.struct(level.alias("depth"), s.alias("seq")))


def question_context(short: DataFrame, path: DataFrame) -> DataFrame:
    """Short-memory frames and path nodes of every question in the order they are shown.

    `short`: query_id, item, text. `path`: as from `descend`. Coarse texts come before fine ones,
    so the most detailed text stands last.
    """
    a = short.select("query_id", F.lit("short").alias("kind"), F.lit(None).cast("int").alias("depth"), F.col("item").cast("string"), "text")
    node = F.concat_ws(":", F.col("depth").cast("string"), F.col("seq").cast("string"))
    b = path.select("query_id", F.lit("tree").alias("kind"), F.col("depth").cast("int"), node.alias("item"), "text")
    rows = a.unionByName(b)
    ordered = order_rows(rows, ["query_id"], ["kind", F.col("depth").desc(), "item"], seq="place")
    return ordered.df


def stream_question_context(
    frames: DataFrame,
    questions: DataFrame,
    stream: str,
    order: Sequence[str],
    vector: str,
    text: str,
    question_id: str,
    chunk: int = 40,
    interval: int = 10,
    window: int = 20,
    remember: int = 5,
    tau: float = 5.0,
    k: int | None = None,
    seed: int = 42,
    score: Score = cosine,
    group_rows: int = GROUP_ROWS,
) -> dict[str, DataFrame]:
    """Memory of every question in all streams at once: `short`, `path` and `context` tables.

    A question sees the frames before it in its stream. Frames and questions are put in one order;
    a running count gives the frames seen, from which follow by arithmetic the window of the short
    memory and the roots the forest had at that time. Trees are built once per stream, not once per
    question.
    """
    cols = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    keys = [f"_o{i}" for i in range(len(order))]
    f = frames.select(F.col(stream).alias("stream"), *cols, F.col(vector).cast("array<double>").alias("vector"), F.col(text).alias("text"))
    q = questions.select(F.col(stream).alias("stream"), *cols, F.col(question_id).alias("query_id"), F.col(vector).cast("array<double>").alias("query"))
    both = f.select("stream", *keys, F.lit(1).alias("_frame"), F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("array<double>").alias("query")).unionByName(
        q.select("stream", *keys, F.lit(0).alias("_frame"), "query_id", "query")
    )
    seen = order_rows(both, ["stream"], [*keys, "_frame"], seq="_at", group_rows=group_rows)
    seen = seen.running(inclusive=False, seen=F.col("_frame").cast("long")).df
    asked = materialise(seen.where("_frame = 0").select("query_id", "stream", "query", "seen"))

    numbered = order_rows(f, ["stream"], keys, group_rows=group_rows).df
    spots = asked.where("seen > 0").select(
        "query_id",
        "stream",
        "seen",
        F.explode(F.sequence(F.greatest(F.col("seen") - window, F.lit(0)), F.col("seen") - 1)).alias("seq"),
    )
    tail = spots.join(shuffled(numbered.select("stream", "seq", "text")), ["stream", "seq"])
    width = F.least(F.col("seen"), F.lit(window))
    short = _draw(tail, ["query_id"], "seq", width, F.col("seen"), remember, tau, seed, "literal")
    short = materialise(short.select("query_id", F.col("seq").alias("item"), "text"))

    leaves = build_leaves(
        f, "stream", keys, "vector", chunk, k, "text", whole_only=True, seed=seed, group_rows=group_rows
    )
    nodes = build_tree(leaves, interval, k, whole_only=True, seed=seed)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    roots = question_roots(asked, F.floor(F.col("seen") / chunk), interval, deepest)
    path = descend(nodes, asked.select("query_id", "stream", "query"), roots, score)
    return {"short": short, "path": path, "context": question_context(short, path), "nodes": nodes}


# ---- dialogue memory --------------------------------------------------------------------------


def explode_bank(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested memory bank (user, history, summary maps) to flat turns and day summaries."""
    days = bank.select("user", F.explode("history").alias("date", "_turns"))
    turns = days.select("user", F.to_date("date").alias("date"), F.posexplode("_turns").alias("ord", "_t"))
    turns = turns.select("user", "date", F.col("ord").cast("long"), "_t.*")
    summaries = bank.select("user", F.explode("summary").alias("date", "_s")).select(
        "user", F.to_date("date").alias("date"), "_s.*"
    )
    return turns, summaries


def append_turns(memory: DataFrame, new: DataFrame) -> DataFrame:
    """New dialogue turns added to their user's day; repeating a batch changes nothing."""
    return merge_keep_saved(memory, new, ["user", "date", "ord"])


def memory_defaults(turns: DataFrame) -> DataFrame:
    """Missing strength is 1, missing recall date the day itself, missing id is built from the key."""

    def have(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in turns.columns else default

    day = F.date_format("date", "yyyy-MM-dd")
    return turns.withColumns(
        {
            "memory_strength": have("memory_strength", F.lit(1).cast("long")),
            "last_recall_date": have("last_recall_date", F.col("date")),
            "memory_id": have(
                "memory_id", F.concat_ws("_", F.col("user").cast("string"), day, F.col("ord").cast("string"))
            ),
        }
    )


def retention(days: Column, strength: Column, mode: str = "documented") -> Column:
    """exp(-t / (5 S)): a stronger memory lasts longer. `literal` is exp(-t / 5 * S)."""
    if mode == "documented":
        return F.exp(-days / (F.lit(5.0) * strength))
    if mode == "literal":
        return F.exp(-days / F.lit(5.0) * strength)
    raise ValueError(f"unknown mode {mode!r}")


def forget(
    turns: DataFrame, summaries: DataFrame, now: Column, seed: int = 42, mode: str = "documented"
) -> tuple[DataFrame, DataFrame]:
    """Keep a turn while its draw is at most its retention; summaries of emptied days go too."""
    full = memory_defaults(turns)
    days = F.datediff(now, F.col("last_recall_date"))
    kept = full.where(u(seed, "memory_id") <= retention(days, F.col("memory_strength"), mode))
    alive = kept.select("user", "date").distinct()
    return kept, summaries.join(alive, ["user", "date"], "left_semi")


def reinforce(turns: DataFrame, recalls: DataFrame) -> DataFrame:
    """Recalled memories gain 1 strength per recall and the date of the last recall.

    `recalls`: memory_id, date. Counted before the join, so a memory recalled very often is one row.
    """
    counts = recalls.groupBy("memory_id").agg(F.count(F.lit(1)).alias("_n"), F.max("date").alias("_d"))
    joined = memory_defaults(turns).join(counts, "memory_id", "left")
    return joined.withColumns(
        {
            "memory_strength": F.col("memory_strength") + F.coalesce("_n", F.lit(0)),
            "last_recall_date": F.greatest(F.col("last_recall_date"), F.col("_d")),
        }
    ).drop("_n", "_d")


def summary_work(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """Days of a user that have no summary yet, with the number of turns to summarise."""
    days = turns.groupBy("user", "date").agg(F.count(F.lit(1)).alias("n_turns"))
    return days.join(summaries.select("user", "date"), ["user", "date"], "left_anti")


def add_summaries(
    documents: DataFrame, summaries: DataFrame, summarise: Callable[[Column], Column]
) -> DataFrame:
    """Summaries for day documents (user, date, content) that lack one, joined to the known ones."""
    todo = documents.join(summaries.select("user", "date"), ["user", "date"], "left_anti")
    new = todo.select("user", "date", summarise(F.col("content")).alias("content"))
    return summaries.select("user", "date", "content").unionByName(new)
