"""Mixing, sampling, ordering and packing of corpora."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.functions.hashing import u
from frameweave.plans.ordering import GROUP_ROWS, as_columns, order_rows, top_rows
from frameweave.plans.staging import materialise, small_side

# ---- mixtures ---------------------------------------------------------------------------------


def mixture(names: str, registry: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Union of the sources named in `a+b+c`, each row tagged with its `source_name`."""
    parts = []
    for name in names.strip().split("+"):
        if name not in registry:
            raise KeyError(f"unknown source {name!r}")
        parts.append(registry[name]().withColumn("source_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def repeat_sources(df: DataFrame, source: str, ratios: Mapping[str, int], default: int = 1) -> DataFrame:
    """Each row repeated by its source's whole-number ratio; 0 leaves the source out."""
    times = F.lit(default)
    for name, ratio in ratios.items():
        times = F.when(F.col(source) == name, F.lit(int(ratio))).otherwise(times)
    copies = F.sequence(F.lit(1), F.greatest(times, F.lit(1)))
    return df.where(times > 0).withColumn("copy", F.explode(copies))


def head_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First `n` rows of the whole order; a long head is cut by position, not in one task."""
    if n <= 10_000:
        return df.orderBy(*order).limit(n)
    return order_rows(df, [], order).df.where(F.col("seq") < n).drop("seq")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


# ---- orders -----------------------------------------------------------------------------------


def interleave(df: DataFrame, source: str, order: Sequence[str], replicas: int) -> DataFrame:
    """Sources merged so that each is spread evenly over the whole, larger sources first on ties.

    Row i of a source with n rows sorts at (i + 0.5) / n. Positions are dealt to replicas in turn
    and the rest that does not fill all replicas is dropped.
    """
    rows = order_rows(df, [source], order, seq="_i", size="_n").df
    rows = rows.withColumn("_at", (F.col("_i") + 0.5) / F.col("_n"))
    merged = order_rows(
        rows, [], ["_at", F.col("_n").desc(), source, "_i"], seq="position", size="_total"
    ).df
    whole = F.floor(F.col("_total") / replicas) * replicas
    return (
        merged.where(F.col("position") < whole)
        .withColumn("replica", F.col("position") % replicas)
        .drop("_i", "_n", "_at", "_total")
    )


def shard_shuffle(
    df: DataFrame, shard: str, row_id: str, seed: int, epoch: int, workers: int
) -> DataFrame:
    """Shards in random order and rows in random order within their shard; contiguous workers."""
    key = f"{seed + epoch}"
    rows = df.withColumns({"_su": u(key, shard), "_ru": u(key, row_id)})
    out = order_rows(rows, [], ["_su", shard, "_ru", row_id], seq="position", size="_n").df
    per = F.ceil(F.col("_n") / workers)
    return out.withColumn("worker", F.floor(F.col("position") / per)).drop("_su", "_ru", "_n")


def length_groups(
    df: DataFrame,
    row_id: str,
    length: str,
    modality: str,
    batch_size: int,
    world_size: int,
    seed: int,
) -> DataFrame:
    """Batches of similar total length: random megabatches, each dealt to `world_size` lanes.

    In a megabatch the longest row goes to the lane with the least length that still has room; an
    incomplete megabatch is dealt in turn. Modalities never share a megabatch, except that their
    incomplete last ones are joined and dealt together as `megabatch` -1, which is smaller than one
    megabatch per modality. One task holds one megabatch. `turn` orders the megabatches at random.
    """
    mega = batch_size * world_size
    rows = df.select(row_id, F.abs(length).cast("long").alias("length"), modality)
    rows = rows.withColumn("_u", u(seed, row_id))
    rows = order_rows(rows, [modality], ["_u", row_id], size="_n").df
    rows = rows.withColumn("megabatch", F.floor(F.col("seq") / mega))
    whole = (F.col("megabatch") + 1) * mega <= F.col("_n")
    rows = rows.withColumns(
        {"megabatch": F.when(whole, F.col("megabatch")).otherwise(-1), "_kind": F.when(whole, F.col(modality))}
    )
    schema = T.StructType(
        [
            T.StructField(row_id, df.schema[row_id].dataType),
            T.StructField("length", T.LongType()),
            T.StructField(modality, df.schema[modality].dataType),
            T.StructField("megabatch", T.LongType()),
            T.StructField("lane", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("turn", T.DoubleType()),
        ]
    )
    rows = rows.withColumn("turn", u(f"{seed}/turn", F.coalesce(F.col("_kind").cast("string"), F.lit("")), "megabatch"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", row_id], ascending=[False, True], ignore_index=True)
        n = len(pdf)
        if n % world_size:
            lane = np.arange(n) % world_size
        else:
            room = np.full(world_size, n // world_size)
            load = np.zeros(world_size)
            lane = np.empty(n, dtype=int)
            for i, size in enumerate(pdf["length"]):
                j = int(np.argmin(np.where(room > 0, load, np.inf)))
                lane[i] = j
                load[j] += size
                room[j] -= 1
        pdf["lane"] = lane
        pdf["place"] = pdf.groupby("lane").cumcount()
        return pdf[[f.name for f in schema]]

    return rows.select(row_id, "length", modality, "megabatch", "turn", "_kind").groupBy("_kind", "megabatch").applyInPandas(
        deal, schema
    )


# ---- samples ----------------------------------------------------------------------------------


def stratified_sample(
    df: DataFrame,
    row_id: str,
    stratum: str,
    n: int,
    seed: int,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """`n` rows in proportion to the strata, then filled up from the rest in random order.

    The quota of a stratum is `int(n * its share of all rows)`; excluded ids count for the share
    but are never taken.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    total = df.count()
    quotas = sizes.select(stratum, F.floor(F.col("_c") * n / F.lit(total) + 1e-9).alias("_quota"))
    pool = df if exclude is None else df.join(exclude.select(row_id), row_id, "left_anti")
    pool = pool.withColumn("_u", u(seed, row_id))
    # No stratum gives more than its quota and then n rows, so only those are kept and ordered.
    ranked = top_rows(pool, [stratum], ["_u", row_id], 2 * n).join(small_side(quotas), stratum)
    ranked = ranked.withColumn("pass", F.when(F.col("rank") <= F.col("_quota"), 1).otherwise(2))
    return ranked.orderBy("pass", "_u", row_id).limit(n).drop("_u", "rank", "_quota")


def fixed_groups(
    df: DataFrame, worker: str, shard: str, row_id: str, size: int, seed: int
) -> DataFrame:
    """Groups of exactly `size` consecutive rows per worker after a seeded shuffle inside shards."""
    rows = df.withColumn("_u", u(seed, shard, row_id))
    out = order_rows(rows, [worker], [shard, "_u", row_id], size="_n").df
    return (
        out.withColumn("group", F.floor(F.col("seq") / size))
        .where((F.col("group") + 1) * size <= F.col("_n"))
        .withColumn("place", F.col("seq") % size)
        .drop("_u", "seq", "_n")
    )


def equal_share(
    df: DataFrame, shard: str, order: Sequence[str], workers: int
) -> DataFrame:
    """Contiguous shards per worker, every worker cut to the smallest worker's number of rows.

    Shards beyond `workers * (shards // workers)` are left out, as each worker gets as many.
    """
    shards = df.groupBy(shard).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = order_rows(shards, [], [shard], seq="_s", size="_k").df
    per = F.floor(F.col("_k") / workers)
    assigned = numbered.where(F.col("_s") < per * workers).withColumn("worker", F.floor(F.col("_s") / per))
    least = assigned.groupBy("worker").agg(F.sum("_rows").alias("_w")).agg(F.min("_w")).first()[0] or 0
    rows = df.join(small_side(assigned.select(shard, "worker")), shard)
    out = order_rows(rows, ["worker"], [shard, *order], seq="place").df
    return out.where(F.col("place") < least)


# ---- token blocks and packs -------------------------------------------------------------------


def token_blocks(
    df: DataFrame,
    order: Sequence[str | Column],
    tokens: str,
    length: int,
    end: Column,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """All samples' tokens, an end token after each, cut into blocks of exactly `length`.

    The offset of a sample is a running sum of lengths; a sample is cut only at block borders, so
    one row is shuffled per (sample, block) and not per token. Ties in `order` are broken by the
    place of a row in the input. The last partial block is dropped.
    """
    rows = df.withColumns({f"_o{i}": c for i, c in enumerate(as_columns(order))})
    names = [f"_o{i}" for i in range(len(order))]
    rows = rows.select(*names, F.concat(F.col(tokens), F.array(end)).alias("_t"), F.monotonically_increasing_id().alias("_id"))
    rows = materialise(rows.withColumn("_n", F.size("_t").cast("long")))  # fixes the row numbers
    # Lengths alone go through the global order; the tokens meet their offset by row number.
    run = order_rows(rows.select(*names, "_id", "_n"), [], [*names, "_id"], group_rows=group_rows)
    at = materialise(run.running(inclusive=False, _at=F.col("_n")).df.select("_id", "_at"))
    run = rows.join(small_side(at), "_id")
    first, last = F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.col("_n") - 1) / length)
    pieces = run.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * length, F.col("_at"))
    stop = F.least((F.col("block") + 1) * length, F.col("_at") + F.col("_n"))
    piece = F.slice("_t", (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int"))
    blocks = pieces.select("block", start.alias("_start"), piece.alias("_p")).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_p"))).alias("_pieces")
    )
    out = blocks.select("block", F.flatten(F.col("_pieces._p")).alias("tokens"))
    return out.where(F.size("tokens") == length)


def pack_sequences(
    df: DataFrame,
    row_id: str,
    length: Column,
    images: Column,
    max_length: int,
    max_images: int,
    seed: int,
    bucket_rows: int,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows packed into sequences of at most `max_length` tokens and `max_images` images.

    Inside a bucket of at most `bucket_rows` random rows the longest come first and a pack closes
    as soon as the next row does not fit. `start` is the offset of a row in its pack; positions
    restart at 0 for every row. Rows that exceed a limit alone come back without a bucket or pack.
    """
    rows = df.select(row_id, length.cast("long").alias("length"), images.cast("long").alias("images"))
    fits = F.coalesce((F.col("length") <= max_length) & (F.col("images") <= max_images), F.lit(False))
    over = rows.where(~fits)
    rows = rows.where(fits)
    rows = order_rows(rows.withColumn("_u", u(seed, row_id)), [], ["_u", row_id], group_rows=group_rows).df
    rows = rows.withColumn("bucket", F.floor(F.col("seq") / bucket_rows)).drop("_u", "seq")
    schema = T.StructType(
        [
            T.StructField(row_id, df.schema[row_id].dataType),
            T.StructField("length", T.LongType()),
            T.StructField("images", T.LongType()),
            T.StructField("bucket", T.LongType()),
            T.StructField("pack", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("start", T.LongType()),
        ]
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", row_id], ascending=[False, True], ignore_index=True)
        packs, places, starts = [], [], []
        pack_no, used, shown, place = 0, 0, 0, 0
        for size, pics in zip(pdf["length"], pdf["images"]):
            if place and (used + size > max_length or shown + pics > max_images):
                pack_no, used, shown, place = pack_no + 1, 0, 0, 0
            packs.append(pack_no)
            places.append(place)
            starts.append(used)
            used, shown, place = used + size, shown + pics, place + 1
        return pdf.assign(pack=packs, place=places, start=starts)[[f.name for f in schema]]

    packed = rows.groupBy("bucket").applyInPandas(pack, schema)
    return packed.unionByName(over, allowMissingColumns=True)


def pad_batches(
    df: DataFrame,
    order: Sequence[str],
    ids: str,
    batch_size: int,
    pad: Column,
    max_length: int | None = None,
) -> DataFrame:
    """Token arrays cut to the model maximum and padded to the longest of their batch."""
    # Cut before they are put in order, so that no more than is kept travels.
    cut = df.withColumn(ids, F.slice(ids, 1, max_length)) if max_length else df
    rows = order_rows(cut, [], order).df.withColumn("batch", F.floor(F.col("seq") / batch_size))
    widths = rows.groupBy("batch").agg(F.max(F.size(ids)).alias("_width"))
    joined = rows.join(widths, "batch")
    missing = F.col("_width") - F.size(ids)
    return joined.withColumns(
        {
            "attention_mask": F.concat(
                F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing)
            ),
            ids: F.concat(F.col(ids), F.array_repeat(pad, missing)),
        }
    ).drop("_width", "seq")


def stride_images(images: Column, limit: int = 8) -> Column:
    """Every second image of a row with exactly `limit`; NULL (reject) beyond the limit."""
    n = F.size(images)
    halved = F.filter(images, lambda x, i: i % 2 == 0)
    return F.when(n == limit, halved).when(n < limit, images)


def collate(
    df: DataFrame, order: Sequence[str], columns: Mapping[str, Column], batch_size: int
) -> DataFrame:
    """One row of ordered lists per batch; a key absent (NULL) in a row is skipped in its list."""
    rows = order_rows(df, [], order)
    pages = rows.pages(batch_size, page="batch", **columns)
    return pages.select("batch", *[F.filter(c, lambda x: x.isNotNull()).alias(c) for c in columns])
