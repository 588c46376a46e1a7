"""Sampling, chunking, cutting and ranking of ordered streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameweave.plans.ordering import order_rows, top_rows
from frameweave.plans.staging import small_side


def _options(group_rows: int | None) -> dict:
    return {} if group_rows is None else {"group_rows": group_rows}


def mean_step(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, group_rows: int | None = None
) -> DataFrame:
    """Mean absolute difference of neighbouring values."""
    rows = order_rows(df.select(*keys, *order, value), keys, order, **_options(group_rows))
    steps = rows.shift(1, _prev=value).df
    return steps.groupBy(*keys).agg(
        F.avg(F.abs(F.col(value) - F.col("_prev"))).alias("mean_step"),
        F.count("_prev").alias("steps"),
    )


# ---- sampling ---------------------------------------------------------------------------------

TARGETS = ("linspace", "midpoint", "centre")
FILTERS = ("spread", "every", "stride")


def sample_targets(mode: str, n: Column, m: Column) -> Column:
    """Indices chosen from `n` rows for `m` samples, one array per stream."""
    i = F.sequence(F.lit(0).cast("long"), m.cast("long") - 1)
    empty = F.array().cast("array<bigint>")
    if mode == "linspace":  # m points from the first to the last row
        step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(F.lit(0.0))
        pick = F.transform(i, lambda x: F.when(x == m - 1, F.when(m > 1, n - 1).otherwise(0)).otherwise(F.floor(x * step)))
    elif mode == "midpoint":  # middle of each of m segments with rounded ends
        seg = (n - 1) / m
        pick = F.transform(
            i, lambda x: F.floor((F.bround(seg * x) + F.bround(seg * (x + 1))) / 2).cast("long")
        )
    elif mode == "centre":  # half a segment past each rounded segment start, over [0, n-1]
        seg = (n - 1) / m
        pick = F.transform(i, lambda x: F.floor(seg / 2 + F.bround(seg * x)).cast("long"))
    else:
        raise ValueError(f"unknown target mode {mode!r}")
    return F.when((n > 0) & (m > 0), pick).otherwise(empty)


def sample_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    mode: str,
    m: Column | int,
    group_rows: int | None = None,
) -> DataFrame:
    """Uniform sample of each ordered stream; adds `seq`, stream size `n` and for index modes `i`.

    `spread`: index `int(i*n/m)`, kept by arithmetic on the row's own position, without a join;
    a row is repeated when m > n. `every`: each m-th row. `stride`: step `n // m`, m rows; all
    rows if n < m. `linspace`, `midpoint`, `centre`: targets per stream joined on position.
    `m` may be a column over the keys and `n`.
    """
    m = F.lit(m).cast("long") if isinstance(m, int) else m.cast("long")
    rows = order_rows(df, keys, order, size="n", **_options(group_rows)).df
    n, seq = F.col("n"), F.col("seq")
    if mode == "spread":
        # i with floor(i*n/m) = seq are those in [ceil(seq*m/n), ceil((seq+1)*m/n) - 1].
        low, high = F.ceil(seq * m / n), F.ceil((seq + 1) * m / n) - 1
        hits = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return rows.withColumn("i", F.explode(hits))
    if mode == "every":
        return rows.where(F.pmod(seq, m) == 0)
    if mode == "stride":
        step = F.floor(n / m)
        return rows.where((n < m) | ((F.pmod(seq, F.greatest(step, F.lit(1))) == 0) & (F.floor(seq / F.greatest(step, F.lit(1))) < m)))
    targets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    targets = targets.select(*keys, F.posexplode(sample_targets(mode, n, m)).alias("i", "seq"))
    return rows.join(targets, [*keys, "seq"])


def frame_plan(
    df: DataFrame,
    keys: Sequence[str],
    duration: Column | None = None,
    max_fps: float = 2.0,
    fps: float = 2.0,
    rate: float = 0.2,
    chunk: int | None = None,
    cap: tuple[int, int] | None = None,
    min_frames: int = 4,
    max_frames: int | None = None,
    factor: int = 2,
) -> DataFrame:
    """Frames to take per stream, by each of three rules.

    `segment`: all rows of a segment up to `chunk` rows if given, else `int(n*rate)`; `cap` (over,
    to) takes `to` frames where that exceeds `over`. `rate_capped`: `min(n, int(duration*max_fps))`. `clamped`:
    `duration*fps` between bounds that are multiples of `factor`, rounded to a multiple.
    """
    seconds = F.lit(0.0) if duration is None else duration
    plan = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), seconds.alias("duration"))
    n = F.col("n")
    share = F.floor(n * F.lit(rate) + 1e-9)
    segment = share if cap is None else F.when(share > cap[0], cap[1]).otherwise(share)
    segment = segment if chunk is None else F.when(n <= chunk, n).otherwise(segment)
    low = F.ceil(F.lit(min_frames) / factor) * factor
    high = F.floor((n if max_frames is None else F.least(F.lit(max_frames), n)) / factor) * factor
    want = F.bround(F.least(F.greatest(F.col("duration") * fps, low), high) / factor) * factor
    return plan.withColumns(
        {
            "segment": segment.cast("long"),
            "rate_capped": F.least(n, F.greatest(F.floor(F.col("duration") * max_fps), F.lit(1))),
            "clamped": want.cast("long"),
        }
    )


def sample_planned(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], plan: DataFrame, frames: str
) -> DataFrame:
    """Spread sample whose size per stream comes from a plan table."""
    sized = df.join(small_side(plan.select(*keys, F.col(frames).alias("_m"))), list(keys))
    return sample_rows(sized.where("_m > 0"), keys, order, "spread", F.col("_m")).drop("_m")


def chunk_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, group_rows: int | None = None
) -> DataFrame:
    """Count-based chunks of each ordered stream: adds `seq`, `n` and `chunk`."""
    rows = order_rows(df, keys, order, size="n", **_options(group_rows)).df
    return rows.withColumn("chunk", F.floor(F.col("seq") / size))


def island_key(df: DataFrame, keys: Sequence[str], value: str, group_rows: int | None = None) -> DataFrame:
    """Adds `island`: equal for rows whose `value` runs on without a gap."""
    rows = order_rows(df, keys, [value], **_options(group_rows)).df
    return rows.withColumn("island", F.col(value) - F.col("seq")).drop("seq")


def islands(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs of consecutive ids: first, last and length."""
    return (
        island_key(df.select(*keys, value), keys, value)
        .groupBy(*keys, "island")
        .agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n"))
        .drop("island")
    )


def event_cuts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    change: Column,
    previous: dict[str, str | Column],
    cuts: int = 4,
    group_rows: int | None = None,
) -> DataFrame:
    """Segment number per row: a new segment starts at each of the largest `cuts` changes.

    `change` compares a row with the `previous` columns, which hold the row before it.
    """
    rows = order_rows(df, keys, order, **_options(group_rows)).shift(1, **previous)
    with_change = rows.df.withColumn("_change", F.when(F.col("seq") > 0, change))
    best = top_rows(
        with_change.where(F.col("_change").isNotNull()).select(*keys, "seq", "_change"),
        keys,
        [F.col("_change").desc(), "seq"],
        cuts,
    ).select(*keys, "seq", F.lit(1).alias("_cut"))
    marked = with_change.drop("_change", *previous).join(best, [*keys, "seq"], "left")
    cut = F.coalesce(F.col("_cut"), F.lit(0)).cast("long")
    return rows.with_df(marked).running(segment=cut).df.drop("_cut")


def segment_spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "segment").agg(
        F.min("seq").alias("start"), F.max("seq").alias("end"), F.count(F.lit(1)).alias("n")
    )


def best_of(df: DataFrame, prompt: str, score: str, tie: str, k: int = 1) -> DataFrame:
    """Best `k` candidates per prompt."""
    return top_rows(df, [prompt], [F.col(score).desc(), tie], k)


def prompt_advantage(
    df: DataFrame,
    prompt: str,
    batch: str,
    order: Sequence[str],
    reward: str,
    buffer_size: int,
    min_count: int,
    group_rows: int | None = None,
) -> DataFrame:
    """Reward standardised by the prompt's last `buffer_size` rewards up to the current batch.

    A prompt with fewer than `min_count` rewards in its buffer uses the mean and spread of the
    whole batch. The buffer sums are differences of running sums, so a hot prompt is never
    gathered in one task.
    """
    centre = df.agg(F.avg(reward)).first()[0] or 0.0
    x = F.col(reward) - F.lit(centre)
    rows = order_rows(df, [prompt], [batch, *order], **_options(group_rows))
    rows = rows.running(_s=x, _q=x * x).shift(buffer_size, _s0="_s", _q0="_q")
    known = F.least(F.col("seq") + 1, F.lit(buffer_size))
    ends = rows.df.groupBy(prompt, batch).agg(
        F.max_by(
            F.struct(
                known.alias("k"),
                (F.col("_s") - F.coalesce("_s0", F.lit(0.0))).alias("s"),
                (F.col("_q") - F.coalesce("_q0", F.lit(0.0))).alias("q"),
            ),
            "seq",
        ).alias("_b")
    )
    mean = F.col("_b.s") / F.col("_b.k")
    ends = ends.select(
        prompt,
        batch,
        (F.col("_b.k") >= min_count).alias("_own"),
        (mean + centre).alias("_mean"),
        F.sqrt(F.greatest(F.col("_b.q") / F.col("_b.k") - mean * mean, F.lit(0.0))).alias("_std"),
    )
    whole = df.groupBy(batch).agg(F.avg(reward).alias("_bm"), F.stddev_pop(reward).alias("_bs"))
    joined = df.join(ends, [prompt, batch]).join(small_side(whole), batch)
    m = F.when(F.col("_own"), F.col("_mean")).otherwise(F.col("_bm"))
    s = F.when(F.col("_own"), F.col("_std")).otherwise(F.col("_bs")) + 1e-6
    return joined.withColumn("advantage", (F.col(reward) - m) / s).drop("_own", "_mean", "_std", "_bm", "_bs")


def unique_ids(df: DataFrame, key: str, order: Sequence[str], out: str) -> DataFrame:
    """Repeated ids made unique by a running count from 0."""
    rows = order_rows(df, [key], order).df
    return rows.withColumn(out, F.concat(F.col(key).cast("string"), F.lit("_"), F.col("seq").cast("string")))


def probe_grid(
    df: DataFrame,
    order: Sequence[str],
    row_id: str,
    lengths: Sequence[int],
    depths: Sequence[float],
    done: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """For every (length, depth) the first `length` rows with a marker put at `int(depth*length)`.

    `done` lists cells to skip. Positions follow by arithmetic: rows at or after the marker move
    up by one. The marker row has a NULL id.
    """
    spark = df.sparkSession
    cells = spark.createDataFrame(
        [(int(n), float(d)) for n in lengths for d in depths], "length long, depth double"
    )
    if done is not None:
        cells = cells.join(done, ["length", "depth"], "left_anti")
    cells = cells.withColumn("marker", F.floor(F.col("depth") * F.col("length") + 1e-9))
    grid = [r.asDict() for r in cells.orderBy("length", "depth").collect()]  # the given small grid
    literal = F.array(
        *[
            F.struct(
                F.lit(c["length"]).alias("length"), F.lit(c["depth"]).alias("depth"), F.lit(c["marker"]).alias("marker")
            )
            for c in grid
        ]
    )
    rows = order_rows(df.select(row_id, *[o for o in order if o != row_id]), [], order, **_options(group_rows)).df
    placed = rows.select(
        row_id, "seq", F.inline(F.filter(literal, lambda c: c["length"] > F.col("seq")))
    ).select(
        "length",
        "depth",
        (F.col("seq") + (F.col("seq") >= F.col("marker")).cast("long")).alias("position"),
        row_id,
    )
    markers = cells.select(
        "length", "depth", F.col("marker").alias("position"), F.lit(None).cast(df.schema[row_id].dataType).alias(row_id)
    )
    return placed.unionByName(markers)


def retention_weights(
    df: DataFrame, keys: Sequence[str], age: Column, tau: float, out: str = "weight"
) -> DataFrame:
    """`exp(-age/tau)` scaled to sum 1 within the keys; for windows of a bounded length."""
    raw = F.exp(-age / F.lit(float(tau)))
    return df.withColumn("_w", raw).withColumn(
        out, F.col("_w") / F.sum("_w").over(Window.partitionBy(*keys))
    ).drop("_w")
