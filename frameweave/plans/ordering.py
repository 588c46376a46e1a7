"""Order-dependent work without a single-task window over an unbounded group.

`order_rows` numbers the rows of each group. Groups of a checked size use a plain window.
Otherwise the rows are range-partitioned on (keys, order), so that even one group with most of
the rows is spread over many tasks; the physical position inside each partition plus one offset
per (partition, group) gives the number. Later windows then run per block of consecutive rows,
with values carried over block edges through a table of one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frameweave.plans.staging import materialise, row_bytes

# Rows and bytes of one group that a single task may sort in a window. Without keys the group is the
# whole table, which other tasks could share, so fewer rows are left to one.
GROUP_ROWS = 1_000_000
GROUP_BYTES = 64 << 20
TABLE_ROWS = 20_000


def as_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def group_extent(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and bytes of the widest, in one map-side combined aggregation.

    Only texts, arrays and binaries are measured; other columns are not read for it.
    """
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.BinaryType, T.StringType))]
    width = row_bytes(df.select(*[F.col(f"`{c}`") for c in wide])) if wide else F.lit(0)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(width).alias("_bytes"))
    most = sizes.agg(F.max("_rows"), F.max("_bytes")).first()
    return most[0] or 0, most[1] or 0


def rows_per_task(group_rows: int, rows: int, size: int) -> int:
    """`group_rows`, or fewer where rows are wide, such as frames with long vectors."""
    return group_rows if size <= GROUP_BYTES else max(1, min(group_rows, GROUP_BYTES * rows // size))


@dataclass(frozen=True)
class Ordered:
    """Rows numbered from 0 within `keys`; `blocked` when a group may exceed one task."""

    df: DataFrame
    keys: tuple[str, ...]
    seq: str
    blocked: bool
    block_rows: int

    def _block(self) -> Column:
        return F.floor(F.col(self.seq) / self.block_rows)

    def window(self) -> Window:
        keys = [*self.keys, "_block"] if self.blocked else list(self.keys)
        return Window.partitionBy(*keys).orderBy(self.seq)

    def with_df(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df)

    def shift(self, offset: int = 1, **columns: str | Column) -> "Ordered":
        """Value `offset` rows earlier (later if negative) as new columns."""
        exprs = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
        if not self.blocked:
            w = self.window()
            return self.with_df(
                self.df.withColumns({k: F.lag(v, offset).over(w) for k, v in exprs.items()})
            )
        # Rows within `offset` of a block edge are also placed in the neighbouring block.
        size, reach = self.block_rows, abs(offset)
        if reach > size:
            return self._shift_far(offset, exprs)
        inside = F.col(self.seq) % size
        near, step = (inside >= size - reach, 1) if offset > 0 else (inside < reach, -1)
        home = self._block()
        df = self.df.withColumn("_home", home).withColumn(
            "_block", F.explode(F.when(near, F.array(home, home + step)).otherwise(F.array(home)))
        )
        w = self.window()
        df = df.withColumns({k: F.lag(v, offset).over(w) for k, v in exprs.items()})
        return self.with_df(df.where(F.col("_home") == F.col("_block")).drop("_home", "_block"))

    def _shift_far(self, offset: int, exprs: dict[str, Column]) -> "Ordered":
        """A shift across whole blocks: rows meet by (keys, number), which is unique."""
        away = self.df.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)],
            (F.col(self.seq) + offset).alias("_to"),
            *[v.alias(f"_far_{k}") for k, v in exprs.items()],
        )
        cond = F.col(self.seq) == F.col("_to")
        for i, k in enumerate(self.keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        df = self.df.join(away, cond, "left").withColumns({k: F.col(f"_far_{k}") for k in exprs})
        return self.with_df(df.drop("_to", *[f"_k{i}" for i in range(len(self.keys))], *[f"_far_{k}" for k in exprs]))

    def running(self, inclusive: bool = True, **columns: Column) -> "Ordered":
        """Running sums from the start of the group up to this row."""
        if not self.blocked:
            w = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            return self.with_df(
                self.df.withColumns(
                    {k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in columns.items()}
                )
            )
        df = self.df.withColumn("_block", self._block())
        heads = df.groupBy(*self.keys, "_block").agg(
            *[F.sum(v).alias(f"_sum_{k}") for k, v in columns.items()]
        )
        before = (
            Window.partitionBy(*self.keys)
            .orderBy("_block")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        heads = heads.select(
            *self.keys,
            "_block",
            *[
                F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}")
                for k in columns
            ],
        )
        w = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        df = df.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in columns.items()})
        df = _join_blocks(df, heads, self.keys)
        df = df.withColumns({k: F.col(k) + F.col(f"_base_{k}") for k in columns})
        return self.with_df(df.drop("_block", *[f"_base_{k}" for k in columns]))

    def next_known(self, **columns: str | Column) -> "Ordered":
        """First non-null value at this row or later, such as the question that ends a segment."""
        exprs = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
        if not self.blocked:
            w = self.window().rowsBetween(0, Window.unboundedFollowing)
            return self.with_df(
                self.df.withColumns(
                    {k: F.first(v, ignorenulls=True).over(w) for k, v in exprs.items()}
                )
            )
        df = self.df.withColumn("_block", self._block())
        heads = df.groupBy(*self.keys, "_block").agg(
            *[
                F.min_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.col(self.seq))).alias(
                    f"_head_{k}"
                )
                for k, v in exprs.items()
            ]
        )
        after = (
            Window.partitionBy(*self.keys)
            .orderBy("_block")
            .rowsBetween(1, Window.unboundedFollowing)
        )
        heads = heads.select(
            *self.keys,
            "_block",
            *[
                F.first(f"_head_{k}", ignorenulls=True).over(after).alias(f"_next_{k}")
                for k in exprs
            ],
        )
        w = self.window().rowsBetween(0, Window.unboundedFollowing)
        df = df.withColumns({k: F.first(v, ignorenulls=True).over(w) for k, v in exprs.items()})
        df = _join_blocks(df, heads, self.keys)
        df = df.withColumns({k: F.coalesce(F.col(k), F.col(f"_next_{k}")) for k in exprs})
        return self.with_df(df.drop("_block", *[f"_next_{k}" for k in exprs]))

    def pages(self, rows: int, page: str = "page", **arrays: Column) -> DataFrame:
        """One row per group and page of at most `rows` consecutive rows, as ordered arrays.

        A group is never gathered whole: a long one gives several pages.
        """
        item = F.struct(F.col(self.seq).alias("_s"), *[v.alias(k) for k, v in arrays.items()])
        df = self.df.withColumn(page, F.floor(F.col(self.seq) / rows)).groupBy(*self.keys, page)
        df = df.agg(F.array_sort(F.collect_list(item)).alias("_items"))
        return df.select(
            *self.keys, page, *[F.col(f"_items.{k}").alias(k) for k in arrays]
        )


def _join_blocks(df: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    # One row per block on the right: each joined group is one block, so no key is hot here.
    if not keys:
        return df.join(heads, "_block")
    cond = df["_block"] == heads["_block"]
    for k in keys:
        cond = cond & df[k].eqNullSafe(heads[k])
    return df.join(heads, cond).drop(*[heads[k] for k in keys], heads["_block"])


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    seq: str = "seq",
    size: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> Ordered:
    """Number rows from 0 within `keys` by the total order `order`; `size` adds the group count."""
    keys, order = tuple(keys), as_columns(order)
    rows, width = group_extent(df, keys)
    group_rows = rows_per_task(group_rows if keys else min(group_rows, TABLE_ROWS), rows, width)
    if rows <= group_rows:
        whole = Window.partitionBy(*keys)
        out = df.withColumn(seq, F.row_number().over(whole.orderBy(*order)).cast("long") - 1)
        if size:
            out = out.withColumn(size, F.count(F.lit(1)).over(whole))
        return Ordered(out, keys, seq, False, group_rows)

    staged = materialise(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    staged = staged.withColumn("_part", F.shiftright("_at", 33))
    spans = staged.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *keys,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(group).alias("_size"),
    )
    if keys:
        cond = staged["_part"] == spans["_part"]
        for k in keys:
            cond = cond & staged[k].eqNullSafe(spans[k])
        out = staged.join(spans, cond).drop(*[spans[k] for k in keys], spans["_part"])
    else:
        out = staged.join(spans, "_part")
    out = out.withColumn(seq, F.col("_base") + F.col("_at") - F.col("_first"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    out = out.drop("_at", "_part", "_first", "_base", "_size")
    return Ordered(out, keys, seq, True, group_rows)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank", group_rows: int = 1000
) -> DataFrame:
    """Best `k` rows per group.

    Up to Spark's group-limit bound (1000) every map task already cuts each group to `k` rows
    before the shuffle. A larger `k` is cut per salt first, so a hot group is ranked by many tasks; so is
    a `k` beyond a smaller `group_rows`.
    """
    order = as_columns(order)
    if k > min(1000, group_rows):
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.spark_partition_id())
            .withColumn("_r", F.row_number().over(first))
            .where(F.col("_r") <= k)
            .drop("_salt", "_r")
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def last_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, seq: str = "seq", size: str = "n", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The last `k` rows per group with their number from 0 and the group's size, without ordering the rest."""
    rows = top_rows(df, keys, [F.col(c).desc() for c in order], k, "_back", group_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    same = None
    for c in keys:
        one = rows[c].eqNullSafe(sizes[c])
        same = one if same is None else same & one
    out = rows.join(sizes, same).drop(*[sizes[c] for c in keys]) if keys else rows.join(F.broadcast(sizes))
    return out.withColumn(seq, F.col(size) - F.col("_back")).drop("_back")
