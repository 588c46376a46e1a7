"""Running totals over an order of any size, without a window over an unbounded group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameweave.plans.staging import materialise


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: sum of `value` over this and all earlier rows of the same `keys`.

    Rows are range-partitioned on (keys, order), so one key with most of the rows spreads over many
    tasks, and written out, which fixes their partition. A table with one row per (partition, key)
    then carries what came before. `keys` must not be null; rows equal in keys and order are
    interchangeable. Also adds `_part` and `_nth`, which number the rows.
    """
    laid = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = materialise(laid.withColumn("_part", F.spark_partition_id()))
    sums = laid.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part") if not keys else Window.partitionBy(*keys).orderBy("_part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumns({out: F.sum(value).over(upto), "_nth": F.row_number().over(inside)})
    return laid.join(sums, ["_part", *keys]).withColumn(out, F.col(out) + F.col("_base")).drop("_base")
