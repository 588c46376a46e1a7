"""Tables written once to shared storage, and size checks made before anything is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes a side may have before it is no longer broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Bytes of rows that are sent to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a private one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_roots.setdefault(
        context.applicationId, tempfile.mkdtemp(prefix="frameweave-stage-")
    )


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet and read it back.

    Lineage ends at files that outlive executors, and a non-deterministic column such as a
    physical row position is fixed from then on.
    """
    path = f"{staging_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to BATCH_BYTES, unless a limit is set.

    Spark alone sends up to 10,000 rows whatever their size, and both JVM and Python hold some batches.
    Plans look the limit up when they are run, so it stays set.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table just read, before costly per-row work, if it has fewer splits than cores.

    A large table already has enough splits and passes unchanged, without a shuffle. Not for the
    result of a join or an aggregation: counting its partitions would run its shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: 8 bytes per number, the length of texts, all values of arrays."""

    def width(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        if isinstance(t, T.ArrayType):
            inner = t.elementType
            if isinstance(inner, (T.ArrayType, T.StringType, T.StructType, T.BinaryType)):
                total = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + width(x, inner))
            else:
                total = F.size(c).cast("long") * 8
            return F.coalesce(total, F.lit(0).cast("long"))
        if isinstance(t, T.StructType):
            return sum((width(c[f.name], f.dataType) for f in t), F.lit(0).cast("long"))
        return F.lit(8).cast("long")

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if `df` has at most `rows` rows that take at most about `max_bytes`.

    Rows are counted first, without their values and no further than needed; only a table of few
    rows is measured.
    """
    if df.limit(rows + 1).count() > rows:
        return False
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; above the bound the join shuffles instead."""
    return F.broadcast(df) if fits(df, rows) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Hint that an equi join with `df` shuffles both sides.

    Spark takes the compressed size of files for that of the rows, and a table that is exploded for as
    large as before, so without the hint it may send millions of rows through the driver.
    """
    return df.hint("merge")
