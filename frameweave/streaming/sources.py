"""Stream sources, sinks and windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from frameweave.plans.staging import staging_root


def read_frames(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """File stream of frames; `files_per_trigger` bounds what one micro-batch takes."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_sink(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append results as Parquet with a checkpoint, taking all that is available and stopping."""
    return (
        df.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drain(df: DataFrame, folder: str, checkpoint: str) -> None:
    append_sink(df, folder, checkpoint).awaitTermination()


def batch_sink(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Call `write` with each micro-batch and its number until all that is available is taken."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True
    ).start().awaitTermination()


#: Batches of a log that are folded into a base.
FOLD = 16


class KeyedLog:
    """Rows by key as a base folder and a log of the batches since it, in generations.

    Generation g holds batches g * fold .. (g + 1) * fold - 1 under `log/generation=g/batch=n`. When the
    next one begins, base g + 1 is made of base g and log g with one row per key, the last one. A reader
    takes the newest complete base and the log from there on, so neither readers nor writers ever
    go through more than one base and `fold` batches. A repeated batch or fold replaces itself.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: T.StructType, fold: int = FOLD):
        self.spark, self.folder, self.keys, self.fold = spark, folder, keys, fold
        self.schema = T.StructType([*schema, T.StructField("batch_id", T.LongType())])

    def _read(self, *paths: str) -> DataFrame:
        there = [p for p in paths if self._exists(f"{p}/_SUCCESS")]
        return self.spark.read.schema(self.schema).parquet(*there) if there else self.spark.createDataFrame([], self.schema)

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _log(self, generation: int) -> list[str]:
        first = generation * self.fold
        return [f"{self.folder}/log/generation={generation}/batch={n}" for n in range(first, first + self.fold)]

    def _latest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.keys]
        best = F.max_by(F.struct(*values), "batch_id")
        return rows.groupBy(*self.keys).agg(best.alias("_v")).select(*self.keys, "_v.*").select(*self.schema.names)

    def _base(self, generation: int) -> str:
        return f"{self.folder}/base/generation={generation}"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        generation = batch_id // self.fold
        if generation and not self._exists(f"{self._base(generation)}/_SUCCESS"):
            old = self._read(self._base(generation - 1), *self._log(generation - 1))
            self._latest(old).write.mode("overwrite").parquet(self._base(generation))
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).select(*self.schema.names)
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/generation={generation}/batch={batch_id}")

    def generation(self) -> int:
        """The newest one that has a base, found by doubling; 0 has none and needs none."""
        high = 1
        while self._exists(f"{self._base(high)}/_SUCCESS"):
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._exists(f"{self._base(middle)}/_SUCCESS") else (low, middle)
        return low

    def read(self) -> DataFrame:
        """The last row of each key."""
        now = self.generation()
        return self._latest(self._read(self._base(now), *self._log(now))).drop("batch_id")


def upsert_sink(df: DataFrame, folder: str, checkpoint: str, keys: list[str], mode: str = "update", fold: int = FOLD) -> KeyedLog:
    """Keep the last row of each key of a stream; a replayed batch changes nothing."""
    log = KeyedLog(df.sparkSession, folder, keys, df.schema, fold)
    batch_sink(df, log.write, checkpoint, mode)
    return log


def dialogue_sink(df: DataFrame, folder: str, checkpoint: str, keys: list[str], ts: str = "ts", late: str = "1 day") -> None:
    """Append dialogue turns once per key. Keys are remembered in state until the watermark has passed
    them, and the file sink commits each batch once, so neither a turn sent again within `late` nor a
    replayed batch adds a row, and no batch reads what is stored.
    """
    drain(df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys), folder, checkpoint)


def staged_files(rows: DataFrame, order: list[str], files: int, ts: str = "ts", late: str = "10 minutes") -> str:
    """Write `rows` as `files` files in the order of `order`, and a last file with one row of nulls whose
    time lies beyond `late`, which makes all others final. Returns a pattern for `read_frames`, to be
    read one file per trigger. All tasks read for a file, one sorts it, so
    large tables take more of them.
    """
    spark, folder = rows.sparkSession, f"{staging_root(rows.sparkSession)}/feed-{uuid.uuid4().hex}"
    shares = [i / files for i in range(1, files)]
    cuts = rows.agg(F.percentile_approx(F.unix_micros(ts), shares, 10_000)).first()[0] if shares else []
    edges = [None, *(cuts or []), None]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        at = F.unix_micros(ts)
        inside = (F.lit(True) if a is None else at > a) & (F.lit(True) if b is None else at <= b)
        rows.where(inside).repartition(1).sortWithinPartitions(*order).write.parquet(f"{folder}/{i:04d}")
    end = rows.agg((F.max(ts) + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 SECOND")).alias(ts))
    names = [F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    end.select(*names).coalesce(1).write.parquet(f"{folder}/{files:04d}")
    return f"{folder}/*"


def windowed_counts(
    frames: DataFrame, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Counts per time window, rows later than the watermark dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return frames.withWatermark("ts", late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"))


def session_counts(frames: DataFrame, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts per session: rows less than `gap` apart. At least one key is needed."""
    return (
        frames.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def running_statistics(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and spread so far, updated with every micro-batch without revisiting data."""
    return frames.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
