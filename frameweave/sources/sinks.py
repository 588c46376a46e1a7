"""Merging and resuming outputs, inventory and quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_keep_saved(saved: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Saved rows win; new rows are added only for keys not saved yet."""
    return saved.unionByName(new.join(saved.select(*keys), list(keys), "left_anti"))


def write_keep_saved(new: DataFrame, keys: Sequence[str], path: str, previous: str | None) -> None:
    """Resumable sink: write the merge of `previous` and `new` to the fresh folder `path`."""
    if previous:
        saved = new.sparkSession.read.parquet(previous)
        new = merge_keep_saved(saved, new, keys)
    new.write.mode("errorifexists").parquet(path)


def concat_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Plain concatenation of chunk outputs, tagged with the chunk number."""
    tagged = [c.withColumn("chunk", F.lit(i)) for i, c in enumerate(chunks)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_chunks(chunks: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Later chunk wins per key; inside one chunk the row last in `order` wins.

    `max_by` combines on the map side, so a key repeated in many chunks stays cheap.
    """
    rows = concat_chunks(chunks)
    values = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*values), F.struct("chunk", order))
    return rows.groupBy(*keys).agg(best.alias("_v")).select(*keys, "_v.*")


def missing_media(
    referenced: DataFrame, inventory: DataFrame, stem: str, path: str, extensions: Sequence[str]
) -> DataFrame:
    """References for which no file `<stem>.<ext>` with an accepted extension is listed."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    present = (
        inventory.select(
            F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias(stem),
            F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("_ext"),
        )
        .where(F.col("_ext").isin(*extensions))
        .select(stem)
    )
    return referenced.join(present, stem, "left_anti")


def quarantine(df: DataFrame, rules: dict[str, Column], reason: str = "reason") -> DataFrame:
    """Name of the first rule a row breaks, NULL for good rows. Nothing is deleted."""
    verdict = F.lit(None).cast("string")
    for name, broken in reversed(list(rules.items())):
        verdict = F.when(broken, F.lit(name)).otherwise(verdict)
    return df.withColumn(reason, verdict)
