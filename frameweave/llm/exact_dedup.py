"""Exact duplicate removal behind two Bloom filters; built-in functions only.

Pass 1 hashes each text to one position of a bit array of fixed size and keeps the positions that
are hit more than once. Pass 2 does the same with an independent hash for the texts that pass 1
could not clear. A text that shares its position with no other in either pass cannot have a copy,
so its row goes straight through; only the remaining rows are shuffled and compared by content.

The bit arrays are tables of 4 KiB bitmaps. Their total size is set by `max_bits`, not by the
data, which bounds the broadcast. With many more texts than bits the filters fill up, more rows
are shuffled, and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.llm.columns import shielded
from frameweave.plans.staging import materialise

#: Bits of one filter at most: 32 MiB, the most that is broadcast.
MAX_BITS = 1 << 28
#: Bits per text while the filter is below that size.
BITS_PER_TEXT = 32
_BITMAP = 32768  # bits that bitmap_construct_agg puts into one value


def digest(text: str | Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    bits = _BITMAP
    while bits < BITS_PER_TEXT * rows and bits < max_bits:
        bits *= 2
    return bits


def repeated_positions(df: DataFrame, key: str, salt: int, bits: int) -> DataFrame:
    """Filter table (block, bits): positions that more than one row of `df` falls on."""
    spots = df.groupBy(_spot(key, salt, bits).alias("spot")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block = F.floor(F.col("spot") / _BITMAP).cast("int").alias(f"_block{salt}")
    return spots.groupBy(block).agg(F.bitmap_construct_agg(F.col("spot") % _BITMAP).alias(f"_bits{salt}"))


def _spot(key: str, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(bits))


def in_filter(df: DataFrame, filt: DataFrame, key: str, salt: int, bits: int, out: str) -> DataFrame:
    """Adds boolean `out`: true if the row's position is set in the (broadcast) filter."""
    spot = _spot(key, salt, bits)
    joined = df.withColumn("_spot", spot).withColumn(
        f"_block{salt}", F.floor(F.col("_spot") / _BITMAP).cast("int")
    ).join(F.broadcast(filt), f"_block{salt}", "left")
    at = F.col("_spot") % _BITMAP
    byte = F.expr(f"substring(_bits{salt}, cast(_spot % {_BITMAP} div 8 as int) + 1, 1)")
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
    return joined.withColumn(out, F.coalesce(is_set, F.lit(False))).drop("_spot", f"_block{salt}", f"_bits{salt}")


def mark_suspects(df: DataFrame, key: str, rows: int, out: str = "_maybe", max_bits: int = MAX_BITS) -> DataFrame:
    """Adds boolean `out`: false only where no other row has the same `key`."""
    return apply_filters(df, build_filters(df, key, rows, max_bits), key, out)


def build_filters(df: DataFrame, key: str, rows: int, max_bits: int = MAX_BITS):
    """The two filters over `key` and their size; both are written out, as they are used twice."""
    bits = filter_bits(rows, max_bits)
    first = materialise(repeated_positions(df, key, 1, bits))
    open_rows = in_filter(df, first, key, 1, bits, "_maybe1").where("_maybe1")
    second = materialise(repeated_positions(open_rows, key, 2, bits))
    return first, second, bits


def apply_filters(df: DataFrame, filters, key: str, out: str = "_maybe") -> DataFrame:
    first, second, bits = filters
    df = in_filter(df, first, key, 1, bits, "_maybe1")
    df = in_filter(df, second, key, 2, bits, "_maybe2")
    return df.withColumn(out, F.col("_maybe1") & F.col("_maybe2")).drop("_maybe1", "_maybe2")


def copy_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The largest id of a group stays.
    A null id counts as smaller than any other and stays only if the group has no other id.
    Repeated rows (same id and text) are one document: each is reported, all with the same `kept`.
    An empty table gives no rows; other columns are not read.
    """
    keys = materialise(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256")))
    marked = mark_suspects(keys, "text_sha256", keys.count(), max_bits=max_bits)
    alone = marked.where(~F.col("_maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    suspects = marked.where("_maybe").drop("_maybe")
    # Written out: otherwise the join would share the partitioning of the aggregation, and a large
    # group of copies could not be split over tasks.
    groups = materialise(
        suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    resolved = suspects.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(resolved)


@shielded("doc_id", "text")
def drop_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with one row per distinct text, the one of the largest id; same columns.

    Rows that both filters clear are passed on without a shuffle. Of repeated rows with the
    same id and text exactly one stays.
    """
    marked_docs = docs.withColumn("_sha", digest(F.col("text")))
    keys = materialise(marked_docs.select(F.col("doc_id").alias("_id"), "_sha"))
    filters = build_filters(keys, "_sha", keys.count(), max_bits)
    marked = apply_filters(marked_docs, filters, "_sha")
    alone = marked.where(~F.col("_maybe")).select(*docs.columns)
    groups = apply_filters(keys, filters, "_sha").where("_maybe").groupBy("_sha").agg(F.max("_id").alias("_keep"))
    groups = groups.withColumnRenamed("_sha", "_key")
    suspects = marked.where("_maybe")
    on = (F.col("_sha") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_keep"))
    kept = suspects.join(groups, on).dropDuplicates(["_sha"]).select(*docs.columns)
    return alone.unionByName(kept)
