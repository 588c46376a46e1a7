"""Mixing of sources to target weights by weighted fair queueing.

Each source is shuffled by a hash of the document id. A document's virtual finish time is the
number of words its source has sent up to and including it, divided by the source's target; a
second pass over the source goes on counting. All (document, pass) rows are sorted globally by
finish time and the order is cut where the total budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameweave.llm.columns import shielded
from frameweave.llm.ranges import running_total
from frameweave.plans.staging import materialise, small_side


_SPACES = " \t\n\v\f\r"


def word_count(text: str | Column) -> Column:
    """Number of maximal runs without space and \\t..\\r; null and empty texts have 0."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.btrim(text, F.lit(_SPACES))  # a text of spaces alone becomes empty
    marks = F.regexp_replace(bare, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], budget: float, most: float
) -> DataFrame:
    """source, source_no, source_size, target for a table (source, size).

    Sources in code-point order, null last, get `weights` in turn. They share `budget` times the
    total size by weight, but none more than `most` times its own size; the excess is shared again
    by weight. That is target = min(cap, weight * level) with one level for all: with sources
    sorted by cap / weight, the first k are at their cap where the level of the others fits.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    no = F.row_number().over(order) - 1
    per = per.withColumn("source_no", no)
    per = per.withColumns(
        {
            "w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)) + 1),
            "cap": F.col("source_size") * F.lit(float(most)),
        }
    )
    fill = Window.orderBy(F.col("cap") / F.col("w"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns(
        {
            "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "rest": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(every) * F.lit(float(budget)),
        }
    ).withColumn("level", (F.col("total") - F.col("spent")) / F.col("rest"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("level"), F.col("cap")))
    return per.select("source", "source_no", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2,
    seed: int = 7,
) -> DataFrame:
    """Adds source_size, target and taken to a table with columns doc_id, source and size.

    `taken` is the number of words the mix takes of the row, repeats counted: 0, its size, or up to
    ceil(`most`) times its size. The order depends on (seed, doc_id) only, so reruns agree. Rows
    with the same id, source and size are interchangeable; null ids sort as empty text; rows
    without words are never taken. An empty table gives no rows. Further columns are carried along,
    so keep them narrow; names that begin with `_` are reserved.
    """
    per = materialise(source_targets(docs.select("source", "size"), weights, budget, most))
    per = per.withColumnRenamed("source", "_source")
    rows = docs.join(small_side(per), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn(
        "_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    rows = running_total(rows, ["source_no"], ["_key", "doc_id", "size"], "size", "_sent")
    rows = materialise(rows.withColumnsRenamed({"_part": "_p", "_nth": "_n"}))
    passes = int(-(-most // 1))
    queue = (
        rows.where("size > 0")
        .select(
            "_p", "_n", "source_no", "_key", "doc_id", "size", "_sent", "source_size", "target",
            F.explode(F.array(*[F.lit(i) for i in range(passes)])).alias("_pass"),
        )
        .where(F.col("_pass") * F.col("source_size") < F.col("target"))
        .withColumn("_finish", (F.col("_pass") * F.col("source_size") + F.col("_sent")) / F.col("target"))
        .select("_p", "_n", "source_no", "_key", "doc_id", "size", "_pass", "_finish")
    )
    queue = running_total(queue, [], ["_finish", "source_no", "_pass", "_key", "doc_id", "size"], "size", "_total")
    limit = per.agg(F.floor(F.sum("source_size") * F.lit(float(budget)))).first()[0]  # one number
    taken = (
        queue.where(F.col("_total") <= F.lit(limit or 0))
        .groupBy("_p", "_n", "source_no")
        .agg(F.sum("size").alias("taken"))
    )
    return (
        rows.join(taken, ["_p", "_n", "source_no"], "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
        .select(*docs.columns, "source_size", "target", "taken")
    )


@shielded("doc_id", "source", "text")
def repeat_mixed(docs: DataFrame, **options) -> DataFrame:
    """`docs` (doc_id, source, text and more) with each row as often as the mix takes it.

    Only the numbers of a row go through the mix; its text is written once with a row number and
    joined back by it. Options go to `mix`. Rows without words are not taken.
    """
    rows = docs.withColumns({"_row": F.monotonically_increasing_id(), "_size": word_count("text")})
    rows = materialise(rows)  # fixes the row numbers
    narrow = rows.select("doc_id", "source", F.col("_size").alias("size"), F.col("_row").alias("row"))
    taken = mix(narrow, **options).where("taken > 0")
    taken = materialise(taken.select(F.col("row").alias("_row"), (F.col("taken") / F.col("size")).cast("int").alias("_times")))
    out = rows.join(small_side(taken), "_row")
    return out.withColumn("_pass", F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)
