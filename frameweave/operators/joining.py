"""Joins of predictions, annotations, captions, subtitles and question segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.functions.binding import let
from frameweave.plans.ordering import order_rows


def join_answers(annotations: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Annotations that have a prediction; the others are skipped."""
    return annotations.join(predictions, list(keys), "inner")


def with_default(
    left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, Column]
) -> DataFrame:
    """Left join whose missing right values get a default, such as FAILED."""
    joined = left.join(right, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def question_from_prompt(prompt: Column) -> Column:
    """Lower-cased question inside a prompt, NULL for a prompt of no known shape.

    Known shapes: OCR tokens with `Question: .. Short answer:`; three lines with a reference OCR
    line first or in the middle; two lines with the question first.
    """
    lines = F.split(prompt, "\n")
    tagged = F.regexp_extract(prompt, r"(?s)Question: (.*?) Short answer:", 1)
    hinted = prompt.contains("Reference OCR token: ") & (F.size(lines) == 3)
    at = F.when(prompt.startswith("Reference OCR token:"), F.lit(1)).otherwise(F.lit(0))
    return F.lower(
        F.when(prompt.startswith("OCR tokens: "), tagged)
        .when(hinted, F.get(lines, at))
        .when(F.size(lines) == 2, F.get(lines, 0))
    )


def combine_models(
    problems: DataFrame, first: DataFrame, second: DataFrame, key: str, answer: str, failed: str
) -> DataFrame:
    """Two prediction sets side by side: the first stands in where the second failed, and the
    upper bound counts a problem if either is right."""
    a = first.select(key, F.col(answer).alias("answer_a"))
    b = second.select(key, F.col(answer).alias("answer_b"))
    joined = problems.join(a, key).join(b, key)
    merged = F.when(F.col("answer_b") == failed, F.col("answer_a")).otherwise(F.col("answer_b"))
    return joined.withColumn("answer_merged", merged)


def combine_known(pred: DataFrame, truth: DataFrame, key: str, needed: Sequence[str]) -> DataFrame:
    """Inner join that first drops rows with a missing value on either side."""
    for c in needed:
        if c in pred.columns:
            pred = pred.where(F.col(c).isNotNull())
        if c in truth.columns:
            truth = truth.where(F.col(c).isNotNull())
    return pred.join(truth, key)


def entailed_accuracy(
    questions: DataFrame, key: Sequence[str], entailed: str, correct: str
) -> DataFrame:
    """For each correct question, the mean correctness of the questions it entails.

    `key` = (group, question id); `entailed` holds question ids of the same group.
    """
    group, qid = key
    asked = questions.where(F.col(correct)).select(
        group, F.col(qid).alias("source_id"), F.explode(entailed).alias(qid)
    )
    target = questions.select(group, qid, F.col(correct).cast("double").alias("_right"))
    return (
        asked.where(F.col(qid) != F.col("source_id"))
        .join(target, [group, qid])
        .groupBy(group, "source_id")
        .agg(F.avg("_right").alias("consistency"))
    )


def override_captions(
    samples: DataFrame,
    captions: DataFrame,
    keys: Sequence[str],
    original: str,
    replacement: str,
    out: str,
    long_form: bool = False,
) -> DataFrame:
    """Caption replaced by the re-caption of the same key, the original where there is none.

    `long_form` keeps both, as a short and a long description.
    """
    joined = samples.join(captions, list(keys), "left")
    new = F.col(replacement)
    if long_form:
        new = F.concat(
            F.lit("Short description: "), F.col(original), F.lit("\nLong description: "), F.col(replacement)
        )
    return joined.withColumn(out, F.coalesce(new, F.col(original))).drop(replacement)


def active_spans(
    points: DataFrame,
    spans: DataFrame,
    stream: str,
    point_id: str,
    time: str,
    start: str,
    end: str,
    order: str,
    text: str,
    width: int,
) -> DataFrame:
    """Text of the first span (by `order`) with `start < time < end`, for each point that has one.

    An equi join on (stream, time bucket of `width`) carries the range predicate, so no task sees
    all spans of a stream; a span is placed in each bucket it touches.
    """
    spread = spans.where(F.trim(text) != "").select(
        stream,
        F.col(start).alias("_start"),
        F.col(end).alias("_end"),
        F.struct(F.col(order).alias("ord"), F.col(text).alias("text")).alias("_span"),
        F.explode(
            F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
        ).alias("_bucket"),
    )
    at = points.withColumn("_bucket", F.floor(F.col(time) / width))
    hit = at.join(spread, [stream, "_bucket"]).where(
        (F.col("_start") < F.col(time)) & (F.col(time) < F.col("_end"))
    )
    return hit.groupBy(stream, point_id, time).agg(F.min("_span").alias("_s")).select(
        stream, point_id, time, F.col("_s.text").alias(text)
    )


def assign_segments(
    frames: DataFrame,
    questions: DataFrame,
    stream: str,
    frame_order: Sequence[str],
    time: str,
    question_id: str,
    group_rows: int | None = None,
) -> DataFrame:
    """Question whose segment `[previous question, question)` holds each frame.

    Both sides are merged into one order per stream and every frame takes the next question at or
    after it; a frame at the very time of a question belongs to the following segment. Frames
    after the last question get none.
    """
    extra = [c for c in frames.columns if c not in (stream, time)]
    left = frames.select(stream, time, *extra, F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_q"))
    right = questions.select(
        stream,
        time,
        *[F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in extra],
        F.lit(0).alias("_kind"),
        F.col(question_id).cast("long").alias("_q"),
    )
    more = {} if group_rows is None else {"group_rows": group_rows}
    rows = order_rows(
        left.unionByName(right), [stream], [time, "_kind", *frame_order, "_q"], seq="_seq", **more
    )
    out = rows.next_known(segment="_q").df
    return out.where(F.col("_kind") == 1).select(*frames.columns, "segment")


def uncovered(have: Column, wanted: Column) -> Column:
    """Items of `wanted` that `have` lacks, ignoring case; repeats are kept."""
    return let(
        F.array_distinct(F.transform(have, F.lower)),
        lambda known: F.filter(wanted, lambda x: ~F.array_contains(known, F.lower(x))),
    )


def compared_items(rows: DataFrame, key: str, ours: Column, theirs: Column) -> DataFrame:
    """(key, n_a, n_b, missed, invented): items of the arrays `ours` and `theirs` of a row, and those that only one has.

    `key` is unique. Rows partitioned by it stay where they are: items are counted by (key, item), which is
    linear in the arrays, and neither count needs a shuffle of its own.
    """

    def marked(items: Column, side: int) -> Column:
        items = F.coalesce(items, F.array().cast("array<string>"))
        return F.transform(items, lambda x: F.struct(F.lit(side).alias("b"), x.alias("w")))

    # An item that no array has keeps rows without any.
    start = F.array(F.struct(F.lit(0).alias("b"), F.lit(None).cast("string").alias("w")))
    items = rows.select(key, F.explode(F.concat(start, marked(ours, 0), marked(theirs, 1))).alias("_i")).select(key, F.col("_i.b").alias("_b"), F.col("_i.w").alias("_w"))
    seen = F.col("_w").isNotNull()
    counts = items.groupBy(key, "_w").agg(F.count_if(seen & (F.col("_b") == 0)).alias("_x"), F.count_if(seen & (F.col("_b") == 1)).alias("_y"))
    return counts.groupBy(key).agg(
        F.sum("_x").alias("n_a"),
        F.sum("_y").alias("n_b"),
        F.sum(F.when(F.col("_x") == 0, F.col("_y")).otherwise(0)).alias("missed"),
        F.sum(F.when(F.col("_y") == 0, F.col("_x")).otherwise(0)).alias("invented"),
    )


def shard_ranges(shards: DataFrame, order: Sequence[str], n: str) -> DataFrame:
    """Half-open row range `[lo, hi)` of every shard in catalog order."""
    rows = order_rows(shards, [], order).running(inclusive=False, lo=F.col(n)).df
    return rows.withColumn("hi", F.col("lo") + F.col(n))


def intersect_range(ranges: DataFrame, low: Column, high: Column) -> DataFrame:
    """Ranges cut to `[low, high)`; empty ones are dropped."""
    cut = ranges.withColumns({"lo": F.greatest("lo", low), "hi": F.least("hi", high)})
    return cut.where(F.col("lo") < F.col("hi"))


def worker_ranges(ranges: DataFrame, per_worker: Column) -> DataFrame:
    """Shard ranges cut at multiples of `per_worker`.

    A shard knows by arithmetic which workers it reaches, so no range join is needed.
    """
    spread = ranges.where("lo < hi").withColumn(
        "worker",
        F.explode(F.sequence(F.floor(F.col("lo") / per_worker), F.floor((F.col("hi") - 1) / per_worker))),
    )
    return intersect_range(spread, F.col("worker") * per_worker, (F.col("worker") + 1) * per_worker)


def strip_score_line(review: Column) -> Column:
    """Review text without its first line, which holds the scores."""
    return F.when(F.contains(review, F.lit("\n")), F.regexp_replace(review, r"^[^\n]*\n", "")).otherwise(
        review
    )
