"""Benchmark metrics as aggregations: one pass, combined on the map side, no per-group collection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameweave.functions.binding import let
from frameweave.functions.text import judge_prompt, judge_reply
from frameweave.plans.ordering import order_rows


def share(condition: Column) -> Column:
    """Mean of a condition; NULL counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def pair(key: str | Column, value: Column, names: tuple[str, str] = ("key", "value")) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(key.alias(names[0]), value.cast("string").alias(names[1]))


def judge_summary(df: DataFrame, pred: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Yes and no by substring, accuracy over both, mean whole score over all rows.

    A row whose score is not readable adds nothing to the sums but stays in the mean's divisor.
    """
    points = F.expr(f"try_cast(try_cast({score} AS double) AS int)")
    low = F.lower(pred)
    readable = points.isNotNull()
    yes = F.count_if(readable & low.contains("yes"))
    no = F.count_if(readable & ~low.contains("yes") & low.contains("no"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        yes.alias("yes"),
        no.alias("no"),
        ratio(yes, yes + no).alias("accuracy"),
        (F.coalesce(F.sum(points), F.lit(0)) / F.count(F.lit(1))).alias("avg_score"),
    )


def judge_predictions(
    predictions: DataFrame,
    done: DataFrame | None,
    keys: Sequence[str],
    judge: Callable[[Column], Column],
) -> DataFrame:
    """Verdicts for predictions (question, label, predict) that have none yet, beside the saved ones.

    `judge` is a column function from prompt to reply, such as an Arrow UDF around a model. Replies
    that cannot be read keep their reason in `reject`.
    """
    todo = predictions if done is None else predictions.join(done, list(keys), "left_anti")
    reply = judge(judge_prompt(F.col("question"), F.col("label"), F.col("predict")))
    # The reply is a column of its own, so the model is asked once per row.
    asked = todo.withColumn("_reply", reply).withColumn("_r", judge_reply(F.col("_reply")))
    new = asked.select(
        *predictions.columns,
        F.col("_r.pred").alias("llama_pred"),
        F.col("_r.score").alias("score"),
        F.col("_r.reject").alias("reject"),
    )
    return new if done is None else done.unionByName(new)


def class_summary(df: DataFrame, cls: str, score: str, pred: str) -> DataFrame:
    """Total and mean score and exact-`yes` accuracy per class."""
    return df.groupBy(cls).agg(
        F.sum(score).alias("total_score"),
        F.avg(score).alias("avg_score"),
        share(F.col(pred) == "yes").alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def valid_accuracy(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """-1 means no answer: accuracy over all rows and over answered rows."""
    valid = F.count_if(F.col(pred) != -1)
    right = F.count_if((F.col(pred) != -1) & (F.col(pred) == F.col(truth)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_total"),
        valid.alias("num_valids"),
        right.alias("num_corrects"),
        (right / F.count(F.lit(1))).alias("acc"),
        ratio(right, valid).alias("acc_valid"),
    )


def typed_rollup(
    df: DataFrame, kind: str, correct: Column, folded: dict[str, str] | None = None
) -> DataFrame:
    """Accuracy per type, per first letter of the type and overall, in percent.

    `folded` merges a type into another before counting.
    """
    t = F.col(kind)
    for old, new in (folded or {}).items():
        t = F.when(t == old, new).otherwise(t)
    typed = df.select(t.alias("type"), F.substring(t, 1, 1).alias("family"), correct.alias("_right"))
    return typed.rollup("family", "type").agg(
        F.count(F.lit(1)).alias("n"), (share(F.col("_right")) * 100).alias("acc")
    )


def grouping_accuracy(
    df: DataFrame, outer: str, inner: Sequence[str], answered: Column, correct: Column
) -> DataFrame:
    """Accuracy of answered questions for outer x each inner key, each inner key, outer, overall."""
    keys = [outer, *inner]
    sets = [[outer, i] for i in inner] + [[i] for i in inner] + [[outer], []]
    cols = [[F.col(c) for c in s] for s in sets]
    rows = df.select(*keys, answered.alias("_answered"), correct.alias("_right"))
    # Counted by all keys first, so that the grouping sets multiply a few sums and not the rows.
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_answered").alias("_told"),
        F.count_if(F.col("_answered") & F.col("_right")).alias("_good"),
    )
    right, told = F.sum("_good"), F.sum("_told")
    return sums.groupingSets(cols, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("level"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("questions"),
        F.coalesce(told, F.lit(0)).alias("answered"),
        F.coalesce(right, F.lit(0)).alias("right"),
        ratio(right, told).alias("acc"),
    )


def attribute_accuracy(
    df: DataFrame, attributes: Sequence[str], multi: Sequence[str], correct: Column
) -> DataFrame:
    """Accuracy for every value of every attribute; a `multi` attribute holds an array."""
    pairs = [F.array(*[pair(a, F.col(a)) for a in attributes])]
    for m in multi:
        name = F.lit(m)
        pairs.append(F.transform(F.array_distinct(m), lambda v: pair(name, v)))  # noqa: B023
    pairs = F.concat(*pairs)
    flat = df.select(correct.alias("_right"), F.inline(pairs))
    return flat.groupBy("key", "value").agg(
        F.count_if("_right").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.round(share(F.col("_right")) * 100, 2).alias("accuracy"),
    )


def domain_accuracy(df: DataFrame, domain: str, subject: str, correct: Column) -> DataFrame:
    """Subject, domain and overall accuracy, each weighted by its number of examples."""
    return (
        df.select(domain, subject, correct.alias("_right"))
        .rollup(domain, subject)
        .agg(F.count(F.lit(1)).alias("num"), F.round(share(F.col("_right")), 6).alias("acc"))
    )


def confusion(
    df: DataFrame, positive: Column, predicted: Column, by: Sequence[str] = (), other: Column | None = None
) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and yes-ratio.

    Rows with `other` (no readable answer) count as wrong in the accuracy and nowhere else.
    """
    told = ~other if other is not None else F.lit(True)
    rows = df.select(*by, positive.alias("_p"), predicted.alias("_y"), told.alias("_t"))
    p, y, t = F.col("_p"), F.col("_y"), F.col("_t")
    counts = rows.groupBy(*by).agg(
        F.count_if(t & y & p).alias("tp"),
        F.count_if(t & y & ~p).alias("fp"),
        F.count_if(t & ~y & ~p).alias("tn"),
        F.count_if(t & ~y & p).alias("fn"),
        F.count_if(~t).alias("other_num"),
        F.count(F.lit(1)).alias("n"),
    )
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    return counts.withColumns(
        {
            "accuracy": (tp + tn) / n,
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "yes_ratio": (tp + fp) / n,
        }
    )


def paired_accuracy(
    df: DataFrame,
    task: str,
    order: Sequence[str],
    correct: Column,
    other: Column,
    group_rows: int | None = None,
) -> DataFrame:
    """`acc`, `acc_plus` (both questions of an item right), count of other answers, task score.

    Items are the consecutive pairs of each task in `order`.
    """
    more = {} if group_rows is None else {"group_rows": group_rows}
    rows = df.select(task, *order, correct.alias("_right"), other.alias("_other"))
    rows = order_rows(rows, [task], order, **more).df
    items = rows.groupBy(task, F.floor(F.col("seq") / 2).alias("_item")).agg(
        F.count(F.lit(1)).alias("_q"),
        F.count_if("_right").alias("_hits"),
        F.count_if("_other").alias("_others"),
    )
    out = items.groupBy(task).agg(
        F.sum("_q").alias("questions"),
        (F.sum("_hits") / F.sum("_q")).alias("acc"),
        share((F.col("_hits") == F.col("_q"))).alias("acc_plus"),
        F.sum("_others").alias("other_num"),
    )
    return out.withColumn("score", 100 * (F.col("acc") + F.col("acc_plus")))


def question_metrics(
    df: DataFrame,
    correct: Column,
    structural: str,
    semantic: str,
    steps: Column,
    n_words: Column,
    predicted: str,
    valid: str,
    plausible: str,
) -> DataFrame:
    """Accuracy overall, binary and open, per type, steps and words; validity and plausibility."""
    named = ("metric", "value")
    rows = df.select(
        F.when(correct, 1.0).otherwise(0.0).alias("_right"),
        F.array_contains(valid, F.col(predicted)).alias("_valid"),
        F.array_contains(plausible, F.col(predicted)).alias("_plausible"),
        F.array(
            pair("accuracy", F.lit(""), named),
            pair(F.when(F.col(structural) == "query", "open").otherwise("binary"), F.lit(""), named),
            pair("structural", F.col(structural), named),
            pair("semantic", F.col(semantic), named),
            pair("steps", steps, named),
            pair("words", n_words, named),
        ).alias("_keys"),
    )
    scores = (
        rows.select("_right", F.inline("_keys"))
        .groupBy("metric", "value")
        .agg(F.avg("_right").alias("score"), F.count(F.lit(1)).alias("n"))
    )
    checks = rows.agg(
        share(F.col("_valid")).alias("validity"),
        share(F.col("_plausible")).alias("plausibility"),
        F.count(F.lit(1)).alias("n"),
    )
    checks = checks.unpivot("n", ["validity", "plausibility"], "metric", "score").withColumn(
        "value", F.lit("")
    )
    return scores.unionByName(checks)


def distribution_score(df: DataFrame, group: str, gold: str, predicted: str) -> DataFrame:
    """Chi-square of predicted against gold answer counts per group, weighted by group size, / 100."""
    g = df.groupBy(group, F.col(gold).alias("_a")).agg(F.count(F.lit(1)).alias("_e"))
    p = df.groupBy(group, F.col(predicted).alias("_a")).agg(F.count(F.lit(1)).alias("_o"))
    per = (
        g.join(p, [group, "_a"], "left")
        .withColumn("_o", F.coalesce("_o", F.lit(0)))
        .groupBy(group)
        .agg(F.sum(F.pow(F.col("_o") - F.col("_e"), 2) / F.col("_e")).alias("_s"), F.sum("_e").alias("_w"))
    )
    return per.agg(
        (F.sum(F.col("_s") * F.col("_w")) / F.sum("_w") / 100).alias("distribution"),
        F.count(F.lit(1)).alias("groups"),
    )


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0))


def grounding_score(
    maps: DataFrame, regions: DataFrame, key: str, attention: str, side: int
) -> DataFrame:
    """Sum over regions and grid cells of attention x share of the cell inside the region.

    `attention` is a `side` x `side` array per question; regions are boxes x0, y0, x1, y1 in 0..1.
    """
    edge = 1.0 / side
    cells = maps.select(key, F.posexplode(attention).alias("_i", "_row")).select(
        key, "_i", F.posexplode("_row").alias("_j", "_att")
    )
    joined = cells.join(regions, key)
    x0, y0 = F.col("_i") * edge, F.col("_j") * edge
    wide = overlap(x0, x0 + edge, F.col("x0"), F.col("x1"))
    high = overlap(y0, y0 + edge, F.col("y0"), F.col("y1"))
    return joined.groupBy(key).agg(
        F.sum(F.col("_att") * wide * high / (edge * edge)).alias("grounding")
    )


def box_iou(pred: Column, gold: Column) -> Column:
    """IoU of a corner box and an (x, y, width, height) box, counting border pixels as inside."""
    p = [F.get(pred, i) for i in range(4)]
    g = [F.get(gold, 0), F.get(gold, 1), F.get(gold, 0) + F.get(gold, 2), F.get(gold, 1) + F.get(gold, 3)]
    wide = F.least(p[2], g[2]) - F.greatest(p[0], g[0]) + 1
    high = F.least(p[3], g[3]) - F.greatest(p[1], g[1]) + 1
    inner = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    area_p = (p[2] - p[0] + 1) * (p[3] - p[1] + 1)
    area_g = (g[2] - g[0] + 1) * (g[3] - g[1] + 1)
    return inner / (area_p + area_g - inner)


def detection_accuracy(
    annotations: DataFrame, predictions: DataFrame, key: str, pred: str, gold: str, bar: float = 0.5
) -> DataFrame:
    """Share of annotations whose prediction reaches IoU `bar`; no prediction is a miss."""
    joined = annotations.join(predictions, key, "left")
    iou = box_iou(F.col(pred), F.col(gold))
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(iou >= bar).alias("hits"),
        share(iou >= bar).alias("accuracy"),
    )


def hallucination_rates(
    df: DataFrame, caption: str, said: str, invented: str, by: Sequence[str] = ()
) -> DataFrame:
    """Share of captions with an invented object, share of invented objects, mean lengths."""
    n_said, n_bad = F.size(said), F.size(F.filter(F.col(invented), lambda x: x != ""))
    return hallucination_counts(df, F.size(F.split(F.trim(caption), " ")), n_said, n_bad, by)


def hallucination_counts(df: DataFrame, length: Column, said: Column, invented: Column, by: Sequence[str] = ()) -> DataFrame:
    """The same from the numbers of words, of objects and of invented ones of each caption."""
    rows = df.select(*by, said.alias("_said"), invented.alias("_bad"), length.alias("_len"))
    return rows.groupBy(*by).agg(
        share(F.col("_bad") > 0).alias("chair_s"),
        ratio(F.sum("_bad"), F.sum("_said")).alias("chair_i"),
        F.avg("_len").alias("sentence_len"),
        F.avg("_said").alias("avg_objects"),
    )


JUDGE_LINE = r"(\d+)\.(.+) - (yes|no|maybe),(.+)"  # fixed pattern of one verdict line


def judged_lines(replies: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered verdicts of a reply: question number from 0 and yes, no or maybe."""
    found = F.regexp_extract_all(F.lower(text), F.lit(JUDGE_LINE), F.lit(0))
    line = replies.select(key, F.explode(found).alias("_line"))
    return line.select(
        key,
        (F.regexp_extract("_line", JUDGE_LINE, 1).cast("long") - 1).alias("question"),
        F.regexp_extract("_line", JUDGE_LINE, 3).alias("verdict"),
    )


def coverage_by_category(verdicts: DataFrame, questions: DataFrame, key: str, category: str) -> DataFrame:
    """Share of yes and maybe per category and overall, and its complement."""
    joined = verdicts.join(questions, [key, "question"])
    rate = F.round(100 * share(F.col("verdict").isin("yes", "maybe")), 2)
    return (
        joined.rollup(category)
        .agg(F.count(F.lit(1)).alias("n"), rate.alias("coverage"))
        .withColumn("hallucination", F.round(100 - F.col("coverage"), 2))
    )


def capability_scores(df: DataFrame, capability: str, scores: str, runs: int) -> DataFrame:
    """Score per capability, per exact capability set and in total: mean over runs, in percent.

    The spread of the total over runs is its population standard deviation.
    """
    named = ("level", "name")
    single = F.transform(F.array_distinct(capability), lambda c: pair("capability", c, named))
    combined = F.array(
        pair("set", F.array_join(F.array_sort(F.array_distinct(capability)), "_"), named),
        pair("total", F.lit("total"), named),
    )
    flat = df.select(F.col(scores).alias("_s"), F.inline(F.concat(single, combined)))
    sums = [F.sum(F.get("_s", r)).alias(f"_r{r}") for r in range(runs)]
    per = flat.groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"), *sums)
    pct = F.transform(F.array(*[F.col(f"_r{r}") for r in range(runs)]), lambda s: s / F.col("n") * 100)
    mean = F.aggregate(pct, F.lit(0.0), lambda a, x: a + x) / runs
    spread = let(
        mean,
        lambda m: F.sqrt(F.aggregate(pct, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / runs),
    )
    return per.select(
        "level",
        "name",
        "n",
        F.round(mean, 4).alias("score"),
        F.when(F.col("level") == "total", F.round(spread, 4)).alias("std"),
    )


def score_pair(review: Column) -> Column:
    """Two numbers on the first line of a review; -1, -1 if there are not exactly two."""
    line = F.split_part(review, F.lit("\n"), F.lit(1))
    parts = F.filter(F.split(F.replace(line, F.lit(","), F.lit(" ")), " "), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    good = (F.size(parts) == 2) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(good, numbers).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def review_summary(df: DataFrame, pair: str, category: str) -> DataFrame:
    """Mean pair per category and overall: ratio in percent and both means times ten."""
    a, b = F.avg(F.get(pair, 0)), F.avg(F.get(pair, 1))
    return df.rollup(category).agg(
        F.round(ratio(F.round(b, 3), F.round(a, 3)) * 100, 1).alias("relative"),
        F.round(F.round(a, 3) * 10, 1).alias("first"),
        F.round(F.round(b, 3) * 10, 1).alias("second"),
        F.count(F.lit(1)).alias("n"),
    )


def least_loss(losses: Column) -> Column:
    """Index of the smallest loss, the first on a tie."""
    return (F.array_position(losses, F.array_min(losses)) - 1).cast("long")


def type_accuracy(df: DataFrame, kind: str, correct: Column) -> DataFrame:
    """Accuracy per type, 0 for a type with nothing right."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), (100 * share(correct)).alias("acc"))


def score_grid(df: DataFrame, row: str, column: str, values: Sequence, score: str) -> DataFrame:
    """Mean score pivoted to one column per known value, so no extra job lists the values."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(score))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and share per class."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def text_statistics(df: DataFrame, by: str, text: str) -> DataFrame:
    """Token totals and means by class."""
    tokens = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return df.groupBy(by).agg(
        F.sum(tokens).alias("tokens"), F.avg(tokens).alias("avg_tokens"), F.count(F.lit(1)).alias("n")
    )


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per half-open bin `[edge, next edge)`; the last bin is open."""
    at = F.lit(-1)
    for i, edge in enumerate(edges):
        at = F.when(F.col(value) >= edge, F.lit(i)).otherwise(at)
    return df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def chance_accuracy(df: DataFrame, task: str, options: str) -> DataFrame:
    """Accuracy of guessing: number of questions over the number of options, in percent."""
    return df.groupBy(task).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size(options)).alias("n_options"),
        (100 * F.count(F.lit(1)) / F.sum(F.size(options))).alias("chance"),
    )


def running_moments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, batch: int
) -> DataFrame:
    """Mean and spread after each batch of `batch` rows, merged from per-batch sums.

    Values are centred on the overall mean first, which keeps the sums of squares accurate.
    """
    rows = order_rows(df.select(*keys, *order, value), keys, order).df
    centre = df.agg(F.avg(value)).first()[0] or 0.0
    x = F.col(value) - F.lit(centre)
    per = rows.groupBy(*keys, F.floor(F.col("seq") / batch).alias("batch")).agg(
        F.count(value).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q")
    )
    run = order_rows(per, keys, ["batch"]).running(count=F.col("_n"), s=F.col("_s"), q=F.col("_q")).df
    mean = F.col("s") / F.col("count")
    var = F.greatest(F.col("q") / F.col("count") - mean * mean, F.lit(0.0))
    return run.select(
        *keys,
        "batch",
        "count",
        (mean + centre).alias("mean"),
        var.alias("var"),
        F.when(F.col("count") > 1, F.sqrt(var * F.col("count") / (F.col("count") - 1))).alias("std"),
    )


def masked_moments(df: DataFrame, value: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and variance of the rows whose mask is 1, in one pass."""
    x = F.when(F.col(mask) == 1, F.col(value))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))
