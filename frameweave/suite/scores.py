"""Metric queries. Predictions and answers are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameweave.functions import text as X
from frameweave.operators import scoring as M
from frameweave.plans.ordering import order_rows
from frameweave.suite.joins import PARTNERS_SQL, compared_words
from frameweave.suite.registry import query


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


JUDGED_SQL = """
WITH j AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'Yes, it matches' WHEN toxic = 1 THEN 'No' ELSE 'unsure' END AS pred,
                  CASE WHEN n_chars % 11 = 0 THEN 'n/a' ELSE (n_chars % 6)::VARCHAR END AS score
           FROM documents JOIN labels USING (doc_id))
"""


def _judged(t):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        "lang",
        F.when(F.col("quality") == 1, "Yes, it matches").when(F.col("toxic") == 1, "No").otherwise("unsure").alias("pred"),
        F.when(F.col("n_chars") % 11 == 0, "n/a").otherwise((F.col("n_chars") % 6).cast("string")).alias("score"),
    )


@query(
    "judge_summary_a1",
    JUDGED_SQL
    + """, s AS (SELECT *, try_cast(score AS INT) AS p FROM j),
       c AS (SELECT count(*) AS n, count(CASE WHEN p IS NOT NULL AND pred LIKE 'Yes%' THEN 1 END) AS yes,
                    count(CASE WHEN p IS NOT NULL AND pred = 'No' THEN 1 END) AS no, sum(p)::DOUBLE AS s FROM s)
       SELECT n, yes, no, round(yes / (yes + no), 6) AS accuracy, round(s / n, 6) AS avg_score FROM c""",
)
def judge_summary(t):
    return r6(M.judge_summary(_judged(t), "pred", "score"), "accuracy", "avg_score")


@query(
    "class_summary_a2",
    """SELECT lang, sum(n_chars % 6)::BIGINT AS total_score, round(avg(n_chars % 6), 6) AS avg_score,
              round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n
       FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def class_summary(t):
    rows = t.documents.join(t.labels, "doc_id").select(
        "lang", (F.col("n_chars") % 6).alias("score"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("pred")
    )
    return r6(M.class_summary(rows, "lang", "score", "pred"), "avg_score", "accuracy")


@query(
    "valid_accuracy_a3",
    """WITH p AS (SELECT quality AS truth, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 1 - toxic END AS pred FROM labels),
            c AS (SELECT count(*) AS num_total, count(CASE WHEN pred <> -1 THEN 1 END) AS num_valids,
                  count(CASE WHEN pred <> -1 AND pred = truth THEN 1 END) AS num_corrects FROM p)
       SELECT *, round(num_corrects / num_total, 6) AS acc, round(num_corrects / num_valids, 6) AS acc_valid FROM c""",
)
def valid_accuracy(t):
    rows = t.labels.select(
        F.col("quality").alias("truth"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(1 - F.col("toxic")).alias("pred")
    )
    return r6(M.valid_accuracy(rows, "truth", "pred"), "acc", "acc_valid")


@query(
    "type_rollup_a4",
    """WITH t AS (SELECT CASE event_type WHEN 'view' THEN 'TN' WHEN 'click' THEN 'TP' WHEN 'error' THEN 'CW'
                           WHEN 'signup' THEN 'CH' ELSE 'DL' END AS k, value > 20 AS ok FROM events),
            f AS (SELECT CASE WHEN k = 'TP' THEN 'TN' ELSE k END AS type, ok FROM t)
       SELECT substr(type, 1, 1) AS family, type, count(*) AS n,
              round(avg(CASE WHEN ok THEN 100.0 ELSE 0 END), 6) AS acc
       FROM f GROUP BY ROLLUP (family, type)""",
)
def type_rollup(t):
    kinds = {"view": "TN", "click": "TP", "error": "CW", "signup": "CH"}
    kind = F.coalesce(F.try_element_at(X.literal_map(kinds), F.col("event_type")), F.lit("DL"))
    rows = t.events.select(kind.alias("kind"), (F.col("value") > 20).alias("ok"))
    return r6(M.typed_rollup(rows, "kind", F.col("ok"), {"TP": "TN"}), "acc")


@query(
    "grouping_accuracy_a5",
    """WITH q AS (SELECT o_orderstatus AS duration, l_returnflag AS task, o_orderpriority AS category, l_linestatus AS sub,
                    CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE chr(65 + (l_linenumber % 4)::INT) END AS pred,
                    chr(65 + (l_suppkey % 4)::INT) AS answer
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       SELECT duration, task, category, sub, grouping(duration, task, category, sub)::BIGINT AS level, count(*) AS questions,
              count(CASE WHEN pred <> '' THEN 1 END) AS answered, count(CASE WHEN pred <> '' AND pred = answer THEN 1 END) AS "right",
              round(count(CASE WHEN pred <> '' AND pred = answer THEN 1 END) / count(CASE WHEN pred <> '' THEN 1 END), 6) AS acc
       FROM q GROUP BY GROUPING SETS ((duration, task), (duration, category), (duration, sub),
                                      (task), (category), (sub), (duration), ())""",
)
def grouping_accuracy(t):
    response = F.when(F.col("l_linenumber") % 5 == 0, "none of these").otherwise(
        F.concat(F.lit("The answer is "), F.char(65 + F.col("l_linenumber") % 4), F.lit("."))
    )
    rows = (
        t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
        .join(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderstatus").alias("duration"),
            F.col("l_returnflag").alias("task"),
            F.col("o_orderpriority").alias("category"),
            F.col("l_linestatus").alias("sub"),
            X.choice_letter(response).alias("pred"),
            F.char(65 + F.col("l_suppkey") % 4).alias("answer"),
        )
    )
    pred = F.col("pred")
    out = M.grouping_accuracy(rows, "duration", ["task", "category", "sub"], pred != "", pred == F.col("answer"))
    return r6(out, "acc")


@query(
    "attribute_accuracy_a6",
    """WITH b AS (SELECT lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size,
                    quality = 1 AS ok, CASE WHEN toxic = 1 THEN ['count', 'read', 'count'] ELSE ['read'] END AS skills
                  FROM documents JOIN labels USING (doc_id)),
            u AS (SELECT ok, 'lang' AS key, lang AS value FROM b UNION ALL SELECT ok, 'source', source FROM b
                  UNION ALL SELECT ok, 'size', size FROM b
                  UNION ALL SELECT ok, 'skills', unnest(list_distinct(skills)) FROM b)
       SELECT key, value, count(CASE WHEN ok THEN 1 END) AS correct, count(*) AS total,
              round(avg(CASE WHEN ok THEN 100.0 ELSE 0 END), 2) AS accuracy FROM u GROUP BY ALL""",
)
def attribute_accuracy(t):
    skills = F.when(F.col("toxic") == 1, F.array(F.lit("count"), F.lit("read"), F.lit("count"))).otherwise(
        F.array(F.lit("read"))
    )
    rows = t.documents.join(t.labels, "doc_id").select(
        "lang",
        "source",
        F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("size"),
        skills.alias("skills"),
        (F.col("quality") == 1).alias("ok"),
    )
    return M.attribute_accuracy(rows, ["lang", "source", "size"], ["skills"], F.col("ok"))


@query(
    "domain_accuracy_a7",
    """SELECT r_name AS domain, n_name AS subject, count(*) AS num,
              round(avg(CASE WHEN c_acctbal > 4000 THEN 1.0 ELSE 0 END), 6) AS acc
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY ROLLUP (r_name, n_name)""",
)
def domain_accuracy(t):
    subjects = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(subjects, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("domain"), F.col("n_name").alias("subject"), (F.col("c_acctbal") > 4000).alias("ok")
    )
    return M.domain_accuracy(rows, "domain", "subject", F.col("ok"))


CONFUSION_SQL = """
SELECT *, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS "precision",
       round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
       round((tp + fp) / n, 6) AS yes_ratio
FROM (SELECT {by} count(CASE WHEN told AND y AND p THEN 1 END) AS tp, count(CASE WHEN told AND y AND NOT p THEN 1 END) AS fp,
      count(CASE WHEN told AND NOT y AND NOT p THEN 1 END) AS tn, count(CASE WHEN told AND NOT y AND p THEN 1 END) AS fn,
      count(CASE WHEN NOT told THEN 1 END) AS other_num, count(*) AS n FROM b {group})
"""
RATES = ("accuracy", "precision", "recall", "f1", "yes_ratio")


@query(
    "confusion_by_category_a8",
    "WITH b AS (SELECT lang, quality = 1 AS p, NOT (toxic = 1 OR n_chars < 400) AS y, true AS told "
    "FROM documents JOIN labels USING (doc_id)) " + CONFUSION_SQL.format(by="lang,", group="GROUP BY lang"),
)
def confusion_by_category(t):
    reply = F.when((F.col("toxic") == 1) | (F.col("n_chars") < 400), "No, there is not. Yes").otherwise("It is, surely.")
    rows = t.documents.join(t.labels, "doc_id").select(
        "lang", (F.col("quality") == 1).alias("p"), (X.yes_no_sentence(reply) == "yes").alias("y")
    )
    return r6(M.confusion(rows, F.col("p"), F.col("y"), ["lang"]), *RATES)


@query(
    "paired_accuracy_a9",
    """WITH b AS (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 2 AS item,
                    quality = 1 - toxic AND doc_id % 9 <> 0 AS ok, doc_id % 9 = 0 AS other
                  FROM documents JOIN labels USING (doc_id)),
            i AS (SELECT lang, item, count(*) AS q, count(CASE WHEN ok THEN 1 END) AS h, count(CASE WHEN other THEN 1 END) AS o
                  FROM b GROUP BY ALL)
       SELECT lang, sum(q)::BIGINT AS questions, round(sum(h) / sum(q), 6) AS acc,
              round(avg(CASE WHEN h = q THEN 1.0 ELSE 0 END), 6) AS acc_plus, sum(o)::BIGINT AS other_num,
              round(100 * (sum(h) / sum(q) + avg(CASE WHEN h = q THEN 1.0 ELSE 0 END)), 6) AS score
       FROM i GROUP BY lang""",
)
def paired_accuracy(t):
    reply = F.when(F.col("doc_id") % 9 == 0, "maybe").when(F.col("toxic") == 1, "no").otherwise("yes, it is")
    rows = t.documents.join(t.labels, "doc_id").select(
        "lang",
        "doc_id",
        X.yes_no_prefix(reply).alias("pred"),
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("gold"),
    )
    pred = F.col("pred")
    out = M.paired_accuracy(rows, "lang", ["doc_id"], pred == F.col("gold"), pred == "other")
    return r6(out, "acc", "acc_plus", "score")


@query(
    "question_metrics_a10",
    """WITH q AS (SELECT role, turn, length(text) AS n, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words,
                    CASE WHEN turn % 2 = 0 THEN 'query' ELSE 'verify' END AS structural,
                    chr(97 + (length(text) % 3)::INT) AS pred FROM conversations),
            b AS (SELECT *, CASE WHEN pred = chr(97 + (turn % 3)::INT) THEN 1.0 ELSE 0 END AS s,
                    pred IN ('a', 'b') AS valid, pred = 'a' AND role <> 'system' AS plausible FROM q),
            u AS (SELECT 'accuracy' AS metric, '' AS value, s FROM b
                  UNION ALL SELECT CASE WHEN structural = 'query' THEN 'open' ELSE 'binary' END, '', s FROM b
                  UNION ALL SELECT 'structural', structural, s FROM b UNION ALL SELECT 'semantic', role, s FROM b
                  UNION ALL SELECT 'steps', (turn % 4)::VARCHAR, s FROM b UNION ALL SELECT 'words', words::VARCHAR, s FROM b
                  UNION ALL SELECT 'validity', '', CASE WHEN valid THEN 1.0 ELSE 0 END FROM b
                  UNION ALL SELECT 'plausibility', '', CASE WHEN plausible THEN 1.0 ELSE 0 END FROM b)
       SELECT metric, value, round(avg(s), 6) AS score, count(*) AS n FROM u GROUP BY ALL""",
)
def question_metrics(t):
    steps = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("turn") % 4),
        lambda i: F.when(i == 0, "exist: ?").otherwise(F.concat(F.lit("filter: "), i.cast("string"))),
    )
    rows = t.conversations.select(
        "role",
        "turn",
        F.when(F.col("turn") % 2 == 0, "query").otherwise("verify").alias("structural"),
        F.char(97 + F.length("text") % 3).alias("pred"),
        F.char(97 + F.col("turn") % 3).alias("gold"),
        F.array(F.lit("a"), F.lit("b")).alias("valid"),
        F.when(F.col("role") != "system", F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("plausible"),
        X.reasoning_steps(steps).alias("steps"),
        X.word_count(F.col("text")).alias("words"),
    )
    out = M.question_metrics(
        rows, F.col("pred") == F.col("gold"), "structural", "role", F.col("steps"), F.col("words"), "pred", "valid", "plausible"
    )
    return r6(out, "score")


@query(
    "distribution_score_a11",
    """WITH b AS (SELECT date_trunc('day', ts) AS day, event_type AS gold,
                    CASE WHEN value > 60 THEN 'view' WHEN value > 30 THEN 'click' ELSE event_type END AS pred FROM events),
            g AS (SELECT day, gold AS a, count(*) AS e FROM b GROUP BY ALL),
            p AS (SELECT day, pred AS a, count(*) AS o FROM b GROUP BY ALL),
            s AS (SELECT g.day, sum(pow(coalesce(o, 0) - e, 2) / e) AS s, sum(e) AS w FROM g LEFT JOIN p USING (day, a) GROUP BY g.day)
       SELECT round(sum(s * w) / sum(w) / 100, 6) AS distribution, count(*) AS groups FROM s""",
)
def distribution_score(t):
    value = F.col("value")
    rows = t.events.select(
        F.date_trunc("day", "ts").alias("day"),
        F.col("event_type").alias("gold"),
        F.when(value > 60, "view").when(value > 30, "click").otherwise(F.col("event_type")).alias("pred"),
    )
    return r6(M.distribution_score(rows, "day", "gold", "pred"), "distribution")


@query(
    "grounding_a12",
    """WITH c AS (SELECT vec_id, k - 1 AS k, embedding[k]::DOUBLE AS a FROM embeddings, range(1, 65) r(k)),
            b AS (SELECT vec_id, label * 0.05 AS x0, label * 0.03 AS y0, label * 0.05 + 0.4 AS x1, label * 0.03 + 0.3 AS y1 FROM embeddings
                  UNION ALL SELECT vec_id, 0, 0, 1, 1 FROM embeddings WHERE label % 2 = 0),
            o AS (SELECT vec_id, a, greatest(least((k // 8 + 1) * 0.125, x1) - greatest((k // 8) * 0.125, x0), 0) AS w,
                    greatest(least((k % 8 + 1) * 0.125, y1) - greatest((k % 8) * 0.125, y0), 0) AS h FROM c JOIN b USING (vec_id))
       SELECT vec_id, round(sum(a * w * h * 64), 6) AS grounding FROM o GROUP BY vec_id""",
)
def grounding(t):
    e = t.embeddings
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8).cast("array<double>"))
    maps = e.select("vec_id", grid.alias("attention"))
    x, y = F.col("label") * 0.05, F.col("label") * 0.03
    boxes = e.select("vec_id", x.alias("x0"), y.alias("y0"), (x + 0.4).alias("x1"), (y + 0.3).alias("y1"))
    scene = e.where(F.col("label") % 2 == 0).select(
        "vec_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1")
    )
    return r6(M.grounding_score(maps, boxes.unionByName(scene), "vec_id", "attention", 8), "grounding")


@query(
    "detection_a13",
    """WITH b AS (SELECT o_orderkey AS id, (o_custkey % 30) * 10.0 AS x, 10.0 + o_custkey % 40 AS w, 5.0 + o_orderkey % 25 AS h,
                    o_orderkey % 11 AS shift FROM orders),
            i AS (SELECT *, greatest(w - shift + 1, 0) * greatest(h - shift + 1, 0) AS inner_area, (w + 1) * (h + 1) AS area FROM b),
            u AS (SELECT shift < 8 AND inner_area / (2 * area - inner_area) >= 0.5 AS hit FROM i)
       SELECT count(*) AS total, count(CASE WHEN hit THEN 1 END) AS hits,
              round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS accuracy FROM u""",
)
def detection(t):
    x, w = F.col("o_custkey") % 30 * 10.0, F.col("o_custkey") % 40 + 10.0
    h, shift = F.col("o_orderkey") % 25 + 5.0, F.col("o_orderkey") % 11
    key = F.col("o_orderkey").alias("id")
    gold = t.orders.select(key, F.array(x, F.lit(20.0), w, h).alias("gold"))
    pred = t.orders.where(shift < 8).select(
        key, F.array(x + shift, shift + 20.0, x + shift + w, shift + 20.0 + h).alias("pred")
    )
    return r6(M.detection_accuracy(gold, pred, "id", "pred", "gold"), "accuracy")


@query(
    "hallucination_a14",
    PARTNERS_SQL
    + """SELECT lang, round(avg(CASE WHEN i.n > 0 THEN 1.0 ELSE 0 END), 6) AS chair_s, round(sum(i.n) / sum(a.n), 6) AS chair_i,
              round(avg(len(string_split(trim(text), ' '))), 6) AS sentence_len, round(avg(coalesce(a.n, 0)), 6) AS avg_objects
         FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN i USING (doc_id) GROUP BY lang""",
)
def hallucination(t):
    rows = t.documents.select("doc_id", "lang", F.size(F.split(F.trim("text"), " ")).alias("length")).join(compared_words(t), "doc_id")
    out = M.hallucination_counts(rows, F.col("length"), F.col("n_a"), F.col("invented"), ["lang"])
    return r6(out, "chair_s", "chair_i", "sentence_len", "avg_objects")


@query(
    "judged_coverage_a15",
    """WITH v AS (SELECT conv_id, role, CASE length(text) % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'maybe' END AS v FROM conversations)
       SELECT role, count(*) AS n, round(100 * avg(CASE WHEN v <> 'no' THEN 1.0 ELSE 0 END), 2) AS coverage,
              round(100 - round(100 * avg(CASE WHEN v <> 'no' THEN 1.0 ELSE 0 END), 2), 2) AS hallucination
       FROM v GROUP BY ROLLUP (role)""",
)
def judged_coverage(t):
    verdict = F.element_at(F.array(F.lit("No"), F.lit("Yes"), F.lit("Maybe")), (F.length("text") % 3 + 1).cast("int"))
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(". item: detail - "), verdict, F.lit(", as shown"))
    # One reply per turn keeps the text of a case bounded; the verdicts are numbered by turn.
    replies = t.conversations.select("conv_id", line.alias("reply"))
    questions = t.conversations.select("conv_id", F.col("turn").alias("question"), "role")
    return M.coverage_by_category(M.judged_lines(replies, "conv_id", "reply"), questions, "conv_id", "role")


CAP_SQL = """
WITH b AS (SELECT d.doc_id, [lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END, CASE WHEN quality = 1 THEN 'good' ELSE lang END] AS caps,
             [(doc_id * 7 + n_chars) % 11 / 10.0, (doc_id * 7 + n_chars + 3) % 11 / 10.0, (doc_id * 7 + n_chars + 6) % 11 / 10.0] AS s
           FROM documents d JOIN labels USING (doc_id)),
     u AS (SELECT 'capability' AS level, unnest(list_distinct(caps)) AS name, s FROM b
           UNION ALL SELECT 'set', array_to_string(list_sort(list_distinct(caps)), '_'), s FROM b
           UNION ALL SELECT 'total', 'total', s FROM b),
     r AS (SELECT level, name, count(*) AS n, avg(s[1]) * 100 AS a, avg(s[2]) * 100 AS b, avg(s[3]) * 100 AS c FROM u GROUP BY ALL)
SELECT level, name, n, round((a + b + c) / 3, 4) AS score,
       CASE WHEN level = 'total' THEN round(sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3), 4) END AS std
FROM r
"""


@query("capability_scores_a16", CAP_SQL)
def capability_scores(t):
    base = F.col("doc_id") * 7 + F.col("n_chars")
    rows = t.documents.join(t.labels, "doc_id").select(
        F.array(
            F.col("lang"),
            F.when(F.col("n_chars") > 1000, "long").otherwise("short"),
            F.when(F.col("quality") == 1, "good").otherwise(F.col("lang")),
        ).alias("caps"),
        F.array(*[(base + 3 * r) % 11 / 10.0 for r in range(3)]).alias("scores"),
    )
    return M.capability_scores(rows, "caps", "scores", 3)


@query(
    "review_summary_a17",
    """WITH b AS (SELECT lang, CASE WHEN n_chars % 13 = 0 THEN -1 ELSE 1 + n_chars % 10 END AS a,
                    CASE WHEN n_chars % 13 = 0 THEN -1 ELSE 1 + doc_id % 10 END AS b FROM documents)
       SELECT lang, round(round(avg(b), 3) / round(avg(a), 3) * 100, 1) AS relative, round(round(avg(a), 3) * 10, 1) AS first,
              round(round(avg(b), 3) * 10, 1) AS second, count(*) AS n FROM b GROUP BY ROLLUP (lang)""",
)
def review_summary(t):
    first, second = (F.col("n_chars") % 10 + 1).cast("string"), (F.col("doc_id") % 10 + 1).cast("string")
    review = F.when(F.col("n_chars") % 13 == 0, F.lit("no scores\nbad")).otherwise(
        F.concat(first, F.lit(", "), second, F.lit("\nfine"))
    )
    rows = t.documents.select("lang", M.score_pair(review).alias("pair"))
    return M.review_summary(rows, "pair", "lang")


@query(
    "least_loss_a18",
    """WITH b AS (SELECT label, list_position(embedding[1:4], list_min(embedding[1:4])) - 1 AS pick, vec_id % 4 AS answer FROM embeddings)
       SELECT label, count(*) AS n, round(100 * avg(CASE WHEN pick = answer THEN 1.0 ELSE 0 END), 6) AS acc FROM b GROUP BY label""",
)
def least_loss(t):
    rows = t.embeddings.select(
        "label", M.least_loss(F.slice("embedding", 1, 4)).alias("pick"), (F.col("vec_id") % 4).alias("answer")
    )
    return r6(M.type_accuracy(rows, "label", F.col("pick") == F.col("answer")), "acc")


@query(
    "score_grid_a19",
    """SELECT l_linenumber AS depth, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), 6) AS A,
              round(avg(CASE WHEN l_returnflag = 'N' THEN l_discount END), 6) AS N,
              round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS R FROM lineitem GROUP BY l_linenumber""",
)
def score_grid(t):
    rows = t.lineitem.select(F.col("l_linenumber").alias("depth"), "l_returnflag", "l_discount")
    return r6(M.score_grid(rows, "depth", "l_returnflag", ["A", "N", "R"], "l_discount"), "A", "N", "R")


@query(
    "class_shares_a20",
    """SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang""",
)
def class_shares(t):
    return r6(M.shares(t.documents, "lang"), "share")


@query(
    "text_statistics_a20",
    """WITH b AS (SELECT role, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations)
       SELECT role, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS avg_tokens, count(*) AS n FROM b GROUP BY role""",
)
def text_statistics(t):
    return r6(M.text_statistics(t.conversations, "role", "text"), "avg_tokens")


@query(
    "length_histogram_a20",
    """SELECT CASE WHEN n_chars >= 5000 THEN 4 WHEN n_chars >= 2000 THEN 3 WHEN n_chars >= 500 THEN 2
                   WHEN n_chars >= 100 THEN 1 WHEN n_chars >= 0 THEN 0 ELSE -1 END AS bin, count(*) AS n FROM documents GROUP BY 1""",
)
def length_histogram(t):
    return M.histogram(t.documents, "n_chars", [0, 100, 500, 2000, 5000])


@query("category_counts_a21", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def category_counts(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "chance_accuracy_a22",
    """WITH b AS (SELECT p_type, 2 + p_size % 4 AS o FROM part)
       SELECT p_type, count(*) AS n, sum(o)::BIGINT AS n_options, round(100 * count(*) / sum(o), 6) AS chance FROM b GROUP BY p_type""",
)
def chance_accuracy(t):
    options = F.array_repeat("p_name", (F.col("p_size") % 4 + 2).cast("int"))
    return r6(M.chance_accuracy(t.part.select("p_type", options.alias("options")), "p_type", "options"), "chance")


@query(
    "soft_vote_a24",
    """WITH b AS (SELECT doc_id, lang, chr(97 + (n_chars % 4)::INT) AS pred,
                    list_transform(range(10), lambda i: chr(97 + ((doc_id * (i + 1) + i) % 4)::INT)) AS gt FROM documents),
            l AS (SELECT lang, pred, list_transform(range(1, 11), lambda i: least(1.0,
                    len(list_filter(list_concat(gt[1:i - 1], gt[i + 1:10]), lambda g: g = pred)) / 3.0)) AS accs FROM b)
       SELECT lang, round(avg(list_sum(accs) / 10), 6) AS accuracy, count(*) AS n FROM l GROUP BY lang""",
)
def soft_vote(t):
    gt = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.char(97 + (F.col("doc_id") * (i + 1) + i) % 4))
    rows = t.documents.select("lang", F.char(97 + F.col("n_chars") % 4).alias("pred"), gt.alias("gt"))
    out = rows.groupBy("lang").agg(
        F.avg(X.soft_vote(F.col("pred"), F.col("gt"))).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )
    return r6(out, "accuracy")


@query(
    "plain_accuracy_a25",
    """SELECT toxic, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS flag_accuracy,
              round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0 END), 6) AS match_accuracy FROM labels GROUP BY toxic""",
)
def plain_accuracy(t):
    out = t.labels.groupBy("toxic").agg(
        M.share(F.col("quality") == 1).alias("flag_accuracy"),
        M.share(F.col("quality") == 1 - F.col("toxic")).alias("match_accuracy"),
    )
    return r6(out, "flag_accuracy", "match_accuracy")


@query(
    "nested_binary_a26",
    "WITH b AS (SELECT length(text) % 2 = 0 AS p, turn % 3 = 0 AS y, turn % 3 <> 2 AS told FROM conversations) "
    + CONFUSION_SQL.format(by="", group=""),
)
def nested_binary(t):
    reply = F.element_at(F.array(F.lit("Yes it is"), F.lit("No."), F.lit("Hard to say")), (F.col("turn") % 3 + 1).cast("int"))
    nested = order_rows(t.conversations, ["conv_id"], ["turn"]).pages(
        10_000,
        a=F.when(F.length("text") % 2 == 0, "yes").otherwise("no"),
        pred=reply,
    )
    qas = nested.select(F.inline(F.arrays_zip("a", "pred")))
    pred = X.yes_no_prefix(F.lower("pred"))
    out = M.confusion(
        qas.select((F.col("a") == "yes").alias("p"), (pred == "yes").alias("y"), (pred == "other").alias("o")),
        F.col("p"),
        F.col("y"),
        other=F.col("o"),
    )
    return r6(out, *RATES)


@query(
    "running_moments_a27",
    """WITH o AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16 AS batch FROM events),
            b AS (SELECT DISTINCT user_id, batch FROM o)
       SELECT b.user_id, b.batch, count(*) AS count, round(avg(value) + 1e-9, 6) AS mean, round(var_pop(value) + 1e-9, 5) AS var,
              round(stddev_samp(value) + 1e-9, 6) AS std
       FROM b JOIN o ON b.user_id = o.user_id AND o.batch <= b.batch GROUP BY ALL""",
)
def running_moments(t):
    out = M.running_moments(t.events, ["user_id"], ["ts", "event_id"], "value", 16)
    # The small shift keeps exact halves from rounding apart on the two sides.
    digits = {"mean": 6, "var": 5, "std": 6}
    return out.withColumns({c: F.round(F.col(c) + 1e-9, d) for c, d in digits.items()})


@query(
    "masked_moments_a27",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var
       FROM events WHERE value > 10 GROUP BY event_type""",
)
def masked_moments(t):
    rows = t.events.withColumn("mask", (F.col("value") > 10).cast("int"))
    return r6(M.masked_moments(rows, "value", "mask", ["event_type"]), "mean", "var")
