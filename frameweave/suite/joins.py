"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameweave.operators import joining as J
from frameweave.plans.ordering import order_rows
from frameweave.plans.staging import small_side
from frameweave.suite.registry import query


@query(
    "answer_types_j1",
    """SELECT d.source, d.lang, count(*) AS n, sum(l.quality)::BIGINT AS right_answers
       FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL""",
)
def answer_types(t):
    joined = J.join_answers(t.documents.select("doc_id", "source", "lang"), t.labels, ["doc_id"])
    return joined.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("right_answers")
    )


@query(
    "prompt_questions_j2",
    """WITH c AS (SELECT conv_id, turn, role, lower(replace(text, chr(10), ' ')) AS q, length(text) AS n
                  FROM conversations)
       SELECT a.conv_id, a.turn AS asked_turn, a.role, b.turn, b.n AS answer_chars
       FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.q = b.q""",
)
def prompt_questions(t):
    question = F.regexp_replace(F.col("text"), "\n", " ")
    tail = F.lit("\nAnswer the question using a single word or phrase.")
    hint = F.lit("Reference OCR token: exit, 12")
    prompt = (
        F.when(F.col("turn") % 4 == 0, F.concat(question, tail))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("OCR tokens: a b. Question: "), question, F.lit(" Short answer:")))
        .when(F.col("turn") % 4 == 2, F.concat(hint, F.lit("\n"), question, tail))
        .otherwise(F.concat(question, F.lit("\n"), hint, tail))
    )
    prompts = t.conversations.select(
        "conv_id", "role", F.col("turn").alias("asked_turn"), J.question_from_prompt(prompt).alias("question")
    )
    notes = t.conversations.select(
        "conv_id", "turn", F.lower(question).alias("question"), F.length("text").cast("long").alias("answer_chars")
    )
    return prompts.join(notes, ["conv_id", "question"]).drop("question")


@query(
    "predictions_or_failed_j3",
    """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'A' WHEN l.quality = 0 THEN 'B' END, 'FAILED') AS answer
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def predictions_or_failed(t):
    preds = t.labels.select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("B").alias("answer"))
    return J.with_default(t.documents.select("doc_id"), preds, ["doc_id"], {"answer": F.lit("FAILED")})


@query(
    "two_models_j4",
    """WITH p AS (SELECT o_orderkey, c_nationkey,
                    CASE WHEN o_totalprice > 250000 THEN 'A' ELSE 'B' END AS truth,
                    CASE WHEN c_acctbal > 4500 THEN 'A' ELSE 'B' END AS a,
                    CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'FAILED' END AS b
                  FROM orders JOIN customer ON o_custkey = c_custkey),
            m AS (SELECT *, CASE WHEN b = 'FAILED' THEN a ELSE b END AS m FROM p)
       SELECT n_name, count(*) AS n, count(CASE WHEN a = truth THEN 1 END) AS right_a,
              count(CASE WHEN m = truth THEN 1 END) AS right_merged,
              count(CASE WHEN a = truth OR b = truth THEN 1 END) AS upper_bound
       FROM m JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def two_models(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    base = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    problems = base.select(
        "o_orderkey", "c_nationkey", F.when(F.col("o_totalprice") > 250000, "A").otherwise("B").alias("truth")
    )
    first = base.select("o_orderkey", F.when(F.col("c_acctbal") > 4500, "A").otherwise("B").alias("answer"))
    second = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "A")
        .when(F.col("o_orderstatus") == "O", "B")
        .otherwise("FAILED")
        .alias("answer"),
    )
    both = J.combine_models(problems, first, second, "o_orderkey", "answer", "FAILED")
    truth = F.col("truth")
    return (
        both.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("answer_a") == truth).alias("right_a"),
            F.count_if(F.col("answer_merged") == truth).alias("right_merged"),
            F.count_if((F.col("answer_a") == truth) | (F.col("answer_b") == truth)).alias("upper_bound"),
        )
    )


@query(
    "known_objects_j5",
    """SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 500 AND toxic = 0""",
)
def known_objects(t):
    pred = t.documents.select("doc_id", "lang", F.when(F.col("n_chars") >= 500, F.col("n_chars")).alias("caption"))
    truth = t.labels.select("doc_id", "quality", F.when(F.col("toxic") == 0, F.lit(1)).alias("objects"))
    return J.combine_known(pred, truth, "doc_id", ["caption", "objects"]).select("doc_id", "lang", "quality")


@query(
    "answered_only_j6",
    """SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def answered_only(t):
    return t.documents.select("doc_id", "source").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query(
    "work_list_j7_u4",
    """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def work_list(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


@query(
    "entailed_accuracy_j8",
    """WITH q AS (SELECT conv_id, turn, role <> 'system' AND length(text) % 3 <> 0 AS ok FROM conversations)
       SELECT a.conv_id, a.turn AS source_id, round(avg(CASE WHEN b.ok THEN 1.0 ELSE 0 END), 6) AS consistency
       FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 3
       WHERE a.ok GROUP BY ALL""",
)
def entailed_accuracy(t):
    q = t.conversations.select(
        "conv_id",
        "turn",
        F.sequence(F.col("turn") + 1, F.col("turn") + 3).alias("entailed"),
        ((F.col("role") != "system") & (F.length("text") % 3 != 0)).alias("ok"),
    )
    out = J.entailed_accuracy(q, ("conv_id", "turn"), "entailed", "ok")
    return out.withColumn("consistency", F.round("consistency", 6))


@query(
    "caption_override_j9",
    """SELECT doc_id, coalesce('Short description: ' || d.lang || chr(10) || 'Long description: ' || b.text, d.lang)
              AS long_caption, coalesce(b.text, d.lang) AS caption
       FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id AND d.source = 'src' || (b.item_id % 20)""",
)
def caption_override(t):
    samples = t.documents.select(F.col("source").alias("shard"), F.col("doc_id").alias("key"), "lang")
    captions = t.benchmark.select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("shard"),
        F.col("item_id").alias("key"),
        F.col("text").alias("recaption"),
    )
    keys = ["shard", "key"]
    out = J.override_captions(samples, captions, keys, "lang", "recaption", "caption")
    out = J.override_captions(out, captions, keys, "lang", "recaption", "long_caption", long_form=True)
    return out.select(F.col("key").alias("doc_id"), "long_caption", "caption")


SPAN_SQL = """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type FROM events),
     s AS (SELECT user_id, event_id AS ord, ms AS start_ms, ms + 14400000 AS end_ms,
                  CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'cue ' || event_id END AS text
           FROM e WHERE event_type = 'purchase'),
     h AS (SELECT e.user_id, e.event_id, e.ms, min_by(s.text, s.ord) AS text FROM e JOIN s
           ON e.user_id = s.user_id AND s.start_ms < e.ms AND e.ms < s.end_ms AND trim(s.text) <> ''
           GROUP BY ALL)
"""


def _subtitled(t):
    e = t.events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type")
    spans = e.where("event_type = 'purchase'").select(
        "user_id",
        F.col("event_id").alias("ord"),
        F.col("ms").alias("start_ms"),
        (F.col("ms") + 14_400_000).alias("end_ms"),
        F.when(F.col("event_id") % 5 == 0, "  ")
        .otherwise(F.concat(F.lit("cue "), F.col("event_id").cast("string")))
        .alias("text"),
    )
    points = e.drop("event_type")
    return J.active_spans(
        points, spans, "user_id", "event_id", "ms", "start_ms", "end_ms", "ord", "text", 3_600_000
    )


@query("subtitle_at_time_j10", SPAN_SQL + "SELECT * FROM h")
def subtitle_at_time(t):
    return _subtitled(t)


@query(
    "subtitle_text_j10",
    SPAN_SQL
    + """SELECT user_id, page, string_agg(text, chr(10) ORDER BY ms, event_id) AS text
           FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1) // 10000 AS page FROM h) GROUP BY user_id, page""",
)
def subtitle_text(t):
    pages = order_rows(_subtitled(t), ["user_id"], ["ms", "event_id"]).pages(10_000, text=F.col("text"))
    return pages.select("user_id", "page", F.array_join("text", "\n").alias("text"))


@query(
    "question_segments_j11",
    """SELECT f.user_id, f.event_id, q.event_id AS segment FROM events f ASOF LEFT JOIN
         (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase') q
       ON f.user_id = q.user_id AND f.ts < q.ts WHERE f.event_type <> 'purchase'""",
)
def question_segments(t):
    frames = t.events.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    questions = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("q"))
    return J.assign_segments(frames, questions, "user_id", ["event_id"], "ts", "q").drop("ts")


@query(
    "review_display_j12",
    """WITH c AS (SELECT *, conv_id * 1000 + turn // 2 AS qid FROM conversations)
       SELECT q.qid, q.turn, length(q.text) AS question_chars, a.role AS answer_role, length(a.text) AS answer_chars,
              CASE WHEN contains(r.text, chr(10)) THEN substr(r.text, instr(r.text, chr(10)) + 1) ELSE r.text END AS review
       FROM c q JOIN c a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
       JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) r ON r.i = q.conv_id % n WHERE q.turn % 2 = 0""",
)
def review_display(t):
    c = t.conversations.withColumn("qid", F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2))
    q = c.where("turn % 2 = 0").select("qid", "conv_id", "turn", F.length("text").cast("long").alias("question_chars"))
    # By conversation and turn: qid alone repeats after 2,000 turns.
    a = c.where("turn % 2 = 1").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("answer_role"),
        F.length("text").cast("long").alias("answer_chars"),
    )
    # Every conversation has a review: the benchmark's items in turn.
    r = order_rows(t.benchmark, [], ["item_id"], seq="place").df.select("place", J.strip_score_line(F.col("text")).alias("review"))
    q = q.withColumn("place", F.col("conv_id") % F.lit(r.count()))
    shown = q.join(a, ["conv_id", "turn"]).join(small_side(r), "place")
    return shown.select("qid", "turn", "question_chars", "answer_role", "answer_chars", "review")


#: Each document beside the next one of its source, the last beside the first; and its words by count.
PARTNERS_SQL = """
WITH p AS (SELECT doc_id, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS other FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
     c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY ALL),
     o AS (SELECT p.doc_id, w, n FROM p JOIN c ON c.doc_id = p.other),
     a AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
     b AS (SELECT doc_id, sum(n) AS n FROM o GROUP BY doc_id),
     m AS (SELECT doc_id, sum(n) AS n FROM o ANTI JOIN c USING (doc_id, w) GROUP BY doc_id),
     i AS (SELECT doc_id, sum(n) AS n FROM c ANTI JOIN o USING (doc_id, w) GROUP BY doc_id)
"""


#: Text of a task that counts the words of documents and of their partners; as rows, words take ten times that.
TEXT_BYTES = 8 << 20


def compared_words(t):
    """(doc_id, n_a, n_b, missed, invented): words of each document and of its partner, and those that only one has."""
    w = order_rows(t.documents.select("source", "doc_id"), ["source"], ["doc_id"]).shift(-1, other="doc_id").df
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("first"))
    pairs = w.join(small_side(first), w["source"].eqNullSafe(first["source"])).select("doc_id", F.coalesce("other", "first").alias("other"))
    texts = t.documents.select("doc_id", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(t.spark.sparkContext.defaultParallelism, size // TEXT_BYTES)
    # Texts are shuffled, once to their own id and once to the document they are the partner of, and cut into
    # words where they meet, so no word is shuffled.
    theirs = texts.withColumnRenamed("doc_id", "other").join(pairs, "other").select("doc_id", F.col("text").alias("their_text"))
    met = texts.repartition(tasks, "doc_id").join(theirs.repartition(tasks, "doc_id").hint("merge"), "doc_id", "left")
    return J.compared_items(met, "doc_id", _words("text"), _words("their_text"))


def _words(c):
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != "")


@query(
    "uncovered_objects_j14",
    PARTNERS_SQL
    + """SELECT doc_id, coalesce(a.n, 0)::BIGINT AS n_a, coalesce(b.n, 0)::BIGINT AS n_b, coalesce(m.n, 0)::BIGINT AS missed, coalesce(i.n, 0)::BIGINT AS invented
         FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def uncovered_objects(t):
    return compared_words(t)


RANGE_SQL = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     r AS (SELECT source, (sum(n) OVER (ORDER BY source) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY source))::BIGINT AS hi FROM s)
"""


def _ranges(t):
    shards = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return J.shard_ranges(shards, ["source"], "n").select("source", "lo", "hi")


@query(
    "range_intersection_j15",
    RANGE_SQL
    + """SELECT source, greatest(lo, 120) AS lo, least(hi, 777) AS hi FROM r WHERE greatest(lo, 120) < least(hi, 777)""",
)
def range_intersection(t):
    return J.intersect_range(_ranges(t), F.lit(120), F.lit(777))


@query(
    "worker_ranges_j15",
    RANGE_SQL
    + """, w AS (SELECT range AS worker FROM range(7)), p AS (SELECT ceil(count(*) / 7)::BIGINT AS per FROM documents)
       SELECT source, worker, greatest(lo, worker * per) AS lo, least(hi, (worker + 1) * per) AS hi FROM r, w, p
       WHERE greatest(lo, worker * per) < least(hi, (worker + 1) * per)""",
)
def worker_ranges(t):
    per = -(-t.documents.count() // 7)
    return J.worker_ranges(_ranges(t), F.lit(per)).select("source", "worker", "lo", "hi")


@query(
    "aligned_regions_j16",
    """SELECT 'labelled' AS part, d.doc_id AS image, (CASE WHEN d.lang = 'en' THEN 1 ELSE 2 END)::BIGINT AS n_names,
              d.lang || '|' || l.quality AS regions FROM documents d JOIN labels l USING (doc_id)
       UNION ALL
       SELECT 'benchmark', d.doc_id, (CASE WHEN d.lang = 'en' THEN 1 ELSE 2 END)::BIGINT, d.lang || '|' || length(b.text)
       FROM documents d JOIN benchmark b ON d.doc_id = b.item_id""",
)
def aligned_regions(t):
    objects = t.documents.select(
        F.col("doc_id").alias("image"), F.array(F.lit("en"), F.col("lang"), F.lit("en")).alias("objects"), "lang"
    )

    def part(name, other):
        j = objects.join(other, "image")
        return j.select(
            F.lit(name).alias("part"),
            "image",
            F.size(F.array_distinct("objects")).cast("long").alias("n_names"),
            F.array_join(F.array("lang", "region"), "|").alias("regions"),
        )

    train = t.labels.select(F.col("doc_id").alias("image"), F.col("quality").cast("string").alias("region"))
    val = t.benchmark.select(F.col("item_id").alias("image"), F.length("text").cast("string").alias("region"))
    return part("labelled", train).unionByName(part("benchmark", val))
