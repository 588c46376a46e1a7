"""Queries over the stream memory and the dialogue memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameweave.functions import vectors as V
from frameweave.operators import clustering as C
from frameweave.operators import memory as M
from frameweave.suite.registry import query
from frameweave.suite.sequences import NUMBERED, ORDER, frames
from frameweave.suite.streams import FOREST, MEMORY_ROWS, PATHS, U_QUERY
from frameweave.suite.texts import DIALOGUE, SUMMARIES, day_summaries, dialogue

U42 = "('0x' || substr(md5('42:' || {0}), 1, 8))::BIGINT / 4294967296.0"


@query(
    "change_gate_m1",
    """WITH d AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
       SELECT user_id, event_id FROM d WHERE p IS NULL OR abs(value - p) > 15""",
)
def change_gate(t):
    rows = frames(t).withColumn("v", F.array("value"))
    return M.change_gate(rows, ["user_id"], ORDER, "v", 15.0).select("user_id", "event_id")


@query(
    "scene_gate_m1",
    """WITH e AS (SELECT vec_id, vec_id % 4 AS stream, embedding::DOUBLE[] AS x FROM embeddings),
            d AS (SELECT *, lag(x) OVER (PARTITION BY stream ORDER BY vec_id) AS p FROM e)
       SELECT stream, vec_id FROM d WHERE p IS NULL OR 1 - list_cosine_similarity(x, p) > 0.9""",
)
def scene_gate(t):
    rows = t.embeddings.select((F.col("vec_id") % 4).alias("stream"), "vec_id", V.doubles("embedding").alias("x"))
    return M.change_gate(rows, ["stream"], ["vec_id"], "x", 0.9, V.cosine_distance).select("stream", "vec_id")


@query(
    "short_memory_m3",
    NUMBERED
    + f""", w AS (SELECT *, ln({U42.format("user_id || ':' || event_id")} + 1e-12) / exp(-(seq - (n - least(n, 20))) / 5.0) AS k FROM e WHERE seq >= n - 20)
       SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS r FROM w) WHERE r <= 5""",
)
def short_memory(t):
    return M.short_memory(frames(t), ["user_id"], ORDER, "event_id").select("user_id", "event_id")


TREE = """
WITH RECURSIVE e AS (SELECT vec_id % 4 AS stream, (row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1) // 8 AS seq, embedding::DOUBLE[] AS x FROM embeddings),
  l AS (SELECT stream, seq, i, avg(v) AS v FROM (SELECT stream, seq, unnest(range(64)) AS i, unnest(x) AS v FROM e) GROUP BY ALL),
  c AS (SELECT stream, count(DISTINCT seq) AS n FROM e GROUP BY stream),
  tree AS (SELECT stream, 0::BIGINT AS depth, seq, i, v, n FROM l JOIN c USING (stream)
           UNION ALL SELECT stream, depth + 1, seq // 4, i, avg(v), (n + 3) // 4 FROM tree WHERE n > 1 GROUP BY stream, depth, seq // 4, i, n),
  nodes AS (SELECT stream, depth, seq, list(v ORDER BY i) AS x, any_value(n) AS n FROM tree GROUP BY stream, depth, seq)
"""


def _tree(t, k=None):
    rows = t.embeddings.select(
        (F.col("vec_id") % 4).alias("stream"),
        "vec_id",
        V.doubles("embedding").alias("x"),
        F.col("vec_id").cast("string").alias("text"),
    )
    leaves = M.build_leaves(rows, "stream", ["vec_id"], "x", 8, k=k, text="text")
    return M.build_tree(leaves, 4, k=k)


@query(
    "memory_leaves_m4",
    """WITH e AS (SELECT vec_id % 4 AS stream, vec_id, (row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1) // 8 AS seq, embedding::DOUBLE[] AS x FROM embeddings),
            m AS (SELECT stream, seq, list(v ORDER BY i) AS m FROM (SELECT stream, seq, i, avg(v) AS v FROM (SELECT stream, seq, unnest(range(64)) AS i, unnest(x) AS v FROM e) GROUP BY ALL) GROUP BY ALL),
            r AS (SELECT e.stream, e.seq, vec_id, row_number() OVER (PARTITION BY e.stream, e.seq ORDER BY round(pow(list_distance(x, m), 2), 12), vec_id) AS r,
                    count(*) OVER (PARTITION BY e.stream, e.seq) AS n FROM e JOIN m USING (stream, seq))
       SELECT stream, seq, vec_id::VARCHAR AS text, least(n, 3) AS centroids FROM r WHERE r = 1""",
)
def memory_leaves(t):
    rows = t.embeddings.select(
        (F.col("vec_id") % 4).alias("stream"), "vec_id", V.doubles("embedding").alias("x"), F.col("vec_id").cast("string").alias("text")
    )
    leaves = M.build_leaves(rows, "stream", ["vec_id"], "x", 8, k=3, text="text")
    return leaves.select("stream", "seq", "text", F.size("centroids").cast("long").alias("centroids"))


@query(
    "memory_tree_m5",
    TREE
    + """SELECT stream, depth, seq, CASE WHEN n > 1 THEN seq // 4 END AS parent_seq, round(x[1], 6) AS first_value, round(list_sum(x), 6) AS total FROM nodes""",
)
def memory_tree(t):
    return _tree(t).select(
        "stream",
        F.col("depth").cast("long").alias("depth"),
        "seq",
        "parent_seq",
        F.round(F.get("vector", 0), 6).alias("first_value"),
        F.round(V.total(F.col("vector")), 6).alias("total"),
    )


@query(
    "clustered_tree_m5",
    TREE
    + """SELECT stream, depth, count(*) AS n, true AS bounded FROM nodes GROUP BY ALL""",
)
def clustered_tree(t):
    nodes = _tree(t, k=5)
    return nodes.groupBy("stream", F.col("depth").cast("long").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.size("centroids") <= 5).alias("bounded")
    )


@query("nodes_by_depth_a23", TREE + "SELECT depth, count(*) AS n FROM nodes GROUP BY depth")
def nodes_by_depth(t):
    return M.nodes_by_depth(_tree(t)).withColumn("depth", F.col("depth").cast("long"))


@query(
    "split_leaves_m7",
    """WITH e AS (SELECT vec_id % 4 AS stream, (row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1) // 8 AS seq FROM embeddings)
       SELECT stream, seq AS parent_seq, 3 AS n FROM e GROUP BY ALL HAVING count(*) > 3""",
)
def split_leaves(t):
    rows = t.embeddings.select((F.col("vec_id") % 4).alias("stream"), "vec_id", V.doubles("embedding").alias("x"))
    leaves = M.build_leaves(rows, "stream", ["vec_id"], "x", 8)
    return M.split_tree(leaves, 3).groupBy("stream", "parent_seq").agg(F.count(F.lit(1)).alias("n"))


SEARCH = (
    TREE
    + """, lm AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY ALL),
  q AS (SELECT label * 4 + s AS query_id, s AS stream, x AS query FROM (SELECT label, list(v ORDER BY i) AS x FROM lm GROUP BY label), range(4) r(s)),
  walk AS (SELECT query_id, q.stream, depth, seq, depth AS top, NULL::DOUBLE AS similarity FROM q JOIN nodes ON nodes.stream = q.stream WHERE n = 1 AND depth > 0
     UNION ALL SELECT query_id, stream, depth, seq, top, similarity FROM (
       SELECT w.query_id, w.stream, c.depth, c.seq, w.top, round({score}, 12) AS similarity,
              row_number() OVER (PARTITION BY w.query_id ORDER BY round({score}, 12) DESC, c.seq) AS r
       FROM walk w JOIN q USING (query_id) JOIN nodes c ON c.stream = w.stream AND c.depth = w.depth - 1 AND c.seq // 4 = w.seq) WHERE r = 1)
SELECT query_id, stream, depth, seq, round(similarity, 6) AS similarity FROM walk WHERE depth < top
"""
)


def questions(t):
    """A question per stream and label: the mean vector of the label."""
    means = C.mean_vectors(t.embeddings, ["label"], "embedding", out="query")
    return means.select("label", "query", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")).select(
        (F.col("label") * 4 + F.col("s")).alias("query_id"), F.col("s").cast("long").alias("stream"), "query"
    )


def _path(df):
    return df.select(
        "query_id",
        "stream",
        F.col("depth").cast("long").alias("depth"),
        "seq",
        F.round("similarity", 6).alias("similarity"),
    )


@query("memory_path_search_m8", SEARCH.format(score="list_cosine_similarity(c.x, q.query)"))
def memory_path_search(t):
    return _path(M.descend(_tree(t), questions(t)))


MIXED = "(0.5 * list_cosine_similarity(c.x[:32], q.query[:32]) + 0.1 * list_cosine_similarity(c.x[33:], q.query[33:]))"


@query("single_root_search_m9", SEARCH.format(score=MIXED))
def single_root_search(t):
    return _path(M.descend(_tree(t), questions(t), score=M.weighted_score(), single_root=True))


@query("dot_product_search_m9", SEARCH.format(score="list_inner_product(c.x, q.query)"))
def dot_product_search(t):
    return _path(M.descend(_tree(t), questions(t), score=V.dot, single_root=True))


def _asked(t):
    """Purchases ask about the other events of their user before them; the nearest value is the best."""
    rows = t.events.select("user_id", "ts", "event_id", "event_type", F.array("value").alias("x"), F.col("event_id").cast("string").alias("text"))
    return M.stream_question_context(
        rows.where("event_type <> 'purchase'"),
        rows.where("event_type = 'purchase'").withColumnRenamed("event_id", "qid").select("user_id", "ts", F.col("qid").alias("event_id"), "qid", "x"),
        "user_id",
        ORDER,
        "x",
        "text",
        "qid",
        chunk=4,
        interval=3,
        window=20,
        remember=5,
        score=lambda node, asked: -V.euclidean(node, asked),
    )


ITEMS = (
    "WITH RECURSIVE "
    + MEMORY_ROWS.format(every=1, u=U_QUERY, turn=1)
    + ","
    + FOREST
    + ","
    + PATHS
    + """,
     items AS (SELECT query_id, 'short' AS kind, NULL::INT AS depth, seq::VARCHAR AS item, text FROM short
               UNION ALL SELECT query_id, 'tree', depth, depth || ':' || seq, text FROM path WHERE (depth, seq) <> (rd, rs)
               UNION ALL SELECT query_id, 'tree', depth, depth || ':' || seq, text FROM flat),
     placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, depth DESC NULLS LAST, item) - 1 AS place FROM items)
"""
)


@query("question_context_m10", ITEMS + "SELECT query_id, place, kind, depth, item, text FROM placed")
def question_context(t):
    return _asked(t)["context"].select("query_id", "place", "kind", "depth", "item", "text")


@query("stream_answers_m15", ITEMS + "SELECT query_id, count(*) AS parts, arg_max(text, place) AS answer FROM placed GROUP BY query_id")
def stream_answers(t):
    """The batch driver: the answer of a question is the finest text of its context."""
    rows = _asked(t)["context"]
    # A question's context is at most `remember` frames and one node per level and root.
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"), F.max_by("text", "place").alias("answer"))


# ---- dialogue ----------------------------------------------------------------------------------


@query(
    "append_turns_m11",
    DIALOGUE + """SELECT "user", date, ord, length(query) AS n FROM q""",
)
def append_turns(t):
    """The later half of each user's days arrives twice and is stored once."""
    turns = dialogue(t).select("user", "date", "ord", F.length("query").cast("long").alias("n"))
    early, late = turns.where("date < '2024-01-03'"), turns.where("date >= '2024-01-03'")
    once = M.append_turns(early, late)
    return M.append_turns(once, late)


MEMORY = (
    DIALOGUE
    + SUMMARIES
    + f""", m AS (SELECT *, "user" || '_' || date || '_' || ord AS memory_id, 1 + ord % 3 AS strength FROM q),
     k AS (SELECT * FROM m WHERE {U42.format('memory_id')} <= exp(-(DATE '2024-01-10' - date) / (5.0 * strength)))
"""
)


def _memory(t):
    turns = dialogue(t).withColumn("memory_strength", F.col("ord") % 3 + 1)
    return M.forget(turns, day_summaries(t), F.lit("2024-01-10").cast("date"))


@query("kept_memories_m12", MEMORY + """SELECT "user", date, ord, memory_id, strength AS memory_strength FROM k""")
def kept_memories(t):
    return _memory(t)[0].select("user", "date", "ord", "memory_id", "memory_strength")


@query(
    "kept_summaries_m12",
    MEMORY + """SELECT s."user", s.date, content FROM s WHERE EXISTS (SELECT 1 FROM k WHERE k."user" = s."user" AND k.date = s.date)""",
)
def kept_summaries(t):
    return _memory(t)[1]


@query(
    "reinforced_memories_m13",
    DIALOGUE
    + """, m AS (SELECT "user", date, ord, "user" || '_' || date || '_' || ord AS memory_id FROM q),
       r AS (SELECT memory_id, date + 1 AS d FROM m WHERE ord % 2 = 0 UNION ALL SELECT memory_id, date + 4 FROM m WHERE ord % 4 = 0)
       SELECT m.memory_id, 1 + count(r.d) AS memory_strength, coalesce(max(r.d), any_value(m.date)) AS last_recall_date FROM m LEFT JOIN r USING (memory_id) GROUP BY m.memory_id""",
)
def reinforced_memories(t):
    turns = M.memory_defaults(dialogue(t))
    first = turns.where("ord % 2 = 0").select("memory_id", F.date_add("date", 1).alias("date"))
    second = turns.where("ord % 4 = 0").select("memory_id", F.date_add("date", 4).alias("date"))
    return M.reinforce(turns, first.unionByName(second)).select("memory_id", "memory_strength", "last_recall_date")


@query(
    "summary_work_m14",
    DIALOGUE
    + SUMMARIES
    + """SELECT "user", date, count(*) AS n_turns FROM q WHERE ("user", date) NOT IN (SELECT ("user", date) FROM s) GROUP BY ALL""",
)
def summary_work(t):
    return M.summary_work(dialogue(t), day_summaries(t))
