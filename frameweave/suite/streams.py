"""Structured Streaming queries: the events table as a stream, read to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from frameweave.plans.staging import staging_root
from frameweave.session import ROCKSDB
from frameweave.streaming import ordered as O
from frameweave.streaming import sources as S
from frameweave.suite.registry import query


def _folders(t) -> tuple[str, str]:
    base = f"{staging_root(t.spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


FILES = 7
_feeds: dict[tuple[str, str], str] = {}


def _events(t):
    """The events as FILES micro-batches in order, and one that makes all of them final."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    place = (t.spark.sparkContext.applicationId, t.folder)
    if place not in _feeds:
        _feeds[place] = S.staged_files(rows, ["ts", "event_id"], FILES)
    return S.read_frames(t.spark, _feeds[place], rows.schema, files_per_trigger=1)


def _real(df):
    """Without the row that ends the feed, for queries whose state needs no end."""
    return df.where("event_id IS NOT NULL")


def _frames(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return _events(t).select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("id"), "ts", "event_type", F.array("value").alias("vector"),
        F.col("event_id").cast("string").alias("text"),
    )


def _drained(t, df):
    out, checkpoint = _folders(t)
    S.drain(df, out, checkpoint)
    return t.spark.read.parquet(out)


@query(
    "streamed_predictions_s12",
    "SELECT event_id AS id, user_id AS stream, round(value, 6) AS predicted FROM events WHERE event_type = 'purchase'",
)
def streamed_predictions(t):
    rows = _events(t).where("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("stream"), F.round("value", 6).alias("predicted")
    )
    return _drained(t, rows)


@query(
    "streamed_gate_m1",
    """WITH d AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
       SELECT user_id AS stream, event_id AS id FROM d WHERE p IS NULL OR abs(value - p) > 15""",
)
def streamed_gate(t):
    return _drained(t, O.gate_in_order(_frames(t), 15.0)).select("stream", "id")


@query(
    "streamed_scenes_m1",
    """WITH e AS (SELECT *, [value / 100, CASE event_type WHEN 'view' THEN 1.0 ELSE 0.0 END, CASE event_type WHEN 'click' THEN 1.0 ELSE 0.0 END] AS x FROM events),
            d AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e),
            m AS (SELECT *, list_avg(x) AS ma, list_avg(p) AS mb, list_avg([v * v for v in x]) AS aa, list_avg([v * v for v in p]) AS bb,
                    (x[1] * p[1] + x[2] * p[2] + x[3] * p[3]) / 3 AS ab FROM d)
       SELECT user_id AS stream, event_id AS id FROM m WHERE p IS NULL
          OR ((2 * ma * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0009)) / ((ma * ma + mb * mb + 0.0001) * ((aa - ma * ma) + (bb - mb * mb) + 0.0009)) < 0.31""",
)
def streamed_scenes(t):
    """Structural similarity to the event before, in the stream."""
    kinds = [F.when(F.col("event_type") == k, 1.0).otherwise(0.0) for k in ("view", "click")]
    rows = _frames(t).withColumn("vector", F.array(F.get("vector", 0) / 100, *kinds))
    return _drained(t, O.gate_in_order(rows, 0.31, "ssim")).select("stream", "id")


#: Nodes of each stream's forest over frames f (stream, seq, v, text): chunks of 4, then 3 by 3.
FOREST = """
     n0 AS (SELECT stream, seq // 4 AS seq, v, text, seq AS i, avg(v) OVER (PARTITION BY stream, seq // 4) AS m FROM f
            WHERE (seq // 4 + 1) * 4 <= (SELECT count(*) FROM f AS g WHERE g.stream = f.stream)),
     nodes AS (SELECT stream, 0 AS depth, seq, any_value(m) AS v, arg_min(text, (round(pow(v - m, 2), 12), i)) AS text,
                 count(*) OVER (PARTITION BY stream) AS n FROM n0 GROUP BY stream, seq
               UNION ALL
               SELECT stream, depth + 1, seq // 3, any_value(m), arg_min(text, (round(pow(v - m, 2), 12), seq)), any_value(n) // 3
               FROM (SELECT *, avg(v) OVER (PARTITION BY stream, depth, seq // 3) AS m FROM nodes WHERE (seq // 3 + 1) * 3 <= n)
               GROUP BY stream, depth, seq // 3)
"""


@query(
    "streamed_forest_m6",
    """WITH RECURSIVE f AS (SELECT user_id AS stream, value AS v, event_id::VARCHAR AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),"""
    + FOREST
    + "SELECT stream, depth, seq, round(v + 1e-9, 6) AS value, text FROM nodes",
)
def streamed_forest(t):
    out = _drained(t, O.forest_in_order(_frames(t), 4, 3))
    return out.select("stream", "depth", "seq", F.round(F.get("vector", 0) + 1e-9, 6).alias("value"), "text")


U42 = "('0x' || substr(md5('42:' || {0}), 1, 8))::BIGINT / 4294967296.0"
#: Rows of the streams in order: questions (purchases), turns (signups), and frames, of which every
#: second one since the last question is taken.
MEMORY_ROWS = """
     e AS (SELECT user_id AS stream, event_id AS id, ts, value AS v, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN {turn} ELSE 1 END AS kind FROM events),
     g AS (SELECT *, count(CASE WHEN kind = 0 THEN 1 END) OVER (PARTITION BY stream ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS asked FROM e),
     h AS (SELECT *, row_number() OVER (PARTITION BY stream, asked, kind = 1 ORDER BY ts, id) - 1 AS i FROM g),
     m AS (SELECT *, count(CASE WHEN kind = 1 THEN 1 END) OVER w AS seen, count(CASE WHEN kind <> 1 THEN 1 END) OVER w - 1 AS pos
           FROM h WHERE kind <> 1 OR i % {every} = 0 WINDOW w AS (PARTITION BY stream ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
     f AS (SELECT stream, id, v, seen - 1 AS seq, id::VARCHAR AS text FROM m WHERE kind = 1),
     q AS (SELECT stream, id AS query_id, v AS x, seen, seen // 4 AS leaves, pos FROM m WHERE kind = 0),
     k AS (SELECT query_id, f.seq, f.id, f.text, ln({u} + 1e-12) / exp(-(f.seq - (seen - least(seen, 20))) / 5.0) AS k
           FROM q JOIN f ON f.stream = q.stream AND f.seq < seen AND f.seq >= seen - 20),
     short AS (SELECT query_id, seq, id, text FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, seq) <= 5)
"""
U_QUERY = U42.format("query_id || ':' || f.seq")


def _memory_rows(t):
    kind = F.when(F.col("event_type") == "purchase", O.QUESTION).when(F.col("event_type") == "signup", O.TURN).otherwise(O.FRAME)
    return _frames(t).withColumn("kind", kind)


@query(
    "streamed_short_memory_m3",
    "WITH " + MEMORY_ROWS.format(every=1, u=U_QUERY, turn=2) + "SELECT q.stream, query_id, seq, id FROM short JOIN q USING (query_id)",
)
def streamed_short_memory(t):
    rows = _memory_rows(t).where("kind <> 2 OR id IS NULL")
    return _drained(t, O.short_memory_in_order(rows)).select("stream", "query_id", "seq", "id")


#: Nodes that a descent of the forest gives each question: chosen children (path), best root that is a leaf (flat).
PATHS = """
     roots AS (SELECT query_id, stream, x, d::INT AS depth, unnest(range(leaves // pow(3, d + 1)::BIGINT * 3, leaves // pow(3, d)::BIGINT)) AS seq
               FROM q, range(0, 12) AS r(d)),
     path AS (SELECT query_id, stream, x, depth AS rd, seq AS rs, depth, seq, NULL::VARCHAR AS text FROM roots WHERE depth > 0
              UNION ALL
              SELECT query_id, p.stream, x, rd, rs, n.depth, n.seq, n.text FROM path p
              JOIN nodes n ON n.stream = p.stream AND n.depth = p.depth - 1 AND n.seq // 3 = p.seq
              QUALIFY row_number() OVER (PARTITION BY query_id, rd, rs ORDER BY round(abs(n.v - x), 12), n.seq) = 1),
     flat AS (SELECT query_id, n.depth, n.seq, n.text FROM roots r JOIN nodes n USING (stream, depth, seq) WHERE depth = 0
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(abs(n.v - x), 12), n.seq) = 1)
"""


@query(
    "streamed_answers_m15",
    "WITH RECURSIVE "
    + MEMORY_ROWS.format(every=2, u=U_QUERY, turn=2)
    + ","
    + FOREST
    + """,
     said AS (SELECT stream, id, pos, v FROM m WHERE kind <> 1),
     told AS (SELECT query_id, s.pos, s.id FROM q JOIN said s ON s.stream = q.stream AND s.pos < q.pos
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(abs(s.v - x), 12), s.pos) <= 2),
"""
    + PATHS
    + """,
     items AS (SELECT query_id, 0 AS o, 0 AS d, pos AS s, 'dialogue' AS kind, id::VARCHAR AS item, NULL AS text FROM told
               UNION ALL SELECT query_id, 1, 0, seq, 'short', seq::VARCHAR, text FROM short
               UNION ALL SELECT query_id, 2, -depth, seq, 'tree', depth || ':' || seq, text FROM path WHERE (depth, seq) <> (rd, rs)
               UNION ALL SELECT query_id, 2, -depth, seq, 'tree', depth || ':' || seq, text FROM flat)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o, d, s)::INT - 1 AS place, kind, item, text FROM items
""",
)
def streamed_answers(t):
    """Context of every question: recalled turns, short memory, forest, from one streaming query."""
    rows = O.answers_in_order(_memory_rows(t), 4, 3, every=2, recall=2, score="l2")
    out = _drained(t, rows).where("kind <> 'answer'")
    text = F.when(F.col("kind") != "dialogue", F.col("text"))  # a turn's text holds the answer of its question
    return out.select("query_id", "place", "kind", "item", text.alias("text"))


@query(
    "streamed_advantage_w10",
    """WITH e AS (SELECT user_id AS prompt, date_diff('day', DATE '2024-01-01', ts::DATE) // 10 AS batch, event_id AS id, value AS reward FROM events),
            r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY batch, id) AS i FROM e),
            l AS (SELECT prompt, batch, max(i) AS last FROM r GROUP BY ALL),
            b AS (SELECT l.prompt, l.batch, count(*) AS known, avg(reward) AS mean, stddev_pop(reward) AS std FROM l JOIN r ON r.prompt = l.prompt AND r.i <= last AND r.i > last - 16 GROUP BY ALL),
            w AS (SELECT batch, avg(reward) AS m, stddev_pop(reward) AS s FROM e GROUP BY batch)
       SELECT prompt, batch, id, round((reward - CASE WHEN known >= 8 THEN mean ELSE m END) / (CASE WHEN known >= 8 THEN std ELSE s END + 1e-6), 5) AS advantage
       FROM e JOIN b USING (prompt, batch) JOIN w USING (batch)""",
)
def streamed_advantage(t):
    """Batches of ten days; a file holds whole batches."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("batch", F.floor(day / 10))
    rows = rows.withColumn("ts", F.timestamp_micros(F.col("batch") * F.lit(1_000_000)))
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    feed = S.read_frames(t.spark, S.staged_files(rows, ["batch", "event_id"], FILES), rows.schema, files_per_trigger=1)
    rewards = _real(feed).select(F.col("user_id").alias("prompt"), "batch", F.col("event_id").alias("id"), F.col("value").alias("reward"))
    out, checkpoint = _folders(t)

    def write(batch, batch_id):
        O.batch_advantage(batch, 8).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    S.batch_sink(O.buffered_rewards(rewards, 16), write, checkpoint)
    rows = t.spark.read.parquet(out)
    return rows.select("prompt", "batch", "id", F.round("advantage", 5).alias("advantage"))


@query(
    "streamed_recalls_m13",
    "SELECT user_id AS memory_id, 1 + count(*) AS strength, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY user_id",
)
def streamed_recalls(t):
    recalls = _frames(t).where("event_type = 'view' OR id IS NULL").select(F.col("stream").alias("memory_id"), "id", "ts")
    out, checkpoint = _folders(t)
    log = S.upsert_sink(O.recalls_in_order(recalls), out, checkpoint, ["memory_id"], "append", fold=3)
    return log.read().select("memory_id", "strength", F.timestamp_micros("at").cast("timestamp_ntz").alias("last"))


@query(
    "streamed_statistics_a27",
    "SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type",
)
def streamed_statistics(t):
    out, checkpoint = _folders(t)
    log = S.upsert_sink(S.running_statistics(_real(_events(t)), ["event_type"], "value"), out, checkpoint, ["event_type"], fold=3)
    return log.read().withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "streamed_windows",
    """WITH c AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
       SELECT * FROM c WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) + INTERVAL 1 SECOND FROM events)""",
)
def streamed_windows(t):
    """Closed windows only: the day that the last event falls in is still open."""
    out = _drained(t, S.windowed_counts(_events(t), ["event_type"], "1 day", late="10 minutes"))
    return out.where("event_type IS NOT NULL").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
