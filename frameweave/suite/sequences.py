"""Queries over ordered streams: sampling, chunks, cuts and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameweave.functions import vectors as V
from frameweave.operators import sequencing as W
from frameweave.plans.ordering import last_rows, order_rows
from frameweave.suite.registry import query

ORDER = ["ts", "event_id"]
NUMBERED = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events)
"""


def frames(t):
    return t.events.select("user_id", "ts", "event_id", "event_type", "value")


@query(
    "mean_step_w1",
    """WITH d AS (SELECT value, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events)
       SELECT round(avg(abs(value - p)) + 1e-9, 6) AS mean_step, count(p) AS steps FROM d""",
)
def mean_step(t):
    out = W.mean_step(frames(t), [], ORDER, "value")
    return out.withColumn("mean_step", F.round(F.col("mean_step") + 1e-9, 6))


@query(
    "spread_sample_w2",
    NUMBERED
    + """, p AS (SELECT DISTINCT user_id, n FROM e), i AS (SELECT user_id, n, range AS i FROM p, range(20))
       SELECT e.user_id, e.event_id, e.seq, i.i FROM i JOIN e ON e.user_id = i.user_id AND e.seq = (i.i * i.n) // 20""",
)
def spread_sample(t):
    return W.sample_rows(frames(t), ["user_id"], ORDER, "spread", 20).select("user_id", "event_id", "seq", "i")


@query(
    "linspace_sample_w2",
    NUMBERED
    + """, p AS (SELECT DISTINCT user_id, n FROM e), i AS (SELECT user_id, n, range AS i FROM p, range(12))
       SELECT e.user_id, e.event_id, e.seq FROM i JOIN e ON e.user_id = i.user_id
          AND e.seq = CASE WHEN i.i = 11 THEN i.n - 1 ELSE floor(i.i * ((i.n - 1)::DOUBLE / 11))::BIGINT END""",
)
def linspace_sample(t):
    return W.sample_rows(frames(t), ["user_id"], ORDER, "linspace", 12).select("user_id", "event_id", "seq")


@query(
    "midpoint_sample_w2",
    NUMBERED
    + """, p AS (SELECT DISTINCT user_id, n FROM e), i AS (SELECT user_id, (n - 1)::DOUBLE / 8 AS seg, range AS i FROM p, range(8))
       SELECT e.user_id, e.event_id, e.seq FROM i JOIN e ON e.user_id = i.user_id
          AND e.seq = floor((round_even(seg * i.i, 0) + round_even(seg * (i.i + 1), 0)) / 2)::BIGINT""",
)
def midpoint_sample(t):
    return W.sample_rows(frames(t), ["user_id"], ORDER, "midpoint", 8).select("user_id", "event_id", "seq")


@query(
    "centre_sample_w2",
    NUMBERED
    + """, p AS (SELECT DISTINCT user_id, n FROM e), i AS (SELECT user_id, (n - 1)::DOUBLE / 8 AS seg, range AS i FROM p, range(8))
       SELECT e.user_id, e.event_id, e.seq FROM i JOIN e ON e.user_id = i.user_id
          AND e.seq = floor(seg / 2 + round_even(seg * i.i, 0))::BIGINT""",
)
def centre_sample(t):
    return W.sample_rows(frames(t), ["user_id"], ORDER, "centre", 8).select("user_id", "event_id", "seq")


@query("every_kth_w2", NUMBERED + "SELECT user_id, event_id, seq FROM e WHERE seq % 7 = 0")
def every_kth(t):
    return W.sample_rows(frames(t), ["user_id"], ORDER, "every", 7).select("user_id", "event_id", "seq")


@query(
    "fixed_stride_w2",
    NUMBERED + "SELECT user_id, event_id, seq FROM e WHERE n < 16 OR (seq % (n // 16) = 0 AND seq // (n // 16) < 16)",
)
def fixed_stride(t):
    return W.sample_rows(frames(t), ["user_id"], ORDER, "stride", 16).select("user_id", "event_id", "seq")


PLAN = """, p AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS days FROM events GROUP BY user_id),
     f AS (SELECT user_id, n, CASE WHEN n <= 40 THEN n WHEN floor(n * 0.2 + 1e-9) > 900 THEN 200 ELSE floor(n * 0.2 + 1e-9)::BIGINT END AS segment,
             least(n, greatest(days * 2, 1)) AS rate_capped,
             (round_even(least(greatest(days * 2, 4), floor(least(768, n) / 2) * 2) / 2, 0) * 2)::BIGINT AS clamped FROM p)
"""


def _plan(t):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = F.floor((micros(F.max("ts")) - micros(F.min("ts"))) / 86_400_000_000)
    return W.frame_plan(frames(t), ["user_id"], days.cast("double"), chunk=40, cap=(900, 200), max_frames=768)


@query("frame_plan_w3", NUMBERED + PLAN + "SELECT * FROM f")
def frame_plan(t):
    return _plan(t).drop("duration")


@query(
    "planned_sample_w3",
    NUMBERED
    + PLAN
    + """SELECT e.user_id, e.event_id, e.seq, r.range AS i FROM f, range(1000) r JOIN e ON e.user_id = f.user_id
         AND e.seq = (r.range * f.n) // f.clamped WHERE r.range < f.clamped""",
)
def planned_sample(t):
    out = W.sample_planned(frames(t), ["user_id"], ORDER, _plan(t), "clamped")
    return out.select("user_id", "event_id", "seq", "i")


@query("count_chunks_w4", NUMBERED + "SELECT user_id, event_id, seq // 16 AS chunk FROM e")
def count_chunks(t):
    return W.chunk_rows(frames(t), ["user_id"], ORDER, 16).select("user_id", "event_id", "chunk")


@query(
    "consecutive_runs_w5",
    """WITH g AS (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS k FROM labels)
       SELECT min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM g GROUP BY k""",
)
def consecutive_runs(t):
    return W.islands(t.labels, [], "doc_id")


@query(
    "event_segments_w7",
    NUMBERED
    + """, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY seq)) AS c FROM e),
       r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC NULLS LAST, seq) AS r FROM d),
       s AS (SELECT *, sum(CASE WHEN r <= 4 AND c IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS segment FROM r)
       SELECT user_id, segment::BIGINT AS segment, min(seq) AS start, max(seq) AS "end", count(*) AS n FROM s GROUP BY ALL""",
)
def event_segments(t):
    rows = W.event_cuts(frames(t), ["user_id"], ORDER, F.abs(F.col("value") - F.col("_p")), {"_p": "value"})
    return W.segment_spans(rows, ["user_id"])


@query(
    "scene_segments_w7",
    """WITH e AS (SELECT vec_id, vec_id % 4 AS stream, embedding::DOUBLE[] AS x,
                    row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS seq FROM embeddings),
            d AS (SELECT stream, vec_id, seq, list_sum(list_transform(list_zip(x, lag(x) OVER w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS c,
                    lag(x) OVER w IS NOT NULL AS known FROM e WINDOW w AS (PARTITION BY stream ORDER BY seq)),
            r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY CASE WHEN known THEN c END DESC NULLS LAST, seq) AS r FROM d),
            s AS (SELECT *, sum(CASE WHEN r <= 4 AND known THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS segment FROM r)
       SELECT stream, segment::BIGINT AS segment, min(seq) AS start, max(seq) AS "end", count(*) AS n FROM s GROUP BY ALL""",
)
def scene_segments(t):
    rows = t.embeddings.select((F.col("vec_id") % 4).alias("stream"), "vec_id", V.doubles("embedding").alias("x"))
    cut = W.event_cuts(rows, ["stream"], ["vec_id"], V.squared("x", "_p"), {"_p": "x"})
    return W.segment_spans(cut, ["stream"])


@query(
    "best_of_n_w9",
    """SELECT source, doc_id, n_chars AS score, r AS rank FROM
         (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3""",
)
def best_of_n(t):
    rows = t.documents.select("source", "doc_id", F.col("n_chars").alias("score"))
    return W.best_of(rows, "source", "score", "doc_id", 3)


@query(
    "prompt_advantage_w10",
    """WITH e AS (SELECT user_id, event_id, value, date_diff('day', DATE '2024-01-01', ts::DATE) AS batch,
                    row_number() OVER (PARTITION BY user_id ORDER BY date_diff('day', DATE '2024-01-01', ts::DATE), ts, event_id) - 1 AS seq FROM events),
            l AS (SELECT user_id, batch, max(seq) AS last FROM e GROUP BY ALL),
            s AS (SELECT l.user_id, l.batch, count(*) AS k, avg(value) AS m, stddev_pop(value) AS s FROM l JOIN e
                  ON e.user_id = l.user_id AND e.seq <= l.last AND e.seq > l.last - 32 GROUP BY ALL),
            b AS (SELECT batch, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY batch)
       SELECT e.user_id, e.event_id, round((value - CASE WHEN k >= 16 THEN s.m ELSE b.m END)
                / (CASE WHEN k >= 16 THEN s.s ELSE b.s END + 1e-6), 5) AS advantage
       FROM e JOIN s USING (user_id, batch) JOIN b USING (batch)""",
)
def prompt_advantage(t):
    rows = frames(t).withColumn("batch", F.datediff("ts", F.lit("2024-01-01")))
    out = W.prompt_advantage(rows, "user_id", "batch", ORDER, "value", 32, 16)
    return out.select("user_id", "event_id", F.round("advantage", 5).alias("advantage"))


@query(
    "unique_ids_w14",
    """SELECT conv_id, turn, role || '_' || (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) AS new_id FROM conversations""",
)
def unique_ids(t):
    return W.unique_ids(t.conversations, "role", ["conv_id", "turn"], "new_id").select("conv_id", "turn", "new_id")


@query(
    "probe_grid_w15",
    """WITH e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM embeddings),
            l AS (SELECT unnest([count(*) // 10, count(*) // 2, count(*)]) AS length, count(*) // 2 AS half FROM e GROUP BY ()),
            g AS (SELECT length, d.d AS depth, floor(d.d * length + 1e-9)::BIGINT AS marker
                  FROM l, (VALUES (0.0::DOUBLE), (0.3), (1.0)) d(d) WHERE NOT (length = half AND d.d = 1.0))
       SELECT length, depth, seq + CASE WHEN seq >= marker THEN 1 ELSE 0 END AS position, vec_id FROM e, g WHERE seq < length
       UNION ALL SELECT length, depth, marker, NULL FROM g""",
)
def probe_grid(t):
    n = t.embeddings.count()
    done = t.spark.createDataFrame([(n // 2, 1.0)], "length long, depth double")
    lengths, depths = [n // 10, n // 2, n], [0.0, 0.3, 1.0]
    return W.probe_grid(t.embeddings.select("vec_id"), ["vec_id"], "vec_id", lengths, depths, done)


@query(
    "retention_weights_m2",
    NUMBERED
    + """SELECT user_id, event_id, round(exp(-(n - 1 - seq) / 5.0) / sum(exp(-(n - 1 - seq) / 5.0)) OVER (PARTITION BY user_id), 6) AS weight
         FROM e WHERE seq >= n - 20""",
)
def retention_weights(t):
    rows = last_rows(frames(t), ["user_id"], ORDER, 20)
    out = W.retention_weights(rows, ["user_id"], F.col("n") - 1 - F.col("seq"), 5)
    return out.select("user_id", "event_id", F.round("weight", 6).alias("weight"))
