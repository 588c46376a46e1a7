"""Queries over vectors: distances, clustering, search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from frameweave.functions import vectors as V
from frameweave.operators import clustering as C
from frameweave.operators import retrieval as R
from frameweave.operators import sequencing as W
from frameweave.operators.conversations import memory_documents
from frameweave.operators.sequence_clustering import sequence_kmeans
from frameweave.operators.vector_index import VectorIndex
from frameweave.plans.ordering import order_rows
from frameweave.plans.staging import materialise, spread, staging_root
from frameweave.suite.registry import query
from frameweave.suite.texts import DIALOGUE, SUMMARIES, day_summaries, dialogue

MEANS = """
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
     d AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(x) AS v FROM p),
     m AS (SELECT label, i, avg(v) AS v FROM d GROUP BY ALL),
     c AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY label)
"""


def points(t):
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), V.doubles("embedding").alias("x"))


def label_means(t):
    return C.mean_vectors(points(t), ["label"], "x").drop("weight")


def _arrays(t):
    return C.centre_arrays(label_means(t), [], "label", "centre")


@query(
    "knn_join_j13",
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
            d AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round(list_distance(a.x, b.x), 12) AS s FROM p a JOIN p b ON a.vec_id <> b.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) AS rank FROM d)
       SELECT query_id, row_id, round(s, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def knn_join(t):
    p = points(t)
    out = R.nearest(p, p, 5, "l2", "vec_id", "vec_id", "x", skip_self=True)
    return out.withColumn("score", F.round("score", 6))


@query(
    "knn_blocks_j13",
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
            d AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round(1 - list_cosine_similarity(a.x, b.x), 12) AS s FROM p a JOIN p b ON a.vec_id <> b.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) AS rank FROM d)
       SELECT query_id, row_id, round(s, 6) AS score, rank FROM r WHERE rank <= 3""",
)
def knn_blocks(t):
    # The path for query tables too large to send: blocks of at most 256 vectors here.
    p = points(t)
    out = R.nearest(p, p, 3, "cosine", "vec_id", "vec_id", "x", skip_self=True, block_bytes=256 * 64 * 8)
    return out.withColumn("score", F.round("score", 6))


@query(
    "knn_manhattan_j13",
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
            d AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: abs(a.x[i] - b.x[i]))), 12) AS s
                  FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) AS rank FROM d)
       SELECT query_id, row_id, round(s, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def knn_manhattan(t):
    """Every hundredth vector, against all vectors."""
    p = points(t)
    out = R.nearest(p.where("vec_id % 100 = 0"), p, 5, "l1", "vec_id", "vec_id", "x", skip_self=True)
    return out.withColumn("score", F.round("score", 6))


@query(
    "knn_cubic_unit_j13",
    """WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings),
            d AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round(pow(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: pow(abs(a.x[i] - b.x[i]), 3))), 1 / 3.0), 12) AS s
                  FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) AS rank FROM d)
       SELECT query_id, row_id, round(s, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def knn_cubic_unit(t):
    """As before, on vectors of length 1 with the cubic distance."""
    p = points(t)
    out = R.nearest(p.where("vec_id % 100 = 0"), p, 5, "lp", "vec_id", "vec_id", "x", skip_self=True, p=3, scale="unit")
    return out.withColumn("score", F.round("score", 6))


@query(
    "vector_search_v12",
    MEANS
    + """, s AS (SELECT c.label AS query_id, vec_id AS row_id, round(list_distance(c.c, p.x), 12) AS s FROM c, p),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) AS rank FROM s)
       SELECT query_id, row_id, round(s, 6) AS score, rank FROM r WHERE rank <= 4""",
)
def vector_search(t):
    queries = label_means(t).select("label", F.col("centre").alias("x"))
    out = R.nearest(queries, points(t), 4, "l2", "label", "vec_id", "x")
    return out.withColumn("score", F.round("score", 6))


@query(
    "indexed_search_v12",
    MEANS
    + """, s AS (SELECT c.label AS query_id, vec_id AS row_id, round(list_distance(c.c, p.x), 12) AS s FROM c, p),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, row_id) AS rank FROM s)
       SELECT query_id, row_id, round(s, 6) AS score, rank FROM r WHERE rank <= 4""",
)
def indexed_search(t):
    """The same over a stored index of cells, a fifth of it appended later; cells out of reach are not read."""
    index = VectorIndex(t.spark, f"{staging_root(t.spark)}/index-{uuid.uuid4().hex}")
    index.create(points(t).where("vec_id % 5 > 0"), "vec_id", "x", cells=32)
    index.append(points(t).where("vec_id % 5 = 0"), "vec_id", "x")
    out = index.search(label_means(t), 4, "label", "centre")
    return out.withColumn("score", F.round("score", 6))


@query(
    "question_frames_w8",
    """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
            f AS (SELECT vec_id, list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda i: x[i * 8 + j + 1]))) AS s FROM p),
            q AS (SELECT vec_id % 10 AS query_id, unnest(range(8)) AS j, unnest(s) AS v FROM f),
            g AS (SELECT query_id, list(sv ORDER BY j) AS q FROM (SELECT query_id, j, sum(v) AS sv FROM q GROUP BY ALL) GROUP BY query_id),
            d AS (SELECT g.query_id, vec_id AS row_id, round(list_inner_product(g.q, f.s), 12) AS s FROM g, f),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM d)
       SELECT query_id, row_id, round(s, 5) AS similarity, rank FROM r WHERE rank <= 6""",
)
def question_frames(t):
    x = V.doubles("embedding")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, 8))
    frames = t.embeddings.select("vec_id", grid.alias("patches"))
    # A question's token vectors: the summed patches of the frames with the same last digit.
    rows = frames.select((F.col("vec_id") % 10).alias("query_id"), F.explode("patches").alias("v"))
    tokens = rows.select("query_id", F.posexplode("v").alias("j", "v")).groupBy("query_id", "j").agg(F.sum("v").alias("v"))
    tokens = tokens.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("l"))
    tokens = tokens.select("query_id", F.array(F.col("l.v")).alias("tokens"))
    out = R.top_frames(frames, tokens, 6, "vec_id", "patches", "query_id", "tokens")
    return out.withColumn("similarity", F.round("similarity", 5))


@query(
    "centre_distances_v6",
    MEANS
    + """SELECT vec_id, c.label, round(list_sum(list_transform(list_zip(x, c.c), lambda z: abs(z[1] - z[2]))), 6) AS l1, round(list_distance(x, c.c), 6) AS l2,
              round(pow(list_distance(x, c.c), 2), 6) AS sq, round(-list_inner_product(x, c.c), 6) AS neg_dot, round(1 - list_cosine_similarity(x, c.c), 6) AS cos_d FROM p, c""",
)
def centre_distances(t):
    rows = C.with_centres(t.embeddings.select("vec_id", V.doubles("embedding").alias("x")), _arrays(t), [])
    d = C.distance_of

    def row(s):
        c = s["c"]
        named = {"l1": d("l1"), "l2": d("l2"), "sq": d("sql2"), "neg_dot": d("dot"), "cos_d": d("cosine")}
        return F.struct(s["label"].alias("label"), *[F.round(f(F.col("x"), c), 6).alias(n) for n, f in named.items()])

    return rows.select("vec_id", F.inline(F.transform("_centres", row)))


@query(
    "distance_table_v6",
    MEANS + """SELECT vec_id, c.label, round(pow(list_distance(x, c.c), 3), 6) AS distance FROM p, c""",
)
def distance_table(t):
    out = C.distance_table(points(t).drop("label"), _arrays(t), "x", [], "l2", power=3.0)
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(
    "cluster_statistics_v7",
    MEANS
    + """SELECT label, count(*) AS n, round(sum(pow(list_distance(x, c.c), 2)), 6) AS inertia, round(any_value(c.c)[1], 6) AS first_value,
              round(sqrt(list_inner_product(any_value(c.c), any_value(c.c))), 6) AS shift FROM p JOIN c USING (label) GROUP BY label""",
)
def cluster_statistics(t):
    zero = label_means(t).select("label", F.transform("centre", lambda v: F.lit(0.0)).alias("centre"))
    out = C.cluster_statistics(points(t), [], "label", "x", zero)
    return out.select(
        "label",
        F.col("weight").cast("long").alias("n"),
        F.round("inertia", 6).alias("inertia"),
        F.round(F.get("centre", 0), 6).alias("first_value"),
        F.round("shift", 6).alias("shift"),
    )


@query(
    "normalised_v8",
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS v FROM p),
            m AS (SELECT i, avg(v) AS m FROM d GROUP BY i),
            c AS (SELECT vec_id, sum(abs(v - m)) AS centred FROM d JOIN m USING (i) GROUP BY vec_id)
       SELECT vec_id, round(centred, 6) AS centred, round((list_sum(x) - 64 * list_min(x)) / (list_max(x) - list_min(x)), 6) AS scaled,
              round(list_sum(x) / sqrt(list_inner_product(x, x)), 6) AS unit_sum FROM p JOIN c USING (vec_id)""",
)
def normalised(t):
    rows = points(t).drop("label").withColumn("c", F.col("x"))
    rows = C.normalise(rows, "c", "mean")
    return rows.select(
        "vec_id",
        F.round(V.total(F.transform("c", lambda v: F.abs(v))), 6).alias("centred"),
        F.round(V.total(V.minmax("x")), 6).alias("scaled"),
        F.round(V.total(V.unit("x")), 6).alias("unit_sum"),
    )


@query(
    "predicted_labels_v3",
    MEANS
    + """, s AS (SELECT vec_id, c.label, round(list_distance(x, c.c), 12) AS s FROM p, c),
       r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, label) AS r FROM s)
       SELECT vec_id, label, round(s, 6) AS distance FROM r WHERE r = 1""",
)
def predicted_labels(t):
    out = C.predict(points(t).drop("label"), label_means(t), "x", [], "l2")
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(
    "lloyd_step_v1",
    MEANS
    + """, s AS (SELECT vec_id, x, c.label, list_distance(x, c.c) AS s FROM p, c),
       a AS (SELECT vec_id, x, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, label) AS r FROM s) WHERE r = 1),
       e AS (SELECT label, unnest(range(64)) AS i, unnest(x) AS v FROM a), n AS (SELECT label, i, avg(v) AS v, count(*) AS n FROM e GROUP BY ALL)
       SELECT label, i AS pos, round(v, 6) AS value, n FROM n""",
)
def lloyd_step(t):
    told = C.predict(points(t).drop("label"), label_means(t), "x", [], "l2")
    new = C.mean_vectors(told, ["label"], "x")
    return new.select(
        "label", F.col("weight").cast("long").alias("n"), F.posexplode("centre").alias("pos", "value")
    ).select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"), "n")


@query(
    "soft_step_v4",
    MEANS
    + """, s AS (SELECT vec_id, x, c.label, list_cosine_similarity(x, c.c) AS s FROM p, c),
       a AS (SELECT *, exp(5 * s) / sum(exp(5 * s)) OVER (PARTITION BY vec_id) AS w FROM s),
       e AS (SELECT label, w, unnest(range(64)) AS i, unnest(x) AS v FROM a), n AS (SELECT label, i, sum(w * v) / (sum(w) + 1e-8) AS v, sum(w) AS m FROM e GROUP BY ALL)
       SELECT label, i AS pos, round(v, 6) AS value, round(m, 5) AS mass FROM n""",
)
def soft_step(t):
    _, new = C.soft_step(points(t).drop("label"), _arrays(t), "x", [])
    return new.select("label", F.round("mass", 5).alias("mass"), F.posexplode("centre").alias("pos", "value")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"), "mass"
    )


def _stream_chunks(t, size: int):
    rows = t.embeddings.select((F.col("vec_id") % 4).alias("stream"), "vec_id", V.doubles("embedding").alias("x"))
    return W.chunk_rows(rows, ["stream"], ["vec_id"], size)


@query(
    "chunk_clusters_v1",
    """WITH e AS (SELECT vec_id % 4 AS stream, embedding::DOUBLE[] AS x, (row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1) // 40 AS chunk FROM embeddings)
       SELECT stream, chunk, least(count(*), 5) AS clusters, count(*)::DOUBLE AS weight, count(*) AS members, round(sum(list_sum(x)), 6) AS mass FROM e GROUP BY ALL""",
)
def chunk_clusters(t):
    # Cluster count, weight and the weighted sum of centroids; the clusters are compared in the tests.
    out = C.chunk_kmeans(_stream_chunks(t, 40), ["stream", "chunk"], "seq", "x", 5)
    return out.groupBy("stream", "chunk").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("weight").alias("weight"),
        F.sum(F.size("members")).alias("members"),
        F.round(F.sum(F.col("weight") * V.total(F.col("centroid"))), 6).alias("mass"),
    )


@query(
    "kmeans_runs_v2",
    """SELECT label AS instance, count(*) AS points, least(count(*), 3) AS clusters, true AS nearest FROM embeddings GROUP BY label""",
)
def kmeans_runs(t):
    # Every point in one cluster and at its nearest centre; values are compared in the tests.
    p = points(t).withColumnRenamed("label", "instance")
    fit = C.kmeans(p, "instance", "vec_id", "x", 3, init="k-means++", runs=2, max_iter=3)
    again = C.predict(p, fit.centres, "x", ["instance"], "l2")
    both = fit.labels.join(again.select("vec_id", F.col("label").alias("again")), "vec_id")
    return both.groupBy("instance").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_distinct("label").alias("clusters"),
        F.bool_and(F.col("label") == F.col("again")).alias("nearest"),
    ).withColumn("instance", F.col("instance").cast("int"))


@query(
    "capacity_clusters_v5",
    """SELECT label AS instance, count(*) AS points, 3.2::DOUBLE AS weight, true AS within_capacity,
              true AS left_out_only_without_room, true AS flagged FROM embeddings GROUP BY label""",
)
def capacity_clusters(t):
    """No cluster is overfull, no point that still fits is left out, and the flag says whether some are."""
    p = points(t).withColumnRenamed("label", "instance")
    # Four clusters of capacity 1 share a total weight of 3.2 at every size.
    total = p.groupBy("instance").agg(F.sum(1 + F.col("vec_id") % 5).alias("total"))
    p = p.join(total, "instance").withColumn("w", (1 + F.col("vec_id") % 5) / F.col("total") * 3.2)
    fit = C.constrained_kmeans(p, "instance", "vec_id", "x", "w", 4, init="ckm++", runs=2)
    told = materialise(fit.labels.join(p.select("vec_id", "w"), "vec_id"))
    load = told.groupBy("instance", "label").agg(F.sum("w").alias("load"), F.count(F.lit(1)).alias("n"), F.min("w").alias("least"))
    out = load.groupBy("instance").agg(
        F.sum("n").alias("points"),
        F.round(F.sum("load"), 6).alias("weight"),
        F.max(F.when(F.col("label") >= 0, F.col("load"))).alias("fullest"),
        F.min(F.when(F.col("label") >= 0, F.col("load"))).alias("emptiest"),
        F.count_if(F.col("label") >= 0).alias("used"),
        F.min(F.when(F.col("label") < 0, F.col("least"))).alias("left"),
    )
    room = F.when(F.col("used") < 4, 1.0).otherwise(1 - F.col("emptiest"))
    return out.join(fit.instances, "instance").select(
        F.col("instance").cast("int").alias("instance"),
        "points",
        "weight",
        (F.col("fullest") <= 1 + 1e-9).alias("within_capacity"),
        (F.coalesce(F.col("left"), F.lit(9.0)) > room - 1e-9).alias("left_out_only_without_room"),
        (F.col("infeasible") == F.col("left").isNotNull()).alias("flagged"),
    )


def _dtw_sql(a: str, b: str) -> str:
    """Soft-DTW of two lists: rows of the recurrence folded one by one, cells folded inside a row."""
    cell = "least(p[j[1]::INT + 1], p[j[1]::INT], r[-1])"
    soft = f"{cell} - ln(exp({cell} - p[j[1]::INT + 1]) + exp({cell} - p[j[1]::INT]) + exp({cell} - r[-1]))"
    row = f"""list_reduce(list_transform(range(1, len({b}) + 1), lambda i: [i::DOUBLE]),
                lambda r, j: list_append(r, pow(x[1] - {b}[j[1]::INT], 2) + {soft}), ['inf'::DOUBLE])"""
    first = f"list_prepend(0.0::DOUBLE, list_transform({b}, lambda v: 'inf'::DOUBLE))"
    return f"(list_reduce(list_transform({a}, lambda v: [v]), lambda p, x: {row}, {first}))[-1]"


@query(
    "soft_dtw_v9",
    """WITH d AS (SELECT user_id, ts::DATE AS day, avg(value) / 100 AS v FROM events GROUP BY ALL),
            s AS (SELECT user_id, list(v ORDER BY day) AS a FROM d GROUP BY user_id),
            p AS (SELECT s.user_id, s.a, b.a AS b FROM s JOIN s AS b ON b.user_id = s.user_id - 1)
       SELECT user_id, round(""" + _dtw_sql("a", "b") + " - 0.5 * (" + _dtw_sql("a", "a") + " + " + _dtw_sql("b", "b") + "), 6) AS distance FROM p",
)
def soft_dtw(t):
    """Each user's daily mean values against those of the user before."""
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    # One value per day: a series is as long as the number of days covered.
    series = daily.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s"))
    series = series.select("user_id", F.transform("s", lambda p: F.array(p["v"] / 100)).alias("s"))
    before = series.select((F.col("user_id") + 1).alias("user_id"), F.col("s").alias("p"))
    out = C.pairwise_soft_dtw(series.join(before, "user_id"), "s", "p", gamma=1.0, normalise=True)
    return out.select("user_id", F.round("distance", 6).alias("distance"))


@query("sequence_clusters_v3")
def sequence_clusters(t):
    """Users clustered by their mean values per weekday under soft-DTW; compared with plain loops in the tests."""
    daily = t.events.groupBy("user_id", F.dayofweek("ts").alias("day")).agg(F.avg("value").alias("v"))
    known = daily.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))
    week = F.array(*[F.array(F.coalesce(F.try_element_at("m", F.lit(d)), F.lit(0.0)) / 100) for d in range(1, 8)])
    fit = sequence_kmeans(known.select("user_id", week.alias("s")), "user_id", "s", 4, gamma=0.1)
    return fit.labels.select("user_id", "label", F.round("distance", 6).alias("distance"))


@query(
    "pooled_patches_v10",
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
            c AS (SELECT vec_id, i // 8 // 3 AS r, i % 8 // 3 AS c, x[i + 1] AS v FROM p, range(64) g(i) WHERE i // 8 < 6 AND i % 8 < 6)
       SELECT vec_id, r * 2 + c AS cell, round(avg(v), 6) AS value FROM c GROUP BY vec_id, r, c""",
)
def pooled_patches(t):
    patches = F.transform(V.doubles("embedding"), lambda v: F.array(v))
    pooled = C.pool_patches(patches, 8, 3)
    return t.embeddings.select("vec_id", F.posexplode(pooled).alias("cell", "v")).select(
        "vec_id", F.col("cell").cast("long").alias("cell"), F.round(F.get("v", 0), 6).alias("value")
    )


@query(
    "projection_v11",
    """SELECT kind, count(*) AS n, true AS in_range FROM (SELECT 'point' AS kind FROM embeddings UNION ALL SELECT DISTINCT 'centre ' || label FROM embeddings) GROUP BY kind""",
)
def projection(t):
    rows = points(t).select(F.lit("point").alias("kind"), F.col("vec_id").alias("id"), "x")
    means = label_means(t).select(
        F.concat(F.lit("centre "), F.col("label").cast("string")).alias("kind"), F.col("label").alias("id"), F.col("centre").alias("x")
    )
    out, _ = C.project(rows.unionByName(means), ["kind", "id"], "x", 2)
    return out.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.forall("point", lambda v: (v >= -1e-9) & (v <= 1 + 1e-9))).alias("in_range"),
    )


# ---- dialogue retrieval -------------------------------------------------------------------------

HASHED = """
t AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM ({src})),
h AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT < 8 THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT id, slot, sum(s)::DOUBLE AS v FROM h GROUP BY ALL),
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM v GROUP BY id)
"""


@query(
    "text_vectors_v14",
    "WITH "
    + HASHED.format(src="SELECT doc_id AS id, text FROM documents")
    + """SELECT id AS doc_id, slot, round(v / n, 6) AS value FROM v JOIN n USING (id) WHERE v <> 0""",
)
def text_vectors(t):
    vec = R.text_vectors(spread(t.documents.select("doc_id", "text")), "doc_id", "text")
    flat = vec.select("doc_id", F.posexplode("vector").alias("slot", "value")).where("value <> 0")
    return flat.select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


def memory_index(t):
    """Dialogue turns and day summaries of all users in one order: pos, source (user and date), content."""
    docs = memory_documents(dialogue(t), day_summaries(t))
    rows = order_rows(docs, [], ["user", "source", F.col("ord").asc_nulls_last()], seq="pos").df
    return rows.select("pos", F.concat_ws("/", F.col("user").cast("string"), "source").alias("source"), "content")


def memory_hits(t, k: int = 3):
    docs = memory_index(t)
    vec = R.text_vectors(docs, "pos", "content")
    asked = R.text_vectors(t.benchmark, "item_id", "text")
    found = R.nearest(asked, vec, k, "l2", "item_id", "pos", "vector")
    return found.select("query_id", F.col("row_id").alias("pos"), "score"), docs


HITS = (
    DIALOGUE
    + SUMMARIES
    + """, o AS (SELECT "user", date, ord, 'Conversation content on ' || date || ':[|User|]: ' || trim(query) || '; [|AI|]: ' || trim(response) AS content FROM q
                 UNION ALL SELECT "user", date, NULL, 'The summary of the conversation on ' || date || ' is: ' || content FROM s),
     docs AS (SELECT row_number() OVER (ORDER BY "user", date, ord NULLS LAST) - 1 AS pos, "user" || '/' || date AS source, content FROM o), """
    + HASHED.format(src="SELECT pos AS id, content AS text FROM docs UNION ALL SELECT -1 - item_id, text FROM benchmark")
    + """, f AS (SELECT id, slot, v / n AS v FROM v JOIN n USING (id)),
     ids AS (SELECT pos AS id FROM docs UNION ALL SELECT -1 - item_id FROM benchmark),
     z AS (SELECT id, list(val ORDER BY s) AS x FROM (SELECT ids.id, r.range AS s, coalesce(f.v, 0) AS val FROM ids CROSS JOIN range(64) r
           LEFT JOIN f ON f.id = ids.id AND f.slot = r.range) GROUP BY id),
     d AS (SELECT -1 - a.id AS query_id, b.id AS pos, round(list_distance(a.x, b.x), 12) AS s FROM z a JOIN z b ON a.id < 0 AND b.id >= 0),
     hits AS (SELECT query_id, pos, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, pos) AS r FROM d) WHERE r <= 3)
"""
)


@query("memory_search_v12", HITS + "SELECT query_id, pos, round(score, 6) AS score FROM hits")
def memory_search(t):
    hits, _ = memory_hits(t)
    return hits.withColumn("score", F.round("score", 6))


WIDE = """, w AS (SELECT h.query_id, h.pos AS hit, h.score, r.range AS step, r.range // 2 + 1 AS dist, d.pos, length(d.content) AS len, d.source = o.source AS same, length(o.content) AS own
           FROM hits h JOIN docs o USING (pos), range(6) r JOIN docs d ON d.pos = h.pos + (r.range // 2 + 1) * CASE WHEN r.range % 2 = 0 THEN 1 ELSE -1 END),
     i AS (SELECT *, row_number() OVER (PARTITION BY query_id, hit ORDER BY step) AS k FROM w),
     fold AS (SELECT query_id, pos AS hit, score, 0::BIGINT AS k, length(content)::BIGINT AS total, 0::BIGINT AS stopped, -1::BIGINT AS took FROM hits JOIN docs USING (pos)
           UNION ALL
           SELECT f.query_id, f.hit, f.score, i.k,
                  f.total + CASE WHEN f.stopped <> i.dist AND f.total + i.len <= 1500 AND i.same THEN i.len ELSE 0 END,
                  CASE WHEN f.stopped <> i.dist AND f.total + i.len > 1500 THEN i.dist ELSE f.stopped END,
                  CASE WHEN f.stopped <> i.dist AND f.total + i.len <= 1500 AND i.same THEN i.pos ELSE -1 END
           FROM fold f JOIN i ON i.query_id = f.query_id AND i.hit = f.hit AND i.k = f.k + 1),
     a AS (SELECT query_id, hit AS pos, score FROM fold WHERE k = 0 UNION ALL SELECT query_id, took, score FROM fold WHERE took >= 0),
     b AS (SELECT query_id, pos, min(score) AS score FROM a GROUP BY ALL),
     u AS (SELECT *, pos - row_number() OVER (PARTITION BY query_id ORDER BY pos) AS run FROM b),
     p AS (SELECT query_id, min(pos) AS first, max(pos) AS last, round(min(score), 6) AS score, min_by(source, pos) AS source, string_agg(content, '' ORDER BY pos) AS content
           FROM u JOIN docs USING (pos) GROUP BY query_id, run)
"""


def _passages(t):
    hits, docs = memory_hits(t)
    return R.merge_passages(R.widen_hits(hits, docs, 3, 1500), docs)


@query("widened_passages_v13", HITS.replace("WITH q", "WITH RECURSIVE q", 1) + WIDE + "SELECT * FROM p")
def widened_passages(t):
    return _passages(t).withColumn("score", F.round("score", 6))


@query(
    "memories_by_date_w6",
    HITS.replace("WITH q", "WITH RECURSIVE q", 1)
    + WIDE
    + """, g AS (SELECT query_id, source, string_agg(content, chr(10) ORDER BY first) AS content FROM p GROUP BY ALL)
       SELECT query_id, string_agg(content, '|' ORDER BY source) AS memories, string_agg(source, ', ' ORDER BY source) AS dates FROM g GROUP BY query_id""",
)
def memories_by_date(t):
    out = R.group_by_date(_passages(t))
    return out.select("query_id", F.array_join("memories", "|").alias("memories"), "dates")
