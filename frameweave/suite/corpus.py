"""Queries for mixing, sampling and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameweave.functions.hashing import u
from frameweave.functions.text import words
from frameweave.operators import corpus as C
from frameweave.plans.staging import spread
from frameweave.suite.registry import query

U = "('0x' || substr(md5('{seed}:' || {id}), 1, 8))::BIGINT / 4294967296.0"


def u_sql(seed, ident):
    return U.format(seed=seed, id=ident)


@query(
    "uniform_draws",
    f"SELECT doc_id, round({u_sql(42, 'doc_id')}, 9) AS u FROM documents",
)
def uniform_draws(t):
    return t.documents.select("doc_id", F.round(u(42, "doc_id"), 9).alias("u"))


@query(
    "named_mixture_u1",
    """SELECT source_name, count(*) AS n, sum(length(text))::BIGINT AS chars FROM
         (SELECT 'documents' AS source_name, text FROM documents UNION ALL SELECT 'pages', html FROM pages
          UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY source_name""",
)
def named_mixture(t):
    registry = {
        "documents": lambda: t.documents,
        "pages": lambda: t.pages.withColumnRenamed("html", "text"),
        "conversations": lambda: t.conversations,
        "benchmark": lambda: t.benchmark,
    }
    rows = C.mixture("documents+pages+conversations", registry)
    return rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "weighted_mixture_u2",
    """WITH r AS (SELECT doc_id, source, unnest(range(1, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 0 ELSE 1 END + 1)) AS copy FROM documents)
       SELECT doc_id, source, copy FROM r ORDER BY doc_id, copy LIMIT 700""",
)
def weighted_mixture(t):
    rows = C.repeat_sources(t.documents.select("doc_id", "source"), "source", {"src0": 3, "src1": 0})
    return C.head_rows(rows, ["doc_id", "copy"], 700)


@query("distinct_keys_u3", "SELECT DISTINCT lang, source FROM documents")
def distinct_keys(t):
    return C.distinct_keys(t.documents, ["lang", "source"])


def _grouped(t):
    rows = t.documents.join(t.labels.withColumn("has", F.lit(True)), "doc_id", "left")
    rows = rows.select("doc_id", "n_chars", F.coalesce("has", F.lit(False)).alias("visual"))
    return C.length_groups(rows, "doc_id", "n_chars", "visual", 8, 4, 42)


@query(
    "length_groups_w11",
    f"""WITH d AS (SELECT doc_id, l.doc_id IS NOT NULL AS visual, {u_sql(42, 'd.doc_id')} AS u
                   FROM documents d LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)),
             o AS (SELECT *, row_number() OVER (PARTITION BY visual ORDER BY u, doc_id) - 1 AS seq, count(*) OVER (PARTITION BY visual) AS n FROM d)
        SELECT visual, CASE WHEN (seq // 32 + 1) * 32 <= n THEN seq // 32 ELSE -1 END AS megabatch, count(*) AS rows_in,
               count(DISTINCT doc_id) AS distinct_rows, CASE WHEN (seq // 32 + 1) * 32 <= n THEN 8 END AS lane_rows
        FROM o GROUP BY ALL""",
)
def length_groups(t):
    # Sizes and disjointness; the greedy deal itself is compared with brute force in the tests.
    lanes = _grouped(t).groupBy("visual", "megabatch", "lane").agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct("doc_id").alias("d")
    )
    return lanes.groupBy("visual", "megabatch").agg(
        F.sum("k").alias("rows_in"),
        F.sum("d").alias("distinct_rows"),
        F.when(F.col("megabatch") >= 0, F.max("k")).alias("lane_rows"),
    )


@query(
    "interleave_w12",
    """WITH i AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
            p AS (SELECT *, row_number() OVER (ORDER BY (i + 0.5) / n, n DESC, source, i) - 1 AS position, count(*) OVER () AS total FROM i)
       SELECT doc_id, source, position, position % 3 AS replica FROM p WHERE position < total // 3 * 3""",
)
def interleave(t):
    return C.interleave(t.documents.select("doc_id", "source"), "source", ["doc_id"], 3)


@query(
    "shard_shuffle_w13",
    f"""WITH p AS (SELECT doc_id, source, row_number() OVER (ORDER BY {u_sql(45, 'source')}, source, {u_sql(45, 'doc_id')}, doc_id) - 1 AS position,
                     count(*) OVER () AS n FROM documents)
        SELECT doc_id, source, position, floor(position / ceil(n / 7))::BIGINT AS worker FROM p""",
)
def shard_shuffle(t):
    return C.shard_shuffle(t.documents.select("doc_id", "source"), "source", "doc_id", 42, 3, 7)


@query(
    "stratified_sample_k1",
    f"""WITH q AS (SELECT lang, floor(count(*) * 120 / (SELECT count(*) FROM documents) + 1e-9) AS quota FROM documents GROUP BY lang),
             p AS (SELECT doc_id, lang, {u_sql(42, 'doc_id')} AS u FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)),
             r AS (SELECT p.*, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) <= quota THEN 1 ELSE 2 END AS pass FROM p JOIN q USING (lang)),
             f AS (SELECT *, row_number() OVER (ORDER BY pass, u, doc_id) AS pos FROM r)
        SELECT doc_id, lang, pass FROM f WHERE pos <= 120""",
)
def stratified_sample(t):
    exclude = t.benchmark.select(F.col("item_id").alias("doc_id"))
    return C.stratified_sample(t.documents.select("doc_id", "lang"), "doc_id", "lang", 120, 42, exclude)


@query(
    "fixed_groups_k2",
    f"""WITH o AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY source, {U.format(seed=42, id="source || ':' || doc_id")}, doc_id) - 1 AS seq,
                     count(*) OVER (PARTITION BY lang) AS n FROM documents)
        SELECT doc_id, lang, source, seq // 6 AS "group", seq % 6 AS place FROM o WHERE (seq // 6 + 1) * 6 <= n""",
)
def fixed_groups(t):
    return C.fixed_groups(t.documents.select("doc_id", "lang", "source"), "lang", "source", "doc_id", 6, 42)


@query(
    "equal_share_k3",
    """WITH s AS (SELECT source, count(*) AS c, row_number() OVER (ORDER BY source) - 1 AS s, count(*) OVER () AS k FROM documents GROUP BY source),
            w AS (SELECT source, c, s // (k // 3) AS worker FROM s WHERE s < k // 3 * 3),
            m AS (SELECT min(x) AS least FROM (SELECT sum(c) AS x FROM w GROUP BY worker)),
            r AS (SELECT d.doc_id, d.source, worker, row_number() OVER (PARTITION BY worker ORDER BY d.source, doc_id) - 1 AS place
                  FROM documents d JOIN w USING (source))
       SELECT doc_id, source, worker, place FROM r, m WHERE place < least""",
)
def equal_share(t):
    rows = t.documents.select("doc_id", "source")
    return C.equal_share(rows, "source", ["doc_id"], 3).select("doc_id", "source", "worker", "place")


@query(
    "token_blocks_k4",
    """WITH w AS (SELECT doc_id, unnest(list_append(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), '</s>')) AS tok,
                    generate_subscripts(list_append(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), '</s>'), 1) AS i FROM documents),
            o AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, count(*) OVER () AS n FROM w)
       SELECT pos // 512 AS block, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM o WHERE (pos // 512 + 1) * 512 <= n GROUP BY 1""",
)
def token_blocks(t):
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", words(F.col("text")).alias("tokens"))
    out = C.token_blocks(rows, ["doc_id"], "tokens", 512, F.lit("</s>"))
    return out.select("block", F.array_join("tokens", " ").alias("tokens"))


@query(
    "sequence_packs_k5",
    """WITH d AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS l, doc_id % 4 AS i FROM documents)
       SELECT count(*) AS placed, count(DISTINCT doc_id) AS documents, sum(l)::BIGINT AS tokens, sum(i)::BIGINT AS images,
              true AS within_limits FROM d WHERE l <= 2048 AND i <= 8""",
)
def sequence_packs(t):
    # Each row is kept once and no pack exceeds a limit; the packing is compared in the tests.
    rows = spread(t.documents.select("doc_id", "text")).select(
        "doc_id", F.size(words(F.col("text"))).alias("l"), (F.col("doc_id") % 4).alias("i")
    )
    packs = C.pack_sequences(rows, "doc_id", F.col("l"), F.col("i"), 2048, 8, 42, bucket_rows=10_000).where("pack is not null")
    per = packs.groupBy("bucket", "pack").agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct("doc_id").alias("d"), F.sum("length").alias("l"), F.sum("images").alias("i")
    )
    return per.agg(
        F.sum("k").alias("placed"),
        F.sum("d").alias("documents"),
        F.sum("l").alias("tokens"),
        F.sum("i").alias("images"),
        F.bool_and((F.col("l") <= 2048) & (F.col("i") <= 8)).alias("within_limits"),
    )


@query(
    "padded_batches_k6",
    """WITH c AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda w: length(w))[:64] AS ids,
                    (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS batch FROM conversations),
            m AS (SELECT batch, max(len(ids)) AS w FROM c GROUP BY batch)
       SELECT conv_id, turn, c.batch, w AS width, len(ids) AS mask_sum, list_sum(ids)::BIGINT AS id_sum FROM c JOIN m USING (batch)""",
)
def padded_batches(t):
    rows = t.conversations.select(
        "conv_id", "turn", F.transform(words(F.col("text")), lambda w: F.length(w)).alias("ids")
    )
    out = C.pad_batches(rows, ["conv_id", "turn"], "ids", 16, F.lit(0), 64)

    def added(c):
        return F.aggregate(F.col(c), F.lit(0), lambda s, x: s + x).cast("long")

    return out.select(
        "conv_id",
        "turn",
        "batch",
        F.size("ids").cast("long").alias("width"),
        added("attention_mask").alias("mask_sum"),
        added("ids").alias("id_sum"),
    )


@query(
    "image_stride_k7",
    """WITH p AS (SELECT page_id, 1 + page_id % 10 AS n FROM pages)
       SELECT page_id, CASE WHEN n = 8 THEN '0,2,4,6' WHEN n < 8 THEN array_to_string(range(n), ',') END AS images, n > 8 AS rejected FROM p""",
)
def image_stride(t):
    images = F.transform(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 10), lambda x: x.cast("string"))
    kept = C.stride_images(images)
    return t.pages.select("page_id", F.array_join(kept, ",").alias("images"), kept.isNull().alias("rejected"))


@query(
    "collated_batches_k8",
    """WITH c AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch FROM conversations)
       SELECT batch, count(*) AS n, string_agg(role, ',' ORDER BY conv_id, turn) AS roles,
              coalesce(string_agg(CASE WHEN role <> 'system' THEN length(text)::VARCHAR END, ',' ORDER BY conv_id, turn), '') AS lengths
       FROM c GROUP BY batch""",
)
def collated_batches(t):
    out = C.collate(
        t.conversations,
        ["conv_id", "turn"],
        {
            "id": F.col("conv_id"),
            "role": F.col("role"),
            "length": F.when(F.col("role") != "system", F.length("text").cast("string")),
        },
        8,
    )
    return out.select(
        "batch",
        F.size("id").cast("long").alias("n"),
        F.array_join("role", ",").alias("roles"),
        F.array_join("length", ",").alias("lengths"),
    )
