"""Queries for sources, sinks, filters and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.operators import selecting as S
from frameweave.plans.ordering import order_rows
from frameweave.plans.staging import staging_root
from frameweave.sources import annotations as A
from frameweave.sources import shards as H
from frameweave.sources import sinks as K
from frameweave.suite.registry import query


def scratch(spark, label: str) -> str:
    import uuid

    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "json_annotations_s1",
    """SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn
       FROM conversations GROUP BY role""",
)
def json_annotations(t):
    path = scratch(t.spark, "annotations")
    t.conversations.write.json(path)
    schema = T.StructType(
        [
            T.StructField("conv_id", T.LongType()),
            T.StructField("turn", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
    return (
        A.read_annotations(t.spark, path, schema)
        .groupBy("role")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length("text")).alias("chars"),
            F.max("turn").alias("last_turn"),
        )
    )


@query(
    "delimited_questions_s2",
    """SELECT p_brand, count(*) AS n, count(CASE WHEN p_size >= 10 THEN p_type END) AS typed
       FROM part GROUP BY p_brand""",
)
def delimited_questions(t):
    path = scratch(t.spark, "delimited")
    src = t.part.select(
        "p_partkey", "p_brand", F.when(F.col("p_size") < 10, "nan").otherwise(F.col("p_type")).alias("kind")
    )
    src.write.csv(path, sep="\t", header=True)
    schema = T.StructType(
        [
            T.StructField("p_partkey", T.LongType()),
            T.StructField("p_brand", T.StringType()),
            T.StructField("kind", T.StringType()),
        ]
    )
    return (
        A.read_delimited(t.spark, path, schema)
        .groupBy("p_brand")
        .agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("typed"))
    )


#: Turns that one nested record holds at most.
PAGE = 10_000


@query(
    "flatten_breakpoints_s3",
    """SELECT conv_id, role AS class, coalesce(lag(10 * turn + 10) OVER w, 0) AS start,
              10 * turn + 10 AS "end", length(text) AS question_chars
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def flatten_breakpoints(t):
    turns = t.conversations.withColumn("time", F.col("turn") * 10 + 10)
    # The start is carried over before the rows are cut into pages.
    ordered = order_rows(turns, ["conv_id"], ["turn"]).shift(1, before="time")
    item = F.struct(
        F.coalesce("before", F.lit(0)).alias("start"), "time", F.col("text").alias("question"), F.col("role").alias("class")
    )
    nested = ordered.pages(PAGE, breakpoint=item).select("conv_id", "breakpoint")
    flat = A.flatten_breakpoints(nested)
    return flat.select(
        "conv_id", "class", F.col("start").cast("long").alias("start"), "end", F.length("question").cast("long").alias("question_chars")
    )


def _document_shards(t, rows: int = 20):
    docs = order_rows(t.documents, ["source"], ["doc_id"]).df
    docs = docs.select(
        F.concat_ws("-", "source", F.floor(F.col("seq") / rows).cast("string")).alias("shard"),
        "doc_id",
        "text",
        "lang",
    )
    folder = scratch(t.spark, "shards")
    H.write_shards(docs, folder, "shard", "doc_id", {"txt": "text", "lang": "lang"}).count()
    return H.shard_listing(t.spark, folder)


@query(
    "tar_samples_s4",
    """SELECT doc_id, lang, length(text) AS chars FROM documents""",
)
def tar_samples(t):
    samples = H.read_listed(_document_shards(t))
    return samples.select(
        F.col("key").cast("long").alias("doc_id"),
        F.col("members")["lang"].cast("string").alias("lang"),
        F.length(F.col("members")["txt"].cast("string")).cast("long").alias("chars"),
    )


@query(
    "shard_catalog_s5",
    """WITH d AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS part FROM documents)
       SELECT source || '-' || part || '.tar' AS shard, count(*) AS nsamples, true AS hashed FROM d GROUP BY source, part""",
)
def shard_catalog(t):
    catalog = H.catalog_listed(_document_shards(t))
    return catalog.select(
        F.element_at(F.split("url", "/"), -1).alias("shard"),
        "nsamples",
        (F.length("md5sum") == 32).alias("hashed"),
    )


@query(
    "resolve_catalog_s6",
    """SELECT CASE WHEN s_suppkey % 2 = 0 THEN '/abs/' || s_name ELSE 'root/' || n_name || '/' || s_name END AS url,
              n_name AS name, (1 + n_regionkey)::DOUBLE AS weight, s_suppkey AS nsamples
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def resolve_catalog(t):
    # One catalog per region, one component per nation, one shard per supplier.
    shard = F.struct(
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/abs/"), "s_name"))
        .otherwise(F.col("s_name"))
        .alias("url"),
        F.col("s_suppkey").alias("nsamples"),
    )
    sold = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = order_rows(sold, ["n_regionkey", "n_name"], ["s_suppkey"]).pages(1000, shardlist=shard)
    # At most one component per nation in a catalog; more suppliers give more catalogs.
    catalogs = part.groupBy("n_regionkey", "page").agg(
        F.collect_list(
            F.struct(
                F.col("n_name").alias("name"),
                (F.col("n_regionkey") + 1.0).alias("weight"),
                F.concat(F.lit("root/"), "n_name").alias("base"),
                "shardlist",
            )
        ).alias("datasets")
    )
    empty = F.array().cast("array<struct<url:string,nsamples:bigint>>")
    catalogs = catalogs.select(
        F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("base"),
        empty.alias("shardlist"),
        "datasets",
    )
    return H.resolve_catalog(catalogs).select("url", "name", "weight", "nsamples")


@query(
    "catalog_summary_s7",
    """WITH s AS (SELECT source AS url, count(*) AS nsamples, sum(n_chars)::BIGINT AS filesize
                  FROM documents GROUP BY source)
       SELECT count(*) AS n_shards, sum(nsamples)::BIGINT AS total_samples, sum(filesize)::BIGINT AS total_bytes,
              round(avg(nsamples), 6) AS avg_samples, round(avg(filesize), 6) AS avg_bytes,
              round(sum(filesize) / sum(nsamples), 6) AS bytes_per_sample,
              min(url) AS first_shard, max(url) AS last_shard FROM s""",
)
def catalog_summary(t):
    shards = t.documents.groupBy(F.col("source").alias("url")).agg(
        F.count(F.lit(1)).alias("nsamples"), F.sum("n_chars").alias("filesize")
    )
    return H.catalog_summary(shards)


@query(
    "merge_keep_saved_s8",
    """SELECT doc_id, 'label-' || quality AS result FROM labels
       UNION ALL SELECT doc_id, lang AS result FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def merge_keep_saved(t):
    saved = t.labels.select("doc_id", F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("result"))
    new = t.documents.select("doc_id", F.col("lang").alias("result"))
    return K.merge_keep_saved(saved, new, ["doc_id"])


@query(
    "merge_chunks_s9",
    """WITH a AS (SELECT doc_id, 0 AS chunk, lang AS result FROM documents
                  UNION ALL SELECT doc_id, 1, 'label-' || quality FROM labels
                  UNION ALL SELECT item_id, 2, 'benchmark' FROM benchmark)
       SELECT doc_id, chunk, result FROM
         (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk DESC) AS r FROM a) WHERE r = 1""",
)
def merge_chunks(t):
    chunks = [
        t.documents.select("doc_id", F.col("lang").alias("result")),
        t.labels.select("doc_id", F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("result")),
        t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("result")),
    ]
    return K.merge_chunks(chunks, ["doc_id"], "doc_id")


@query(
    "concat_chunks_s9",
    """SELECT chunk, count(*) AS n, sum(chars)::BIGINT AS chars FROM
         (SELECT 0 AS chunk, length(text) AS chars FROM documents
          UNION ALL SELECT 1, length(text) FROM benchmark
          UNION ALL SELECT 2, length(text) FROM conversations) GROUP BY chunk""",
)
def concat_chunks(t):
    chunks = [t.documents.select("text"), t.benchmark.select("text"), t.conversations.select("text")]
    rows = K.concat_chunks(chunks)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "missing_media_s10",
    """SELECT page_id, url FROM pages WHERE page_id NOT IN
         (SELECT doc_id FROM documents WHERE lang IN ('en', 'de', 'fr'))""",
)
def missing_media(t):
    ext = (
        F.when(F.col("lang") == "en", "mp4")
        .when(F.col("lang") == "fr", "MKV")
        .when(F.col("lang") == "de", "webm")
        .otherwise("txt")
    )
    files = t.documents.select(
        F.concat(F.lit("/media/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path")
    )
    wanted = t.pages.select("page_id", "url", F.col("page_id").cast("string").alias("stem"))
    return K.missing_media(wanted, files, "stem", "path", ["mp4", "mkv", "webm"]).drop("stem")


@query(
    "quarantine_s11",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no sidecar' WHEN d.n_chars < 200 THEN 'truncated'
                             WHEN l.toxic = 1 THEN 'unreadable' END AS reason
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def quarantine(t):
    rows = t.documents.join(t.labels.withColumn("has", F.lit(True)), "doc_id", "left")
    rules = {
        "no sidecar": F.col("has").isNull(),
        "truncated": F.col("n_chars") < 200,
        "unreadable": F.col("toxic") == 1,
    }
    return K.quarantine(rows, rules).select("doc_id", "reason")


# ---- P ---------------------------------------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "cumulative_levels_p1",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderstatus IN ('F', 'O')
       GROUP BY ALL""",
)
def cumulative_levels(t):
    kept = S.filter_levels(
        t.orders,
        {"o_orderpriority": (PRIORITIES, "3-MEDIUM"), "o_orderstatus": (("F", "O", "P"), "O")},
    )
    return kept.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fraction_subset_p2",
    """SELECT doc_id, seq FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq,
                                count(*) OVER () AS n FROM documents)
       WHERE seq >= floor(n * 0.25) AND seq < floor(n * 0.75)""",
)
def fraction_subset(t):
    return S.fraction(t.documents.select("doc_id"), ["doc_id"], 0.25, 0.75)


@query(
    "worker_splits_p3_p4",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS s, count(*) OVER () AS n,
                         ntile(7) OVER (ORDER BY doc_id) - 1 AS even_chunk,
                         ntile(14) OVER (ORDER BY doc_id) - 1 AS piece FROM documents)
       SELECT doc_id, floor(s / ceil(n / 7))::BIGINT AS ceil_chunk, least(s // (n // 7), 6) AS floor_chunk,
              s % 7 AS strided, even_chunk, CASE WHEN piece < 7 THEN piece ELSE 13 - piece END AS zigzag FROM a""",
)
def worker_splits(t):
    rows = order_rows(t.documents.select("doc_id"), [], ["doc_id"], size="n").df
    splits = S.split_columns(F.col("seq"), F.col("n"), 7)
    return rows.select("doc_id", *[c.cast("long").alias(k) for k, c in splits.items()])


@query(
    "option_rounds_p5",
    """WITH o AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN [p_name]
                    WHEN p_size < 20 THEN [p_name, p_brand]
                    WHEN p_size < 35 THEN [p_name, p_brand, p_type]
                    ELSE [p_name, p_brand, p_type, p_size::VARCHAR] END AS o FROM part),
            r AS (SELECT p_partkey, o, len(o) AS n, unnest(range(len(o))) AS round FROM o)
       SELECT p_partkey, round, n AS n_options, array_to_string(list_concat(o[round + 1:], o[:round]), '|') AS shown,
              CASE WHEN n >= 2 THEN chr((65 + (1 - round + n) % n)::INT) END AS answer_letter FROM r""",
)
def option_rounds(t):
    size = F.col("p_size")
    rows = t.part.select(
        "p_partkey",
        F.col("p_name").alias("A"),
        F.when(size < 5, "nan").otherwise(F.col("p_brand")).alias("B"),
        F.when(size >= 20, F.col("p_type")).otherwise("None").alias("C"),
        F.when(size >= 35, size.cast("string")).alias("D"),
        F.lit("B").alias("right"),
    )
    out = S.option_rounds(rows, ["A", "B", "C", "D"], answer="right")
    return out.select(
        "p_partkey",
        F.col("round").cast("long").alias("round"),
        F.col("n_options").cast("long").alias("n_options"),
        F.array_join("options", "|").alias("shown"),
        "answer_letter",
    )


@query(
    "readable_words_p6",
    """WITH w AS (SELECT l_orderkey AS image, l_linenumber AS line, l_shipdate, l_partkey,
                         CASE WHEN l_returnflag = 'N' THEN '.' ELSE l_returnflag || l_linenumber END AS text,
                         l_quantity AS width, floor(100 * l_discount + 0.5) + 1 AS height, l_linestatus = 'O' AS legible,
                         l_tax >= 0.07 AS vertical FROM lineitem),
            k AS (SELECT image, width * height AS area FROM w WHERE text <> '.' AND legible AND NOT vertical
                  AND width * height >= 5000 * 0.01 AND width * height >= 60)
       SELECT image, count(*) AS words, round(sum(area), 4) AS area FROM k GROUP BY image""",
)
def readable_words(t):
    x, y = F.col("l_linenumber") * 10.0, (F.col("l_suppkey") % 50) * 1.0
    w, h = F.col("l_quantity"), F.floor(F.col("l_discount") * 100 + 0.5) + 1.0
    corners = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    words = t.lineitem.select(
        F.col("l_orderkey").alias("image"),
        F.when(F.col("l_returnflag") == "N", ".")
        .otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
        .alias("text"),
        corners.alias("vertices"),
        (F.col("l_linestatus") == "O").alias("legible"),
        (F.col("l_tax") >= 0.07).alias("vertical"),
    )
    kept = S.keep_readable_words(
        words, "image", "text", "vertices", F.lit(5000.0), 0.01, 60.0, "legible", "vertical"
    )
    return kept.groupBy("image").agg(
        F.count(F.lit(1)).alias("words"), F.round(F.sum("area"), 4).alias("area")
    )


@query(
    "nest_questions_p7",
    """SELECT conv_id, 0 AS page, count(*) AS n, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS items
       FROM conversations GROUP BY conv_id""",
)
def nest_questions(t):
    nested = S.nest_rows(
        t.conversations,
        ["conv_id"],
        ["turn"],
        {"item": F.concat(F.col("role"), F.lit(":"), F.length("text").cast("string"))},
    )
    return nested.select(
        "conv_id", "page", F.size("item").cast("long").alias("n"), F.array_join("item", "|").alias("items")
    )


@query(
    "media_token_p8",
    """WITH c AS (SELECT conv_id, turn, replace(text, 'the', 'THE') AS text FROM conversations),
            h AS (SELECT conv_id, bool_or(contains(text, 'THE')) AS has, min(turn) AS f FROM c GROUP BY conv_id)
       SELECT conv_id, turn, CASE WHEN NOT has AND turn = f THEN 'THE' || chr(10) || text ELSE text END AS text
       FROM c JOIN h USING (conv_id)""",
)
def media_token(t):
    turns = t.conversations.select("conv_id", "turn", "text")
    return S.place_media_token(turns, "conv_id", "turn", "text", "THE", "the", "THE")


@query(
    "flatten_nested_p9",
    """SELECT conv_id, role AS "meta/role", turn AS "meta/place/turn", length(text) AS "meta/chars"
       FROM conversations""",
)
def flatten_nested(t):
    meta = F.struct(
        "role", F.struct("turn").alias("place"), F.length("text").cast("long").alias("chars")
    ).alias("meta")
    return A.flatten_nested(t.conversations.select("conv_id", meta))
