"""Queries over text columns and dialogue turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameweave.functions import text as X
from frameweave.operators import conversations as C
from frameweave.plans.ordering import order_rows
from frameweave.plans.staging import spread
from frameweave.sources.sinks import merge_keep_saved
from frameweave.suite.registry import query


@query(
    "choice_letter_t1",
    """WITH s AS (SELECT doc_id, replace(replace(replace(trim(text), 'The best answer is', ''), 'The answer is', ''), 'The answer', '') AS s FROM documents)
       SELECT doc_id, regexp_extract(s, '[ABCD]') AS letter FROM s""",
)
def choice_letter(t):
    return t.documents.select("doc_id", X.choice_letter(F.col("text")).alias("letter"))


@query(
    "parse_choice_t2",
    """WITH b AS (SELECT p_partkey, p_partkey % 5 AS k, p_size % 4 AS i, (p_size + 1) % 4 AS j,
                    ('0x' || substr(md5('42:' || p_partkey), 1, 8))::BIGINT / 4294967296.0 AS u FROM part)
       SELECT p_partkey, chr((65 + CASE k WHEN 0 THEN j WHEN 1 THEN i WHEN 2 THEN j WHEN 3 THEN i ELSE floor(u * 4) END)::INT) AS choice FROM b""",
)
def parse_choice(t):
    k, i, j = F.col("p_partkey") % 5, F.col("p_size") % 4, (F.col("p_size") + 1) % 4
    options = F.array(*[F.lit(o) for o in ("red fox", "blue whale", "green frog", "grey wolf")])
    a, b = F.char(65 + i), F.char(65 + j)
    response = (
        F.when(k == 0, F.concat(F.lit("Not ("), a, F.lit(") but ("), b, F.lit(").")))
        .when(k == 1, F.concat(a, F.lit(".")))
        .when(k == 2, F.concat(F.lit("choose "), a, F.lit(" or rather "), b, F.lit(" here!")))
        .when(k == 3, F.concat(F.lit("we can see in the picture one "), F.upper(F.get(options, i.cast("int")))))
        .otherwise("no idea")
    )
    choice = X.parse_choice(response, ["A", "B", "C", "D"], options, 42, F.col("p_partkey"))
    return t.part.select("p_partkey", choice.alias("choice"))


@query(
    "open_answer_t3",
    """SELECT o_orderkey, o_orderkey % 4 <> 0 AS correct FROM orders""",
)
def open_answer(t):
    price = F.round(F.col("o_totalprice"), 2)
    other = F.format_number(price + 17, 2)
    response = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("First we add.\nSo the total is "), other))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Two steps.\nthus the sum = "), F.format_number(price, 2), F.lit(".")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("The answer is "), price.cast("decimal(15,2)").cast("string"), F.lit(" dollars")))
        .otherwise(F.concat(F.lit("It could be of kind "), F.lower("o_orderpriority")))
    )
    gold = F.array(price.cast("decimal(15,2)").cast("string"), F.col("o_orderpriority"))
    return spread(t.orders).select("o_orderkey", X.open_correct(gold, X.parse_open(response)).alias("correct"))


@query(
    "science_answer_t4",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN chr((65 + n_chars % 5)::INT) ELSE 'FAILED' END AS answer,
              CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN n_chars % 5 < 4 THEN n_chars % 5 ELSE -1 END ELSE -1 END AS idx
       FROM documents""",
)
def science_answer(t):
    k, letter = F.col("doc_id") % 5, F.char(65 + F.col("n_chars") % 5)
    text = (
        F.when(k == 0, "B")
        .when(k == 1, "C. because of it")
        .when(k == 2, F.concat(F.lit("We think. The answer is "), letter, F.lit(".")))
        .when(k == 3, "The answer is A. The answer is B.")
        .otherwise("nothing")
    )
    options = ["A", "B", "C", "D", "E"]
    rows = t.documents.select("doc_id", X.science_answer(text, options).alias("answer"))
    return rows.withColumn("idx", X.option_index(F.col("answer"), options, F.lit(4)))


@query(
    "yes_no_t5",
    """WITH s AS (SELECT doc_id, string_split(replace(string_split(text, '.')[1], ',', ''), ' ') AS w, text[:4] AS h FROM documents)
       SELECT doc_id, CASE WHEN list_has_any(w, ['No', 'not', 'no']) THEN 'no' ELSE 'yes' END AS by_sentence,
              CASE WHEN contains(h, 'yes') THEN 'yes' WHEN contains(h, 'no') THEN 'no' ELSE 'other' END AS by_prefix FROM s""",
)
def yes_no(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", X.yes_no_sentence(text).alias("by_sentence"), X.yes_no_prefix(text).alias("by_prefix")
    )


def _quote(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_map(values):
    keys, vals = ", ".join(map(_quote, values)), ", ".join(map(_quote, values.values()))
    return f"MAP([{keys}], [{vals}])"


CANONICAL_SQL = f"""
WITH s AS (SELECT conv_id, turn, trim(translate(regexp_replace(replace(replace(replace(lower(text), ',', ''), '?', ''), '''s', ' ''s'),
             '^\\s+|\\s+$', '', 'g'), chr(10) || chr(9), '  ')) AS base FROM conversations),
     p AS (SELECT conv_id, turn, list_reduce([{", ".join(map(_quote, X.MARKS))}], lambda acc, m: replace(acc, m,
             CASE WHEN contains(base, m || ' ') OR contains(base, ' ' || m) OR regexp_matches(base, '\\d,+\\d') THEN '' ELSE ' ' END), base) AS o FROM s),
     d AS (SELECT conv_id, turn, replace(replace(regexp_replace(o, '\\.(\\d)', chr(1) || '\\1', 'g'), '.', ''), chr(1), '.') AS o FROM p),
     w AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(lower(o), '\\s+'), lambda x: x <> ''),
             lambda x: coalesce({_sql_map(X.NUMBER_WORDS)}[x], x)) AS w FROM d)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(w, lambda x: x NOT IN ('a', 'an', 'the')),
         lambda x: coalesce({_sql_map(X.CONTRACTIONS)}[x], x)), ' ') AS answer FROM w
"""


@query("canonical_answer_t6", CANONICAL_SQL)
def canonical_answer(t):
    return spread(t.conversations).select("conv_id", "turn", X.canonical_answer(F.col("text")).alias("answer"))


@query(
    "relaxed_accuracy_t7",
    """WITH b AS (SELECT l_returnflag, l_linenumber, l_extendedprice AS p, l_extendedprice * (0.9 + l_discount * 2) AS a FROM lineitem)
       SELECT l_returnflag, l_linenumber, count(*) AS n,
              round(avg(CASE WHEN l_linenumber % 3 = 0 OR abs(round(a, 2) - p) / p <= 0.05 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM b GROUP BY ALL""",
)
def relaxed_accuracy(t):
    price = F.col("l_extendedprice")
    answer = F.round(price * (F.col("l_discount") * 2 + 0.9), 2).cast("string")
    notes = F.array(
        price.cast("string"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), answer)).otherwise("n/a")
    )
    ok = X.best_relaxed(answer, F.transform(notes, F.trim))
    return spread(t.lineitem).groupBy("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy")
    )


@query(
    "edit_similarity_t8",
    """WITH b AS (SELECT p_partkey, p_name, lower(p_type) AS k, ['red widget', 'small ring', 'blue bolt', 'hot gear'] AS c FROM part),
            s AS (SELECT *, 1 - levenshtein(p_name, 'small gear') / greatest(length(p_name), 10) AS r,
                    list_sort(list_transform(range(4), lambda i: [levenshtein(p_name, c[i + 1]), i]))[1] AS best FROM b)
       SELECT p_partkey, round(CASE WHEN r >= 0.5 THEN r ELSE 0 END, 6) AS anls, c[best[2] + 1] AS closest FROM s""",
)
def edit_similarity(t):
    choices = F.array(*[F.lit(c) for c in ("red widget", "small ring", "blue bolt", "hot gear")])
    return t.part.select(
        "p_partkey",
        F.round(X.edit_similarity(F.col("p_name"), F.lit(" Small Gear ")), 6).alias("anls"),
        X.closest(F.col("p_name"), choices).alias("closest"),
    )


@query(
    "typed_answer_t9",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE p_size % 2 WHEN 0 THEN p_name ELSE p_brand END
                 WHEN 1 THEN floor(p_retailprice)::BIGINT::VARCHAR WHEN 2 THEN round(p_retailprice, 1)::VARCHAR ELSE p_type END AS answer FROM part""",
)
def typed_answer(t):
    k = F.col("p_partkey") % 4
    extraction = (
        F.when(k == 0, F.when(F.col("p_size") % 2 == 0, "(a) that one").otherwise(" B "))
        .when(k.isin(1, 2), F.col("p_retailprice").cast("string"))
        .otherwise(F.col("p_type"))
    )
    answer = X.typed_answer(
        extraction,
        F.array("p_name", "p_brand"),
        F.when(k == 0, "multi_choice").otherwise("free_form"),
        F.when(k == 1, "integer").when(k == 2, "float").otherwise("text"),
        F.lit(1),
    )
    return t.part.select("p_partkey", answer.alias("answer"))


@query(
    "judge_reply_t10",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN CASE WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'no' END END AS pred,
              CASE WHEN doc_id % 4 < 2 THEN (n_chars % 6)::DOUBLE END AS score,
              CASE doc_id % 4 WHEN 2 THEN 'not readable' WHEN 3 THEN 'no object' END AS reject, true AS asked FROM documents""",
)
def judge_reply(t):
    k = F.col("doc_id") % 4
    verdict = F.when(F.col("n_chars") % 2 == 0, "yes").otherwise("no")
    good = F.concat(
        F.lit("{'llama_pred': '"), verdict, F.lit("', 'score': "), (F.col("n_chars") % 6).cast("string"), F.lit("}")
    )
    reply = (
        F.when(k == 0, F.concat(F.lit("Here: "), good, F.lit(" done")))
        .when(k == 1, F.concat(F.lit("{'llama_pred': 'maybe', 'score': 9} or "), good))
        .when(k == 2, "{'llama_pred': yes")
        .otherwise("yes, 5")
    )
    reply = F.when(k == 2, F.concat(reply, F.lit("}"))).otherwise(reply)
    prompt = X.judge_prompt(F.col("lang"), F.col("source"), F.col("text"))
    return t.documents.select(
        "doc_id", X.judge_reply(reply).alias("r"), F.contains(prompt, F.col("text")).alias("asked")
    ).select("doc_id", "r.pred", "r.score", "r.reject", "asked")


CUT_SQL = """
WITH p AS (SELECT doc_id, string_split(text, '.') AS parts, string_split(lower(text), '.') AS low FROM documents),
     f AS (SELECT doc_id, parts, list_position(list_transform(low, lambda x, i: list_position(low, x) < i), true) AS first FROM p),
     c AS (SELECT doc_id, array_to_string(CASE WHEN first IS NULL OR first = 0 THEN parts ELSE parts[:first - 1] END, '.') AS caption FROM f)
"""


@query("cut_repetition_t11", CUT_SQL + "SELECT * FROM c")
def cut_repetition(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", X.cut_repetition(F.col("text")).alias("caption"))


@query(
    "prompt_work_list_t12",
    CUT_SQL
    + """SELECT doc_id, 'done' AS prompt FROM labels UNION ALL
         SELECT doc_id, 'Write questions about: ' || caption FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def prompt_work_list(t):
    done = t.labels.select("doc_id", F.lit("done").alias("prompt"))
    todo = t.documents.join(done, "doc_id", "left_anti")
    new = todo.select("doc_id", F.concat(F.lit("Write questions about: "), X.cut_repetition(F.col("text"))).alias("prompt"))
    return merge_keep_saved(done, new, ["doc_id"])


@query(
    "sentences_t13",
    """WITH a AS (SELECT doc_id, regexp_replace(text, '([﹒﹔﹖﹗．。！？?.!]["’”」』]{0,2})', '\\1' || chr(1), 'g') AS s FROM documents),
            b AS (SELECT doc_id, regexp_replace(s, chr(1) || '([﹒﹔﹖﹗．。！？?.!"’”」』‘“「『]|$)', '\\1', 'g') AS s FROM a),
            c AS (SELECT doc_id, string_split(regexp_replace(s, chr(1) || '([﹒﹔﹖﹗．。！？?.!"’”」』‘“「『]|$)', '\\1', 'g'), chr(1)) AS p FROM b)
       SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS pos FROM c""",
)
def sentences(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query("document_chunks_t13")
def document_chunks(t):
    chunk = X.document_chunks(500, 150, ("!", "?", "।", ".", " "))
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(chunk("text")).alias("pos", "chunk"))


# ---- dialogue ----------------------------------------------------------------------------------

DIALOGUE = """
WITH q AS (SELECT a.conv_id % 10 AS "user", DATE '2024-01-01' + a.turn::INT AS date, a.conv_id AS ord, a.text AS query, b.text AS response
           FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
           WHERE a.role = 'user' AND b.role = 'assistant')
"""


def dialogue(t):
    """Turns of a user-day: a user turn with the assistant turn that follows it."""
    c = t.conversations
    asked = c.where("role = 'user'").select(
        (F.col("conv_id") % 10).alias("user"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).alias("date"),
        F.col("conv_id").alias("ord"),
        F.col("text").alias("query"),
        "conv_id",
        (F.col("turn") + 1).alias("turn"),
    )
    told = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response"))
    return asked.join(told, ["conv_id", "turn"]).drop("conv_id", "turn")


def day_summaries(t):
    """Summary table for days 1, 3, 5, ... of each user."""
    days = dialogue(t).groupBy("user", "date").agg(F.count(F.lit(1)).alias("n"))
    odd = F.datediff("date", F.lit("2024-01-01")) % 2 == 0
    return days.where(odd).select("user", "date", F.concat(F.lit("talked "), F.col("n").cast("string")).alias("content"))


SUMMARIES = """, s AS (SELECT "user", date, 'talked ' || count(*) AS content FROM q
                       WHERE (date - DATE '2024-01-01') % 2 = 0 GROUP BY ALL)"""


@query(
    "memory_documents_t14",
    DIALOGUE
    + SUMMARIES
    + """SELECT "user", date::VARCHAR AS source, ord, 'Conversation content on ' || date || ':[|User|]: ' || trim(query) || '; [|AI|]: ' || trim(response) AS content FROM q
         UNION ALL SELECT "user", date::VARCHAR, NULL, 'The summary of the conversation on ' || date || ' is: ' || content FROM s""",
)
def memory_documents(t):
    return C.memory_documents(dialogue(t), day_summaries(t))


@query(
    "day_documents_t14",
    DIALOGUE
    + SUMMARIES
    + """SELECT q."user", q.date::VARCHAR AS source, 0 AS page, 'Conversation on ' || q.date || ': ' ||
                string_agg(chr(10) || q."user" || ': ' || trim(query) || chr(10) || 'AI: ' || trim(response), '' ORDER BY ord) || chr(10) ||
                coalesce('The summary of the conversation on ' || q.date || ' is: ' || any_value(s.content), '') AS content
         FROM q LEFT JOIN s ON q."user" = s."user" AND q.date = s.date GROUP BY q."user", q.date""",
)
def day_documents(t):
    return C.day_documents(dialogue(t), day_summaries(t))


@query(
    "memory_prompt_t15",
    """WITH w AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN text END) AS personality, min(turn) AS d FROM conversations GROUP BY conv_id),
            p AS (SELECT w.*, text AS related, CASE WHEN conv_id % 2 = 0 THEN 'calm talks' ELSE '' END AS summary FROM w LEFT JOIN benchmark ON item_id = conv_id),
            x AS (SELECT conv_id, 0 AS part, 0 AS turn, CASE WHEN summary <> '' AND trim(related) <> '' AND trim(personality) <> ''
                    THEN 'Summary of past talks: ' || summary || chr(10) || 'User: ' || personality || chr(10) || 'Related memory (' || d || '):' || chr(10) || related || chr(10)
                    WHEN trim(related) <> '' THEN 'Related memory (' || d || '):' || chr(10) || related || chr(10) ELSE '' END AS piece FROM p
                  UNION ALL SELECT conv_id, 1, turn, chr(10) || ' [|' || role || '|]: ' || text FROM conversations
                  UNION ALL SELECT conv_id, 2, 0, chr(10) || ' [|User|]: And then? ' || chr(10) || ' [|AI|]: ' FROM w)
       SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1 AS seq, piece FROM x WHERE piece <> ''""",
)
def memory_prompt(t):
    """Prompts over whole histories, as ordered pieces: a writer streams them, and none is gathered."""
    line = F.concat(F.lit("\n [|"), F.col("role"), F.lit("|]: "), F.col("text"))
    who = t.conversations.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "system", F.col("text"))).alias("personality"), F.min("turn").alias("d")
    )
    related = t.benchmark.select(F.col("item_id").alias("conv_id"), F.col("text").alias("related"))
    rows = who.join(related, "conv_id", "left")
    summary = F.when(F.col("conv_id") % 2 == 0, "calm talks").otherwise("")
    ends = C.prompt_ends(F.lit("And then?"), F.col("related"), F.col("d").cast("string"), summary, F.col("personality"))
    history = t.conversations.select("conv_id", "turn", line.alias("piece"))
    return C.memory_prompt_rows(history, rows.select("conv_id", *ends), "conv_id", ["turn"]).drop("turn")


def _turns(t):
    return t.conversations.select("conv_id", "turn", (F.col("role") == "assistant").cast("int").alias("speaker"), "text")


RENDER = """
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, (role = 'assistant')::INT AS sp, text FROM conversations),
     g AS (SELECT conv_id, bool_and(sp = seq % 2) AS good FROM c GROUP BY conv_id)
"""


@query(
    "render_two_t16",
    RENDER
    + """SELECT conv_id, 0 AS page, ' ' || string_agg(CASE WHEN sp = 1 THEN 'ASSISTANT' ELSE 'USER' END || ': ' || text ||
                CASE WHEN seq % 2 = 1 THEN '</s>' ELSE ' ' END, '' ORDER BY seq) AS prompt, false AS rejected FROM c GROUP BY conv_id""",
)
def render_two(t):
    return C.render(_turns(t), "conv_id", ["turn"], "speaker", "text", C.STYLES["two"])


@query(
    "render_strict_t16",
    RENDER
    + """SELECT conv_id, 0 AS page, CASE WHEN good THEN string_agg(CASE WHEN sp = 1 THEN '<start_of_turn>model' ELSE '<start_of_turn>user' END || chr(10) || text ||
                '<end_of_turn>' || chr(10), '' ORDER BY seq) END AS prompt, NOT good AS rejected FROM c JOIN g USING (conv_id) GROUP BY conv_id, good""",
)
def render_strict(t):
    return C.render(_turns(t), "conv_id", ["turn"], "speaker", "text", C.STYLES["gemma"])


@query(
    "training_labels_t17",
    """WITH c AS (SELECT conv_id, turn, (role = 'assistant')::INT AS sp, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n,
                    min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations),
            k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM c WHERE NOT (turn = f AND sp = 1)),
            g AS (SELECT conv_id, bool_and(sp = seq % 2) AS good, sum(n)::BIGINT AS tokens, sum(n * sp)::BIGINT AS told FROM k GROUP BY conv_id)
       SELECT conv_id, tokens, CASE WHEN good THEN told ELSE 0 END AS labelled FROM g""",
)
def training_labels(t):
    turns = _turns(t).withColumn("ids", F.transform(X.words(F.col("text")), lambda w: F.length(w)))
    out = C.training_labels(turns.drop("text"), "conv_id", ["turn"], "speaker", "ids")
    return out.groupBy("conv_id").agg(
        F.sum(F.size("input_ids")).alias("tokens"),
        F.sum(F.size(F.filter("labels", lambda x: x != C.IGNORE))).alias("labelled"),
    )


@query(
    "completion_labels_t17",
    """WITH c AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda w: length(w)) AS ids FROM conversations),
            m AS (SELECT *, list_max(list_filter(range(len(ids)), lambda i: ids[i + 1] = 3 AND ids[i + 2] = 2)) AS last FROM c)
       SELECT conv_id, turn, CASE WHEN last IS NULL THEN 0 ELSE len(ids) - last - 2 END AS labelled FROM m""",
)
def completion_labels(t):
    ids = F.transform(X.words(F.col("text")), lambda w: F.length(w))
    labels = C.completion_labels(ids, [3, 2])
    n = F.size(F.filter(labels, lambda x: x != C.IGNORE)).cast("long")
    return spread(t.conversations).select("conv_id", "turn", n.alias("labelled"))


INTERLEAVED = """
WITH b AS (SELECT doc_id, string_split(text, chr(10)) AS s, list_transform(range(doc_id % 9), lambda j: (doc_id + 3 * j) % len(string_split(text, chr(10)))) AS m FROM documents)
"""


def _interleaved(t):
    lines = F.split("text", "\n")
    images = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(8)), lambda j: j < F.col("doc_id") % 9),
        lambda j: (F.col("doc_id") + 3 * j) % F.size(lines),
    )
    return t.documents.select("doc_id", lines.alias("s"), images.alias("m"))


@query(
    "interleaved_text_t18",
    INTERLEAVED
    + """SELECT doc_id, replace(replace(array_to_string(list_transform(s, lambda x, i: repeat('<image>' || chr(10), len(list_filter(m[:6], lambda k: k = i - 1))) || x), ' '),
                '<image> ', '<image>'), ' <image>', '<image>') || '</s>' AS text,
              array_to_string(list_transform(list_sort(list_transform(m[:6], lambda k, i: k * 1000 + i - 1)), lambda k: k % 1000), ',') AS image_order FROM b""",
)
def interleaved_text(t):
    order = F.transform(C.image_order(F.col("m"), 6), lambda i: i.cast("string"))
    return _interleaved(t).select(
        "doc_id",
        C.interleaved_text(F.col("s"), F.col("m"), max_images=6, end="</s>").alias("text"),
        F.array_join(order, ",").alias("image_order"),
    )


@query(
    "recover_turns_t19",
    """WITH c AS (SELECT a.conv_id, a.turn, replace(a.text, chr(10), ' ') AS q1, replace(b.text, chr(10), ' ') AS a1 FROM conversations a JOIN conversations b
                  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
       SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'human=<image>' || chr(10) || q1 || '|gpt=' || a1 || '|human=and more' || '|gpt=the end'
              ELSE 'human=' || repeat('<image>' || chr(10), (conv_id % 3)::INT) || q1 || '|gpt=the end' END AS turns FROM c""",
)
def recover_turns(t):
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    first = t.conversations.select("conv_id", "turn", flat.alias("q1"))
    second = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), flat.alias("a1"))
    rows = first.join(second, ["conv_id", "turn"])
    question = F.when(
        F.col("conv_id") % 2 == 0,
        F.concat(
            F.lit("Image Descriptions: x\nQuestion: "), "q1", F.lit("\nAnswer: "), "a1", F.lit("\nQuestion: and\n more")
        ),
    ).otherwise(F.concat(F.lit("<image>\n"), "q1"))
    turns = C.recover_turns(question, F.lit("the end"), F.col("conv_id") % 3)
    shown = F.transform(turns, lambda x: F.concat(x["from"], F.lit("="), x["value"]))
    return rows.select("conv_id", "turn", F.array_join(shown, "|").alias("turns"))


@query(
    "chat_messages_t20",
    DIALOGUE
    + """SELECT "user", date, ord, 'user:' || length(query) || ',assistant:' || length(response) AS messages FROM q""",
)
def chat_messages(t):
    messages = C.chat_messages(F.col("query"), F.col("response"))
    shown = F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string")))
    return dialogue(t).select("user", "date", "ord", F.array_join(shown, ",").alias("messages"))


@query(
    "length_estimates_t21",
    """WITH c AS (SELECT conv_id, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS w, bool_or(role = 'system') AS m FROM conversations GROUP BY conv_id)
       SELECT conv_id, w + CASE WHEN m THEN 128 ELSE 0 END AS length, CASE WHEN m THEN w ELSE -w END AS modality_length FROM c""",
)
def length_estimates(t):
    return C.length_estimates(t.conversations, "conv_id", "text", F.col("role") == "system")


@query(
    "interleaved_length_t21",
    INTERLEAVED
    + """SELECT doc_id, len(m[:6]) * 196 // 2 + coalesce(list_sum(list_transform(m[:6], lambda k: length(s[k + 1]))), 0)::BIGINT AS length FROM b""",
)
def interleaved_length(t):
    return _interleaved(t).select("doc_id", C.interleaved_length(F.col("s"), F.col("m"), 196, max_images=6).alias("length"))


@query(
    "choice_prompt_t22",
    """SELECT p_partkey, 'Question: which <image 1> or <image 2>?' || chr(10) || 'Options:' || chr(10) || '(A) ' || p_name || chr(10) || '(B) ' || p_brand || chr(10) || '(C) ' || p_type AS prompt,
              CASE WHEN p_size % 2 = 0 THEN '(B) ' || p_brand ELSE '(C) ' || p_type END AS answer FROM part""",
)
def choice_prompt(t):
    options = F.array("p_name", "p_brand", "p_type")
    question = X.number_placeholders(F.lit("which <image> or <image>?"))
    answer = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    return t.part.select(
        "p_partkey", X.choice_prompt(question, options).alias("prompt"), X.choice_answer(options, answer).alias("answer")
    )


@query(
    "time_columns_t23",
    """SELECT event_id, round(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + extract('second' FROM ts) + (epoch_us(ts) // 1000 % 1000) / 1000.0, 3) AS seconds,
              strftime(ts, '%H:%M:%S') AS clock, date_diff('day', DATE '2024-01-01', ts::DATE) AS days FROM events""",
)
def time_columns(t):
    seconds = X.clock_to_seconds(F.date_format("ts", "H:m:s.SSS"))
    return t.events.select(
        "event_id",
        F.round(seconds, 3).alias("seconds"),
        X.seconds_to_clock(seconds).alias("clock"),
        F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("days"),
    )


@query(
    "question_features_t24",
    """SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words,
              len(list_filter(string_split(text, '.'), lambda s: NOT contains(s, 'exist'))) AS steps FROM conversations""",
)
def question_features(t):
    steps = X.reasoning_steps(F.split("text", r"\."))
    return t.conversations.select("conv_id", "turn", X.word_count(F.col("text")).alias("n_words"), steps.alias("steps"))
