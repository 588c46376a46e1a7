"""Jobs over dialogue turns: rendering, labels, prompts, lengths.

Turns stay flat rows until the last step, so a very long conversation is spread over tasks; the
final text or array is built per page of consecutive turns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.functions.binding import let
from frameweave.functions.text import words
from frameweave.plans.ordering import order_rows

IGNORE = -100  # fixed value: label of a token that is not trained on
PAGE_TURNS = 10_000


@dataclass(frozen=True)
class Style:
    """How turns are written: role names, separators after even and odd turns, system text."""

    roles: tuple[str, str]
    kind: str
    sep: str = ""
    sep2: str = ""
    system: str = ""
    strict: bool = False  # roles must alternate


# Public prompt formats of common chat models.
STYLES = {
    "single": Style(("Human", "Assistant"), "colon", "###", "###"),
    "two": Style(("USER", "ASSISTANT"), "colon", " ", "</s>"),
    "chatml": Style(("<|im_start|>user", "<|im_start|>assistant"), "line", "<|im_end|>", "<|im_end|>"),
    "llama3": Style(("user", "assistant"), "header", "<|eot_id|>", "<|eot_id|>"),
    "mpt": Style(("<|im_start|>user\n", "<|im_start|>assistant\n"), "plain_role", "<|im_end|>", "<|im_end|>"),
    "gemma": Style(("<start_of_turn>user\n", "<start_of_turn>model\n"), "plain_role", "<end_of_turn>\n", "<end_of_turn>\n", strict=True),
    "llama2": Style(("USER", "ASSISTANT"), "inst", "<s>", "</s>", strict=True),
    "plain": Style(("", ""), "bare", "\n", "\n"),
}


def _turn_text(style: Style, seq: Column, speaker: Column, text: Column) -> Column:
    odd = seq % 2 == 1
    sep = F.when(odd, F.lit(style.sep2)).otherwise(F.lit(style.sep))
    role = F.when(speaker == 1, F.lit(style.roles[1])).otherwise(F.lit(style.roles[0]))
    empty = text.isNull() | (text == "")
    if style.kind == "colon":
        return F.when(empty, F.concat(role, F.lit(":"))).otherwise(F.concat(role, F.lit(": "), text, sep))
    if style.kind == "line":
        return F.when(empty, F.concat(role, F.lit("\n"))).otherwise(
            F.concat(role, F.lit("\n"), text, sep, F.lit("\n"))
        )
    if style.kind == "header":
        head = F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))
        return F.when(empty, F.lit("")).otherwise(F.concat(head, text, sep))
    if style.kind == "plain_role":
        return F.when(empty, role).otherwise(F.concat(role, text, sep))
    if style.kind == "inst":
        system = f"<<SYS>>\n{style.system}\n<</SYS>>\n\n" if style.system else ""
        asked = F.when(seq == 0, F.concat(F.lit(system), text)).otherwise(text)
        open_mark = F.when(seq == 0, F.lit("")).otherwise(F.lit(style.sep))
        asked = F.concat(open_mark, F.lit("[INST] "), asked, F.lit(" [/INST]"))
        told = F.concat(F.lit(" "), text, F.lit(" "), F.lit(style.sep2))
        return F.when(empty, F.lit("")).when(odd, told).otherwise(asked)
    return F.when(empty, F.lit("")).otherwise(F.concat(text, sep))


def _opening(style: Style) -> str:
    if style.kind == "colon":
        return style.system + style.sep
    if style.kind == "line":
        return f"{style.system}{style.sep}\n" if style.system else ""
    if style.kind == "header":
        system = f"<|start_header_id|>system<|end_header_id|>\n\n{style.system}{style.sep}"
        return "<|begin_of_text|>" + (system if style.system else "")
    if style.kind == "plain_role":
        return style.system + style.sep if style.system else ""
    return style.system if style.kind == "bare" else ""


def alternation(turns: DataFrame, conv: str, seq: str, speaker: str) -> DataFrame:
    """Per conversation whether turn i is spoken by i mod 2."""
    return turns.groupBy(conv).agg(F.bool_and(F.col(speaker) == F.col(seq) % 2).alias("alternates"))


def render(
    turns: DataFrame,
    conv: str,
    order: Sequence[str],
    speaker: str,
    text: str,
    style: Style,
    page_turns: int = PAGE_TURNS,
) -> DataFrame:
    """Conversation text in a style, one row per page of turns.

    `speaker` is 0 for the user and 1 for the assistant. A conversation that breaks alternation
    in a strict style has NULL text and `rejected` set.
    """
    rows = order_rows(turns, [conv], order)
    piece = _turn_text(style, F.col("seq"), F.col(speaker), F.col(text))
    pages = rows.pages(page_turns, piece=piece)
    body = F.array_join("piece", "")
    full = F.when(F.col("page") == 0, F.concat(F.lit(_opening(style)), body)).otherwise(body)
    out = pages.select(conv, "page", full.alias("prompt"))
    if not style.strict:
        return out.withColumn("rejected", F.lit(False))
    checked = out.join(alternation(rows.df, conv, "seq", speaker), conv)
    return checked.select(
        conv, "page", F.when(F.col("alternates"), F.col("prompt")).alias("prompt"), (~F.col("alternates")).alias("rejected")
    )


def training_labels(
    turns: DataFrame, conv: str, order: Sequence[str], speaker: str, ids: str, page_turns: int = PAGE_TURNS
) -> DataFrame:
    """Token ids and labels of a conversation: only assistant tokens keep their id as label.

    A leading turn that is not the user's is skipped; a conversation that does not alternate
    afterwards has every label ignored.
    """
    first = turns.groupBy(conv).agg(F.min_by(F.col(speaker), F.struct(*order)).alias("_s0"), F.min(F.struct(*order)).alias("_o0"))
    kept = turns.join(first, conv).where((F.col("_s0") == 0) | (F.struct(*order) != F.col("_o0")))
    rows = order_rows(kept.drop("_s0", "_o0"), [conv], order)
    good = alternation(rows.df, conv, "seq", speaker)
    label = F.when(F.col(speaker) == 1, F.col(ids)).otherwise(F.array_repeat(F.lit(IGNORE), F.size(ids)))
    pages = rows.pages(page_turns, ids=F.col(ids), labels=label).join(good, conv)
    flat = F.flatten("labels")
    return pages.select(
        conv,
        "page",
        F.flatten("ids").alias("input_ids"),
        F.when(F.col("alternates"), flat).otherwise(F.transform(flat, lambda x: F.lit(IGNORE))).alias("labels"),
    )


def completion_labels(ids: Column, marker: Sequence[int]) -> Column:
    """Labels that keep only what follows the last occurrence of the response marker."""
    return let(ids, lambda bound: _after_marker(bound, marker))


def _after_marker(ids: Column, marker: Sequence[int]) -> Column:
    k = len(marker)
    want = F.array(*[F.lit(m) for m in marker])
    starts = F.transform(ids, lambda x, i: F.when(F.slice(ids, i + 1, k) == want, i))
    return let(
        F.coalesce(F.array_max(starts), F.lit(2**31 - 1 - k)),
        lambda last: F.transform(ids, lambda x, i: F.when(i >= last + k, x).otherwise(F.lit(IGNORE))),
    )


# ---- interleaved and multi-turn records -------------------------------------------------------


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def interleaved_text(
    sentences: Column, matched: Column, token: str = "<image>", max_images: int | None = None, end: str = ""
) -> Column:
    """Sentences joined by spaces with an image mark before each matched sentence.

    `matched` holds one 0-based sentence index per image; only the first `max_images` count, if given.
    """
    clean = F.transform(sentences, lambda s: F.replace(s, F.lit(token), F.lit(token.upper())))
    marked = let(
        _first(matched, max_images),
        lambda used: F.transform(
            clean,
            lambda s, i: F.concat(F.repeat(F.lit(token + "\n"), F.size(F.filter(used, lambda m: m == i))), s),
        ),
    )
    text = F.array_join(marked, " ")
    for old in (token + " ", " " + token):
        text = F.replace(text, F.lit(old), F.lit(token))
    return F.concat(text, F.lit(end))


def image_order(matched: Column, max_images: int | None = None) -> Column:
    """Positions of the used images sorted by their sentence, then by position."""
    used = _first(matched, max_images)
    keyed = F.transform(used, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def recover_turns(question: Column, answer: Column, n_images: Column, token: str = "<image>") -> Column:
    """Turns of a record as array<struct<from, value>>.

    A question with `Image Descriptions` holds the whole dialogue as `Question:`/`Answer:` pairs;
    any other is a single turn with one media mark per image.
    """

    def turn(who: str, value: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), value.alias("value"))

    parts = F.split(question, "\nQuestion: ")

    def dialogue(asked: Column) -> Column:
        last = F.size(asked) - 1
        return F.transform(
            asked,
            lambda p, i: F.array(
                turn(
                    "human",
                    F.concat(
                        F.when(i == 0, F.lit(token + "\n")).otherwise(F.lit("")),
                        F.when(i == last, F.replace(p, F.lit("\n"), F.lit(""))).otherwise(
                            F.split_part(p, F.lit("\nAnswer: "), F.lit(1))
                        ),
                    ),
                ),
                turn(
                    "gpt", F.when(i == last, answer).otherwise(F.split_part(p, F.lit("\nAnswer: "), F.lit(2)))
                ),
            ),
        )

    pairs = let(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), dialogue)
    bare = question
    for mark in (token + "\n", "\n" + token, token):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    marks = F.array_join(F.array_repeat(F.lit(token + "\n"), n_images.cast("int")), "")
    single = F.array(turn("human", F.concat(marks, bare)), turn("gpt", answer))
    return F.when(question.contains("Image Descriptions"), F.flatten(pairs)).otherwise(single)


def chat_messages(prompt: Column, completion: Column) -> Column:
    """Prompt and completion as a two-message array."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("user", prompt), message("assistant", completion))


def length_estimates(
    turns: DataFrame, conv: str, text: str, has_media: Column, media_tokens: int = 128
) -> DataFrame:
    """Words plus a media allowance, and words signed by modality, per conversation."""
    per = turns.select(conv, F.size(words(F.col(text))).cast("long").alias("_w"), has_media.alias("_m"))
    per = per.groupBy(conv).agg(F.sum("_w").alias("_w"), F.bool_or("_m").alias("_m"))
    return per.select(
        conv,
        (F.col("_w") + F.when(F.col("_m"), media_tokens).otherwise(0)).alias("length"),
        F.when(F.col("_m"), F.col("_w")).otherwise(-F.col("_w")).alias("modality_length"),
    )


def interleaved_length(sentences: Column, matched: Column, image_tokens: int, max_images: int | None = None) -> Column:
    """Half the image tokens plus the characters of the matched sentences."""
    used = _first(matched, max_images)
    chars = F.aggregate(
        used, F.lit(0).cast("long"), lambda s, m: s + F.length(F.get(sentences, m.cast("int"))).cast("long")
    )
    return F.floor(F.size(used) * F.lit(image_tokens) / 2) + chars


# ---- prompts ----------------------------------------------------------------------------------


def memory_documents(turns: DataFrame, summaries: DataFrame | None) -> DataFrame:
    """One document per dialogue turn and one per day summary, with the date as source.

    `turns`: user, date, ord, query, response. `summaries`: user, date, content.
    """
    day = F.date_format("date", "yyyy-MM-dd")
    said = F.concat(
        F.lit("Conversation content on "),
        day,
        F.lit(":[|User|]: "),
        F.trim("query"),
        F.lit("; [|AI|]: "),
        F.trim("response"),
    )
    docs = turns.select("user", day.alias("source"), "ord", said.alias("content"))
    if summaries is None:
        return docs
    told = F.concat(F.lit("The summary of the conversation on "), day, F.lit(" is: "), F.col("content"))
    extra = summaries.join(turns.select("user", "date").distinct(), ["user", "date"], "left_semi")
    return docs.unionByName(
        extra.select("user", day.alias("source"), F.lit(None).cast("long").alias("ord"), told.alias("content"))
    )


def day_documents(
    turns: DataFrame, summaries: DataFrame | None, page_turns: int = PAGE_TURNS
) -> DataFrame:
    """One document per user and day, the summary at its end; long days give several pages."""
    line = F.concat(
        F.lit("\n"), F.col("user").cast("string"), F.lit(": "), F.trim("query"), F.lit("\nAI: "), F.trim("response")
    )
    rows = order_rows(turns, ["user", "date"], ["ord"], size="_n")
    pages = rows.pages(page_turns, line=line, n=F.col("_n"))
    day = F.date_format("date", "yyyy-MM-dd")
    last = (F.col("page") + 1) * page_turns >= F.get("n", 0)
    head = F.when(F.col("page") == 0, F.concat(F.lit("Conversation on "), day, F.lit(": "))).otherwise("")
    tail = F.lit("\n")
    if summaries is not None:
        pages = pages.join(summaries.select("user", "date", F.col("content").alias("_sum")), ["user", "date"], "left")
        told = F.concat(F.lit("\nThe summary of the conversation on "), day, F.lit(" is: "), F.col("_sum"))
        tail = F.coalesce(told, F.lit("\n"))
    return pages.select(
        "user",
        day.alias("source"),
        "page",
        F.concat(head, F.array_join("line", ""), F.when(last, tail).otherwise("")).alias("content"),
    )


def prompt_ends(question: Column, related: Column, dates: Column, summary: Column, personality: Column) -> tuple[Column, Column]:
    """What stands before and after the history in a prompt, as columns head and tail.

    The head depends on which of memory, summary and personality are known.
    """

    def known(c: Column) -> Column:
        return c.isNotNull() & (F.trim(c) != "")

    memory = F.concat(F.lit("Related memory ("), dates, F.lit("):\n"), related, F.lit("\n"))
    full = F.concat(F.lit("Summary of past talks: "), summary, F.lit("\nUser: "), personality, F.lit("\n"), memory)
    head = F.when(known(summary) & known(related) & known(personality), full).when(known(related), memory).otherwise("")
    return head.alias("head"), F.concat(F.lit("\n [|User|]: "), question, F.lit(" \n [|AI|]: ")).alias("tail")


def memory_prompt(
    question: Column, history: Column, related: Column, dates: Column, summary: Column, personality: Column
) -> Column:
    """The whole prompt as one text, for histories of bounded length."""
    head, tail = prompt_ends(question, related, dates, summary, personality)
    return F.concat(head, history, tail)


def memory_prompt_rows(history: DataFrame, ends: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Prompts over histories of any length: `key`, `order`, piece, seq, to be joined in the order of seq.

    `history`: key, order, piece. `ends`: key, head, tail (as from `prompt_ends`). Empty pieces are left out.
    """
    def end(name: str, part: int) -> DataFrame:
        none = [F.lit(None).cast(history.schema[c].dataType).alias(c) for c in order]
        return ends.select(key, *none, F.col(name).alias("piece"), F.lit(part).alias("_part"))

    rows = end("head", 0).unionByName(history.withColumn("_part", F.lit(1))).unionByName(end("tail", 2))
    return order_rows(rows.where("piece <> ''"), [key], ["_part", *order]).df.drop("_part")
