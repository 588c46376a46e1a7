"""Conversations rendered by a compiled template, one output row per turn, and read back.

Turns are numbered in their conversation and then rendered independently of each other, so a
conversation with most of the turns is rendered by many tasks. Only the digests of whole
conversations, which are sequential by definition, read a conversation in order; they do so in a
stream that holds one batch of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameweave.llm.templates import Template, unescape
from frameweave.plans.ordering import order_rows

#: Marks every turn and trains on the texts of the assistant. Texts and roles are escaped, so a
#: `<` or `#` without a backslash always belongs to the template, and so does the first such `:`.
TEMPLATE = (
    "{% for m in messages %}{% if loop.first %}<chat>\n{% endif %}"
    "### {{ m.role | escape_name }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}</chat>"
)
_TURN = re.compile(r"(?:<chat>\n)?### ((?:[^\\<#:]|\\.)*): ((?:[^\\<#]|\\.)*)</turn>\n(?:</chat>)?", re.S)


def format_turns(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, place, formatted, spans) for each row of `turns` (conv_id, turn, role, text).

    Rows are ordered by turn, then role and text, nulls first; repeated rows are turns of their own;
    null texts and roles count as empty. `spans` lists [start, end) of the trained pieces, in code
    points of `formatted`. A conversation is the concatenation of its rows by `place`. An empty table
    gives no rows; other columns are not read.
    """
    compiled = Template(template)  # raises here for a template that is not in the language
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A null conversation is one too.
    rows = rows.withColumns({"_none": F.col("conv_id").isNull(), "conv_id": F.coalesce("conv_id", F.lit(0).cast("long"))})
    sizes = rows.groupBy("conv_id", "_none").agg(F.count(F.lit(1)).alias("n"))
    placed = order_rows(rows, ["conv_id", "_none"], ["turn", "role", "text"], seq="place").df
    placed = placed.join(sizes, ["conv_id", "_none"])
    placed = placed.select(
        F.when(~F.col("_none"), F.col("conv_id")).alias("conv_id"), F.col("place").cast("long"),
        (F.col("place") == F.col("n") - 1).alias("last"), "role", "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, spans = [], []
            for row in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                place, last, role, text = row
                at, out, marked = 0, [], []
                for piece, generated in compiled.render_message({"role": role, "text": text}, place, last):
                    if generated:
                        marked.append([at, at + len(piece)])
                    out.append(piece)
                    at += len(piece)
                formatted.append("".join(out))
                spans.append(marked)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["conv_id", "place", "formatted", "spans"],
            )

    return placed.mapInArrow(run, "conv_id long, place long, formatted string, spans array<array<long>>")


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one row formatted by TEMPLATE."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def conversation_report(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the output of `format_turns` with TEMPLATE.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. SHA-256 cannot be
    computed in parts, so the turns of a conversation pass one task in order, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state:
                conv, n, turns, loss, loss_chars, chars = state
                done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def send() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            done.clear()
            return batch

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            for conv, place, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                if not place:
                    close()
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, said = read_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                for start, end in spans:
                    trained = unescape(text[start:end])
                    state[3].update(trained.encode())
                    state[4] += len(trained)
                state[5] += len(text)
            if done:
                yield send()
        close()
        yield send()

    laid = formatted.select("conv_id", "place", "formatted", "spans").repartition("conv_id")
    laid = laid.sortWithinPartitions("conv_id", "place")
    return laid.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
