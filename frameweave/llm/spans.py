"""Positions of regular-expression matches with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameweave.functions.binding import let

#: Matches whose positions are added up in one fold. A fold copies its result at every step, so the work
#: per match grows with this and with the matches of a text divided by its square.
FOLD = 64
SPAN = "struct<start:int,end:int,value:string>"


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points.

    The gaps between the matches come from `split` and the matches from `regexp_extract_all`; both
    search alike, so that adding their lengths in turn gives every position. Start and end count
    code points from 0, end exclusive. A null text gives null. Patterns must not match the empty
    string, and repeat groups possessively, which keeps the Java stack flat on long texts.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    return let(parts, _positions)


def _length(part: Column) -> Column:
    return F.char_length(part["gap"]) + F.coalesce(F.char_length(part["hit"]), F.lit(0))


def _positions(parts: Column) -> Column:
    """Spans of the parts: where each block of FOLD parts begins, then the places inside the blocks."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD).cast("int"))

    def block(b: Column) -> Column:
        return F.slice(parts, b * FOLD + 1, FOLD)

    def begin(acc: Column, b: Column) -> Column:
        return F.struct(
            F.aggregate(block(b), acc["at"], lambda at, part: at + _length(part)).alias("at"),
            F.concat(acc["out"], F.array(acc["at"])).alias("out"),
        )

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        end = acc["at"] + _length(part)
        span = F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("value")).cast(SPAN)
        more = F.when(part["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(end.cast("int").alias("at"), more.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(numbers, zero, begin, lambda acc: acc["out"])

    def spans(at: Column, b: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(block(b), start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(begins, spans))


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
