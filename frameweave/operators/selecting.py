"""Filters, positional subsets, splits and reshaping of annotation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameweave.functions.binding import let

from frameweave.plans.ordering import order_rows
from frameweave.sources.annotations import is_missing


def filter_levels(df: DataFrame, wanted: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Cumulative filters: column -> (levels from lowest to highest, chosen level).

    A chosen level keeps itself and all levels before it.
    """
    for column, (levels, chosen) in wanted.items():
        df = df.where(F.col(column).isin(list(levels)[: list(levels).index(chosen) + 1]))
    return df


def fraction(df: DataFrame, order: Sequence[str], start: float, end: float) -> DataFrame:
    """Rows at positions `[int(n*start), int(n*end))` of the whole order."""
    rows = order_rows(df, [], order, size="n").df
    low, high = F.floor(F.col("n") * F.lit(start)), F.floor(F.col("n") * F.lit(end))
    return rows.where((F.col("seq") >= low) & (F.col("seq") < high)).drop("n")


def split_columns(seq: Column, n: Column, k: int) -> dict[str, Column]:
    """Ways to deal `n` ordered rows to `k` workers, as columns over the position `seq`."""
    size = F.ceil(n / F.lit(k))
    base = F.floor(n / F.lit(k))
    return {
        "ceil_chunk": F.floor(seq / size),
        "floor_chunk": F.least(F.floor(seq / F.greatest(base, F.lit(1))), F.lit(k - 1).cast("long")),
        "strided": F.pmod(seq, F.lit(k)),
        "even_chunk": even_piece(seq, n, k),
        "zigzag": zigzag_lane(seq, n, k),
    }


def even_piece(seq: Column, n: Column, k: int) -> Column:
    """Contiguous piece of near-even size; the first `n mod k` pieces hold one row more."""
    base, longer = F.floor(n / F.lit(k)), F.pmod(n, F.lit(k))
    head = longer * (base + 1)
    return F.when(seq < head, F.floor(seq / (base + 1))).otherwise(
        longer + F.floor((seq - head) / F.greatest(base, F.lit(1)))
    )


def zigzag_lane(seq: Column, n: Column, k: int) -> Column:
    """Lane `i` holds pieces `i` and `2k-1-i` of `2k` near-even pieces."""
    piece = even_piece(seq, n, 2 * k)
    return F.when(piece < k, piece).otherwise(2 * k - 1 - piece)


def option_rounds(
    df: DataFrame, options: Sequence[str], rotate: bool = True, answer: str | None = None
) -> DataFrame:
    """Options up to the first missing one, and one row per rotation of them.

    `answer` names the column with the right letter; its letter after each rotation is kept.
    """
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(len(options))])
    values = F.array(*[F.col(c).cast("string") for c in options])
    gaps = F.array(*[is_missing(F.col(c)) for c in options])
    first_gap = F.array_position(gaps, True)
    kept = F.when(first_gap == 0, values).otherwise(
        F.slice(values, F.lit(1), F.greatest(first_gap.cast("int") - 1, F.lit(0)))
    )
    df = df.withColumn("options", kept).withColumn("n_options", F.size("options"))
    if not rotate:
        return df
    df = df.withColumn(
        "round", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_options") - 1, F.lit(0))))
    )
    turned = F.concat(
        F.slice("options", F.col("round") + 1, F.greatest(F.col("n_options") - F.col("round"), F.lit(0))),
        F.slice("options", F.lit(1), F.col("round")),
    )
    df = df.withColumn("options", turned)
    if answer:
        place = F.array_position(letters, F.col(answer)).cast("int") - 1
        moved = F.pmod(place - F.col("round"), F.col("n_options"))
        df = df.withColumn(
            "answer_letter", F.when(place < F.col("n_options"), F.get(letters, moved))
        )
    return df


def polygon_box(vertices: Column) -> dict[str, Column]:
    xs = F.transform(vertices, lambda v: v[0])
    ys = F.transform(vertices, lambda v: v[1])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def keep_readable_words(
    words: DataFrame,
    image: str,
    text: str,
    vertices: str,
    image_area: Column,
    min_share: float,
    min_pixels: float = 0.0,
    legible: str | None = None,
    vertical: str | None = None,
) -> DataFrame:
    """OCR words that are legible, horizontal, not a lone dot, and large enough."""
    out = words.where(F.col(text) != ".")
    if legible:
        out = out.where(F.col(legible))
    if vertical:
        out = out.where(~F.col(vertical))
    # The box is made once for each word that passed the tests above.
    box = F.struct(*[c.alias(k) for k, c in polygon_box(F.col(vertices)).items()])
    sized = let(box, lambda b: F.struct(
        *[b[k].alias(k) for k in ("x1", "y1", "x2", "y2")], ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).alias("area")
    ))
    out = out.withColumn("_box", F.explode(F.array(sized)))
    out = out.where((F.col("_box.area") >= image_area * min_share) & (F.col("_box.area") >= min_pixels))
    return out.select(*words.columns, "_box.x1", "_box.y1", "_box.x2", "_box.y2", "_box.area")


def nest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], items: dict[str, Column], rows: int = 10_000
) -> DataFrame:
    """Flat rows to one record per group, in pages of at most `rows` items."""
    return order_rows(df, keys, order).pages(rows, **items)


def place_media_token(
    turns: DataFrame, conv: str, turn: str, text: str, token: str, conflict: str, replacement: str
) -> DataFrame:
    """Replace a conflicting literal in every turn, and open a conversation that never mentions
    the token with it."""
    clean = turns.withColumn(text, F.replace(F.col(text), F.lit(conflict), F.lit(replacement)))
    has = clean.groupBy(conv).agg(
        F.max(F.contains(F.col(text), F.lit(token))).alias("_has"), F.min(turn).alias("_first")
    )
    opened = F.when(
        ~F.col("_has") & (F.col(turn) == F.col("_first")), F.concat(F.lit(token + "\n"), F.col(text))
    ).otherwise(F.col(text))
    return clean.join(has, conv).withColumn(text, opened).drop("_has", "_first")


__all__ = [
    "even_piece",
    "filter_levels",
    "fraction",
    "keep_readable_words",
    "nest_rows",
    "option_rounds",
    "place_media_token",
    "polygon_box",
    "split_columns",
    "zigzag_lane",
]
