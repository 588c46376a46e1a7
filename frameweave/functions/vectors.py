"""Vector arithmetic on array columns as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameweave.functions.binding import let

Distance = Callable[[Column, Column], Column]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: str | Column) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def squared(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared(a, b))


def lp(p: float) -> Distance:
    if p == 1:
        return lambda a, b: total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))
    if p == 2:
        return euclidean
    return lambda a, b: F.pow(
        total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.pow(F.abs(x - y), F.lit(p)))),
        F.lit(1.0 / p),
    )


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return 1 - cosine(a, b)


def negative_dot(a: str | Column, b: str | Column) -> Column:
    return -dot(a, b)


def ssim(a: str | Column, b: str | Column, span: float = 1.0) -> Column:
    """Structural similarity over the whole vector, with the usual constants for range `span`."""
    a, b = doubles(a), doubles(b)
    n = F.size(a).cast("double")
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    moments = F.struct(
        (total(a) / n).alias("ma"),
        (total(b) / n).alias("mb"),
        (dot(a, a) / n).alias("aa"),
        (dot(b, b) / n).alias("bb"),
        (dot(a, b) / n).alias("ab"),
    )

    def score(m: Column) -> Column:
        ma, mb = m["ma"], m["mb"]
        spread = (m["aa"] - ma * ma) + (m["bb"] - mb * mb)
        return ((2 * ma * mb + c1) * (2 * (m["ab"] - ma * mb) + c2)) / (
            (ma * ma + mb * mb + c1) * (spread + c2)
        )

    return let(moments, score)


def unit(a: str | Column) -> Column:
    """Vector of length 1; an all-zero vector stays as it is."""
    return let(
        doubles(a),
        lambda v: let(
            norm(v),
            lambda size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0))),
        ),
    )


def minmax(a: str | Column) -> Column:
    """Values scaled to 0..1; a constant vector becomes zeros."""

    def scale(v: Column, b: Column) -> Column:
        span = b["high"] - b["low"]
        return F.transform(v, lambda x: F.when(span > 0, (x - b["low"]) / span).otherwise(F.lit(0.0)))

    return let(
        doubles(a),
        lambda v: let(
            F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), lambda b: scale(v, b)
        ),
    )


DISTANCES: dict[str, Distance] = {
    "l1": lp(1),
    "l2": euclidean,
    "sql2": squared,
    "cosine": cosine_distance,
    "dot": negative_dot,
}
