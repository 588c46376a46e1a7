"""Repeatable random choices: each draw is a function of (seed, id)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(seed: int | str | Column, *ids: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of md5('seed:id:...')."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    text = F.concat_ws(":", seed.cast("string"), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
