"""Other columns of a table kept out of an operator's way."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


def shielded(*used: str) -> Callable:
    """Decorator for a function that returns rows of its first argument with the same columns.

    Inside it only the columns `used` have their names; all others are numbered, so none can
    clash with a helper column, and get their names back in the result.
    """

    def around(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            inner = docs.toDF(*[c if c in used else f"kept{i}" for i, c in enumerate(docs.columns)])
            return fn(inner, *args, **options).toDF(*docs.columns)

        return run

    return around
