"""Evaluate an expression once and use it many times inside another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    Common subexpressions are not shared inside lambdas, so a value used per element of an array
    would be recomputed for every element without this.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)
