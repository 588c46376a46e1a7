"""Registered queries over the given tables, one module per area."""

from __future__ import annotations

import importlib

AREAS = (
    "memories",
    "streams",
    "vectors",
    "texts",
    "sequences",
    "corpus",
    "scores",
    "joins",
    "tables",
)


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"frameweave.suite.{area}")
