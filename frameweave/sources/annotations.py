"""Annotation inputs: JSON in either layout, delimited files, nested question records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TOKENS = ("nan", "none", "")  # fixed values: spellings of a missing answer


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin(*NULL_TOKENS)


def read_annotations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array or JSON Lines, told apart by the first non-blank character.

    Rows that do not parse keep their text in `_corrupt` when the schema has that field.
    """
    head = spark.read.text(path).where(F.trim("value") != "").first()
    is_array = head is not None and head[0].lstrip().startswith("[")
    return (
        spark.read.schema(schema)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path, multiLine=is_array)
    )


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t"
) -> DataFrame:
    """Delimited file with a header; `nan`, `none` and blanks become NULL in text columns."""
    df = spark.read.csv(
        path, schema=schema, sep=sep, header=True, escape='"', quote='"', multiLine=False
    )
    text = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~is_missing(F.col(c)), F.col(c)) for c in text})


def flatten_breakpoints(df: DataFrame, breakpoints: str = "breakpoint") -> DataFrame:
    """One row per question with the segment `[start, end)` that precedes it.

    The start is the time of the question before it in the same record, so no shuffle is needed.
    Records that hold one page of a longer list bring the start along as a field of that name.
    """
    item = F.col(breakpoints)
    fields = [f.name for f in df.schema[breakpoints].dataType.elementType.fields]

    def segment(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(item, i - 1)["time"]).otherwise(F.lit(0))
        start = x["start"] if "start" in fields else before
        rest = [x[f].alias(f) for f in fields if f not in ("time", "start")]
        return F.struct(start.alias("start"), x["time"].alias("end"), *rest)

    rest = [c for c in df.columns if c != breakpoints]
    return df.select(*rest, F.inline(F.transform(item, segment)))


def flatten_nested(df: DataFrame, sep: str = "/") -> DataFrame:
    """Struct columns to top-level columns named by their path."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema:
            if sep in field.name:
                raise ValueError(f"field name {field.name!r} contains the separator {sep!r}")
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, (*path, field.name))
            else:
                yield (*path, field.name)

    return df.select(
        *[
            F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
            for path in leaves(df.schema, ())
        ]
    )
