"""Documents with typed metadata as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType([T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType())])
DOCUMENT = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", T.MapType(T.StringType(), VALUE)),
])


def tagged(value) -> tuple:
    """A Python metadata value as (b, i, f, s) with one member set; booleans are no integers."""
    if isinstance(value, bool):
        return (value, None, None, None)
    if isinstance(value, int):
        return (None, value, None, None) if -(1 << 63) <= value < 1 << 63 else (None, None, float(value), None)
    if isinstance(value, float):
        return (None, None, value, None)
    if isinstance(value, str):
        return (None, None, None, value)
    raise ValueError(f"metadata values are bool, int, float or str, not {type(value).__name__}")


def untagged(row):
    """The Python value of a tagged one."""
    return next((x for x in row if x is not None), None)


def value(kind: str, column: Column) -> Column:
    """A tagged value from a plain column of kind b, i, f or s; null stays null."""
    fields = [(column if n == kind else F.lit(None)).cast(t).alias(n) for n, t in (("b", "boolean"), ("i", "bigint"), ("f", "double"), ("s", "string"))]
    return F.when(column.isNotNull(), F.struct(*fields))


def metadata(**columns: tuple[str, Column]) -> Column:
    """A metadata map from name=(kind, column); null values are absent keys."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), value(k, c).alias("value")) for n, (k, c) in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def finite(embedding: Column) -> Column:
    """Whether a vector has neither NaN nor infinity."""
    return ~F.exists(embedding, lambda x: F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
