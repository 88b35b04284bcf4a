"""Row ids of any kind for operators that pack them as 64-bit integers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

_INTEGERS = ("byte", "short", "integer", "long")


def is_integer(docs: DataFrame, column: str = "doc_id") -> bool:
    return docs.schema[column].dataType.typeName() in _INTEGERS


def numbered(docs: DataFrame, run: Callable[[DataFrame], DataFrame], *ids: str) -> DataFrame:
    """``run(docs)`` where it sees ``doc_id`` as bigint; the columns ``ids`` of its result get the type of the input's back.

    Integers are cast. Ids of another kind are numbered: their distinct values become a table, by which rows get numbers and
    results their ids again. Null ids stay null.
    """
    kind = docs.schema["doc_id"].dataType
    if is_integer(docs):
        out = run(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))
        return out.withColumns({c: F.col(c).cast(kind) for c in ids if out.schema[c].dataType != kind})
    table = materialize(docs.select(F.col("doc_id").alias("__id")).dropna().distinct().withColumn("__number", F.monotonically_increasing_id()), "row-numbers")
    out = run(docs.join(table, F.col("doc_id") == F.col("__id"), "left").withColumn("doc_id", F.col("__number")).drop("__id", "__number"))
    names = out.columns
    for c in ids:
        out = out.join(table, F.col(c) == F.col("__number"), "left").withColumn(c, F.col("__id")).drop("__id", "__number")
    return out.select(*names)
