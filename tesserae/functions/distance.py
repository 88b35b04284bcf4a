"""Distances between vectors as Column expressions: lower is nearer, and a score is 1 - distance."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot_product"

    @classmethod
    def of(cls, name: "str | Metric | None") -> "Metric":
        """The metric of a name (``dot`` too); ValueError for an unknown one."""
        if name is None:
            return cls.COSINE
        if isinstance(name, cls):
            return name
        return cls.DOT if name == "dot" else cls(name)


def vector(values) -> Column:
    """A literal vector, as floats."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def _fold(a: Column, b: Column, term) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(metric: Metric, query: Column, stored: Column, query_norm: Column | None = None) -> Column:
    """Cosine: 1 - similarity, which is 0 below a product of norms of 1e-10. Euclidean: squared. Dot: negated product.

    ``query_norm`` is the norm of the query where it is known already, so that it is not found again for each row.
    """
    if metric is Metric.EUCLIDEAN:
        return _fold(query, stored, lambda x, y: (x - y) * (x - y))
    if metric is Metric.DOT:
        return -dot(query, stored)
    scale = (norm(query) if query_norm is None else query_norm) * norm(stored)
    return F.lit(1.0) - F.when(scale < 1e-10, 0.0).otherwise(dot(query, stored) / scale)
