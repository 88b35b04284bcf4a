"""Metadata filters compiled to one Boolean Column without nulls.

A clause is {"must": [condition], "must_not": [condition]}; a condition is {"field", "op", "value" or "values"}. Fields that
are missing make every condition false, ``ne`` too. Equality needs equal kinds, except that integers and floats compare as
numbers; order comparisons are for numbers alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .limits import F64_EPSILON

OPS = ("eq", "ne", "gt", "lt", "gte", "lte", "in")


def from_map(column: str = "metadata") -> Callable[[str], Column]:
    """Fields looked up in a map of tagged values."""
    return lambda field: F.try_element_at(F.col(column), F.lit(field))


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equal(v: Column, x) -> Column:
    if isinstance(x, bool):
        return _false(v["b"] == F.lit(x))
    if isinstance(x, (int, float)):
        near = lambda c: _false(F.abs(c - F.lit(float(x))) < F64_EPSILON)
        out = near(v["i"].cast("double")) | near(v["f"])
        return out | _false(v["i"] == F.lit(x)) if isinstance(x, int) and -(1 << 63) <= x < 1 << 63 else out
    return _false(v["s"] == F.lit(x)) if isinstance(x, str) else F.lit(False)


def _ordered(v: Column, op: str, x) -> Column:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return F.lit(False)
    n, x = F.coalesce(v["i"].cast("double"), v["f"]), F.lit(float(x))
    return _false({"gt": n > x, "lt": n < x, "gte": n >= x, "lte": n <= x}[op])


def condition(c: dict, field: Callable[[str], Column] = from_map()) -> Column:
    op = c.get("op")
    if op not in OPS:
        raise ValueError(f"unknown filter operator {op!r}")
    if not isinstance(c.get("field"), str):
        raise ValueError("a filter condition needs a field")
    v = field(c["field"])
    if op == "in":
        return reduce(lambda a, b: a | b, [_equal(v, x) for x in c.get("values") or []], F.lit(False))
    x = c.get("value")
    if x is None:
        return F.lit(False)
    if op == "eq":
        return _equal(v, x)
    return v.isNotNull() & ~_equal(v, x) if op == "ne" else _ordered(v, op, x)


def compile_filter(clause: dict | None, field: Callable[[str], Column] = from_map()) -> Column:
    clause = clause or {}
    must = [condition(c, field) for c in clause.get("must") or []]
    must_not = [~condition(c, field) for c in clause.get("must_not") or []]
    return reduce(lambda a, b: a & b, must + must_not, F.lit(True))
