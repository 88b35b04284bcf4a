"""Scalar quantization to one byte a component, and distances on codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import Metric, distance
from .limits import F32_EPSILON

_F = "float"


def codes(v: Column) -> Column:
    """Struct (codes, min, scale) of a float vector; a constant vector has codes 128 and scale 0."""
    low, high = F.array_min(v), F.array_max(v)
    span = (high - low).cast(_F)
    step = (F.lit(255).cast(_F) / span).cast(_F)
    # half away from zero, on values that are never negative
    code = lambda x: F.least(F.lit(255.0), F.floor(((x - low) * step).cast(_F).cast("double") + 0.5).cast("double")).cast("smallint")
    flat = span < F.lit(F32_EPSILON).cast(_F)
    return F.struct(
        F.when(flat, F.transform(v, lambda x: F.lit(128).cast("smallint"))).otherwise(F.transform(v, code)).alias("codes"),
        low.cast(_F).alias("min"), F.when(flat, F.lit(0.0)).otherwise(span / F.lit(255).cast(_F)).cast(_F).alias("scale"),
    )


def restored(q: Column) -> Column:
    """The float vector that codes stand for: min + code * scale."""
    return F.transform(q["codes"], lambda c: (q["min"] + c.cast(_F) * q["scale"]).cast(_F))


def compact_distance(metric: Metric, query: Column, q: Column, query_norm: Column | None = None) -> Column:
    """Distance of a float query to a quantized vector; the cosine similarity of a constant vector is 0."""
    d = distance(metric, query, restored(q), query_norm)
    return F.when(q["scale"] == 0, 1.0).otherwise(d) if metric is Metric.COSINE else d


def symmetric_distance(metric: Metric, a: Column, b: Column) -> Column:
    """Distance of two quantized vectors by sums of integer codes and the affine map of each."""
    n = F.size(a["codes"]).cast("double")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    cross = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("bigint") * r), F.lit(0).cast("bigint"), lambda s, v: s + v)
    ma, sa, mb, sb = (q[f].cast("double") for q in (a, b) for f in ("min", "scale"))

    def product(x: Column, y: Column, mx: Column, sx: Column, my: Column, sy: Column) -> Column:
        return n * mx * my + mx * sy * total(y) + my * sx * total(x) + sx * sy * cross(x, y)

    ab = product(a["codes"], b["codes"], ma, sa, mb, sb)
    if metric is Metric.DOT:
        return -ab
    aa, bb = product(a["codes"], a["codes"], ma, sa, ma, sa), product(b["codes"], b["codes"], mb, sb, mb, sb)
    if metric is Metric.EUCLIDEAN:
        return F.greatest(F.lit(0.0), aa + bb - 2 * ab)
    scale = F.sqrt(aa * bb)
    return F.lit(1.0) - F.when((sa == 0) | (sb == 0) | (scale < 1e-10), 0.0).otherwise(ab / scale)
