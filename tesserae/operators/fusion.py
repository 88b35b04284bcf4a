"""Fusion of a vector and a keyword result, each (seq, score) of at most k rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.limits import F32_EPSILON, RRF_K


def _top(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), F.desc("seq")).limit(max(k, 0))


def rrf(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Sum of 1 / (60 + rank) over both lists, ranks from 1."""
    order = Window.orderBy(F.desc("score"), F.desc("seq"))  # over k rows at most
    ranked = [x.select("seq", (1 / (RRF_K + F.row_number().over(order))).alias("part")) for x in (vector, keyword)]
    both = ranked[0].unionByName(ranked[1]).groupBy("seq").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return _top(both.select("seq", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x).alias("score")), k)


def _scaled(x: DataFrame) -> DataFrame:
    low, high = F.min("score").over(Window.partitionBy()), F.max("score").over(Window.partitionBy())
    return x.select("seq", F.when(high - low < F32_EPSILON, 1.0).otherwise((F.col("score") - low) / (high - low)).alias("score"))


def linear(vector: DataFrame, keyword: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword after scaling each list to 0 .. 1; a missing side adds nothing."""
    v, w = _scaled(vector).withColumnRenamed("score", "v"), _scaled(keyword).withColumnRenamed("score", "w")
    zero = F.lit(0.0)
    score = alpha * F.coalesce("v", zero) + (1 - alpha) * F.coalesce("w", zero)
    return _top(v.join(w, "seq", "full_outer").select("seq", score.alias("score")), k)


def fuse(vector: DataFrame, keyword: DataFrame, k: int, alpha: float, method: str) -> DataFrame:
    if method == "linear":
        return linear(vector, keyword, alpha, k)
    if method != "rrf":
        warnings.warn(f"unknown fusion method {method!r}; reciprocal ranks are used", stacklevel=2)
    return rrf(vector, keyword, k)
