"""Ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) from ranked (query_id, seq, rank) and judged (query_id, seq, gain); queries without gain have 0."""
    gain = F.sum(F.col("gain") / F.log2(F.col("rank") + 1))
    got = ranked.where(F.col("rank") <= k).join(judged, ["query_id", "seq"]).groupBy("query_id").agg(gain.alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "seq")
    best = judged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(gain.alias("ideal"))
    ratio = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return best.join(got, "query_id", "left").select("query_id", ratio.alias("ndcg"))
