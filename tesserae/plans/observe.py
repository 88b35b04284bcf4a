"""Audit events, metrics and health."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .access import mask

AUDIT = "at timestamp, actor string, role string, client string, action string, resource string, detail string, outcome string"


def audit(spark: SparkSession, path: str, key: str | None, action: str, resource: str, outcome: str, role: str | None = None, client: str = "-", detail: str = "") -> None:
    """Append one event; keys are masked."""
    row = (datetime.now(timezone.utc), mask(key) if key else "anonymous", role, client, action, resource, detail, outcome)
    spark.createDataFrame([row], AUDIT).write.mode("append").parquet(path)


def metrics(requests: DataFrame, duration: str) -> DataFrame:
    """(collection, op, requests, mean) of a table of requests."""
    return requests.groupBy("collection", "op").agg(F.count("*").alias("requests"), F.round(F.avg(duration), 6).alias("mean"))


def health(memory_used: int, memory_cap: int | None, disk_free: int, log_bytes: int) -> dict:
    """Degraded from 90 % of the memory or below 100 MB of disk; a log above 1 GB is a warning."""
    degraded = bool(memory_cap and memory_used >= 0.9 * memory_cap) or disk_free < 100 * 1024 * 1024
    return {"status": "degraded" if degraded else "ok", "log_warning": log_bytes > 1 << 30}
