"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import new_path
from . import chunks, katz, maxscore, mixing, near, pieces, quality, repeats, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by the first versions of the rules, then one by the present: it looks only at the pairs of the two that changed."""
    docs, ledger = _table(spark, sf_dir, "documents"), new_path(spark, "blob-ledger")
    secrets.update(docs, ledger, secrets.FIRST_RULES)
    return secrets.scan(docs, ledger)


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunked(_table(spark, sf_dir, "pages"), "page_id", "html")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.train_and_score(_table(spark, sf_dir, "documents"), katz.Params(order=3, parts=4))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return kept.where(kept.quality >= quality.Params().threshold)


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "item_id", "text")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings"), weights=True)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_media_chunks, op3_toxicity, op4_katz, op5_quality, op6_maxscore, op7_repeats, op8_mixing, op9_near_duplicates, op10_pieces)
}
ORACLE_SQL: dict[str, str] = {"op1_secret_scan": secrets.SCAN_SQL, "op6_maxscore": maxscore.SEARCH_SQL, "op8_mixing": mixing.sample_sql()}
