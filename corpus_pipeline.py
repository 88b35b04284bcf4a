"""From raw documents to sampled, encoded training rows: quality, near copies, secrets, mixture, pieces.

Every stage takes empty tables, nulls in any column, repeated rows and columns beyond those of documents, which it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import mixing, near, pieces, quality, secrets
from tesserae.sources.scratch import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the labels of these documents, doesn't reject.

    Documents without a text go; an empty text is judged by the bias alone; repeated rows stay or go together.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all others.

    Of equal rows one stays; rows of one id with different texts are documents of their own; rows without an id, a text or a
    word are copies of nothing and stay.
    """
    return near.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by the name of the rule that found them. No row goes, nulls and repeats neither."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that bring sources, languages and topics to their target weights.

    A null source or language, or a document without an embedding, counts as 'none'; texts without a token are never drawn; the
    rows of an id are drawn together, and those without an id always.
    """
    return mixing.sample(docs, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of a sampled segmentation, and whether they decode to the text: both null for a null text."""
    return pieces.encode(docs, text=True)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
#: The stages learn weights and hash in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
