"""Vector, keyword and hybrid search over a collection (seq, id, text, embedding, metadata)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, distance, vector
from ..functions.filters import compile_filter
from ..functions.limits import DEFAULT_ALPHA, DEFAULT_FUSION, DEFAULT_K
from ..functions.quantize import codes, compact_distance
from ..sources.scratch import materialize
from . import bm25
from .ann import Top, blocks
from .fusion import fuse


def _at_least(rows: DataFrame, threshold: float | None) -> DataFrame:
    return rows if threshold is None else rows.where(F.col("score") >= threshold)


def vector_search(docs: DataFrame, query, k: int = DEFAULT_K, metric: Metric | str = Metric.COSINE, min_similarity: float | None = None, where: dict | None = None, mode: str = "exact") -> DataFrame:
    """(seq, score) of the ``k`` nearest documents that pass ``where``, then those of at least ``min_similarity``.

    The filter comes before the ranking, so k rows are found if there are as many. ``mode='compact'`` ranks by codes of one
    byte a component (column ``quantized`` if there, else made on the fly).
    """
    q = vector(query)
    known = F.lit(float(np.sqrt(np.sum(np.square(np.asarray(query, np.float32).astype(float))))))
    rows = docs.where(compile_filter(where)) if where else docs
    if mode == "compact":
        stored = F.col("quantized") if "quantized" in docs.columns else codes(F.col("embedding"))
        d = compact_distance(Metric.of(metric), q, stored, known)
    else:
        d = distance(Metric.of(metric), q, F.col("embedding"), known)
    ranked = rows.where("embedding is not null").select("seq", (1 - d).alias("score")).orderBy(F.desc("score"), F.desc("seq")).limit(max(k, 0))
    return _at_least(ranked, min_similarity)


def batch_search(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: Metric | str = Metric.COSINE, block: int | None = None) -> DataFrame:
    """(query_id, seq, score) of the ``k`` nearest documents of each row of ``queries`` (query_id, query).

    Each task compares its vectors with a block of queries, tile by tile, and keeps k rows a query; the survivors are merged by
    a window. ``queries`` are broadcast in blocks, so that what a task holds does not grow with them, and the vectors are written
    once, as each block meets all of them.
    """
    metric, spark = Metric.of(metric), docs.sparkSession

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            top = Top(metric, q, k)
            for b in batches:
                if b.num_rows and len(ids) and k > 0:
                    top.offer(b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            top.trim()
            if len(top.row):
                yield pa.record_batch([pa.array(ids[top.row]), pa.array(top.seq), pa.array(top.score)], ["query_id", "seq", "score"])

        return run

    vectors, out = materialize(docs.where("embedding is not null").select("seq", "embedding"), "vectors"), None
    for one in blocks(queries, k, block):
        found = vectors.mapInArrow(searcher(spark.sparkContext.broadcast(one)), "query_id bigint, seq bigint, score double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("seq"))
    return out.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def keyword_search(docs: DataFrame, query: str, k: int = DEFAULT_K, where: dict | None = None, prefilter: bool = False) -> DataFrame:
    """(seq, score) by BM25. The filter is applied to the k best rows; with ``prefilter`` to what is ranked."""
    if not where:
        return bm25.search(docs, query, k)
    if prefilter:
        return bm25.search(docs, query, k, where=compile_filter(where))
    # the few best rows meet the documents again
    passing = docs.where(compile_filter(where)).select("seq")
    return bm25.search(docs, query, k).join(passing, "seq", "left_semi")


def hybrid_search(docs: DataFrame, query=None, text: str | None = None, k: int = DEFAULT_K, alpha: float = DEFAULT_ALPHA, method: str = DEFAULT_FUSION, min_similarity: float | None = None, where: dict | None = None, metric: Metric | str = Metric.COSINE, mode: str = "exact") -> DataFrame:
    """Both sides' k best, fused; the threshold is on the fused score. Either side may be missing."""
    empty = docs.sparkSession.createDataFrame([], "seq bigint, score double")
    v = empty if query is None else vector_search(docs, query, k, metric, where=where, mode=mode)
    w = empty if not text else keyword_search(docs, text, k, where)
    return _at_least(fuse(v, w, k, alpha, method), min_similarity)


def search(docs: DataFrame, query=None, text: str | None = None, k: int = DEFAULT_K, offset: int = 0, alpha: float = DEFAULT_ALPHA, method: str = DEFAULT_FUSION, min_similarity: float | None = None, where: dict | None = None, metric: Metric | str = Metric.COSINE, mode: str = "exact", prefilter: bool = False) -> DataFrame:
    """The mode that the arguments ask for, then the page of ``k`` rows from ``offset``; ValueError without a query."""
    n = offset + k if k > 0 else 0
    if query is not None and text is not None:
        rows = hybrid_search(docs, query, text, n, alpha, method, min_similarity, where, metric, mode)
    elif query is not None:
        rows = vector_search(docs, query, n, metric, min_similarity, where, mode)
    elif text is not None:
        rows = keyword_search(docs, text, n, where, prefilter)
    else:
        raise ValueError("a query vector or a query text is needed")
    return page(rows, k, offset)


def page(rows: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """(seq, score, rank) of one page of a ranked window."""
    order = Window.orderBy(F.desc("score"), F.desc("seq"))  # over offset + k rows at most
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def with_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts and metadata joined to ranked rows, after the limit."""
    return docs.join(F.broadcast(rows), "seq").select("seq", "id", "text", "metadata", "score", *[c for c in rows.columns if c == "rank"])
