"""Exact BM25 top-k of many queries by MaxScore over document shards.

A task indexes its documents in shards. For each query the terms whose summed bounds cannot reach the k-th score so far
are non-essential: candidates come from the postings of the others alone, and the non-essential lists are probed, best
bound first, only for candidates that can still get in. The k best of every task are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._ids import numbered
from ._text import Tokens, released, slices

_SLACK = 2e-6  # scores are compared after rounding to six decimals


@dataclass(frozen=True)
class Params:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    query_batch: int = 5000


class Queries:
    """Hashed terms of a batch of queries: ``terms`` (sorted, distinct), and for each query its term numbers and their counts."""

    def __init__(self, rows: list[tuple[int, str]]):
        column = pa.array([r[1] for r in rows], pa.string())
        hashes, self.ids, parts = [], [r[0] for r in rows], []
        for i, j, data, offsets in slices(column):
            t = Tokens(data, offsets)
            parts += [t.hash[t.first[k] : t.first[k + 1]] for k in range(j - i)]
            hashes.append(t.hash)
        self.terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.of = []
        for h in parts:
            u, c = np.unique(h, return_counts=True)
            self.of.append((np.searchsorted(self.terms, u), c.astype(float)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, term numbers) of the tokens that are query terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == h)
        return hit, at[hit]


def _count(q):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = q.value
        df, docs, words = np.zeros(len(queries.terms), np.int64), 0, 0
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                t = Tokens(data, offsets)
                at, term = queries.find(t.hash)
                df += np.bincount(np.unique(term * (j - i) + t.doc[at]) // (j - i), minlength=len(df))
                docs, words = docs + j - i, words + len(t.hash)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [docs, words]))], ["term", "n"])

    return released(run)


class Shard:
    """Postings of the query terms in some documents, in order of term, then document."""

    def __init__(self, queries: Queries, t: Tokens, ids: np.ndarray, idf: np.ndarray, mean: float, p: Params):
        n = len(ids)
        at, term = queries.find(t.hash)
        key, tf = np.unique(term * n + t.doc[at], return_counts=True)
        term, self.doc = key // n, key % n
        length = np.diff(t.first)
        self.score = idf[term] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length[self.doc] / mean))
        self.first = np.searchsorted(term, np.arange(len(queries.terms) + 1))
        self.bound = np.zeros(len(queries.terms))
        np.maximum.at(self.bound, term, self.score)
        self.ids, self.p = ids, p
        self.total, self.seen = np.zeros(n), np.zeros(n, bool)  # of one query at a time; only what it touches is cleared

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.first[term], self.first[term + 1])
        return self.doc[s], self.score[s]

    def probe(self, term: int, docs: np.ndarray) -> np.ndarray:
        d, s = self.list(term)
        if not len(d):
            return np.zeros(len(docs))
        at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
        return np.where(d[at] == docs, s[at], 0.0)

    def top(self, terms: np.ndarray, counts: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of all documents of this shard that may be among the k best, given the k-th score so far."""
        bound = self.bound[terms] * counts
        some = np.flatnonzero(bound > 0)
        order = some[np.argsort(bound[some], kind="stable")]
        reach = np.cumsum(bound[order])
        split = int(np.searchsorted(reach, floor - _SLACK, "left"))  # below it: non-essential
        if split == len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        total, seen, parts = self.total, self.seen, []
        for x in order[split:]:
            d, s = self.list(terms[x])
            new = d[~seen[d]]
            total[new], seen[new] = 0, True
            total[d] += s * counts[x]
            parts.append(new)
        docs = np.concatenate(parts)
        seen[docs] = False
        for k in range(split - 1, -1, -1):
            docs = docs[total[docs] + reach[k] >= floor - _SLACK]
            total[docs] += self.probe(terms[order[k]], docs) * counts[order[k]]
        docs = docs[total[docs] >= floor - _SLACK]
        if len(docs) > self.p.k:
            kth = np.partition(total[docs], len(docs) - self.p.k)[len(docs) - self.p.k]
            docs = docs[total[docs] >= kth - _SLACK]
        # summed once more in the order of the terms, so that equal documents score alike in every shard
        exact = np.zeros(len(docs))
        for x in some:
            exact += self.probe(terms[x], docs) * counts[x]
        return self.ids[docs], np.round(exact, 6)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(q, stats, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (idf, mean) = q.value, stats.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries.of)
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, offsets in slices(b.column(1), 4 << 20):
                shard = Shard(queries, Tokens(data, offsets), ids[i:j], idf, mean, p)
                for n, (terms, counts) in enumerate(queries.of):
                    floor = best[n][1][-1] if len(best[n][0]) == p.k else 0.0
                    more = shard.top(terms, counts, floor)
                    if len(more[0]):
                        best[n] = _best(np.concatenate([best[n][0], more[0]]), np.concatenate([best[n][1], more[1]]), p.k)
        for n, (ids, scores) in enumerate(best):
            if len(ids):
                yield pa.record_batch([pa.array(np.full(len(ids), queries.ids[n], np.int64)), pa.array(ids), pa.array(scores)], ["query_id", "doc_id", "score"])

    return released(run)


def search(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, p: Params = Params()) -> DataFrame:
    """(query_id, doc_id, rank, score): the ``k`` best documents of every query, by score to six decimals, then by id.

    Every row of ``queries`` with an id and text is a query; repeated ids are searched once, with the least of their texts.
    Rows of ``docs`` with a null id or text are no documents; empty texts count in the statistics; repeated rows are
    documents of their own. A query without a word of the corpus has no rows. Ids of documents may be of any kind.

    Queries are sent to the tasks in batches of ``query_batch``, so what is broadcast does not grow with their number.
    """
    return numbered(docs.select("doc_id", "text").dropna(), lambda rows: _ranked(rows, queries, query_id, query_text, p), "doc_id")


def _ranked(rows: DataFrame, queries: DataFrame, query_id: str, query_text: str, p: Params) -> DataFrame:
    spark = rows.sparkSession
    asked = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_text).alias("q")).dropna().groupBy("id").agg(F.min("q").alias("q"))
    parts = -(-asked.count() // p.query_batch) or 1
    out = None
    for part in range(parts):
        mine = Queries(sorted(tuple(r) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()))
        q = spark.sparkContext.broadcast(mine)
        counts = dict(rows.mapInArrow(_count(q), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
        n, words = counts.pop(-1, 0), counts.pop(-2, 0)
        df = np.zeros(len(mine.terms))
        df[list(counts)] = list(counts.values())
        stats = spark.sparkContext.broadcast((np.log((n - df + 0.5) / (df + 0.5) + 1), max(words, 1) / max(n, 1)))
        found = rows.mapInArrow(_search(q, stats, p), "query_id bigint, doc_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "doc_id", "rank", "score")


_FOLD = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x80-\\x{{10ffff}}]+')"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_FOLD.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
tf AS (SELECT row, doc_id, l, t, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS l, unnest(w) AS t FROM d) GROUP BY row, doc_id, l, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest({_FOLD.format("q")}) AS t FROM (SELECT item_id AS id, min(text) AS q FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id)) GROUP BY id, t),
r AS (SELECT id, doc_id, round(sum(c * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY id, row, doc_id)
SELECT id AS query_id, doc_id, CAST(rank AS INTEGER) AS rank, score
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10"""
