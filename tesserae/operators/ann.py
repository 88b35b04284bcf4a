"""Approximate search: inverted lists round k-means centres, and product quantization.

Neither is a graph index. Centres are fitted on at most ``sample`` vectors; every vector is indexed. An index is written once, a
folder a list, and a search reads the folders that it probes: ``nprobe`` of them, or, as ``ef_search``, enough for that many
vectors. ``m`` and ``ef_construction`` mean nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, distance, vector
from ..functions.limits import PQ_CENTROIDS, PQ_ITERATIONS
from ..sources.scratch import new_path

SHORT = 1e-4  # two vectors of at least this length have a cosine similarity that is not put to 0
TILE = (512, 1024)  # queries and vectors whose scores are held at once


def kmeans(x: np.ndarray, k: int, iterations: int = PQ_ITERATIONS, seed: int = 42) -> np.ndarray:
    """Centres by Lloyd's rounds from k-means++ seeds; rows of zeros fill up if there are fewer points than centres."""
    rng = np.random.default_rng(seed)
    n = min(k, len(x))
    out = np.zeros((k, x.shape[1]))
    if not n:
        return out
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < n:
        p = near / near.sum() if near.sum() > 0 else None
        centres.append(x[rng.choice(len(x), p=p)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(iterations):
        own = nearest(x, c)
        for j in range(n):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    out[:n] = c
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by squared distance, the first among equals."""
    return ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]).argmin(1)


def _sample(docs: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, chosen by the hash of their number, to fit centres on."""
    rows = docs.where("embedding is not null").orderBy(F.xxhash64("seq")).limit(most).select("embedding").collect()
    return np.array([r.embedding for r in rows], float)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length (zeros stay) and their lengths before."""
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


@dataclass
class Ivf:
    """Vectors with their list number, the centres, and how many vectors each list has."""

    rows: DataFrame
    centres: np.ndarray
    metric: Metric
    sizes: np.ndarray

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Ivf":
        """A written index."""
        table = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # one row a list
        return cls(spark.read.parquet(f"{path}/rows"), np.array([r.centre for r in table], float), Metric.of(table[0].metric), np.array([r.size for r in table]))

    def near(self, query) -> np.ndarray:
        """The lists, nearest first; those of cosine by the direction of the query."""
        q = np.asarray(query, float)
        if self.metric is Metric.COSINE:
            q = _unit(q[None])[0][0]
        return np.argsort(((self.centres - q) ** 2).sum(1), kind="stable")

    def lists(self, query, k: int, nprobe: int | None = None, ef_search: int | None = None) -> np.ndarray:
        """The lists to probe: ``nprobe``, or enough for ``ef_search`` vectors, and more until they hold ``k`` if all do."""
        order = self.near(query)
        held = np.cumsum(self.sizes[order])
        enough = int(np.searchsorted(held, max(k, ef_search or 0), "left")) + 1
        return order[: max(enough, nprobe or 1)]

    def probe(self, query, k: int, nprobe: int | None = None, ef_search: int | None = None) -> DataFrame:
        """The rows of the probed lists: a filter on the folders of the stored index."""
        return self.rows.where(F.col("list").isin([int(x) for x in self.lists(query, k, nprobe, ef_search)]))

    def search(self, query, k: int, nprobe: int | None = None, ef_search: int | None = None) -> DataFrame:
        """(seq, score) of the k best in the probed lists, reranked by exact distance."""
        score = (1 - distance(self.metric, vector(query), F.col("embedding"))).alias("score")
        return self.probe(query, k, nprobe, ef_search).select("seq", score).orderBy(F.desc("score"), F.desc("seq")).limit(k)

    def batch(self, queries: DataFrame, k: int, nprobe: int, block: int | None = None) -> DataFrame:
        """(query_id, seq, score) of the k best of each row of ``queries`` (query_id, query) in its ``nprobe`` nearest lists.

        Queries go out in blocks; a batch of vectors of one list meets those that probe it.
        """
        spark, out = queries.sparkSession, None
        for ids, q in blocks(queries, k, block):
            mask = np.zeros((len(ids), len(self.centres)), bool)
            for i, one in enumerate(q):
                mask[i, self.lists(one, k, nprobe)] = True
            found = self.rows.mapInArrow(_probe(spark.sparkContext.broadcast((ids, q, mask)), self.metric, k), "query_id bigint, seq bigint, score double")
            out = found if out is None else out.unionByName(found)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("seq"))
        return out.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def blocks(queries: DataFrame, k: int, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query_id, query) in blocks of ``block`` rows, or as many as have two million results, one block at least.

    The driver holds one partition and one block at a time.
    """
    block = block or max(1, min(20_000, 2_000_000 // max(k, 1)))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query").cast("array<float>").alias("query")).dropna()
    ids, q, none = [], [], True
    for r in asked.toLocalIterator():
        ids.append(r[0])
        q.append(np.array(r[1], np.float32))
        if len(ids) == block:
            yield np.array(ids, np.int64), np.stack(q)
            ids, q, none = [], [], False
    if ids or none:
        yield np.array(ids, np.int64), np.stack(q) if q else np.zeros((0, 0), np.float32)


def _probe(shared, metric: Metric, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, mask = shared.value
        top = Top(metric, q, k)
        for b in batches:
            if not b.num_rows or not len(ids) or k <= 0:
                continue
            seq, lists = b.column("seq").to_numpy(), b.column("list").to_numpy()
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(seq), -1)
            for one in np.unique(lists):
                at, who = np.flatnonzero(lists == one), np.flatnonzero(mask[:, one])
                if len(who):
                    top.offer(seq[at], v[at], who)
            top.trim()
        if len(top.row):
            yield pa.record_batch([pa.array(ids[top.row]), pa.array(top.seq), pa.array(top.score)], ["query_id", "seq", "score"])

    return run


class Top:
    """The k best vectors so far of each row of ``q``.

    Scores are made tile by tile, so that what is held grows neither with the vectors nor with the product of batch and
    queries; a score below the k-th of its query is dropped as soon as it is made.
    """

    def __init__(self, metric: Metric, q: np.ndarray, k: int):
        self.metric, self.q, self.k = metric, q, k
        self.row, self.seq, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(q), -np.inf)
        self.new: list[tuple] = []
        self.waiting = 0

    def offer(self, seq: np.ndarray, v: np.ndarray, who: np.ndarray | None = None) -> None:
        """Vectors that the queries ``who``, or all, are compared with."""
        who = np.arange(len(self.q)) if who is None else who
        for j in range(0, len(seq), TILE[1]):
            some = v[j : j + TILE[1]].astype(float)
            for i in range(0, len(who), TILE[0]):
                own = who[i : i + TILE[0]]
                s = scores(self.metric, self.q[own].astype(float), some)
                floor = self.floor[own]
                r, c = best(s, self.k) if np.isneginf(floor).any() else np.nonzero(s >= floor[:, None])
                if len(r):
                    self.new.append((own[r], seq[j + c], s[r, c]))
                    self.waiting += len(r)
            if self.waiting > max(1 << 18, len(self.row)):
                self.trim()

    def trim(self) -> None:
        """Leave k a query, and raise the floors."""
        if not self.new:
            return
        row, seq, score = (np.concatenate(x) for x in zip((self.row, self.seq, self.score), *self.new))
        keep = first(row, seq, score, self.k)
        self.row, self.seq, self.score, self.new, self.waiting = row[keep], seq[keep], score[keep], [], 0
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.q)) == self.k)
        least = np.full(len(self.q), np.inf)
        np.minimum.at(least, self.row, self.score)
        self.floor[full] = least[full]


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row of ``s``, ties at the k-th place too; only these need to be sorted."""
    n = s.shape[1]
    if n <= k:
        return np.divmod(np.arange(s.size), n)
    return np.nonzero(s >= np.partition(s, n - k, axis=1)[:, n - k][:, None])


def first(row: np.ndarray, seq: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row, by score, then by the larger number."""
    order = np.lexsort((-seq, -score, row))
    own = row[order]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    return order[np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own)))) < k]


def scores(metric: Metric, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 - distance of each query to each vector."""
    s = q @ v.T
    if metric is Metric.EUCLIDEAN:
        return 1 - ((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * s)
    if metric is Metric.DOT:
        return 1 + s
    scale = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None]
    return np.divide(s, scale, out=np.zeros_like(s), where=scale >= 1e-10)


def build_ivf(docs: DataFrame, lists: int = 16, metric: Metric | str = Metric.COSINE, sample: int = 20_000, seed: int = 42, path: str | None = None) -> Ivf:
    """Centres fitted on at most ``sample`` vectors; every vector is written to the folder of its nearest centre.

    For cosine, centres and vectors are compared at unit length. Without a path the index goes to the shared folder.
    """
    metric, spark = Metric.of(metric), docs.sparkSession
    path = path or new_path(spark, "vector-index")
    x = _sample(docs, sample)
    centres = kmeans(_unit(x)[0] if metric is Metric.COSINE and len(x) else x, lists, seed=seed) if len(x) else np.zeros((lists, 1))
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                own = nearest(_unit(v)[0] if metric is Metric.COSINE else v, shared.value)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(own.astype(np.int32))], ["seq", "embedding", "list"])

    rows = docs.where("embedding is not null").select("seq", "embedding").mapInArrow(run, "seq bigint, embedding array<float>, list int")
    # a large list is spread over several files, so that no task writes it alone
    rows.repartition("list", F.pmod(F.xxhash64("seq"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/rows")
    # an index of no vectors has no folder to tell its schema
    stored = spark.read.schema("seq bigint, embedding array<float>, list int").parquet(f"{path}/rows")
    size = dict(tuple(r) for r in stored.groupBy("list").count().collect())
    table = [(i, [float(x) for x in c], int(size.get(i, 0)), metric.value) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "list int, centre array<double>, size bigint, metric string").coalesce(1).write.parquet(f"{path}/centres")
    return Ivf(stored, centres, metric, np.array([r[2] for r in table]))


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of true neighbours, of one query or by ``query_id``, that were found."""
    keys = [c for c in ("query_id", "seq") if c in true.columns]
    n = true.count()
    return true.join(found.select(*keys), keys, "left_semi").count() / n if n else 1.0


@dataclass
class Pq:
    """Centres [subspaces, 256, dim / subspaces] of a product quantizer; for cosine, those of vectors of unit length."""

    centres: np.ndarray
    metric: Metric

    @classmethod
    def train(cls, docs: DataFrame, subspaces: int, sample: int = 20_000, seed: int = 42, metric: Metric | str = Metric.COSINE) -> "Pq":
        """One k-means a subspace on at most ``sample`` vectors; ValueError unless the dimension divides."""
        x, metric = _sample(docs, sample), Metric.of(metric)
        if not len(x) or subspaces < 1 or x.shape[1] % subspaces:
            raise ValueError("the dimension must be a multiple of the number of subspaces, and there must be vectors")
        x = _unit(x)[0] if metric is Metric.COSINE else x
        return cls(np.stack([kmeans(part, PQ_CENTROIDS, seed=seed + j) for j, part in enumerate(np.split(x, subspaces, 1))]), metric)

    def write(self, docs: DataFrame, path: str) -> DataFrame:
        """Store the centres and the codes of all vectors; the stored codes."""
        spark = docs.sparkSession
        rows = [(j, c, [float(x) for x in v], self.metric.value) for j, part in enumerate(self.centres) for c, v in enumerate(part)]
        spark.createDataFrame(rows, "part int, code int, centre array<double>, metric string").coalesce(1).write.parquet(f"{path}/centres")
        self.encode(docs).write.parquet(f"{path}/codes")
        return spark.read.parquet(f"{path}/codes")

    def add(self, docs: DataFrame, path: str) -> None:
        """Store the codes of more vectors by the centres that are there."""
        self.encode(docs).write.mode("append").parquet(f"{path}/codes")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> tuple["Pq", DataFrame]:
        """A stored quantizer and its codes."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("part", "code").collect()  # 256 a subspace
        centres = np.array([r.centre for r in rows]).reshape(rows[-1].part + 1, PQ_CENTROIDS, -1)
        return cls(centres, Metric.of(rows[0].metric)), spark.read.parquet(f"{path}/codes")

    def encode(self, docs: DataFrame) -> DataFrame:
        """(seq, embedding, code, err): the nearest centre in each subspace, and how far all of them are from the vector.

        A vector too short to be told from zero has an infinite ``err``, so that no bound leaves it out.
        """
        shared, cosine = docs.sparkSession.sparkContext.broadcast(self.centres), self.metric is Metric.COSINE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                if b.num_rows:
                    v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                    v, norm = _unit(v) if cosine else (v, np.ones(len(v)))
                    parts = np.split(v, len(c), 1)
                    code = np.stack([nearest(p, c[j]) for j, p in enumerate(parts)], 1).astype(np.int16)
                    err = np.sqrt(sum(((p - c[j][code[:, j]]) ** 2).sum(1) for j, p in enumerate(parts)))
                    err[norm < SHORT] = np.inf
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(list(code), pa.list_(pa.int16())), pa.array(err)], ["seq", "embedding", "code", "err"])

        return docs.where("embedding is not null").select("seq", "embedding").mapInArrow(run, "seq bigint, embedding array<float>, code array<smallint>, err double")

    def table(self, query: np.ndarray) -> np.ndarray:
        """Partial scores [subspaces, 256]: products, or negated squared distances."""
        parts = np.split(query, len(self.centres))
        if self.metric is Metric.EUCLIDEAN:
            return np.stack([-((c - q) ** 2).sum(1) for c, q in zip(self.centres, parts)])
        return np.stack([c @ q for c, q in zip(self.centres, parts)])

    def search(self, coded: DataFrame, query, k: int, oversample: int = 4) -> DataFrame:
        """(seq, score) of the k best, all of them.

        The k-th exact score of the first ``k * oversample`` candidates by table lookups is a floor; then every row whose
        lookup and ``err`` let it reach the floor is reranked by exact distance.
        """
        q = np.asarray(query, np.float32).astype(float)
        length = float(np.sqrt((q * q).sum()))
        cosine, euclidean = self.metric is Metric.COSINE, self.metric is Metric.EUCLIDEAN
        table = self.table(q / length if cosine and length else q)
        reach = 1.0 if cosine else length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near, err = table[np.arange(len(table)), code].sum(1), b.column(3).to_numpy()
                if euclidean:
                    bound = 1 - np.maximum(np.sqrt(np.maximum(-near, 0)) - err, 0) ** 2
                else:
                    bound = near + reach * err + (0 if cosine else 1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(near), pa.array(bound)], ["seq", "embedding", "near", "bound"])

        rows = coded.select("seq", "embedding", "code", "err").mapInArrow(run, "seq bigint, embedding array<float>, near double, bound double")
        score = (1 - distance(self.metric, vector(query), F.col("embedding"))).alias("score")
        first = rows.orderBy(F.desc("near"), F.desc("seq")).limit(k * oversample).select("seq", score)
        floor = first.orderBy(F.desc("score"), F.desc("seq")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        # a cosine similarity of 0 stands for that to a query too short, whatever the bound
        if floor.n == k and k > 0 and not (cosine and length < SHORT):
            rows = rows.where(F.col("bound") >= floor.s - 1e-6 * (1 + abs(floor.s)))
        return rows.select("seq", score).orderBy(F.desc("score"), F.desc("seq")).limit(k)
