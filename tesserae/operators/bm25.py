"""BM25 keyword search: over texts in one pass, or over a stored inverted index that follows changes."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.limits import BM25_B, BM25_K1
from ..functions.text import STOP_WORDS, runs, tokens
from ..sources.scratch import materialize, new_path, tidy_shuffles

CHUNK = 1 << 20  # runs of letters and digits that a task counts at once
_PACKED = "term string, seq array<bigint>, dl array<int>, tf array<int>"


def doc_terms(docs: DataFrame) -> DataFrame:
    """(seq, terms) of every document; a row without a text, such as a vector alone, is none."""
    return docs.where("text is not null").select("seq", tokens(F.col("text")).alias("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, seq, tf)."""
    return doc_terms(docs).select("seq", F.explode("terms").alias("term")).groupBy("term", "seq").agg(F.count("*").cast("int").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """(seq, dl): kept tokens of every document, 0 included."""
    return doc_terms(docs).select("seq", F.size("terms").alias("dl"))


def _count(seq: np.ndarray, words: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms; then term, row and tf of each posting, by term and row; and the kept tokens of each row.

    ``words`` has the runs of all rows, ``row`` the row of each. Which are kept is told by the distinct ones alone.
    """
    coded = words.dictionary_encode()
    terms = coded.dictionary
    kept = pc.and_(pc.greater(pc.binary_length(terms), 1), pc.invert(pc.is_in(terms, pa.array(STOP_WORDS, terms.type))))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    good = kept.to_numpy(zero_copy_only=False)[code] if len(terms) else np.zeros(0, bool)
    code, row = code[good], row[good]
    key, tf = np.unique(code * len(seq) + row, return_counts=True)
    term, at = np.divmod(key, max(len(seq), 1))
    return terms, term, at, tf, np.bincount(row, minlength=len(seq))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(seq, words, row) of about ``most`` words, from batches of (seq, words); a row alone may have more."""

    def joined():
        return np.concatenate([s for s, _, _ in held]), pa.concat_arrays([w for _, w, _ in held]), np.repeat(np.arange(sum(len(n) for _, _, n in held)), np.concatenate([n for _, _, n in held]))

    held, size = [], 0
    for b in batches:
        seq, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        ends = np.cumsum(n := pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(seq):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most - size, "right")))
            held.append((seq[start:stop], lists.slice(start, stop - start).flatten(), n[start:stop]))
            size, start = size + int(ends[stop - 1] - done), stop
            if size >= most or start < len(seq):
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _pack(most: int):
    """Postings of each chunk, a row a term; the lengths of its documents are a row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, words, own in _chunks(batches, most):
            terms, term, at, tf, dl = _count(seq, words, own)
            seq, dl = seq.astype(np.int64), dl.astype(np.int32)
            heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
            ends = np.append(np.append(heads, len(term)), len(term) + len(seq)).astype(np.int32)
            lists = (np.append(seq[at], seq), np.append(dl[at], dl), np.append(tf, np.zeros(len(seq))).astype(np.int32))
            names = pa.concat_arrays([terms.take(pa.array(term[heads])).cast(pa.string()), pa.nulls(1, pa.string())])
            whole = pa.record_batch([names, *[pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in lists]], ["term", "seq", "dl", "tf"])
            for i in range(0, whole.num_rows, 50_000):
                yield whole.slice(i, 50_000)

    return run


def packed(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """(term, seq, dl, tf) with a list of documents a term and chunk, and a row without a term with all documents of the chunk.

    A document is counted where its text is read: nothing is shuffled, and only texts split by Spark go to Python.
    """
    return docs.where("text is not null and seq is not null").select(F.col("seq").cast("bigint").alias("seq"), runs(F.col("text")).alias("w")).mapInArrow(_pack(most), _PACKED)


def _tally(most: int):
    """How many rows of each chunk have a term; a row without a term has the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, words, own in _chunks(batches, most):
            terms, term, *_ = _count(size, words, own)
            df = np.bincount(term, minlength=len(terms))
            found = np.flatnonzero(df)
            names = pa.concat_arrays([terms.take(pa.array(found)).cast(pa.string()), pa.nulls(1, pa.string())])
            whole = pa.record_batch([names, pa.array(np.append(df[found], 0)), pa.array(np.append(np.zeros(len(found), np.int64), size.sum()))], ["term", "df", "size"])
            for i in range(0, whole.num_rows, 50_000):
                yield whole.slice(i, 50_000)

    return run


def tally(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """(term, df, size) of rows (size, text): sums over chunks, to be added up by term. Without a term: the sum of the sizes."""
    words = F.coalesce(runs(F.col("text")), F.array().cast("array<string>"))
    return rows.select(F.col("size").cast("bigint").alias("size"), words.alias("w")).mapInArrow(_tally(most), "term string, df bigint, size bigint")


def unpacked(rows: DataFrame) -> DataFrame:
    """(term, seq, dl, tf) of one document each."""
    return rows.select("term", F.inline(F.arrays_zip("seq", "dl", "tf")))


def idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    n = docs.agg(F.count("text").alias("n"))
    df = doc_terms(docs).select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """The kept terms of a query and how often each stands in it."""
    return dict(Counter(spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t))


def _part(qtf, tf: Column, dl: Column, n: int, df, words: int, k1: float, b: float) -> Column:
    mean = F.lit(float(words) / n)
    return qtf * (idf(F.lit(float(n)), df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)))


def _sum(parts: Column) -> Column:
    """Summed in a fixed order."""
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda s, x: s + x)


def _is(word: str):
    return lambda t: t == F.lit(word)


def _best(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("seq")).limit(k)


def search(docs: DataFrame, query: str, k: int, k1: float = BM25_K1, b: float = BM25_B, where: Column | None = None) -> DataFrame:
    """(seq, score) of the ``k`` best documents; a term that stands twice in the query counts twice.

    One pass over the texts leaves the length of each document and the counts of the query's terms in it; sums over these
    give the statistics, of all documents, and only rows that pass ``where`` are ranked. No text is shuffled. An empty query
    or corpus has no rows.
    """
    spark = docs.sparkSession
    wanted = query_terms(spark, query)
    if not wanted or k <= 0:
        return spark.createDataFrame([], "seq bigint, score double")
    passing = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = docs.where("text is not null").select("seq", passing.alias("passing"), tokens(F.col("text")).alias("terms"))
    rows = rows.select("seq", "passing", F.size("terms").alias("dl"), F.filter("terms", lambda t: t.isin(*wanted)).alias("hits"))
    counts = [F.size(F.filter("hits", _is(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    counted = materialize(rows.select("seq", "passing", "dl", *counts), "term-counts")
    n, words, *df = counted.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), *[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(wanted))]).first()
    if not words:
        return spark.createDataFrame([], "seq bigint, score double")
    tf = [F.col(f"tf{i}") for i in range(len(wanted))]
    parts = [F.when(c > 0, _part(q, c, F.col("dl"), n, F.lit(float(d)), words, k1, b)) for q, c, d in zip(wanted.values(), tf, df)]
    found = counted.where(F.greatest(*tf, F.lit(0)) > 0).where("passing")
    return _best(found.select("seq", _sum(F.array_compact(F.array(*parts))).alias("score")), k)


class KeywordIndex:
    """Postings in folders by the hash of the term, lists of documents as ``packed`` makes them, with lengths and dead documents.

    A search reads the folders of its terms alone. Adding and removing documents append; ``compact`` rewrites.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, buckets: int = 32) -> "KeywordIndex":
        index = cls(docs.sparkSession, path or new_path(docs.sparkSession, "keyword-index"), buckets)
        docs.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{index.path}/meta")
        docs.sparkSession.createDataFrame([], "seq bigint").write.parquet(f"{index.path}/dead")
        index.add(docs)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "KeywordIndex":
        return cls(spark, path, spark.read.parquet(f"{path}/meta").first().buckets)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame) -> None:
        """Index documents (seq, text) of numbers that the index doesn't have; rows without a number or text are none."""
        part = f"{self.path}/postings/part=p{uuid.uuid4().hex}"
        rows = packed(docs).withColumn("bucket", F.when(F.col("term").isNotNull(), self._bucket(F.col("term"))).otherwise(-1))
        with tidy_shuffles(self.spark):
            rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(part)
        own = self.spark.read.schema(f"{_PACKED}, bucket int").parquet(part).where("bucket = -1")
        unpacked(own).select("seq", "dl").write.mode("append").parquet(f"{self.path}/lengths")

    def remove(self, gone: DataFrame) -> None:
        """Documents ``gone(seq)`` are found no more and leave the statistics."""
        gone.select("seq").distinct().write.mode("append").parquet(f"{self.path}/dead")

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.spark.read.parquet(f"{self.path}/dead"), "seq", "left_anti")

    def _lengths(self) -> DataFrame:
        return self._live(self.spark.read.parquet(f"{self.path}/lengths"))

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(f"{_PACKED}, part string, bucket int").parquet(f"{self.path}/postings")

    def search(self, query: str, k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
        """As ``search`` over the live documents."""
        wanted = query_terms(self.spark, query)
        empty = self.spark.createDataFrame([], "seq bigint, score double")
        if not wanted or k <= 0:
            return empty
        n, words = self._lengths().agg(F.count("*"), F.sum("dl")).first()
        if not words:
            return empty
        places = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(self._bucket(F.col("t"))).distinct().collect()]
        rows = self._live(unpacked(self._postings().where(F.col("bucket").isin(places) & F.col("term").isin(*wanted))))
        rows = rows.groupBy("seq", "dl", "term").agg(F.sum("tf").alias("tf"))  # a number that stands twice is one document
        df = dict(tuple(r) for r in rows.groupBy("term").count().collect())  # of the terms of one query
        if not df:
            return empty
        part = None
        for t, d in df.items():
            one = _part(wanted[t], F.col("tf"), F.col("dl"), n, F.lit(float(d)), words, k1, b)
            part = F.when(F.col("term") == t, one) if part is None else part.when(F.col("term") == t, one)
        return _best(rows.groupBy("seq").agg(_sum(F.collect_list(part)).alias("score")), k)

    def compact(self) -> "KeywordIndex":
        """A new index beside this one, of the live postings alone."""
        other = KeywordIndex(self.spark, new_path(self.spark, "keyword-index"), self.buckets)
        self.spark.read.parquet(f"{self.path}/meta").write.parquet(f"{other.path}/meta")
        self.spark.createDataFrame([], "seq bigint").write.parquet(f"{other.path}/dead")
        self._lengths().write.parquet(f"{other.path}/lengths")
        # a list has the documents of 65,536 numbers at most
        rows = self._live(self._postings().where("bucket >= 0").select("bucket", "term", F.inline(F.arrays_zip("seq", "dl", "tf"))))
        rows = rows.groupBy("bucket", "term", F.shiftright("seq", 16)).agg(F.array_sort(F.collect_list(F.struct("seq", "dl", "tf"))).alias("p"))
        rows = rows.select("term", "p.seq", "p.dl", "p.tf", "bucket").repartition("bucket").sortWithinPartitions("bucket", "term")
        rows.write.partitionBy("bucket").parquet(f"{other.path}/postings/part=p{uuid.uuid4().hex}")
        return other
