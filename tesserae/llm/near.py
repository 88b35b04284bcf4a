"""MinHash near-duplicates by an inverted join on signature coordinates.

Documents of one signature are a class with one representative, which is posted under its (coordinate, value) pairs. Pairs that
no other class has are skipped, and with them every class that shares fewer than ``matches``. Of the s pairs that a class
shares, its s - matches + 1 rarest are its prefix: two classes that collide at least ``matches`` times meet under one of these,
because all rank the pairs alike. Inside the list of a prefix pair collisions are counted by merging postings: the
``matches`` - 1 longest lists of a probe are skipped, the others merged, and only what could still reach ``matches`` is
compared. Long lists are split into blocks that meet two by two, so no task holds more than two blocks.

The links so found connect all that retained pairs connect. The retained pairs themselves are counted inside each
component, again by blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ._ids import numbered
from ._text import Tokens, buffers, ngrams, released, slices
from .components import components

_rng = np.random.default_rng(64)
_A = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Params:
    """``k`` coordinates over runs of ``shingle`` words; a pair is retained from ``matches`` equal coordinates.

    ``block`` members of a list or component meet in one piece of work; it changes nothing in the result.
    """

    k: int = 64
    shingle: int = 2
    matches: int = 33
    block: int = 8000


def signature(data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(rows, uint32[rows, k]) of the documents that have a word; one of fewer words than a shingle is one shingle."""
    t = Tokens(data, offsets)
    count = np.diff(t.first)
    h, doc = ngrams(t, p.shingle)
    few = np.flatnonzero((count > 0) & (count < p.shingle))
    if len(few):
        whole = np.array([np.bitwise_xor.reduce(t.hash[t.first[d] : t.first[d + 1]] * np.arange(1, 2 * count[d], 2, dtype=np.uint64)) for d in few], np.uint64)
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    rows, start = np.unique(doc, return_index=True)
    out = np.empty((len(rows), p.k), np.uint32)
    for k in range(p.k if len(rows) else 0):
        out[:, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), start)
    return rows, out


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, version, sig) of each row with an id and at least one word; the version is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, offsets in slices(b.column(2), 1 << 19):
                rows, sig = signature(data, offsets, p)
                at = pa.array(rows + i)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), _binary(sig)], ["doc_id", "version", "sig"])

    rows = docs.select("doc_id", "text").dropna().select("doc_id", F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(released(run), "doc_id bigint, version bigint, sig binary")


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return buffers(column)[0].view(np.uint32).reshape(len(column), k)


def _post(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = (np.arange(p.k, dtype=np.int64) << 32) | _matrix(b.column(1), p.k).astype(np.int64)
                yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), p.k))], ["key", "rep"])

    return released(run)


def prefixes(reps: DataFrame, p: Params) -> DataFrame:
    """(key, rep): the prefix postings of the classes that share enough coordinates."""
    posts = reps.select("rep", "sig").mapInArrow(_post(p), "key bigint, rep bigint")
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = posts.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all")).where(F.size("all") >= p.matches)
    rarest = F.slice("all", F.lit(1), F.size("all") - F.lit(p.matches - 1))
    return mine.select(F.explode(rarest).alias("post"), "rep").select("post.key", "rep")


class Postings:
    """The members of one list under each of their coordinates' values, for counting collisions."""

    def __init__(self, sig: np.ndarray, matches: int):
        self.sig, self.matches = sig, matches
        n, k = sig.shape
        self.order = np.argsort(sig, axis=0, kind="stable")
        value = np.take_along_axis(sig, self.order, 0)
        new = np.ones((n, k), bool)
        new[1:] = value[1:] != value[:-1]
        place = np.arange(n)[:, None]
        first = np.maximum.accumulate(np.where(new, place, 0), 0)
        last = np.minimum.accumulate(np.where(np.append(new[1:], np.ones((1, k), bool), 0), place, n)[::-1], 0)[::-1] + 1
        self.first, self.last = np.empty((n, k), np.int32), np.empty((n, k), np.int32)
        np.put_along_axis(self.first, self.order, first.astype(np.int32), 0)
        np.put_along_axis(self.last, self.order, last.astype(np.int32), 0)

    def partners(self, at: int, left: np.ndarray) -> np.ndarray:
        """Members in the mask ``left`` that collide with ``at`` in ``matches`` coordinates or more."""
        k = self.sig.shape[1]
        size = self.last[at] - self.first[at]
        short = np.argsort(size, kind="stable")[: k - self.matches + 1]  # a partner is in one of these at least
        if size[short].sum() > left.sum():
            seen = np.flatnonzero(left)
        else:
            seen = np.concatenate([self.order[self.first[at, c] : self.last[at, c], c] for c in short])
            seen = np.unique(seen[left[seen]])
        return seen[(self.sig[seen] == self.sig[at]).sum(1) >= self.matches]


def links(ids: np.ndarray, sig: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Edges that connect exactly the members of one list that are connected by retained pairs."""
    if len(ids) == 2:
        return [(int(ids[0]), int(ids[1]))] if (sig[0] == sig[1]).sum() >= matches else []
    index, left, out = Postings(sig, matches), np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            at = queue.pop()
            found = index.partners(at, left)
            left[found] = False
            out += [(int(ids[at]), int(ids[x])) for x in found]
            queue += found.tolist()
    return out


def _by_unit(reduce: Callable[[list[np.ndarray]], pa.RecordBatch | None], k: int):
    """Hand the rows (unit, columns ..., sig) of each unit, sorted by it, to ``reduce`` as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            own = np.array(b.column(0).dictionary_encode().indices) if pa.types.is_string(b.column(0).type) else b.column(0).to_numpy()
            arrays = [*[b.column(c).to_numpy() for c in range(1, b.num_columns - 1)], _matrix(b.column(b.num_columns - 1), k)]
            cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), b.num_rows]
            for x, y in zip(cut[:-1], cut[1:]):
                name = b.column(0)[x].as_py()
                if name != unit:
                    if held and (out := reduce([np.concatenate(c) for c in zip(*held)])) is not None:
                        yield out
                    unit, held = name, []
                held.append([c[x:y] for c in arrays])
        if held and (out := reduce([np.concatenate(c) for c in zip(*held)])) is not None:
            yield out

    return released(run)


def _in_blocks(rows: DataFrame, key: str, size: str, p: Params) -> DataFrame:
    """Rows with the column ``unit``: the members of a key of ``size`` fall into blocks, and every two blocks share a unit.

    ``half`` is 0 for members of the first block, 1 for those of the second; a unit of one block has 0 alone.
    """
    n = F.ceil(F.col(size) / F.lit(p.block)).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    name = lambda a, b: F.concat_ws(":", F.col(key).cast("string"), a.cast("string"), b.cast("string"))
    units = F.transform(F.sequence(F.lit(0), n - 1), lambda other: F.struct(name(F.least(own, other), F.greatest(own, other)).alias("unit"), (own > other).cast("int").alias("half")))
    return rows.withColumn("__unit", F.explode(units)).withColumns({"unit": F.col("__unit.unit"), "half": F.col("__unit.half")}).drop("__unit")


def near_edges(reps: DataFrame, p: Params = Params()) -> DataFrame:
    """Edges (u, v) spanning the retained pairs among ``reps(rep, sig)`` of distinct signatures."""
    posts = materialize(prefixes(reps, p), "postings")
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    # lists of the same members are merged once
    lists = lists.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = _in_blocks(posts.join(lists, "key"), "key", "n", p).join(reps, "rep").select("unit", "rep", "sig")

    def merge(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        found = links(*rows, p.matches)
        return pa.record_batch([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"]) if found else None

    return members.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(_by_unit(merge, p.k), "u bigint, v bigint")


def partners(classes: DataFrame, p: Params = Params()) -> DataFrame:
    """(rep, links) of ``classes(rep, n, sig, root, size)``: how many documents of other classes of a component are retained."""

    def count(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        rep, n, half, sig = rows
        first, second = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
        if not len(second):
            second = first  # one block with itself: a class is no partner of its own
        elif not len(first):
            return None
        total = np.zeros(len(rep), np.int64)
        step = max(1, 4_000_000 // (len(second) * p.k))
        for i in range(0, len(first), step):
            own = first[i : i + step]
            hit = (sig[own][:, None] == sig[second][None]).sum(2) >= p.matches
            total[own] += hit @ n[second]
            if second is not first:
                total[second] += n[own] @ hit
        if second is first:
            total -= n
        return pa.record_batch([pa.array(rep), pa.array(total)], ["rep", "links"])

    units = _in_blocks(classes.select("rep", "n", "sig", "root", "size"), "root", "size", p).select("unit", "rep", "n", "half", "sig")
    counted = units.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(_by_unit(count, p.k), "rep bigint, links bigint")
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))


def members(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, version, kept_id, kept_version, n, links) of every document of a group, the kept one too; bigint ids alone."""
    sigs = materialize(signatures(docs, p).distinct(), "signatures")
    reps = sigs.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version")).alias("least")).withColumn("rep", F.monotonically_increasing_id())
    reps = materialize(reps, "representatives")
    roots = materialize(components(near_edges(reps.select("rep", "sig"), p)), "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    many = reps.join(roots, F.col("rep") == F.col("node")).join(sizes, "root")
    linked = many.join(partners(many, p), "rep").select("rep", "root", "sig", "n", "least", "links")
    alone = reps.where("n > 1").join(roots, F.col("rep") == F.col("node"), "left_anti").select("rep", F.col("rep").alias("root"), "sig", "n", "least", F.lit(0).cast("bigint").alias("links"))
    classes = materialize(linked.unionByName(alone), "classes")
    group = classes.groupBy("root").agg(F.sum("n").alias("size"), F.min("least").alias("kept"))
    classes = classes.join(group, "root").select("sig", (F.col("links") + F.col("n") - 1).alias("links"), F.col("size").alias("n"), "kept")
    return sigs.join(classes, "sig").select("doc_id", "version", F.col("kept.doc_id").alias("kept_id"), F.col("kept.version").alias("kept_version"), "n", "links")


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, kept_id, n, links) for every document that is a near copy of ``kept_id``, the least id of its group of ``n``.

    ``links`` is the number of documents that share ``matches`` coordinates with it, copies of the same signature included.
    A group is a connected component of the retained pairs. Clean documents and the kept ones have no row of their own.
    Rows with a null id, a null text or no word belong to no group; equal rows are one document, and rows of one id with
    different texts are documents of their own, which may be in different groups. An empty table gives an empty one. Ids may
    be of any kind.
    """
    found = lambda d: members(d, p).where("doc_id <> kept_id").select("doc_id", "kept_id", "n", "links")
    return numbered(docs, found, "doc_id", "kept_id")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each group; of equal (id, text) rows one stays.

    Rows with a null id or text, or without a word, stay but for such repeats: nothing identifies them as copies.
    """

    def kept(d: DataFrame) -> DataFrame:
        drop = members(d, p).where("doc_id <> kept_id or version <> kept_version").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.lit(True).alias("__drop"))
        # only ids and hashes are counted; of all rows, those that stand several times alone are ranked
        twice = d.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__version")).agg(F.count("*").alias("__n")).where("__n > 1")
        marks = drop.unionByName(twice, allowMissingColumns=True).groupBy("__id", "__version").agg(F.coalesce(F.max("__drop"), F.lit(False)).alias("__drop"))
        rows = d.join(marks, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__version")), "left").where("__drop is null or not __drop")
        several = rows.where("__drop is not null").withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__version").orderBy("__id"))).where("__nth = 1")
        return rows.where("__drop is null").select(*d.columns).unionByName(several.select(*d.columns))

    return numbered(docs, kept, "doc_id").select(*docs.columns)
