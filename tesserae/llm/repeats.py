"""Repeated passages by recompression.

Every round renames runs (aaa -> a^3) and then pairs (ab -> c) of the words of all documents. Which pairs are joined depends
on the two symbols alone, and a name is a 64-bit fingerprint of what it stands for, so every task gives equal substrings
equal symbols inside, however far apart they are: the naming is global without a dictionary to be shuffled in each round.
Symbols of eight words or more are left as they are. After the rounds

1. the symbols are brought together by name; those of two or more documents mark where a long repeat may lie,
2. every window of ``window`` words round such a mark is fingerprinted twice, by 64 and by 32 bits, and these are brought
   together: a window found in two or more documents is a verified repeat,
3. the repeated windows of a document are merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ._ids import numbered
from ._packed import ascending, bounds, buckets, exchange, planes, unascending, unplanes
from ._text import _INV, _MULT, Tokens, _power, mix, pair, released, slices

U64 = np.uint64
_ODD = 0x5851F42D4C957F2D
_LONG = U64(_ODD)
_OTHER = 0xC2B2AE3D27D4EB4F  # the base of the second fingerprint
_OTHER_INV = pow(_OTHER, -1, 1 << 64)


@dataclass(frozen=True)
class Params:
    """``window`` words must repeat; ``rest`` words make a symbol final; ``run`` words of one run are enough for a mark."""

    window: int = 50
    rounds: int = 12
    rest: int = 8
    run: int = 16


def recompress(symbol: np.ndarray, doc: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, doc, start, length) after all rounds; start and length in words of the whole input."""
    start, length = np.arange(len(symbol)), np.ones(len(symbol), np.int64)
    for r in range(p.rounds):
        n = len(symbol)
        if n < 2:
            break
        free = length < p.rest
        near = free[1:] & free[:-1] & (doc[1:] == doc[:-1])
        # runs
        same = near & (symbol[1:] == symbol[:-1])
        if same.any():
            head = np.flatnonzero(np.append(True, ~same))
            count = np.diff(np.append(head, n))
            many = count > 1
            symbol, doc, start, length = symbol[head], doc[head], start[head], length[head] * count
            # runs of many words are one name, as their ends say nothing of what a window inside them holds
            name = np.where(length >= p.run, _LONG, count.astype(np.uint64))
            symbol = symbol.copy()
            symbol[many] = pair(symbol[many], name[many])
            free = length < p.rest
            near = free[1:] & free[:-1] & (doc[1:] == doc[:-1])
        # pairs: a symbol is a left or a right one in this round, by a bit of its hash
        right = (mix(symbol + U64((2 * r + 1) * _ODD & (1 << 64) - 1)) >> U64(33)) & U64(1) == 1
        join = np.flatnonzero(near & ~right[:-1] & right[1:])
        if len(join):
            symbol = symbol.copy()
            symbol[join] = pair(symbol[join], symbol[join + 1])
            length = length.copy()
            length[join] += length[join + 1]
            keep = np.ones(len(symbol), bool)
            keep[join + 1] = False
            symbol, doc, start, length = symbol[keep], doc[keep], start[keep], length[keep]
    return symbol, doc, start, length


def _messages(key: np.ndarray, doc: np.ndarray, at: np.ndarray, width: np.ndarray, ids: np.ndarray, count: int) -> pa.RecordBatch:
    order = np.argsort(key, kind="stable")
    key, doc, at = key[order], doc[order].astype(np.uint32), at[order].astype(np.uint32)
    width = width[order].astype(np.uint32)
    cut = bounds(key, count)
    some = np.flatnonzero(np.diff(cut))
    parts: list[list] = [[], [], [], [], []]
    for s in (slice(cut[k], cut[k + 1]) for k in some):
        local, inverse = np.unique(doc[s], return_inverse=True)
        raw = (ascending(key[s]), planes(inverse.astype(np.uint32)), ids[local].tobytes(), planes(at[s]), planes(width[s]))
        for column, x in zip(parts, raw):
            column.append(x)
    return pa.record_batch([pa.array(some.astype(np.int32)), *[pa.array(x, pa.binary()) for x in parts]], ["bucket", "key", "doc", "ids", "at", "width"])


_SENT = "bucket int, key binary, doc binary, ids binary, at binary, width binary"
_MARKS = "doc_id bigint, at binary, width binary"


def _shared(wide: bool):
    """Places of the keys of a bucket that two or more documents have, by document; ``wide`` for symbols, which have a width."""

    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([unascending(r["key"]) for r in rows])
        doc = np.concatenate([np.frombuffer(r["ids"], np.int64)[unplanes(r["doc"], np.uint32)] for r in rows])
        at = np.concatenate([unplanes(r["at"], np.uint32) for r in rows])
        width = np.concatenate([unplanes(r["width"], np.uint32) for r in rows])
        rows.clear()
        # windows are the same if both of their fingerprints are
        order = np.argsort(key, kind="stable") if wide else np.lexsort((width, key))
        key, doc, second = key[order], doc[order], np.zeros(len(key), np.uint32) if wide else width[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        if not len(first):
            return
        shared = np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), size)
        doc, order = doc[shared], order[shared]
        by = np.argsort(doc, kind="stable")
        doc, order = doc[by], order[by]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        if not len(first):
            return
        ends = np.append(first[1:], len(doc))
        at, width = at[order], width[order] if wide else None
        yield pa.record_batch([
            pa.array(doc[first]), pa.array([at[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
            pa.array([width[a:b].tobytes() if wide else b"" for a, b in zip(first, ends)], pa.binary()),
        ], ["doc_id", "at", "width"])

    return reduce


def _symbols(p: Params, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, offsets in slices(b.column(1), 2 << 20):
                t = Tokens(data, offsets)
                symbol, doc, start, length = recompress(t.hash, t.doc, p)
                # a document shorter than the window holds no repeat
                some = np.diff(t.first)[doc] >= p.window
                symbol, doc, start, length = symbol[some], doc[some], start[some], length[some]
                yield _messages(symbol, doc, start - t.first[doc], length, ids[i:j], count)

    return run


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of 0 .. n-1 lie in an interval [start, end)."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _windows(p: Params, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, widths = b.column(0).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, j, data, offsets in slices(b.column(1), 2 << 20):
                t = Tokens(data, offsets)
                total = np.append(U64(0), np.cumsum(t.hash * _power(_MULT, len(t.hash)), dtype=np.uint64))
                found = []
                for k in range(j - i):
                    n = int(t.first[k + 1] - t.first[k]) - p.window + 1
                    if n < 1:
                        continue
                    at = np.frombuffer(b"".join(marks[i + k]), np.uint32).astype(np.int64)
                    width = np.frombuffer(b"".join(widths[i + k]), np.uint32).astype(np.int64)
                    inner = np.minimum(width, p.run)
                    lo, hi = np.maximum(at + inner - p.window, 0), np.minimum(at + width - inner, n - 1) + 1
                    ok = hi > lo
                    found.append(t.first[k] + np.flatnonzero(_cover(n, lo[ok], hi[ok])))
                if found:
                    at = np.concatenate(found)
                    key = mix((total[at + p.window] - total[at]) * _power(_INV, len(t.hash) + 1)[at])
                    second = np.append(U64(0), np.cumsum(mix(t.hash + U64(_ODD)) * _power(_OTHER, len(t.hash)), dtype=np.uint64))
                    second = mix((second[at + p.window] - second[at]) * _power(_OTHER_INV, len(t.hash) + 1)[at]) >> U64(32)
                    doc = t.doc[at]
                    yield _messages(key, doc, at - t.first[doc], second, ids[i:j], count)

    return run


def _spans(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ([], [], [])
            for doc_id, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = np.unique(np.frombuffer(b"".join(parts), np.uint32)).astype(np.int64)
                gap = np.flatnonzero(np.diff(at) > p.window)
                begin, end = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + p.window
                rows[0].append(doc_id)
                rows[1].append([{"begin": int(x), "end": int(y)} for x, y in zip(begin, end)])
                rows[2].append(int((end - begin).sum()))
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], kind), pa.array(rows[2], pa.int32())], ["doc_id", "spans", "repeated_words"])

    return run


def repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, spans, repeated_words) of each document with a passage of ``window`` words that another one has too.

    ``spans`` are maximal runs of words (``begin`` to ``end`` exclusive, counted from 0) covered by such windows. Case and
    punctuation do not count. Repeats inside one document alone do not count, nor do those of rows with the same id, which
    are versions of one document: each is searched whole, and the spans of an id are those of all its versions together. Rows
    with a null id or text are left out; documents without a repeat have no row, and an empty table gives an empty one. Ids may
    be of any kind.
    """
    return numbered(docs.select("doc_id", "text").dropna(), lambda rows: _found(rows, p), "doc_id")


def _found(rows: DataFrame, p: Params) -> DataFrame:
    count = buckets(rows)
    marks = exchange(rows.mapInArrow(released(_symbols(p, count)), _SENT), _shared(True), _MARKS)
    marks = materialize(marks.groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("width").alias("width")), "marks")
    # the marks of an id are those of all its versions; one more window in a version is no harm, as all are verified
    near = rows.join(marks, "doc_id").select("doc_id", "text", "at", "width")
    windows = materialize(near.mapInArrow(released(_windows(p, count)), _SENT), "windows")
    hits = exchange(windows, _shared(False), _MARKS)
    return hits.groupBy("doc_id").agg(F.collect_list("at").alias("at")).mapInArrow(released(_spans(p)), "doc_id bigint, spans array<struct<begin:int,end:int>>, repeated_words int")
