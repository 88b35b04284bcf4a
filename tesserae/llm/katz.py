"""Language-model scoring by Katz backoff over counted n-grams of any order from 2.

    P(w | h) = d(c) c(h, w) / c(h)        if the n-gram was seen
             = a(h) P(w | h')             otherwise; h' is h without its first word
    P(w)     = d'(c) c(w) / N             if the word was seen, else the mass that discounting left for unknown words

d are Good-Turing discounts, for each order, of counts up to ``k``; a(h) makes each distribution sum to exactly 1. All n-grams
whose context ends in the same word have one home bucket, where lower orders are sums of higher ones and backoff from order
to order needs no shuffle. Context words of more than ``share`` of all words are hot: there are at most 1 / share of them, and
their n-grams live by the last two words instead, but for their bigrams, which live with the word that follows. A bucket is a
row of packed arrays in a table. ``train_and_score`` keeps, for each n-gram of a document, what its probability depends on as soon
as it is counted, so that documents scored by a model of themselves are sent once; ``score`` is for any documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ._ids import numbered
from ._packed import ascending, ascending_by, bounds, buckets, exchange, planes, planes_by, unascending, unplanes
from ._text import Tokens, pair, released, slices

U64 = np.uint64
BEGIN = U64(0x2545F4914F6CDD1D)  # stands for each word before the first
WORD, HOT, GRAM, BACK, LOOK, FALL, SUM, OWN = range(1, 9)  # kinds of rows
_NAMES = ["kind", "bucket", "words", "at", "n", "many", "doc", "ids", "x"]
_ROWS = "kind int, bucket int, words binary, at binary, n binary, many binary, doc binary, ids binary, x binary"
_KIND = 1 << 24  # where kinds are counted together, their buckets are numbered apart


@dataclass(frozen=True)
class Params:
    """Counts above ``k`` are not discounted; ``block`` bytes of text are counted before they are sent; ``order`` words at most
    make an n-gram; words of more than ``share`` of all are hot; n-grams go out in ``parts``, by home, one after the other."""

    k: int = 5
    block: int = 3 << 20
    order: int = 2
    share: float = 1 / 256
    parts: int = 1


class HotWords:
    """The hot context words, numbered from 1; the begin of a text is one of them. Never more than 1 / share + 1."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Numbers of words, 0 for those that aren't hot."""
        at = np.minimum(np.searchsorted(self.words, x), len(self.words) - 1)
        return np.where(self.words[at] == x, at + 1, 0)


@dataclass
class Model:
    """Tables of packed rows: ``words`` and bigrams of hot words (WORD, HOT), n-grams and backoff weights (GRAM, BACK).

    The rest is of bounded size: discounts by order, the hot words with the probability of each as a word, its total and
    backoff weight as a context, and the counts of bigrams of two of them.
    """

    order: int
    buckets: int
    words: DataFrame
    grams: DataFrame
    d: dict[int, np.ndarray]
    denominator: float
    unknown: float
    hot: HotWords
    total: np.ndarray = field(default_factory=lambda: np.ones(1))
    back: np.ndarray = field(default_factory=lambda: np.zeros(1))
    word: np.ndarray = field(default_factory=lambda: np.zeros(1))
    both: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))


def blocks(batches: Iterator[pa.RecordBatch], size: int, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, c, doc, ids) of about ``size`` bytes of whole documents at a time.

    ``words`` are sorted; words[c[:, 0]] are those of the texts in order, words[c[:, m]] the m-th words before them.
    """
    held: list[tuple] = []
    n = docs = 0
    for b in batches:
        ids = b.column(0).to_numpy()
        for i, j, data, offsets in slices(b.column(1), 1 << 17):  # its arrays of 8 bytes a byte stay in the cache
            t = Tokens(data, offsets)
            held.append((t.hash, t.doc + docs, ids[i:j], np.arange(len(t.hash)) - t.first[t.doc]))
            n, docs = n + len(data), docs + j - i
            if n >= size:
                yield _block(held, order)
                held, n, docs = [], 0, 0
    if held:
        yield _block(held, order)


def _block(held: list[tuple], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, doc, ids, place = (np.concatenate(x) for x in zip(*held))
    coded = pa.array(np.append(hashes, BEGIN)).dictionary_encode()
    words = coded.dictionary.to_numpy()
    order_of = np.argsort(words)
    rank = np.empty(len(words), np.int32)
    rank[order_of] = np.arange(len(words), dtype=np.int32)
    words, at = words[order_of], rank[coded.indices.to_numpy()]
    c = np.empty((len(hashes), order), np.int32)
    c[:, 0] = at[:-1]
    for m in range(1, order):
        c[:m, m] = at[-1]
        c[m:, m] = at[: max(0, len(hashes) - m)]
        c[place < m, m] = at[-1]
    return words, c, doc, ids


def context(c: np.ndarray, m: int) -> np.ndarray:
    """Names of the m - 1 words before each."""
    x = c[:, 1]
    for j in range(2, m):
        x = pair(x, c[:, j])
    return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, the number of each element among them, how often each stands there)."""
    order = np.argsort(x)
    own = x[order]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    head = np.flatnonzero(new)
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return own[head], order[head], at, np.diff(np.append(head, len(x)))


def _in(key: np.ndarray, count: int) -> np.ndarray:
    return (key >> U64(64 - (count.bit_length() - 1))).astype(np.int64)


def _homes(words: np.ndarray, at: np.ndarray, hot: HotWords, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the last context word, 0 unless hot, and the home bucket of each n-gram; -1 for bigrams of hot words."""
    h = hot.of(words)[at[:, 1]]
    home, some = _in(words, count)[at[:, 1]], np.flatnonzero(h)
    home[some] = _in(pair(words[at[some, 1]], words[at[some, 2]]), count) if at.shape[1] > 2 else -1
    return h, home


class Packer:
    """Packs rows of word numbers against the sorted words that they number."""

    def __init__(self, words: np.ndarray):
        self.words, self.seen, self.rank = words, np.zeros(len(words), bool), np.empty(len(words), np.int32)

    def pack(self, rows: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
        """The words that occur, the number of each element among them, column by column, and the order in which rows are packed."""
        self.seen[rows.ravel()] = True
        own = np.flatnonzero(self.seen)
        self.seen[own], self.rank[own] = False, np.arange(len(own), dtype=np.int32)
        at = self.rank[rows]
        order = np.argsort(ranked(at, len(own)))
        return ascending(self.words[own]), _numbers(at[order], len(own)), order


def ranked(at: np.ndarray, words: int) -> np.ndarray:
    """A number of each row of word numbers, in the order of rows by their context, last word first, and then their word."""
    x, most = at[:, 1].astype(np.int64), words
    for k in (*range(2, at.shape[1]), 0):
        if most * words >= 1 << 62:
            _, _, x, n = distinct(x)
            most = len(n)
        x, most = x * words + at[:, k], most * words
    return x


def _numbers(at: np.ndarray, words: int) -> bytes:
    return planes(at.T.astype(np.uint16 if words <= 1 << 16 else np.uint32, order="C").ravel())


def _unpack(words: bytes, at: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, rows of their numbers)."""
    w = unascending(words)
    return w, unplanes(at, np.uint16 if len(w) <= 1 << 16 else np.uint32).reshape(columns, -1).T


def _unpack_all(rows: list[dict], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of several rows together."""
    parts = [_unpack(r["words"], r["at"], columns) for r in rows]
    words = np.unique(np.concatenate([w for w, _ in parts]))
    return words, np.concatenate([np.searchsorted(words, w).astype(np.int32)[at] for w, at in parts])


def _row(kind: int, bucket: int, **values: bytes) -> tuple:
    return (kind, int(bucket), *[values.get(x, b"") for x in _NAMES[2:]])


def _batch(rows: list[tuple], names: list[str] = _NAMES) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int32() if x in ("kind", "bucket") else pa.binary()) for k, x in enumerate(names)], names)


def _columns(kind: int, bucket: np.ndarray, **values: pa.Array) -> pa.RecordBatch:
    """A row of each bucket, from whole columns."""
    none = pa.array([b""] * len(bucket), pa.binary())
    return pa.record_batch([pa.array(np.full(len(bucket), kind, np.int32)), pa.array(bucket.astype(np.int32)), *[values.get(x, none) for x in _NAMES[2:]]], _NAMES)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where one of some columns changes, and the end."""
    n = len(keys[0])
    new = np.zeros(max(0, n - 1), bool)
    for x in keys:
        new |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(np.append(True, new)) if n else 0, n)


def _spread(words: np.ndarray, rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """The order by bucket, where each bucket begins in it, and its words and the numbers of its rows, for all buckets at once.

    What this takes does not depend on how many buckets a block falls into, which grows with the corpus.
    """
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    start, columns = _heads(bucket[order]), rows.shape[1]
    n = np.diff(start)
    of = np.repeat(np.arange(len(n)), n)
    own, _, at, _ = distinct((of[:, None] * len(words) + rows[order]).ravel())
    cut = np.searchsorted(own, np.arange(len(n) + 1) * len(words))
    at = at.reshape(-1, columns) - cut[of][:, None]
    numbers = np.empty(at.size, np.uint32)
    place = np.arange(len(of)) + ((columns - 1) * start[:-1])[of]
    for k in range(columns):
        numbers[place + k * n[of]] = at[:, k]
    sizes = np.where(np.diff(cut) <= 1 << 16, 2, 4)
    return order, start, {"words": ascending_by(words[own % len(words)], cut), "at": planes_by(numbers, columns * start, sizes)}


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of each bucket."""
    order = np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")
    own = bucket[order]
    cut = [*np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist(), len(own)] if len(own) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(own[a]), order[a:b]


def _count_words(p: Params, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, c, _, _ in blocks(batches, p.block, 1):
            n = np.bincount(c[:, 0], minlength=len(words))
            words, n = words[n > 0], n[n > 0]
            if len(words):
                start = _heads(bucket := _in(words, count))
                yield _columns(WORD, bucket[start[:-1]], words=ascending_by(words, start), n=planes_by(n.astype(np.uint32), start))

    return released(run)


def _few(n: np.ndarray, k: int) -> np.ndarray:
    """How many counts are 0 .. k + 1."""
    return np.bincount(n[n <= k + 1].astype(np.int64), minlength=k + 2)[: k + 2]


def _sum_words(p: Params):
    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        w, at = np.unique(np.concatenate([unascending(r["words"]) for r in rows]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([unplanes(r["n"], np.uint32) for r in rows])).astype(np.uint64)
        yield _batch([_row(WORD, bucket, words=ascending(w), n=planes(n), x=np.append(_few(n, p.k), n.sum()).astype(np.int64).tobytes())])

    return reduce


def _frequent(least: float):
    """The words of more than ``least`` occurrences, which are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = unplanes(raw, np.uint64)
                some = n > least
                yield pa.record_batch([pa.array(unascending(words)[some].view(np.int64)), pa.array(n[some].view(np.int64))], ["word", "n"])

    return run


def _count(p: Params, count: int, hot: HotWords, part: int, keep: bool):
    """N-grams of blocks in the order of the text, of the homes of one part, with their documents if they are to be kept.

    Bigrams of hot words go out with the first part, distinct ones of a block once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, rows, doc, ids in blocks(batches, p.block, p.order):
            h, home = _homes(words, rows, hot, count)
            own = np.flatnonzero(home * p.parts // count == part)
            if len(own):
                order, start, packed = _spread(words, rows[own], home[own])
                own = own[order]
                if keep:
                    head = _heads(home[own], doc[own])
                    cut = np.searchsorted(head, start)
                    packed |= {"ids": planes_by(ids[doc[own[head[:-1]]]], cut), "many": planes_by(np.diff(head).astype(np.uint32), cut)}
                yield _columns(GRAM, home[own[start[:-1]]] + GRAM * _KIND, **packed)
            some = h > 0
            if part == 0 and some.any():
                key, _, _, n = distinct(rows[some, 1].astype(np.int64) << 32 | rows[some, 0])
                rows = np.stack([key & 0xFFFFFFFF, key >> 32], axis=1)
                bucket = _in(words, count)[rows[:, 0]]
                order, start, packed = _spread(words, rows, bucket)
                yield _columns(HOT, bucket[order[start[:-1]]] + HOT * _KIND, n=planes_by(n[order].astype(np.uint32), start), **packed)

    return released(run)


def _sum(p: Params, hot: HotWords, keep: bool):
    """Total counts of a bucket, with the counts of counts of each order, and what the documents of its n-grams keep of them."""

    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        kind, bucket = divmod(bucket, _KIND)
        columns = 2 if kind == HOT else p.order
        words, at = _unpack_all(rows, columns)
        n = np.concatenate([unplanes(r["n"], np.uint32) for r in rows]) if kind == HOT else None
        ids = [unplanes(r["ids"], np.int64) for r in rows] if keep and kind == GRAM else []
        many = [unplanes(r["many"], np.uint32) for r in rows] if ids else []
        rows.clear()
        _, first, which, times = distinct(ranked(at, len(words)))  # these are in the order that rows are packed in
        at, n = at[first], times if n is None else np.bincount(which, weights=n)
        if ids:
            yield _batch([_row(OWN, bucket, ids=planes(np.concatenate(ids)), many=planes(np.concatenate(many)), **_classes(at, n, which, p.k))])
        del which, ids, many
        few = np.zeros((p.order + 1, p.k + 2), np.int64)
        cold = hot.of(words)[at[:, 1]] == 0
        for m in range(2, columns + 1):
            if kind == HOT or m == p.order and p.order > 2:
                few[m] = _few(n, p.k)
            else:
                own = slice(None) if m > 2 else cold
                _, _, which, _ = distinct(ranked(at[own, :m], len(words)))
                few[m] = _few(np.bincount(which, weights=n[own]), p.k)
        yield _batch([_row(kind, bucket, words=ascending(words), at=_numbers(at, len(words)), n=planes(n.astype(np.uint64)), x=few.tobytes())])

    return reduce


def _classes(at: np.ndarray, n: np.ndarray, which: np.ndarray, k: int) -> dict[str, bytes]:
    """What probabilities depend on before discounts are known, and the number among these of each occurrence ``which``.

    These are the count, the total of the context, and, by bits, which of the counts that are discounted the context has.
    """
    of = np.append(0, np.cumsum((at[1:, 1:] != at[:-1, 1:]).any(axis=1)))  # n-grams of a context stand together
    total = np.bincount(of, weights=n).astype(np.uint64)
    some = np.zeros(len(total), np.uint64)
    for r in range(1, k + 1):
        some[of[n == r]] |= U64(1 << r)
    _, first, at, _ = distinct(pair(pair(total, some)[of], n.astype(np.uint64)))
    own, at = of[first], at[which]
    return {"n": planes(n[first].astype(np.uint64)), "at": planes(total[own]), "x": planes(some[own]), "doc": planes(at.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32))}


def _own_sums(k: int, d: np.ndarray):
    """Sums of log probabilities by document and bucket, of the n-grams that were kept with their documents."""
    less = U64(sum(1 << r for r in range(1, k + 1) if d[r] < 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, total, some, at, many, ids = (b.column(x)[i].as_py() for x in ("n", "at", "x", "doc", "many", "ids"))
                n, total = unplanes(n, np.uint64).astype(float), unplanes(total, np.uint64).astype(float)
                total += unplanes(some, np.uint64) & less == 0  # as in _enough
                value = np.log10(discounted(n, d) / total)[unplanes(at, np.uint16 if len(n) <= 1 << 16 else np.uint32)]
                ids, many = unplanes(ids, np.int64), unplanes(many, np.uint32).astype(np.int64)
                yield pa.record_batch([pa.array(ids), pa.array(np.add.reduceat(value, np.cumsum(many) - many)), pa.array(many)], ["doc_id", "sum", "n"])

    return released(run)


def discounts(few: np.ndarray, k: int) -> np.ndarray:
    """Good-Turing discount of each count 0 .. k (Katz's form) from the counts of counts 0 .. k + 1.

    Where the counts of counts do not give a discount inside (0, 1], such as in a small corpus, that count keeps its weight.
    """
    d = np.ones(k + 1)
    if few[1] > 0:
        common = (k + 1) * few[k + 1] / few[1]
        for r in range(1, k + 1):
            if few[r] > 0 and common < 1:
                x = ((r + 1) * few[r + 1] / few[r] / r - common) / (1 - common)
                if 0 < x <= 1:
                    d[r] = x
    return d


def discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return n * np.where(n < len(d), d[np.minimum(n, len(d) - 1).astype(np.int64)], 1.0)


def _enough(total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Totals of contexts; one none of whose counts is discounted would leave nothing, so one more is added to it."""
    return np.where(total - kept < 1e-9, total + 1, total)


class Words:
    """The words of a bucket and the bigrams of hot words and them, to be looked up."""

    def __init__(self, rows: list[dict], hot: HotWords):
        own = {r["kind"]: r for r in rows if r["kind"] in (WORD, HOT)}
        self.words, self.n, self.many = np.zeros(1, np.uint64), np.zeros(1), len(hot.words) + 1
        if WORD in own:
            self.words, self.n = unascending(own[WORD]["words"]), unplanes(own[WORD]["n"], np.uint64).astype(float)
        self.key, self.pairs = np.full(1, -1), np.zeros(1)
        if HOT in own:
            words, at = _unpack(own[HOT]["words"], own[HOT]["at"], 2)
            c = words[at]
            key = np.searchsorted(self.words, c[:, 0]) * self.many + hot.of(c[:, 1])
            order = np.argsort(key)
            self.key, self.pairs = key[order], unplanes(own[HOT]["n"], np.uint64).astype(float)[order]

    def find(self, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and of the bigrams of hot words (by number; 0 for none) and them."""
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        key = at * self.many + h
        pair_at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.words[at] == w
        return np.where(known, self.n[at], 0.0), np.where(known & (h > 0) & (self.key[pair_at] == key), self.pairs[pair_at], 0.0)


def _hot_sums(d1: np.ndarray, d2: np.ndarray, denominator: float, hot: HotWords):
    """Of each hot context word in a bucket: what its bigrams count, what of it is kept, and the probability of their words."""

    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        t = Words(rows, hot)
        if t.key[0] < 0:
            return
        h, size = t.key % t.many, t.many
        low = discounted(t.n, d1)[t.key // t.many] / denominator
        sums = [np.bincount(h, weights=x, minlength=size) for x in (t.pairs, discounted(t.pairs, d2), low)]
        some = np.flatnonzero(sums[0])
        yield pa.record_batch([pa.array(some), *[pa.array(x[some]) for x in sums]], ["h", "total", "kept", "low"])

    return reduce


def _hot_pairs(hot: HotWords):
    """(first, second, n) of the bigrams of two hot words, numbers from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, at, raw in zip(*[b.column(k).to_pylist() for k in range(3)]):
                own, at = _unpack(words, at, 2)
                c, n = own[at], unplanes(raw, np.uint64).astype(np.int64)
                w = hot.of(c[:, 0])
                yield pa.record_batch([pa.array(hot.of(c[:, 1])[w > 0]), pa.array(w[w > 0]), pa.array(n[w > 0])], ["first", "second", "n"])

    return run


def _asks(words: np.ndarray, rows: np.ndarray, hot: HotWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, number of a hot context word before it), sorted, and the place of each n-gram's in them."""
    many = len(hot.words) + 1
    key, _, at, _ = distinct(rows[:, 0].astype(np.int64) * many + hot.of(words)[rows[:, 1]])
    return words[key // many], key % many, at


def _ask(order: int, count: int, hot: HotWords):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for home, words, at in zip(*[b.column(k).to_pylist() for k in range(3)]):
                w, h, _ = _asks(*_unpack(words, at, order), hot)
                start = _heads(bucket := _in(w, count))
                x = pa.array([int(home).to_bytes(4, "little")] * (len(start) - 1), pa.binary())
                yield _columns(LOOK, bucket[start[:-1]], words=ascending_by(w, start), at=planes_by(h.astype(np.uint32), start), x=x)

    return released(run)


def _answer(hot: HotWords):
    """Counts of what was asked, sent home."""

    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        t = Words(rows, hot)
        for r in rows:
            if r["kind"] == LOOK:
                h = unplanes(r["at"], np.uint32).astype(np.int64)
                n, pairs = t.find(unascending(r["words"]), h)
                yield _batch([_row(LOOK, int.from_bytes(r["x"], "little"), n=planes(np.where(h > 0, pairs, n).astype(np.uint64)), x=bucket.to_bytes(4, "little"))])

    return reduce


class Level:
    """The n-grams of one order in a bucket: sorted names, counts, probabilities, and the contexts of each."""

    def __init__(self, c: np.ndarray, n: np.ndarray, m: int, d: np.ndarray):
        ctx = context(c, m)
        self.gram, self.first, self.at, _ = distinct(pair(ctx, c[:, 0]))
        n = np.bincount(self.at, weights=n)
        self.ctx, _, self.of, _ = distinct(ctx[self.first])
        kept = discounted(n, d)
        total, self.kept = np.bincount(self.of, weights=n), np.bincount(self.of, weights=kept)
        self.total = _enough(total, self.kept)
        self.p = kept / self.total[self.of]


def _levels(words: np.ndarray, rows: np.ndarray, raw: bytes, order: int, d: dict[int, np.ndarray], hot: HotWords) -> tuple[np.ndarray, dict[int, Level]]:
    """Which n-grams have a last context word that isn't hot, and the levels of all orders."""
    c, n = words[rows], unplanes(raw, np.uint64).astype(float)
    cold = hot.of(c[:, 1]) == 0
    return cold, {m: Level(c, n, m, d[m]) if m > 2 else Level(c[cold], n[cold], m, d[m]) for m in range(2, order + 1)}


def _weigh(order: int, d: dict[int, np.ndarray], denominator: float, total: np.ndarray, hot: HotWords):
    """The backoff weights (log10) of all contexts of a bucket, order by order, each sorted by name."""

    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = next(r for r in rows if r["kind"] == GRAM)
        told = sorted((r for r in rows if r["kind"] == LOOK), key=lambda r: int.from_bytes(r["x"], "little"))
        told = np.concatenate([unplanes(r["n"], np.uint64) for r in told]).astype(float)  # in the order of what was asked
        words, at = _unpack(own["words"], own["at"], order)
        n = unplanes(own["n"], np.uint64).astype(float)
        rows.clear()
        del own
        cold = hot.of(words)[at[:, 1]] == 0
        _, h, asked = _asks(words, at, hot)
        # the probability of each n-gram's word one order below, from the lowest that the bucket has
        low = np.where(h > 0, discounted(told, d[2]) / total[h], discounted(told, d[1]) / denominator)[asked]
        del told, h, asked
        out = []
        for m in range(2, order + 1):  # one level in memory at a time
            some = cold if m == 2 else slice(None)
            level = Level(words[at[some, :m]], n[some], m, d[m])
            rest = np.maximum(1 - np.bincount(level.of, weights=low[some][level.first]), 1e-12)
            out.append(np.log10((1 - level.kept / level.total) / rest))
            low[some] = level.p[level.at]
            del level, rest
        yield _batch([_row(BACK, bucket, x=np.concatenate(out).tobytes())])

    return reduce


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Count the n-grams of all orders of all documents (rows with an id and text) and store the normalised tables.

    Repeated rows count again. Without a word the tables are empty and every word is unknown, of probability 1.
    """
    return _trained(docs.select("doc_id", "text").dropna().select(F.lit(0).cast("bigint").alias("doc_id"), "text"), buckets(docs, 4 << 20), p)[0]


def _trained(rows: DataFrame, count: int, p: Params, keep: bool = False) -> tuple[Model, DataFrame]:
    """The model, and the table of what documents keep of their n-grams."""
    if p.order < 2:
        raise ValueError("the order must be at least 2")
    words = materialize(exchange(rows.mapInArrow(_count_words(p, count), _ROWS), _sum_words(p), _ROWS), "word-counts")
    few = {1: np.zeros(p.k + 2)} | {m: np.zeros(p.k + 2) for m in range(2, p.order + 1)}
    total = 0
    for r in words.select("x").collect():  # a few numbers a bucket
        own = np.frombuffer(bytes(r.x), np.int64)
        few[1] += own[:-1]
        total += int(own[-1])
    d = {1: discounts(few[1], p.k)}
    lost = float((few[1][: p.k + 1] * np.arange(p.k + 1) * (1 - d[1])).sum())
    denominator = float(total) if lost >= 1e-9 else float(total + 1)
    unknown = float(np.log10((denominator - (total - lost)) / denominator))
    frequent = sorted(tuple(r) for r in words.select("words", "n").mapInArrow(_frequent(p.share * total), "word bigint, n bigint").collect())
    hot = HotWords(np.append(np.array([w for w, _ in frequent], np.int64).view(np.uint64), BEGIN))
    word = np.zeros(len(hot.words) + 1)
    for w, n in frequent:
        word[hot.of(np.array([w], np.int64).view(np.uint64))] = discounted(np.array([float(n)]), d[1]) / denominator

    # part by part, so that what is on its way at once is a share of the corpus
    parts = [materialize(exchange(rows.mapInArrow(_count(p, count, hot, part, keep), _ROWS), _sum(p, hot, keep), _ROWS), "ngram-counts", ("kind",)) for part in range(p.parts)]
    table = reduce(DataFrame.unionByName, parts).select(*_NAMES)
    for r in table.where(F.col("kind") != OWN).select("x").collect():  # a few numbers a bucket
        own = np.frombuffer(bytes(r.x), np.int64).reshape(p.order + 1, -1)
        for m in range(2, p.order + 1):
            few[m] += own[m]
    d |= {m: discounts(few[m], p.k) for m in range(2, p.order + 1)}
    words = words.unionByName(table.where(F.col("kind") == HOT))
    grams = table.where(F.col("kind") == GRAM)
    sums = exchange(words, _hot_sums(d[1], d[2], denominator, hot), "h bigint, total double, kept double, low double")
    size, back, both = np.ones(len(hot.words) + 1), np.zeros(len(hot.words) + 1), np.zeros((len(hot.words) + 1,) * 2)
    for r in sums.groupBy("h").agg(F.sum("total").alias("total"), F.sum("kept").alias("kept"), F.sum("low").alias("low")).collect():
        size[r.h] = float(_enough(np.array(r.total), np.array(r.kept)))
        back[r.h] = np.log10((1 - r.kept / size[r.h]) / max(1 - r.low, 1e-12))
    for r in table.where(F.col("kind") == HOT).select("words", "at", "n").mapInArrow(_hot_pairs(hot), "first bigint, second bigint, n bigint").collect():
        both[r.first, r.second] = r.n
    asks = grams.select("bucket", "words", "at").mapInArrow(_ask(p.order, count, hot), _ROWS)
    told = materialize(exchange(asks.unionByName(words), _answer(hot), _ROWS), "lower-counts")
    backs = materialize(exchange(grams.unionByName(told), _weigh(p.order, d, denominator, size, hot), _ROWS), "backoff-weights", replaces=told)
    return Model(p.order, count, words, grams.unionByName(backs), d, denominator, unknown, hot, size, back, word, both), table.where(F.col("kind") == OWN)


def _occurrences(c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct rows of ``c``, how often each stands there, and the documents of all, row by row."""
    order = np.argsort(name := pair(context(c, c.shape[1]), c[:, 0]))
    head = np.flatnonzero(np.append(True, name[order[1:]] != name[order[:-1]])[: len(order)])
    return order[head], np.diff(np.append(head, len(order))), doc[order]


def _docs(doc: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
    local, at = np.unique(doc, return_inverse=True)
    return {"doc": planes(at.astype(np.uint16 if len(local) <= 1 << 16 else np.uint32)), "ids": ids[local].tobytes()}


def _places(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(document ids, the place in them of each occurrence) of a row."""
    ids = np.frombuffer(r["ids"], np.int64)
    return ids, unplanes(r["doc"], np.uint16 if len(ids) <= 1 << 16 else np.uint32).astype(np.int64)


def _fall(w: np.ndarray, h: np.ndarray, weight: np.ndarray, many: np.ndarray, doc: np.ndarray, ids: np.ndarray, count: int) -> list[tuple]:
    """Rows for the bucket of each word: what is left to look up, with the backoff weights so far."""
    order = np.argsort(w, kind="stable")
    of = np.repeat(np.arange(len(w)), many)
    rank = np.empty(len(w), np.int64)
    rank[order] = np.arange(len(w))
    doc = doc[np.argsort(rank[of], kind="stable")]
    w, h, weight, many = w[order], h[order], weight[order], many[order]
    stop, cut = np.append(0, np.cumsum(many)), bounds(w, count)
    parts = [(int(k), slice(cut[k], cut[k + 1])) for k in np.flatnonzero(np.diff(cut))]
    return [_row(FALL, k, words=ascending(w[s]), at=planes(h[s].astype(np.uint32)), many=planes(many[s].astype(np.uint32)), x=weight[s].tobytes(), **_docs(doc[stop[s.start] : stop[s.stop]], ids)) for k, s in parts]


def _sums(ids: np.ndarray, doc: np.ndarray, value: np.ndarray) -> tuple:
    n = np.bincount(doc, minlength=len(ids))
    some = np.flatnonzero(n)
    return _row(SUM, -1, ids=ids[some].tobytes(), n=planes(n[some].astype(np.uint32)), x=np.bincount(doc, weights=value, minlength=len(ids))[some].tobytes())


def _lookups(p: Params, count: int, hot: HotWords, order: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, at, doc, ids in blocks(batches, p.block, order):
            c = words[at]
            h, home = _homes(words, at, hot, count)
            own, rows, packer = np.flatnonzero(home * p.parts // count == part), [], Packer(words)
            for k, some in _by_bucket(home[own]):
                some = own[some]
                first, many, docs = _occurrences(c[some], doc[some])
                own_words, where, by = packer.pack(at[some[first]])
                start = np.cumsum(many) - many
                many = many[by]
                docs = docs[np.repeat(start[by], many) + np.arange(len(docs)) - np.repeat(np.cumsum(many) - many, many)]
                rows.append(_row(LOOK, k, words=own_words, at=where, many=planes(many.astype(np.uint32)), **_docs(docs, ids)))
            if part == 0 and (away := home < 0).any():  # bigrams of hot words
                rows += _fall(c[away, 0], h[away], np.zeros(away.sum()), np.ones(away.sum(), np.int64), doc[away], ids, count)
            if rows:
                yield _batch(rows)

    return released(run)


def _look_up(m: Model):
    """Sums by document of the log probabilities of seen n-grams; the others, to the buckets of their words."""
    order, count, hot, d, total, back, word, both = m.order, m.buckets, m.hot, m.d, m.total, m.back, m.word, m.both

    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = {r["kind"]: r for r in rows if r["kind"] in (GRAM, BACK)}
        levels, weights = {}, {}
        if own:
            _, levels = _levels(*_unpack(own[GRAM]["words"], own[GRAM]["at"], order), own[GRAM]["n"], order, d, hot)
            values = np.frombuffer(own[BACK]["x"])
            for k, level in levels.items():
                weights[k], values = values[: len(level.ctx)], values[len(level.ctx) :]
        for r in rows:
            if r["kind"] == FALL:
                yield _batch([tuple(r[x] for x in _NAMES)])
            if r["kind"] != LOOK:
                continue
            words, at = _unpack(r["words"], r["at"], order)
            c = words[at]
            h = hot.of(c[:, 1])
            value, weight, left = np.zeros(len(c)), np.zeros(len(c)), np.ones(len(c), bool)
            for k in range(order, 1, -1):
                level = levels.get(k)
                i = np.flatnonzero(left if k > 2 else left & (h == 0))
                if level is None or not len(level.gram) or not len(i):
                    continue
                ctx = context(c[i], k)
                name = pair(ctx, c[i, 0])
                at = np.minimum(np.searchsorted(level.gram, name), len(level.gram) - 1)
                hit = level.gram[at] == name
                value[i[hit]] = weight[i[hit]] + np.log10(level.p[at[hit]])
                left[i[hit]] = False
                i, ctx = i[~hit], ctx[~hit]
                at = np.minimum(np.searchsorted(level.ctx, ctx), len(level.ctx) - 1)
                known = level.ctx[at] == ctx
                weight[i[known]] += weights[k][at[known]]
            # hot words are known here too, lest their bucket get more than its share
            w = hot.of(c[:, 0])
            i = np.flatnonzero(left & (w > 0))
            if len(i):
                n = both[h[i], w[i]]
                value[i] = weight[i] + np.where(n > 0, np.log10(np.maximum(discounted(n, d[2]) / total[h[i]], 1e-300)), back[h[i]] + np.log10(word[w[i]]))
                left[i] = False
            many = unplanes(r["many"], np.uint32).astype(np.int64)
            (ids, doc), each = _places(r), np.repeat(np.arange(len(c)), many)
            hit = ~left[each]
            out = [_sums(ids, doc[hit], value[each[hit]])]
            if left.any():
                out += _fall(c[left, 0], h[left], weight[left], many[left], doc[~hit], ids, count)
            yield _batch(out)

    return reduce


def _back_off(m: Model):
    d, denominator, unknown, hot, total, back = m.d, m.denominator, m.unknown, m.hot, m.total, m.back

    def reduce(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        t = Words(rows, hot)
        for r in rows:
            if r["kind"] != FALL:
                continue
            h = unplanes(r["at"], np.uint32).astype(np.int64)
            n, pairs = t.find(unascending(r["words"]), h)
            low = np.where(n > 0, np.log10(np.maximum(discounted(n, d[1]) / denominator, 1e-300)), unknown)
            value = np.where(pairs > 0, np.log10(np.maximum(discounted(pairs, d[2]) / total[h], 1e-300)), back[h] + low)
            (ids, doc), each = _places(r), np.repeat(np.arange(len(h)), unplanes(r["many"], np.uint32))
            yield _batch([_sums(ids, doc, (np.frombuffer(r["x"]) + value)[each])])

    return reduce


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums as rows, those of one document in a batch added up."""
    for b in batches:
        ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), np.int64)
        value = np.frombuffer(b"".join(b.column("x").to_pylist()))
        n = np.concatenate([unplanes(x, np.uint32) for x in b.column("n").to_pylist()] or [np.zeros(0, np.uint32)])
        ids, at = np.unique(ids, return_inverse=True)
        yield pa.record_batch([pa.array(ids), pa.array(np.bincount(at, weights=value, minlength=len(ids))), pa.array(np.bincount(at, weights=n, minlength=len(ids)).astype(np.int64))], ["doc_id", "sum", "n"])


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, words, log10_prob, perplexity) of every document under the model.

    A document without a word has 0 words, log probability 0 and a null perplexity. Rows with a null id or text are left
    out; the rows of a repeated id are one document. Ids may be of any kind. Look-ups go out in ``parts``, by home bucket, so
    that what is on its way at once is a share of the corpus.
    """
    return numbered(docs.select("doc_id", "text").dropna(), lambda rows: _scored(rows, model, p), "doc_id")


def _scored(rows: DataFrame, m: Model, p: Params) -> DataFrame:
    done, none = [], []
    for part in range(p.parts):
        mine = m.grams.where(F.floor(F.col("bucket") * p.parts / m.buckets) == part)
        asked = rows.mapInArrow(_lookups(p, m.buckets, m.hot, m.order, part), _ROWS)
        got = materialize(exchange(asked.unionByName(mine), _look_up(m), _ROWS), "scores")
        done.append(got.where(F.col("kind") == SUM))
        none.append(got.where(F.col("kind") == FALL))
    done.append(exchange(reduce(DataFrame.unionByName, none).unionByName(m.words), _back_off(m), _ROWS))
    parts = reduce(DataFrame.unionByName, done).select("ids", "x", "n").mapInArrow(_rows, "doc_id bigint, sum double, n bigint")
    return _summed(rows, parts)


def _summed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    parts = parts.unionByName(rows.select("doc_id", F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n")))
    s, n = F.sum("sum"), F.sum("n")
    return parts.groupBy("doc_id").agg(n.alias("words"), F.round(s, 4).alias("log10_prob"), F.when(n > 0, F.round(F.pow(F.lit(10.0), -s / n), 4)).alias("perplexity"))


def train_and_score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``score(docs, train(docs, p), p)``, where n-grams are sent to their homes once, with their documents.

    Every n-gram of the highest order was seen then, so its probability needs its count, the total of its context and the
    discounts, which are known when all is counted.
    """
    if p.order == 2 or p.k > 62:  # bigrams of hot words have no home; counts are bits of a number
        return score(docs, train(docs, p), p)

    def run(rows: DataFrame) -> DataFrame:
        model, own = _trained(rows, buckets(docs, 4 << 20), p, keep=True)
        return _summed(rows, own.mapInArrow(_own_sums(p.k, model.d[p.order]), "doc_id bigint, sum double, n bigint"))

    return numbered(docs.select("doc_id", "text").dropna(), run, "doc_id")
