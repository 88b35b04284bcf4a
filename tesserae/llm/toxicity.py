"""Toxicity by a factorization machine over hashed terms.

score = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2): the factors learn that two terms are
worse together, such as an insult and the mention of a group, which no sum of single weights can tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Tokens, released, slices
from .quality import labelled


_STEM = 4


@dataclass(frozen=True)
class Params:
    """``max_train_rows`` bounds the labelled rows that the fit sees; a document from ``threshold`` on is toxic.

    Terms of fewer than ``min_docs`` of those rows get no weight, lest the model learn its examples by heart.
    """

    bits: int = 18
    factors: int = 8
    max_train_rows: int = 8000
    min_docs: int = 8
    epochs: int = 6
    rate: float = 0.5
    factor_rate: float = 0.1
    l2: float = 1e-3
    factor_l2: float = 3e-3
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    """Bias, weights[2**bits] and factors[2**bits, f]; a fixed size, whatever the input."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first): the distinct hashed terms of each document, of value log2(1 + count) / (their number)**(1/4).

    Terms are words and, for words of more than four bytes, their first four bytes, which inflected forms share.
    """
    t = Tokens(data, offsets, spans=True)
    long = t.end - t.begin > _STEM
    stem = t.prefix(_STEM, long)
    doc = np.concatenate([t.doc, t.doc[long]]).astype(np.uint64)
    key = (doc << np.uint64(bits)) | (np.concatenate([t.hash, stem]) >> np.uint64(64 - bits))
    key, count = np.unique(key, return_counts=True)
    doc = (key >> np.uint64(bits)).astype(np.int64)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    n = np.diff(first)
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.log2(1.0 + count) / np.sqrt(np.sqrt(n[doc])), first


def _gather(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column("text")):
                idx, x, first = terms(data, offsets, bits)
                idx, x = idx.astype(np.uint32), x.astype(np.float32)
                cut = [slice(first[k], first[k + 1]) for k in range(j - i)]
                yield pa.record_batch([b.column("label").slice(i, j - i), pa.array([idx[c].tobytes() for c in cut], pa.binary()), pa.array([x[c].tobytes() for c in cut], pa.binary())], ["label", "idx", "x"])

    return released(run)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> Model:
    """Stochastic gradient descent with per-coordinate step sizes on the logistic loss, classes weighted alike."""
    d = 1 << p.bits
    rng = np.random.default_rng(3)
    w, v, bias = np.zeros(d), rng.normal(0, 0.02, (d, p.factors)), 0.0
    # steps shrink with what a coordinate has seen; the head start keeps rare terms from leaping
    gw, gv, gb = np.ones(d), np.ones((d, p.factors)), 1.0
    seen = np.zeros(d, np.int64)
    for i, _, _ in examples:
        seen[i] += 1
    known = seen >= min(p.min_docs, max(1, len(examples) // 20))
    v[~known] = 0
    examples = [(i[known[i]], x[known[i]], y) for i, x, y in examples]
    ones = sum(y for _, _, y in examples)
    weight = {1: len(examples) / 2 / max(1, ones), 0: len(examples) / 2 / max(1, len(examples) - ones)}
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        for k in rng.permutation(len(examples)):
            i, x, y = examples[k]
            vx = v[i] * x[:, None]
            s = vx.sum(0)
            z = bias + w[i] @ x + 0.5 * float(s @ s - (vx * vx).sum())
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * weight[y]
            dw = g * x + p.l2 * w[i]
            dv = g * x[:, None] * (s - vx) + p.factor_l2 * v[i]
            gw[i] += dw * dw
            gv[i] += dv * dv
            gb += g * g
            w[i] -= rate * dw / np.sqrt(gw[i])
            v[i] -= rate * p.factor_rate * dv / np.sqrt(gv[i])
            bias -= rate * g / np.sqrt(gb)
    return Model(bias, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model of P(toxic = 1). Without both classes among the labels nothing is toxic: the bias is minus 35, all else 0."""
    rows = labelled(docs, labels, "toxic", p.max_train_rows).mapInArrow(_gather(p.bits), "label int, idx binary, x binary").collect()
    if len({r.label for r in rows}) < 2:
        return Model(-35.0, np.zeros(1 << p.bits, np.float32), np.zeros((1 << p.bits, p.factors), np.float32))
    examples = [(np.frombuffer(bytes(r.idx), np.uint32).astype(np.int64), np.frombuffer(bytes(r.x), np.float32).astype(float), r.label) for r in rows]
    return fit(sorted(examples, key=lambda e: (len(e[0]), e[0].tobytes())), p)


def probabilities(column: pa.Array, m: Model, bits: int) -> np.ndarray:
    out = np.empty(len(column))
    for i, j, data, offsets in slices(column):
        idx, x, first = terms(data, offsets, bits)
        n, rows = j - i, np.repeat(np.arange(j - i), np.diff(first))
        z = m.bias + np.bincount(rows, weights=m.weights[idx] * x, minlength=n)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            vx = m.factors[idx] * x[:, None].astype(np.float32)
            s = np.add.reduceat(vx, first[full], axis=0)
            z[full] += 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first[full]))
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    return out


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, toxicity) for every row; a null or empty text gets the probability of the bias alone. Repeated rows repeat.

    Ids of any kind, null too, pass as they are; an empty table gives an empty one.
    """
    m = docs.sparkSession.sparkContext.broadcast(model)
    bits = p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(np.round(probabilities(b.column(1), m.value, bits), 6))], ["doc_id", "toxicity"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxicity double")


def toxic(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """The rows of ``score`` from the threshold on; a null or empty text is never among them."""
    return score(docs.where(F.length("text") > 0), model, p).where(F.col("toxicity") >= p.threshold)
