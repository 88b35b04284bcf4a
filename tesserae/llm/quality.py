"""Quality classifier: logistic regression on hashed token n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Tokens, mix, ngrams, released, slices


@dataclass(frozen=True)
class Params:
    """``max_train_rows`` bounds the labelled rows that the fit sees; a document below ``threshold`` is rejected."""

    bits: int = 18
    max_train_rows: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    threshold: float = 0.5


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, row) of the hashed unigrams and bigrams; case counts and runs of punctuation are tokens."""
    t = Tokens(data, offsets, fold=False, punct=True)
    two, at = ngrams(t, 2)
    shift = np.uint64(64 - bits)
    return np.concatenate([t.hash >> shift, mix(two) >> shift]).astype(np.int64), np.concatenate([t.doc, at])


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents, chosen by the hash of their id.

    Rows with a null id or label are ignored, as are ids with contradicting labels; repeated rows count once.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col(column).cast("int").alias("__y")).dropna().groupBy("__id")
        .agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").drop("__z")
        .orderBy(F.xxhash64("__id"), "__id").limit(most)
    )
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__t")).dropna()
    # bounded by `most`, hence safe to broadcast at any input size
    return texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__t").alias("text"), F.min("__y").alias("label")).drop("__id")


def _gather(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("label")
            for i, j, data, offsets in slices(b.column("text")):
                idx, row = features(data, offsets, bits)
                order = np.argsort(row, kind="stable")
                idx, cut = idx[order].astype(np.uint32), np.searchsorted(row[order], np.arange(j - i + 1))
                yield pa.record_batch([y.slice(i, j - i), pa.array([idx[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)], pa.binary())], ["label", "idx"])

    return released(run)


class Ftrl:
    """Per-coordinate FTRL-proximal state; ``weights`` is the closed-form minimiser."""

    def __init__(self, p: Params):
        self.p, n = p, (1 << p.bits) + 1  # the last is the bias
        self.z, self.n = np.zeros(n), np.zeros(n)

    def at(self, i: np.ndarray) -> np.ndarray:
        p, z = self.p, self.z[i]
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(self.n[i])) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def update(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.at(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[i]
        new = n + g * g
        self.z[i] += g - (np.sqrt(new) - np.sqrt(n)) / self.p.alpha * w
        self.n[i] = new


def _vector(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    i, c = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
    x = c / np.sqrt(max(1, c.sum()))
    return np.append(i.astype(np.int64), 1 << bits), np.append(x, 1.0)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), column: str = "quality") -> np.ndarray:
    """Weights (2**bits, then the bias) for P(label = 1).

    With no usable label of either class every weight is 0, so that every probability is 0.5 and nothing is rejected.
    """
    rows = labelled(docs, labels, column, p.max_train_rows).mapInArrow(_gather(p.bits), "label int, idx binary").collect()
    model = Ftrl(p)
    if len({r.label for r in rows}) < 2:
        return np.zeros((1 << p.bits) + 1, np.float32)
    examples = sorted(((*_vector(bytes(r.idx), p.bits), r.label) for r in rows), key=lambda e: (len(e[0]), e[0].tobytes()))
    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(examples)):
            model.update(*examples[k])
    return model.at(np.arange((1 << p.bits) + 1)).astype(np.float32)


def probabilities(column: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.empty(len(column))
    for i, j, data, offsets in slices(column):
        idx, row = features(data, offsets, bits)
        n = np.bincount(row, minlength=j - i)
        s = np.bincount(row, weights=weights[idx], minlength=j - i)
        out[i:j] = 1 / (1 + np.exp(-(weights[-1] + s / np.sqrt(np.maximum(n, 1)))))
    return out


def score(docs: DataFrame, weights: np.ndarray, p: Params = Params()) -> DataFrame:
    """(doc_id, quality) for every row; a null or empty text gets the probability of the bias alone. Repeated rows repeat.

    Ids of any kind, null too, pass as they are; an empty table gives an empty one.
    """
    w = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats, whatever the input
    bits = p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(np.round(probabilities(b.column(1), w.value, bits), 6))], ["doc_id", "quality"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality double")


def keep_good(docs: DataFrame, weights: np.ndarray, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability reaches the threshold, ties with it too.

    Rows without a text have nothing to train on and go; an empty text has the probability of the bias alone. Repeated rows
    stay or go together, null ids are no matter, and an empty table gives an empty one.
    """
    w = docs.sparkSession.sparkContext.broadcast(weights)
    bits, threshold, at = p.bits, p.threshold, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(probabilities(b.column(at), w.value, bits) >= threshold))

    return docs.where(F.col("text").isNotNull()).mapInArrow(released(run), docs.schema)
