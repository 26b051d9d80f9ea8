"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-Proximal.

A text is cut into runs of letters and digits and runs of other signs, kept in their case. Features
are hashes of single runs, of neighbouring pairs and, in place of a pair, one feature for a run that
repeats the one before it. A feature's value is its count over the number of features of the text, so
a score is the dot product of a sparse row with the weights, plus the bias; it is computed for all
rows of a slice by one gather and one prefix sum.

Training takes labelled rows, sampled by a hash of the id so that they have about `train_chars`
characters at every input size. That bounds what the driver holds and what is broadcast (the weights:
8 << `bits` bytes). Scoring reads every row and whole texts.

Null and empty texts get the score of the bias alone. Rows without a label are not learned from;
with several labels for an id each counts. Without any labelled row the score is 0.5. Further columns
of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasforge.llm.common import modest_batches
from atlasforge.llm.textcore import U, lean, mix, slices, span_hashes, spans

_CLASS = np.full(256, 2, dtype=np.uint8)  # 0 white space, 1 letters and digits, 2 other signs
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_REPEAT = U(0x5851F42D4C957F2D)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of all rows of a slice one after another, and where each row's begin."""
    kind = _CLASS[raw]
    inside = kind != 0
    cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1  # a change of class ends a run, too
    start, end = spans(inside, np.union1d(offsets, cut))
    h = span_hashes(raw + np.uint8(1), start, end)
    first = np.searchsorted(start, offsets)
    both = np.empty(2 * len(h), dtype=U)
    both[0::2] = h
    prev = np.concatenate((np.zeros(1, dtype=U), h[:-1]))
    prev[first[:-1][first[:-1] < len(h)]] = 0
    both[1::2] = np.where(prev == h, _REPEAT, mix(prev * U(0xC2B2AE3D27D4EB4F) + h))
    return (mix(both) >> U(64 - bits)).astype(np.int64), 2 * first


class Ftrl:
    """Follow the regularised leader, per coordinate, with L1 and L2."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, l1: float, l2: float) -> np.ndarray:
    """Weights (the bias last) from rows (distinct features, values, label), in a fixed shuffled order;
    the rarer label weighs as much in all as the other does at most, up to a factor of four."""
    model = Ftrl(bits, alpha, 1.0, l1, l2)
    good = sum(y for *_, y in rows)
    weight = {1: 1.0, 0: min(4.0, max(1.0, good / max(len(rows) - good, 1)))} if rows else {}
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            model.update(np.append(at, 1 << bits), np.append(x, 1.0), y, weight[y])
    return model.weights(slice(None))


def learn(docs: DataFrame, labels: DataFrame, train_chars: int = 24_000_000, bits: int = 20, epochs: int = 3, alpha: float = 1.0, l1: float = 0.002, l2: float = 0.0, value_scale: float = 30.0) -> np.ndarray:
    """Fits on documents (doc_id, text) and labels (doc_id, label in 0 and 1). Both are sampled before
    they meet; how large a part is follows from the number of labels and the mean length of a text."""
    modest_batches(docs.sparkSession)
    known = labels.where("label in (0, 1)").select(F.col("doc_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    total = known.count() * (texts.agg(F.avg(F.coalesce(F.length("text"), F.lit(0))).alias("n")).first()["n"] or 0)
    share = min(1.0, train_chars / max(total, 1))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000
    sample = texts.where(chosen).join(known.where(chosen), "id").select("id", "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in slices(batch.column("text")):
                idx, first = features(raw, offsets, bits)
                at, x = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    u, c = np.unique(idx[a:b], return_counts=True)
                    at.append(u.astype(np.int32))
                    x.append((c * (value_scale / max(b - a, 1))).astype(np.float32))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32())), part.column(2)], names=["id", "at", "x", "label"])

    table = sample.mapInArrow(lean(extract), "id string, at array<int>, x array<float>, label int").toArrow()
    found = [(i, np.asarray(a.values), np.asarray(x.values), y) for i, a, x, y in zip(table["id"].to_pylist(), table["at"], table["x"], table["label"].to_pylist(), strict=True)]
    found.sort(key=lambda r: (r[0] or "", r[3], len(r[1])))  # whatever order the tasks ended in
    return train([r[1:] for r in found], bits, epochs, alpha, l1, l2)


def score(docs: DataFrame, weights: np.ndarray, value_scale: float = 30.0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score, the probability of label 1, for every row."""
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo, hi, raw, offsets in slices(batch.column(1)):
                idx, first = features(raw, offsets, bits)
                sums = np.concatenate(([0.0], np.cumsum(w[idx], dtype=float)))
                n = np.diff(first)
                dot = (sums[first[1:]] - sums[first[:-1]]) * (value_scale / np.maximum(n, 1)) + float(w[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], names=["doc_id", "score"])

    return slim.mapInArrow(lean(run), f"doc_id {dict(slim.dtypes)['doc_id']}, score double")
