"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A document's features are its distinct 3- to 5-character strings (lower case, white space as one blank, a blank at
either end), hashed. From a bounded labelled sample, smoothed counts give each feature the log ratio of its shares in
either class; the features that tell the classes apart best are kept, and a logistic regression is fitted on their
values times that ratio. Scoring hashes all characters of whole texts with array operations; most hashes have no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.sample import labelled
from alphaloom.llm.shared import spans, utf8

ORDERS = (3, 4, 5)
BITS = 20
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLANKS = " \t\n\r\x0b\x0c"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, blanks around each, and where each text begins."""
    parts = [" " + t.lower() + " " for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(np.isin(codes, [ord(c) for c in BLANKS]), np.uint32(32), codes), starts


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of each n-gram and where it begins, over all texts; those across two texts are left out."""
    codes, starts = _codes(texts)
    c = codes.astype(np.uint64) + np.uint64(1)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(c))  # characters to the end of the text
    h = c
    for n in range(2, ORDERS[-1] + 1):
        if len(c) < n:
            return
        h = h[: len(c) - n + 1] * _STEP + c[n - 1 :]
        if n in ORDERS:
            yield ((h ^ (h >> np.uint64(29))) * _LAST >> np.uint64(64 - BITS)).astype(np.int32), left[: len(h)] >= n


class Model:
    def __init__(self, weights: np.ndarray, bias: float, cut: float) -> None:
        #: weights by bucket; most are 0
        self.weights, self.bias, self.cut = weights, bias, cut

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        keys = []
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t.lower()) + 2 for t in texts], out=starts[1:])
        used = self.weights != 0
        for bucket, whole in features(texts):
            at = np.flatnonzero(used[bucket] & whole)
            keys.append((np.searchsorted(starts, at, "right") - 1) << BITS | bucket[at])
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        total = np.bincount(keys >> BITS, self.weights[keys & ((1 << BITS) - 1)], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -40, 40)))


def _table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The document and the bucket of each distinct feature of each document."""
    doc, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i in range(0, len(texts), 64):
        part = texts[i : i + 64]
        starts = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t.lower()) + 2 for t in part], out=starts[1:])
        found = [(np.searchsorted(starts, np.flatnonzero(whole), "right") - 1) << BITS | b[whole] for b, whole in features(part)]
        k = np.unique(np.concatenate(found))
        doc.append((k >> BITS).astype(np.int32) + i)
        buckets.append((k & ((1 << BITS) - 1)).astype(np.int32))
    return np.concatenate(doc), np.concatenate(buckets)


def _weights(doc: np.ndarray, buckets: np.ndarray, y: np.ndarray, use: np.ndarray, keep: int, alpha: float, ridge: float, steps: int) -> np.ndarray:
    """Weights by bucket, from the documents marked in use."""
    size = 1 << BITS
    mine = use[doc]
    doc, buckets = doc[mine], buckets[mine]
    positive = np.bincount(buckets[y[doc] == 1], minlength=size).astype(float)
    negative = np.bincount(buckets[y[doc] == 0], minlength=size).astype(float)
    n1, n0 = max(1.0, y[use].sum()), max(1.0, (1 - y[use]).sum())
    p, q = (positive + alpha) / (n1 + 2 * alpha), (negative + alpha) / (n0 + 2 * alpha)
    ratio = np.log(p / q)
    gain = (p - q) ** 2 / (p * (1 - p) / n1 + q * (1 - q) / n0)
    gain[positive + negative < 3] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[:keep])
    chosen = chosen[gain[chosen] > 6]
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    known = place[buckets] >= 0
    row, col = doc[known], place[buckets[known]]
    value = ratio[chosen][col]
    # Either class weighs half; accelerated gradient descent with a step from the largest row norm.
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * use
    lipschitz = 0.25 * max(1.0, np.bincount(row, value**2, len(y)).max(initial=0)) + ridge
    w, b = np.zeros(len(chosen)), 0.0
    v, c = w.copy(), b
    for t in range(1, steps + 1):
        z = np.bincount(row, value * v[col], len(y)) + c
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        nw = v - (np.bincount(col, value * g[row], len(chosen)) + ridge * v) / lipschitz
        nb = c - g.sum() / lipschitz * 10
        k = (t - 1) / (t + 2)
        v, c, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    weights = np.zeros(size)
    weights[chosen] = w * ratio[chosen]
    return weights


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a logistic curve over raw scores, either class weighing half, with softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    middle, spread = z.mean(), z.std() + 1e-9
    x = np.stack([(z - middle) / spread, np.ones(len(z))])
    a = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        a -= np.clip(np.linalg.solve(h, x @ (weight * (p - target))), -2, 2)
    return float(a[0] / spread), float(a[1] - a[0] * middle / spread)


def fit_texts(pairs: list[tuple[int, str]], keep: int = 4096, alpha: float = 0.5, ridge: float = 3e-3, steps: int = 200, folds: int = 4) -> Model:
    """Fits on (label, text) pairs; with one class only, the scores are constant.

    The curve from raw scores to (0, 1) comes from scores of held-out folds of the sample.
    """
    y = np.array([int(a == 1) for a, _ in pairs], float)
    if len(pairs) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 40.0 if len(pairs) and y.max() == 1 else -40.0, 0.7)
    doc, buckets = _table([t for _, t in pairs])
    rank = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y)).astype(int)  # folds hold either class
    z = np.zeros(len(y))
    for k in range(folds):
        held = rank % folds == k
        w = _weights(doc, buckets, y, ~held, keep, alpha, ridge, steps)
        z[held] = np.bincount(doc, w[buckets], len(y))[held]
    weights = _weights(doc, buckets, y, np.ones(len(y), bool), keep, alpha, ridge, steps)
    scale, bias = _calibrate(z, y)
    return Model(weights * scale, bias, 0.7)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> Model:
    """labels: id, label (1 toxic). At most per_label texts of each label are read into the driver."""
    return fit_texts(labelled(docs, labels, per_label, total_bytes=1 << 23))


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.7): a row for each row of docs.

    A null text is empty; an empty text has no feature with a weight and gets the score of the bias. Ids may be null or
    repeat, and are passed on. An empty table gives no rows. Whole texts are read; no other column is.
    """
    used = np.flatnonzero(model.weights).astype(np.int32)
    packed = (used, model.weights[used], model.bias, model.cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[packed[0]] = packed[1]
        own = Model(weights, packed[2], packed[3])
        for b in batches:
            offsets, data, _ = utf8(b.column(1))
            score = [own.score([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in range(i, j)]) for i, j in spans(offsets, 1 << 19)]
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= own.cut).astype(np.int32))], names=[doc_id, "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"`{doc_id}` {kind}, score double, predicted int")
