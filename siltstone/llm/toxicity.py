"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = logistic(theta_k - w x) for grades 0..K with one weight vector w for all thresholds, theta in order; x are
hashed words and beginnings of words (by their share in the text), and the weights are kept sparse by an L1 step.
The expected severity is the sum over k of P(grade > k).

Labels that only say toxic or not are graded first: words that stand out in the toxic texts of one half of the sample make a
lexicon, and the toxic texts of the other half are ranked by the share of it in them, the upper half getting the next grade;
so no text is graded by a lexicon that it had a part in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, lean, pieces, prepared, texts
from .features import Sparse, bucket, counted, sampled, words_of

BITS = 18
MAX_LABELLED = 8192
PREFIXES = (4, 5, 6, 7, 8)


def featurise(part: list[bytes]) -> Sparse:
    """log(1 + share in hundredths) of hashed lower-case words and of their first 4 to 8 bytes, where a word is longer.

    30 words are added to the length, so that one word of a short text isn't taken for a dense one.
    """
    codes, distinct, starts = words_of(part, ALNUM)
    known: dict[bytes, int] = {}

    def of(w: bytes) -> int:
        if w not in known:
            known[w] = bucket(w, BITS, len(w))
        return known[w]

    lists = [[bucket(w, BITS), *[of(w[:k]) for k in PREFIXES if len(w) > k]] for w in distinct]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    every, first = np.array([f for x in lists for f in x], np.int64), np.cumsum(n) - n
    size = n[codes]
    ends = np.concatenate(([0], np.cumsum(size)))
    flat = np.repeat(first[codes] - ends[:-1], size) + np.arange(ends[-1])
    x = counted(flat, every, ends[starts], 1 << BITS)
    return Sparse(x.index, np.log1p(100 * x.value / (np.repeat(np.diff(starts), np.diff(x.starts)) + 30)), x.starts)


def grades(x: Sparse, toxic: np.ndarray, levels: int = 2) -> np.ndarray:
    """0 for clean texts, 1..levels for toxic ones by their share of words that stand out in toxic texts."""
    y = (toxic > 0).astype(np.int64)
    if not y.any() or y.all() or levels < 2:
        return y
    size, fold, out = 1 << BITS, np.arange(len(y)) % 2, y.copy()
    ones, much = Sparse(x.index, np.ones(len(x.index)), x.starts), Sparse(x.index, np.expm1(x.value), x.starts)
    for k in (0, 1):
        seen = [(y == c) & (fold != k) for c in (1, 0)]
        rate = [(ones.tdot(m.astype(float), size) + 0.5) / (m.sum() + 1) for m in seen]
        lexicon = (np.log(rate[0] / rate[1]) > 2) & (ones.tdot(seen[0].astype(float), size) >= 5)
        own = (y == 1) & (fold == k)
        if own.any():
            share = much.dot(lexicon.astype(float))[own]
            out[own] = 1 + np.searchsorted(np.quantile(share, np.arange(1, levels) / levels), share, "right")
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: Sparse) -> np.ndarray:
        """P(grade > k) for k = 0..K-1, a column each."""
        return _logistic(x.dot(self.weights)[:, None] - self.thresholds)

    @staticmethod
    def loss(x: Sparse, y: np.ndarray, params: np.ndarray, k: int) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood of grades y, and its gradient, for params: k weights, the first threshold, log gaps of the others."""
        n, rows = len(x), np.arange(len(x))
        theta = _thetas(params, k)
        below = np.concatenate((np.zeros((n, 1)), _logistic(theta - x.dot(params[:k])[:, None]), np.ones((n, 1))), 1)
        lo, hi = below[rows, y], below[rows, y + 1]
        p = np.maximum(hi - lo, 1e-12)
        dlo, dhi = lo * (1 - lo), hi * (1 - hi)
        gt = np.zeros(len(theta) + 2)
        np.add.at(gt, y + 1, -dhi / p / n)
        np.add.at(gt, y, dlo / p / n)
        tail = np.cumsum(gt[1:-1][::-1])[::-1]
        return float(-np.log(p).mean()), np.concatenate((x.tdot((dhi - dlo) / p / n, k), tail[:1], tail[1:] * np.exp(params[k + 1 :])))

    @classmethod
    def fit(cls, x: Sparse, y: np.ndarray, top: int, steps: int = 400, l1: float = 3e-4, rate: float = 0.1, patience: int = 20, least: float = 2e-3) -> CumulativeLink:
        """Full-batch proximal Adam on the negative log-likelihood of y in 0..top, until it falls by less than the share `least`
        in `patience` steps; no rows or one grade give no weights."""
        size, n = 1 << BITS, len(x)
        share = np.array([((y > k).sum() + 0.5) / (n + 1) for k in range(top)])
        first = -np.log(share / (1 - share))
        theta = np.maximum.accumulate(first + 1e-3 * np.arange(top))
        weights = np.zeros(size)
        if not n or y.min() == y.max():
            return cls(weights, theta)
        used = np.unique(x.index)
        own, k = Sparse(np.searchsorted(used, x.index), x.value, x.starts), len(used)
        params = np.concatenate((np.zeros(k), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))
        m, v, losses = np.zeros(k + top), np.zeros(k + top), []
        for t in range(1, steps + 1):
            loss, grad = cls.loss(own, y, params, k)
            losses.append(loss + l1 * float(np.abs(params[:k]).sum()))
            if t > patience and losses[-1 - patience] - losses[-1] < least * losses[-1 - patience]:
                break
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            params = params - scale * m / (1 - 0.9**t)
            shrink = np.minimum(scale[:k] * l1, 10.0)
            params[:k] = np.sign(params[:k]) * np.maximum(0, np.abs(params[:k]) - shrink)
        weights[used] = params[:k]
        return cls(weights, _thetas(params, k))


def _thetas(params: np.ndarray, k: int) -> np.ndarray:
    return params[k] + np.concatenate(([0.0], np.cumsum(np.exp(params[k + 1 :]))))


def toxicity(docs: DataFrame, labels: DataFrame, levels: int = 2, max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, expected_severity, p_toxic, severity, toxic.

    labels: (doc_id, toxic); values over 1 are taken as grades, else grades 1..levels are derived (see grades). At most
    max_labelled labelled documents, by a hash of the id, fit the model, which the driver sends to the executors.
    severity: the likeliest grade by the thresholds passed at even odds; toxic: P(grade > 0) >= threshold. Without
    labels nothing is toxic. Null text is empty; rows that repeat a doc_id are given as often as they come, a null
    doc_id stays null; other columns are ignored; no rows give none.
    """
    spark = prepared(docs.sparkSession)
    x, y = sampled(docs, labels, ["toxic"], max_labelled, featurise)
    given = np.maximum(0, y["toxic"].astype(np.int64))
    y_ = given if len(given) and given.max() > 1 else grades(x, given, levels)
    model = CumulativeLink.fit(x, y_, max(1, int(y_.max()) if len(y_) else 1))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            above = sent.value.above(featurise(texts(part)))
            cols = [np.round(above.sum(1), 6), np.round(above[:, 0], 6), (above >= 0.5).sum(1).astype(np.int64), above[:, 0] >= threshold]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, cols)], ["doc_id", "expected_severity", "p_toxic", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, expected_severity double, p_toxic double, severity long, toxic boolean")
