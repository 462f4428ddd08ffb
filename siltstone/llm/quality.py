"""A quality classifier by hierarchical empirical Bayes.

A logistic regression on hashed words and word shapes gives each document its own evidence. Grouped sums of that over
all documents give a posterior for each host, shrunk to the corpus, and for each path of a host, shrunk to the host;
the strength of each prior is estimated from how far the groups differ. A document's log-odds are its own, moved by those
of its path against those of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, lean, pieces, prepared, settled, texts
from .features import Sparse, bucket, counted, sampled, words_of

BITS = 15
#: Labelled documents that the classifier is fitted on at most.
MAX_LABELLED = 8192
_SHAPE = bytes(b"a"[0] if 97 <= c <= 122 or c >= 128 else b"9"[0] if 48 <= c <= 57 else c for c in range(256))
#: Sums of probabilities are kept in millionths, so that they don't depend on the order of rows.
UNIT = 1_000_000


def shape(word: bytes) -> bytes:
    """The word with runs of letters and of digits as one a or 9."""
    out = word.translate(_SHAPE)
    while b"aa" in out:
        out = out.replace(b"aa", b"a")
    while b"99" in out:
        out = out.replace(b"99", b"9")
    return out


def featurise(part: list[bytes]) -> Sparse:
    """Square roots of the shares of hashed words and shapes, words in the lower half of the buckets, shapes above, and how repetitive the text is."""
    codes, distinct, starts = words_of(part, LOWER)
    half, n = 1 << (BITS - 1), np.maximum(1, np.diff(starts))
    shapes: dict[bytes, int] = {}
    of_shape = np.empty(len(distinct), np.int64)
    for k, w in enumerate(distinct):
        s = shape(w)
        if s not in shapes:
            shapes[s] = half + bucket(s, BITS - 1, 1)
        of_shape[k] = shapes[s]
    word = counted(codes, np.fromiter((bucket(w, BITS - 1) for w in distinct), np.int64, len(distinct)), starts, 1 << BITS)
    form = counted(codes, of_shape, starts, 1 << BITS)
    most = np.array([word.value[a:b].max(initial=0) for a, b in zip(word.starts[:-1], word.starts[1:], strict=True)]) / n
    again = np.append(codes[1:] == codes[:-1], False) if len(codes) else np.zeros(0, bool)
    again[starts[1:][starts[1:] > 0] - 1] = False  # the last word of a document has no next one
    twice = np.diff(np.concatenate(([0], np.cumsum(again)))[starts]) / n
    bins = np.stack([bucket(b"\0", BITS - 1, 2 + k) // 32 * 32 + np.minimum(9, (v * 10).astype(np.int64)) + half for k, v in enumerate((most, twice))], 1)
    rows = np.concatenate([*[np.repeat(np.arange(len(n)), np.diff(x.starts)) for x in (word, form)], np.repeat(np.arange(len(n)), 2)])
    by = np.argsort(rows, kind="stable")
    index = np.concatenate((word.index, form.index, bins.ravel()))[by]
    value = np.concatenate((np.sqrt(word.value / n[rows[: len(word.index)]]), np.sqrt(form.value / np.repeat(n, np.diff(form.starts))), np.ones(bins.size)))[by]
    return Sparse(index, value, word.starts + form.starts + 2 * np.arange(len(n) + 1))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def log_odds(self, x: Sparse) -> np.ndarray:
        return np.clip(x.dot(self.weights) + self.bias, -30, 30)

    @classmethod
    def fit(cls, x: Sparse, y: np.ndarray, steps: int = 300, l2: float = 3e-5, rate: float = 0.2) -> Logistic:
        """Full-batch Adam; no rows or one class give the smoothed log-odds of the class alone."""
        size, n = 1 << BITS, len(x)
        prior = (y.sum() + 1) / (n + 2)
        w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
        if not n or y.min() == y.max():
            return cls(w, bias)
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        for t in range(1, steps + 1):
            g = (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - y) / n
            grad = np.append(x.tdot(g, size) + l2 * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, bias = w - step[:-1], bias - float(step[-1])
        return cls(w, bias)


def site(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path of a document. A source is host/path; one without a path has a path for each language. Null: empty."""
    whole = F.coalesce(source.cast("string"), F.lit(""))
    host = F.split_part(whole, F.lit("/"), F.lit(1))
    rest = F.substring(whole, F.length(host) + 2, F.length(whole))
    return host, F.when(rest != "", rest).otherwise(F.concat(F.lit("lang="), F.coalesce(lang.cast("string"), F.lit(""))))


def evidence(docs: DataFrame, model: Logistic, carry: list[str], name: str = "own") -> DataFrame:
    """The carried columns of docs and, by the name given, the log-odds of the text alone."""
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            own = sent.value.log_odds(featurise(texts(part)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(own, pa.float64())], [*carry, name])

    source = docs.select(*dict.fromkeys([*carry, "text"]))
    return source.mapInArrow(lean(run), StructType([*source.select(*carry).schema.fields, StructField(name, DoubleType())]))


def posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, mean) for rows (host, path, p), and the corpus mean. Beta priors by the method of moments."""
    path = settled(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(F.col("p") * UNIT).cast("long")).alias("s")), "paths")
    host = path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = path.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (total["s"] / UNIT + 1) / (total["n"] + 2) if total["n"] else 0.5

    def strength(groups: DataFrame, n: str, s: str, centre: Column) -> float:
        """Observations that the prior counts for: mean (1 - mean) / variance between groups - 1, noise taken off."""
        share, c = F.col(s) / F.col(n) / UNIT, mean * (1 - mean)
        row = groups.agg(F.sum(F.col(n) * F.pow(share - centre, 2)).alias("v"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
        between = ((row["v"] or 0) - (row["k"] or 0) * c) / row["n"] if row["n"] else 0
        return float(np.clip(c / between - 1, 1, 1e6)) if between > 0 else 1e6

    by_host = strength(host, "hn", "hs", F.lit(mean))
    prior = ((F.col("hs") / UNIT + F.lit(by_host * mean)) / (F.col("hn") + F.lit(by_host))).alias("hm")
    both = path.join(host.select("host", prior), "host")
    by_path = strength(both, "n", "s", F.col("hm"))
    means = both.select("host", "path", ((F.col("s") / UNIT + F.lit(by_path) * F.col("hm")) / (F.col("n") + F.lit(by_path))).alias("mean"))
    return settled(means, "posteriors"), mean


def classified(docs: DataFrame, labels: DataFrame, carry: list[str], max_labelled: int = MAX_LABELLED, threshold: float = 0.5, mark: str = "__") -> DataFrame:
    """The carried columns of each row of docs (doc_id, text, source, lang), and host, path, own, p and keep (p >= threshold).

    mark is put in front of the names of the last five; no column of docs may begin with it. labels: (doc_id, quality
    0/1); at most max_labelled of them, by a hash of the id, fit the text classifier; with no labels the evidence is even
    and every document stays. A p at the threshold keeps its document. Null text is empty, null sources and languages are groups of
    their own; repeated rows count as often as they come; no rows give none.
    """
    x, y = sampled(docs, labels, ["quality"], max_labelled, featurise)
    model = Logistic.fit(x, (y["quality"] > 0).astype(np.float64))
    own, host_, path_ = (F.col(f"{mark}{c}") for c in ("own", "host", "path"))
    host, path = site(F.col("source"), F.col("lang"))
    given = docs.select(*dict.fromkeys([*carry, "text"]), host.alias(f"{mark}host"), path.alias(f"{mark}path"))
    every = settled(evidence(given, model, [*carry, f"{mark}host", f"{mark}path"], f"{mark}own"), "evidence")  # texts are read by the classifier once
    means, corpus = posteriors(every.select(host_.alias("host"), path_.alias("path"), (1 / (1 + F.exp(-own))).alias("p")))
    logit = lambda c: F.log(c / (1 - c))
    shift = means.select(F.col("host").alias(f"{mark}host"), F.col("path").alias(f"{mark}path"), (logit(F.least(F.greatest("mean", F.lit(1e-6)), F.lit(1 - 1e-6))) - F.lit(float(np.log(corpus / (1 - corpus))))).alias(f"{mark}shift"))
    final = 1 / (1 + F.exp(-(own + F.col(f"{mark}shift"))))
    return every.join(shift, [f"{mark}host", f"{mark}path"]).select(*carry, host_, path_, own, final.alias(f"{mark}p"), (final >= threshold).alias(f"{mark}keep"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, text_log_odds, p_quality, keep for each row of docs; see classified."""
    rows = classified(docs.select("doc_id", "text", "source", "lang"), labels, ["doc_id"], max_labelled, threshold)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__host").alias("host"), F.col("__path").alias("path"), F.round("__own", 6).alias("text_log_odds"), F.round("__p", 6).alias("p_quality"), F.col("__keep").alias("keep"))
