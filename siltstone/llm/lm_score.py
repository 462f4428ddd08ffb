"""Documents scored by a masked pseudo-likelihood.

A token is hidden and predicted from the two tokens on either side: position-wise embeddings are summed, squashed, and
go into a two-level softmax (class of the token, token within the class). The score of a document is the sum of the log
probability of each of its tokens given both sides.

The network's vocabulary is the corpus's most frequent words, counted over all documents; it grows with the root of the
number of tokens. Other words share hashed buckets for the network, and each is told from the others of its bucket by its
share of the bucket's count in the whole corpus, so that every word has a probability of its own. Every partition trains
the same first network on all of its own tokens, and the networks' weighted sums, added up block by block, give their average.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, coded, lean, pieces, prepared, settled, texts

CLASSES, WITHIN, HIDDEN = 32, 32, 16
#: The least vocabulary.
VOCABULARY = CLASSES * WITHIN
BUCKETS = 64
#: Counts of so many of the words in buckets are sent to the workers, by 64-bit hashes of the words; those of all the others are joined.
FREQUENT = 1 << 19
SIDES = (-2, -1, 1, 2)
CHUNK = 16384
BLOCK = 4096


def side_of(total: int) -> int:
    """Classes of the network, and words of a class, for a corpus of so many tokens."""
    return max(CLASSES, math.isqrt(math.isqrt(total) // 5))


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


@dataclass
class Network:
    """Embeddings for each side (one row more for what lies outside the text), and the two softmax layers."""

    embed: np.ndarray  # sides, vocabulary + 1, hidden
    top: np.ndarray  # hidden + 1, classes
    low: np.ndarray  # classes, hidden + 1, within

    @classmethod
    def first(cls, counts: np.ndarray | None = None) -> Network:
        """Small random embeddings, and biases that give each token its share of the corpus."""
        r = np.random.default_rng(11)
        side = CLASSES if counts is None else math.isqrt(len(counts))
        net = cls((r.standard_normal((len(SIDES), side * side + 1, HIDDEN)) * 0.3).astype(np.float32), np.zeros((HIDDEN + 1, side), np.float32), np.zeros((side, HIDDEN + 1, side), np.float32))
        if counts is not None:
            own = np.asarray(counts, np.float64).reshape(side, side) + 1
            net.top[-1] = np.log(own.sum(1) / own.sum())
            net.low[:, -1, :] = np.log(own / own.sum(1, keepdims=True))
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate((self.embed.ravel(), self.top.ravel(), self.low.ravel()))

    @classmethod
    def of(cls, flat: np.ndarray, side: int = CLASSES) -> Network:
        a = len(SIDES) * (side * side + 1) * HIDDEN
        b = a + (HIDDEN + 1) * side
        flat = flat.astype(np.float32)
        return cls(flat[:a].reshape(len(SIDES), side * side + 1, HIDDEN), flat[a:b].reshape(HIDDEN + 1, side), flat[b:].reshape(side, HIDDEN + 1, side))

    @property
    def side(self) -> int:
        return self.top.shape[1]

    def _by_class(self, tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Order of tokens by class, and the rows of each class that occurs in it."""
        c = (tokens // self.side).astype(np.int16)
        edges = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=self.side)))).tolist()
        return np.argsort(c, kind="stable"), [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.take(self.embed[0], context[0], axis=0)
        for k in range(1, len(SIDES)):
            h += np.take(self.embed[k], context[k], axis=0)
        return np.concatenate((np.tanh(h), np.ones((len(h), 1), np.float32)), 1)

    def pass_(self, tokens: np.ndarray, context: np.ndarray, learn: bool = False):
        """log P of each token given its context (sides, n); with `learn` also the gradient of their mean."""
        n = len(tokens)
        h = self.hidden(context)
        order, classes = self._by_class(tokens)
        top = h @ self.top
        top -= top.max(1, keepdims=True)
        rows, cls_ = np.arange(n), tokens // self.side
        log_p = top[rows, cls_]
        p_top = np.exp(top, out=top)
        z = p_top.sum(1)
        log_p -= np.log(z)
        own, low = h[order], np.empty((n, self.side), np.float32)
        for c, at in classes:
            np.matmul(own[at], self.low[c], out=low[at])
        low -= low.max(1, keepdims=True)
        word = (tokens % self.side)[order]
        picked = low[rows, word]
        p_low = np.exp(low, out=low)
        z_low = p_low.sum(1)
        log_p[order] += picked - np.log(z_low)
        if not learn:
            return log_p
        p_top /= z[:, None]
        p_top[rows, cls_] -= 1
        p_low /= z_low[:, None]
        p_low[rows, word] -= 1
        g_low, back = np.zeros_like(self.low), np.empty_like(own)
        for c, at in classes:
            np.matmul(own[at].T, p_low[at], out=g_low[c])
            np.matmul(p_low[at], self.low[c].T, out=back[at])
        g_low /= n
        d = p_top @ self.top.T
        d[order] += back
        d = (d * (1 - h * h))[:, :-1] / n
        g_embed = np.zeros_like(self.embed)
        for k in range(len(SIDES)):
            by = np.argsort(context[k].astype(np.uint16 if self.side < 256 else np.int32), kind="stable")
            ids = context[k][by]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            g_embed[k][ids[first]] = np.add.reduceat(np.take(d, by, axis=0), first, axis=0)
        return log_p, Network(g_embed, (h.T @ p_top) / n, g_low)


def contexts(tokens: np.ndarray, starts: np.ndarray, outside: int = VOCABULARY) -> np.ndarray:
    """For each token those at SIDES, `outside` where that is outside the document."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pad = max(map(abs, SIDES))
    at = np.arange(pad, len(tokens) + pad) + doc * pad
    padded = np.full(len(tokens) + pad * (len(starts) + 1), outside, np.int64)
    padded[at] = tokens
    return np.stack([padded[at + side] for side in SIDES])


def tokenised(part: list[bytes], ids: dict[bytes, int], other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ids of all tokens in a row, where each text starts, and the tokens as codes of the distinct words."""
    codes, distinct, starts = coded([t.translate(ALNUM).split() for t in part])
    known = np.fromiter((i if (i := ids.get(w)) is not None else other[bucket(w)] for w in distinct), np.int64, len(distinct))
    return known[codes] if len(codes) else np.zeros(0, np.int64), starts, codes, distinct


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for part in pieces(batches, "text"):
            codes, distinct, _ = coded([t.translate(ALNUM).split() for t in texts(part)])
            for w, n in zip(distinct, np.bincount(codes, minlength=len(distinct)).tolist(), strict=True):
                seen[w] += n
            if len(seen) > 400_000:  # bounds the worker, not the counts
                yield give()
                seen.clear()
        yield give()

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settled(counts, "words")


def vocabulary(counts: DataFrame) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the most frequent words, ids of the buckets, how often each id occurs, and each bucket's count.

    Ids are dealt to the classes in turn, so that classes are about equally frequent.
    """
    held = np.zeros(BUCKETS, np.int64)
    for b, n in counts.groupBy((F.crc32("word") % BUCKETS).alias("b")).agg(F.sum("n")).collect():
        held[b] = n
    side = side_of(int(held.sum()))
    top = counts.orderBy(F.desc("n"), "word").limit(side * side - BUCKETS).collect()
    place = np.arange(side * side).reshape(side, side).T.ravel()  # place[id] = rank
    by_rank = np.argsort(place)
    ids = {bytes(w): int(by_rank[k + BUCKETS]) for k, (w, _) in enumerate(top)}
    other = by_rank[:BUCKETS]
    n = np.zeros(side * side)
    for w, k in top:
        n[ids[bytes(w)]] = k
        held[bucket(w)] -= k
    n[other] = held
    return ids, other, n, held


class Shares:
    """log P of a word given its bucket, by the word's hash, in 16 bytes a word."""

    def __init__(self, words: list[bytes], share: np.ndarray) -> None:
        mark = self.marks(words)
        by = np.argsort(mark)
        self.mark, self.share = mark[by], share[by]

    @staticmethod
    def marks(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        """NaN for words that are not among them."""
        if not len(self.mark):
            return np.full(len(words), np.nan)
        mark = self.marks(words)
        at = np.minimum(np.searchsorted(self.mark, mark), len(self.mark) - 1)
        return np.where(self.mark[at] == mark, self.share[at], np.nan)


def shares(counts: DataFrame, ids: dict[bytes, int], held: np.ndarray, frequent: int) -> tuple[Shares, DataFrame]:
    """log P of a word given its bucket: those of up to `frequent` words, and (word, share) of all the rarer ones."""
    above, least = 0, None
    for n, words in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        above += words
        if above > frequent + len(ids):
            break
        least = n
    often = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    log = np.log(np.maximum(held, 1))
    table = often.toArrow()
    every = [(w, n) for w, n in zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True) if w not in ids]
    words = [w for w, _ in every]
    sent = Shares(words, np.log(np.fromiter((n for _, n in every), np.float64, len(every))) - log[np.fromiter(map(bucket, words), np.int64, len(words))])
    rest = counts if least is None else counts.where(F.col("n") < least)
    by_bucket = F.array(*[F.lit(float(x)) for x in log])
    return sent, rest.select("word", (F.log("n") - F.get(by_bucket, (F.crc32("word") % BUCKETS).cast("int"))).alias("share"))


def train(docs: DataFrame, ids: dict[bytes, int], other: np.ndarray, first: Network, rate: float = 0.1) -> Network:
    """The average, by tokens, of the networks that the partitions get in one pass of Adagrad over all their tokens."""
    side = first.side
    sent = docs.sparkSession.sparkContext.broadcast((ids, other, first.flat()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, other_, flat = sent.value
        flat = flat.copy()
        net, past, done = Network.of(flat, side), np.full(len(flat), 1e-8, np.float32), 0
        for part in pieces(batches, "text"):
            tokens, starts, *_ = tokenised(texts(part), ids_, other_)
            around = contexts(tokens, starts, side * side)
            for k in range(0, len(tokens), CHUNK):
                _, g = net.pass_(tokens[k : k + CHUNK], around[:, k : k + CHUNK], True)
                g = g.flat()
                past += g * g
                flat = flat - rate * g / np.sqrt(past)
                net = Network.of(flat, side)
            done += len(tokens)
        if done:
            blocks = [flat[k : k + BLOCK].astype("<f4").tobytes() for k in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(blocks, pa.binary()), pa.array(np.full(len(blocks), float(done)))], ["k", "v", "n"])

    def mean(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        total = sum(np.frombuffer(v, "<f4") * w for v, w in zip(table.column("v").to_pylist(), n, strict=True))
        return pa.table({"k": table.column("k")[:1], "v": pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())})

    nets = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "k int, v binary, n double")
    means = nets.groupBy("k").applyInArrow(mean, "k int, v binary").toArrow().sort_by("k").column("v").to_pylist()
    return Network.of(np.frombuffer(b"".join(means), "<f4"), side) if means else first


def pseudo_likelihood(docs: DataFrame, rate: float = 0.1, frequent: int = FREQUENT) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_tokens, log_likelihood, per_token.

    The network is trained, and words are counted, on all documents of the table. Null or empty texts have no tokens,
    likelihood 0, and null per_token. Rows that repeat a doc_id are scored (and trained on) as often as they come, a null
    doc_id stays null; other columns are ignored; no rows give none. `frequent` only says which counts are sent to the
    workers and which are joined, the scores are the same.
    """
    spark = prepared(docs.sparkSession)
    counts = word_counts(docs)
    ids, other, n, held = vocabulary(counts)
    net = train(docs, ids, other, Network.first(n), rate)
    often, rest = shares(counts, ids, held, frequent)
    side = net.side
    sent = spark.sparkContext.broadcast((ids, other, often, net.flat()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, other_, often_, flat = sent.value
        net_ = Network.of(flat, side)
        key = TaskContext.get().partitionId() << 40
        for part in pieces(batches, "text"):
            tokens, starts, codes, distinct = tokenised(texts(part), ids_, other_)
            around = contexts(tokens, starts, side * side)
            log_p = np.concatenate([*[net_.pass_(tokens[k : k + CHUNK], around[:, k : k + CHUNK]) for k in range(0, len(tokens), CHUNK)], np.zeros(0)])
            share = np.where(np.fromiter((w in ids_ for w in distinct), bool, len(distinct)), 0.0, often_.of(distinct))
            rare = np.isnan(share)
            at = np.flatnonzero(rare[codes])
            log_p += np.where(rare, 0, share)[codes]
            total = np.concatenate(([0.0], np.cumsum(log_p, dtype=np.float64)))
            doc = np.searchsorted(starts, at, "right") - 1
            pairs, times = np.unique(doc << 32 | codes[at], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(starts)) << 32).astype(np.int32)
            words = pa.array(distinct, pa.binary()).take(pa.array(pairs & 0xFFFFFFFF))
            rows = len(starts) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key, key + rows)), part.column("doc_id"), pa.array(np.diff(starts).astype(np.int64)), pa.array(total[starts[1:]] - total[starts[:-1]]),
                    pa.ListArray.from_arrays(pa.array(ends), words), pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                ],
                ["key", "doc_id", "n_tokens", "score", "words", "times"],
            )
            key += rows

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "key long, doc_id long, n_tokens long, score double, words array<binary>, times array<int>")
    made = settled(made, "scores")
    each = made.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    more = each.join(rest.hint("shuffle_hash"), "word").groupBy("key").agg(F.sum(F.col("times") * F.col("share")).alias("more"))
    score = F.col("score") + F.coalesce("more", F.lit(0.0))
    per_token = F.when(F.col("n_tokens") > 0, F.round(score / F.col("n_tokens"), 6))
    return made.select("key", "doc_id", "n_tokens", "score").join(more, "key", "left").select("doc_id", "n_tokens", F.round(score, 4).alias("log_likelihood"), per_token.alias("per_token"))
