"""Hashed sparse features of texts, and the bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, coded, lean, pieces, prepared, texts


@dataclass
class Sparse:
    """Rows of (index, value) lists: starts has one more entry than rows."""

    index: np.ndarray
    value: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.index] * self.value, dtype=np.float64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def tdot(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(g, np.diff(self.starts)) * self.value, size)


def counted(codes: np.ndarray, features: np.ndarray, starts: np.ndarray, size: int) -> Sparse:
    """How often each document has each feature; features: that of each word code, -1 for none."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    f = features[codes]
    use = f >= 0
    key, n = np.unique(doc[use] * size + f[use], return_counts=True)
    return Sparse(key % size, n.astype(np.float64), np.searchsorted(key // size, np.arange(len(starts))))


def bucket(word: bytes, bits: int, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(word, seed) >> (64 - bits)


def sampled(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, featurise: Callable[[list[bytes]], Sparse]) -> tuple[Sparse, dict[str, np.ndarray]]:
    """Features and labels of at most `most` labelled documents, those first in the order of a hash of doc_id.

    labels: (doc_id, *columns); rows with a null are left out, one row of each doc_id is taken (the smallest values).
    The sample's ids are broadcast: `most` rows.
    """
    prepared(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns]).dropna()
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("y")).select("doc_id", "y.*")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            x = featurise(texts(part))
            cut = pa.array(x.starts.astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (x.index.astype(np.int32), x.value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(c) for c in columns], *lists], ["doc_id", *columns, "index", "value"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    with_text = text.join(F.broadcast(chosen), "doc_id").select("doc_id", *columns, "text")
    schema = ", ".join(["doc_id long", *[f"{c} int" for c in columns], "index array<int>", "value array<float>"])
    table = with_text.mapInArrow(lean(run), schema).toArrow().sort_by("doc_id").combine_chunks()
    index, value = (table.column(c).combine_chunks() for c in ("index", "value"))
    starts = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(index).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return Sparse(index.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64), starts), {c: table.column(c).to_numpy() for c in columns}


def words_of(part: list[bytes], table: bytes = LOWER) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    return coded([t.translate(table).split() for t in part])
