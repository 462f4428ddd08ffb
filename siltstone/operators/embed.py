"""Models as batch functions: a model is loaded once for a Python worker and sees Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import dense as D

Encode = Callable[[list[str]], list]
Score = Callable[[list[str], list[str]], list]


class Store(Protocol):
    """Where vectors are kept: rows (id, vector, any others) by id, and the nearest of them."""

    def upsert(self, rows: DataFrame) -> None:
        """Rows take the place of those with the same id."""

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query_id, id, dense_score, dense_rank) of the `limit` nearest vectors of each of (query_id, vector)."""


class TableStore:
    """A Store in a folder of Parquet files, a version for each upsert; readers see the last one that was written whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "id long, vector array<float>") -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, version long").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schema}, version long")

    def _last(self) -> int:
        return self._versions().agg(F.max("version")).first()[0] or 0

    def rows(self) -> DataFrame:
        return self._versions().where(F.col("version") == self._last()).drop("version")

    def upsert(self, rows: DataFrame) -> None:
        """Rows without id are left out; of rows with one id in one call, the one with the smallest vector stays."""
        own = self.rows()
        batch = rows.where("id is not null").select(*own.columns)
        one = batch.groupBy("id").agg(F.min(F.struct("vector", *[c for c in own.columns if c not in ("id", "vector")])).alias("r")).select("id", "r.*").select(*own.columns)
        own.join(one.select("id"), "id", "left_anti").unionByName(one).write.parquet(f"{self.path}/version={self._last() + 1}")

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        return D.dense_topk(self.rows().select("id", "vector"), queries, limit)


def embedder(load: Callable[[], Encode]) -> Callable[[Column], Column]:
    """A Column function from text to array<float>; load() gives a function from texts to vectors. Null text is empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series([np.asarray(v, np.float32) for v in encode(texts.fillna("").tolist())])

    return run


def pair_scorer(load: Callable[[], Score]) -> Callable[[Column, Column], Column]:
    """A Column function from (question, text) to double, for re-ranking; null where load() gives None."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for questions, texts in batches:
            if score is None:
                yield pd.Series(np.full(len(texts), None), dtype="Float64")
                continue
            yield pd.Series(np.asarray(score(questions.fillna("").tolist(), texts.fillna("").tolist()), np.float64))

    return run


def sentence_model(name: str, local_only: bool = True) -> Callable[[], Encode]:
    """Unit vectors of a sentence-transformers model, where that library is installed on the executors."""

    def load() -> Encode:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, local_files_only=local_only)
        return lambda texts: model.encode(texts, normalize_embeddings=True, show_progress_bar=False)

    return load


def pair_model(name: str, local_only: bool = True, device: str = "cpu") -> Callable[[], Score | None]:
    """Scores of a cross-encoder of the sentence-transformers library; None where it can't be loaded, and ranks stay as they are."""

    def load() -> Score | None:
        try:
            from sentence_transformers import CrossEncoder

            model = CrossEncoder(name, local_files_only=local_only, device=device)
        except Exception:  # whatever keeps a model from being there, search goes on without it
            return None
        return lambda questions, texts: model.predict(list(zip(questions, texts, strict=True)), show_progress_bar=False)

    return load


def hashed_letters(width: int = 32) -> Callable[[], Encode]:
    """A stand-in that needs no model: counts of letter pairs by their code points, of length one."""

    def load() -> Encode:
        def encode(texts: list[str]) -> list[np.ndarray]:
            out = []
            for t in texts:
                x = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64)
                v = np.bincount((x[:-1] * 31 + x[1:]) % width, minlength=width).astype(np.float64) if len(x) > 1 else np.zeros(width)
                out.append(v / max(1e-12, np.linalg.norm(v)))
            return out

        return encode

    return load
