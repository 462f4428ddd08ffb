"""Exact dense search and the vector table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are sent to the executors at once; more are joined with the vectors, group by group.
SENT = 64 << 20
#: Bytes of vectors, and of queries, in a row of that join.
PACKED = 8 << 20
#: Vectors that are multiplied at once, and the queries that they are multiplied with: a worker's tables of scores have no more cells,
#: whatever the number of queries.
STEP, ASKED = 2048, 128
#: Scores are rounded to so many digits, so that ties don't depend on the order of sums.
DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of doubles; 0 where either is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists that all have `dim` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Best:
    """The k best vectors of each query among those seen so far; ties go by id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, queries, k
        self.i, self.s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for lo in range(0, len(ids), STEP):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for a in range(0, len(self.ids), ASKED):
                own, new, best = ids[lo : lo + STEP], np.round(self.q[a : a + ASKED] @ vectors[lo : lo + STEP].T, DIGITS), self.s[a : a + ASKED]
                if best.shape[1] == self.k > 0:  # vectors that are below every query's last place can't come in
                    near = (~(new < best[:, -1:])).any(0)
                    own, new = own[near], new[:, near]
                s = np.concatenate((best, new), 1)
                i = np.concatenate((self.i[a : a + ASKED], np.broadcast_to(own, (len(s), len(own)))), 1)
                by = np.lexsort((i, -s), axis=1)[:, : self.k]
                held.append((np.take_along_axis(i, by, 1), np.take_along_axis(s, by, 1)))
            self.i, self.s = (np.concatenate(x) for x in zip(*held, strict=True))

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = self.i.shape[1]
        if n and len(self.ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(self.i.ravel()), pa.array(self.s.ravel())], ["query_id", "id", "dense_score"])


_HITS = "query_id long, id long, dense_score double"


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, sent: int = SENT, packed: int = PACKED) -> DataFrame:
    """(query_id, id, dense_score, dense_rank): the k vectors of (id, vector) of largest cosine for each of (query_id, vector).

    The vectors are read once, whatever the number of queries. Up to `sent` bytes of queries go to all executors; more are
    packed in groups, which are joined with packed vectors. Every task keeps its own k best for each query, and only
    those are shuffled. Scores are rounded to DIGITS digits, ties go by id. Rows with null ids or vectors, and vectors of another
    length than that of most queries (the longest of those), are left out.
    """
    asked = queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    rows = vectors.where("id is not null and vector is not null").select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))
    sizes = asked.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
    asked, rows = (d.where(F.size("vector") == dim) for d in (asked, rows))
    found = _sent(rows, asked, k, dim) if n * max(1, dim) * 8 <= sent else _grouped(rows, asked, k, dim, n, packed)
    w = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "id")
    return found.withColumn("dense_rank", F.row_number().over(w)).where(F.col("dense_rank") <= k)


def _sent(rows: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    table = asked.toArrow().combine_chunks()  # of a size that the caller has checked
    ids = table.column("query_id").to_numpy()
    given = rows.sparkSession.sparkContext.broadcast((ids, _unit(_matrix(table.column("vector").combine_chunks(), dim)) if len(ids) else np.zeros((0, dim))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*given.value, k)
        for b in batches:
            if b.num_rows and len(best.ids):
                best.see(b.column("id").to_numpy(), _unit(_matrix(b.column("vector"), dim)))
        yield from best.rows()

    return rows.mapInArrow(run, _HITS)


def _grouped(rows: DataFrame, asked: DataFrame, k: int, dim: int, n: int, packed: int) -> DataFrame:
    """Groups of queries joined with packs of vectors; a task keeps the best of a group over all its packs."""
    groups, salts = -(-n * dim * 8 // packed), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(ids: np.ndarray, matrix: np.ndarray) -> list[bytes]:
        return [ids.astype("<i8").tobytes(), _unit(matrix).tobytes()]

    def packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, packed // (8 * dim))
        for b in batches:
            for lo in range(0, b.num_rows, most):
                part = b.slice(lo, most)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in pack(part.column("id").to_numpy(), _matrix(part.column("vector"), dim))], ["ids", "vectors"])

    def group(table: pa.Table) -> pa.Table:
        made = pack(table.column("query_id").to_numpy(), _matrix(table.column("vector").combine_chunks(), dim))
        return pa.table({"g": table.column("g")[:1], **{c: pa.array([x], pa.binary()) for c, x in zip(("asked", "queries"), made, strict=True)}})

    own = asked.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).groupBy("g").applyInArrow(group, "g int, asked binary, queries binary")
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = rows.mapInArrow(packs, "ids binary, vectors binary").select("ids", "vectors", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    pairs = every.hint("merge").join(own, ["g", "salt"]).sortWithinPartitions("g")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None
        read = lambda x, kind: np.frombuffer(x, kind)
        for b in batches:
            for row in range(b.num_rows):
                g, ids, vectors, own_ids, own_vectors = (b.column(c)[row].as_py() for c in ("g", "ids", "vectors", "asked", "queries"))
                if g != at:
                    if best is not None:
                        yield from best.rows()
                    best, at = _Best(read(own_ids, "<i8"), read(own_vectors, np.float64).reshape(-1, dim), k), g
                best.see(read(ids, "<i8"), read(vectors, np.float64).reshape(-1, dim))
        if best is not None:
            yield from best.rows()

    return pairs.select("g", "ids", "vectors", "asked", "queries").mapInArrow(run, _HITS)


def upsert(base: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """base with the rows of batch in place of those with the same key; the last of the batch by `order` wins."""
    last = batch.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def keyword_vector(tokens: Column, text: Column, table: tuple[tuple[str, ...], ...], percent_at: int | None = None) -> Column:
    """1.0 for each entry of the table of which a token occurs, in place of a model; one entry also by a `%` in the text."""
    flags = [F.arrays_overlap(tokens, F.array(*map(F.lit, words))) for words in table]
    if percent_at is not None:
        flags[percent_at] = flags[percent_at] | F.contains(text, F.lit("%"))
    return F.array(*[f.cast("double") for f in flags])
