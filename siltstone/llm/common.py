"""What the operators share: the shared folder, bounded Arrow batches, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; no byte of a longer character is touched.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The same, and every ASCII byte but digits and letters becomes a space: words are runs of 0-9, a-z and non-ASCII.
ALNUM = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

ROWS_A_BATCH = 512
BYTES_A_BATCH = 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers get: texts may be long, and the default is 10,000 rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_A_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_A_BATCH))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, and no lost executor can take it away."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of small rows, removed when nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(columns: list[str]) -> str:
    """A beginning for names that none of the columns has (names are compared without regard to case)."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return mark


def joined_on_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """rows joined with groups (one row for each value of the keys, `size` rows of `rows` each) on the keys.

    Groups that hold over one of `share` of all rows are broadcast, as there can't be `share` of them; the rows of all
    others are shuffled. So no task gets the rows of a hot key. groups should be settled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > total // share)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= total // share), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes of the column (at least a row): small batches joined, large ones cut."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = taken = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(part, taken + most - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(part[hi - 1]) - taken
            if size >= most or hi < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
            taken, lo = int(part[hi - 1]), hi
    if held:
        yield pa.concat_batches(held)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, giving its memory back at its end: Spark keeps Python workers for the stages that follow."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each row, empty for null."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def coded(docs: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word codes of all documents in a row, the distinct words, and where each document starts (one more at the end)."""
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    words = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_pylist(), starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each document's values (rows of zeros for empty ones); starts as from coded()."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]
