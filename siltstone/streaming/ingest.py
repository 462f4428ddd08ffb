"""Documents that arrive as files become chunks in a table, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import text as T
from siltstone.operators import chunking as C


def newest(docs: DataFrame, version: str | None = None) -> DataFrame:
    """The row of each doc_id with the largest version (null is the smallest); ties, and rows without such a column, go by the
    text, the smallest first. Rows without doc_id are documents of their own, and all stay."""
    order = [*([F.col(version).desc_nulls_last()] if version else []), F.col("text").asc_nulls_last()]
    return C.first_wins(docs, ["doc_id"], order)


def chunks_of(docs: DataFrame, size: int = 420, overlap: int = 60, version: str | None = None) -> DataFrame:
    """(doc_id, start, n, chunk_id, text) of the newest row of each document; one without words has a row with null start."""
    own = newest(docs, version).select("doc_id", "text")
    w = C.token_windows(own, size, overlap)
    key = F.concat_ws(":", F.col("start").cast("string"), "text")
    chunks = w.select("doc_id", "start", "n", T.content_id(F.col("doc_id").cast("string"), F.lit("1"), F.lit("paragraph"), key).alias("chunk_id"), "text")
    bare = own.where(F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)) <= 0).select("doc_id", F.lit(None).cast("int").alias("start"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("text"))
    return chunks.unionByName(bare)


def ingest(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, version: str | None = None) -> StreamingQuery:
    """Each batch of new Parquet files is chunked into a folder of its own, so that a batch run twice is written once.

    Reading takes the newest chunks of each document: see current(). version: the column that orders rows of a document inside
    a batch, see newest().
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks_of(batch, version=version).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """Chunks of the last batch that brought each document; those of rows without doc_id are of all batches."""
    rows = spark.read.parquet(table)
    last = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"]).unionByName(rows.where("doc_id is null").select("doc_id", "batch", *[c for c in rows.columns if c not in ("doc_id", "batch")])).where("start is not null")


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of (ts, event_type, value) for each window of event time, late rows let in up to a bound."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
