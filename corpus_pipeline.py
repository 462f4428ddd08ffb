"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, line_dedup, quality, sentencepiece_codec, simhash_dedup
from siltstone.llm.common import fresh, settled


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, text_hash): a row is told by both, so that no other text of an id, or row without one, goes or stays with it."""
    mark = fresh(docs.columns)
    keys = gone.select(F.col("doc_id").alias(f"{mark}id"), F.col("text_hash").alias(f"{mark}hash")).distinct()
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}id")) & (own == F.col(f"{mark}hash")), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mark = fresh(docs.columns)
    return quality.classified(docs, labels, docs.columns, mark=mark).where(f"{mark}keep").select(*docs.columns)


def line_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; a document that had words goes if no line of it is left."""
    rows = line_dedup.line_dedup(docs).where("n_kept > n_kept_blank or n_lines = n_kept_blank")
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; of a group without ids, the one of the smallest hash of its text."""
    return _without(docs, simhash_dedup.simhash_groups(docs).where("not first"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contamination(docs, benchmark).where("contaminated"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the round trip and the parity checked."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_near_dedup", line_near_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Models and XXH64 are beyond DuckDB's SQL; the tests compare with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, name)
    return docs
