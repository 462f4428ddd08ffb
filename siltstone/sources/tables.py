"""Readers and writers: chunk files, catalogs and reports, evaluation items and run history, raw pages, PDF pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.prepare import CHUNK

BLOCK = "doc_id string, file_name string, page int, block_type string, text string, rows array<array<string>>, block_ord bigint, error string, ocr boolean"
EVAL_ITEM = "id string, category string, query string, expected_top3 array<struct<candidate_answer:string,source_file:string,page:int>>"
HISTORY = "run_at string, eval_set string, model_name string, embedding_model string, run_name string, queries int, score double, hit_at_3 double, hit_at_10 double, mrr_at_3 double"


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out."""
    chunks.write.option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report or an aggregate of fixed size."""
    row.coalesce(1).write.json(path)


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items; expected answers stay an array, to be exploded."""
    return spark.read.schema(EVAL_ITEM).option("multiLine", "true").json(path)


def read_history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """Runs from a JSON array or from JSON lines; malformed lines are dropped; a missing path is empty. run_at becomes a timestamp."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("at", F.lit(None).cast("timestamp"))
    first = lines.where("trim(value) <> ''").first()
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    rows = reader.option("multiLine", str(bool(first) and first[0].lstrip().startswith("["))).json(path)
    return rows.withColumn("at", F.try_to_timestamp("run_at"))


def append_history(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Paragraph blocks from raw web pages (page_id, url, html): scripts, styles and tags taken off, empty pages left out."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?i)</?(?:p|div|br|li|h[1-6]|tr|table|section|article)\b[^>]*>", "\n")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"[ \t]+", " "), r"^\s+|\s+$", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("file_name"), F.lit(1).alias("page"), F.lit("paragraph").alias("block_type"), text.alias("text"), F.col("page_id").alias("block_ord")).where(F.col("text") != "")


def pdf_blocks(spark: SparkSession, folder: str, least_chars: int = 20, ocr=None) -> DataFrame:
    """BLOCK rows of every *.pdf in a folder: a page's text, then its tables; a file that fails gives one row with `error`.

    Needs pdfplumber on the executors. ocr(page) -> str is asked for pages without text and used from least_chars on; its
    blocks are marked. See tesseract_page for one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        names = [x.split(":")[0].split()[0] for x in BLOCK.replace("array<array<string>>", "x").split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                doc, rows = name.rsplit(".", 1)[0], []
                try:
                    import pdfplumber

                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        for number, page in enumerate(pdf.pages, 1):
                            text = (page.extract_text() or "").strip()
                            read = not text and ocr and len(seen := ocr(page).strip()) >= least_chars
                            text = seen if read else text
                            if text:
                                rows.append((doc, name, number, "paragraph", text, None, len(rows), None, bool(read)))
                            for table in page.extract_tables() or []:
                                cells = [r for r in ([(c or "").strip() for c in row] for row in table) if any(r)]
                                if cells:
                                    rows.append((doc, name, number, "table", "\n".join(" | ".join(r) for r in cells), cells, len(rows), None, False))
                except Exception as e:  # kept as a row, so that one bad file doesn't end the scan
                    rows = [(doc, name, None, None, None, None, None, f"{type(e).__name__}: {e}", None)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page": "Int32", "block_ord": "Int64", "ocr": "boolean"})

    return files.mapInPandas(run, BLOCK)


def tesseract_page(languages: str = "fra+eng", resolution: int = 200, seconds: float = 60):
    """An `ocr` for pdf_blocks: the page as an image, read by the tesseract program in a process of its own with a time limit.

    Empty where the program is missing, fails, or takes longer; its process is ended then.
    """

    def read(page) -> str:
        import io
        import subprocess

        image = io.BytesIO()
        page.to_image(resolution=resolution).original.save(image, "PNG")
        try:
            done = subprocess.run(["tesseract", "stdin", "stdout", "-l", languages], input=image.getvalue(), capture_output=True, timeout=seconds, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return ""
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""

    return read
