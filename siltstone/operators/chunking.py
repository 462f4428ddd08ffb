"""From blocks of text to chunks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T


def settled_columns(rows: DataFrame, /, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: filters and projections above read their values, not their expressions.

    The optimiser would write an expression out wherever it is used, which for long chains of text rules grows without
    measure; it does not look through a generator.
    """
    box = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.select(*[c for c in rows.columns if c not in columns], box.alias("__box")).select("*", "__box.*").drop("__box")


def stored(rows: DataFrame) -> DataFrame:
    """Rows that several steps read, worked out once: written to the folder of spark.checkpoint.dir, which all machines share, and read again.

    Without such a folder, where Spark runs in one process, a temporary one is taken.
    """
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    path = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, each: int = 3) -> DataFrame:
    """The same rows, dealt evenly over all cores, `each` tasks a core.

    For narrow tables from which long texts are made: they lie in so few files and row groups that most cores would stay idle.
    """
    return rows.repartition(each * max(1, rows.sparkSession.sparkContext.defaultParallelism))


def token_windows(docs: DataFrame, size: int = 420, overlap: int = 60) -> DataFrame:
    """(doc_id, start, n, total, text): overlapping windows of the words of (doc_id, text); texts without words give none."""
    split = docs.select("doc_id", T.words(F.col("text")).alias("w")).withColumn("total", F.size("w")).where("total > 0")
    at = split.withColumn("start", F.explode(T.window_starts(F.col("total"), size, overlap)))
    own = F.slice("w", F.col("start") + 1, F.lit(size))
    return at.select("doc_id", "start", F.size(own).alias("n"), "total", F.array_join(own, " ").alias("text"))


def short_gate(windows: DataFrame, least: int = 12) -> DataFrame:
    """Windows of `least` words or more, and the first one of a shorter text."""
    return windows.where((F.col("n") >= least) | ((F.col("start") == 0) & (F.col("total") < least)))


def first_wins(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key; rows of which a key is null all stay.

    Each task keeps its own first row of a key before the shuffle. Rows with a null key go along, each as a group of its own,
    so that the rows are worked out once.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    null = F.lit(False)
    for k in cols:
        null = null | k.isNull()
    alone = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__alone", F.when(null, F.col("__id"))).drop("__id")
    return alone.withColumn("__n", F.row_number().over(Window.partitionBy(*cols, "__alone").orderBy(*order))).where("__n = 1").drop("__n", "__alone")


def repeated_lines(pages: DataFrame, least: int = 2) -> DataFrame:
    """(doc, line, pages): normalised lines of 5 to 120 characters on at least so many pages of (doc, page, text)."""
    return page_lines(pages).where(F.length("line").between(5, 120)).distinct().groupBy("doc", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, line): normalised lines of (doc, page, text), each worked out once."""
    lines = pages.select("doc", "page", F.explode(F.split("text", r"[\n\r]+", -1)).alias("line"))
    return settled_columns(lines, line=F.lower(T.for_embedding(F.col("line"))))


def grouped_blocks(blocks: DataFrame, keys: list[str], order: str, lang: Column) -> DataFrame:
    """One row for each key: texts joined in order, the first order, and the common language (else mixed)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return blocks.withColumn("__lang", lang).groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"), F.min(order).alias("first_order"), F.count("*").alias("n_blocks"),
        F.when(F.min("__lang") == F.max("__lang"), F.min("__lang")).otherwise("mixed").alias("lang"),
    )


def carried_forward(rows: DataFrame, value: Column, keys: list[str], order: str, default: str) -> DataFrame:
    """`carried`: the latest non-null value before a row, else the default."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("carried", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def merged_rows(rows: Column) -> Column:
    """Table rows (arrays of cells) with rows of a single cell put to the end of that column of the row before."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.btrim(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))

    def step(done: Column, row: Column) -> Column:
        lone = (F.size(F.filter(row, lambda c: c != "")) == 1) & (F.size(done) > 0)
        last = F.element_at(done, -1)
        joined = F.transform(F.arrays_zip(last.alias("a"), row.alias("b")), lambda p: F.btrim(F.concat_ws(" ", F.nullif(p["a"], F.lit("")), F.nullif(p["b"], F.lit("")))))
        return F.when(lone, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(row)))

    return F.aggregate(clean, F.array().cast("array<array<string>>"), step)


def table_fields(tables: DataFrame) -> DataFrame:
    """(table_id, n, section, field, value, product, dosage, observation, sentence) for each usable row of (table_id, section, rows)."""
    merged = settled_columns(tables.select("table_id", "section", "rows"), rows=merged_rows(F.col("rows")))
    headed = (F.size("rows") > 1) & (F.size(F.filter(F.get("rows", F.lit(0)), lambda c: c != "")) >= 2)
    split = merged.select("table_id", "section", F.when(headed, F.get("rows", F.lit(0))).alias("header"), F.posexplode(F.when(headed, F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))).alias("n", "row"))
    cells = settled_columns(split, cells=F.filter("row", lambda c: c != "")).where(F.size("cells") > 0)
    pair = F.filter(F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c")), lambda p: (F.coalesce(p["h"], F.lit("")) != "") & (F.coalesce(p["c"], F.lit("")) != ""))
    paired = F.array_join(F.transform(pair, lambda p: F.concat(p["h"], F.lit("="), p["c"])), " ; ")
    first = F.get("cells", F.lit(0))
    value = F.when(F.col("header").isNotNull() & (F.size("cells") >= 2), paired).otherwise(F.array_join(F.slice("cells", F.lit(2), F.size("cells")), " ; "))
    both = settled_columns(cells, f=first, v=value)
    colon = (F.col("v") == "") & F.contains("f", F.lit(":"))
    named = settled_columns(
        both.select("table_id", "n", "section", "f", "v"),
        field=F.when(colon, F.btrim(F.regexp_extract("f", r"^([^:]*):", 1))).otherwise(F.col("f")),
        value=F.when(colon, F.btrim(F.regexp_extract("f", r"(?s)^[^:]*:(.*)$", 1))).otherwise(F.col("v")),
    ).drop("f", "v")
    good = named.where((F.length(F.btrim("field")) >= 3) & (F.col("value") != ""))
    parts = F.filter(F.transform(F.split("value", ";"), lambda x: F.btrim(x)), lambda x: F.contains(x, F.lit("=")))

    def of(key: str) -> Column:
        """Of `key = value` parts; a later one wins."""
        own = F.element_at(F.filter(F.concat(F.array(F.lit("=")), F.col("parts")), lambda x: (x == "=") | (F.btrim(F.regexp_extract(x, "^([^=]*)=", 1)) == key)), -1)
        return F.nullif(F.btrim(F.regexp_extract(own, "(?s)^[^=]*=(.*)$", 1)), F.lit(""))

    read = settled_columns(settled_columns(good, parts=parts), product=F.coalesce(of("Type de Production"), F.col("field")), dosage=of("Dosage (ppm)"), note=of("Observations")).drop("parts")
    dosage = F.col("dosage")
    amount = F.when(F.contains(F.lower(dosage), F.lit("ppm")), dosage).otherwise(F.concat(dosage, F.lit(" ppm")))
    dosed = F.concat(
        F.lit("Dans la section « "), F.col("section"), F.lit(" », la recommandation pour « "), F.col("product"), F.lit(" » indique un dosage de "), amount, F.lit("."),
        F.when(F.col("note").isNotNull(), F.concat(F.lit(" Cette recommandation est accompagnee de la remarque suivante : "), F.col("note"), F.lit("."))).otherwise(F.lit(" Aucune remarque complementaire n'est precisee.")),
    )
    plain = F.concat(F.lit("Dans la section « "), F.col("section"), F.lit(" », le champ « "), F.col("field"), F.lit(" » contient l'information suivante : "), F.col("value"), F.lit("."))
    return settled_columns(read, observation=F.when(dosage.isNotNull(), F.col("note")), sentence=F.coalesce(dosed, plain)).drop("note")
