"""The whole way from extracted blocks to chunks, with a catalog and a report; everything stays in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C

#: Typed metadata of a chunk; what does not apply to it is null.
METADATA = {
    "boilerplate_removed": "boolean", "boilerplate_removed_chars": "bigint", "source_block_type": "string", "window_start": "int",
    "fields": "array<string>", "units": "array<string>", "field_name": "string", "section": "string", "table_summary": "boolean",
    "product_type": "string", "product_type_canonical": "string", "dosage": "string", "dosage_unit": "string", "observation": "string",
    "product_family": "string", "family_canonical": "string", "model_codes": "array<string>", "model_codes_canonical": "array<string>",
    "doc_id_canonical": "string", "section_canonical": "string", **dict.fromkeys(E.DOSAGES, "string"),
}
#: Keys that survive when blocks are merged into a chunk.
MERGED = ("boilerplate_removed", "boilerplate_removed_chars", "table_summary", "section")
#: Schema of chunks as rows and as JSON lines.
CHUNK = "chunk_id string, doc_id string, file_name string, page int, section string, chunk_type string, text string, text_raw string, lang string, metadata struct<" + ",".join(f"{k}:{t}" for k, t in METADATA.items()) + ">, chunk_ord bigint"
COLUMNS = ("chunk_id", "doc_id", "file_name", "page", "section", "chunk_type", "text", "text_raw", "lang", "metadata", "chunk_ord")


NORMALISED = ("doc_id", "file_name", "page", "section", "chunk_type", "text", "text_raw", "lang", "metadata", "ord")


@dataclass(frozen=True)
class Preparation:
    size: int = 420
    overlap: int = 60
    least_words: int = 12
    least_chars: int = 20
    list_items: bool = False
    across_docs: bool = True
    boilerplate: bool = True
    boilerplate_mode: str = "hybrid"
    boilerplate_least: int = 10


def metadata(**known: Column) -> Column:
    return F.struct(*[known.get(k, F.lit(None)).cast(t).alias(k) for k, t in METADATA.items()])


def fold(order: Column, keys: tuple[str, ...] = tuple(METADATA), prefix: str = "metadata.") -> dict[str, Column]:
    """Aggregates that fold the metadata of rows into one, in order; what is missing changes nothing.

    A single value: the last one. A list: the first one, as long as all are equal; else all their entries, sorted, each once.
    """

    def of(key: str) -> Column:
        c = F.col(f"{prefix}{key}")
        if not METADATA[key].startswith("array"):
            return F.max_by(c, F.when(c.isNotNull(), order))
        every = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(c)))))
        return F.when(F.size(F.collect_set(c)) == 1, F.min_by(c, F.when(c.isNotNull(), order))).when(F.count(c) > 0, every)

    return {k: of(k) for k in keys}


def extracted(doc_id: Column, norm: Column) -> dict[str, Column]:
    """Metadata of a chunk's normal form (of document id, file name and text), of which _named has settled codes and family."""
    codes, family = F.when(F.size("__codes") > 0, F.col("__codes")), F.col("__family")
    return {
        "product_family": family, "family_canonical": family, "model_codes": codes, "model_codes_canonical": codes,
        "doc_id_canonical": E.canonical_doc_id(doc_id), "section_canonical": E.section(norm), **E.dosages(norm),
    }


def _named(rows: DataFrame) -> DataFrame:
    """rows with their normal form, and what several fields of the metadata read of it, each worked out once."""
    normal = C.settled_columns(rows, norm=_norm())
    return C.settled_columns(normal, __codes=E.doc_codes(F.col("norm")), __family=E.family(F.col("norm")))


def _norm() -> Column:
    return T.normal_token(F.concat_ws(" ", "doc_id", "file_name", "text"))


def _clean(blocks: DataFrame, config: Preparation) -> DataFrame:
    read = C.settled_columns(blocks.select("doc_id", "file_name", "page", "block_type", "block_ord", "text"), text=T.cleanup(F.coalesce("text", F.lit(""))))
    return C.settled_columns(read, b=_stripped(F.col("text"), config)).drop("text")


def _stripped(text: Column, config: Preparation) -> Column:
    """struct(text, removed, removed_chars) of cleaned text; the flags are null where the filter is off."""
    if config.boilerplate:
        return T.without_boilerplate(text, config.boilerplate_mode, config.boilerplate_least)
    return F.struct(text.alias("text"), F.lit(None).cast("boolean").alias("removed"), F.lit(None).cast("long").alias("removed_chars"))


def _ord(sub: Column) -> Column:
    return F.shiftleft(F.col("block_ord").cast("long"), 24) + sub


def table_section(rows: Column, fallback: Column) -> Column:
    flat = F.lower(F.array_join(F.transform(F.flatten(rows), lambda c: F.btrim(F.coalesce(c, F.lit("")))), " "))
    has = lambda *parts: T.any_of(flat, parts)
    return (
        F.when(has("type de production", "dosage (ppm)"), "Dosages Recommandes")
        .when(has("poids farine") & has("50 ppm"), "Table de Conversion")
        .when(has("microbiology", "heavy metals", "allergens", "gmo status", "food safty data"), "Food Safety Data")
        .otherwise(fallback)
    )


def normalize_blocks(blocks: DataFrame, config: Preparation = Preparation()) -> DataFrame:
    """Cleaned blocks (doc_id, file_name, page, section, chunk_type, text, text_raw, lang, metadata, ord) of extracted ones.

    blocks: (doc_id, file_name, page, block_type, text, rows, block_ord); block_ord orders and names a block of its
    document. A line on two pages of a document or more goes. A table without a known section takes that of the last paragraph
    before it on its page. Null texts are empty and give nothing, as do tables without usable rows; other columns are ignored.
    """
    base = blocks.select("doc_id", "file_name", "page", "block_type", "text", "rows", "block_ord").where("block_ord is not null")
    is_table = (F.col("block_type") == "table") & (F.coalesce(F.size("rows"), F.lit(0)) > 0)
    is_table = F.coalesce(is_table, F.lit(False))
    again = C.repeated_lines(base.where("block_type = 'paragraph'").select(F.col("doc_id").alias("doc"), "page", "text")).select(F.col("doc").alias("__doc"), F.col("line").alias("__line"))
    clean = _clean(base.where(~is_table), config)
    lines = F.filter(F.transform(F.split(T.machine_phrases(F.col("b.text")), "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")
    every = clean.select("doc_id", "file_name", "page", "block_ord", "b.removed", "b.removed_chars", F.posexplode(lines).alias("i", "line"))
    every = C.settled_columns(every, key=F.lower(T.for_embedding(F.col("line"))))
    kept = every.join(again, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__line")), "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("i", "line")))
    paragraphs = kept.groupBy("doc_id", "file_name", "page", "block_ord", "removed", "removed_chars").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    paragraphs = C.settled_columns(C.settled_columns(paragraphs, body=F.array_join("lines", "\n")), section=T.section_title(F.col("body")))
    flags = metadata(boilerplate_removed=F.col("removed"), boilerplate_removed_chars=F.col("removed_chars"))

    def shaped(rows: DataFrame, kind: str, raw: Column, lang: Column, md: Column, ord_: Column) -> DataFrame:
        made = rows.select("doc_id", "file_name", "page", "section", F.lit(kind).alias("chunk_type"), raw.alias("text_raw"), lang.alias("lang"), md.alias("metadata"), ord_.alias("ord"))
        return C.settled_columns(made, text=T.for_embedding(F.col("text_raw"))).select(*NORMALISED)

    out = shaped(paragraphs, "paragraph", F.col("body"), T.language(F.col("body")), flags, _ord(F.size("lines")))
    if config.list_items:
        items = paragraphs.select("*", F.posexplode("lines").alias("i", "item")).where(T.list_item(F.col("item")))
        out = out.unionByName(shaped(items, "list_item", F.col("item"), T.language(F.col("item")), flags, _ord(F.col("i"))))

    tables = base.where(is_table).select("doc_id", "file_name", "page", "block_ord", "rows", F.lit(None).cast("string").alias("own"))
    before = paragraphs.select("doc_id", "file_name", "page", "block_ord", F.lit(None).cast("array<array<string>>").alias("rows"), F.col("section").alias("own"))
    carried = C.carried_forward(tables.unionByName(before), F.col("own"), ["doc_id", "page"], "block_ord", "Table Data").where("rows is not null")
    named = C.settled_columns(carried.select(F.struct("doc_id", "file_name", "page", "block_ord").alias("table_id"), "carried", "rows"), section=table_section(F.col("rows"), F.col("carried")))
    facts = C.settled_columns(C.table_fields(named).select("table_id.*", "n", "section", "field", "product", "dosage", "observation", "sentence"), lang=T.language(F.col("sentence")))
    md = metadata(
        fields=F.array("field"), units=T.units(F.col("sentence")), field_name=F.col("field"), section=F.col("section"), product_type=F.col("product"), product_type_canonical=E.product_class(F.col("product")),
        dosage=F.col("dosage"), dosage_unit=F.when(F.col("dosage").isNotNull(), "ppm"), observation=F.col("observation"),
    )
    out = out.unionByName(shaped(facts, "table_kv", F.col("sentence"), F.col("lang"), md, _ord(F.col("n"))))
    whole = F.array_sort(F.collect_list(F.struct("n", T.for_embedding(F.col("sentence")).alias("t"))))
    summary = facts.groupBy("doc_id", "file_name", "page", "block_ord", "section").agg(
        F.array_join(F.transform(whole, lambda x: x["t"]), " ").alias("all"), (F.max("n") + 1).alias("n"), F.when(F.min("lang") == F.max("lang"), F.min("lang")).otherwise("mixed").alias("lang"))
    return out.unionByName(shaped(summary, "paragraph", F.col("all"), F.col("lang"), metadata(table_summary=F.lit(True), section=F.col("section")), _ord(F.col("n"))))


def chunk_blocks(blocks: DataFrame, config: Preparation = Preparation()) -> DataFrame:
    """CHUNK rows of normalize_blocks' output: table rows as they are, the rest joined by page, section and kind and cut into windows.

    A text that needs no cut must have least_words words; a short last window stays.
    """
    page = F.col("page").cast("string")
    facts = blocks.where("chunk_type = 'table_kv'").withColumn("chunk_id", T.content_id(F.col("doc_id"), page, F.col("chunk_type"), F.col("text"))).withColumn("chunk_ord", F.col("ord"))
    ordered = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("t")))), lambda x: x["t"]), lambda t: t != ""), "\n")
    last = [c.alias(f"m_{k}") for k, c in fold(F.col("ord"), MERGED).items()]
    grouped = blocks.where("chunk_type <> 'table_kv'").groupBy("doc_id", "page", "section", "chunk_type").agg(
        ordered("text").alias("whole"), ordered("text_raw").alias("whole_raw"), F.min_by("file_name", "ord").alias("file_name"), F.min("ord").alias("chunk_ord"),
        F.when(F.min("lang") == F.max("lang"), F.min("lang")).otherwise("mixed").alias("lang"), *last,
    )
    worded = C.settled_columns(C.settled_columns(grouped, whole=F.col("whole")), w=T.words(F.col("whole"))).withColumn("n", F.size("w"))
    fits = F.col("n") <= config.size
    at = worded.where(~fits | (F.col("n") >= config.least_words)).withColumn("start", F.explode(F.when(fits, F.array(F.lit(0))).otherwise(T.window_starts(F.col("n"), config.size, config.overlap))))
    window = F.array_join(F.slice("w", F.col("start") + 1, F.lit(config.size)), " ")
    cut = C.settled_columns(at, text=F.when(fits, F.col("whole")).otherwise(window)).withColumn("text_raw", F.when(fits, F.col("whole_raw")).otherwise(F.col("text")))
    named = cut.withColumn("chunk_id", T.content_id(F.col("doc_id"), page, F.col("chunk_type"), F.when(fits, F.col("text")).otherwise(F.concat_ws(":", F.col("start").cast("string"), "text"))))
    named = _named(named)
    md = metadata(**{k: F.col(f"m_{k}") for k in MERGED}, **extracted(F.col("doc_id"), F.col("norm")), units=T.units(F.col("text")), window_start=F.when(~fits, F.col("start")))
    return C.settled_columns(named, metadata=md).select(*COLUMNS).unionByName(facts.select(*COLUMNS))


def _order() -> list[Column]:
    """Chunks as files, blocks and windows come."""
    return [F.col("file_name"), F.col("doc_id"), F.col("chunk_ord"), F.coalesce(F.col("metadata.window_start"), F.lit(0)), F.col("chunk_id")]


def signature() -> Column:
    """What a table row says, in whichever document; null for other chunks."""
    part = lambda c: F.lower(F.btrim(F.coalesce(F.col(c), F.lit(""))))
    field, dosage = part("metadata.field_name"), part("metadata.dosage")
    norm = T.normal_token(F.col("text"))
    said = F.when((field != "") & (dosage != ""), F.concat_ws("|", F.lower(F.btrim(F.coalesce("metadata.section", "section"))), field, dosage)).when(norm != "", F.substring(F.sha1(norm), 1, 24))
    return F.when(F.col("chunk_type") == "table_kv", said)


def deduplicated(chunks: DataFrame, across_docs: bool = True) -> DataFrame:
    """The first of chunks that say the same: table rows of all documents, then texts of a document's page and kind."""
    rows = C.first_wins(C.settled_columns(chunks, __s=signature()), ["__s"], _order()).drop("__s") if across_docs else chunks
    same = ["doc_id", "page", "chunk_type"]
    keyed = C.settled_columns(rows, __t=F.sha2(F.lower(T.for_embedding(F.col("text"))), 256), __k=F.struct(*same))
    return C.first_wins(keyed, ["__k", "__t"], _order()).drop("__k", "__t")


def catalog(chunks: DataFrame) -> DataFrame:
    """A row for each document: canonical id, file name, families, codes, sections, pages and the number of chunks."""
    md = lambda k: F.nullif(F.btrim(f"metadata.{k}"), F.lit(""))
    some = lambda c: F.array_sort(F.collect_set(c))
    first = F.struct("chunk_ord", "chunk_id")
    rows = chunks.withColumn("__codes", F.coalesce("metadata.model_codes_canonical", "metadata.model_codes", F.array().cast("array<string>")))
    return rows.groupBy("doc_id").agg(
        F.min_by(F.coalesce("metadata.doc_id_canonical", E.canonical_doc_id(F.col("doc_id"))), first).alias("doc_id_canonical"), F.min_by("file_name", first).alias("file_name"),
        some(F.coalesce(md("family_canonical"), md("product_family"))).alias("families"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__codes")))).alias("model_codes"),
        some(md("section_canonical")).alias("sections"), some("page").alias("pages"), F.count("*").alias("chunks"),
    )


def report(blocks: DataFrame, chunks: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: documents, pages, pages read by OCR, chunks, chunks after dedup, failed files with their errors.

    The last two come from blocks.ocr and blocks.error, where they are there.
    """
    failed = F.col("error") if "error" in blocks.columns else F.lit(None).cast("string")
    seen = F.coalesce(F.col("ocr"), F.lit(False)) if "ocr" in blocks.columns else F.lit(False)
    pages = blocks.select("doc_id", "page", failed.alias("error"), seen.alias("ocr")).groupBy("doc_id", "page", "error").agg(F.max("ocr").alias("ocr")).agg(
        F.count_if(F.col("ocr") & F.col("page").isNotNull()).alias("pages_with_ocr"),
        F.count_distinct(F.when(F.col("error").isNull(), F.col("doc_id"))).alias("documents_processed"), F.count_if(F.col("error").isNull() & F.col("page").isNotNull()).alias("pages_processed"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "doc_id", "error")))).alias("extraction_errors"),
    )
    return pages.crossJoin(chunks.agg(F.count("*").alias("chunks_generated"))).crossJoin(unique.agg(F.count("*").alias("chunks_after_dedup")))


def prepare(blocks: DataFrame, config: Preparation = Preparation()) -> DataFrame:
    """CHUNK rows of extracted blocks, normalised, chunked and without repeats."""
    return deduplicated(chunk_blocks(normalize_blocks(blocks, config), config), config.across_docs)


def direct_chunks(blocks: DataFrame, config: Preparation = Preparation()) -> DataFrame:
    """CHUNK rows by the short way: every block's cleaned text cut into windows, without sections or table sentences.

    Blocks of under least_chars characters give nothing, and a window of under least_words words only if it is all of its
    block. across_docs drops a document's repeated windows.
    """
    clean = C.settled_columns(_clean(blocks.where("block_ord is not null"), config), whole=T.for_embedding(F.col("b.text")))
    worded = C.settled_columns(clean.where(F.length("whole") >= config.least_chars), w=T.words_of(F.col("whole"))).withColumn("total", F.size("w")).where("total > 0")
    at = worded.withColumn("start", F.explode(T.window_starts(F.col("total"), config.size, config.overlap))).withColumn("own", F.slice("w", F.col("start") + 1, F.lit(config.size))).withColumn("n", F.size("own"))
    rows = C.settled_columns(C.short_gate(at, config.least_words).drop("w"), text=F.array_join("own", " "))
    rows = _named(rows)
    name = T.content_id(F.col("doc_id"), F.col("page").cast("string"), F.lit("paragraph"), F.concat_ws(":", "block_type", F.col("start").cast("string"), "text"))
    md = metadata(source_block_type=F.col("block_type"), window_start=F.col("start"), boilerplate_removed=F.col("b.removed"), boilerplate_removed_chars=F.col("b.removed_chars"), **extracted(F.col("doc_id"), F.col("norm")))
    shaped = rows.select(
        name.alias("chunk_id"), "doc_id", "file_name", "page", F.lit("General").alias("section"), F.lit("paragraph").alias("chunk_type"), "text", F.col("text").alias("text_raw"),
        T.language(F.col("text")).alias("lang"), md.alias("metadata"), _ord(F.lit(0)).alias("chunk_ord"),
    )
    if not config.across_docs:
        return shaped
    same = F.sha2(F.lower(T.for_embedding(F.col("text"))), 256)
    return C.first_wins(C.settled_columns(shaped, __t=same, __d=F.struct("doc_id")), ["__d", "__t"], _order()).drop("__d", "__t")
