"""Queries that go the whole way: blocks to chunks, chunks to answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import dense as D
from siltstone.operators import prepare as P
from siltstone.operators import retrieve as V

from .registry import query
from .retrieval_queries import _HYBRID, KEYWORDS, questions
from . import sql as S
from .text_queries import _ALL, _CLEAN, _DOC_CODES, _FAMILY, _LANG, _LINES, _SECTION, _STRIP, _TITLE, _embed_sql, spec


def _blocks(t, doc: str):
    """Documents as one-block pages of the documents that a column names."""
    d = t("documents")
    return d.select(
        F.col(doc).cast("string").alias("doc_id"), F.col("source").alias("file_name"), F.col("doc_id").cast("int").alias("page"), F.lit("paragraph").alias("block_type"), "text",
        F.lit(None).cast("array<array<string>>").alias("rows"), F.col("doc_id").alias("block_ord"),
    )


_SAID = f"cleaned AS (SELECT doc_id, {_CLEAN} AS text FROM documents), " + _STRIP[len("WITH ") : _STRIP.rindex("SELECT doc_id, md5")].replace("FROM documents", "FROM cleaned").rstrip()
_WORDS = "list_filter(regexp_split_to_array(whole, '\\s+'), lambda x: x <> '')"
_CUT = "unnest(range(0, greatest(len(w), 1), 360)) AS u(s) WHERE s = 0 OR s - 360 + 420 < len(w)"


_DIRECT = f"""WITH {_SAID}, p AS (SELECT doc_id, {_embed_sql('CASE WHEN ok THEN kept ELSE text END')} AS whole FROM r), w AS (SELECT doc_id, {_WORDS} AS w FROM p WHERE length(whole) >= 20),
c AS (SELECT doc_id, s, len(w[s + 1 : s + 420]) AS n, len(w) AS total, array_to_string(w[s + 1 : s + 420], ' ') AS text FROM w, {_CUT}),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower({_embed_sql('text')}) ORDER BY s) AS k FROM c WHERE n >= 12 OR (s = 0 AND total < 12))
SELECT doc_id::VARCHAR AS doc_id, s::INTEGER AS start, left(sha1(doc_id::VARCHAR || '|' || doc_id::VARCHAR || '|paragraph|paragraph:' || s::VARCHAR || ':' || text), 16) AS chunk_id, {_LANG} AS lang FROM g WHERE k = 1"""


@query(_DIRECT)
def direct_chunks(t, spark):
    return P.direct_chunks(_blocks(t, "doc_id")).select("doc_id", F.col("metadata.window_start").alias("start"), "chunk_id", "lang")


_PREPARED = f"""WITH {_SAID}, rep AS (SELECT doc, line FROM ({_LINES}) WHERE length(line) BETWEEN 5 AND 120 GROUP BY doc, line HAVING count(*) >= 2),
ls AS (SELECT doc_id, source, unnest(range(len(x))) AS i, trim(unnest(x)) AS t FROM (SELECT doc_id, source, string_split(CASE WHEN ok THEN kept ELSE r.text END, chr(10)) AS x FROM r JOIN documents USING (doc_id))),
lk AS (SELECT *, lower({_embed_sql('t')}) AS line, source AS doc FROM ls WHERE t <> ''),
body AS (SELECT doc_id, source, string_agg(t, chr(10) ORDER BY i) AS text FROM lk ANTI JOIN rep USING (doc, line) GROUP BY ALL),
normal AS (SELECT doc_id, source, {_LANG} AS lang, coalesce(list_filter(string_split(text, chr(10))[1:6], lambda l: {_TITLE})[1], 'General') AS section, {_embed_sql('text')} AS whole FROM body),
w AS (SELECT *, {_WORDS} AS w FROM normal), c AS (SELECT * EXCLUDE (w), s, len(w) AS total, CASE WHEN len(w) <= 420 THEN whole ELSE array_to_string(w[s + 1 : s + 420], ' ') END AS text FROM w, {_CUT}),
g AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, lower({_embed_sql('text')}) ORDER BY s) AS k FROM c WHERE total >= 12)
"""


@query(f"""{_PREPARED} SELECT source AS doc_id, doc_id::INTEGER AS page, section, lang, left(sha1(source || '|' || doc_id::VARCHAR || '|paragraph|' || CASE WHEN total > 420 THEN s::VARCHAR || ':' ELSE '' END || text), 16) AS chunk_id FROM g WHERE k = 1""")
def prepared_chunks(t, spark):
    return P.prepare(_blocks(t, "source")).select("doc_id", "page", "section", "lang", "chunk_id")


@query(f"""{_PREPARED} SELECT (SELECT count(DISTINCT source) FROM documents)::BIGINT AS documents_processed, (SELECT count(*) FROM documents)::BIGINT AS pages_processed, 0::BIGINT AS pages_with_ocr,
 (SELECT count(*) FROM g)::BIGINT AS chunks_generated, (SELECT count(*) FROM g WHERE k = 1)::BIGINT AS chunks_after_dedup, '' AS errors""")
def prep_report(t, spark):
    blocks = _blocks(t, "source")
    chunks = C.stored(P.chunk_blocks(P.normalize_blocks(blocks)).drop("text_raw", "lang"))  # read twice, and no count asks for these two
    return P.report(blocks, chunks, P.deduplicated(chunks)).withColumn("errors", F.array_join("extraction_errors", ",")).drop("extraction_errors")


@query(_DIRECT)
def jsonl_roundtrip(t, spark):
    """Chunks written as JSON objects and read back by the schema."""
    made = P.direct_chunks(_blocks(t, "doc_id"))
    lines = C.settled_columns(made, line=F.to_json(F.struct(*made.columns), {"ignoreNullFields": "false"})).select("line")
    back = C.settled_columns(lines, c=F.from_json("line", P.CHUNK)).select("c.*")  # a line is written and read once, not for each field
    return back.select("doc_id", F.col("metadata.window_start").alias("start"), "chunk_id", "lang")


def _sheet_blocks(t, spark, doc_id: str):
    """Product sheets as one-block pages of the documents that a column names."""
    return spec(t, spark).select(
        F.col(doc_id).alias("doc_id"), "file_name", F.col("k").cast("int").alias("page"), F.lit("paragraph").alias("block_type"), "text", F.lit(None).cast("array<array<string>>").alias("rows"), F.col("k").cast("long").alias("block_ord")
    )


_SHEETS = f"""spec0 AS ({S.SPEC}), spec AS (SELECT k, brand AS doc_id, file_name, {_embed_sql(_CLEAN)} AS text FROM spec0),
u AS (SELECT *, {_ALL} AS a, row_number() OVER (PARTITION BY doc_id, lower({_embed_sql('text')}) ORDER BY file_name, k) AS n FROM spec)"""


@query(f"""WITH {_SHEETS}, m AS (SELECT *, {_FAMILY} AS f, {_SECTION} AS sec, list_filter(string_split({_DOC_CODES}, ','), lambda x: x <> '') AS codes FROM u WHERE n = 1)
SELECT doc_id, {S.norm('doc_id')} AS doc_id_canonical, min_by(file_name, k) AS file_name, {S.joined('list(DISTINCT f)')} AS families, {S.joined('list_distinct(flatten(list(codes)))')} AS model_codes,
 coalesce({S.joined('list(DISTINCT sec) FILTER (sec IS NOT NULL)')}, '') AS sections, array_to_string(list_sort(list(k)), ',') AS pages, count(*)::BIGINT AS chunks FROM m GROUP BY doc_id""")
def doc_catalog(t, spark):
    """The catalog of the sheets of each brand; no brand's name holds a word that its canonical form leaves out."""
    rows = P.catalog(P.direct_chunks(_sheet_blocks(t, spark, "brand")))
    return rows.select("doc_id", "doc_id_canonical", "file_name", *[F.array_join(c, ",").alias(c) for c in ("families", "model_codes", "sections")], F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "chunks")


_FOLDED = lambda c: f"CASE WHEN count(DISTINCT {c}) = 1 THEN array_to_string(min_by({c}, k) FILTER ({c} IS NOT NULL), ',') ELSE {S.joined(f'list_distinct(flatten(list({c}) FILTER ({c} IS NOT NULL)))')} END AS {c}"


@query(f"""WITH {_SHEETS}, s AS (SELECT *, {_FAMILY} AS family, {_SECTION} AS sec, nullif(regexp_extract(a, '{E.AMOUNT}', 1), '') AS dosage FROM u),
m AS (SELECT *, k % 7 AS grp, CASE WHEN k % 5 <> 0 THEN ['z', family] END AS fields, CASE WHEN k % 7 = 3 THEN ['y', 'x'] WHEN k % 3 = 0 THEN [family] END AS units FROM s)
SELECT grp, max_by(sec, k) FILTER (sec IS NOT NULL) AS section, max_by(dosage, k) FILTER (dosage IS NOT NULL) AS dosage, {_FOLDED('fields')}, {_FOLDED('units')} FROM m GROUP BY grp""")
def metadata_fold(t, spark):
    """Metadata of many sheets folded into one: the last single value, lists joined, what is missing passed over."""
    k, sheets = F.col("page"), spec(t, spark).select(F.col("k").alias("page"), "brand", "file_name", "text")
    own = C.settled_columns(C.settled_columns(sheets, text=T.for_embedding(T.cleanup(F.col("text")))), a=T.normal_token(F.concat_ws(" ", "brand", "file_name", "text")))
    own = C.settled_columns(own, family=E.family(F.col("a")), sec=E.section(F.col("a")), dosage=F.nullif(F.regexp_extract("a", E.AMOUNT, 1), F.lit("")))
    md = P.metadata(section=F.col("sec"), dosage=F.col("dosage"), fields=F.when(k % 5 != 0, F.array(F.lit("z"), "family")), units=F.when(k % 7 == 3, F.array(F.lit("y"), F.lit("x"))).when(k % 3 == 0, F.array("family")))
    out = own.select((k % 7).alias("grp"), "page", md.alias("metadata")).groupBy("grp").agg(*[c.alias(n) for n, c in P.fold(F.col("page"), ("section", "dosage", "fields", "units")).items()])
    return out.select("grp", "section", "dosage", *[F.array_join(c, ",").alias(c) for c in ("fields", "units")])


@query(f"""WITH spec AS ({S.SPEC}), f AS (SELECT doc_id, file_name, k, CASE k % 4 WHEN 0 THEN 'Pain de mie' WHEN 1 THEN 'Biscuit sec' WHEN 2 THEN ' PAIN DE MIE' ELSE 'Pizza' END AS field, size_ || '-' || (size_ + 10) AS dosage
 FROM spec JOIN (SELECT p_partkey AS k, p_size AS size_ FROM part) USING (k)), n AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(field)), dosage ORDER BY file_name, doc_id) AS n FROM f) SELECT doc_id, trim(field) AS field, dosage FROM n WHERE n = 1""")
def cross_doc_signature_dedup(t, spark):
    """A row of each sheet's dosage table; what an earlier document says already goes, whatever its letters' case."""
    k = F.col("p_partkey")
    field = F.when(k % 4 == 0, "Pain de mie").when(k % 4 == 1, "Biscuit sec").when(k % 4 == 2, " PAIN DE MIE").otherwise("Pizza")
    dose = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 10).cast("string"))
    rows = F.array(F.array(F.lit("Type de Production"), F.lit("Dosage (ppm)")), F.array(field, dose))
    sheets = spec(t, spark).join(t("part").select(k.alias("k"), rows.alias("rows")), "k")
    blocks = sheets.select("doc_id", "file_name", F.lit(1).alias("page"), F.lit("table").alias("block_type"), F.lit(None).cast("string").alias("text"), "rows", F.lit(0).cast("long").alias("block_ord"))
    facts = P.chunk_blocks(P.normalize_blocks(blocks)).where("chunk_type = 'table_kv'")
    return P.deduplicated(facts).select("doc_id", F.col("metadata.field_name").alias("field"), "metadata.dosage")


_CHUNK_ID = "left(sha1(doc_id || '|1|paragraph|paragraph:0:' || text), 16)"
_SIGNED = f"((('0x' || {_CHUNK_ID})::UBIGINT::HUGEINT + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)"
#: The hybrid ranks, for chunks: of cleaned texts, without product classes, in the order of their ids.
_CHUNKED = _HYBRID[: _HYBRID.rindex("SELECT query_id, k AS chunk_id")]
for _old, _new in (
    (f"spec AS ({S.SPEC})", f"spec0 AS ({S.SPEC}), spec AS (SELECT k, doc_id, file_name, brand, {_embed_sql(_CLEAN)} AS text FROM spec0)"), ("sv AS (SELECT k, ", f"sv AS (SELECT k, {_SIGNED} AS id, "), ("(SELECT query_id, k, round(coalesce", "(SELECT query_id, k, id, round(coalesce"),
    ("ORDER BY cos DESC, k)", "ORDER BY cos DESC, id)"), ("y AS (SELECT x.*, cos,", "y AS (SELECT x.*, cos, dr,"), ("THEN 1.0 WHEN", "THEN 0.8 WHEN"), ("ORDER BY final DESC, k)", "ORDER BY final DESC, dr)"),
):
    assert _old in _CHUNKED, _old
    _CHUNKED = _CHUNKED.replace(_old, _new)


@query(f"""{_CHUNKED} SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, {_CHUNK_ID} AS chunk_id, round(final, 6) AS score, {S.joined('list_intersect(tok, own)')} AS terms, false AS is_context
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, dr) AS rank FROM d WHERE nd = 1) WHERE rank <= 10""")
def search_with_context(t, spark):
    """Product sheets as chunks, keyword vectors, the stated questions: ranks, then neighbours, of which pages of one chunk have none."""
    blocks = spec(t, spark).select("doc_id", "file_name", F.lit(1).alias("page"), F.lit("paragraph").alias("block_type"), "text", F.lit(None).cast("array<array<string>>").alias("rows"), F.col("k").cast("long").alias("block_ord"))
    chunks = C.stored(P.direct_chunks(blocks))  # for vectors, candidates and neighbours
    vec = lambda c: D.keyword_vector(T.token_set(F.col(c), 1), F.col(c), KEYWORDS, 7)
    asked = questions(spark).select(F.col("query_id").cast("long").alias("query_id"), "question", vec("question").alias("vector"))
    rows = V.search(chunks, chunks.select("chunk_id", vec("text").alias("vector")), asked, 10)
    return rows.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), F.array_join("matched_terms", ",").alias("terms"), "is_context")
