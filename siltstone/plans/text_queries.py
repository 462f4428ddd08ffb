"""Queries on text, chunks and metadata."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from siltstone.functions import answer as A
from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import embed as M

from . import sql as S
from .registry import query


def spec(t, spark):
    C.spread(t("part")).createOrReplaceTempView("part")
    return spark.sql(S.SPEC)


def _joined(c):
    return F.array_join(F.array_sort(c), ",")


_CLEAN = """array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(replace(replace(replace(text, chr(12), chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '-\\n([a-zA-Z])', '\\1', 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: replace(replace(x, ' .', '.'), ' ,', ',')), chr(10))"""


@query(f"SELECT doc_id, md5({_CLEAN}) AS clean_md5, length({_CLEAN})::BIGINT AS n FROM documents")
def cleanup_text(t, spark):
    c = T.cleanup(F.col("text"))
    return t("documents").select("doc_id", F.md5(c).alias("clean_md5"), F.char_length(c).cast("long").alias("n"))


def _embed_sql(x: str) -> str:
    return S.squeeze(S.rewrites(S.rewrites(f"replace({x}, '：', ':')", [(r"\b(?:[a-z]{0,2})?\s*technical\s+data\s+sheet\b", " ")], "gi"), [(r"(\d),(\d)", r"\1.\2")]))


@query(f"SELECT doc_id, md5({_embed_sql('text')}) AS text_md5 FROM documents")
def normalize_embedding(t, spark):
    return t("documents").select("doc_id", F.md5(T.for_embedding(F.col("text"))).alias("text_md5"))


@query(f"SELECT doc_id, md5({S.norm('text')}) AS norm_md5 FROM documents")
def token_normalize(t, spark):
    return t("documents").select("doc_id", F.md5(T.normal_token(F.col("text"))).alias("norm_md5"))


@query(f"SELECT doc_id, len({S.tokens('text')})::BIGINT AS n_search_tokens, len({S.tokens('text', 1)})::BIGINT AS n_answer_tokens, len(list_filter(string_split({S.norm('text')}, ' '), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents")
def token_counts(t, spark):
    own = C.settled_columns(t("documents").select("doc_id", "text"), words=F.filter(F.split(T.normal_token(F.col("text")), " "), lambda x: x != ""))
    own = C.settled_columns(own.drop("text"), tokens=F.array_distinct("words"))
    return own.select("doc_id", F.size(F.filter("tokens", lambda x: F.length(x) >= 2)).cast("long").alias("n_search_tokens"), F.size("tokens").cast("long").alias("n_answer_tokens"), F.size("words").cast("long").alias("n_tokens"))


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


_FR, _EN = (_any("' ' || lower(text) || ' '", [f" {m} " for m in ms]) for ms in (T.FR_MARKERS, T.EN_MARKERS))
_LANG = f"CASE WHEN {_FR} AND NOT {_EN} THEN 'fr' WHEN {_EN} AND NOT {_FR} THEN 'en' ELSE 'mixed' END"


@query(f"SELECT doc_id, {_LANG} AS tag FROM documents")
def detect_lang(t, spark):
    return t("documents").select("doc_id", T.language(F.col("text")).alias("tag"))


@query(f"SELECT source, CASE WHEN min(tag) = max(tag) THEN min(tag) ELSE 'mixed' END AS lang, count(*)::BIGINT AS n FROM (SELECT source, {_LANG} AS tag FROM documents) GROUP BY source")
def lang_counts(t, spark):
    tags = t("documents").select("source", T.language(F.col("text")).alias("tag"))
    return tags.groupBy("source").agg(F.when(F.min("tag") == F.max("tag"), F.min("tag")).otherwise("mixed").alias("lang"), F.count("*").alias("n"))


_TITLE = r"length(l) BETWEEN 3 AND 80 AND ((l = upper(l) AND l <> lower(l)) OR (NOT regexp_matches(l, '\p{L}\p{Lu}') AND NOT regexp_matches(l, '(^|[^\p{L}])\p{Ll}') AND regexp_matches(l, '\p{Lu}')))"


@query(f"SELECT doc_id, coalesce(list_filter(string_split(text, chr(10))[1:6], lambda l: {_TITLE})[1], 'General') AS section FROM documents")
def detect_section(t, spark):
    return t("documents").select("doc_id", T.section_title(F.col("text")).alias("section"))


@query(S.over_spec(f"k, {S.joined('list_distinct(regexp_extract_all(lower(text), ' + chr(39) + T.UNIT_TOKENS + chr(39) + '))')} AS units"))
def extract_units(t, spark):
    return spec(t, spark).select("k", F.array_join(T.units(F.col("text")), ",").alias("units"))


@query("SELECT doc_id, left(sha1(doc_id::VARCHAR || '|1|paragraph|' || text), 16) AS chunk_id FROM documents")
def chunk_ids(t, spark):
    return t("documents").select("doc_id", T.content_id(F.col("doc_id").cast("string"), F.lit("1"), F.lit("paragraph"), F.col("text")).alias("chunk_id"))


_WINDOWS = """SELECT doc_id, s AS start, len(w[s + 1 : s + 420]) AS n, len(w) AS total, array_to_string(w[s + 1 : s + 420], ' ') AS text
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), unnest(range(0, greatest(len(w), 1), 360)) AS u(s) WHERE len(w) > 0 AND (s = 0 OR s - 360 + 420 < len(w))"""


@query(f"SELECT doc_id, start::INTEGER AS start, n::INTEGER AS n, left(sha1(doc_id::VARCHAR || '|1|paragraph|' || start::VARCHAR || ':' || text), 16) AS chunk_id FROM ({_WINDOWS})")
def token_windows(t, spark):
    w = C.token_windows(t("documents"))
    return w.select("doc_id", "start", "n", T.content_id(F.col("doc_id").cast("string"), F.lit("1"), F.lit("paragraph"), F.concat_ws(":", F.col("start").cast("string"), "text")).alias("chunk_id"))


@query(f"SELECT doc_id, start::INTEGER AS start, n::INTEGER AS n FROM ({_WINDOWS}) WHERE n >= 12 OR (start = 0 AND total < 12)")
def short_window_gate(t, spark):
    return C.short_gate(C.token_windows(t("documents"))).select("doc_id", "start", "n")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, {S.norm('text')} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup_first_wins(t, spark):
    norm = T.normal_token(F.col("text"))
    keyed = C.settled_columns(t("documents").select("doc_id", "source", "text"), norm=F.sha2(norm, 256)).drop("text")
    return C.first_wins(keyed, ["source", "norm"], ["doc_id"]).select("doc_id", "source")


#: Texts in which more than ASCII matters.
_ODD = (
    "dosage\u00a0:\u00a05\u00a0ppm", "25\u2103", "5 \u338e/\u338f", "\uff28\uff23\uff26\uff16\uff10\uff10", "\u2167 \u2153 \u2116", "Am\u00e9liorant \u0130stanbul STRA\u00dfE", "\ufb01n \u2026 \u00bd \u2122", "a\u2028b\u3000c\u1680d\x1ce\x85f\x0bg",
    "\U0001d400\U0001d7ce \u2460\u2474 \u32c0", "\ud55c\uae00 ok", "e\u0301e \u0903 x\u0345", "", "plain  ASCII - 100 %", "\u212b\u2126 K\u212a", "\u0660\u0661,\u0662 1,5", "\ufdfa",
)


def _expected(text: str) -> tuple:
    """The rule itself, by Python's unicodedata and its \\s, \\d and split()."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    norm = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9%/\-\s]", " ", bare)).strip()
    embed = re.sub(r"\s+", " ", re.sub(r"(\d),(\d)", r"\1.\2", text.replace("：", ":"))).strip()
    return norm, len(text.split()), re.sub(r"\s+", " ", text).strip(), embed


def _values(rows) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


@query(_values((k, *_expected(x)) for k, x in enumerate(_ODD)) + " AS v(id, norm, n_words, squeezed, embed)")
def unicode_forms(t, spark):
    """Folding, words and white space of texts with no-break spaces, units, ligatures and full-width letters."""
    rows = spark.createDataFrame(list(enumerate(_ODD)), "id int, text string")
    x = F.col("text")
    return rows.select("id", T.normal_token(x).alias("norm"), F.size(T.words(x)).alias("n_words"), T.squeezed(x).alias("squeezed"), T.for_embedding(x).alias("embed"))


_LINES = f"SELECT DISTINCT source AS doc, doc_id AS page, lower({_embed_sql('l')}) AS line FROM documents, unnest(regexp_split_to_array(text, '[\\n\\r]+')) AS u(l)"


@query(f"SELECT doc, line, count(*)::BIGINT AS pages FROM ({_LINES}) WHERE length(line) BETWEEN 5 AND 120 GROUP BY doc, line HAVING count(*) >= 2")
def repeated_lines(t, spark):
    return C.repeated_lines(t("documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text"))


@query(f"WITH l AS ({_LINES}), r AS (SELECT doc, line FROM l WHERE length(line) BETWEEN 5 AND 120 GROUP BY doc, line HAVING count(*) >= 2) SELECT page AS doc_id, count(*)::BIGINT AS n FROM l ANTI JOIN r USING (doc, line) WHERE line <> '' GROUP BY page")
def repeated_line_strip(t, spark):
    pages = t("documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    lines = C.page_lines(pages).distinct()
    return lines.where("line <> ''").join(C.repeated_lines(pages), ["doc", "line"], "left_anti").groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5, min(turn) AS first_order, count(*)::BIGINT AS n_blocks, CASE WHEN min({_LANG}) = max({_LANG}) THEN min({_LANG}) ELSE 'mixed' END AS lang FROM conversations GROUP BY conv_id")
def group_concat_blocks(t, spark):
    return C.grouped_blocks(t("conversations"), ["conv_id"], "turn", T.language(F.col("text"))).withColumn("text_md5", F.md5("text")).drop("text")


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Table Data') AS carried FROM conversations")
def section_carry_forward(t, spark):
    return C.carried_forward(t("conversations"), F.when(F.col("role") == "user", F.col("text")), ["conv_id"], "turn", "Table Data").select("conv_id", "turn", "carried")


#: Letters and numbers of other scripts count as \\w and \\d; stand-ins of ASCII, which no pattern names, let this engine see them so.
_PLAIN = r"regexp_replace(regexp_replace(line, '[^\P{Nd}0-9]', '0', 'g'), '[^\P{L}A-Za-z]|[^\P{N}0-9]', 'x', 'g')"
_HITS = f"len(regexp_extract_all({_PLAIN}, '{T.CONTACT}'))"
_SIGNED = "(" + " + ".join(f"contains(' ' || {S.norm('line')} || ' ', ' {w} ')::INT" for w in T.SIGNATURE_TOKENS) + ")"
_BOILER = f"({S.norm('line')} <> '' AND (({_SIGNED} >= 3 AND {_HITS} >= 1) OR {_HITS} >= 2 OR ({_HITS} >= 1 AND length(line) - length(replace(line, ',', '')) >= 4 AND len({S.tokens('line', 1)}) >= 8)))"
_DOC_LINES = "SELECT doc_id, trim(l) AS line FROM documents, unnest(string_split(text, chr(10))) AS u(l) WHERE trim(l) <> ''"


@query(f"SELECT doc_id, count(*)::BIGINT AS n_lines, sum({_BOILER}::INT)::BIGINT AS n_boilerplate FROM ({_DOC_LINES}) GROUP BY doc_id")
def boilerplate_lines(t, spark):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.btrim("line").alias("line")).where("line <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(T.boilerplate_line(F.col("line")).cast("long")).alias("n_boilerplate"))


_STRIP = rf"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (
 SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, 'vtr\s*&?\s*beyond.*?(technical\s+data\s+sheet)', '\1', 'gis'), '[\n\r\f]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents)),
b AS (SELECT *, {_BOILER} AS boiler FROM l), e AS (SELECT doc_id, min(i) AS a, max(i) AS z FROM b WHERE NOT boiler GROUP BY doc_id),
k AS (SELECT b.doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM b JOIN e USING (doc_id) WHERE i BETWEEN a AND z GROUP BY b.doc_id),
j AS (SELECT d.doc_id, text, coalesce(kept, '') AS kept FROM documents d LEFT JOIN k USING (doc_id)),
r AS (SELECT *, kept <> '' AND len(list_filter(string_split({S.norm('kept')}, ' '), lambda x: x <> '')) >= 10 AND length(text) > length(kept) AS ok FROM j)
SELECT doc_id, md5(CASE WHEN ok THEN kept ELSE text END) AS text_md5, ok AS removed, (CASE WHEN ok THEN length(text) - length(kept) ELSE 0 END)::BIGINT AS removed_chars FROM r"""


@query(_STRIP)
def boilerplate_strip(t, spark):
    return C.settled_columns(t("documents").select("doc_id", "text"), b=T.without_boilerplate(F.col("text"))).select("doc_id", F.md5("b.text").alias("text_md5"), "b.removed", "b.removed_chars")


_PIPES = [(r"(?:\s*\|\s*){2,}", " | "), (r"\|\s*\|\s*\|+", "|"), (r"\s*\|\s*", "; "), (r"(?:;\s*){2,}", "; "), (r"^\s*;\s*|\s*;\s*$", "")]


@query(f"SELECT doc_id, md5(CASE WHEN contains(text, '|') THEN {S.squeeze(S.rewrites('text', _PIPES))} ELSE text END) AS text_md5 FROM documents")
def pipe_cleanup(t, spark):
    return t("documents").select("doc_id", F.md5(T.without_pipes(F.col("text"))).alias("text_md5"))


@query(f"SELECT doc_id, len(list_filter(string_split(regexp_replace({S.squeeze('text')}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::BIGINT AS n_sentences FROM documents")
def sentences(t, spark):
    return t("documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("SELECT doc_id, count(*)::BIGINT AS n_items FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '^[\\-\\*•\\d]+[\\.)]?\\s+') GROUP BY doc_id")
def list_items(t, spark):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    return lines.where(T.list_item(F.col("l"))).groupBy("doc_id").agg(F.count("*").alias("n_items"))


_PHRASES = "SELECT * FROM (VALUES (1, 'VTR & Beyond, Pingbei Zhuhai.  Technical  Data Sheet HCF 600'), (2, 'Section: S1; Pour pain, dosage recommande: 5-40 ppm. Observation: rien.'), (3, 'plain')) AS v(id, text)"


@query(f"SELECT id, regexp_replace(text, 'vtr\\s*&?\\s*beyond.*?(technical\\s+data\\s+sheet)', '\\1', 'gis') AS text FROM ({_PHRASES})")
def signature_collapse(t, spark):
    return spark.sql(_PHRASES).select("id", T.without_signature(F.col("text")).alias("text"))


@query(f"SELECT id, CASE WHEN id = 2 THEN 'Dans la section « S1 », la recommandation pour « pain » indique un dosage de 5-40 ppm. Cette recommandation est accompagnee de la remarque suivante : rien.' ELSE text END AS text FROM ({_PHRASES})")
def machine_phrase_rewrite(t, spark):
    return spark.sql(_PHRASES).select("id", T.machine_phrases(F.col("text")).alias("text"))


def _tables(spark):
    rows = [
        (1, "Dosages Recommandes", [["Type de Production", "Dosage (ppm)", "Observations"], ["Pain de mie", "5-40", "avec soin"], ["", "", "encore"], ["Biscuit sec", "10 ppm", ""]]),
        (2, "Food Safety Data", [["Category", "Parameter", "Limit"], ["Heavy metals", "Lead", "5 mg/kg"], ["Micro", "", "absent"]]),
        (3, "Table Data", [["Field: value of it"], ["ab", ""]]),
    ]
    return spark.createDataFrame(rows, "table_id int, section string, rows array<array<string>>")


@query("SELECT * FROM (VALUES (1, 'Type de Production|Dosage (ppm)|Observations/Pain de mie|5-40|avec soin encore/Biscuit sec|10 ppm|'), (2, 'Category|Parameter|Limit/Heavy metals|Lead|5 mg/kg/Micro||absent'), (3, 'Field: value of it ab|')) AS v(table_id, merged) WHERE table_id < 3")
def wrapped_rows(t, spark):
    m = _tables(spark).where("table_id < 3").select("table_id", C.merged_rows(F.col("rows")).alias("m"))
    return m.select("table_id", F.array_join(F.transform("m", lambda r: F.array_join(r, "|")), "/").alias("merged"))


_TABLE_KV = """SELECT * FROM (VALUES
(1, 'Pain de mie', 'Dans la section « Dosages Recommandes », la recommandation pour « Pain de mie » indique un dosage de 5-40 ppm. Cette recommandation est accompagnee de la remarque suivante : avec soin encore.'),
(1, 'Biscuit sec', 'Dans la section « Dosages Recommandes », la recommandation pour « Biscuit sec » indique un dosage de 10 ppm. Aucune remarque complementaire n''est precisee.'),
(2, 'Heavy metals', 'Dans la section « Food Safety Data », le champ « Heavy metals » contient l''information suivante : Category=Heavy metals ; Parameter=Lead ; Limit=5 mg/kg.'),
(2, 'Micro', 'Dans la section « Food Safety Data », le champ « Micro » contient l''information suivante : Category=Micro ; Parameter=absent.')) AS v(table_id, field, sentence)"""


@query(_TABLE_KV)
def table_kv(t, spark):
    return C.table_fields(_tables(spark).where("table_id < 3")).select("table_id", "field", "sentence")


@query(f"SELECT table_id, md5(string_agg(sentence, ' ' ORDER BY field DESC)) AS summary_md5 FROM ({_TABLE_KV}) WHERE table_id = 1 GROUP BY table_id")
def table_summary(t, spark):
    rows = C.table_fields(_tables(spark).where("table_id = 1"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "sentence")))
    return rows.groupBy("table_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["sentence"]), " ")).alias("summary_md5"))


_ALL = S.norm("doc_id || ' ' || file_name || ' ' || text")


def _codes_sql(n: str, toks: str, token: str, phrases) -> str:
    lists = [f"list_filter({toks}, lambda x: regexp_matches(x, '{token}'))", *[f"regexp_extract_all({n}, '{p}', {g})" for p, g in phrases]]
    every = lists[0]
    for x in lists[1:]:
        every = f"list_concat({every}, {x})"
    return f"array_to_string(list_sort(list_distinct(list_transform({every}, lambda x: regexp_replace(regexp_replace(regexp_replace({S.norm('x')}, '[ -]', '', 'g'), '^asoft', 'soft'), '^afresh', 'fresh')))), ',')"


_DOC_CODES = _codes_sql("a", "string_split(a, ' ')", E.DOC_TOKEN_CODE, [(E.MAX_CODE, 0), (E.SOFT_CODE, 1), (E.NUMBER_CODE, 0), (E.GO_CODE, 0)])
_P = "(' ' || a || ' ')"
_FAMILY = f"""CASE WHEN contains(a, 'acide ascorbique') OR contains({_P}, ' e300 ') THEN 'ascorbic' WHEN contains({_P}, ' hcf ') OR (contains({_P}, ' xylanase ') AND contains(a, 'hcf')) THEN 'hcf'
 WHEN contains({_P}, ' hcb ') THEN 'hcb' WHEN contains({_P}, ' tg ') OR contains(a, 'transglutaminase') THEN 'tg' WHEN contains({_P}, ' gox ') OR contains({_P}, ' glucose oxidase ') THEN 'gox'
 WHEN contains(a, ' go max ') THEN 'go' WHEN contains({_P}, ' af ') OR (contains(a, 'amylase') AND contains(a, 'af')) THEN 'af' WHEN contains({_P}, ' amg ') OR contains(a, 'amyloglucosidase') THEN 'amg'
 WHEN contains({_P}, ' lipase ') OR contains(a, ' l max ') OR regexp_matches(a, '\\bl(?:55|65)\\b') THEN 'lipase' WHEN contains({_P}, ' fresh ') OR contains({_P}, ' soft ') THEN 'fresh_soft' ELSE 'other' END"""
_SECTION = "CASE " + " ".join(f"WHEN {_any('a', parts)} THEN '{name}'" for name, parts in E.SECTIONS) + " END"
_SPEC_NORM = f"WITH spec AS ({S.SPEC}), s AS (SELECT *, {_ALL} AS a FROM spec)"


def spec_norm(t, spark):
    return spec(t, spark).withColumn("a", T.normal_token(F.concat_ws(" ", "doc_id", "file_name", "text")))


@query(f"{_SPEC_NORM} SELECT k, {_DOC_CODES} AS codes FROM s")
def model_codes_doc(t, spark):
    return spec_norm(t, spark).select("k", F.array_join(E.doc_codes(F.col("a")), ",").alias("codes"))


@query(f"{_SPEC_NORM} SELECT k, {_FAMILY} AS family, {_SECTION} AS section FROM s")
def product_family_section(t, spark):
    return spec_norm(t, spark).select("k", E.family(F.col("a")).alias("family"), E.section(F.col("a")).alias("section"))


_CLASS = "CASE " + " ".join(f"WHEN {_any(S.norm('text'), parts)} THEN '{name}'" for name, parts in E.PRODUCTS) + " ELSE 'other' END"


@query(S.over_spec(f"k, {_CLASS} AS product"))
def product_class(t, spark):
    return spec(t, spark).select("k", E.product_class(F.col("text")).alias("product"))


@query(S.over_spec(f"k, trim(regexp_replace(regexp_replace(regexp_replace({S.norm('doc_id')}, '\\btds\\b', ' ', 'g'), '\\bpdf\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS canonical, regexp_replace(file_name, '\\.[^.]*$', '') AS stem"))
def doc_id_canonical(t, spark):
    return spec(t, spark).select("k", E.canonical_doc_id(F.col("doc_id")).alias("canonical"), E.stem(F.col("file_name")).alias("stem"))


_DOSES = ", ".join(f"nullif(regexp_extract(a, '{p}', 1), '') AS {k}" for k, p in E.DOSAGES.items())


@query(f"{_SPEC_NORM} SELECT k, {_DOSES} FROM s")
def dosage_fields(t, spark):
    return spec_norm(t, spark).select("k", *[c.alias(k) for k, c in E.dosages(F.col("a")).items()])


_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR))"


@query(f"SELECT doc_id, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM (SELECT doc_id, {_UUID} AS h FROM documents)")
def uuid5_point_id(t, spark):
    return t("documents").select("doc_id", E.uuid5_url(F.col("doc_id").cast("string")).alias("point_id"))


_UNIT_SQL = [(p, r.replace("$", "\\")) for p, r in A.UNIT_RULES]


def unit_sql(x: str) -> str:
    return S.squeeze(S.rewrites(x, _UNIT_SQL, "gi"))


def answer_sql(x: str) -> str:
    """Dots next to a digit are set aside, the others taken off, and the first put back."""
    u = S.rewrites(unit_sql(f"replace(lower(strip_accents({x})), '’', chr(39))"), [(r"[^a-z0-9%/\-.\s]", " "), (r"([0-9])\.", r"\1~"), (r"\.([0-9])", r"~\1"), (r"\.", " ")])
    return S.squeeze(f"replace({u}, '~', '.')")


@query(S.over_spec(f"k, {unit_sql('text')} AS unit_text"))
def unit_string(t, spark):
    return spec(t, spark).select("k", A.unit_string(F.col("text")).alias("unit_text"))


@query(S.over_spec(f"k, {answer_sql('text')} AS norm"))
def answer_norm(t, spark):
    return spec(t, spark).select("k", A.answer_norm(F.col("text")).alias("norm"))


_TEXTS = "SELECT * FROM (VALUES (1, 'Contains milk and eggs'), (2, 'nothing of it'), (3, 'Wheat, hazelnut; soybean'), (4, 'Lactose; dairy. Almond'), (5, 'butter')) AS v(id, text)"
ALLERGENS_SQL = lambda n, sep: f"array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({n}, '\\b(?:{'|'.join(t)})\\b') THEN '{name}' END" for name, t in A.ALLERGENS) + f"], lambda z: z IS NOT NULL), '{sep}')"


@query(f"SELECT id, {ALLERGENS_SQL('n', ',')} AS found FROM (SELECT id, {answer_sql('text')} AS n FROM ({_TEXTS}))")
def allergens(t, spark):
    return spark.sql(_TEXTS).select("id", F.array_join(A.allergens(A.answer_norm(F.col("text"))), ",").alias("found"))


def metals_sql(n: str) -> str:
    """Limits by metal and then by place, each once, from a normal form."""
    body = f"replace({unit_sql(n)}, ',', '.')"
    of = lambda m: f"list_transform(regexp_extract_all({body}, '{m}[^.\\n;]{{0,80}}?(?:<=|>=|<|>)?\\s*\\d+(?:\\.\\d+)?\\s*mg/kg'), lambda z: '{m} ' || regexp_extract(z, '(<=|>=|<|>)?\\s*(\\d+(?:\\.\\d+)?)\\s*mg/kg$', 1) || regexp_extract(z, '(<=|>=|<|>)?\\s*(\\d+(?:\\.\\d+)?)\\s*mg/kg$', 2) || ' mg/kg')"
    every = of(A.METALS[0])
    for m in A.METALS[1:]:
        every = f"list_concat({every}, {of(m)})"
    return f"array_to_string({every}, '; ')"  # no sheet says a limit twice


@query(S.over_spec(f"k, {metals_sql(answer_sql('text'))} AS limits"))
def metal_limits(t, spark):
    return spec(t, spark).select("k", F.array_join(A.metal_limits(A.answer_norm(F.col("text"))), "; ").alias("limits"))


_CODES = "SELECT * FROM (VALUES (1, 'A Soft 305'), (2, 'hcf-600'), (3, 'A Fresh 101'), (4, 'L Max64'), (5, 'SOFT  205'), (6, 'GOX 110®'), (7, '')) AS v(id, code)"


@query(f"SELECT id, regexp_replace(regexp_replace(regexp_replace({S.norm('code')}, '[ -]', '', 'g'), '^asoft', 'soft'), '^afresh', 'fresh') AS canonical FROM ({_CODES})")
def canonical_code(t, spark):
    return spark.sql(_CODES).select("id", E.canonical_code(F.col("code")).alias("canonical"))


_HEADS = """SELECT * FROM (VALUES (1, 'Tel: 123 456 www.x.org, mail us'), (2, concat('Tel: +32 123 456, mail a@b.org, x, y', chr(10), 'Title of it', chr(10), 'one two three four five six seven eight nine ten eleven', chr(10), 'phone www.y.org')),
(3, concat('www.x.org a@b.org', chr(10), 'too few words')), (4, '')) AS v(doc_id, text)"""


@query(_STRIP.replace("FROM documents", "FROM heads").replace("WITH l AS", f"WITH heads AS ({_HEADS}), l AS", 1))
def boilerplate_revert(t, spark):
    """Boilerplate at head and tail goes, but for texts of which too little would be left."""
    return C.settled_columns(spark.sql(_HEADS), b=T.without_boilerplate(F.col("text"))).select("doc_id", F.md5("b.text").alias("text_md5"), "b.removed", "b.removed_chars")


@query()
def pandas_embedder(t, spark):
    """Vectors of every document by a batch function; its values are the model's own, so there is no SQL for them."""
    v = M.embedder(M.hashed_letters())(F.col("text"))
    return t("documents").select("doc_id", v.alias("vector")).select("doc_id", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("length"))
