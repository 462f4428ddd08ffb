"""Queries on search: dense, analysis of questions, scores, ranking, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import answer as A
from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import dense as D
from siltstone.operators import ranking as R
from siltstone.operators import retrieve as V

from . import sql as S
from .registry import query
from .text_queries import _ALL, _DOC_CODES, _DOSES, _FAMILY, _BOILER, _SECTION, ALLERGENS_SQL, answer_sql, metals_sql, spec, unit_sql

# Words of each dimension of the keyword vectors.
KEYWORDS = (
    ("dosage", "dose", "recommande", "recommended", "optimum", "max"), ("bread", "pain", "panification", "mie", "bakery"), ("hcf", "hcb", "xylanase"), ("ascorbique", "e300", "vitamine", "acide"),
    ("allergens", "gluten"), ("heavy", "metals", "cadmium", "lead", "mg/kg"), ("storage", "stockage", "durability", "months", "mois", "temperature", "humidite"), ("ppm",), ("gox", "glucose", "oxidase", "go"),
    ("tg", "transglutaminase"), ("af110", "af220", "af330", "amylase", "fau", "skb"), ("amg", "amyloglucosidase", "agi"), ("fresh", "soft", "nmau"), ("lipase", "lmax", "l55", "l65"),
    ("regulation", "autorise", "directive", "codex", "innorpi"), ("conversion", "kg", "grammes", "g", "ph"),
)


def questions(spark):
    return spark.sql(S.QUESTIONS)


def _vectors(t):
    e = t("embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_COS = "round(coalesce(list_inner_product(q.v, e.v) / nullif(sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v)), 0), 0), 12)"
_DENSE = f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
hits AS (SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id AS id, e.label, {_COS} AS s FROM e AS q, e WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits)"""


@query(f"WITH {_DENSE} SELECT query_id, id, round(s, 6) AS score, r::INTEGER AS rank FROM ranked WHERE r <= 10")
def flagship_dense_topk(t, spark):
    """The ten nearest vectors of every query vector."""
    return D.dense_topk(*_vectors(t), 10).select("query_id", "id", F.round("dense_score", 6).alias("score"), F.col("dense_rank").alias("rank"))


@query(f"WITH {_DENSE}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, id) AS n FROM ranked WHERE r <= 60) SELECT query_id, label, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS rank FROM d WHERE n = 1")
def dense_doc_fusion(t, spark):
    top = _labelled(t, 60)
    return R.post_passes(top, "final", doc="label").select("query_id", "label", F.col("chunk_id").alias("id"), F.round("final", 6).alias("score"), "rank")


def _labelled(t, k):
    labels = t("embeddings").select(F.col("vec_id").alias("id"), "label")
    return D.dense_topk(*_vectors(t), k).join(labels, "id").select("query_id", F.col("id").alias("chunk_id"), "label", F.col("dense_score").alias("final"))


@query(f"WITH {_DENSE}, d AS (SELECT *, s * greatest(0, 1 - 0.1 * (row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, id) - 1)) AS p FROM ranked WHERE r <= 20) SELECT query_id, id, round(p, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, id)::INTEGER AS rank FROM d")
def dense_diversity(t, spark):
    return R.post_passes(_labelled(t, 20), "final", by_doc=False, penalty=0.1, doc="label").select("query_id", F.col("chunk_id").alias("id"), F.round("final", 6).alias("score"), "rank")


@query("WITH b AS (SELECT vec_id + 5 AS vec_id, label FROM embeddings WHERE vec_id % 2 = 0) SELECT vec_id, label FROM b UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM b)")
def upsert_last_wins(t, spark):
    e = t("embeddings").select("vec_id", "label")
    batch = e.where("vec_id % 2 = 0").select((F.col("vec_id") + 5).alias("vec_id"), "label")
    twice = batch.withColumn("n", F.lit(1)).unionByName(batch.select("vec_id", F.lit(-1).alias("label")).withColumn("n", F.lit(0)))
    return D.upsert(e.withColumn("n", F.lit(0)), twice, "vec_id", "n").drop("n")


def _kw(x: str) -> str:
    tok = S.tokens(x, 1)
    parts = [f"len(list_intersect({tok}, ['{chr(39).join(w).replace(chr(39), chr(39) + ',' + chr(39))}'])) > 0" + (f" OR contains({x}, '%')" if k == 7 else "") for k, w in enumerate(KEYWORDS)]
    return " || ".join(f"({p})::INT::VARCHAR" for p in parts)


@query(S.over_spec(f"k, {_kw('text')} AS flags"))
def keyword_embedder(t, spark):
    own = _with_vector(spec(t, spark).select("k", "text"), "text")
    return own.select("k", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), "").alias("flags"))


def _has(words) -> str:
    return "len(list_intersect(tok, [" + ", ".join(f"'{w}'" for w in words) + "])) > 0"


def _codes_sql() -> str:
    every = f"list_filter(tok, lambda x: regexp_matches(x, '{E.QUERY_TOKEN_CODE}'))"
    for p, g in ((E.MAX_CODE, 0), (E.SOFT_CODE, 1), (E.QUERY_NUMBER_CODE, 0)):
        every = f"list_concat({every}, regexp_extract_all(nq, '{p}', {g}))"
    return f"list_sort(list_distinct(list_transform({every}, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[ -]', '', 'g'), '^asoft', 'soft'), '^afresh', 'fresh'))))"


_FAM = f"list_sort(list_distinct(list_concat(list_intersect(tok, {list(E.FAMILY_TOKENS)}), list_concat(CASE WHEN {_has(('fresh', 'soft'))} THEN ['fresh_soft'] ELSE [] END, CASE WHEN list_contains(tok, 'lipase') THEN ['lipase'] ELSE [] END))))"
_PROFILE = f"""questions AS ({S.QUESTIONS}), q0 AS (SELECT *, {S.norm('question')} AS nq, {S.tokens('question')} AS tok FROM questions),
q AS (SELECT *, {_codes_sql()} AS codes, {_FAM} AS fams, {', '.join(f'{_has(w)} AS {k}' for k, w in R.ASKS.items())}, list_contains(tok, 'improvement') AND list_contains(tok, 'bread') AS asks_bread_improvement FROM q0),
p AS (SELECT *, len(codes) = 0 AS broad_mode, CASE WHEN len(codes) > 0 THEN 'code_specific' WHEN asks_storage OR asks_safety OR asks_regulatory THEN 'compliance_storage_safety' WHEN asks_activity THEN 'activity' ELSE 'broad' END AS route FROM q)"""
_FLAGS = [*R.ASKS, "asks_bread_improvement", "broad_mode"]


@query(f"WITH {_PROFILE} SELECT query_id, array_to_string(codes, ',') AS codes, array_to_string(fams, ',') AS families, {', '.join(_FLAGS)} FROM p")
def query_profile(t, spark):
    return R.profile(questions(spark)).select("query_id", F.array_join("codes", ",").alias("codes"), F.array_join("families", ",").alias("families"), *_FLAGS)


@query(f"WITH {_PROFILE} SELECT query_id, route, CASE route WHEN 'compliance_storage_safety' THEN 0.58 ELSE 0.65 END::DOUBLE AS dense, CASE WHEN route IN ('code_specific', 'activity') THEN 100 ELSE 50 END::INTEGER AS pool FROM p")
def route_params(t, spark):
    table = spark.createDataFrame([(n, d, p) for n, d, _, _, p in R.ROUTES], "route string, dense double, pool int")
    return R.profile(questions(spark)).select("query_id", R.route().alias("route")).join(F.broadcast(table), "route")  # four rows


@query(f"WITH {_PROFILE} SELECT query_id, round(d / (d + x + f), 6) AS dense_w, round(x / (d + x + f), 6) AS lexical_w, round(f / (d + x + f), 6) AS field_w FROM (SELECT query_id, CASE WHEN broad_mode THEN 0.58::DOUBLE ELSE 0.63::DOUBLE END AS d, CASE WHEN broad_mode THEN 0.32::DOUBLE ELSE 0.29::DOUBLE END AS x, CASE WHEN broad_mode THEN 0.10::DOUBLE ELSE 0.08::DOUBLE END AS f FROM p)")
def dynamic_weights(t, spark):
    w = R.weights(F.lit(0.58), F.lit(0.32), F.lit(0.10))
    return R.profile(questions(spark)).select("query_id", *w).select("query_id", *[F.round(c, 6).alias(c) for c in ("dense_w", "lexical_w", "field_w")])


@query(f"WITH {_PROFILE} SELECT query_id, greatest(30, CASE WHEN NOT broad_mode THEN 24 WHEN asks_storage OR asks_safety OR asks_activity THEN 50 ELSE 40 END)::INTEGER AS fetch_k FROM p")
def adaptive_fetch_k(t, spark):
    return R.profile(questions(spark)).select("query_id", R.fetch_k(10, 3, 10).cast("int").alias("fetch_k"))


def _pairs(t, spark):
    """Every passage with every question: the questions are a stated set of twelve rows."""
    s = spec(t, spark).select(F.col("k").alias("chunk_id"), "doc_id", "file_name", "text")
    return R.passages(s).crossJoin(F.broadcast(R.profile(questions(spark))))


_LEX = "least(1.0::DOUBLE, 0.75::DOUBLE * (m / greatest(nq, 1)) + 0.25::DOUBLE * (m / greatest(nt, 1)) * 4)"


@query(f"WITH {_PROFILE}, spec AS ({S.SPEC}), own AS (SELECT k, {S.tokens('text')} AS own FROM spec), c AS (SELECT query_id, k, len(list_intersect(tok, own)) AS m, len(tok) AS nq, len(own) AS nt FROM own, p) SELECT query_id, k AS chunk_id, round(CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE {_LEX} END, 6) AS score FROM c")
def lexical_score(t, spark):
    return _pairs(t, spark).select("query_id", "chunk_id", F.round(R.lexical_score(F.col("tokens"), F.col("own_tokens")), 6).alias("score"))


_NT = S.norm("text")


def _in(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


_FIELD = f"greatest(0, least(1.5, CASE WHEN bread THEN CASE WHEN {_in('n', ('pain', 'panification', 'bread'))} THEN 1.0 WHEN {_in('n', ('biscuit', 'viennoiserie'))} THEN -0.3 ELSE 0.0 END ELSE 0 END + CASE WHEN dosage AND {_in('n', ('dosage', 'ppm'))} THEN 0.5 ELSE 0 END + CASE WHEN limits AND {_in('n', ('maximum', 'autorise'))} THEN 0.5 ELSE 0 END))::DOUBLE"


@query(f"WITH {_PROFILE}, spec AS ({S.SPEC}), o AS (SELECT k, {_NT} AS n FROM spec) SELECT query_id, k AS chunk_id, round({_FIELD}, 6) AS score FROM o, p")
def field_intent_score(t, spark):
    return _pairs(t, spark).select("query_id", "chunk_id", F.round(R.field_intent_score(F.col("text_norm"), F.col("product")), 6).alias("score"))


_NAME = S.norm("doc_id || ' ' || file_name")
_HEAD = S.tokens("doc_id || ' ' || file_name || ' ' || left(text, 320)")
_OWN_CODES = _codes_sql().replace("tok,", "head,").replace("nq,", "nn,")
_SCORED = f"""WITH {_PROFILE}, spec AS ({S.SPEC}), s0 AS (SELECT *, {_ALL} AS a, {_NAME} AS nn, {_HEAD} AS head, {S.tokens('text')} AS own, {_NT} AS n, {S.norm('left(text, 180)')} AS n180 FROM spec),
s1 AS (SELECT *, {_FAMILY} AS family, {_SECTION} AS sec, {_DOC_CODES} AS meta, {_DOSES} FROM s0),
s AS (SELECT *, CASE WHEN meta <> '' THEN string_split(meta, ',') ELSE {_OWN_CODES} END AS dcodes, list_concat({_FAM.replace('tok,', 'head,')}, [family]) AS dfams, contains(nn, 'acide ascorbique') AS dasc FROM s1),
c AS (SELECT s.*, p.* FROM s, p),
x AS (SELECT *, greatest(-0.20, least(0.35,
  CASE WHEN len(fams) > 0 AND family <> 'other' THEN CASE WHEN list_contains(fams, family) THEN 0.10 ELSE -0.16 END ELSE 0 END
  + CASE WHEN asks_standardization AND dosage_standardization IS NOT NULL THEN 0.18 ELSE 0 END + CASE WHEN asks_bread_improvement AND dosage_bread_improvement IS NOT NULL THEN 0.18 ELSE 0 END
  + CASE WHEN asks_optimum AND (dosage_suggested_optimum IS NOT NULL OR dosage_suggested IS NOT NULL) THEN 0.18 ELSE 0 END
  + CASE WHEN asks_regulatory AND (dosage_max_authorized IS NOT NULL OR coalesce(sec = 'regulatory', false)) THEN 0.16 ELSE 0 END
  + CASE WHEN asks_storage AND coalesce(sec = 'storage', false) THEN 0.14 ELSE 0 END + CASE WHEN asks_safety AND coalesce(sec = 'food_safety', false) THEN 0.16 ELSE 0 END
  + CASE WHEN asks_activity AND contains(n180, 'activity') THEN 0.14 ELSE 0 END))::DOUBLE AS structured,
 greatest(-0.60, least(1.00,
  CASE WHEN len(codes) = 0 THEN 0 WHEN len(list_intersect(codes, dcodes)) > 0 THEN 0.50 + 0.20 * least(2, len(list_intersect(codes, dcodes))) WHEN len(dcodes) > 0 THEN -0.05 ELSE -0.035 END
  + CASE WHEN len(list_intersect(fams, dfams)) > 0 THEN 0.25 ELSE 0 END + CASE WHEN ascorbic AND dasc THEN 0.20 WHEN ascorbic THEN -0.20 WHEN dasc AND len(fams) > 0 THEN -0.45 ELSE 0 END
  + CASE WHEN asks_storage THEN CASE WHEN sec = 'storage' THEN 0.10 WHEN sec IS NOT NULL THEN -0.02 ELSE 0 END ELSE 0 END
  + CASE WHEN asks_safety THEN CASE WHEN sec = 'food_safety' THEN 0.12 WHEN sec IS NOT NULL THEN -0.02 ELSE 0 END ELSE 0 END
  + CASE WHEN asks_regulatory THEN CASE WHEN sec = 'regulatory' THEN 0.08 WHEN sec IS NOT NULL AND sec <> 'dosage' THEN -0.016 ELSE 0 END ELSE 0 END))::DOUBLE AS specific FROM c)"""


@query(f"{_SCORED} SELECT query_id, k AS chunk_id, round(structured, 6) AS score FROM x")
def structured_score(t, spark):
    return _pairs(t, spark).select("query_id", "chunk_id", F.round(R.structured_score(), 6).alias("score"))


@query(f"{_SCORED} SELECT query_id, k AS chunk_id, round(specific, 6) AS score FROM x")
def doc_specific_score(t, spark):
    return _pairs(t, spark).select("query_id", "chunk_id", F.round(R.doc_specific_score(), 6).alias("score"))


def _with_vector(rows, text: str):
    """rows with the keyword vector of a text."""
    own = C.settled_columns(rows, __tokens=T.token_set(F.col(text), 1))
    return own.withColumn("vector", D.keyword_vector(F.col("__tokens"), F.col(text), KEYWORDS, 7)).drop("__tokens")


def swept(t, spark):
    """The questions with what they ask for, and their hundred nearest sheets with what scoring reads, the only ones whose texts are scored."""
    sheets = spec(t, spark).select(F.col("k").cast("long").alias("chunk_id"), "doc_id", "file_name", "text")
    asked = _with_vector(V.asked(questions(spark), 10, V.Search()), "question")
    own = _with_vector(sheets, "text").select(F.col("chunk_id").alias("id"), "vector")
    top = D.dense_topk(own, asked.select("query_id", "vector"), V.most_candidates(10, V.Search()))
    hits = top.join(F.broadcast(asked.drop("vector")), "query_id")  # the questions are a stated set of twelve rows
    return asked, R.passages(sheets.join(F.broadcast(hits), F.col("chunk_id") == F.col("id")))  # no more rows than 100 a question


def hybrid(t, spark):
    """Final scores of each question's candidates: its fetch_k nearest sheets."""
    rows = swept(t, spark)[1].where("dense_rank <= fetch_k")
    lex, field = R.lexical_score(F.col("tokens"), F.col("own_tokens")), R.field_intent_score(F.col("text_norm"), F.col("product"))
    scored = C.settled_columns(rows, lex=lex, field=field, extra=R.doc_specific_score() + R.structured_score())
    return scored.withColumn("final", F.col("dense_w") * F.col("dense_score") + F.col("lexical_w") * F.col("lex") + F.col("field_w") * F.col("field") + F.col("extra"))


def _vec(x: str) -> str:
    """The keyword vector as a list of doubles."""
    return "list_transform(string_split(" + _kw(x) + ", ''), lambda z: z::DOUBLE)"


_W_SQL = "(CASE WHEN broad_mode THEN CASE WHEN route = 'compliance_storage_safety' THEN [0.58, 0.32, 0.10] ELSE [0.65, 0.25, 0.10] END ELSE [0.70, 0.22, 0.08] END)::DOUBLE[]"
_HYBRID = f"""{_SCORED}, qv AS (SELECT query_id, {_vec('question')} AS qv FROM p), sv AS (SELECT k, {_vec('text')} AS v FROM spec),
near AS (SELECT query_id, k, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, k) AS dr FROM (SELECT query_id, k, round(coalesce(list_inner_product(qv, v) / nullif(sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(v, v)), 0), 0), 12) AS cos FROM qv, sv)),
y AS (SELECT x.*, cos, {_W_SQL} AS w, len(list_intersect(tok, own)) AS m, len(tok) AS nqt, len(own) AS nt FROM x JOIN near USING (query_id, k) WHERE dr <= CASE WHEN route IN ('code_specific', 'activity') THEN 100 ELSE 50 END),
f AS (SELECT *, round(w[1] / list_sum(w) * coalesce(cos, 0) + w[2] / list_sum(w) * (CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE {_LEX.replace('nq,', 'nqt,')} END) + w[3] / list_sum(w) * {_FIELD} + specific + structured, 9) AS final FROM y),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY final DESC, k) AS nd FROM f)
SELECT query_id, k AS chunk_id, round(final, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, k) AS rank FROM d WHERE nd = 1) WHERE rank <= 10"""


@query(_HYBRID)
def hybrid_rank(t, spark):
    rows = hybrid(t, spark).select("query_id", "chunk_id", "doc_id", F.round("final", 9).alias("final"))
    return R.post_passes(rows, "final").where("rank <= 10").select("query_id", "chunk_id", F.round("final", 6).alias("score"), "rank")


_PLAIN_FINAL = _HYBRID[: _HYBRID.index("round(w[1]")] + "round(cos + specific + structured, 9) AS final" + _HYBRID[_HYBRID.index(" FROM y),") :]


@query(_PLAIN_FINAL)
def hybrid_off_rank(t, spark):
    """Without lexical and field scores: the dense score and what documents and sections add to it."""
    rows = hybrid(t, spark).select("query_id", "chunk_id", "doc_id", F.round(F.col("dense_score") + F.col("extra"), 9).alias("final"))
    return R.post_passes(rows, "final").where("rank <= 10").select("query_id", "chunk_id", F.round("final", 6).alias("score"), "rank")


_SPANS = """SELECT * FROM (VALUES (1, 'dosage of hcf', 'Tel: 123 456 www.x.org. The dosage is 5 ppm. Use hcf well.'), (2, 'shelf life', 'Nothing here. Shelf life of it; months.'), (3, 'abc', 'First one. Second one.'), (4, '', 'Only this.')) AS v(id, question, text)"""
_OWN_SCORE = f"len(list_intersect(asked, {S.tokens('line', 1)})) / greatest(len(asked), 1) + CASE WHEN len(list_intersect({S.tokens('line', 1)}, {list(A.SPAN_UNITS)})) > 0 THEN 0.2 ELSE 0 END"


@query(f"""WITH r AS (SELECT id, text, {S.tokens('question', 1)} AS asked, list_filter(string_split(regexp_replace({S.squeeze('text')}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM ({_SPANS})),
p AS (SELECT id, asked, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM r), o AS (SELECT id, line, i, CASE WHEN {_BOILER} THEN -1 ELSE {_OWN_SCORE} END AS score FROM p)
SELECT id, arg_max(line, (round(score, 9), -i)) AS span FROM o GROUP BY id""")
def best_span(t, spark):
    """The sentence that says most of what is asked, boilerplate passed over."""
    rows = C.settled_columns(spark.sql(_SPANS), asked=T.token_set(F.col("question"), 1), parts=T.sentences(F.col("text")))
    return rows.select("id", A.best_span(F.col("asked"), F.col("parts"), F.col("text")).alias("span"))


@query(f"WITH {_DENSE}, h AS (SELECT query_id, id, r, s, (id * 7919 % 101)::DOUBLE AS m FROM ranked WHERE r <= 30), x AS (SELECT *, min(CASE WHEN r <= 20 THEN m END) OVER (PARTITION BY query_id) AS lo, max(CASE WHEN r <= 20 THEN m END) OVER (PARTITION BY query_id) AS hi FROM h), b AS (SELECT *, CASE WHEN r <= 20 THEN 0.65 * s + 0.35 * (CASE WHEN hi = lo THEN 0.5 ELSE (m - lo) / (hi - lo) END) ELSE s END AS blend FROM x) SELECT query_id, id, round(blend, 6) AS blend, row_number() OVER (PARTITION BY query_id ORDER BY r > 20, blend DESC, r)::INTEGER AS new_rank FROM b")
def rerank_blend(t, spark):
    """With a stand-in for the model's score that both engines can work out."""
    top = D.dense_topk(*_vectors(t), 30).select("query_id", "id", F.col("dense_rank").alias("rank"), F.col("dense_score").alias("final"), (F.col("id") * 7919 % 101).cast("double").alias("model"))
    return R.blended(top).select("query_id", "id", F.round("blend", 6).alias("blend"), "new_rank")


@query("WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE role = 'system'), n AS (SELECT c.conv_id, c.turn, min(a.rank) AS anchor_rank FROM conversations c JOIN a ON a.conv_id = c.conv_id AND c.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY ALL) SELECT conv_id, turn, anchor_rank::BIGINT AS anchor_rank FROM n ANTI JOIN a USING (conv_id, turn)")
def context_expand(t, spark):
    c = t("conversations")
    anchors = c.where("role = 'system'").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return R.context(anchors.select("rank", "conv_id", "turn"), c, "conv_id", "turn").select("conv_id", "turn", F.col("anchor_rank").cast("long"))


_INTENT = "CASE " + " ".join(f"WHEN {_in(answer_sql('question'), parts)} THEN '{name}'" for name, parts in A.INTENTS) + " ELSE 'generic' END"


@query(S.over_questions(f"query_id, {_INTENT} AS intent"))
def answer_intent(t, spark):
    return questions(spark).select("query_id", A.intent(F.col("question")).alias("intent"))


def _take(x: str, pattern: str, form: str) -> str:
    """form with {1}, {2} for the groups where the pattern occurs, else null."""
    for k in (1, 2):
        form = form.replace(f"{{{k}}}", f"regexp_extract({x}, '{pattern}', {k})")
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN {form} END"


_SPREAD = rf"{A.NUMBER}\s*(?:-|to|–)\s*{A.NUMBER}\s*ppm"
_BOTH = "'dosage: ' || {1} || '-' || {2} || ' ppm'"
_CUE, _CUES = r"(?:dosage|dose|recommended|suggested|optimum)[^.\n]{0,120}?", r"(?:dosage|dose|recommended|suggested|optimum|application rate|addition level)[^.\n]{0,120}?"
_DEGREES = r"(\d+(?:\s*-\s*\d+)?)\s*c"
_BARE = lambda x: f"regexp_replace({x}, '\\s+', '', 'g')"
_UNITS_OF = rf"[^.\n]{{0,80}}?{A.NUMBER}\s*{A.ACTIVITY_UNITS}"
_HEAT = "'temperature: ' || " + _BARE("{1}") + " || ' c'"
_STORED = f"array_to_string(list_filter([{_take('n', r'(\d+(?:\s*-\s*\d+)?)\s*(months?|years?)', chr(39) + 'shelf life: ' + chr(39) + ' || ' + _BARE('{1}') + ' || ' + chr(39) + ' ' + chr(39) + ' || {2}')}, coalesce({_take('n', r'(?:below|under|<|<=|between)\s*' + _DEGREES, _HEAT)}, {_take('n', _DEGREES, _HEAT)}), {_take('n', r'humidity[^.\n]{0,30}?(?:<|<=|below|under)?\s*(\d+)\s*%', chr(39) + 'humidity: <' + chr(39) + ' || {1} || ' + chr(39) + '%' + chr(39))}], lambda z: z IS NOT NULL), '; ')"
_LISTED = ALLERGENS_SQL("n", ", ")
_RULE = f"list_filter(string_split(regexp_replace(body, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: {_in(answer_sql('z'), A.REGULATIONS)})[1]"
_FOUND = f"""CASE kind WHEN 'dosage' THEN {unit_sql('coalesce(' + ', '.join((_take('n', _CUE + _SPREAD, _BOTH), _take('n', _SPREAD, _BOTH), _take('n', _CUES + A.NUMBER + r'\s*(g/100kg|kg/t|%)', chr(39) + 'dosage: ' + chr(39) + ' || {1} || ' + chr(39) + ' ' + chr(39) + ' || {2}'))) + ')')}
 WHEN 'activity' THEN {unit_sql('coalesce(' + _take('u', 'activity' + _UNITS_OF, chr(39) + 'activity: ' + chr(39) + ' || {1} || ' + chr(39) + ' ' + chr(39) + ' || {2}') + ', ' + _take('u', r'(?:enzyme\s+activity|declared\s+activity|units?)' + _UNITS_OF, chr(39) + 'activity: ' + chr(39) + ' || {1} || ' + chr(39) + ' ' + chr(39) + ' || {2}') + ')')}
 WHEN 'metals' THEN nullif({metals_sql('n')}, '')
 WHEN 'allergen' THEN CASE WHEN {_LISTED} <> '' THEN 'allergens contains: ' || {_LISTED} END
 WHEN 'storage' THEN nullif({unit_sql(_STORED)}, '') WHEN 'regulatory' THEN {unit_sql(_RULE)} END"""
#: The sheets hold neither tables nor mostly boilerplate, so that the plain answer is the squeezed text.
_ANSWERS = f"""b AS (SELECT k, {S.squeeze('text')} AS body FROM spec), bn AS (SELECT *, {answer_sql('body')} AS n FROM b), bu AS (SELECT *, {unit_sql('n')} AS u FROM bn),
qi AS (SELECT query_id, {_INTENT} AS kind FROM questions), fo AS (SELECT query_id, k, body, kind, {_FOUND} AS found FROM bu, qi),
ans AS (SELECT query_id, k, coalesce(found, body) AS answer, CASE WHEN found IS NULL THEN 0.6 WHEN kind IN ('dosage', 'activity', 'metals') THEN 0.95 WHEN kind = 'regulatory' THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence FROM fo)"""


@query(f"WITH spec AS ({S.SPEC}), questions AS ({S.QUESTIONS}), {_ANSWERS} SELECT * FROM ans")
def structured_answer(t, spark):
    return V.answers(spec(t, spark).select("k", "text"), questions(spark)).select("query_id", "k", "answer", "confidence")


_TOP = _HYBRID[: _HYBRID.rindex("SELECT query_id, k AS chunk_id")].rstrip()


@query(f"""{_TOP}, {_ANSWERS}, r AS (SELECT query_id, k, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, k) AS rank FROM d WHERE nd = 1),
g AS (SELECT r.*, a.answer, round(0.35 / (1 + exp(-final)) + 0.65 * confidence, 8) AS score FROM r JOIN ans a USING (query_id, k) WHERE rank <= 10)
SELECT query_id, n::INTEGER AS rank, k AS chunk_id, score, answer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM g) WHERE n <= 3""")
def api_fused_top3(t, spark):
    rows = hybrid(t, spark).select("query_id", "question", "chunk_id", "doc_id", "text", F.round("final", 9).alias("final"))
    top = A.with_structured(R.post_passes(rows, "final").where("rank <= 10"), "question", "text")
    fused = top.withColumn("score", F.round(0.35 / (1 + F.exp(-F.col("final"))) + 0.65 * F.col("confidence"), 8))
    out = fused.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).where("n <= 3")
    return out.select("query_id", F.col("n").alias("rank"), "chunk_id", "score", "answer")
