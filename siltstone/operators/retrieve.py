"""Questions answered from chunks and their vectors: candidates, scores, ranks, neighbours, answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import answer as A
from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import dense as D
from siltstone.operators import evaluation as V
from siltstone.operators import ranking as R

RESULT = ("query_id", "rank", "chunk_id", "text", "score", "doc_id", "page", "dense_score", "lex_score", "field_score", "final_score", "matched_terms", "is_context")


@dataclass(frozen=True)
class Search:
    """How to search. With `routed`, what a question asks for sets weights, pool and penalties in place of these."""

    context: int = 1
    multiplier: int = 3
    pool: int = 60
    dense: float = 0.58
    lexical: float = 0.32
    field: float = 0.10
    hybrid: bool = True
    routed: bool = True
    adaptive: bool = True
    by_doc: bool = True
    diversity: float | None = None
    constraints: bool = True
    code_penalty: float = 0.10
    section_penalty: float = 0.08
    rerank_top: int = 20
    rerank_weight: float = 0.35


def point(chunk_id: Column) -> Column:
    """The long that stands for a content-addressed id of 16 hex digits."""
    return F.conv(chunk_id, 16, -10).cast("long")


def with_vectors(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Chunks with the vector of their text."""
    return chunks.withColumn("vector", embed(F.col("text")))


def asked(questions: DataFrame, k: int, config: Search) -> DataFrame:
    """(query_id, question, vector) with profile, route, weights and number of candidates."""
    q = R.profile(questions.where("query_id is not null").withColumn("question", F.coalesce("question", F.lit("")))).withColumn("route", R.route())
    q = C.settled_columns(q, **{c: F.col(c) for c in q.columns})
    if config.routed:
        pick = lambda n: F.element_at(F.create_map(*[F.lit(x) for r in R.ROUTES for x in (r[0], r[n])]), F.col("route"))
        dense, lexical, field, pool, multiplier = pick(1), pick(2), pick(3), pick(4), 4
    else:
        dense, lexical, field, pool, multiplier = F.lit(config.dense), F.lit(config.lexical), F.lit(config.field), F.lit(config.pool), config.multiplier
    least = F.greatest(F.lit(k), F.lit(k * max(1, multiplier)), pool)
    floor = F.when(~F.col("broad_mode"), 24).when(F.col("asks_storage") | F.col("asks_safety") | F.col("asks_activity"), 50).otherwise(40)
    return q.select("*", *R.weights(dense, lexical, field), (F.greatest(least, floor) if config.adaptive else least).alias("fetch_k"))


def most_candidates(k: int, config: Search) -> int:
    """A bound on fetch_k."""
    pool, multiplier = (max(r[4] for r in R.ROUTES), 4) if config.routed else (config.pool, config.multiplier)
    return max(k * max(1, multiplier), pool, 50)


def scored(hits: DataFrame, config: Search = Search()) -> DataFrame:
    """Candidates (a question's columns, a chunk's columns, dense_score) with lex_score, field_score, final_score, matched_terms."""
    named = F.concat_ws(" ", "doc_id", "file_name")
    own = hits.withColumnsRenamed({c: f"q_{c}" for c in ("norm", "tokens")})
    own = C.settled_columns(
        own, text_norm=T.normal_token(F.col("text")), name_norm=T.normal_token(named), head=T.normal_token(F.concat_ws(" ", named, F.substring("text", 1, 320))), head_norm=T.normal_token(F.substring("text", 1, 180))
    )
    split = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: F.length(x) > 1))
    own = C.settled_columns(own, own_tokens=split("text_norm"), head_tokens=split("head"))
    known = lambda k: F.col(f"metadata.{k}")
    codes = F.coalesce(known("model_codes_canonical"), known("model_codes"), F.array().cast("array<string>"))
    family = F.nullif(F.lower(F.coalesce(known("family_canonical"), known("product_family"))), F.lit(""))
    said = C.settled_columns(
        own,
        product=F.coalesce(known("product_type_canonical"), F.lit("")), product_family=F.lower(known("product_family")), section_canonical=F.lower(known("section_canonical")), **{d: F.nullif(known(d), F.lit("")) for d in E.DOSAGES},
        doc_codes=F.when(F.size(codes) > 0, codes).otherwise(E.query_codes(F.col("name_norm"), F.col("head_tokens"))), doc_families=F.array_compact(F.array_union(E.family_set(F.col("head_tokens")), F.array(family))),
        doc_ascorbic=F.contains("name_norm", F.lit("acide ascorbique")),
    )
    code, section = (R.CODE_PENALTY, R.SECTION_PENALTY) if config.routed else (config.code_penalty, config.section_penalty)
    lex = C.settled_columns(
        said, lex_score=R.lexical_score(F.col("q_tokens"), F.col("own_tokens")), matched_terms=F.array_sort(F.array_intersect("q_tokens", "own_tokens")), field_score=R.field_intent_score(F.col("text_norm"), F.col("product"))
    )
    base = F.col("dense_w") * F.col("dense_score") + F.col("lexical_w") * F.col("lex_score") + F.col("field_w") * F.col("field_score") if config.hybrid else F.col("dense_score")
    final = base + R.doc_specific_score(code, section, config.constraints) + R.structured_score()
    return C.settled_columns(lex, final_score=F.round(final, 9))  # so ties don't depend on the order of sums


def search(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, k: int, config: Search = Search(), model: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """RESULT rows: the k best chunks of each question, then their neighbours on the page.

    chunks: as prepare() gives them; vectors: (chunk_id, vector); questions: (query_id long, question, vector), a stated set.
    Chunks and vectors without a partner are left out; ties go by dense rank. model(question, text) re-ranks the first
    rerank_top. Neighbours within `context` places carry the scores of their first anchor. The chunk table is scanned once
    for candidates and once for neighbours; only candidates' texts are scored.
    """
    q = asked(questions, k, config)
    top = D.dense_topk(vectors.select(point(F.col("chunk_id")).alias("id"), "vector"), questions.select("query_id", "vector"), most_candidates(k, config))
    wanted = top.join(q.drop("vector"), "query_id").where("dense_rank <= fetch_k")
    named = chunks.where("chunk_id is not null").withColumn("id", point(F.col("chunk_id")))
    rows = scored(wanted.join(named, "id"), config)
    out = R.post_passes(rows, "final_score", config.by_doc, None if config.routed else config.diversity, page="page", tie="dense_rank")
    if model is not None:
        blended = R.blended(out.withColumnRenamed("final_score", "final").withColumn("model", F.when(F.col("rank") <= config.rerank_top, model(F.col("question"), F.col("text")))), config.rerank_top, config.rerank_weight)
        again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("blend"), "rank"))
        out = blended.withColumn("__again", again).withColumn("rank", F.col("__again")).withColumn("final_score", F.col("blend"))
    best = out.where(F.col("rank") <= k).withColumn("score", F.col("final_score")).withColumn("is_context", F.lit(False)).select(*RESULT)
    return with_context(best, chunks, config.context) if config.context > 0 else best


def with_context(results: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Results and, behind them, chunks within `width` places on an anchor's page; each once a question, with its first anchor's scores."""
    pages = results.select("doc_id", "page").distinct()
    order = [F.col("chunk_ord"), F.coalesce(F.col("metadata.window_start"), F.lit(0)), F.col("chunk_id")]
    near = chunks.join(pages, ["doc_id", "page"], "left_semi").select("doc_id", "page", "chunk_id", "text", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order)).alias("pos"))
    anchors = results.join(near.select("doc_id", "page", "chunk_id", "pos"), ["doc_id", "page", "chunk_id"]).withColumnRenamed("chunk_id", "anchor").drop("text")
    around = anchors.withColumn("at", F.explode(F.sequence(F.col("pos") - width, F.col("pos") + width))).drop("pos")
    found = around.join(near.withColumnRenamed("pos", "at"), ["doc_id", "page", "at"]).join(results.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    one = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank", "at"))).where("__n = 1")
    behind = F.row_number().over(Window.partitionBy("query_id").orderBy("is_context", "rank", "at")).cast("int")
    every = results.withColumn("at", F.lit(0)).unionByName(one.withColumn("is_context", F.lit(True)).select(*RESULT, "at"))
    return every.withColumn("rank", behind).select(*RESULT)


def answers(passages: DataFrame, questions: DataFrame, question: str = "question", passage: str = "text") -> DataFrame:
    """Every passage with every one of a stated set of questions, its answer and confidence, as answer.with_structured gives them for a pair.

    A passage is read once for all questions and once for each intent among them; only one that is mostly boilerplate and holds
    nothing of what is asked is read again for each question.
    """
    q = questions.withColumn("__kind", A.intent(F.col(question))).withColumn("__asked", T.token_set(F.col(question), 1))
    p = C.settled_columns(passages, __t=T.pretty_table(F.col(passage)))
    p = C.settled_columns(p, __n=A.answer_norm(F.col("__t")))
    p = C.settled_columns(A.unheard(p, "__t"), __u=A.unit_string(F.col("__n")), __light=F.when(~F.col("__heavy"), T.clean_answer(F.col("__c")))).drop("__c")
    each = C.settled_columns(p.crossJoin(F.broadcast(q.select("__kind").distinct())), __list=A.listed())
    each = C.settled_columns(each, __found=A.found()).drop("__n", "__u", "__list")
    pairs = each.join(F.broadcast(q), "__kind")  # a stated set
    span = F.when(F.col("__heavy"), T.clean_answer(A.best_span(F.col("__asked"), F.col("__all"), F.col("__t"))))
    own = pairs.withColumn("answer", F.coalesce("__found", "__light", span)).withColumn("confidence", A.confidence_of(F.col("__found"), F.col("__kind")))
    return own.drop("__t", "__kind", "__asked", "__heavy", "__all", "__light", "__found")


def api_rows(questions: DataFrame, results: DataFrame, shown: int = 3) -> DataFrame:
    """(query_id, rank, text, score, retrieval_score, answer_score): the answers shown for each valid question, its ten first results re-scored."""
    valid = questions.where(F.length(F.btrim("question")).between(1, 2000)).select("query_id", F.btrim("question").alias("question"))
    rows = A.with_structured(results.where("rank <= 10 and not is_context").join(valid, "query_id"), "question", "text")
    kept = F.when(F.col("final_score") == 0, F.col("score")).otherwise(F.col("final_score"))
    sure = rows.withColumn("retrieval_score", 1 / (1 + F.exp(-kept))).withColumn("answer_score", F.col("confidence"))
    fused = sure.withColumn("score", 0.35 * F.col("retrieval_score") + 0.65 * F.col("answer_score"))
    out = fused.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).where(F.col("__n") <= shown)
    return out.select("query_id", F.col("__n").alias("rank"), F.col("answer").alias("text"), "score", "retrieval_score", "answer_score")


def quality(results: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """One row (total_queries, hit_at_k, mrr) of results against (query_id, doc_id); every question of `expected` counts, none gives zeros."""
    asked_ = expected.select("query_id").distinct()
    right = results.join(expected.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    each = V.reciprocal(asked_, right, F.lit(True), (k,))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.agg(F.count("*").alias("total_queries"), mean(f"hit_at_{k}").alias("hit_at_k"), mean(f"rr_at_{k}").alias("mrr"))
