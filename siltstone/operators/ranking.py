"""Query analysis and hybrid ranking. Questions are a small stated set; passages are the table that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C

# Fixed values.
ASKS = {
    "bread": ("pain", "panification", "bread", "mie"), "dosage": ("dosage", "dose", "ppm", "recommande"), "limits": ("max", "maximum", "autorise", "reglement"),
    "asks_standardization": ("standardization",), "asks_optimum": ("optimum", "optimal", "suggested"), "asks_activity": ("activity", "skb", "fau", "xylh", "agi"),
    "asks_safety": ("allergen", "allergens", "heavy", "metals", "cadmium", "lead"),
    "asks_storage": ("storage", "shelf", "durability", "months", "temperature", "conservation", "stockage", "humidity"),
    "asks_regulatory": ("legal", "regulatory", "directive", "codex", "autorise", "maximum"), "ascorbic": ("ascorbique", "e300", "vitamine"),
}
ROUTES = (("code_specific", 0.65, 0.25, 0.10, 100), ("compliance_storage_safety", 0.58, 0.32, 0.10, 50), ("activity", 0.65, 0.25, 0.10, 100), ("broad", 0.65, 0.25, 0.10, 50))
CODE_PENALTY, SECTION_PENALTY = 0.05, 0.04


def profile(questions: DataFrame) -> DataFrame:
    """(query_id, question) with norm, tokens, codes, families and what is asked for."""
    q = questions.withColumn("norm", T.normal_token(F.col("question"))).withColumn("tokens", T.token_set(F.col("question")))
    q = q.withColumn("codes", E.query_codes(F.col("norm"), F.col("tokens"))).withColumn("families", E.family_set(F.col("tokens")))
    has = lambda words: F.arrays_overlap("tokens", F.array(*map(F.lit, words)))
    q = q.withColumns({k: has(w) for k, w in ASKS.items()})
    return q.withColumn("asks_bread_improvement", F.array_contains("tokens", "improvement") & F.array_contains("tokens", "bread")).withColumn("broad_mode", F.size("codes") == 0)


def route() -> Column:
    return F.when(~F.col("broad_mode"), "code_specific").when(F.col("asks_storage") | F.col("asks_safety") | F.col("asks_regulatory"), "compliance_storage_safety").when(F.col("asks_activity"), "activity").otherwise("broad")


def fetch_k(k: int, multiplier: int, pool: int) -> Column:
    """Candidates to fetch without a route: floors of 24 with codes, else 50 for storage, safety or activity, else 40."""
    least = max(k, k * max(1, multiplier), pool)
    floor = F.when(~F.col("broad_mode"), 24).when(F.col("asks_storage") | F.col("asks_safety") | F.col("asks_activity"), 50).otherwise(40)
    return F.greatest(F.lit(least), floor)


def weights(dense: Column, lexical: Column, field: Column) -> list[Column]:
    coded = ~F.col("broad_mode")
    d = F.when(coded, F.least(F.lit(0.74), dense + 0.05)).otherwise(dense)
    x = F.when(coded, F.greatest(F.lit(0.20), lexical - 0.03)).otherwise(lexical)
    f = F.when(coded, F.greatest(F.lit(0.08), field - 0.02)).otherwise(field)
    total = d + x + f
    return [F.when(total <= 0, raw).otherwise(c / total).alias(n) for n, raw, c in (("dense_w", dense, d), ("lexical_w", lexical, x), ("field_w", field, f))]


def lexical_score(asked: Column, own: Column) -> Column:
    m = F.size(F.array_intersect(asked, own))
    score = F.least(F.lit(1.0), 0.75 * (m / F.greatest(F.size(asked), F.lit(1))) + 0.25 * (m / F.greatest(F.size(own), F.lit(1))) * 4)
    return F.when(m == 0, 0.0).otherwise(score)


def _sum(*terms: Column) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def _clamped(score: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def field_intent_score(norm_text: Column, product: Column) -> Column:
    bread = F.when(product == "bread", 1.0).when(T.any_of(norm_text, ("pain", "panification", "bread")), 0.8).when(T.any_of(norm_text, ("biscuit", "viennoiserie")), -0.3).otherwise(0.0)
    return _clamped(_sum(F.when(F.col("bread"), bread).otherwise(0.0), _if(F.col("dosage") & T.any_of(norm_text, ("dosage", "ppm")), 0.5), _if(F.col("limits") & T.any_of(norm_text, ("maximum", "autorise")), 0.5)), 0.0, 1.5)


def structured_score() -> Column:
    """Of a question's profile against a passage's metadata columns."""
    known = (F.size("families") > 0) & (F.col("product_family") != "other")
    same = F.array_contains("families", F.col("product_family"))
    there = lambda c: F.col(c).isNotNull()
    at = lambda s: F.coalesce(F.col("section_canonical") == s, F.lit(False))
    return _clamped(
        _sum(
            F.when(known & same, 0.10).when(known, -0.16).otherwise(0.0),
            _if(F.col("asks_standardization") & there("dosage_standardization"), 0.18), _if(F.col("asks_bread_improvement") & there("dosage_bread_improvement"), 0.18),
            _if(F.col("asks_optimum") & (there("dosage_suggested_optimum") | there("dosage_suggested")), 0.18), _if(F.col("asks_regulatory") & (there("dosage_max_authorized") | at("regulatory")), 0.16),
            _if(F.col("asks_storage") & at("storage"), 0.14), _if(F.col("asks_safety") & at("food_safety"), 0.16), _if(F.col("asks_activity") & F.contains("head_norm", F.lit("activity")), 0.14),
        ),
        -0.20, 0.35,
    )


def doc_specific_score(code_penalty: float | Column = CODE_PENALTY, section_penalty: float | Column = SECTION_PENALTY, constraints: bool = True) -> Column:
    """Codes, families, ascorbic acid and sections of a question against a passage's columns.

    Without constraints other codes cost nothing and sections do not count.
    """
    code_penalty = code_penalty if constraints else 0.0
    n = F.size(F.array_intersect("codes", "doc_codes"))
    codes = F.when(F.size("codes") == 0, 0.0).when(n > 0, 0.50 + 0.20 * F.least(F.lit(2), n)).when(F.size("doc_codes") > 0, -code_penalty).otherwise(-code_penalty * 0.7)
    sec = F.coalesce(F.col("section_canonical"), F.lit(""))
    part = lambda ask, name, plus, share, free: F.when(F.col(ask), F.when(sec == name, plus).when((sec != "") & ~sec.isin(*free), -section_penalty * share).otherwise(0.0)).otherwise(0.0)
    sections = [part("asks_storage", "storage", 0.10, 0.5, ("storage",)), part("asks_safety", "food_safety", 0.12, 0.5, ("food_safety",)), part("asks_regulatory", "regulatory", 0.08, 0.4, ("regulatory", "dosage"))]
    return _clamped(
        _sum(
            codes, _if(F.arrays_overlap("families", "doc_families"), 0.25), _if(F.col("ascorbic") & F.col("doc_ascorbic"), 0.20), _if(F.col("ascorbic") & ~F.col("doc_ascorbic"), -0.20),
            _if(~F.col("ascorbic") & F.col("doc_ascorbic") & (F.size("families") > 0), -0.45),
            *(sections if constraints else []),
        ),
        -0.60, 1.00,
    )


def passages(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, file_name, text, any others) with what scoring reads, worked out once."""
    name = F.concat_ws(" ", "doc_id", "file_name")
    p = C.settled_columns(
        chunks, text_norm=T.normal_token(F.col("text")), name_norm=T.normal_token(name), all_norm=T.normal_token(F.concat_ws(" ", name, F.col("text"))),
        head=T.normal_token(F.concat_ws(" ", name, F.substring("text", 1, 320))), head_norm=T.normal_token(F.substring("text", 1, 180)),
    )
    p = C.settled_columns(
        p, own_tokens=T.tokens_of(F.col("text_norm")), head_tokens=T.tokens_of(F.col("head")), product_family=E.family(F.col("all_norm")), section_canonical=E.section(F.col("all_norm")),
        product=F.coalesce(E.first_of(F.col("text_norm"), E.PRODUCTS), F.lit("other")), meta_codes=E.doc_codes(F.col("all_norm")), **E.dosages(F.col("all_norm")),
    )
    return C.settled_columns(
        p, doc_codes=F.when(F.size("meta_codes") > 0, F.col("meta_codes")).otherwise(E.query_codes(F.col("name_norm"), F.col("head_tokens"))),
        doc_families=F.array_union(E.family_set(F.col("head_tokens")), F.array("product_family")), doc_ascorbic=F.contains("name_norm", F.lit("acide ascorbique")),
    )


def post_passes(scored: DataFrame, score: str, by_doc: bool = True, penalty: float | Column | None = None, doc: str = "doc_id", page: str | None = None, tie: str = "chunk_id") -> DataFrame:
    """Ranks of (query_id, chunk_id, doc): first of each chunk, repeats of a page penalised, best of each document, by score, then `tie`."""
    order = [F.desc(score), tie]
    out = scored.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where("__n = 1")
    if penalty is not None:
        nth = F.row_number().over(Window.partitionBy("query_id", doc, *([page] if page else [])).orderBy(*order)) - 1
        out = out.withColumn("__first", F.col(score)).withColumn(score, F.col(score) * F.greatest(F.lit(0.0), 1 - F.lit(penalty) * nth))
    if by_doc:
        first = [F.desc("__first" if penalty is not None else score), tie]
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", doc).orderBy(*first))).where("__n = 1")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("__n", "__first")


def blended(rows: DataFrame, top: int = 20, alpha: float = 0.35) -> DataFrame:
    """The first `top` ranks of each query re-scored: (1 - alpha) final + alpha scaled model score; 0.5 where all are alike.

    Rows without a model score (there is no model) keep their own.
    """
    head = (F.col("rank") <= top) & F.col("model").isNotNull()
    w = Window.partitionBy("query_id")
    low, high = F.min(F.when(head, F.col("model"))).over(w), F.max(F.when(head, F.col("model"))).over(w)
    scaled = F.when(high - low <= 1e-9, 0.5).otherwise((F.col("model") - low) / (high - low))
    out = rows.withColumn("blend", F.when(head, (1 - alpha) * F.col("final") + alpha * scaled).otherwise(F.col("final")))
    return out.withColumn("new_rank", F.row_number().over(w.orderBy(F.when(head, 0).otherwise(1), F.desc("blend"), "rank")))


def context(anchors: DataFrame, rows: DataFrame, group: str, position: str, width: int = 1) -> DataFrame:
    """Neighbours within `width` positions of (rank, group, position) anchors in rows of the same group; the first anchor wins.

    Rows that are anchors themselves are left out.
    """
    a = anchors.select(F.col("rank").alias("anchor_rank"), F.col(group).alias("__g"), F.explode(F.sequence(F.col(position) - width, F.col(position) + width)).alias("__p"))
    near = a.groupBy("__g", "__p").agg(F.min("anchor_rank").alias("anchor_rank"))
    near = near.join(anchors.select(F.col(group).alias("__g"), F.col(position).alias("__p")).distinct(), ["__g", "__p"], "left_anti")
    return rows.join(near, (F.col(group) == F.col("__g")) & (F.col(position) == F.col("__p"))).drop("__g", "__p")


def sweep(hits: DataFrame, questions: DataFrame, grid: DataFrame, relevant: Column, k: int = 3) -> DataFrame:
    """(config, pool, multiplier, route, queries, hit, mrr): each configuration of a stated grid, on the same candidates.

    hits: candidates (query_id, dense_rank, dense_score, a question's profile, a passage's columns), as many as any
    configuration fetches, scored again for each; questions: (query_id, route); grid: (config, dense, lexical, field,
    pool, multiplier, diversity, code_penalty, section_penalty). Lexical and field scores are worked out once.
    """
    base = C.settled_columns(hits, lex=lexical_score(F.col("tokens"), F.col("own_tokens")), intent=field_intent_score(F.col("text_norm"), F.col("product")), fixed=structured_score())
    g = grid.withColumnsRenamed({c: f"g_{c}" for c in grid.columns if c != "config"})
    every = base.crossJoin(F.broadcast(g))  # a stated grid
    fetched = F.greatest(F.lit(k), k * F.greatest(F.lit(1), F.col("g_multiplier")), F.col("g_pool"), F.when(~F.col("broad_mode"), 24).when(F.col("asks_storage") | F.col("asks_safety") | F.col("asks_activity"), 50).otherwise(40))
    d, x, f = (w.alias(n) for w, n in zip(weights(F.col("g_dense"), F.col("g_lexical"), F.col("g_field")), ("w_d", "w_x", "w_f"), strict=True))
    kept = every.where(F.col("dense_rank") <= fetched).select("*", d, x, f)
    extra = doc_specific_score(F.col("g_code_penalty"), F.col("g_section_penalty")) + F.col("fixed")
    final = F.round(F.col("w_d") * F.col("dense_score") + F.col("w_x") * F.col("lex") + F.col("w_f") * F.col("intent") + extra, 9)
    rows = C.settled_columns(kept, final=final).select(F.struct("config", "query_id").alias("asked"), "chunk_id", "doc_id", "final", "g_diversity", relevant.alias("good"))
    ranks = post_passes(rows.withColumnRenamed("asked", "query_id"), "final", penalty=F.col("g_diversity")).where((F.col("rank") <= k) & F.col("good"))
    first = ranks.groupBy(F.col("query_id.config").alias("config"), F.col("query_id.query_id").alias("query_id")).agg(F.min("rank").alias("first"))
    asked = questions.select("query_id", "route").crossJoin(F.broadcast(grid.select("config", "pool", "multiplier")))
    return asked.join(first, ["config", "query_id"], "left").groupBy("config", "pool", "multiplier", "route").agg(
        F.count("*").alias("queries"), F.avg(F.col("first").isNotNull().cast("double")).alias("hit"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")
    )


def best_configs(swept: DataFrame, most: int = 10) -> DataFrame:
    """The `most` best configurations of each route and of all routes together (route "all"): by hits, reciprocal ranks, pool and multiplier, then number."""
    mean = lambda c: (F.sum(F.col(c) * F.col("queries")) / F.sum("queries")).alias(c)
    every = swept.groupBy("config", "pool", "multiplier").agg(F.sum("queries").alias("queries"), mean("hit"), mean("mrr")).withColumn("route", F.lit("all"))
    w = Window.partitionBy("route").orderBy(F.desc(F.round("hit", 5)), F.desc(F.round("mrr", 5)), F.desc("pool"), F.desc("multiplier"), "config")
    return swept.unionByName(every).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
