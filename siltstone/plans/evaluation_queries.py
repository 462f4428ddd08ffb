"""Queries on evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import dense as D
from siltstone.operators import evaluation as V
from siltstone.operators import ranking as R

from . import sql as S
from .registry import query
from .retrieval_queries import _DENSE, _HYBRID, _PROFILE, _W_SQL, _vectors, questions, swept

_EVAL = f"WITH {_DENSE}, top AS (SELECT * FROM ranked WHERE r <= 11 AND id <> query_id), rel AS (SELECT query_id, min(r - 1) AS f FROM top WHERE label = query_label GROUP BY query_id), m AS (SELECT e.vec_id AS query_id, e.label, coalesce(f <= 3, false)::INT::DOUBLE AS h3, coalesce(f <= 10, false)::INT::DOUBLE AS h10, CASE WHEN f <= 3 THEN 1.0::DOUBLE / f ELSE 0.0::DOUBLE END AS rr3 FROM e LEFT JOIN rel ON rel.query_id = e.vec_id WHERE e.vec_id % 100 = 0)"


def _measured(t):
    """Query vectors against all others; a result counts as relevant if its label is the query's."""
    labels = t("embeddings").select("vec_id", "label")
    top = D.dense_topk(*_vectors(t), 11).where("id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dense_rank")))
    q = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    results = top.join(labels.withColumnRenamed("vec_id", "id"), "id").join(q, "query_id")
    return V.reciprocal(q, results, F.col("label") == F.col("query_label")), results


@query(_EVAL.replace("min(r - 1)", "min(n)").replace("top AS (SELECT *", "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS n") + " SELECT count(*)::BIGINT AS total_queries, round(avg(h3), 6) AS hit_at_3, round(avg(rr3), 6) AS mrr_at_3, round(avg(h10), 6) AS hit_at_10, round(0.5 * avg(h3) + 0.4 * avg(rr3) + 0.1 * avg(h10), 6) AS eval_score FROM m")
def hit_mrr(t, spark):
    m, _ = _measured(t)
    h3, rr, h10 = (F.coalesce(F.avg(c), F.lit(0.0)) for c in ("hit_at_3", "rr_at_3", "hit_at_10"))
    return m.agg(F.count("*").alias("total_queries"), F.round(h3, 6).alias("hit_at_3"), F.round(rr, 6).alias("mrr_at_3"), F.round(h10, 6).alias("hit_at_10"), F.round(0.5 * h3 + 0.4 * rr + 0.1 * h10, 6).alias("eval_score"))


_EVAL_N = _EVAL.replace("min(r - 1)", "min(n)").replace("top AS (SELECT *", "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS n")


@query(f"{_EVAL_N} SELECT coalesce(label::VARCHAR, 'all') AS category, count(*)::BIGINT AS n, round(avg(h3), 6) AS hit_at_3, round(avg(rr3), 6) AS mrr_at_3 FROM m GROUP BY GROUPING SETS ((label), ())")
def metrics_by_category(t, spark):
    m, _ = _measured(t)
    return m.rollup("query_label").agg(F.count("*").alias("n"), F.round(F.avg("hit_at_3"), 6).alias("hit_at_3"), F.round(F.avg("rr_at_3"), 6).alias("mrr_at_3")).select(F.coalesce(F.col("query_label").cast("string"), F.lit("all")).alias("category"), "n", "hit_at_3", "mrr_at_3")


@query(f"{_EVAL_N} SELECT count_if(h3 = 0 AND h10 = 1)::BIGINT AS rerank_bottleneck, count_if(h10 = 0)::BIGINT AS retrieval_bottleneck FROM m")
def bottleneck_split(t, spark):
    return _measured(t)[0].agg(F.count_if(F.expr("hit_at_3 = 0 and hit_at_10 = 1")).alias("rerank_bottleneck"), F.count_if(F.expr("hit_at_10 = 0")).alias("retrieval_bottleneck"))


@query(f"{_EVAL_N} SELECT label, count(*)::BIGINT AS n FROM top WHERE n = 1 AND label <> query_label GROUP BY label ORDER BY n DESC, label LIMIT 10")
def false_top1(t, spark):
    """The ten labels that are most often wrongly first: a report of fixed length."""
    return _measured(t)[1].where("rank = 1 and label <> query_label").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(10)


_PAIRS = """SELECT * FROM (VALUES (1, 'dosage 5-40 ppm', 'recommended dosage 5-40 ppm', 0.857143, 0.0, 1.0), (2, '5-40 ppm', '5 to 40 ppm', 1.0, 1.0, 1.0), (3, '5-30 ppm', '5 to 40 ppm', 0.5, 0.0, 0.5),
(4, 'Enzyma GOX 110®: 5-40 ppm.', 'enzyma gox 110 5-40 ppm', 1.0, 1.0, 1.0), (5, 'abc', 'def', 0.0, 0.0, 1.0), (6, '', 'x 1', 0.0, 0.0, 0.0)) AS v(id, predicted, expected, token_f1, exact_match, numeric_f1)"""


@query(f"SELECT id, token_f1::DOUBLE AS token_f1, exact_match::DOUBLE AS exact_match, numeric_f1::DOUBLE AS numeric_f1 FROM ({_PAIRS})")
def answer_f1(t, spark):
    rows = V.with_f1(spark.sql(_PAIRS).select("id", "predicted", "expected"), "predicted", "expected")
    return rows.select("id", F.round("token_f1", 6).alias("token_f1"), "exact_match", F.round("numeric_f1", 6).alias("numeric_f1"))


@query("SELECT * FROM (VALUES (1, 'dosage: 5-40 ppm', 1.0::DOUBLE), (2, 'Activity 10000 U/g', 1.0::DOUBLE)) AS v(item, expected, score)")
def best_answer(t, spark):
    """The expected answer that each prediction matches best."""
    rows = [(1, 0, "what is the recommended dosage?", "recommended dose is 5 to 40 parts per million", "storage below 20 C"), (1, 1, "what is the recommended dosage?", "recommended dose is 5 to 40 parts per million", "dosage: 5-40 ppm"), (2, 0, "enzyme activity?", "activity: 10000 u/g", "Cadmium 0.5 mg/kg"), (2, 1, "enzyme activity?", "activity: 10000 u/g", "Activity 10000 U/g")]
    pairs = spark.createDataFrame(rows, "item int, n int, question string, predicted string, expected string")
    return V.best_match(V.answer_scores(pairs), "item", "n").select("item", "expected", F.round("score", 6).alias("score"))


_RUNS = "SELECT * FROM (VALUES ('a', 'm1', 1, 0.70), ('a', 'm1', 2, 0.72), ('a', 'm2', 3, 0.60), ('a', 'm1', 4, 0.71), ('b', 'm1', 5, 0.5)) AS v(eval_set, model, run, score)"


@query(f"SELECT eval_set, model, run, round((score - lag(score) OVER (PARTITION BY eval_set, model ORDER BY run))::DOUBLE, 6) AS delta_score FROM ({_RUNS})")
def run_delta(t, spark):
    runs = spark.sql(_RUNS).withColumn("score", F.col("score").cast("double"))
    return V.with_previous(runs, ["eval_set", "model"], ["run"], ["score"]).select("eval_set", "model", "run", F.round("delta_score", 6).alias("delta_score"))


_GRID = "SELECT * FROM (VALUES (1, 1), (2, 3), (3, 5), (4, 10)) AS g(config, k)"
_SWEEP = f"{_EVAL_N}, c AS (SELECT g.config, g.k, m.label % 3 AS route, avg(coalesce((SELECT f FROM rel WHERE rel.query_id = m.query_id) <= g.k, false)::INT::DOUBLE) AS hit, avg(CASE WHEN (SELECT f FROM rel WHERE rel.query_id = m.query_id) <= g.k THEN 1.0::DOUBLE / (SELECT f FROM rel WHERE rel.query_id = m.query_id) ELSE 0.0::DOUBLE END) AS mrr FROM m, ({_GRID}) g GROUP BY ALL)"


def _sweep(t, spark):
    """Hits are worked out once; each configuration of the small grid scores them again."""
    m, results = _measured(t)
    first = results.where("label = query_label").groupBy("query_id").agg(F.min("rank").alias("f"))
    every = m.select("query_id", (F.col("query_label") % 3).alias("route")).join(first, "query_id", "left").crossJoin(F.broadcast(spark.sql(_GRID)))
    hit = F.coalesce(F.col("f") <= F.col("k"), F.lit(False))
    return every.groupBy("config", "k", "route").agg(F.avg(hit.cast("double")).alias("hit"), F.avg(F.when(hit, 1 / F.col("f")).otherwise(0.0)).alias("mrr"))


@query(f"{_SWEEP} SELECT config, route, round(hit, 6) AS hit, round(mrr, 6) AS mrr, round(hit - max(CASE WHEN config = 1 THEN hit END) OVER (PARTITION BY route), 6) AS delta FROM c")
def sweep_grid(t, spark):
    base = F.max(F.when(F.col("config") == 1, F.col("hit"))).over(Window.partitionBy("route"))
    return _sweep(t, spark).select("config", "route", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"), F.round(F.col("hit") - base, 6).alias("delta"))


@query(f"{_SWEEP} SELECT route, config FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY round(hit, 9) DESC, round(mrr, 9) DESC, k DESC) AS n FROM c) WHERE n = 1")
def sweep_best_per_route(t, spark):
    w = Window.partitionBy("route").orderBy(F.desc(F.round("hit", 9)), F.desc(F.round("mrr", 9)), F.desc("k"))
    return _sweep(t, spark).withColumn("n", F.row_number().over(w)).where("n = 1").select("route", "config")


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(t, spark):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), p.alias("p"))
    return rows.select("event_type", "n", "mean", *[F.round(F.col("p")[k], 4).alias(c) for k, c in enumerate(("p50", "p95", "p99"))])


@query(f"SELECT list_filter(string_split({S.norm('text')}, ' '), lambda x: x <> '')[1] AS opening, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def query_style_stats(t, spark):
    return t("documents").groupBy(V.opening(F.col("text")).alias("opening")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NULL AS only_label, l.doc_id IS NULL AS only_document FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def set_reconcile(t, spark):
    d, x = t("documents").select("doc_id", F.lit(True).alias("d")), t("labels").select("doc_id", F.lit(True).alias("l"))
    return d.join(x, "doc_id", "full_outer").where("d is null or l is null").select("doc_id", F.col("d").isNull().alias("only_label"), F.col("l").isNull().alias("only_document"))


@query(S.over_questions("query_id, length(trim(question)) BETWEEN 1 AND 2000 AS valid"))
def question_valid(t, spark):
    return questions(spark).select("query_id", F.length(F.btrim("question")).between(1, 2000).alias("valid"))


@query("SELECT r_name AS category, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dimension_lookup(t, spark):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("category")).agg(F.count("*").alias("n"))


_ASKED = "SELECT * FROM (VALUES (1, ' What is it?'), (2, 'can you tell my dose'), (3, 'Whatever, inside'), (4, 'for bread: which?'), (5, 'limits of lead'), (6, 'I''m asking'), (7, 'wii skiing'), (8, '  ')) AS v(id, query)"


@query(f"""SELECT count(*)::BIGINT AS total, round(avg(regexp_matches(trim(query), '{V.FORMAL}')::INT), 6) AS formal_share, round(avg(regexp_matches(trim(query), '{V.CONVERSATIONAL.replace(chr(39), chr(39) * 2)}')::INT), 6) AS conversational_share,
 (SELECT max(n) FROM (SELECT count(*)::BIGINT AS n FROM ({_ASKED}) WHERE regexp_replace(lower(regexp_extract(trim(query), '^\\S+')), '[^a-z0-9]+', '', 'g') <> '' GROUP BY regexp_replace(lower(regexp_extract(trim(query), '^\\S+')), '[^a-z0-9]+', '', 'g'))) AS most_frequent_opening FROM ({_ASKED})""")
def query_style_shares(t, spark):
    return V.style_shares(spark.sql(_ASKED), "query")


_SCORED = "SELECT * FROM (VALUES (1, 1, 0.9, 1.0, 1.0), (1, 2, 0.95, 0.0, 0.5), (1, 3, 0.2, 0.0, 0.0), (1, 4, 1.0, 1.0, 1.0), (2, 1, 0.4, 0.0, 1.0), (2, 2, 0.3, 0.0, 0.0), (3, 1, 0.5, 0.0, 0.999)) AS v(item, rank, score, exact_match, numeric_f1)"


@query(f"""WITH s AS ({_SCORED}), i AS (SELECT item, max(CASE WHEN rank = 1 THEN score END) AS top1, max(CASE WHEN rank <= 3 THEN score END) AS top3, bool_or(rank = 1 AND exact_match >= 1) AS e, bool_or(rank = 1 AND numeric_f1 >= 1) AS n FROM s GROUP BY item)
SELECT count(*)::BIGINT AS total, round(avg(top1)::DOUBLE, 6) AS top1_mean, round(avg(top3)::DOUBLE, 6) AS top3_mean, round(avg(e::INT), 6) AS exact_match_rate, round(avg(n::INT), 6) AS numeric_match_rate, round((0.70 * avg(top1) + 0.30 * avg(top3))::DOUBLE, 6) AS answer_score FROM i""")
def answer_summary(t, spark):
    rows = spark.sql(_SCORED).select("item", "rank", *[F.col(c).cast("double").alias(c) for c in ("score", "exact_match", "numeric_f1")])
    return V.answer_summary(rows).select("total", *[F.round(c, 6).alias(c) for c in ("top1_mean", "top3_mean", "exact_match_rate", "numeric_match_rate", "answer_score")])


_SHOWN = "SELECT * FROM (VALUES (1, 1, 'a', 1.25), (1, 2, 'b', -0.5), (2, 1, 'c', 0.123456), (3, 1, 'd', NULL), (2, 2, 'e', 'NaN'::DOUBLE)) AS v(query_id, rank, text, score)"


@query("SELECT * FROM (VALUES (1, 1, 'a', '1.000'), (1, 2, 'b', '0.000'), (1, 3, '', '0.000'), (2, 1, 'c', '0.123'), (2, 2, 'e', '0.000'), (2, 3, '', '0.000'), (3, 1, 'd', '0.000'), (3, 2, '', '0.000'), (3, 3, '', '0.000')) AS v(query_id, rank, text, shown)")
def shown_rows(t, spark):
    """Three rows for each question, whatever was found, with scores from 0 to 1."""
    rows = spark.createDataFrame([(1, 1, "a", 1.25), (1, 2, "b", -0.5), (2, 1, "c", 0.123456), (3, 1, "d", None), (2, 2, "e", float("nan"))], "query_id int, rank int, text string, score double")
    return V.shown(rows).select("query_id", "rank", "text", "shown")


_SCORES = _HYBRID[: _HYBRID.index(",\nd AS (SELECT *, row_number()")]
#: (config, dense, lexical, field, pool, multiplier, diversity, code_penalty, section_penalty)
_CONFIGS = ((1, 0.58, 0.32, 0.10, 30, 1, 0.0, 0.10, 0.08), (2, 0.65, 0.25, 0.10, 60, 2, 0.0, 0.05, 0.04), (3, 0.52, 0.33, 0.15, 40, 4, 0.1, 0.15, 0.12), (4, 0.65, 0.25, 0.10, 100, 3, 0.1, 0.05, 0.12))


def _config_sql(config, dense, lexical, field, pool, multiplier, diversity, code, section) -> str:
    """Ranks of one configuration: its weights, floors of candidates and penalties written into the scores."""
    scored = _SCORES.replace("THEN -0.05 ELSE -0.035 END", f"THEN {-code} ELSE {-code * 0.7} END").replace("THEN -0.02 ELSE", f"THEN {-section * 0.5} ELSE").replace("THEN -0.016 ELSE", f"THEN {-section * 0.4} ELSE")
    coded = (min(0.74, dense + 0.05), max(0.20, lexical - 0.03), max(0.08, field - 0.02))
    w = f"(CASE WHEN broad_mode THEN [{dense}, {lexical}, {field}] ELSE [{coded[0]}, {coded[1]}, {coded[2]}] END)::DOUBLE[]"
    least = max(3, 3 * multiplier, pool)
    fetch = f"greatest({least}, CASE WHEN NOT broad_mode THEN 24 WHEN asks_storage OR asks_safety OR asks_activity THEN 50 ELSE 40 END)"
    body = scored.replace(_W_SQL, w).replace("CASE WHEN route IN ('code_specific', 'activity') THEN 100 ELSE 50 END", fetch)
    page = f"greatest(0, 1 - {diversity} * (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY final DESC, k) - 1))"
    return f"""SELECT {config} AS config, query_id, route, min(CASE WHEN k % 7 = query_id % 7 THEN rank END) AS first FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, k) AS rank FROM (SELECT query_id, k, route, final, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY before DESC, k) AS nd FROM (SELECT query_id, k, route, doc_id, final * {page} AS final, final AS before FROM ({body} SELECT * FROM f))) WHERE nd = 1)
 WHERE rank <= 3 GROUP BY query_id, route UNION ALL BY NAME SELECT {config} AS config, query_id, route, NULL AS first FROM (WITH {_PROFILE} SELECT query_id, route FROM p)"""


_SWEPT = "SELECT config, route, count(*)::BIGINT AS queries, round(avg((first IS NOT NULL)::INT), 6) AS hit, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM (SELECT config, query_id, route, min(first) AS first FROM (" + " UNION ALL BY NAME ".join(f"({_config_sql(*c)})" for c in _CONFIGS) + ") GROUP BY ALL) GROUP BY config, route"


def _weight_sweep(t, spark):
    grid = spark.createDataFrame(list(_CONFIGS), "config int, dense double, lexical double, field double, pool int, multiplier int, diversity double, code_penalty double, section_penalty double")
    asked, hits = swept(t, spark)
    return R.sweep(hits, asked, grid, F.col("chunk_id") % 7 == F.col("query_id") % 7, 3)


@query(_SWEPT)
def sweep_weights(t, spark):
    """Hits and reciprocal ranks of each route under weights, pools, multipliers, diversity and penalties of a grid."""
    return _weight_sweep(t, spark).select("config", "route", "queries", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"))


_POOLS = "(VALUES " + ", ".join(f"({c[0]}, {c[4]}, {c[5]})" for c in _CONFIGS) + ") AS g(config, pool, multiplier)"


@query(f"""WITH s AS ({_SWEPT}), a AS (SELECT config, 'all' AS route, sum(queries) AS queries, sum(hit * queries) / sum(queries) AS hit, sum(mrr * queries) / sum(queries) AS mrr FROM s GROUP BY config),
e AS (SELECT * FROM s UNION ALL BY NAME SELECT * FROM a), r AS (SELECT route, config, row_number() OVER (PARTITION BY route ORDER BY round(hit, 5) DESC, round(mrr, 5) DESC, pool DESC, multiplier DESC, config) AS place FROM e JOIN {_POOLS} USING (config))
SELECT route, config, place::INTEGER AS place FROM r WHERE place <= 10""")
def sweep_top(t, spark):
    """The ten best configurations of each route, and of all questions together."""
    return R.best_configs(_weight_sweep(t, spark), 10).select("route", "config", "place")
