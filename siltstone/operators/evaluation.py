"""Retrieval and answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import answer as A
from siltstone.functions import text as T

# Fixed values.
FORMAL = r"(?i)^(?:what|which|for|in|among|between|within)\b"
CONVERSATIONAL = r"(?i)\b(?:i|my|we|our|can you|could you|should i|do they|if i|i am|i'm)\b"
TOP1_SHARE, TOP3_SHARE = 0.70, 0.30


def reciprocal(queries: DataFrame, results: DataFrame, relevant: Column, ks: tuple[int, ...] = (3, 10)) -> DataFrame:
    """queries with, for each k, hit (0/1) and the reciprocal of the first relevant rank of (query_id, rank), 0 if none."""
    first = results.where(relevant).groupBy("query_id").agg(F.min("rank").alias("__r"))
    hit = lambda k: F.coalesce(F.col("__r") <= k, F.lit(False))
    columns = {f"hit_at_{k}": hit(k).cast("double") for k in ks} | {f"rr_at_{k}": F.when(hit(k), 1 / F.col("__r")).otherwise(0.0) for k in ks}
    return queries.join(first, "query_id", "left").withColumns(columns).drop("__r")


def f1(overlap: Column, predicted: Column, expected: Column) -> Column:
    p, r = overlap / F.greatest(predicted, F.lit(1)), overlap / F.greatest(expected, F.lit(1))
    return F.when(overlap == 0, 0.0).otherwise(2 * p * r / (p + r))


def bag_f1(a: Column, b: Column) -> Column:
    """Of two multisets of tokens."""
    count = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    return f1(F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t))), F.size(a), F.size(b))


def atoms_f1(a: Column, b: Column) -> Column:
    """Of two sets of numbers; nothing expected counts as met."""
    return F.when(F.size(b) == 0, 1.0).otherwise(f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)))


def with_f1(pairs: DataFrame, predicted: str, expected: str, suffix: str = "") -> DataFrame:
    """Adds token_f1, exact_match and numeric_f1 of two text columns; each side is normalised once."""
    step = pairs
    for side, c in (("p", predicted), ("e", expected)):
        step = step.withColumn(f"__{side}n", A.answer_norm(F.coalesce(F.col(c), F.lit(""))))
        step = step.withColumn(f"__{side}t", F.filter(F.split(f"__{side}n", " "), lambda x: x != "")).withColumn(f"__{side}a", A.numeric_atoms(F.col(f"__{side}n")))
    there = (F.coalesce(F.col(predicted), F.lit("")) != "") & (F.coalesce(F.col(expected), F.lit("")) != "")
    step = step.withColumn(f"token_f1{suffix}", bag_f1(F.col("__pt"), F.col("__et"))).withColumn(f"numeric_f1{suffix}", atoms_f1(F.col("__pa"), F.col("__ea")))
    return step.withColumn(f"exact_match{suffix}", F.when(there & (F.col("__pn") == F.col("__en")), 1.0).otherwise(0.0)).drop(*[f"__{a}{b}" for a in "pe" for b in "nta"])


def with_canonical(rows: DataFrame, question: str, text: str, to: str) -> DataFrame:
    """Adds the structured answer in normal form; for regulations their sorted numbers, where there are any."""
    step = A.with_structured(rows, question, text, "__a", "__conf").withColumn("__a", A.answer_norm(F.col("__a")))
    step = step.withColumn("__refs", F.array_sort(F.array_distinct(F.regexp_extract_all("__a", F.lit(r"\b\d{3,4}/\d{4}\b"), 0))))
    special = F.when((A.intent(F.col(question)) == "regulatory") & (F.size("__refs") > 0), F.concat(F.lit("regulations "), F.array_join("__refs", " ")))
    return step.withColumn(to, F.when(F.coalesce(F.col(text), F.lit("")) == "", "").otherwise(F.coalesce(special, F.col("__a")))).drop("__a", "__conf", "__refs")


def answer_scores(pairs: DataFrame) -> DataFrame:
    """(question, predicted, expected) with token_f1, exact_match, numeric_f1 (larger of raw and canonical) and score."""
    step = with_f1(pairs, "predicted", "expected")
    step = with_canonical(with_canonical(step, "question", "predicted", "__cp"), "question", "expected", "__ce")
    step = with_f1(step, "__cp", "__ce", "_c")
    names = ("token_f1", "exact_match", "numeric_f1")
    step = step.withColumns({n: F.greatest(n, f"{n}_c") for n in names}).drop("__cp", "__ce", *[f"{n}_c" for n in names])
    return step.withColumn("score", 0.70 * F.col("token_f1") + 0.10 * F.col("exact_match") + 0.20 * F.col("numeric_f1"))


def best_match(scored: DataFrame, key: str, order: str) -> DataFrame:
    """The best-scored row of each key, the earlier one on ties."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_previous(runs: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each run with the change of its values against the run before it with the same keys; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return runs.withColumns({f"delta_{v}": F.col(v) - F.lag(v).over(w) for v in values})


def opening(question: Column, head: int = 200) -> Column:
    """The first word of a text's normal form; null if it has none.

    The normal form goes character by character, so where its first `head` characters give two words, the first is whole and
    stands; any other text is normalised whole.
    """
    words = lambda x: F.filter(F.split(T.normal_token(x), " "), lambda w: w != "")
    return T.bound(words(F.substring(question, 1, head)), lambda ws: F.get(F.when(F.size(ws) > 1, ws).otherwise(words(question)), F.lit(0)))


def style_shares(questions: DataFrame, column: str) -> DataFrame:
    """One row: total, shares of formal and of conversational questions, and how often the most frequent opening word opens one."""
    q = F.btrim(F.coalesce(column, F.lit("")))
    word = F.regexp_replace(F.lower(F.regexp_extract(q, r"^\S+", 0)), "[^a-z0-9]+", "")
    rows = questions.select(word.alias("word"), q.rlike(T.unicode(FORMAL)).alias("formal"), q.rlike(T.unicode(CONVERSATIONAL)).alias("said"))
    each = rows.groupBy("word").agg(F.count("*").alias("n"), F.count_if("formal").alias("formal"), F.count_if("said").alias("said"))
    total = F.sum("n")
    share = lambda c: F.round(F.coalesce(F.sum(c) / total, F.lit(0.0)), 6)
    return each.agg(F.coalesce(total, F.lit(0)).alias("total"), share("formal").alias("formal_share"), share("said").alias("conversational_share"), F.max(F.when(F.col("word") != "", F.col("n"))).alias("most_frequent_opening"))


def answer_summary(scored: DataFrame) -> DataFrame:
    """One row of (item, rank, score, exact_match, numeric_f1): means of the first and of the best of three answers, the rates of
    first answers that match exactly and in their numbers, and the two means' weighted sum. No items give zeros."""
    first, three = F.col("rank") == 1, F.col("rank") <= 3
    each = scored.groupBy("item").agg(
        F.max(F.when(first, F.col("score"))).alias("top1"), F.max(F.when(three, F.col("score"))).alias("top3"),
        F.max((first & (F.col("exact_match") >= 1)).cast("double")).alias("exact"), F.max((first & (F.col("numeric_f1") >= 1)).cast("double")).alias("numeric"),
    )
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    return each.agg(
        F.count("*").alias("total"), mean("top1").alias("top1_mean"), mean("top3").alias("top3_mean"), mean("exact").alias("exact_match_rate"), mean("numeric").alias("numeric_match_rate"),
        (TOP1_SHARE * mean("top1") + TOP3_SHARE * mean("top3")).alias("answer_score"),
    )


def shown(rows: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, rank, text, score) with `least` rows for each question, empty ones behind, and `shown`: the score from 0 to 1 with three digits; what is no number counts as 0."""
    bare = rows.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(1), F.lit(least))).alias("rank"))
    number = lambda c: F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    every = bare.join(rows.select("query_id", "rank", "text", "score"), ["query_id", "rank"], "full_outer").withColumn("text", F.coalesce("text", F.lit("")))
    return every.withColumn("shown", F.format_string("%.3f", number(F.col("score"))))
