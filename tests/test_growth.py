"""What keeps a query's work in proportion to its input."""

import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions import answer as A
from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import dense as D
from siltstone.operators import evaluation as V
from siltstone.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classes_list_ascii():
    assert not re.search(r"a-z|A-Z|0-9", T.unicode(r"[^a-z0-9%/\-]+ \w+ [\d.]") )


def test_single_spaces_are_passed_over(spark):
    rows = spark.createDataFrame([("a b  c d\n",)], "t string")
    assert rows.select(T.spaced(F.col("t"), T.unicode(r"\s")).alias("x")).first().x == "a b c d "
    assert rows.select(T.cleanup(F.concat(F.lit("x-\r\fy \v z\n\n"), "t")).alias("x")).first().x == "xy z\na b c d"


def test_first_wins_reads_its_rows_once(spark):
    assert plan(C.first_wins(spark.range(10).withColumn("k", F.col("id") % 3), ["k"], ["id"])).count("Range (") == 1


def test_lines_are_normalised_once(spark, sf):
    assert plan(registry.QUERIES["repeated_lines"](spark, sf)).count("technical") <= 2  # the rule and what guards it


def test_sheets_are_dealt_over_all_cores(spark, sf):
    """One small file is one task, however much text is made from its rows."""
    assert all("RoundRobinPartitioning" in plan(registry.QUERIES[q](spark, sf)) for q in ("lexical_score", "doc_specific_score", "structured_score", "field_intent_score", "cross_doc_signature_dedup"))
    assert C.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_every_unit_rule_has_its_parts():
    assert len(A.UNIT_NEEDS) == len(A.UNIT_RULES)


def test_scores_held_do_not_grow_with_the_queries():
    r = np.random.default_rng(3)
    q, v = D._unit(r.normal(size=(2048, 8))), D._unit(np.round(r.normal(size=(5000, 8)), 1))
    v[4000:] = v[:1000]  # ties go by id
    v[17] = np.nan
    best = D._Best(np.arange(2048), q, 5)
    tracemalloc.start()
    for lo in range(0, 5000, 2500):
        best.see(np.arange(lo, lo + 2500), v[lo : lo + 2500])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    s = np.round(q @ v.T, D.DIGITS)
    by = np.lexsort((np.broadcast_to(np.arange(5000), s.shape), -s), axis=1)[:, :5]
    assert (best.i == by).all() and (best.s == np.take_along_axis(s, by, 1)).all()


def test_opening_reads_on_where_the_head_does_not_settle_it(spark):
    texts = ["One two", "  !!", "", "x" * 300 + " y", "." * 250 + "Late word", "ab" + "\u0301" * 300 + "c d", "w" * 199 + "\u00e9t\u00e9", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = F.get(F.filter(F.split(T.normal_token(F.col("text")), " "), lambda x: x != ""), F.lit(0))
    out = rows.select("id", V.opening(F.col("text")).alias("a"), plain.alias("b"), V.opening(F.col("text"), 3).alias("c")).collect()
    assert all(r.a == r.b == r.c for r in out) and [r.a for r in out][:3] == ["one", None, None]
    assert "substring" in plan(rows.select(V.opening(F.col("text"))))


def test_guards_without_letters_take_no_lower_copy(spark):
    rows = spark.createDataFrame([("A,1 b",)], "t string")
    assert "lower" not in plan(rows.select(T.guarded(F.col("t"), ",", ";", (",",)))) and "lower" in plan(rows.select(T.guarded(F.col("t"), "(?i)b", "c", ("b", "1"))))
    texts = ["1,2,3", "a, 5", "5 ,1", "١,٢", "1,2 3,4,", ",", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r.x for r in rows.select(T.for_embedding(F.col("t")).alias("x")).collect()] == ["1.2,3", "a, 5", "5 ,1", "١.٢", "1.2 3.4,", ",", "", None]


def test_codes_are_found_behind_their_guard(spark):
    texts = ["hcf 600", "a soft - 305 x", "l55", "xl55 max63", "go-12 go 1", "tg max x", "12 34 of 20", "af110 af220", "gox  90", "fresh 101 maxx", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "n string")
    tokens = F.filter(F.split("n", " "), lambda t: t.rlike(E.DOC_TOKEN_CODE))
    every = F.flatten(F.array(tokens, *[F.regexp_extract_all("n", F.lit(p), g) for p, g in ((E.MAX_CODE, 0), (E.SOFT_CODE, 1), (E.NUMBER_CODE, 0), (E.GO_CODE, 0))]))
    out = rows.select(E.doc_codes(F.col("n")).alias("a"), F.array_sort(F.array_distinct(F.transform(every, E.canonical_code))).alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out] and out[0].a == ["hcf600"] and out[6].a == []
    # codes of a longer text than the normal form count as well
    assert spark.createDataFrame([("sheet", ["hcf600"])], "n string, t array<string>").select(E.query_codes(F.col("n"), F.col("t")).alias("a")).first().a == ["hcf600"]


def test_a_json_line_is_read_once(spark, sf):
    assert plan(registry.QUERIES["jsonl_roundtrip"](spark, sf)).count("from_json(") == 1


def test_chunks_that_are_read_twice_are_made_once(spark, sf):
    assert plan(registry.QUERIES["prep_report"](spark, sf)).count("documents.parquet") == 1  # the pages; chunks come from the shared folder
    assert "part.parquet" not in plan(registry.QUERIES["search_with_context"](spark, sf))
