import json

from siltstone.operators.dense import dense_topk
from siltstone.sources import tables
from siltstone.streaming import ingest


def test_chunks_round_trip(spark, tmp_path):
    row = ("c1", "d", "f.pdf", 1, "General", "paragraph", 'é "x"\n', None, "fr", {"section": "s", "units": ["ppm", "kg"], "window_start": 3}, 0)
    df = spark.createDataFrame([row], tables.CHUNK)
    tables.write_chunks(df, f"{tmp_path}/c")
    got = tables.read_chunks(spark, f"{tmp_path}/c")
    assert got.collect() == df.collect() and got.first().metadata.units == ["ppm", "kg"]


def test_prepared_chunks_round_trip(spark, tmp_path):
    """What prepare() gives is read back as it was, lists and all."""
    from siltstone.operators import prepare as P

    rows = [("d1", "d1.pdf", 1, "paragraph", "HCF 600 dosage range 5-40 ppm for the bread improvement of white flour in bags of 25 kg", None, 0), ("d1", "d1.pdf", 1, "table", "x", [["Type de Production", "Dosage (ppm)"], ["Pain de mie", "5-40"]], 1)]
    made = P.prepare(spark.createDataFrame(rows, "doc_id string, file_name string, page int, block_type string, text string, rows array<array<string>>, block_ord bigint"))
    tables.write_chunks(made, f"{tmp_path}/c")
    key = lambda r: r.chunk_id
    got = sorted(tables.read_chunks(spark, f"{tmp_path}/c").collect(), key=key)
    assert got == sorted(made.collect(), key=key) and any(r.metadata.units for r in got)


def test_eval_items(spark, tmp_path):
    items = [{"id": "q1", "category": "c", "query": "what?", "expected_top3": [{"candidate_answer": "a", "source_file": "x/y.pdf", "page": 2}, {"candidate_answer": "b", "source_file": "z.pdf", "page": None}]}, {"id": "q2", "category": "c", "query": "which?", "expected_top3": []}]
    (tmp_path / "items.json").write_text(json.dumps(items, indent=1))
    got = {x.id: x for x in tables.read_eval_items(spark, f"{tmp_path}/items.json").collect()}
    assert [(a.candidate_answer, a.source_file, a.page) for a in got["q1"].expected_top3] == [("a", "x/y.pdf", 2), ("b", "z.pdf", None)] and got["q2"].expected_top3 == []


def test_history_is_appended(spark, tmp_path):
    run = spark.createDataFrame([("2024-01-02T03:04:05", "a", 0.5)], "run_at string, eval_set string, score double")
    tables.append_history(run, f"{tmp_path}/h")
    tables.append_history(run, f"{tmp_path}/h")
    assert tables.read_history(spark, f"{tmp_path}/h").where("score = 0.5 and at is not null").count() == 2
    tables.write_report(run, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first().eval_set == "a"


def test_history(spark, tmp_path):
    rows = [{"run_at": "2024-01-02T03:04:05+00:00", "eval_set": "a", "score": 0.5}, {"run_at": "x", "eval_set": "b", "score": 0.7}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join([json.dumps(rows[0]), "{broken", "", json.dumps(rows[1])]))
    for name in ("a.json", "b.jsonl"):
        got = tables.read_history(spark, f"{tmp_path}/{name}").collect()
        assert [(x.eval_set, x.score) for x in got] == [("a", 0.5), ("b", 0.7)] and got[0]["at"] and not got[1]["at"]
    assert tables.read_history(spark, f"{tmp_path}/missing").count() == 0


def test_pages(spark, sf):
    df = spark.createDataFrame([(1, "u", "<p>A &amp; B</p><script>x</script><!-- c --><div>C</div>"), (2, "u", "<br>")], "page_id long, url string, html string")
    got = tables.page_blocks(df).collect()
    assert len(got) == 1 and got[0].text.split() == ["A", "&", "B", "C"]


def test_bad_pdf_is_a_row(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"not a pdf")
    got = tables.pdf_blocks(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].doc_id == "a" and got[0].error


def test_ingest(spark, tmp_path):
    schema = "doc_id long, text string"
    for k, rows in enumerate([[(1, "one two"), (2, "three")], [(1, "changed text here")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert k >= 0
    assert sorted((x.doc_id, x.text) for x in ingest.current(spark, f"{tmp_path}/out").collect()) == [(1, "changed text here"), (2, "three")]


def test_ingest_loses_nothing(spark, tmp_path):
    """The newest row of a batch wins, rows without id stay, and a document that has become empty has no chunks."""
    schema = "doc_id long, text string, seen int"
    for rows in [[(1, "old words", 1), (1, "new words", 2), (1, "no version", None), (None, "nameless", 1), (None, "another", 1), (2, "here", 1)], [(2, " ", 1), (None, "third", 1)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check", "seen").awaitTermination()
    assert sorted((x.doc_id or 0, x.text) for x in ingest.current(spark, f"{tmp_path}/out").collect()) == [(0, "another"), (0, "nameless"), (0, "third"), (1, "new words")]


def test_dense_topk_blocks_and_odd_rows(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)] + [(90, None), (91, [1.0]), (None, [1.0, 1.0]), (92, [0.0, 0.0])], "id long, vector array<double>")
    q = v.where("id < 5").selectExpr("id as query_id", "vector")
    whole, groups = (sorted(map(tuple, dense_topk(v, q, 3, **more).collect())) for more in ({}, {"sent": 0, "packed": 32}))
    assert whole == groups and len(whole) == 15
    assert dense_topk(v, q.limit(0), 3).count() == 0 and dense_topk(v.limit(0), q, 3).count() == 0


def test_batch_models(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import embed

    df = spark.createDataFrame([("abc", "abd"), (None, "x"), ("", None)], "q string, t string")
    got = df.select(embed.embedder(embed.hashed_letters(8))(F.col("q")).alias("v"), embed.pair_scorer(lambda: lambda q, t: [len(a) + len(b) for a, b in zip(q, t, strict=True)])("q", "t").alias("s")).collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-6 and sum(got[1].v) == 0 and sorted(x.s for x in got) == [0.0, 1.0, 6.0]


def test_store(spark, tmp_path):
    from siltstone.operators.embed import TableStore

    store, schema = TableStore(spark, f"{tmp_path}/vectors"), "id long, vector array<float>"
    assert store.rows().count() == 0 and store.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), 2).count() == 0
    store.upsert(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0])], schema))
    store.upsert(spark.createDataFrame([(2, [1.0, 0.5]), (3, [-1.0, 0.0]), (3, [-1.0, 0.0])], schema))
    assert sorted((x.id, x.vector) for x in store.rows().collect()) == [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, [-1.0, 0.0])]
    got = store.search(spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>"), 2).orderBy("dense_rank").collect()
    assert [(x.query_id, x.id) for x in got] == [(7, 1), (7, 2)]


def test_a_missing_pair_model_changes_nothing(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import embed
    from siltstone.operators import ranking as R

    rows = spark.createDataFrame([(1, k, 1.0 / k, f"t{k}") for k in range(1, 6)], "query_id long, rank int, final double, text string")
    scored = rows.withColumn("model", embed.pair_scorer(embed.pair_model("no/such-model"))(F.lit("q"), F.col("text")))
    assert all(x.model is None and x.blend == x.final and x.new_rank == x.rank for x in R.blended(scored).collect())
