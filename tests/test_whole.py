import pytest
from pyspark.sql import functions as F

from siltstone.functions import answer as A
from siltstone.operators import chunking as C
from siltstone.operators import embed as M
from siltstone.operators import prepare as P
from siltstone.operators import retrieve as V

BLOCK = "doc_id string, file_name string, page int, block_type string, text string, rows array<array<string>>, block_ord bigint, extra int"
ROWS = [
    ("d1", "d1.pdf", 1, "paragraph", "HCF 600 DATA\nRunning head of the page\nSuggested optimum dosage 5-40 ppm for bread improvement of the white flour kind\nStorage below 25 C", None, 0, 1),
    ("d1", "d1.pdf", 1, "table", "x", [["Type de Production", "Dosage (ppm)", "Observations"], ["Pain de mie", "5-40", "avec soin"], ["", "", "encore"], ["Biscuit sec", "10 ppm", None]], 1, 1),
    ("d1", "d1.pdf", 1, "table", "x", [["Parameter", "Unit"], ["Colour", "white"]], 3, 1),
    ("d1", "d1.pdf", 2, "paragraph", "Running head of the page\n- first item of the list\n2) second item of the list that has more words than the first one has in all", None, 2, 1),
    ("d2", "d2.pdf", 1, "table", None, [["Type de Production", "Dosage (ppm)"], ["Pain de mie", "5-40"]], 0, 1),
    ("d2", "d2.pdf", 1, "paragraph", " ".join(f"w{i}" for i in range(1000)), None, 1, 1),
    ("d3", None, None, "paragraph", None, None, 0, 1), ("d4", "d4.pdf", 1, None, "", [], 0, None), (None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(ROWS, BLOCK)


@pytest.fixture(scope="module")
def chunks(spark, blocks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chunks") / "c")
    P.prepare(blocks).write.parquet(path)
    return spark.read.schema(P.CHUNK).parquet(path)


def test_normalised(blocks):
    rows = {(r.doc_id, r.page, r.chunk_type, r.ord): r for r in P.normalize_blocks(blocks, P.Preparation(list_items=True)).collect()}
    first = rows["d1", 1, "paragraph", 3]
    assert first.section == "HCF 600 DATA" and "Running head" not in first.text and first.lang == "en" and first.metadata.boilerplate_removed is False
    assert sorted(r.text for r in rows.values() if r.chunk_type == "list_item") == ["- first item of the list", "2) second item of the list that has more words than the first one has in all"]
    facts = sorted((r for r in rows.values() if r.chunk_type == "table_kv" and r.doc_id == "d1"), key=lambda r: r.ord)
    assert [(r.section, r.metadata.field_name, r.metadata.dosage, r.metadata.product_type_canonical, r.metadata.observation) for r in facts] == [
        ("Dosages Recommandes", "Pain de mie", "5-40", "bread", "avec soin encore"), ("Dosages Recommandes", "Biscuit sec", "10 ppm", "biscuit", None), ("HCF 600 DATA", "Colour", None, "other", None),
    ]
    summary = [r for r in rows.values() if r.metadata.table_summary and r.section == "Dosages Recommandes" and r.doc_id == "d1"]
    assert [r.text for r in summary] == [" ".join(r.text for r in facts[:2])]
    assert not [r for r in rows.values() if r.doc_id in ("d3", "d4", None)]


def test_prepared(chunks):
    rows = chunks.orderBy("doc_id", "chunk_ord", "metadata.window_start").collect()
    assert [r.metadata.window_start for r in rows if r.doc_id == "d2" and r.section == "General"] == [0, 360, 720]
    # d2's only table row says what d1's first says; the summary of its table is another text of another document
    assert [(r.doc_id, r.metadata.field_name) for r in rows if r.chunk_type == "table_kv"] == [("d1", "Pain de mie"), ("d1", "Biscuit sec"), ("d1", "Colour")]
    own = next(r for r in rows if r.section == "HCF 600 DATA" and r.chunk_type == "paragraph" and "Suggested" in r.text)
    assert own.metadata.product_family == "hcf" and own.metadata.model_codes == ["hcf600"] and own.metadata.dosage_suggested_optimum == "5-40 ppm" and own.metadata.section_canonical == "storage"
    # blocks of one page, section and kind are one chunk: the second table's summary joins the paragraph it took its section from
    assert own.text.startswith("HCF 600 DATA Suggested") and "Colour" in own.text and own.metadata.table_summary and len(own.chunk_id) == 16


def test_catalog_and_report(blocks, chunks):
    rows = {r.doc_id: r for r in P.catalog(chunks).collect()}
    assert set(rows) == {"d1", "d2"} and rows["d1"].pages == [1, 2] and rows["d1"].model_codes == ["hcf600"] and "hcf" in rows["d1"].families
    r = P.report(blocks, chunks, chunks).first()
    assert (r.documents_processed, r.pages_processed, r.chunks_generated, r.extraction_errors) == (4, 4, chunks.count(), [])


def test_direct(blocks):
    rows = P.direct_chunks(blocks).orderBy("doc_id", "chunk_ord", "metadata.window_start").collect()
    assert [(r.doc_id, r.page, r.metadata.window_start) for r in rows] == [("d1", 1, 0), ("d1", 2, 0), ("d2", 1, 0), ("d2", 1, 360), ("d2", 1, 720)]
    twice = blocks.where("doc_id = 'd2' and block_ord = 1")
    again = twice.unionByName(twice.withColumn("block_ord", F.col("block_ord") + 5))
    assert P.direct_chunks(again).count() == 3 and P.direct_chunks(again, P.Preparation(across_docs=False)).count() == 6


def test_empty(spark):
    none = spark.createDataFrame([], BLOCK)
    assert P.prepare(none).count() == 0 and P.direct_chunks(none).count() == 0


def test_search(spark, chunks):
    embed = M.embedder(M.hashed_letters())
    vectors = V.with_vectors(chunks, embed).select("chunk_id", "vector")
    asked = spark.createDataFrame([(1, "recommended dosage for bread improvement of hcf 600"), (2, " ")], "query_id long, question string").withColumn("vector", embed(F.col("question")))
    found = V.search(chunks, vectors, asked, 3).where("query_id = 1").orderBy("rank").collect()
    own = [r for r in found if not r.is_context]
    assert [r.rank for r in found] == list(range(1, len(found) + 1)) and [r.doc_id for r in own] == ["d1", "d2"] and "hcf" in own[0].matched_terms
    assert len({r.chunk_id for r in found}) == len(found) and found[: len(own)] == own and any(r.is_context and r.doc_id == "d1" and r.score == own[0].score for r in found)
    plain = V.search(chunks, vectors, asked, 3, V.Search(routed=False, by_doc=False, context=0, diversity=0.1), M.pair_scorer(lambda: lambda q, t: [float(len(x)) for x in t])).where("query_id = 1").collect()
    assert len(plain) == 3 and not any(r.is_context for r in plain)
    report = V.quality(spark.createDataFrame(own), spark.createDataFrame([(1, "d2"), (3, "d1")], "query_id long, doc_id string")).first()
    assert (report.total_queries, report.hit_at_k, report.mrr) == (2, 0.5, 0.25)
    shown = V.api_rows(asked, spark.createDataFrame(own)).collect()
    assert [r.rank for r in shown] == [1, 2] and shown[0].text == "dosage: 5-40 ppm" and shown[0].answer_score == 0.95


def test_answers_read_a_passage_once(spark):
    signed = "Tel: 123 456 www.x.org, mail a@b.org. Phone: www.y.org, mail us. Lipase it is. "
    texts = ["Dosage 5-40 ppm. Lead: <5 mg/kg. Directive 1829/2003 applies.", signed, "| Activity | 100 u/g |", "Contains milk. Store below 25 C, 24 months", "Plain words here", "", None]
    asked = spark.createDataFrame(list(enumerate(["dosage?", "activity", "lead limit", "allergens", "shelf life", "which directive", "tell me about lipase", "plain words", "", None])), "query_id int, question string")
    passages = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = V.answers(passages, asked).select("k", "query_id", "answer", "confidence")
    pairs = A.with_structured(passages.crossJoin(asked), "question", "text").select("k", "query_id", "answer", "confidence")
    assert sorted(out.collect(), key=repr) == sorted(pairs.collect(), key=repr) and out.count() == 70
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Join")  # the last joins' rows, the passages, come with their normal form
    assert "__n" not in below[0] and below[-1].count("celsius") >= 1


def test_first_wins_keeps_one_a_task(spark):
    rows = spark.range(10).select("id", F.when(F.col("id") > 3, F.col("id") % 2).alias("k"))
    out = C.first_wins(rows, ["k"], ["id"])
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 3, 4, 5] and "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
