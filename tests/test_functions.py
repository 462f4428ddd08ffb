import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import answer as A
from siltstone.functions import extract as E
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import evaluation as V


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("ab-\ncd  e .\r\n\x0c\n x ,y", "abcd e.\nx,y"), ("", ""), (" \n ", "")])
def test_cleanup(spark, text, want):
    assert one(spark, text, T.cleanup) == want


@pytest.mark.parametrize(("text", "want"), [("Améliorant ﬁn: 0,5 % (Été)", "ameliorant fin 0 5 % ete"), ("É́A-b/c", "ea-b/c")])
def test_normal_token(spark, text, want):
    assert one(spark, text, T.normal_token) == want


def test_sections_and_languages(spark):
    assert one(spark, "x\nTitle Case Here\nrest", T.section_title) == "Title Case Here"
    assert one(spark, "plain\nALL CAPS", T.section_title) == "ALL CAPS"
    assert one(spark, "nothing here", T.section_title) == "General"
    assert [one(spark, t, T.language) for t in ("with it", "pour le x", "le the x", "zzz")] == ["en", "fr", "mixed", "mixed"]


def test_boilerplate(spark):
    text = "VTR Zhuhai Berlin tel: +49 123 456 789 mail a@b.de\nTITLE OF IT\nContent of one two three four"
    got = one(spark, text, lambda c: T.without_boilerplate(c, "hybrid", 4))
    assert got["removed"] and got["text"] == "TITLE OF IT\nContent of one two three four"
    kept = one(spark, "tel: 1 mail a@b.de", lambda c: T.without_boilerplate(c, "hybrid", 20))
    assert not kept["removed"] and kept["text"] == "tel: 1 mail a@b.de"


def test_pipes(spark):
    got = one(spark, "… | | | | Microbiology | | Salmonella: absent in 25g |", T.clean_answer)
    assert "|" not in got and "Salmonella: absent in 25g" in got


def plain_starts(n, size, overlap):
    step, s, out = max(1, size - overlap), 0, []
    while True:
        out.append(s)
        if s + size >= n:
            return out
        s += step


def test_windows(spark):
    for n, size, overlap in [(30, 10, 2), (1, 10, 2), (10, 10, 2), (11, 10, 2), (18, 10, 2), (19, 10, 2), (50, 5, 5), (840, 420, 60)]:
        got = spark.range(1).select(T.window_starts(F.lit(n), size, overlap).alias("x")).first()["x"]
        assert got == plain_starts(n, size, overlap), (n, size, overlap)


def answered(spark, question, text):
    rows = spark.createDataFrame([(question, text)], "q string, t string")
    return A.with_structured(rows, "q", "t").first()


@pytest.mark.parametrize(
    ("question", "text", "parts", "confidence"),
    [
        ("what dosage range is recommended?", "Product info. Dosage 5-40 ppm. Additional notes.", ["dosage: 5-40 ppm"], 0.95),
        ("storage?", "Date of minimum durability: 24 months. Store in a cool, dry place below 20C.", ["shelf life: 24 months", "temperature: 20 c"], 0.90),
        ("storage?", "Shelf-life 12 months. Store at or below 25 Celsius. Relative humidity below 65%.", ["shelf life: 12 months", "temperature: 25 c", "humidity: <65%"], 0.90),
        ("activity?", "Technical data. Activity 10000U/g. Application bakery.", ["activity: 10000 u/g"], 0.95),
        ("heavy metals?", "Heavy metals: Cadmium: <0.5 mg/kg. Lead: <5 mg/kg.", ["cadmium 0.5 mg/kg", "lead 5 mg/kg"], 0.95),
        ("tell me", "value " * 120, ["value"], 0.6),
        ("which directive?", "First. Directive 1829/2003 applies; x", ["Directive 1829/2003 applies;"], 0.85),
    ],
)
def test_structured_answers(spark, question, text, parts, confidence):
    got = answered(spark, question, text)
    assert got["confidence"] == confidence and all(p in got["answer"] for p in parts), got
    if confidence == 0.6:
        assert got["answer"] == text.strip()


def test_answer_forms(spark):
    assert one(spark, "Enzyma GOX 110®: 5-40 ppm.", A.answer_norm) == "enzyma gox 110 5-40 ppm"
    pairs = spark.createDataFrame([("dosage 5-40 ppm", "recommended dosage 5-40 ppm")], "p string, e string")
    assert abs(V.with_f1(pairs, "p", "e").first()["token_f1"] - 6 / 7) < 1e-9


def test_codes(spark):
    assert one(spark, "hcf max x a soft 305 go 20 tg-883 l65", lambda c: E.doc_codes(c)) == sorted(["hcfmaxx", "soft305", "go20", "tg883", "l65"])
    assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", one(spark, "x", E.uuid5_url))


def test_uuid5(spark):
    import uuid

    assert one(spark, "chunk-1", E.uuid5_url) == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk-1"))


def test_null_keys_all_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "k int, s string")
    assert sorted(x.k for x in C.first_wins(rows, ["s"], ["k"]).collect()) == [1, 3, 4]


def test_table_with_a_gap(spark):
    rows = spark.createDataFrame([(1, "S", [["A", "B", "C"], ["field", "", "v"]])], "table_id int, section string, rows array<array<string>>")
    assert C.table_fields(rows).first()["value"] == "A=field ; B=v"
