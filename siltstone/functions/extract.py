"""Metadata taken from normalised text: codes, families, sections, dosages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, normal_token, rewritten

# Fixed values.
SECTIONS = (
    ("food_safety", ("food safty data", "food safety data", "heavy metals", "allergens", "microbiology")),
    ("regulatory", ("reglementation", "directive", "codex alimentarius", "legal framework")),
    ("storage", ("storage", "minimum durability", "shelf life", "temperature", "conservation", "humidite", "humidity")),
    ("dosage", ("dosage",)),
)
PRODUCTS = (("bread", ("pain", "panification", "bread")), ("biscuit", ("biscuit", "cracker")), ("viennoiserie", ("viennoiserie",)), ("frozen", ("surgel",)))
AMOUNT = r"([0-9.]+\s*(?:-\s*[0-9.]+)?\s*ppm)"
DOSAGES = {
    "dosage_standardization": rf"standardization of wheat flour\s*{AMOUNT}",
    "dosage_bread_improvement": rf"bread improvement\s*{AMOUNT}",
    "dosage_suggested_optimum": rf"suggested optimum dosage\s*{AMOUNT}",
    "dosage_suggested": rf"suggest(?:ed)? dosage\s*{AMOUNT}",
    "dosage_range": rf"dosage range\s*{AMOUNT}",
    "dosage_max_authorized": r"dosage maximum autoris[ée]?\s*(?:france belgique\s*)?:?\s*([0-9.]+\s*ppm)",
    "dosage_generic": rf"\bdosage\s*{AMOUNT}",
}
FAMILY_TOKENS = ("hcf", "hcb", "af", "amg", "tg", "gox", "go", "fresh", "soft", "fresh_soft")
DOC_TOKEN_CODE, QUERY_TOKEN_CODE = r"^(?:(?:hcf|hcb|af|amg|tg|gox|go|fresh|soft)\d{2,4}|max(?:63|64|65|x)|l(?:55|65))$", r"^(?:(?:hcf|hcb|af|amg|tg|gox|go|fresh|soft)\d{2,4}|max(?:63|64|65)|l(?:55|65))$"
MAX_CODE = r"\b(?:hcf|hcb|tg|go|l)\s*max\s*(?:x|63|64|65)\b"
SOFT_CODE = r"\b(?:a\s+)?((?:soft|fresh)\s*[- ]?\s*\d{2,4})\b"
NUMBER_CODE = r"\b(?:hcf|hcb|af|amg|tg|gox|fresh|soft)\s*[- ]?\s*\d{2,4}\b"
GO_CODE = r"\bgo\s*[- ]?\s*\d{2,4}\b"
QUERY_NUMBER_CODE = r"\b(?:hcf|hcb|af|amg|tg|gox|go|fresh|soft)\s*[- ]?\s*\d{2,4}\b"


def first_of(text: Column, table: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The name of the first entry of which a part occurs; null if none."""
    return reduce(lambda c, entry: c.when(any_of(text, entry[1]), entry[0]), table[1:], F.when(any_of(text, table[0][1]), table[0][0]))


def section(norm: Column) -> Column:
    return first_of(norm, SECTIONS)


def product_class(text: Column) -> Column:
    return F.coalesce(first_of(normal_token(text), PRODUCTS), F.lit("other"))


def canonical_code(code: Column) -> Column:
    return rewritten(F.regexp_replace(normal_token(code), "[ -]", ""), [("^asoft", "soft"), ("^afresh", "fresh")])


def _codes(norm: Column, found: Column, phrases: list[tuple[str, int]]) -> Column:
    # what begins a code is asked for before the edge of a word, which is dear
    first = lambda p: F.lit(r"(?=[hatgofsl])" + p)
    every = F.flatten(F.array(found, *[F.regexp_extract_all(norm, first(p), g) for p, g in phrases]))
    return F.array_sort(F.array_distinct(F.transform(every, canonical_code)))


#: What every code of a normal form holds, asked for by its digits: two of them behind a letter that ends a code's name.
_CODED = r"\d\d(?<=[fbgxohtl][- ]{0,3}\d\d)"


def doc_codes(norm: Column) -> Column:
    tokens = F.regexp_extract_all(norm, F.lit(rf"(?=[hatgofslm])(?<![^ ])(?:{DOC_TOKEN_CODE[1:-1]})(?![^ ])"), 0)
    every = _codes(norm, tokens, [(MAX_CODE, 0), (SOFT_CODE, 1), (NUMBER_CODE, 0), (GO_CODE, 0)])
    return F.when(norm.rlike(_CODED) | F.contains(norm, F.lit("max")), every).when(norm.isNotNull(), F.array().cast("array<string>"))


def query_codes(norm: Column, tokens: Column) -> Column:
    """Codes of a normal form and of tokens, which may be those of a longer text."""
    return _codes(norm, F.filter(tokens, lambda t: t.rlike(r"\d|max") & t.rlike(QUERY_TOKEN_CODE)), [(MAX_CODE, 0), (SOFT_CODE, 1), (QUERY_NUMBER_CODE, 0)])


def family(norm: Column) -> Column:
    """First match of an ordered cascade; `has` wants a word, `within` any part."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    has, within = (lambda w: F.contains(padded, F.lit(f" {w} "))), (lambda w: F.contains(norm, F.lit(w)))
    return (
        F.when(within("acide ascorbique") | has("e300"), "ascorbic")
        .when(has("hcf") | (has("xylanase") & within("hcf")), "hcf")
        .when(has("hcb"), "hcb")
        .when(has("tg") | within("transglutaminase"), "tg")
        .when(has("gox") | has("glucose oxidase"), "gox")
        .when(within(" go max "), "go")
        .when(has("af") | (within("amylase") & within("af")), "af")
        .when(has("amg") | within("amyloglucosidase"), "amg")
        .when(has("lipase") | within(" l max ") | norm.rlike(r"\bl(?:55|65)\b"), "lipase")
        .when(has("fresh") | has("soft"), "fresh_soft")
        .otherwise("other")
    )


def family_set(tokens: Column) -> Column:
    known = F.array_intersect(tokens, F.array(*map(F.lit, FAMILY_TOKENS)))
    soft = F.when(F.array_contains(tokens, "fresh") | F.array_contains(tokens, "soft"), F.array(F.lit("fresh_soft"))).otherwise(F.array().cast("array<string>"))
    lipase = F.when(F.array_contains(tokens, "lipase"), F.array(F.lit("lipase"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.array_union(known, soft), lipase))


def canonical_doc_id(doc_id: Column) -> Column:
    return F.btrim(rewritten(normal_token(doc_id), [(r"\btds\b", " "), (r"\bpdf\b", " "), (r"\s+", " ")]), F.lit(" "))


def dosages(norm: Column) -> dict[str, Column]:
    return {k: F.when(F.contains(norm, F.lit("ppm")), F.nullif(F.regexp_extract(norm, p, 1), F.lit(""))) for k, p in DOSAGES.items()}


def stem(file_name: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


def uuid5_url(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
