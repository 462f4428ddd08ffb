"""Structured answers from passages: unit forms, intents, and what each intent extracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import any_of, boilerplate_line, bound, clean_answer, folded, guarded, pretty_table, rewritten, sentences, squeezed, token_set, without_boilerplate

# Unit rewrites, in the order in which they apply.
UNIT_RULES = [
    (r"[–—]", "-"), (r"\bper\s*cent\b", "%"), (r"\bpercent(?:age)?\b", "%"), (r"\bp\.?\s*p\.?\s*m\.?\b", "ppm"), (r"\bparts?\s+per\s+million\b", "ppm"),
    (r"\bmg\s*/?\s*kg\b", "mg/kg"), (r"\bg\s*/?\s*kg\b", "g/kg"), (r"\bkg\s*/?\s*t(?:on(?:ne)?)?\b", "kg/t"), (r"\bg\s*/?\s*100\s*kg\b", "g/100kg"),
    (r"\bi\.?\s*u\.?\s*/?\s*g\b", "u/g"), (r"\bu\s*/?\s*g\b", "u/g"), (r"\bskb\s*/?\s*g\b", "skb/g"), (r"\bfau\s*/?\s*g\b", "fau/g"), (r"\bnmau\s*/?\s*g\b", "nmau/g"),
    (r"\bxylh\s*/?\s*g\b", "xylh/g"), (r"\bagi\s*/?\s*g\b", "agi/g"), (r"\brelative\s+humidity\b", "humidity"), (r"\brh\b", "humidity"), (r"\bshelf[\s-]*life\b", "shelf life"),
    (r"\bnot\s+more\s+than\b", "<="), (r"\bnot\s+less\s+than\b", ">="), (r"\bat\s+or\s+below\b", "<="), (r"\bat\s+or\s+above\b", ">="), (r"(\d)\s+to\s+(\d)", "$1-$2"),
    (r"(\d)\s*(?:~|−)\s*(\d)", "$1-$2"), (r"(\d)\s*°\s*c\b", "$1 c"), (r"(\d)\s*c\b", "$1 c"), (r"\bcelsius\b", "c"),
]
#: Parts that each rule's matches hold, in lower case; a text without them is passed over.
UNIT_NEEDS = (
    (), ("cent",), ("percent",), ("p", "m"), ("million",), ("mg", "kg"), ("g", "kg"), ("kg", "t"), ("100", "kg"), ("i", "u", "g"), ("u", "g"), ("skb", "g"), ("fau", "g"), ("nmau", "g"), ("xylh", "g"), ("agi", "g"),
    ("humidity",), ("rh",), ("shelf",), ("not", "more"), ("not", "less"), ("below",), ("above",), ("to",), (), ("°",), ("c",), ("celsius",),
)
INTENTS = (
    ("dosage", ("dosage", "dose", "ppm", "recommended", "suggested", "application rate")),
    ("activity", ("activity", "enzyme unit", "u/g", "fau/g", "skb/g", "agi/g", "xylh/g", "nmau/g")),
    ("metals", ("cadmium", "lead", "mercury", "arsenic", "heavy metal")),
    ("allergen", ("allergen", "gluten")),
    ("storage", ("storage", "shelf life", "humidity", "temperature", "durability", "expiry")),
    ("regulatory", ("regulation", "directive", "codex", "innorpi", "gmo", "labeling", "compliance")),
)
ALLERGENS = (
    ("egg", ("egg", "eggs")), ("gluten", ("gluten", "wheat")), ("milk", ("milk", "lactose", "dairy")),
    ("nuts", ("nuts", "nut", "peanut", "almond", "hazelnut", "walnut", "cashew")), ("soy", ("soy", "soya", "soybean")),
)
METALS = ("cadmium", "lead", "mercury", "arsenic")
REGULATIONS = ("regulation", "directive", "codex", "innorpi", "1829/2003", "1830/2003", "1169/2011", "gmo")
ACTIVITY_UNITS = "(u/g|skb/g|fau/g|nmau/g|xylh/g|agi/g)"
NUMBER = r"(\d+(?:[.,]\d+)?)"
SPAN_UNITS = ("ppm", "mg/kg", "months", "temperature")


def unit_string(text: Column) -> Column:
    rules = zip(UNIT_RULES, UNIT_NEEDS, strict=True)
    return squeezed(reduce(lambda c, x: guarded(c, f"(?i){x[0][0]}", x[0][1], x[1]) if x[1] else rewritten(c, [(f"(?i){x[0][0]}", x[0][1])]), rules, text))


def answer_norm(text: Column) -> Column:
    units = unit_string(F.replace(folded(text), F.lit("’"), F.lit("'")))
    return squeezed(rewritten(units, [(r"[^a-z0-9%/\-.\s]", " "), (r"\.(?<!\d\.)(?!\d)", " ")]))


def intent(question: Column) -> Column:
    """By parts of the normalised question, first table entry wins."""
    of = lambda q: reduce(lambda c, e: c.when(any_of(q, e[1]), e[0]), INTENTS[1:], F.when(any_of(q, INTENTS[0][1]), INTENTS[0][0])).otherwise("generic")
    return bound(answer_norm(question), of)


def allergens(norm: Column) -> Column:
    return F.array_compact(F.array(*[F.when(norm.rlike(rf"\b(?:{'|'.join(terms)})\b"), F.lit(name)) for name, terms in ALLERGENS]))


def metal_limits(norm: Column) -> Column:
    """`metal value mg/kg` for each distinct limit, by metal, then by place."""
    return _limits(unit_string(norm))


def _limits(units: Column) -> Column:
    none = F.array().cast("array<string>")

    def of(body: Column, metal: str) -> Column:
        pattern = rf"(?i){metal}[^.\n;]{{0,80}}?(<=|>=|<|>)?\s*(\d+(?:\.\d+)?)\s*mg/kg"
        pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), 1).alias("s"), F.regexp_extract_all(body, F.lit(pattern), 2).alias("v"))
        found = F.transform(pairs, lambda p: F.concat(F.lit(f"{metal} "), p["s"], p["v"], F.lit(" mg/kg")))
        return F.when(F.contains(F.lower(body), F.lit(metal)), found).otherwise(none)

    every = lambda body: F.array_distinct(F.flatten(F.array(*[of(body, m) for m in METALS])))
    return bound(F.replace(units, F.lit(","), F.lit(".")), every)


def _found(text: Column, pattern: str, form) -> Column:
    """form(groups) where the pattern occurs, else null; form gets a function from group number to Column."""
    return F.when(text.rlike(pattern), form(lambda k: F.regexp_extract(text, pattern, k)))


def _dosage(norm: Column) -> Column:
    spread = rf"{NUMBER}\s*(?:-|to|–)\s*{NUMBER}\s*ppm"
    cue = r"(?:dosage|dose|recommended|suggested|optimum)[^.\n]{0,120}?"
    other = rf"(?:dosage|dose|recommended|suggested|optimum|application rate|addition level)[^.\n]{{0,120}}?{NUMBER}\s*(g/100kg|kg/t|%)"
    both = lambda g: F.concat(F.lit("dosage: "), g(1), F.lit("-"), g(2), F.lit(" ppm"))
    return unit_string(F.coalesce(_found(norm, cue + spread, both), _found(norm, spread, both), _found(norm, other, lambda g: F.concat(F.lit("dosage: "), g(1), F.lit(" "), g(2)))))


def _activity(body: Column) -> Column:
    form = lambda g: F.concat(F.lit("activity: "), g(1), F.lit(" "), g(2))
    near = rf"[^.\n]{{0,80}}?{NUMBER}\s*{ACTIVITY_UNITS}"
    return unit_string(F.coalesce(_found(body, "activity" + near, form), _found(body, r"(?:enzyme\s+activity|declared\s+activity|units?)" + near, form)))


def _storage(norm: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    shelf = _found(norm, r"(\d+(?:\s*-\s*\d+)?)\s*(months?|years?)", lambda g: F.concat(F.lit("shelf life: "), bare(g(1)), F.lit(" "), g(2)))
    heat = lambda g: F.concat(F.lit("temperature: "), bare(g(1)), F.lit(" c"))
    degrees = r"(\d+(?:\s*-\s*\d+)?)\s*c"
    warm = F.coalesce(_found(norm, rf"(?:below|under|<|<=|between)\s*{degrees}", heat), _found(norm, degrees, heat))
    damp = _found(norm, r"humidity[^.\n]{0,30}?(?:<|<=|below|under)?\s*(\d+)\s*%", lambda g: F.concat(F.lit("humidity: <"), g(1), F.lit("%")))
    return F.nullif(unit_string(F.concat_ws("; ", shelf, warm, damp)), F.lit(""))


def best_span(asked: Column, parts: Column, fallback: Column) -> Column:
    """The first sentence of the largest share of question tokens, 0.2 more with a unit, passing over boilerplate."""

    def score(p: Column) -> Column:
        own = token_set(p, 1)
        has = F.arrays_overlap(own, F.array(*map(F.lit, SPAN_UNITS)))
        return F.when(boilerplate_line(p), F.lit(-1.0)).otherwise(F.size(F.array_intersect(asked, own)) / F.greatest(F.size(asked), F.lit(1)) + F.when(has, 0.2).otherwise(0.0))

    scores = F.transform(parts, score)
    return F.coalesce(F.get(parts, (F.array_position(scores, F.array_max(scores)) - 1).cast("int")), fallback)


def with_presentable(rows: DataFrame, question: str, text: str, to: str) -> DataFrame:
    """Adds the text without boilerplate, or its best span where half of its sentences or more are boilerplate.

    Each step is a column of its own: what several steps read is worked out once.
    """
    step = unheard(rows, text).withColumn("__asked", F.when(F.col("__heavy"), token_set(F.col(question), 1)))
    return step.withColumn(to, presentable(F.col(text))).drop("__c", "__heavy", "__all", "__asked")


def unheard(rows: DataFrame, text: str) -> DataFrame:
    """What with_presentable works out of a text whatever is asked: __c, the text without boilerplate; __heavy, whether half of its
    sentences or more are boilerplate; __all, the sentences to choose from then."""
    t = F.col(text)
    step = rows.withColumn("__c", without_boilerplate(t)).withColumn("__c", F.when(squeezed(F.col("__c.text")) != "", F.col("__c.text")).otherwise(t))
    step = step.withColumn("__parts", sentences(F.col("__c"))).withColumn("__noisy", F.size(F.filter("__parts", lambda p: boilerplate_line(p))))
    heavy = (F.size("__parts") > 0) & (F.col("__noisy") * 2 >= F.size("__parts"))
    return step.withColumn("__heavy", heavy).withColumn("__all", F.when(F.col("__heavy"), sentences(t))).drop("__parts", "__noisy")


def presentable(text: Column) -> Column:
    """Of unheard's columns and the question's tokens, __asked."""
    return clean_answer(F.when(F.col("__heavy"), best_span(F.col("__asked"), F.col("__all"), text)).otherwise(F.col("__c")))


def with_structured(rows: DataFrame, question: str, passage: str, answer: str = "answer", confidence: str = "confidence") -> DataFrame:
    """Adds the answer and its confidence for the question's intent; the presentable passage at 0.6 where nothing is found."""
    step = rows.withColumn("__t", pretty_table(F.col(passage))).withColumn("__q", F.col(question)).withColumn("__kind", intent(F.col("__q"))).withColumn("__n", answer_norm(F.col("__t")))
    step = step.withColumn("__u", F.when(F.col("__kind").isin("metals", "activity"), unit_string(F.col("__n"))))
    step = step.withColumn("__list", listed()).withColumn("__found", found())
    sure = confidence_of(F.col("__found"), F.col("__kind"))
    plain = with_presentable(step.withColumn(confidence, sure).withColumn("__open", F.when(F.col("__found").isNull(), F.col("__t"))), "__q", "__open", "__plain")
    return plain.withColumn(answer, F.coalesce("__found", "__plain")).drop("__t", "__q", "__kind", "__n", "__list", "__found", "__open", "__plain", "__u")


def listed() -> Column:
    """The metals' limits or the allergens, by __kind, of a passage's normal form __n and its unit form __u."""
    kind = F.col("__kind")
    return F.when(kind == "metals", _limits(F.col("__u"))).when(kind == "allergen", allergens(F.col("__n")))


def found() -> Column:
    """What __kind extracts from a passage (__t, its forms __n and __u, and __list); null if nothing."""
    norm, kind, some = F.col("__n"), F.col("__kind"), F.size("__list") > 0
    state = F.when(norm.rlike(r"\bfree from\b|\ballergen[-\s]*free\b|\bdoes not contain\b"), "free_from").otherwise("contains")
    # no rule of the normal form makes such a part, so a passage without any has no such sentence
    rule = F.when(any_of(folded(F.col("__t")), REGULATIONS), F.get(F.filter(sentences(F.col("__t")), lambda s: any_of(answer_norm(s), REGULATIONS)), F.lit(0)))
    return (
        F.when(kind == "dosage", _dosage(norm)).when(kind == "activity", _activity(F.col("__u"))).when((kind == "metals") & some, F.array_join("__list", "; "))
        .when((kind == "allergen") & some, F.concat(F.lit("allergens "), state, F.lit(": "), F.array_join("__list", ", ")))
        .when(kind == "storage", _storage(norm)).when(kind == "regulatory", unit_string(rule))
    )


def confidence_of(found_: Column, kind: Column) -> Column:
    return F.when(found_.isNull(), 0.6).when(kind.isin("dosage", "activity", "metals"), 0.95).when(kind == "regulatory", 0.85).otherwise(0.90)


def numeric_atoms(norm: Column) -> Column:
    """Distinct numbers of a normalised answer, digits joined over spaces, trailing zeros taken off."""
    raw = F.regexp_extract_all(norm, F.lit(r"(?<![a-z0-9])\d[\d\s]*(?:[.,]\d+)?(?![a-z0-9])"), 0)
    value = lambda x: F.format_string("%.6f", F.replace(F.regexp_replace(x, r"\s", ""), F.lit(","), F.lit(".")).cast("double"))
    return F.array_distinct(F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(value(x), "0+$", ""), r"\.$", "")))
