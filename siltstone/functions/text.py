"""Text functions as Column expressions: cleaning, folding, tokens, language, sections, boilerplate."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FR_MARKERS = ("le", "la", "des", "avec", "pour", "améliorant", "température")
EN_MARKERS = ("the", "with", "for", "shelf", "storage", "bread")
UNIT_TOKENS = r"\b(?:ppm|mg/kg|u/g|nmau/g|xylh/g|°c|kg|g|months?)\b"
CONTACT = r"(?i)(?:https?://|www\.|[\w.\-]+@[\w.\-]+\.\w+|\+\d[\d\s().-]{5,}|\b(?:tel|phone|mail|email|website)\b)"
SIGNATURE_TOKENS = ("vtr", "vtrbeyond", "pingbei", "stresemann", "zhuhai", "guangdong", "berlin", "technical", "sheet")


#: What \\s, \\d and \\w stand for, inside a class: white space, decimal digits, and letters and numbers of all scripts.
CLASSES = {
    "s": r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
    "d": r"\p{Nd}", "w": r"\p{L}\p{N}_",
}
#: The same, for a place inside a class. The JVM asks the parts of a class one by one, and ranges united with others are so slow on
#: several threads that they take most of a query's time; characters listed singly are one look into a table, and the rest of
#: Unicode is asked for behind a test that ASCII fails.
_LETTERS, _NUMERALS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LISTED = {
    "s": r"\x09\x0a\x0b\x0c\x0d\x20\x1c\x1d\x1e\x1f\x85\xa0[[^\x00-\xff]&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]",
    "d": _NUMERALS + r"[[^\x00-\x7f]&&[\p{Nd}]]", "w": _LETTERS + _LETTERS.upper() + _NUMERALS + r"_[[^\x00-\x7f]&&[\p{L}\p{N}]]",
}
_QUICK = {k: f"[{v}]" for k, v in _LISTED.items()}
_SPANS = {"a-z": _LETTERS, "A-Z": _LETTERS.upper(), "0-9": _NUMERALS}
_EDGE = f"(?:(?<={_QUICK['w']})(?!{_QUICK['w']})|(?<!{_QUICK['w']})(?={_QUICK['w']}))"
#: All white space, to be trimmed.
_BLANKS = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@cache
def unicode(pattern: str) -> str:
    """The pattern with \\s, \\d, \\w and \\b written out for all of Unicode; the JVM takes them for ASCII. Ranges of ASCII are listed."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at : at + 3] if inside and pattern[at : at + 3] in _SPANS else pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        name = c[1:]
        if c in _SPANS:
            out.append(_SPANS[c])
        elif name in CLASSES:
            out.append(_LISTED[name] if inside else _QUICK[name])
        elif name == "b" and not inside:
            after = pattern[at + 2 : at + 3]
            out.append(f"(?={after})(?<!{_QUICK['w']})" if after.isascii() and after.isalpha() and pattern[at + 3 : at + 4] not in ("?", "*", "{") else _EDGE)
        else:
            out.append(c)
        inside = (inside or c == "[") and c != "]"
        at += len(c)
    return "".join(out)


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The (pattern, replacement) rules applied in order, over all of Unicode; each is its own pass over the text."""
    return reduce(lambda c, rule: F.regexp_replace(c, unicode(rule[0]), rule[1]), rules, text)


def guarded(text: Column, pattern: str, replacement: str, needs: tuple[str, ...]) -> Column:
    """The rule applied where the lower-case text holds all of the parts, without which the pattern can't match."""
    plain, cased = [n for n in needs if n.upper() == n.lower()], [n for n in needs if n.upper() != n.lower()]  # the first need no lower-case copy
    every = lambda x, parts: reduce(lambda a, b: a & b, [F.contains(x, F.lit(n)) for n in parts])
    low = lambda x: bound(F.lower(x), lambda y: every(y, cased)) if len(cased) > 1 else every(F.lower(x), cased)
    has = lambda x: every(x, plain) & low(x) if plain and cased else every(x, plain) if plain else low(x)
    return bound(text, lambda x: F.when(has(x), F.regexp_replace(x, unicode(pattern), replacement)).otherwise(x))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaced(text: Column, of: str) -> Column:
    """Every run of characters of a class as one space; runs that are one space already are passed over."""
    return F.regexp_replace(text, f"{of}(?:(?<! )|(?={of})){of}*", " ")


def squeezed(text: Column) -> Column:
    return F.btrim(spaced(text, _QUICK["s"]), F.lit(" "))


def cleanup(text: Column) -> Column:
    """Page text with one clean line a row: breaks unified, words rejoined over line ends, blanks squeezed, blank lines dropped."""
    flat = F.when(text.rlike(r"[\r\f]"), F.regexp_replace(text, r"\r[\n\f]?|\f", "\n")).otherwise(text)
    flat = spaced(guarded(flat, r"-\n(?=[a-zA-Z])", "", ("-\n",)), f"[{_QUICK['s']}&&[^\n]]")
    lines = F.filter(F.transform(F.split(flat, "\n", -1), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    return F.replace(F.replace(F.array_join(lines, "\n"), F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))


def for_embedding(text: Column) -> Column:
    named = guarded(F.replace(text, F.lit("："), F.lit(":")), r"(?i)\b(?:[a-z]{0,2})?\s*technical\s+data\s+sheet\b", " ", ("technical",))
    pairs = lambda x: F.when(x.rlike(unicode(r",(?=\d)(?<=\d,)")), F.regexp_replace(x, unicode(r"(\d),(\d)"), "$1.$2")).otherwise(x)  # noqa: E731  # asks for the comma first
    return squeezed(bound(named, pairs))


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without marks, of all of Unicode but Hangul syllables.

    Characters that become one other and, behind them, those that vanish; what the first become; and those that become several.
    """
    own = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(0x80, 0x110000) if not (0xD800 <= c < 0xE000 or 0xAC00 <= c <= 0xD7A3)}
    one = [(a, b) for a, b in own.items() if len(b) == 1 and a != b]
    return "".join(a for a, _ in one) + "".join(a for a, b in own.items() if not b), "".join(b for _, b in one), {a: b for a, b in own.items() if len(b) > 1}


#: A character that may stand for several: the long forms lie in these stretches. Each stretch is a test of its own, and short in a plan.
_MAYBE_LONG = r"[^\x00-\x{bb}](?<![\x{bf}-\x{131}])(?<![\x{1f4}-\x{586}])(?<![\x{1e9b}-\x{2024}])"


def _spread(text: Column) -> Column:
    """Characters that stand for several written out; only those that a text has are looked for in it."""
    table = F.lit("\x01" + "\x01".join(f"{a}\x02{b}" for a, b in _folds()[2].items()) + "\x01")
    key = lambda c: F.concat(F.lit("\x01"), c, F.lit("\x02"))
    own = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_MAYBE_LONG), 0)), lambda c: F.contains(table, key(c)))
    return F.aggregate(own, text, lambda t, c: F.replace(t, c, F.split_part(F.split_part(table, key(c), F.lit(2)), F.lit("\x01"), F.lit(1))))


def folded(text: Column) -> Column:
    """Compatibility decomposition without combining marks, lower-case. Hangul syllables stay whole; ASCII texts skip all passes but the last."""
    gone, new, _ = _folds()

    def of(x: Column) -> Column:
        whole = F.when(x.rlike(_MAYBE_LONG), _spread(x)).otherwise(x)
        return F.lower(F.when(x.rlike(r"[^\x00-\x7f]"), F.translate(whole, gone, new)).otherwise(x))

    return bound(text, of)


def normal_token(text: Column) -> Column:
    """The folded text with everything but a-z, 0-9, % / and - as single spaces."""
    return F.btrim(spaced(folded(text), unicode(r"[^a-z0-9%/\-]")), F.lit(" "))


def tokens_of(norm: Column, least: int = 2) -> Column:
    """Distinct tokens of a normal form with at least so many characters."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda x: F.length(x) >= least))


def token_set(text: Column, least: int = 2) -> Column:
    """Distinct tokens of the normal form with at least so many characters (2 for search, 1 for answers)."""
    return tokens_of(normal_token(text), least)


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(normal_token(text), " "), lambda x: x != "")).cast("long")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def language(text: Column) -> Column:
    def of(padded: Column) -> Column:
        fr, en = (any_of(padded, tuple(f" {m} " for m in markers)) for markers in (FR_MARKERS, EN_MARKERS))
        return bound(F.struct(fr.alias("fr"), en.alias("en")), lambda x: F.when(x["fr"] & ~x["en"], "fr").when(x["en"] & ~x["fr"], "en").otherwise("mixed"))

    return bound(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), of)


def section_title(text: Column) -> Column:
    """The first of the first six lines with 3 to 80 characters in capitals or title case."""
    def title(x: Column) -> Column:
        upper = (x == F.upper(x)) & (x != F.lower(x))
        cased = ~x.rlike(r"\p{L}\p{Lu}") & ~x.rlike(r"(^|[^\p{L}])\p{Ll}") & x.rlike(r"\p{Lu}")
        return F.length(x).between(3, 80) & (upper | cased)

    return F.coalesce(F.get(F.filter(F.slice(F.split(text, "\n", -1), 1, 6), title), F.lit(0)), F.lit("General"))


def units(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=[pmunxkg°]){unicode(UNIT_TOKENS)}"), 0)))


def content_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def boilerplate_line(line: Column, mode: str = "hybrid") -> Column:
    """Lines of addresses and contacts: by known signature words, by contacts alone, or by either."""
    some = lambda low: any_of(low, ("http", "www.", "@", "+", "tel", "phone", "mail", "website"))  # noqa: E731  # no contact is without one

    def found(norm: Column, contacts: Column) -> Column:
        padded = F.concat(F.lit(" "), norm, F.lit(" "))
        signature = reduce(lambda a, b: a + b, [F.contains(padded, F.lit(f" {t} ")).cast("int") for t in SIGNATURE_TOKENS])
        commas, words_ = F.regexp_count(line, F.lit(",")), F.size(F.array_distinct(F.filter(F.split(norm, " "), lambda x: x != "")))
        signed, generic = (signature >= 3) & (contacts >= 1), (contacts >= 2) | ((contacts >= 1) & (commas >= 4) & (words_ >= 8))
        return (norm != "") & {"signature": signed, "generic": generic, "hybrid": signed | generic}[mode]

    # most lines end at one of the two tests
    counted = lambda n: F.when(n == 0, F.lit(False)).otherwise(bound(normal_token(line), lambda norm: found(norm, n)))
    return F.when(~bound(F.lower(line), some), F.lit(False)).otherwise(bound(F.regexp_count(line, F.lit(unicode(CONTACT))), counted))


def without_signature(text: Column) -> Column:
    return guarded(text, r"(?is)vtr\s*&?\s*beyond.*?(technical\s+data\s+sheet)", "$1", ("vtr", "beyond", "technical"))


def without_boilerplate(text: Column, mode: str = "hybrid", least: int = 10) -> Column:
    """struct(text, removed, removed_chars): head and tail lines of boilerplate trimmed, taken back if too little is left."""
    working = without_signature(text) if mode != "generic" else text
    lines = F.filter(F.transform(F.split(working, r"[\n\r\f]", -1), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    plain = lambda ls: F.transform(ls, lambda x, i: F.when(~boilerplate_line(x, mode), i))
    cut = lambda ls, k: F.slice(ls, F.coalesce(F.array_min(k), F.lit(0)) + 1, F.coalesce(F.array_max(k) - F.array_min(k) + 1, F.lit(0)))
    kept = bound(lines, lambda ls: F.array_join(bound(plain(ls), lambda k: cut(ls, k)), "\n"))

    def chosen(new: Column) -> Column:
        fewer = F.length(text) - F.length(new)
        ok = (fewer > 0) & (new != "") & (token_count(new) >= max(1, least))  # the dear test last: most texts lose nothing
        return F.when(ok, F.struct(new.alias("text"), F.lit(True).alias("removed"), fewer.cast("long").alias("removed_chars"))).otherwise(F.struct(text.alias("text"), F.lit(False).alias("removed"), F.lit(0).cast("long").alias("removed_chars")))

    return bound(kept, chosen)


def without_pipes(text: Column) -> Column:
    rules = [(r"(?:\s*\|\s*){2,}", " | "), (r"\|\s*\|\s*\|+", "|"), (r"\s*\|\s*", "; "), (r"(?:;\s*){2,}", "; "), (r"^\s*;\s*|\s*;\s*$", "")]
    return F.when(F.contains(text, F.lit("|")), squeezed(rewritten(text, rules))).otherwise(text)


def clean_answer(text: Column) -> Column:
    return squeezed(rewritten(without_pipes(squeezed(text)), [(r"\s*\.\.\.$", "")]))


def sentences(text: Column) -> Column:
    return F.filter(F.split(squeezed(text), r" (?<=[.!?;] )"), lambda x: x != "")


def pretty_table(text: Column) -> Column:
    flat = squeezed(text)
    parts = F.filter(F.transform(F.split(flat, r"\|", -1), lambda x: F.btrim(x, F.lit(" :-"))), lambda x: (F.length(x) > 1) & ~x.rlike(r"^[|:/\\-]+$"))
    return F.when(~F.contains(flat, F.lit("|")) | (F.size(parts) == 0), flat).otherwise(F.array_join(parts, "; "))


def machine_phrases(text: Column) -> Column:
    pattern = r"(?i)Section:\s*([^;]+?)\s*;\s*Pour\s*([^,]+?)\s*,\s*dosage recommande:\s*([^.]+?)\s*\.\s*Observation:\s*([^.]+?)\s*(?:\.|(?=$))"
    return guarded(text, pattern, "Dans la section « $1 », la recommandation pour « $2 » indique un dosage de $3. Cette recommandation est accompagnee de la remarque suivante : $4.", ("section:", "observation:"))


def list_item(line: Column) -> Column:
    return line.rlike(unicode(r"^[\-\*•\d]+[\.)]?\s+"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """0-based starts of token windows: every step, up to the first window that reaches the end."""
    step = max(1, size - overlap)
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))


def words_of(squeezed_: Column) -> Column:
    """Words of a text of which all white space is single spaces."""
    return F.filter(F.split(squeezed_, " "), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, unicode(r"\s+")), lambda x: x != "")
