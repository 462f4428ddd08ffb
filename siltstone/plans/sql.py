"""Pieces of DuckDB SQL that several oracles share, and the derived views that both engines read."""

from __future__ import annotations

from siltstone.functions import text as T


def rewrites(expression: str, rules: list[tuple[str, str]], flags: str = "g") -> str:
    """Nested global regexp_replace calls in the order of the rules."""
    for pattern, new in rules:
        expression = f"regexp_replace({expression}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', '{flags}')"
    return expression


#: White space of all of Unicode, inside a class.
SPACE = T.CLASSES["s"]


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def norm(x: str) -> str:
    return squeeze(rewrites(f"lower(strip_accents({x}))", [(r"[^a-z0-9%/\-\s]", " ")]))


def tokens(x: str, least: int = 2) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda t: length(t) >= {least}))"


def joined(x: str) -> str:
    return f"array_to_string(list_sort({x}), ',')"


#: Product sheets made from `part`: text with codes, dosages, limits and storage notes. Valid in both engines.
SPEC = """SELECT p_partkey AS k, concat('part ', p_partkey, ' TDS') AS doc_id, concat('Sheet_', p_partkey % 97, '.v1.pdf') AS file_name, p_brand AS brand,
concat(
 CASE p_partkey % 9 WHEN 0 THEN 'HCF ' WHEN 1 THEN 'HCB-' WHEN 2 THEN 'TG ' WHEN 3 THEN 'GOX ' WHEN 4 THEN 'AF' WHEN 5 THEN 'A Soft ' WHEN 6 THEN 'L Max 64 lipase ' WHEN 7 THEN 'Acide ascorbique E300 ' ELSE 'Améliorant ' END,
 100 + p_partkey % 900, '. ',
 CASE p_partkey % 4 WHEN 0 THEN 'For bread improvement ' WHEN 1 THEN 'Suggested optimum dosage ' WHEN 2 THEN 'Dosage range ' ELSE 'Recommended dosage: ' END,
 p_size, '-', p_size + 10, ' ppm. ',
 CASE p_partkey % 6 WHEN 0 THEN 'Shelf life 24 months. Store below ' WHEN 1 THEN 'Storage temperature 5 - ' WHEN 2 THEN 'Activity 10000 U/g for panification below ' WHEN 3 THEN 'Directive 1829/2003 applies up to ' WHEN 4 THEN 'Allergens: wheat, soya and milk. Kept under ' ELSE 'Biscuit and cracker use at ' END,
 p_size % 30 + 1, ' C. ',
 CASE p_partkey % 3 WHEN 0 THEN 'Heavy metals: Cadmium: <0.5 mg/kg. Lead: <5 mg/kg.' WHEN 1 THEN 'Relative humidity below 65%.' ELSE 'Tel: 123 456, mail us at www.x.org, a, b, c' END) AS text FROM part"""

#: A stated set of questions. Valid in both engines.
QUESTIONS = """SELECT * FROM (VALUES
(1, 'what is the recommended dosage for bread improvement?'), (2, 'HCF 600 storage temperature and shelf life'), (3, 'heavy metals cadmium and lead limits'),
(4, 'TG max 63 activity'), (5, 'acide ascorbique e300 dosage maximum autorise'), (6, 'which directive is the legal basis'), (7, 'suggested optimum gox dosage ppm'),
(8, 'soft 305 for pain de mie'), (9, 'enzyme activity in skb'), (10, 'tell me about lipase'), (11, 'l max64 humidity'), (12, 'allergens gluten wheat')) AS q(query_id, question)"""


def over_spec(select: str, rest: str = "") -> str:
    return f"WITH spec AS ({SPEC}) SELECT {select} FROM spec {rest}"


def over_questions(select: str, rest: str = "") -> str:
    return f"WITH questions AS ({QUESTIONS}) SELECT {select} FROM questions {rest}"
