"""The queries of this subpackage, each over the whole of its table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, line_dedup, lm_score, quality, secret_scan, sentencepiece_codec, simhash_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(_table(spark, sf_dir, "documents")).drop("text_hash", "first")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold the template's own control strings."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = chat_format.conversation_digests(given.unionByName(extra))
    return rows.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_embedding_near_dedup, op3_simhash_near_dedup, op4_chat_formatting, op5_lm_scoring, op6_benchmark_decontamination, op7_secret_scan, op8_toxicity, op9_line_dedup, op10_quality)}

_CONTROL = r"(<)(\\*(?:s>|/s>|<SYS>>|</SYS>>|unk>|\|endoftext\|>|\|im_start\|>|\|im_end\|>))|(\[)(\\*/?INST\])"

ORACLES = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT *, sqrt(list_inner_product(v, v)) AS s FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.s * b.s) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.root::BIGINT AS component_id, e.vec_id = r.root AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) r ON r.id = e.vec_id""",
    "op4_chat_formatting": f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, length(text) + length(role) + len(regexp_extract_all(text, '{_CONTROL}')) + len(regexp_extract_all(role, '{_CONTROL}')) + 17 AS n FROM given)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  (sum(n) + 3)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op6_benchmark_decontamination": r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS t, least(len(w), 10) AS size
  FROM item, unnest(range(greatest(1, len(w) - 9))) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT k, s, size, array_to_string(w[s + 1 : s + size], ' ') AS t FROM doc, sizes, unnest(range(len(w) - size + 1)) AS u(s) WHERE len(w) >= size),
found AS (SELECT p.k, p.s, p.size, x.item_id FROM place p JOIN win x ON p.t = x.t AND p.size = x.size),
hit AS (SELECT k, count(DISTINCT s + o) AS n FROM found, unnest(range(size)) AS u(o) GROUP BY k),
items AS (SELECT k, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM found) GROUP BY k),
-- By proximity: of the five rarest words of an item that occur at all, four (all of fewer) within 20 words of an early one of them.
term AS (SELECT DISTINCT item_id, unnest(w) AS t FROM item),
word AS (SELECT k, t, p FROM (SELECT k, unnest(w) AS t, unnest(range(len(w))) AS p FROM doc) WHERE t IN (SELECT t FROM term)),
ranked AS (
  SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY c, t) AS r
  FROM term JOIN (SELECT t, count(*) AS c FROM word GROUP BY t) USING (t)),
plan AS (
  SELECT item_id, m, least(need, m) AS need
  FROM (SELECT item_id, least(4, count(*)) AS need FROM term GROUP BY item_id) JOIN (SELECT item_id, least(5, count(*)) AS m FROM ranked GROUP BY item_id) USING (item_id)
  WHERE m >= need OR m >= greatest(2, need - 1)),
chosen AS (SELECT item_id, t, r, m, need FROM ranked JOIN plan USING (item_id) WHERE r <= 5),
anchor AS (SELECT c.item_id, c.r, c.need, w.k, w.p FROM chosen c JOIN word w ON w.t = c.t WHERE c.r <= c.m - c.need + 1),
other AS (
  SELECT a.item_id, a.r, a.k, a.p, count(DISTINCT c.r) AS n
  FROM anchor a JOIN chosen c ON c.item_id = a.item_id AND c.r <> a.r JOIN word w ON w.k = a.k AND w.t = c.t AND w.p BETWEEN a.p - 20 AND a.p + 20 GROUP BY ALL),
near AS (
  SELECT a.k, count(DISTINCT a.item_id) AS n FROM anchor a LEFT JOIN other o ON o.item_id = a.item_id AND o.r = a.r AND o.k = a.k AND o.p = a.p
  WHERE 1 + coalesce(o.n, 0) >= a.need GROUP BY a.k)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated, coalesce(x.n, 0)::BIGINT AS n_near
FROM doc d LEFT JOIN hit h USING (k) LEFT JOIN items i USING (k) LEFT JOIN near x USING (k)""",
    # Lines go by doc_id and line number: ids are unique in the table, so the hash of the text never decides.
    "op9_line_dedup": r"""
WITH doc AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents),
line AS (
  SELECT d, i, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
  FROM (SELECT d, unnest(arr) AS raw, unnest(range(len(arr))) AS i FROM doc)),
one AS (SELECT line, length(line) AS n, min((d, i)) AS pos FROM line WHERE line <> '' GROUP BY line),
half AS (
  SELECT line, n, pos, c, side, md5(CASE side WHEN 0 THEN left(line, c // 2) ELSE right(line, c // 2) END) AS h
  FROM (SELECT *, unnest([n, n, n - 1, n - 1]) AS c, unnest([0, 1, 0, 1]) AS side FROM one WHERE n >= 4)),
pair AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.pos AS a_pos, b.pos AS b_pos FROM half a JOIN half b USING (c, side, h)
  WHERE a.n BETWEEN b.n AND b.n + 1 AND a.n >= 5 AND a.line <> b.line),
apart AS (
  SELECT *, string_split(a, '') AS x, string_split(b, '') AS y FROM pair),
place AS (
  SELECT a, b, a_pos, b_pos, coalesce(list_position(list_transform(range(1, len(y) + 1), lambda k: x[k] <> y[k]), true) - 1, len(y)) AS p, len(x) - len(y) AS more FROM apart),
gone AS (
  SELECT CASE WHEN a_pos > b_pos THEN a ELSE b END AS line FROM place
  WHERE substr(a, p::BIGINT + 2) = substr(b, p::BIGINT + 2 - more)),
kept AS (
  SELECT l.d, l.i, l.raw FROM line l LEFT JOIN one o ON o.line = l.line AND o.pos = (l.d, l.i)
  WHERE l.line = '' OR (o.line IS NOT NULL AND l.line NOT IN (SELECT line FROM gone)))
SELECT doc.doc_id, len(doc.arr)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_kept, sha256(coalesce(k.t, '')) AS text_sha256
FROM doc LEFT JOIN (SELECT d, count(*) AS n, string_agg(raw, chr(10) ORDER BY i) AS t FROM kept GROUP BY d) k USING (d)""",
}
