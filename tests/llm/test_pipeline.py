import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import xxhash
from siltstone.llm import quality
from test_near_dedup import plain_components, plain_fingerprint, plain_lines

ROOT = Path(__file__).resolve().parents[2]


def test_stages_work_on_what_is_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns, name
        after = after.cache()
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = after
        counts.append(after.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] * 0.5
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == counts[-1] and last.where("not parity or not same_text").count() == 0
    assert corpus_pipeline.run(spark, sf).select("doc_id").exceptAll(last.select("doc_id")).count() == 0


def test_planted_cases(spark, sf, tmp_path):
    """Copies, a benchmark passage and junk go; clean texts stay as they are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = [x for x in docs.where("length(text) between 800 and 3000").collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()
    words = " ".join(f"unseen{k}" for k in range(60))
    rows = [(10**6, words + " first\n" + words[::-1], "en", "src1", 1), (10**6 + 1, words + " first\n" + words[::-1], "en", "src1", 1), (10**6 + 2, "Before it. " + item.text + " After it.", "en", "src2", 1)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    lines = corpus_pipeline.line_near_dedup(spark, more, sf)
    assert lines.where("doc_id = 1000001").count() == 0 and lines.where("doc_id = 1000000").first().text == rows[0][1]
    near = corpus_pipeline.simhash_near_dedup(spark, more, sf)
    assert near.where("doc_id = 1000001").count() == 0 and near.where("doc_id = 1000000").count() == 1
    leaks = corpus_pipeline.benchmark_decontamination(spark, more, sf)
    assert leaks.where("doc_id = 1000002").count() == 0 and leaks.where("doc_id = 1000000").count() == 1
    assert clean


def test_the_rest_imports_without_it(tmp_path):
    """The entry module works where this subpackage and the pipeline are gone."""
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q)[:5]; assert set(e.oracle_sql()) <= set(q)"
    for p in ROOT.iterdir():
        if p.name not in ("siltstone", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "siltstone").mkdir()
    for p in (ROOT / "siltstone").iterdir():
        if p.name != "llm":
            (tmp_path / "siltstone" / p.name).symlink_to(p)
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def plain_posteriors(rows):
    """(host, path, own) of documents to p, by hand: grouped sums, priors by the method of moments, shrinkage to host and corpus."""
    p = [1 / (1 + np.exp(-own)) for *_, own in rows]
    n, s, hn, hs = ({} for _ in range(4))
    for (host, path, _), x in zip(rows, p, strict=True):
        for d, e, k in ((n, s, (host, path)), (hn, hs, host)):
            d[k], e[k] = d.get(k, 0) + 1, e.get(k, 0) + round(x * 1e6) / 1e6
    total = sum(n.values())
    mean = (sum(s.values()) + 1) / (total + 2)

    def strength(n, s, centre):
        c = mean * (1 - mean)
        between = (sum(n[k] * (s[k] / n[k] - centre(k)) ** 2 for k in n) - len(n) * c) / total
        return float(np.clip(c / between - 1, 1, 1e6)) if between > 0 else 1e6

    a = strength(hn, hs, lambda k: mean)
    of_host = {k: (hs[k] + a * mean) / (hn[k] + a) for k in hn}
    b = strength(n, s, lambda k: of_host[k[0]])
    logit = lambda x: np.log(x / (1 - x))
    of_path = {k: (s[k] + b * of_host[k[0]]) / (n[k] + b) for k in n}
    return [1 / (1 + np.exp(-(own + logit(of_path[host, path]) - logit(mean)))) for host, path, own in rows]


def test_quality_by_hand(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).collect()
    want = plain_posteriors([(x.host, x.path, x.text_log_odds) for x in got])
    assert np.allclose([x.p_quality for x in got], want, atol=2e-5)
    assert all(x.keep == (p >= 0.5) for x, p in zip(got, want, strict=True) if abs(p - 0.5) > 1e-4)


def plain_pipeline(rows, kept, items):
    """Each stage by brute force on (doc_id, text) rows; what the classifier keeps is given. Rows with both alike are one document."""
    import re

    import sentencepiece

    from siltstone.llm import sentencepiece_codec

    order = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted((r for r in rows if r in kept), key=order)
    documents = list(dict.fromkeys((i, t or "") for i, t in rows))
    lines = plain_lines([(k, t) for k, (_, t) in enumerate(documents)])
    after = {}
    for k, doc in enumerate(documents):
        new = lines[k]
        if any(x.strip(" \t\r\f\x0b") for x in new.split("\n")) or not any(x.strip(" \t\r\f\x0b") for x in doc[1].split("\n")):
            after[doc] = new
    rows = [(i, after[i, t or ""]) for i, t in rows if (i, t or "") in after]
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    last = lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)))
    first = {c: min(last(r) for r, d in zip(rows, comps, strict=True) if d == c) for c in comps}
    rows = [r for r, c in zip(rows, comps, strict=True) if last(r) == first[c]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    windows = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in range(1, 11) for k in range(len(w) - n + 1))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    return sorted((i or -1, sp.encode(t)) for i, t in rows if not hit(words(t)))


def test_against_a_plain_version(spark, sf, tmp_path):
    """The whole pipeline on null texts and ids, repeated rows, ties, and columns of the names that stages use."""
    given = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(120).collect()
    long = " ".join(f"word{k}" for k in range(80))
    more = [(None, long + " of nobody"), (None, long + " of nobody"), (None, None), (5000, None), (5000, None), (5001, ""), (5002, long + " of somebody"), (5002, "another text under the same id, " + long[::-1]), (5003, "  \n\n "), (5004, "tie one\ntie two"), (5005, "tie onx\ntie two\nown line of it")]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    more += [(None, f"Nobody's copy: {item}"), (5006, f"Before. {item} After."), (5006, "a clean text of the id that also has the passage")]
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in given] + [(i, t, "en", "src1" if k % 2 else None) for k, (i, t) in enumerate(more)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __gone int, __host string, __keep boolean"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "h", False) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {(x.doc_id, x.text) for x in corpus_pipeline.quality_classifier(spark, stored, str(tmp_path)).collect()}
    items = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_pipeline([(r[0], r[1]) for r in rows], kept, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id or -1, list(x.ids)) for x in got) == want and len(want) > 50
    assert corpus_pipeline.simhash_near_dedup(spark, stored, str(tmp_path)).columns == stored.columns


def test_an_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
