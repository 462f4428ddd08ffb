import itertools
import random

import numpy as np
import pytest
import xxhash

from siltstone.llm import embedding_dedup, line_dedup, simhash_dedup
from siltstone.llm.components import connected_components, roots


def plain_components(n, pairs):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    want = {x: c for x, c in enumerate(plain_components(141, pairs)) if any(x in p and p[0] != p[1] for p in pairs)}
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == want
    assert roots(141, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist() == plain_components(141, pairs)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k : k + n]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ["", " \n", "One", "a b c", "A b  c D\x0be É x", "x y z w " * 50, "to be or not to be that is"]:
        assert simhash_dedup.fingerprint(text.encode()) == plain_fingerprint(text), text


def simhash_case(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, perm int, key string, root long")
    return simhash_dedup.simhash_groups(df, **more).collect()


def test_simhash_against_all_pairs(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 120))) for _ in range(60)]
    for t in texts[:20]:
        for _ in range(4):
            w = t.split() or ["x"]
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += texts[:5] + ["", None, "   ", "long " * 30000]
    rows = [(k * 3, t, 1, 2, "x", 5) for k, t in enumerate(texts)]
    fps = [plain_fingerprint(t or "") for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = {k * 3: (f"{fps[k]:016x}", c * 3) for k, c in enumerate(plain_components(len(fps), pairs))}
    got = simhash_case(spark, rows)
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_simhash_odd_rows(spark):
    got = simhash_case(spark, [(None, "a b c d e", 0, 0, "", 0), (7, "a b c d e", 0, 0, "", 0), (7, "a b c d e", 0, 0, "", 0), (None, "quite another text here", 0, 0, "", 0)])
    assert sorted((x.doc_id or -1, x.component_id, x.kept) for x in got if x.component_id) == [(-1, 7, False), (7, 7, True), (7, 7, True)]
    assert simhash_case(spark, []) == []


@pytest.mark.parametrize("unit", [8, 2048])
def test_trie_links(spark, unit):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 200, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in r.choice(64, int(n), replace=False)) for b in base[:60] for n in r.integers(0, 7, 5)]
    fps = np.unique(np.concatenate((base, np.array(near, np.uint64), base[:1] ^ np.arange(40, dtype=np.uint64))))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1))
    want = roots(len(fps), i, j)
    df = spark.createDataFrame([(int(x), k % 7 == 0, k) for k, x in enumerate(fps.view(np.int64))], "fp long, nameless boolean, id long")
    links = [(x.a, x.b) for x in simhash_dedup.links(df, 4, unit).collect()]
    assert links and all(x.nameless == (x.id % 7 == 0) for pair in links for x in pair)
    assert plain_components(len(fps), [(a.id, b.id) for a, b in links]) == want.tolist()


def test_trie_is_walked_and_pruned():
    """Every link comes from the walk, which sees a small part of all pairs, also of few leaves."""
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 1500, dtype=np.uint64)
    fps = np.unique(np.concatenate((base, base[:100] ^ np.uint64(1 << 40), base[:50] ^ np.uint64(7), base[100:120] ^ np.uint64(31 << 20))))
    near = np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1)
    seen: dict[str, int] = {}
    at = simhash_dedup.trie_links(fps, np.array([[0, len(fps), 0, len(fps)]]), 4, seen)
    assert at.tolist() == roots(len(fps), *np.nonzero(near)).tolist()
    # A link between leaves of one component may be passed over, never one that joins two.
    assert len(np.unique(at)) == len(fps) - np.count_nonzero(at != np.arange(len(fps))) and 0 < seen["links"] <= near.sum()
    assert 0 < seen["over"] < seen["visited"] < near.size / 4
    for few in (fps[:1], fps[:2], np.array([5, 6, 7, 2**63 + 5], np.uint64)):
        seen = {}
        simhash_dedup.trie_links(few, np.array([[0, len(few), 0, len(few)]]), 4, seen)
        pairs = np.nonzero(np.triu(np.bitwise_count(few[:, None] ^ few[None]) <= 4, 1))
        assert seen["visited"] >= min(len(few), 2) and seen["links"] <= len(pairs[0])
        assert seen["links"] >= len(few) - len(np.unique(roots(len(few), *pairs)))


def test_text_hash_is_that_of_the_engine(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "\u00e9 " * 500)], "doc_id long, text string")
    want = {x.doc_id: x.h for x in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert {x.doc_id: x.text_hash for x in simhash_dedup.simhash_groups(df).collect()} == want


def test_first_rows(spark):
    """One row stands for each component; rows that repeat both id and text stand together, nameless ones are told apart by their texts."""
    texts = [(None, "one two three four five"), (None, "one two three four five"), (None, "another text of six words here"), (4, "one two three four five six"), (4, "something else in this row"), (9, "Something else in this row"), (9, None), (3, "")]
    got = simhash_case(spark, [(i, t, 0, 0, "", 0) for i, t in texts])
    mark = lambda t: xxhash.xxh64((t or "").encode(), 42).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    first = sorted((x.doc_id or 0, x.text_hash) for x in got if x.first)
    assert first == sorted([(0, signed(mark(texts[0][1])))] * 2 + [(0, signed(mark(texts[2][1]))), (4, signed(mark(texts[3][1]))), (4, signed(mark(texts[4][1]))), (3, signed(mark("")))])


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 32))
    more = base[r.integers(0, 40, 260)] + r.standard_normal((260, 32)) * 0.12
    x = np.concatenate((base, more, base[:3] * 2.5, base[:4]))
    label = [int(k) for k in r.integers(0, 2, len(x))]
    rows = [(k + 10, [float(v) for v in x[k]], label[k], 1) for k in range(len(x))]
    rows += [(900, None, 0, 1), (901, [0.0] * 32, 0, 1), (902, [float("nan")] * 32, 0, 1), (903, [1.0, None], 0, 1), (904, [1.0] * 32, None, 1), (905, [1.0] * 3, 0, 1), (906, [], 0, 1), (None, [1.0] * 32, 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    comp = plain_components(len(x), list(zip(*np.nonzero(near), strict=True)))
    for shard in (64, 8192):
        got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in embedding_dedup.embedding_groups(df, shard=shard, beam=8).collect()}
        assert len(got) == len(rows)
        assert {k: got[k] for k in got if k and k < 900} == {k + 10: (int(near[k].sum()), comp[k] + 10, comp[k] == k) for k in range(len(x))}
        assert all(got[k] == (0, k, True) for k in range(900, 907)) and got[None] == (0, None, False)
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_embeddings_of_repeated_ids(spark):
    """An id that is given to two vectors is two vectors: neither has the links of the other."""
    e = [[float(k == i) for k in range(4)] for i in range(4)]
    df = spark.createDataFrame([(5, e[0], 1), (5, e[1], 1), (7, e[0], 1), (9, e[1], 1), (9, e[1], 1), (4, e[1], 2)], "vec_id long, embedding array<float>, label int")
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_groups(df).collect())
    assert got == [(4, 0, 4, True), (5, 1, 5, True), (5, 2, 5, True), (7, 1, 5, False), (9, 2, 5, False), (9, 2, 5, False)]


def test_recall_audit(spark):
    """The audit's figures are those of all pairs, and a graph is built once for each shard."""
    r = np.random.default_rng(6)
    base = r.standard_normal((30, 16))
    x = np.concatenate([base + r.standard_normal((30, 16)) * 0.02 for _ in range(8)])
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = embedding_dedup.recall_audit(df, shard=64, beam=4).collect()
    shards = {g.i for g in got}
    assert len(shards) > 2 and sorted((g.i, g.j) for g in got) == sorted((i, j) for i in shards for j in shards if i <= j)
    assert sum(g.links for g in got) == np.triu(u @ u.T >= 0.98, 1).sum()
    assert all(0 <= g.recall <= 1 for g in got) and sum(g.queries for g in got if g.i == g.j) == len(x)


def test_stored_graph():
    x = embedding_dedup.unit_rows(np.random.default_rng(2).standard_normal((900, 24))).astype(np.float32)
    graph = embedding_dedup.Graph(x)
    again = embedding_dedup.Graph.from_stored(x, graph.stored())
    for a, b in zip(graph.search(x[:50], 32), again.search(x[:50], 32), strict=True):
        assert (a == b).all()


def test_graph_recall():
    x = embedding_dedup.unit_rows(np.random.default_rng(1).standard_normal((1500, 24))).astype(np.float32)
    ids, _ = embedding_dedup.Graph(x).search(x[:200], 64)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([np.isin(b, i).mean() for b, i in zip(best, ids, strict=True)]) >= 0.9


def edits(a, b):
    """Edit distance; what the two have in common at either end doesn't count, and is passed over first."""
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    k = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - k], b[: len(b) - k]
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, prev = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(prev[j] + 1, d[-1] + 1, prev[j - 1] + (x != y)))
    return d[-1]


def plain_lines(rows, per_edit=5):
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda x: x[0]):
        kept = []
        for line in text.split("\n"):
            bare = line.strip(" \t\r\f\x0b")
            if not bare:
                kept.append(line)
                continue
            if not any(bare == s or (max(len(s), len(bare)) >= per_edit and abs(len(s) - len(bare)) <= 1 and edits(s, bare) <= 1) for s in seen):
                kept.append(line)
            seen.append(bare)
        out[doc] = "\n".join(kept)
    return out


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(4)
    lines = ["".join(r.choice("abé x") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 20, 21, 40]))) for _ in range(60)]

    def changed(s):
        k = r.randrange(len(s))
        return r.choice([s[:k] + s[k + 1 :], s[:k] + "q" + s[k:], s[:k] + "q" + s[k + 1 :], s[:k] + "qq" + s[k + 1 :], s, f" {s}\t"])

    rows = [(k, "\n".join(r.choice([r.choice(lines), changed(r.choice(lines)), "", "ab"]) for _ in range(r.randrange(1, 9)))) for k in range(80)]
    rows += [(200, ""), (201, "y" * 30000), (202, "y" * 30001)]
    df = spark.createDataFrame([(a, b, "extra", 3) for a, b in rows], "doc_id long, text string, row string, k int")
    got = line_dedup.line_dedup(df).collect()
    assert {x.doc_id: x.text for x in got} == plain_lines(rows)
    assert all(x.row.row == "extra" and x.row.k == 3 for x in got)
    every = line_dedup.line_dedup(df, per_edit=0).collect()
    assert {x.doc_id: x.text for x in every} == plain_lines(rows, per_edit=0)
    exact = line_dedup.line_dedup(df, max_edits=0).collect()
    assert {x.doc_id: x.text for x in exact} == plain_lines(rows, per_edit=10**9)


def test_line_variants_come_in_bounded_batches():
    """A line of a million characters, and many short ones: no batch is larger than BATCH, and none is tiny."""
    import pyarrow as pa

    long, at = "ab" * 500_000, {"d": 1, "k": 2, "i": 3}
    kinds = [pa.binary(), pa.struct([("d", pa.int64()), ("k", pa.int64()), ("i", pa.int32())]), pa.string(), pa.int32()]
    rows = [(b"h", at, long, 1), *[(b"s", at, "short", 15)] * 1000]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "at", "line", "roles"])
    sizes = [x.num_rows for x in line_dedup._variant_rows([batch])]
    assert max(sizes) < 2 * line_dedup.BATCH and sum(sizes) == 500_001 + 1000 * 11 and len(sizes) <= 9


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "same line of the text"), (3, None), (3, "same line of the text"), (3, "same line of the text"), (9, "\n\n")], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.text, x.n_lines) for x in line_dedup.line_dedup(df).collect())
    assert got == [(-1, "same line of the text", 1), (3, "", 1), (3, "", 1), (3, "", 1), (9, "\n\n", 3)]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
