import base64
import gzip
import hashlib
import random
import re
import zlib
from pathlib import Path
from urllib.parse import quote

import duckdb
import numpy as np
import pytest

from siltstone.llm import chat_format, decontaminate, lm_score, quality, secret_scan, sentencepiece_codec, toxicity
from siltstone.llm.queries import ORACLES, QUERIES


ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_decontamination(spark):
    items = [("a", "One two, three four five six seven eight nine ten eleven"), ("b", "short Item"), ("b", "other words"), ("c", None), ("d", "..."), (None, "seven eight")]
    docs = [(1, "x one TWO three four five six seven eight nine ten y"), (2, "a short-item and short item"), (2, None), (None, "other: words"), (4, "nine ten short"), (5, "z " * 40000 + "short item")]
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, n_words int, segment string")
    b = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 10):
        got = sorted((x.doc_id or -1, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in decontaminate.contamination(d, b, block_bytes=block).collect())
        assert got == [(-1, 2, 2, 1, True), (1, 12, 10, 1, True), (2, 0, 0, 0, False), (2, 6, 4, 1, True), (4, 3, 0, 0, False), (5, 40002, 2, 1, True)], block
    sha = {x.doc_id: x.items_sha256 for x in decontaminate.contamination(d, b).collect()}
    assert sha[1] == hashlib.sha256(b"a").hexdigest() and sha[4] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert not any(x.contaminated for x in decontaminate.contamination(d, b.limit(0)).collect())


def test_proximity(spark):
    d = spark.createDataFrame([(1, "delta x gamma y beta z alpha"), (2, "alpha beta " + "x " * 50 + "gamma delta")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    assert {x.doc_id: (x.n_near, x.contaminated) for x in decontaminate.contamination(d, b).collect()} == {1: (1, False), 2: (0, False)}


def test_proximity_of_altered_and_short_items(spark, tmp_path):
    """A rare word that is altered, whether it stands elsewhere or nowhere, and items of few words."""
    docs = [(1, "alpha beta gamma delta epsilon omega"), (2, "alpha beta gamma delta zeta epsilon"), (3, "item x short"), (4, "omicron"), (5, "eta theta iota"), (6, "alpha " * 3 + "x " * 40 + "beta")]
    items = [("nowhere", "alpha beta gamma delta epsilon unseen"), ("elsewhere", "omicron alpha beta gamma delta"), ("short", "short item"), ("four", "eta theta iota lost"), ("gone", "alpha lost1 lost2 lost3 lost4")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x.n_near for x in QUERIES["op6_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 0, 5: 1, 6: 0}


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_secrets(spark):
    r = random.Random(6)
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "=", ":", " ", '"', "'", "é", "K", "ſecret", "x.y-z/", "AKIA" * 5, "\n"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randrange(0, 40)))) for k in range(400)] + [(500, None), (None, "token=abcdefghijklmnop"), (501, "a" * 100000)]
    df = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in secret_scan.secrets(df).collect()}
    for k, t in rows:
        want = plain_secrets(t or "")
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(want.count(x + ":") for x in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(got[k].spans.split(","))
    assert secret_scan.secrets(df.limit(0)).count() == 0


def test_unpacked_to_the_end():
    """However often a secret is packed, and for data that packs to nothing new."""
    data = b"password = abcdefgh12345678"
    for _ in range(60):
        data = gzip.compress(data)
    text = base64.b64encode(data).decode()
    assert secret_scan.scan(text) == ([], {(0, len(text), "assign")})


@pytest.mark.parametrize("begin", ["x ", "x?", "x^", "x}"])
def test_text_that_begins_like_a_compressed_layer(begin):
    text = base64.b64encode(f"{begin}password = abcdefgh12345678".encode()).decode()
    assert secret_scan.scan(text) == ([], {(0, len(text), "assign")})


def test_layers():
    inner = 'secret = "abcdefghijklmnop"'
    b64 = lambda x: base64.b64encode(x).decode()
    for wrap in (lambda s: quote(quote(s, safe=""), safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: b64(s.encode()), lambda s: b64(gzip.compress(b64(zlib.compress(s.encode())).encode())), lambda s: s.encode().hex()):
        text = f"é before {wrap(inner)} after"
        base, every = secret_scan.scan(text)
        a, b = min((a, b) for a, b, k in every if k == "assign")
        assert not [x for x in base if x[2] == "assign"] and a >= len("é before ") and b <= len(f"é before {wrap(inner)}") and b > a
    loop = "JUJJ" * 6  # decoding text that keeps its shape ends
    secret_scan.scan(loop)


def test_layers_that_are_no_clean_text_or_not_aligned():
    inner = b"password = abcdefgh12345678"
    b64 = lambda x: base64.b64encode(x).decode()
    noise = bytes(random.Random(3).randrange(256) for _ in range(300))
    packed = gzip.compress(noise + b"\n" + inner + b"\n")
    wrapped = "\n".join(b64(packed)[k : k + 76] for k in range(0, len(b64(packed)), 76))
    for text in (
        b64(gzip.compress(b"name" + b"\0" * 100 + inner + b"\0" * 40)), b64(b"\x1b[31m" + inner + b"\x1b[0m"), b64(b"\xff\xfe " + inner), b64(inner.decode().encode("utf-16-le")), b64(inner.decode().encode("utf-16-be")),
        *["https://h.example/" + "c" * k + "/" + b64(inner) for k in range(2, 6)], "a-b/cd_e/" + b64(packed), wrapped, wrapped.replace("\n", "\r\n  "), "some-long-name-/x\n" + wrapped, "id-" + inner.hex(),
    ):
        base, every = secret_scan.scan(f"see {text} .")
        assert [x for x in every - set(base) if x[2] == "assign"], text


def test_all_members_of_a_compressed_layer():
    inner = b"password = abcdefgh12345678"
    for data in (gzip.compress(b"first") + gzip.compress(b"") + gzip.compress(inner), gzip.compress(b"first") + b"\0" * 9 + gzip.compress(inner), zlib.compress(b"first") + gzip.compress(inner), gzip.compress(gzip.compress(b"first") + gzip.compress(inner)), gzip.compress(b"first") + b" " + inner):
        text = base64.b64encode(data).decode()
        assert secret_scan.scan(text)[1] >= {(0, len(text), "assign")}


def test_nested_without_end():
    """Many layers, one that unpacks to itself, and one that is broken further on."""
    secret = b"password = abcdefgh12345678"
    data = secret
    for _ in range(3000):
        data = zlib.compress(data, 0)
    text = base64.b64encode(data).decode()
    assert secret_scan.scan(text)[1] >= {(0, len(text), "assign")}
    # A stored block of deflate that says what follows it again: unpacks to its own head.
    broken = gzip.compress(secret + random.Random(1).randbytes(5000))
    text = base64.b64encode(broken[:-2000]).decode()
    assert secret_scan.scan(text)[1] >= {(0, len(text), "assign")}


def test_windows_of_large_layers(monkeypatch):
    """Layers larger than a window are read to their end, also those that are packed again, whatever character stands at an edge."""
    monkeypatch.setattr(secret_scan, "WINDOW", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 512)
    monkeypatch.setattr(secret_scan, "STEP", 1000)
    secret, r = b"password = abcdefgh12345678", random.Random(5)
    for fill in (b" ", "\u00e9\U0001f600 ".encode(), b"\0", b"\xff "):
        for k in range(0, 9000, 531):
            plain = fill * (k // len(fill)) + secret + fill * 3000
            for data in (gzip.compress(plain), gzip.compress(b"") + zlib.compress(gzip.compress(plain)), gzip.compress(gzip.compress(plain, 0) + b"behind")):
                text = base64.b64encode(data).decode()
                assert (0, len(text), "assign") in secret_scan.scan(text)[1], (fill, k)
    for n in (0, 1, 4095, 4096, 4097, 20000):
        data = r.randbytes(n)
        parts = list(secret_scan._windows(data[k : k + 700] for k in range(0, n, 700)))
        at, out = 0, b""
        for p in parts:
            assert len(p) <= 4096 + 700
            own = next(k for k in range(min(len(out), 520), -1, -1) if out.endswith(p[:k]) and (k >= 500 or not out)) if out else 0
            out += p[own:]
        assert out == data


def test_a_large_layer_in_little_memory():
    """100 MB behind a few hundred kilobytes of base64: what a worker holds doesn't grow with it."""
    import subprocess
    import sys

    code = """
import base64, resource, zlib
from siltstone.llm import secret_scan
step = zlib.compressobj(9)
line = (b"x y z 0123 " * 95 + b"\\n") * 1000
data = b"".join([*(step.compress(line) for _ in range(100)), step.compress(b"password = abcdefgh12345678"), step.flush()])
text = base64.b64encode(data).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert (0, len(text), "assign") in secret_scan.scan(text)[1]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 400


def test_template_round_trip():
    t, r = chat_format.Template(), random.Random(7)
    parts = [*t.controls, *[c[:1] for c in t.controls], *[c[1:] for c in t.controls], "\\", "\\\\", " ", "\n", "é😀"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(0, 8)))
        e = t.escaped(text)
        assert t.unescaped(e) == text and not any(c in e for c in t.controls)
        turns = [("user", text), (text, "x"), ("assistant", text)]
        assert t.parse(t.render(turns)[0]) == turns
    with pytest.raises(ValueError):
        chat_format.Template(reserved=("a[INST]",))


def test_special_tokens_of_the_file_are_escaped(spark, tmp_path):
    """A text that spells a special token of another tokenizer file is read back as it was, and not taken for the token."""
    import json

    with open(chat_format.DEFAULT_TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    number = max(spec["model"]["vocab"].values()) + 50
    spec["added_tokens"].append({"id": number, "content": "<|tool|>", "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False})
    (tmp_path / "own.json").write_text(json.dumps(spec))
    df = spark.createDataFrame([(1, 0, "user", "say <|tool|>"), (1, 1, "assistant", "<|tool|> <\\|tool|>")], "conv_id long, turn int, role string, text string")
    row = chat_format.format_conversations(df, tokenizer=f"{tmp_path}/own.json").first()
    template = chat_format.Template().guarded((tmp_path / "own.json").read_text())
    assert template.parse(row.formatted) == [("user", "say <|tool|>"), ("assistant", "<|tool|> <\\|tool|>")] and "<|tool|>" not in row.formatted
    assert number not in row.input_ids
    assert chat_format.conversation_digests(df, tokenizer=f"{tmp_path}/own.json").first().loss_chars == len("<|tool|> <\\|tool|>")


def test_chat_masks(spark):
    rows = [(1, 1, "assistant", "\n</s>\n é"), (1, 0, "user", None), (1, 2, "assistant", " next"), (1, 2, "assistant", " next"), (2, None, None, "x"), (None, 1, "user", "lost"), (3, 0, "assistant", "y" * 50000)]
    df = spark.createDataFrame([(*x, 5) for x in rows], "conv_id long, turn long, role string, text string, starts int")
    got = {x.conv_id: x for x in chat_format.conversation_digests(df).collect()}
    assert set(got) == {1, 2, 3}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].loss_sha256 == sha("\n</s>\n é next next") and got[1].turns_sha256 == sha("user\n\nassistant\n\n</s>\n é\nassistant\n next\nassistant\n next\n")
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[3].loss_chars == 50000
    full = chat_format.format_conversations(df).where("conv_id = 1").first()
    assert len(full.input_ids) == len(full.loss_mask) == len(full.starts)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_sentencepiece(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    odd = ["", "  a  b ", "\n\t x", "▁a ▁", "<s> </s> <unk> <0x0A>", "日本語 テキスト😀é", "a\x00b", " ", "ab" * 20000, "abcbc bcbcabc", None]
    rows = [(k, t, [1]) for k, t in enumerate(odd)] + [(None, "x", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = {x.doc_id: x for x in sentencepiece_codec.encoded(df).collect()}
    for k, t in enumerate(odd):
        assert got[k].ids == sp.encode(t or "") and got[k].parity and got[k].same_text == ("▁" not in (t or ""))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = sentencepiece_codec.encoded(docs)
    assert every.where("not parity or not same_text").count() == 0
    texts = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    assert all(x.ids == sp.encode(texts[x.doc_id]) for x in every.collect())
    assert {x.doc_id: x.text for x in sentencepiece_codec.decoded(every).collect()} == texts
    assert sentencepiece_codec.encoded(df.limit(0)).count() == 0


def test_sentencepiece_decodes_every_text():
    """An error of the decoder shows in the texts that it damages, though their words are known."""
    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    texts = ["one two", "", " one  two", "two", "\u65e5\u672c\x01 one"]
    assert codec.encode(texts)[2] == [True] * 5
    codec.bytes.model = sentencepiece_codec.Model(dummy_prefix=False, squeeze=False)  # the space in front stays
    assert codec.encode(texts)[2] == [False, True, False, False, False]
    codec.bytes = sentencepiece_codec.Bytes(codec.model)
    place = codec.model.pieces.index("\u2581two")
    codec.bytes.start[place] += 1
    assert codec.encode(texts)[2] == [False, True, False, False, True]


def test_sentencepiece_decoding_of_any_ids():
    """The table decodes as the library does, and as the rebuilt decoder does, broken byte sequences too."""
    import sentencepiece

    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        data = f.read()
    codec, sp, r = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data), random.Random(8)
    usable = [k for k, t in enumerate(codec.model.types) if t in (1, 6)]
    in_bytes = [k for k in usable if codec.model.types[k] == 6]
    rows = [[r.choice(usable if r.random() < 0.6 else in_bytes) for _ in range(r.randrange(0, 30))] for _ in range(400)]
    assert codec.decode(rows) == [sp.decode(x) for x in rows]
    plain = [[k for k in x if codec.model.types[k] == 1] for x in rows]
    assert codec.decode(plain) == codec.whole.decode_batch(plain, skip_special_tokens=False)


def spelled(pieces, kind, normaliser=b"", dummy=1, squeeze=1, fallback=1):
    """The protobuf of a model of (piece, score, type)."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def field(n, data):
        return varint(n << 3 | 2) + varint(len(data)) + data

    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([3 << 3, t])) for p, s, t in pieces)
    return out + field(2, bytes([3 << 3, kind]) + varint(35 << 3) + bytes([fallback])) + field(3, field(2, normaliser) + bytes([3 << 3, dummy, 4 << 3, squeeze, 5 << 3, 1]))


@pytest.mark.parametrize("user", [False, True])
@pytest.mark.parametrize("normaliser", ["identity", "nmt_nfkc"])
@pytest.mark.parametrize("dummy,squeeze,fallback", [(1, 1, 1), (1, 0, 1), (0, 0, 1), (1, 1, 0)])
def test_unigram_models_of_many_pieces(sf, user, normaliser, dummy, squeeze, fallback):
    """Thousands of pieces with many equal scores, with and without symbols of the user, normaliser and byte fallback."""
    import pyarrow.parquet
    import sentencepiece

    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        base = sentencepiece_codec.Model.parse(f.read())
    r = np.random.default_rng(2)
    plain = list(dict.fromkeys([p for p, t in zip(base.pieces, base.types, strict=True) if t == 1][:6000] + list("abcdefghijklmnopqrstuvwxyz\u2581#.,-") + ["##", "###", "--"]))
    scores = np.float32(-np.round(np.log(2 + np.arange(len(plain))) * 3, 1) - r.integers(0, 2, len(plain)) * 0.37)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *([("<user>", 0.0, 4), ("@@", 0.0, 4), ("@@@x", 0.0, 4)] if user else []), *zip(plain, scores.tolist(), [1] * len(plain), strict=True)]
    if fallback:
        pieces += [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    spec = dict(sentencepiece_codec.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())) if normaliser != "identity" else {}
    data = spelled(pieces, 1, spec.get(2, b""), dummy, squeeze, fallback)
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(data)
    texts = [t or "" for t in pyarrow.parquet.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()][:60]
    texts += ["###", "a ### b", "\u65e5\u672c \U0001f600\u00e9", "", " ", "  a  b ", "x<user>y @@@x @@ @@@", "\uff28\uff23 \ufb01 \u00bd \u2163", "\t\n q", "aaaa----####", "<s><unk>"]
    flat, ends, back, same = codec.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [sp.encode(t) for t in texts]
    assert all(same)
    rows = [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
    assert codec.decode(rows) == [sp.decode(x) for x in rows]
    assert back == [sp.decode(x) == t for x, t in zip(rows, texts, strict=True)]


def test_unigram_model():
    """A hand-made unigram model: pieces of a protobuf, encoded as by the library."""
    import sentencepiece

    def field(n, data):
        return bytes([n << 3 | 2]) + (len(data).to_bytes(1) if len(data) < 128 else bytes([len(data) & 127 | 128, len(data) >> 7])) + data

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -2.0, 1), ("▁ab", -1.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -2.5, 1), ("c", -3.0, 1), *[(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([3 << 3, t])) for p, s, t in pieces)
    data += field(2, bytes([3 << 3, 1]) + b"\x98\x02\x01") + field(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(data)
    texts = ["ab ab abc", "cab", "é", "", "abab  c", "<s>"]
    flat, ends, _, same = codec.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [sp.encode(t) for t in texts] and all(same)


def test_lm_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = random.Random(8)
    text = max((x.text for x in docs.collect() if len(x.text) < 9000), key=len)
    words = text.split()
    r.shuffle(words)
    more = spark.createDataFrame([(-1, text), (-2, " ".join(words)), (-3, None), (None, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in lm_score.pseudo_likelihood(docs.unionByName(more)).collect()}
    assert got[-1].per_token > got[-2].per_token
    assert (got[-3].n_tokens, got[-3].log_likelihood, got[-3].per_token) == (0, 0.0, None)
    assert all(x.log_likelihood <= 0 for x in got.values())
    assert lm_score.pseudo_likelihood(docs.limit(0)).count() == 0


def test_lm_words_of_a_bucket(spark):
    """Words that share a bucket differ by their counts, whether these are sent or joined."""
    r = random.Random(9)
    common = [f"w{k}" for k in range(960)] * 20
    r.shuffle(common)
    of = lm_score.bucket(b"rare0")
    twins = [w for w in (f"rare{k}" for k in range(1000)) if lm_score.bucket(w.encode()) == of][:3]
    rows = [(k, " ".join(common[k::40])) for k in range(40)]
    rows += [(100 + k, f"w1 w2 {w} w3 w4") for k, w in enumerate(twins)] + [(200, " ".join([twins[1]] * 8)), (201, twins[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (0, 1, 1 << 17):
        got = {x.doc_id: x.log_likelihood for x in lm_score.pseudo_likelihood(df, frequent=frequent).collect()}
        assert len(got) == len(rows)
        assert abs(got[101] - got[100] - np.log(9)) < 1e-3 and abs(got[102] - got[100] - np.log(2)) < 1e-3, frequent


def test_lm_vocabulary_grows():
    assert lm_score.side_of(10**6) == lm_score.CLASSES < lm_score.side_of(10**9) < lm_score.side_of(10**11)
    side = 40
    net = lm_score.Network.first(np.arange(side * side))
    net = lm_score.Network.of(net.flat(), side)
    every = np.arange(side * side)
    p = np.exp(net.pass_(every, np.full((len(lm_score.SIDES), len(every)), side * side)))
    assert abs(p.sum() - 1) < 1e-3


def test_lm_against_plain_softmax():
    r = np.random.default_rng(2)
    net = lm_score.Network.of(r.standard_normal(len(lm_score.Network.first().flat())) * 0.2)
    tokens, starts = r.integers(0, lm_score.VOCABULARY, 9), np.array([0, 0, 5, 9])
    around = lm_score.contexts(tokens, starts)
    got = net.pass_(tokens, around)
    padded = lambda d, k: tokens[d[0] + k] if 0 <= k < d[1] - d[0] else lm_score.VOCABULARY
    for k, tok in enumerate(tokens):
        d = (0, 5) if k < 5 else (5, 9)
        h = np.append(np.tanh(sum(net.embed[s][padded(d, k - d[0] + side)] for s, side in enumerate(lm_score.SIDES))), 1)
        top, low = h @ net.top, h @ net.low[tok // lm_score.WITHIN]
        want = top[tok // lm_score.WITHIN] - np.log(np.exp(top).sum()) + low[tok % lm_score.WITHIN] - np.log(np.exp(low).sum())
        assert abs(got[k] - want) < 1e-4


def test_classifiers_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    held = labels.where("doc_id % 4 = 0")
    scored = toxicity.toxicity(docs, seen).withColumnRenamed("toxic", "said").join(held, "doc_id").toPandas()
    assert (scored.said[scored.toxic == 1]).mean() > 0.9 and (scored.said[scored.toxic == 0]).mean() < 0.01
    assert scored.expected_severity[scored.toxic == 1].mean() > 0.9 > 0.1 > scored.expected_severity[scored.toxic == 0].mean()
    kept = quality.quality_scores(docs, seen).join(held, "doc_id").toPandas()
    assert kept.keep[kept.quality == 1].mean() > 0.99 and kept.keep[kept.quality == 0].mean() < 0.06


def test_classifiers_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, "c"), (None, "x", "h/p", "en", "c"), (2, "", "h/p", None, "c"), (2, "z " * 50000, "h", "en", "c")], "doc_id long, text string, source string, lang string, host string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for y in (labels, none):
        assert toxicity.toxicity(docs, y).count() == 4 and quality.quality_scores(docs, y).count() == 4
        assert toxicity.toxicity(docs.limit(0), y).count() == 0 and quality.quality_scores(docs.limit(0), y).count() == 0
    assert all(x.keep for x in quality.quality_scores(docs, none).collect())


def test_ordinal_thresholds():
    texts = [b"good fine words " * 5, b"good mild words " * 5, b"good severe severe mild " * 5] * 40
    x = toxicity.featurise(texts)
    m = toxicity.CumulativeLink.fit(x, np.array([0, 1, 2] * 40), 2)
    expected = m.above(x).sum(1)
    assert m.thresholds[0] < m.thresholds[1] and expected[0] < expected[1] < expected[2] and abs(expected[2] - 2) < 0.3


def test_ordinal_likelihood_and_gradient():
    """The loss is that of the model written out, and its gradient that of small steps."""
    r = np.random.default_rng(3)
    k, top, n = 6, 3, 40
    rows = [r.choice(k, r.integers(0, 4), replace=False) for _ in range(n)]
    starts = np.cumsum([0, *map(len, rows)])
    x = toxicity.Sparse(np.concatenate(rows).astype(np.int64), r.standard_normal(starts[-1]), starts)
    y, params = r.integers(0, top + 1, n), r.standard_normal(k + top) * 0.5
    theta = params[k] + np.concatenate(([0], np.cumsum(np.exp(params[k + 1 :]))))
    z = [sum(params[i] * v for i, v in zip(x.index[a:b], x.value[a:b], strict=True)) for a, b in zip(starts, starts[1:], strict=False)]
    below = lambda t, s: 1 / (1 + np.exp(-(t - s)))
    p = [(below(theta[c], s) if c < top else 1.0) - (below(theta[c - 1], s) if c else 0.0) for c, s in zip(y, z, strict=True)]
    loss, grad = toxicity.CumulativeLink.loss(x, y, params, k)
    assert abs(loss + np.mean(np.log(p))) < 1e-9
    for j in range(k + top):
        step = np.zeros(k + top)
        step[j] = 1e-6
        slope = (toxicity.CumulativeLink.loss(x, y, params + step, k)[0] - toxicity.CumulativeLink.loss(x, y, params - step, k)[0]) / 2e-6
        assert abs(slope - grad[j]) < 1e-6, j


def test_grades_of_a_text_come_from_others():
    """A word that stands in the toxic texts of one half only grades those of the other."""
    texts = [b"foul words here " + (b"vile " * (k % 7) if k % 2 else b"") if k < 60 else b"kind words here" for k in range(120)]
    y = np.array([1] * 60 + [0] * 60)
    grades = toxicity.grades(toxicity.featurise(texts), y)
    assert set(grades[60:]) == {0} and set(grades[:60]) == {1, 2}


def test_held_out_severity_orders_texts(spark):
    """Expected severity puts held-out toxic texts before clean ones, and those with more of the words before those with fewer."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    text = dict(zip(*[pq.read_table(f"{sf}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")], strict=True))
    rows = [(x["doc_id"], x["toxic"]) for x in pq.read_table(f"{sf}/labels.parquet").to_pylist() if x["toxic"] is not None and x["doc_id"] in text]
    seen, held = [x for x in rows if x[0] % 4], [x for x in rows if not x[0] % 4]
    x = toxicity.featurise([(text[i] or "").encode() for i, _ in seen])
    model = toxicity.CumulativeLink.fit(x, toxicity.grades(x, np.array([t for _, t in seen])), 2)
    own = model.above(toxicity.featurise([(text[i] or "").encode() for i, _ in held])).sum(1)
    toxic = np.array([t for _, t in held]) == 1
    assert (own[toxic][:, None] > own[~toxic][None]).mean() > 0.95


@pytest.mark.parametrize("threshold", [0.5, 0.25])
def test_ties_at_the_threshold(spark, threshold):
    """Texts without evidence are all at even odds: at the threshold a document stays, and a text is toxic."""
    docs = spark.createDataFrame([(k, "", "h", "en") for k in range(4)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(x.p_quality == 0.5 and x.keep for x in quality.quality_scores(docs, none, threshold=threshold).collect())
    rows = toxicity.toxicity(docs, none, threshold=threshold).collect()
    assert all(x.toxic == (x.p_toxic >= threshold) for x in rows)


def test_lm_odd_rows(spark):
    """A very long text, repeated rows, columns of the names used inside, a table of empty texts; whole documents against the model written out."""
    df = spark.createDataFrame([(1, "a b " * 60000, 1, "x"), (2, "same words", 1, "x"), (2, "same words", 1, "x"), (None, None, 1, "x"), (3, " .", 1, "x")], "doc_id long, text string, key int, words string")
    got = [(x.doc_id, x.n_tokens, x.log_likelihood) for x in lm_score.pseudo_likelihood(df).collect()]
    assert sorted(n for _, n, _ in got) == [0, 0, 2, 2, 120000] and len({x for x in got if x[0] == 2}) == 1
    assert all(np.isfinite(x) and x <= 0 for *_, x in got)
    empty = lm_score.pseudo_likelihood(df.where("doc_id = 3")).collect()
    assert [(x.n_tokens, x.log_likelihood, x.per_token) for x in empty] == [(0, 0.0, None)]


def test_secrets_and_pieces_of_repeated_rows(spark):
    rows = [(k % 3, f"password = abcdefgh1234567{k % 3}", k) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    assert {(x.doc_id, x.n_assign, x.spans) for x in secret_scan.secrets(df).collect()} == {(k, 1, "assign:0:27") for k in range(3)} and secret_scan.secrets(df).count() == 1200
    every = sentencepiece_codec.encoded(df).collect()  # more rows than an Arrow batch has
    assert len(every) == 1200 and len({(x.doc_id, tuple(x.ids)) for x in every}) == 3 and all(x.parity and x.same_text for x in every)
