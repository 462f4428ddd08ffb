"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; its normaliser, the marker for spaces, and the model (unigram scores, or the
merges that the scores of a BPE model imply) with byte fallback are rebuilt as a tokenizers pipeline, which encodes batches on several
threads. Every text can be held against the sentencepiece library. Ids are decoded by a table of each piece's bytes.

Pieces of equal score are a matter of rounding: the library keeps the best score of each place in single precision. A
unigram text for which the two libraries differ is encoded once more by a search with that very rounding, which goes on
from word to word.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import lean, pieces, prepared

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a SentencePiece model file holds, as far as encoding needs it."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False
    unknown: str = " \u2047 "  # what decoding puts for an unknown piece

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                m.pieces.append(own.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                m.types.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(fields(value))
                m.kind, m.byte_fallback, m.suffix = own.get(3, 1), bool(own.get(35, 0)), bool(own.get(24, 0))
                m.unknown = own[44].decode() if 44 in own else m.unknown
            elif number == 3:
                own = dict(fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze, m.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if m.kind not in (1, 2) or m.suffix:
            raise ValueError("unigram and BPE models with the space in front of words are read")
        return m

    @property
    def user(self) -> list[str]:
        return [p for p, t in zip(self.pieces, self.types, strict=True) if t == USER]

    @property
    def lossless(self) -> bool:
        return not self.charsmap and not self.squeeze

    @property
    def splittable(self) -> bool:
        """No piece has the space marker behind another character, so no token reaches from a word into the next."""
        return self.escape and self.dummy_prefix and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER))


WORD = f"{SPACE}*[^{SPACE}]+|{SPACE}+"


def build(model: Model) -> Tokenizer:
    """The tokenizers pipeline of the model. With symbols of the user it takes texts that normalised() has prepared."""
    unk = model.types.index(UNKNOWN)
    real = [t in (NORMAL, USER) for t in model.types]
    if model.kind == 1:
        # Names of pieces that no text may match are put out of reach; their ids stay.
        vocab = [(p if ok or t == BYTE else f"\0{p}\0", s) for p, s, ok, t in zip(model.pieces, model.scores, real, model.types, strict=True)]
        core = models.Unigram(vocab, unk, model.byte_fallback)
    else:
        ids = {p: i for i, p in enumerate(model.pieces)}
        usable = {p for p, ok in zip(model.pieces, real, strict=True) if ok}
        merges = []
        for i, (p, ok) in enumerate(zip(model.pieces, real, strict=True)):
            if ok:
                merges += [(-model.scores[i], ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        merges.sort()
        core = models.BPE(ids, [(model.pieces[a], model.pieces[b]) for _, a, b in merges], unk_token=model.pieces[unk], fuse_unk=True, byte_fallback=model.byte_fallback)
    t = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    t.normalizer = normalizers.Sequence(steps)
    if model.splittable:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    if model.user:
        t.normalizer = None
        t.add_tokens([AddedToken(p, normalized=False) for p in model.user])
    back = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else back)
    return t


def normalised(model: Model, text: str) -> str:
    """The text as the model sees it; symbols of the user are left as they are."""
    steps = normalizers.Precompiled(model.charsmap).normalize_str if model.charsmap else str
    if model.user:
        symbol = "|".join(map(re.escape, sorted(model.user, key=len, reverse=True)))
        text = "".join(x if k % 2 else steps(x) if x else x for k, x in enumerate(re.split(f"({symbol})", text)))
    else:
        text = steps(text)
    if model.squeeze:
        text = re.sub(" {2,}", " ", text.strip(" "))
    if model.dummy_prefix and text:
        text = " " + text
    return text.replace(" ", SPACE) if model.escape else text


class Lattice:
    """The best unigram path of a normalised text, with the rounding that decides between equal ones.

    From each place, in order, every piece that starts there goes for its end; a place takes a new path if the sum, in
    double precision, is above what it holds, which is kept in single precision.
    """

    def __init__(self, model: Model) -> None:
        self.model, single = model, np.float32
        self.score = {p: float(single(s)) for p, s, t in zip(model.pieces, model.scores, model.types, strict=True) if t == NORMAL}
        top, low = max(self.score.values(), default=0.0), min(self.score.values(), default=0.0)
        self.score |= {p: float(single(len(p.encode()) * single(top))) - 0.1 for p in model.user}
        self.id = {p: k for k, p in enumerate(model.pieces) if p in self.score}
        self.lost, self.unk = float(single(low) - single(10)), model.types.index(UNKNOWN)
        self.most = max(map(len, self.score), default=0)
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.bytes = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}

    def __call__(self, text: str) -> list[int]:
        n = len(text)
        best: list[float | None] = [0.0, *[None] * n]
        came: list[tuple[int, int]] = [(0, self.unk)] * (n + 1)
        for a in range(n):
            here, single = best[a], False
            if here is None:
                continue
            for b in range(a + 1, min(n, a + self.most) + 1):
                piece = text[a:b]
                if piece not in self.prefixes:
                    break
                if (s := self.score.get(piece)) is not None:
                    if best[b] is None or s + here > best[b]:
                        best[b], came[b] = float(np.float32(s + here)), (a, self.id[piece])
                    single |= b == a + 1
            if not single:
                s = float(np.float32(self.lost + here))
                if best[a + 1] is None or s > best[a + 1]:
                    best[a + 1], came[a + 1] = s, (a, self.unk)
        out, at = [], n
        while at:
            a, k = came[at]
            if k != self.unk or not self.model.byte_fallback:
                if not (k == self.unk and out and out[-1] == k):  # unknown neighbours are one
                    out.append(k)
            else:
                out += [self.bytes[x] for x in reversed(text[a:at].encode())]
            at = a
        return out[::-1]


class Bytes:
    """Decoding by a table: the bytes of each piece, laid side by side for all ids of a batch at once."""

    def __init__(self, model: Model) -> None:
        def own(piece: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(piece[3:5], 16)])
            return b"" if kind == CONTROL else (model.unknown if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

        every = [own(p, t) for p, t in zip(model.pieces, model.types, strict=True)]
        self.unk = model.types.index(UNKNOWN)
        self.model, self.size = model, np.fromiter(map(len, every), np.int64, len(every))
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(every), np.uint8)

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; ends: where each text's ids end, from 0."""
        n = self.size[ids]
        every = np.concatenate(([0], np.cumsum(n)))
        data = self.flat[np.repeat(self.start[ids] - every[:-1], n) + np.arange(every[-1])].tobytes()
        cut = every[ends].tolist()
        rows = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        if self.model.squeeze:
            # White space in front goes, but for that of the mark for an unknown piece.
            return [x[: len(x) - len(y)].lstrip(b" ") + y for x, y in zip(rows, self._from_unknown(ids, every, ends, data), strict=True)]
        return [x.removeprefix(b" ") for x in rows] if self.model.dummy_prefix else rows


    def _from_unknown(self, ids: np.ndarray, every: np.ndarray, ends: np.ndarray, data: bytes) -> list[bytes]:
        """What each text has from its first unknown piece on."""
        at = np.append(np.flatnonzero(ids == self.unk), len(ids))
        first = np.minimum(at[np.searchsorted(at, ends[:-1])], ends[1:])
        return [data[a:b] for a, b in zip(every[first].tolist(), every[ends[1:]].tolist(), strict=True)]


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Codec:
    """Encodes batches of whole texts and checks them.

    Where the words of a BPE model are independent (Model.splittable) and nothing is normalised away, each new word is encoded and held
    against the library once, on several threads, and is remembered; texts are put together from their words. Where the
    libraries differ on a unigram text, it is encoded by the Lattice, and held against the library again. The ids of every
    whole text are decoded and compared with it.
    """

    def __init__(self, data: bytes, parity: bool = True, most: int = 400_000) -> None:
        self.model = Model.parse(data)
        self.whole = build(self.model)
        self.by_word = self.model.kind == 2 and self.model.splittable and self.model.lossless and not self.model.user
        self.lattice = Lattice(self.model) if self.model.kind == 1 and parity else None
        self.bytes = Bytes(self.model)
        self.word = build(self.model)
        self.word.normalizer = self.word.pre_tokenizer = None
        self.find = re.compile(WORD).findall
        self.most = most
        self._forget()
        self.library = None
        if parity:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.unlike = np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        ids = [e.ids for e in self.word.encode_batch_fast(new, add_special_tokens=False)]
        unlike = [False] * len(new)
        if self.library:
            # What the library sees: a word in front of which it puts the marker itself; the marker alone is no text.
            plain, lone = [w[1:].replace(SPACE, " ") for w in new], [self.library.piece_to_id(SPACE)]
            want = [lone if w == SPACE else t for w, t in zip(new, self.library.encode(plain, num_threads=1), strict=True)]
            unlike = [i != t for i, t in zip(ids, want, strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, _flat(ids)))
        self.unlike = np.concatenate((self.unlike, np.array(unlike, bool)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool | None]]:
        """Ids of all texts in a row, where each text ends (from 0), whether decoding gives the text, and whether the library agrees."""
        if not self.by_word:
            given = [normalised(self.model, t) for t in texts] if self.model.user else texts
            ids = [e.ids for e in self.whole.encode_batch_fast(given, add_special_tokens=False)]
            same = [None] * len(ids)
            if self.library:
                want = self.library.encode(texts, num_threads=1)
                ids = [self._mended(i, None if i == t else normalised(self.model, x), t) for i, x, t in zip(ids, texts, want, strict=True)]
                same = [i == t for i, t in zip(ids, want, strict=True)]
            flat, ends = _flat(ids), np.cumsum([0, *map(len, ids)])
            return flat, ends, self._given_back(flat, ends, texts), same
        split = [self.find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.most:
            self._forget()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        n = self.size[codes]
        every = np.concatenate(([0], np.cumsum(n)))
        out = self.flat[np.repeat(self.start[codes] - every[:-1], n) + np.arange(every[-1])]
        ends = np.cumsum([0, *map(len, split)])

        at = np.concatenate(([0], np.cumsum(self.unlike[codes])))[ends]
        same = (at[1:] == at[:-1]).tolist() if self.library else [None] * len(texts)
        return out, every[ends], self._given_back(out, every[ends], texts), same

    def _mended(self, ids: list[int], text: str | None, want: list[int]) -> list[int]:
        """ids, unless the library gives others and the text's best path, rounded as there, isn't ids either."""
        return ids if ids == want or not self.lattice else self.lattice(text)

    def _given_back(self, ids: np.ndarray, ends: np.ndarray, texts: list[str]) -> list[bool]:
        return [b == t.encode() for b, t in zip(self.bytes(ids, ends), texts, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [x.decode("utf-8", "each-byte") for x in self.bytes(_flat(ids), np.cumsum([0, *map(len, ids)]))]


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.array([i for x in ids for i in x], np.int32)


ENCODED = "doc_id long, ids array<int>, n_tokens long, same_text boolean, parity boolean"


def encoded(docs: DataFrame, model: str = DEFAULT_MODEL, threads: int = 2, parity: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, ids, n_tokens, same_text, parity.

    ids are those of the whole text; same_text: decoding them gives the text back (a model that normalises, or a text
    with the space marker itself, need not); parity: they equal those of the sentencepiece library (null if not asked).
    Null text counts as empty and has no ids. Rows that repeat a doc_id are given as often as they come; other columns
    are ignored; no rows give none. The model file is read by the driver and sent to the executors.
    """
    spark = prepared(docs.sparkSession)
    with open(model, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        codec = Codec(sent.value, parity)
        for part in pieces(batches, "text", 3 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            flat, ends, back, same = codec.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(back, pa.bool_()), pa.array(same, pa.bool_()),
                ],
                ["doc_id", "ids", "n_tokens", "same_text", "parity"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), ENCODED)


def decoded(rows: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text); null ids give empty text, ids that the model lacks are left out."""
    spark = prepared(rows.sparkSession)
    with open(model, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, parity=False)
        known = len(codec.model.pieces)
        for batch in batches:
            ids = [[i for i in x or [] if i is not None and 0 <= i < known] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec.decode(ids), pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, text string")
