"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a row is a segment of about a million words with, for every test term in it, the
sorted positions of the term. It is written to the shared folder and read twice: for how often each term occurs in the
whole corpus, and for the matches. A window (a phrase of consecutive test words) starts from the positions of its
rarest term and is intersected, offsets taken off, with the lists of its other terms from rare to frequent; windows are
kept by their rarest term, and a segment looks at those of the terms that it has. Documents
lie GAP positions apart, so that neither phrase nor proximity reaches over their borders.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, coded, lean, pieces, prepared, settled, texts

GAP = 64
SEGMENT_WORDS = 1 << 20
#: Bytes of test text that are sent to the executors at once; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 8 << 20

INDEX = "segment string, doc_id array<bigint>, doc_key array<bigint>, text_hash array<bigint>, start array<bigint>, size array<bigint>, terms array<binary>, counts array<bigint>, postings array<binary>"
FOUND = "doc_id long, doc_key long, text_hash long, n_words long, starts array<bigint>, ends array<bigint>, items array<string>, near array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def windows_of(items: list[tuple[str, bytes]], length: int) -> tuple[dict[tuple[bytes, ...], set[str]], dict[str, set[bytes]]]:
    """Windows with the items they are of, and the words of each item. An item of fewer words than a window is one."""
    windows, terms = defaultdict(set), defaultdict(set)
    for item, text in items:
        w = words(text)
        terms[item].update(w)
        for k in range(max(1, len(w) - length + 1) if w else 0):
            windows[tuple(w[k : k + length])].add(item)
    return dict(windows), dict(terms)


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in blocks of bounded size, one block on the driver at a time; items without id are left out."""
    block, size = [], 0
    for row in benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
    yield block


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """Segments (INDEX) of the postings of the vocabulary (None: of all terms) in docs (doc_id, doc_key, text_hash, text)."""
    prepared(docs.sparkSession)
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segment(name: str, ids: list, keys: list, hashes: list, docs_: list[list[bytes]]) -> pa.RecordBatch:
        codes, distinct, starts = coded(docs_)
        position = np.arange(len(codes)) + np.repeat(np.arange(len(docs_)), np.diff(starts)) * GAP
        wanted = np.array([known is None or w in known.value for w in distinct], bool)
        new = np.cumsum(wanted) - 1
        use = wanted[codes] if len(codes) else np.zeros(0, bool)
        term, position = new[codes[use]], position[use]
        by = np.argsort(term.astype(np.int32), kind="stable")
        counts = np.bincount(term, minlength=int(wanted.sum()))
        lists = np.split(position[by].astype("<u4"), np.cumsum(counts)[:-1]) if len(counts) else []
        row = {
            "segment": name, "doc_id": ids, "doc_key": keys, "text_hash": hashes, "start": (starts[:-1] + np.arange(len(docs_)) * GAP).tolist(), "size": np.diff(starts).tolist(),
            "terms": [w for w, u in zip(distinct, wanted.tolist(), strict=True) if u], "counts": counts.tolist(), "postings": [x.tobytes() for x in lists],
        }
        kinds = [pa.string(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, ids, keys, hashes, held, size, made = TaskContext.get().partitionId(), [], [], [], [], 0, 0
        for part in pieces(batches, "text"):
            for i, k, h, t in zip(*[part.column(c).to_pylist() for c in ("doc_id", "doc_key", "text_hash")], texts(part), strict=True):
                w = words(t)
                ids.append(i)
                keys.append(k)
                hashes.append(h)
                held.append(w)
                size += len(w) + GAP
                if size >= SEGMENT_WORDS:
                    yield segment(f"{me}-{made}", ids, keys, hashes, held)
                    ids, keys, hashes, held, size, made = [], [], [], [], 0, made + 1
        if held:
            yield segment(f"{me}-{made}", ids, keys, hashes, held)

    return settled(docs.select("doc_id", "doc_key", "text_hash", "text").mapInArrow(lean(run), INDEX), "postings")


def term_counts(index: DataFrame) -> dict[bytes, int]:
    """Occurrences of each indexed term in the whole corpus: as many rows as the vocabulary has."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts"))
    return {bytes(w): n for w, n in pairs.toLocalIterator()}


def phrase(lists: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Starts of a phrase: the lists (rarest first), each less its offset, intersected."""
    found = lists[0] - offsets[0]
    for at, off in zip(lists[1:], offsets[1:], strict=True):
        if not len(found):
            break
        want = found + off
        k = np.minimum(np.searchsorted(at, want), len(at) - 1)
        found = found[at[k] == want]
    return found


def near_plan(words_: set[bytes], counts: dict[bytes, int], near_terms: int) -> tuple[list[bytes], int] | None:
    """Terms of an item, rarest first, and how many of them must be close; None if too few of its words occur at all.

    Of near_terms + 1 words that occur one may be missing, as it may be the altered one; of fewer, all are needed.
    """
    least = min(near_terms, len(words_))
    terms = sorted((w for w in words_ if counts.get(w)), key=lambda w: (counts[w], w))[: near_terms + 1]
    if not terms or len(terms) < least and len(terms) < max(2, least - 1):
        return None
    return terms, min(least, len(terms))


def close(lists: list[np.ndarray], slop: int, need: int) -> np.ndarray:
    """Positions of the rarest lists (they come first; one more than may be missing) that have `need` lists, their own included, within slop words."""
    found = []
    for k, own in enumerate(lists[: len(lists) - need + 1]):
        n = np.ones(len(own), np.int64)
        for at in filter(len, lists[:k] + lists[k + 1 :]):
            to = np.searchsorted(at, own)
            right = at[np.minimum(to, len(at) - 1)] - own
            left = own - at[np.maximum(to - 1, 0)]
            n += ((right >= 0) & (right <= slop)) | ((left >= 0) & (left <= slop))
        found.append(own[n >= need])
    return np.concatenate(found)


@dataclass
class Plans:
    """Windows in the order of their rarest terms, as arrays of term codes from rare to frequent and of their offsets, and items by proximity."""

    code: dict[bytes, int]
    #: The windows of the term c are start[c] to start[c + 1].
    start: np.ndarray
    terms: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    owners: list[tuple[int, ...]]
    items: list[str]
    #: (item, terms, how many are needed), and those of each term that a match can start from.
    nears: list[tuple[int, list[int], int]]
    near_of: dict[int, list[int]]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], counts: dict[bytes, int], window: int, near_terms: int) -> Plans:
        windows, words_of = windows_of(items, window)
        names = sorted(words_of)
        number = {x: k for k, x in enumerate(names)}
        code = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}  # codes go by frequency
        found = [(own, of) for w, of in windows.items() if None not in (own := [code.get(x) for x in w])]
        n, most = len(found), max((len(own) for own, _ in found), default=0)
        terms, offsets = np.full((n, most), -1, np.int32), np.zeros((n, most), np.int16)
        for row, (own, _) in enumerate(found):
            order = sorted(range(len(own)), key=own.__getitem__)
            terms[row, : len(own)], offsets[row, : len(own)] = [own[k] for k in order], order
        by = np.argsort(terms[:, 0], kind="stable") if n else np.zeros(0, np.int64)
        start = np.searchsorted(terms[by, 0], np.arange(len(code) + 1)) if n else np.zeros(len(code) + 1, np.int64)
        owners = [tuple(sorted(number[x] for x in found[k][1])) for k in by.tolist()]
        sizes = np.array([len(found[k][0]) for k in by.tolist()], np.int16)
        nears, near_of = [], defaultdict(list)
        for item in names:
            if plan := near_plan(words_of[item], counts, near_terms):
                own, need = [code[w] for w in plan[0]], plan[1]
                for c in own[: len(own) - need + 1]:
                    near_of[c].append(len(nears))
                nears.append((number[item], own, need))
        return cls(code, start, terms[by], offsets[by], sizes, owners, names, nears, dict(near_of))


def match(index: DataFrame, items: list[tuple[str, bytes]], counts: dict[bytes, int], window: int, near_terms: int, slop: int) -> DataFrame:
    """FOUND for each document of the index: hit spans of word positions, items of exact windows, items by proximity."""
    sent = index.sparkSession.sparkContext.broadcast(Plans.of(items, counts, window, near_terms))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, none = sent.value, np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                at = {plans.code[w]: np.frombuffer(p, "<u4").astype(np.int64) for w, p in zip(row["terms"], row["postings"], strict=True)}
                start, n = np.array(row["start"], np.int64), len(row["start"])
                spans, items_, near = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)]
                for k in chain.from_iterable(range(plans.start[c], plans.start[c + 1]) for c in at):
                    size = int(plans.sizes[k])
                    ws = plans.terms[k, :size].tolist()
                    if not all(w in at for w in ws):
                        continue
                    for s in phrase([at[w] for w in ws], plans.offsets[k, :size].tolist()).tolist():
                        d = int(np.searchsorted(start, s, "right")) - 1
                        spans[d].append((s - int(start[d]), s - int(start[d]) + size))
                        items_[d].update(plans.items[x] for x in plans.owners[k])
                for k in {k for c in at for k in plans.near_of.get(c, ())}:
                    item, ws, need = plans.nears[k]
                    if sum(w in at for w in ws) >= need:
                        for d in set((np.searchsorted(start, close([at.get(w, none) for w in ws], slop, need), "right") - 1).tolist()):
                            near[d].add(plans.items[item])
                merged = []
                for own in spans:
                    flat: list[list[int]] = []
                    for a, b in sorted(own):
                        if flat and a <= flat[-1][1]:
                            flat[-1][1] = max(flat[-1][1], b)
                        else:
                            flat.append([a, b])
                    merged.append(flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], pa.int64()), pa.array(row["doc_key"], pa.int64()), pa.array(row["text_hash"], pa.int64()), pa.array(row["size"], pa.int64()),
                        pa.array([[a for a, _ in m] for m in merged], pa.list_(pa.int64())), pa.array([[b for _, b in m] for m in merged], pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in items_], pa.list_(pa.string())), pa.array([sorted(x) for x in near], pa.list_(pa.string())),
                    ],
                    ["doc_id", "doc_key", "text_hash", "n_words", "starts", "ends", "items", "near"],
                )

    return index.mapInArrow(lean(run), FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, near_terms: int = 4, slop: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is `window` consecutive
    words of an item of benchmark (item_id, text); an item with fewer words, but not none, is one window. n_hit: words
    of the document inside any occurrence of a window; items_sha256: of the sorted, comma-joined ids of items with
    occurring windows. n_near: items of which `near_terms` of the `near_terms` + 1 rarest words that occur in docs at all
    lie within `slop` words of the rarest or the second; if no more words occur than are needed, all within `slop` of the
    rarest. Of an item with fewer words all are needed, but for one that occurs nowhere where two others do. text_hash: xxhash64 of the text (null as empty), which together with doc_id tells rows apart. Null or empty texts have no words; items without id or words match nothing; an item_id given twice is one
    item with both texts. Rows that repeat a doc_id are given as often as they come; a null doc_id stays null. Other
    columns are ignored. No documents give no rows; no items leave every document clean.
    """
    prepared(docs.sparkSession)
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    found, blocks = None, 0
    if (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        keyed = settled(keyed, "keyed")  # a document has one key in the indexes of all blocks
    for block in item_blocks(benchmark, block_bytes):
        vocabulary = {w for _, t in block for w in words(t)}
        index = build_index(keyed, vocabulary)
        one = match(index, block, term_counts(index), window, near_terms, slop)
        found = one if found is None else found.unionByName(one)
        blocks += 1
    if blocks > 1:  # the spans of a document come from several blocks of items
        found = found.groupBy("doc_key").agg(
            F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.max("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")], *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")],
        )
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(spans, zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["ends"] - F.greatest(s["to"], x["starts"]))).alias("n"), F.greatest(s["to"], x["ends"]).alias("to")))["n"]
    return found.select(
        "doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
    )
