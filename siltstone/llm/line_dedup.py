"""Line near-duplicates by a deletion-neighbourhood join.

Two lines within one edit share a variant: a string left by deleting one character of a line, or the line itself. Every
variant is a hashed key; lines with equal variants are joined, their edit distance is verified on the texts, and only
the earliest stays. Before variants are made, an exact test leaves out lines that can't have a partner: one edit lies in
the first or in the second half, so partners share the other half, character for character, as lines of the same
smaller length; and of a line that shares a half, only the variants of edits outside it are made. A variant's group holds
only lines that differ from it in one place, and gives a row for each line, never a pair for each two.

The bound holds for lines of every length: an edit for every PER_EDIT characters of the longer line, which is a
similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, prepared, settled

BLANK = " \t\r\f\x0b"
#: Characters of the longer line for each edit: one of five changed is a similarity of 0.8.
PER_EDIT = 5
#: Variants in a batch.
BATCH = 1 << 16

_P1, _P2 = (1 << 31) - 1, (1 << 31) - 19
_BASE, _B1, _B2 = 0x9E3779B97F4A7C15 | 1, 1_000_003, 69_069_069


class Variants:
    """Hashes of a string with each single character deleted, in linear time: 64 bits and two primes of 31 bits."""

    def __init__(self) -> None:
        self.inverse = (pow(_BASE, -1, 1 << 64), pow(_B1, -1, _P1), pow(_B2, -1, _P2))
        self.powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 3

    def _power(self, n: int) -> list[np.ndarray]:
        while len(self.powers[0]) < n:
            have = len(self.powers[0])
            grown = []
            for p, base, mod in zip(self.powers, (_BASE, _B1, _B2), (0, _P1, _P2), strict=True):
                step = np.uint64(pow(base, have, mod or 1 << 64))
                grown.append(np.concatenate((p, p * step if not mod else p * step % np.uint64(mod))))
            self.powers = grown
        return [p[:n] for p in self.powers]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Two arrays of n + 1 keys: of the text itself, then without its first, second ... character."""
        x = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        keys = []
        for p, mod, inv in zip(self._power(len(x)), (0, _P1, _P2), self.inverse, strict=True):
            own = x * np.uint64(0xD6E8FEB86659FD93) * p if not mod else x * p % np.uint64(mod)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))
            if not mod:
                gone = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(inv)
            else:
                m = np.uint64(mod)
                gone = (sums[:-1] + (sums[-1] - sums[1:]) % m * np.uint64(inv)) % m
                sums = sums % m
            keys.append(np.concatenate((sums[-1:], gone)))
        return keys[0].view(np.int64), (keys[1] << np.uint64(31) | keys[2]).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("k"), text.alias("t"))


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of (smaller length, side, half) of a line: as the smaller or an equal one of a pair first, then as the larger one."""
    keys = []
    for c in (n, n - 1):
        half = F.floor(c / 2).cast("int")
        keys += [F.xxhash64(c, F.lit(0), F.substring(line, F.lit(1), half)), F.xxhash64(c, F.lit(1), F.substring(line, n - half + 1, half))]
    return F.array(*keys)


def places(n: int, roles: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of a line of n characters that shares halves with others (a bit for each of _half_keys): the places where an equally long
    partner may differ, those of a character that a shorter partner lacks, and whether a longer one may come."""

    def outside(smaller: int, bits: int) -> np.ndarray:
        half, can = smaller // 2, np.zeros(n, bool)
        can[half:] |= bool(bits & 1)
        can[: n - half] |= bool(bits & 2)
        return np.flatnonzero(can)

    return outside(n, roles), outside(n - 1, roles >> 2), bool(roles & 3)


def _variant_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The variants of each line, in batches of bounded size, of short lines together and of a long line in turn.

    Those with a place are of one length and lack the character there, as lines that differ only there do; of the
    others, place -1, one is the line itself (own).
    """
    variants, names = Variants(), ["k1", "k2", "place", "size", "own", "h", "at"]
    for batch in batches:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def give() -> pa.RecordBatch:
            row, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), *[batch.column(c).take(pa.array(row)) for c in ("h", "at")]], names)

        for row, (line, roles) in enumerate(zip(batch.column("line").to_pylist(), batch.column("roles").to_pylist(), strict=True)):
            a, b = variants(line)
            same, less, more = places(len(line), roles)
            key = np.concatenate((same + 1, less + 1, np.zeros(int(more), np.int64)))
            place = np.concatenate((same, np.full(len(less) + more, -1))).astype(np.int32)
            size = np.concatenate((np.full(len(same), len(line)), np.full(len(less), len(line) - 1), np.full(int(more), len(line)))).astype(np.int32)
            own = np.arange(len(key)) >= len(same) + len(less)
            for k in range(0, len(key), BATCH):
                part = slice(k, k + BATCH)
                held.append((np.full(len(key[part]), row), a[key[part]], b[key[part]], place[part], size[part], own[part]))
                count += len(key[part])
                if count >= BATCH:
                    yield give()
                    held, count = [], 0
        if held:
            yield give()


def kept_lines(docs: DataFrame, max_edits: int = 1, per_edit: int = PER_EDIT) -> DataFrame:
    """(d, k, kept): for each document with a kept line, its id, the hash of its text and the kept line numbers.

    Blank lines are not among them. See line_dedup for what is kept.
    """
    if max_edits not in (0, 1):
        raise ValueError("variants of two deletions are quadratic in the line; bounds of 0 and 1 are offered")
    prepared(docs.sparkSession)
    keyed = _keyed(docs)
    at = F.struct("d", "k", "i").alias("at")
    lines = keyed.select("d", "k", F.posexplode(F.split("t", "\n", -1)).alias("i", "raw")).select(at, F.btrim("raw", F.lit(BLANK)).alias("line")).where("line <> ''")
    n = F.char_length("line")
    firsts = lines.select("at", F.unhex(F.md5("line")).alias("h"), n.alias("n"), _half_keys(F.col("line"), n).alias("halves"))
    first = settled(firsts.groupBy("h").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves")), "lines")
    if not max_edits:
        return first.groupBy("at.d", "at.k").agg(F.collect_list("at.i").alias("kept"))
    half = first.where(F.col("n") >= per_edit - 1).select("h", "at", F.posexplode("halves").alias("role", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    maybe = half.join(shared, "half", "left_semi").groupBy("h", "at").agg(F.bit_or(F.expr("shiftleft(1, role)")).alias("roles"))
    wanted = maybe.groupBy("at.d", "at.k").agg(F.collect_list(F.struct("at.i", "h", "roles")).alias("some"))
    arr = F.split("t", "\n", -1)
    found = (
        keyed.select("d", "k", "t").join(wanted.withColumnsRenamed({"d": "wd", "k": "wk"}), F.col("k").eqNullSafe(F.col("wk")) & F.col("d").eqNullSafe(F.col("wd")))
        .select("d", "k", arr.alias("arr"), F.explode("some").alias("s"))
        .select(F.col("s.h").alias("h"), F.col("s.roles").alias("roles"), F.struct("d", "k", "s.i").alias("at"), F.btrim(F.get("arr", F.col("s.i")), F.lit(BLANK)).alias("line"))
    )
    texts = settled(found, "candidates").dropDuplicates(["h"])

    schema = "k1 long, k2 long, place int, size int, own boolean, h binary, at struct<d:bigint,k:bigint,i:int>"
    variants = texts.mapInArrow(lean(_variant_rows), schema)
    w = Window.partitionBy("k1", "k2", "place", "size")
    line = F.struct("at", "h")
    partner = F.when(F.col("place") >= 0, F.min(line).over(w)).when(F.col("own"), F.min(F.when(~F.col("own"), line)).over(w)).otherwise(F.min(F.when(F.col("own"), line)).over(w))
    pairs = variants.withColumn("p", partner).where("p.at < at").select("h", F.col("p.h").alias("ph")).distinct()
    near = (F.greatest(F.char_length("a"), F.char_length("b")) >= per_edit) & F.levenshtein("a", "b", max_edits).between(0, max_edits)
    verified = pairs.join(texts.select("h", F.col("line").alias("a")), "h").join(texts.select(F.col("h").alias("ph"), F.col("line").alias("b")), "ph").where(near)
    stay = first.select("h", "at").join(verified.select("h").distinct(), "h", "left_anti")
    return stay.groupBy("at.d", "at.k").agg(F.collect_list("at.i").alias("kept"))


def line_dedup(docs: DataFrame, max_edits: int = 1, per_edit: int = PER_EDIT) -> DataFrame:
    """Every row of docs (doc_id, text, any others) as a struct `row`, with text, n_lines, n_kept and n_kept_blank.

    Lines end at line feeds and are compared without white space at their ends. Blank lines are kept. A line stays if no
    earlier one, by doc_id (null first), hash of the text, and line number, equals it or, where the longer of the two has
    per_edit characters, is within max_edits edits of code points; this holds whether the earlier one stays itself or not. text
    is the kept lines joined by line feeds. Null texts count as empty: one blank line. Rows that repeat a doc_id with the same text
    are one document and have the same text; no rows give none.
    """
    kept = kept_lines(docs, max_edits, per_edit).withColumnsRenamed({"d": "kd", "k": "kk"})
    arr = F.col("arr")
    blanks = F.filter(F.transform(arr, lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) == "", i)), lambda i: i.isNotNull())
    stay = F.array_sort(F.concat(F.coalesce("kept", F.array().cast("array<int>")), F.col("blanks")))
    joined = _keyed(docs).join(kept, F.col("k").eqNullSafe(F.col("kk")) & F.col("d").eqNullSafe(F.col("kd")), "left").select("row", "d", "kept", F.split("t", "\n", -1).alias("arr"))
    return (
        joined.withColumn("blanks", blanks)
        .withColumn("stay", stay)
        .select(
            "row", F.col("d").alias("doc_id"), F.array_join(F.transform("stay", lambda i: F.get(arr, i)), "\n").alias("text"),
            F.size("arr").cast("long").alias("n_lines"), F.size("stay").cast("long").alias("n_kept"), F.size("blanks").cast("long").alias("n_kept_blank"),
        )
    )
