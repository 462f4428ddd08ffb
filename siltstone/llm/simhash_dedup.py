"""SimHash near-duplicates by a self-join over the binary trie of the fingerprints.

The trie's upper levels are dealt out: the 64 bits are cut into six blocks, and a pair within four bits agrees on two
whole blocks at least (four bits spoil four blocks at most), so under each of the 15 choices of two blocks the pair
falls below the same node. Each such subtree, or for a large one each pair of its parts, is a unit of work.
Inside a task all units are walked together, from branch to branch: node pairs that were reached go to their child
pairs, the bits in which the two paths differ are added up, and a pair of nodes over the error budget is dropped, as is
one whose leaves are known to be one component; two leaves within the budget are a link. A task gives one link a leaf at
most (to its root there). Nodes of the graph are named by the smallest doc_id of a fingerprint, so that a component's
root is its name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, joined_on_hot, lean, pieces, prepared, settled, texts
from .components import connected_components, roots

WIDTHS = (11, 11, 11, 11, 10, 10)
#: Fingerprints in a unit, or in each of the two parts that a unit joins.
UNIT = 2048
#: Node pairs that are walked at once.
STEP = 1 << 18


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Of lower-cased UTF-8: bits set in over half of the XXH64 (seed 42) of the word shingles; no word gives zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[k : k + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's bits as a signed long; null text counts as empty."""
    prepared(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            own = texts(part)
            fps, marks = (np.array([f(t) for t in own], np.uint64).view(np.int64) for f in (lambda t: fingerprint(t, shingle), lambda t: xxhash.xxh64_intdigest(t, 42)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, text_hash long, fp long")


def _branches(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The bit (0: the highest) at which the leaves [lo, hi) of a node first differ, 64 for a single leaf."""
    x = fps[lo] ^ fps[hi - 1]
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return 64 - np.bitwise_count(x).astype(np.int64)


def _middle(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the leaves [lo, hi) of a node that branches at the bit go from 0 to 1 there."""
    lo, hi, shift = lo.copy(), hi - 1, (63 - bit).astype(np.uint64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        one = (fps[mid] >> shift) & np.uint64(1) == 1
        hi = np.where(one, mid, hi)
        lo = np.where(one, lo, np.minimum(mid + 1, hi))
    return lo


def trie_links(fps: np.ndarray, tops: np.ndarray, budget: int, seen: dict[str, int] | None = None) -> np.ndarray:
    """Roots of the components that links within the budget make of fps (uint64), which are sorted inside each part.

    tops: rows (a0, a1, b0, b1), the pairs of nodes to start from; a node with itself is [a0, a1) twice. A node is the
    leaves below it, and paths without a branch are walked in one step. seen: gets how many node pairs were visited, how many
    of them went over the budget, were of one component already, or were a link of two leaves.
    """
    at = np.arange(len(fps))
    todo = [(tops, np.zeros(len(tops), np.int64), np.zeros(len(tops), np.int64))]
    count = dict.fromkeys(("visited", "over", "known", "links"), 0)
    while todo:
        pairs, depth, err = todo.pop()
        if len(pairs) > STEP:
            todo.append((pairs[STEP:], depth[STEP:], err[STEP:]))
            pairs, depth, err = pairs[:STEP], depth[:STEP], err[:STEP]
        count["visited"] += len(pairs)
        a0, a1, b0, b1 = pairs.T
        turn = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
        known = (turn[a1 - 1] == turn[a0]) & (turn[b1 - 1] == turn[b0]) & (at[a0] == at[b0])
        count["known"] += int(known.sum())
        a0, a1, b0, b1, depth, err = (v[~known] for v in (a0, a1, b0, b1, depth, err))
        branch_a, branch_b = _branches(fps, a0, a1), _branches(fps, b0, b1)
        down = np.minimum(branch_a, branch_b)
        # Both paths go down to the first branch of either; the bits in which they differ on the way are added up.
        path = (fps[a0] ^ fps[b0]) << depth.astype(np.uint64) >> depth.astype(np.uint64)
        rest = np.where(down < 64, path & ~np.uint64(0) >> np.minimum(down, 63).astype(np.uint64), 0)
        err = err + np.bitwise_count(path ^ rest)
        ok = err <= budget
        count["over"] += int((~ok).sum())
        a0, a1, b0, b1, err, down, branch_a, branch_b = (v[ok] for v in (a0, a1, b0, b1, err, down, branch_a, branch_b))
        leaf = down == 64
        count["links"] += int(leaf.sum())
        if leaf.any():
            at = roots(len(fps), a0[leaf], b0[leaf], at)
        a0, a1, b0, b1, err, down, branch_a, branch_b = (v[~leaf] for v in (a0, a1, b0, b1, err, down, branch_a, branch_b))
        if not len(a0):
            continue
        cut_a, cut_b = branch_a == down, branch_b == down
        same = (a0 == b0) & (a1 == b1)
        am, bm = a1.copy(), b1.copy()
        am[cut_a], bm[cut_b] = _middle(fps, a0[cut_a], a1[cut_a], down[cut_a]), _middle(fps, b0[cut_b], b1[cut_b], down[cut_b])
        # A node that doesn't branch here stays whole, as its own lower half; the other half is empty.
        children = [(a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), tuple(np.where(same, 0, v) for v in (am, a1, b0, bm))]
        new = np.concatenate([np.stack(c, 1) for c in children])
        some = (new[:, 1] > new[:, 0]) & (new[:, 3] > new[:, 2])
        todo.append((new[some], np.tile(down, 4)[some], np.tile(err, 4)[some]))
    if seen is not None:
        for k, v in count.items():
            seen[k] = seen.get(k, 0) + v
    return at


def _walk(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit and part: whole units are walked some ten thousand rows at a time."""

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        unit, part, fps, ids = rows[:, :4], rows[:, 4], rows[:, 5].view(np.uint64), rows[:, 6:]
        new = np.concatenate(([True], (unit[1:] != unit[:-1]).any(1)))
        no = np.cumsum(new) - 1
        order = np.lexsort((fps, part, no))
        fps, part, no, ids = fps[order], part[order], no[order], ids[order]
        edge = np.flatnonzero(np.concatenate(([True], (no[1:] != no[:-1]) | (part[1:] != part[:-1]))))
        ends, of = np.append(edge[1:], len(no)), no[edge]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        lone = unit[new][:, 2] == unit[new][:, 3]
        two = np.append(first[1:], len(of)) - first == 2
        s, t = first[lone], first[~lone & two]
        tops = np.concatenate((np.stack((edge[s], ends[s], edge[s], ends[s]), 1), np.stack((edge[t], ends[t], edge[t + 1], ends[t + 1]), 1)))
        at = trie_links(fps, tops, budget)
        own = np.flatnonzero(at != np.arange(len(at)))
        node = lambda k: pa.StructArray.from_arrays([pa.array(ids[k, 0] == 1), pa.array(ids[k, 1])], ["nameless", "id"])
        return pa.RecordBatch.from_arrays([node(own), node(at[own])], ["a", "b"])

    held: list[np.ndarray] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
        count += batch.num_rows
        if count >= 1 << 16:
            rows = np.concatenate(held)
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1))
            end = change[-1] + 1 if len(change) else 0
            if end:
                yield solve(rows[:end])
            held, count = [rows[end:]], len(rows) - end
    if count:
        yield solve(np.concatenate(held))


def links(fps: DataFrame, budget: int = 4, unit: int = UNIT) -> DataFrame:
    """Distinct fingerprints (fp, nameless, id) to links (a, b) with the same components as all pairs within the budget.

    a and b are structs (nameless, id), ordered so that a named node is smaller. The blocks prove whole results for
    budgets up to 4; subtrees of over `unit` leaves are cut into parts by a hash, and each pair of parts is a unit, so no
    task grows with a subtree.
    """
    if not 0 <= budget <= 4:
        raise ValueError("six blocks, two of them equal, hold for a budget of at most 4 bits")
    masks, low = [], 64
    for w in WIDTHS:
        low -= w
        masks.append(((1 << w) - 1) << low)
    keys = [m - (1 << 64) if (m := masks[i] | masks[j]) >> 63 else m for i, j in combinations(range(6), 2)]
    own = ("fp", "nameless", "id")
    spread = fps.select(*own, F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("perm"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(keys)])).alias("k")).select(*own, "k.perm", "k.key")
    sizes = spread.groupBy("perm", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / unit).cast("long")
    cells = (
        spread.join(sizes, ["perm", "key"])
        .select("perm", "key", *own, parts.alias("p"))
        .withColumn("part", F.when(F.col("p") > 1, F.pmod(F.xxhash64("fp"), F.col("p"))).otherwise(F.lit(0).cast("long")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
        .select("perm", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *own)
    )
    dealt = cells.repartition("perm", "key", "i", "j").sortWithinPartitions("perm", "key", "i", "j")
    node = "struct<nameless:boolean,id:bigint>"
    return dealt.mapInArrow(lean(lambda b: _walk(b, budget)), f"a {node}, b {node}")


def simhash_groups(docs: DataFrame, budget: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, kept, first) for each row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable by links, itself included; kept: doc_id = component_id. Null or empty
    texts have fingerprint zero and link like others. A row with null doc_id is fingerprinted and links, but can't name a
    component; without a named document its component is null, and kept false. Rows that repeat a doc_id are given as
    often as they come. No rows give none. text_hash: xxhash64 of the text (null as empty), which together with doc_id tells
    rows apart; first: whether the row stands for its component, by doc_id (null last) and then text_hash.
    """
    prepared(docs.sparkSession)
    fps = settled(fingerprints(docs, shingle), "simhash")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", "text_hash").alias("id"), F.col("text_hash").alias("th"))
    per_fp = fps.groupBy("fp").agg(F.min(own).alias("own"), F.count("*").alias("n"))
    # Nameless nodes go by their fingerprint: two of them may hold one text hash, but none is the smallest beside a named one.
    nodes = settled(per_fp.select("fp", "own", "n", F.col("own.nameless").alias("nameless"), F.when(F.col("own.nameless"), F.col("fp")).otherwise(F.col("own.id")).alias("id")), "fingerprints")
    comps = connected_components(links(nodes.select("fp", "nameless", "id"), budget))
    node = F.struct("nameless", "id")
    rooted = nodes.withColumn("at", node).join(comps.withColumnRenamed("node", "at"), "at", "left").withColumn("root", F.coalesce("root", "at"))
    # The smallest row of a component is that of its root's fingerprint, for named ones; a nameless component goes by its root too.
    by_fp = settled(rooted.select("fp", "n", "own", F.when(~F.col("root.nameless"), F.col("root.id")).alias("component_id"), (F.col("root") == F.col("at")).alias("head")), "rooted")
    joined = joined_on_hot(fps, by_fp, ["fp"], "n")
    first = F.col("head") & (own == F.col("own"))
    return joined.select(
        "doc_id",
        "text_hash",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        first.alias("first"),
    )
