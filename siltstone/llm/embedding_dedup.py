"""Near-duplicate embeddings by small-world graphs.

Vectors are compared inside a label (and a number of dimensions). Equal vectors are put together first, with their
number. A label's vectors are dealt by a hash to shards of bounded size. A hierarchical navigable small-world graph is
built once for each shard and stored with it; every vector of the shard, and of all shards before it, searches it. A beam
that is full of links is widened; then an audit holds what the beams found against exact products of the same two shards,
and the beams of the queries that missed a link are widened again until nothing is missed (a beam as wide as the shard
sees all of it). Found pairs are verified by cosine in double precision. A pair of shards gives a link for each vector (to its
root there), and how many it has, never a pair of vectors.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined_on_hot, prepared, settled
from .components import connected_components, roots

SHARD = 8192
#: Components of all vectors of a shard together, at most; vectors of many dimensions have smaller shards.
SHARD_NUMBERS = 1 << 22
#: The products of a search are in single precision; a pair this far below the threshold is still verified in double.
SLACK = 1e-4


class Graph:
    """Layered neighbour lists over unit vectors (float32 rows); points are added in batches, all searches in step."""

    def __init__(self, x: np.ndarray, links: int = 12, beam: int = 48, batch: int = 512) -> None:
        self.x, self.links, n = x, links, len(x)
        self.order = np.random.default_rng(7).permutation(n)
        self.v = x[self.order]
        tops = [n]
        while tops[-1] > 4 * links:
            tops.append(max(1, tops[-1] // (2 * links)))
        self.layers = [self._build(size, beam, batch) for size in tops[::-1]]

    def stored(self) -> list[bytes]:
        """The order and the layers, as from_stored takes them."""
        return [x.astype("<i4").tobytes() for x in (self.order, *self.layers)]

    @classmethod
    def from_stored(cls, x: np.ndarray, parts: list[bytes], links: int = 12) -> Graph:
        graph = cls.__new__(cls)
        graph.x, graph.links = x, links
        graph.order, *layers = (np.frombuffer(p, "<i4").astype(np.int64) for p in parts)
        graph.v, graph.layers = x[graph.order], [v.reshape(-1, 2 * links) for v in layers]
        return graph

    def _build(self, size: int, beam: int, batch: int) -> np.ndarray:
        """The layer of the first `size` points: a first block by exact products, then batches that search it."""
        m = 2 * self.links
        near = np.full((size, m), -1, np.int64)
        done = min(size, 4 * self.links)
        if done > 1:
            sims = self.v[:done] @ self.v[:done].T
            np.fill_diagonal(sims, -np.inf)
            ids = np.argsort(-sims, axis=1)[:, : done - 1]
            near[:done] = self._choose(self.v[:done], ids, np.take_along_axis(sims, ids, 1), m)
        while done < size:
            end = min(size, done + min(batch, max(32, done)))
            q = self.v[done:end]
            ids, sims = self._beam(near, done, q, np.zeros((len(q), 1), np.int64), beam)
            own = q @ q.T
            own[np.triu_indices(len(q))] = -np.inf
            k = min(len(q), self.links)
            best = np.argpartition(-own, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(own, best, 1)
            ids, sims = np.concatenate((ids, np.where(np.isfinite(s), best + done, -1)), 1), np.concatenate((sims, s), 1)
            chosen = self._choose(q, ids, sims, self.links)
            near[done:end, : self.links] = chosen
            a = np.repeat(np.arange(done, end), self.links)
            b = chosen.ravel()
            a, b = a[b >= 0], b[b >= 0]
            self._back(near, a, b, m)
            done = end
        return near

    def _back(self, near: np.ndarray, a: np.ndarray, b: np.ndarray, m: int) -> None:
        """Links b -> a for new links a -> b; a list that overflows is chosen anew."""
        sims = np.einsum("id,id->i", self.v[a], self.v[b])
        by = np.lexsort((-sims, b))
        a, b, sims = a[by], b[by], sims[by]
        targets, first = np.unique(b, return_index=True)
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        keep = rank < m
        row = np.searchsorted(targets, b[keep])
        new = np.full((len(targets), m), -1, np.int64)
        new[row, rank[keep]] = a[keep]
        ids = np.concatenate((near[targets], new), 1)
        s = np.einsum("bmd,bd->bm", self.v[ids], self.v[targets])
        s[ids < 0] = -np.inf
        near[targets] = self._choose(self.v[targets], ids, s, m)

    def _choose(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the candidates, near ones first, passing over those nearer to a chosen one than to q; then the rest."""
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        out, count = np.full((len(q), m), -1, np.int64), np.zeros(len(q), np.int64)
        kept = np.zeros((len(q), m, q.shape[1]), np.float32)
        skip, rows = np.isfinite(sims) & (ids >= 0), np.arange(len(q))
        late = np.zeros_like(skip)
        for c in range(ids.shape[1]):
            ok = skip[:, c] & (count < m)
            if not ok.any():
                continue
            v = self.v[ids[:, c]]
            closest = np.einsum("bmd,bd->bm", kept, v)
            closest[np.arange(m) >= count[:, None]] = -np.inf
            far = ok & (closest.max(1) < sims[:, c])
            late[:, c] = ok & ~far
            r = rows[far]
            out[r, count[r]], kept[r, count[r]] = ids[r, c], v[r]
            count[r] += 1
        for c in range(ids.shape[1]):
            r = rows[late[:, c] & (count < m)]
            out[r, count[r]] = ids[r, c]
            count[r] += 1
        return out

    def _beam(self, near: np.ndarray, size: int, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam best points of the first `size` for each query, by best-first search from the entries."""
        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, size + 1), bool)
        seen[:, size] = True
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        ids[:, : entry.shape[1]] = entry
        s = np.einsum("bmd,bd->bm", self.v[entry], q)
        s[entry < 0] = -np.inf
        sims[:, : entry.shape[1]] = s
        open_[:, : entry.shape[1]] = entry >= 0
        seen[rows[:, None], np.where(entry < 0, size, entry)] = True
        live = rows
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            at = score.argmax(1)
            live, at = live[(go := np.isfinite(score[np.arange(len(live)), at]))], at[go]
            if not len(live):
                break
            open_[live, at] = False
            nb = near[ids[live, at]]
            nb = np.where((nb < 0) | (nb >= size), size, nb)
            fresh = ~seen[live[:, None], nb]
            seen[live[:, None], nb] = True
            s = np.einsum("bmd,bd->bm", self.v[np.where(fresh, nb, 0)], q[live])
            s[~fresh] = -np.inf
            all_s, all_i = np.concatenate((sims[live], s), 1), np.concatenate((ids[live], np.where(fresh, nb, -1)), 1)
            all_o = np.concatenate((open_[live], fresh), 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], open_[live] = (np.take_along_axis(v, top, 1) for v in (all_s, all_i, all_o))
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and products of about the `beam` nearest vectors; -1 where there are fewer."""
        if beam >= len(self.v):
            return np.broadcast_to(np.arange(len(self.x)), (len(q), len(self.x))), q @ self.x.T
        out_i, out_s = [], []
        for k in range(0, len(q), 512):
            part, entry = q[k : k + 512], np.zeros((len(q[k : k + 512]), 1), np.int64)
            for near in self.layers[:-1]:
                ids, sims = self._beam(near, len(near), part, entry, 4)
                entry = np.take_along_axis(ids, sims.argsort(1)[:, ::-1], 1)
            ids, sims = self._beam(self.layers[-1], len(self.v), part, entry[:, :beam], beam)
            out_i.append(np.where(ids < 0, -1, self.order[ids]))
            out_s.append(sims)
        return np.concatenate(out_i), np.concatenate(out_s)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float, beam: int = 48, audit: float = 1.0, graph: Graph | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Index pairs (into x, into y; y None: both into x, first below second) with cosine >= threshold, and what was done.

    audit: share of the queries that are held against exact products; the default is all of them. graph: that of y, if
    there is one already.
    """
    same = y is None
    y = x if same else y
    xf, yf = x.astype(np.float32), y.astype(np.float32)
    graph, low = graph or Graph(yf), np.float32(threshold - SLACK)
    found: dict[int, np.ndarray] = {}
    todo, wide, widened, missed = np.arange(len(x)), beam, 0, 0
    first = True
    while len(todo):
        full = []
        for k in range(0, len(todo), 1024):
            part = todo[k : k + 1024]
            ids, sims = graph.search(xf[part], wide)
            hit = (sims >= low) & (ids >= 0)
            crowded = hit.all(1) & (wide < len(y))
            full += part[crowded].tolist()
            for r in range(len(part)):
                found[int(part[r])] = np.sort(ids[r][hit[r]])
        step = max(1, round(1 / audit)) if audit > 0 else len(x) + 1
        again = set(full)
        audited = todo[::step] if first else todo
        for k in range(0, len(audited), 1024):
            part = audited[k : k + 1024]
            want = xf[part] @ yf.T >= low
            for r in np.flatnonzero(want.sum(1) != [len(found[int(p)]) for p in part]):
                if not np.isin(np.flatnonzero(want[r]), found[int(part[r])]).all():
                    again.add(int(part[r]))
                    missed += 1
        if missed and step > 1 and first:  # a sampled audit failed: all beams are widened
            again |= set(todo.tolist())
        first, wide, widened = False, wide * 4, widened + len(again)
        if wide > len(y) // 2:
            wide = len(y)
        todo = np.array(sorted(again), np.int64)
    a = np.repeat(np.fromiter(found, np.int64, len(found)), [len(v) for v in found.values()])
    b = np.concatenate([*found.values(), np.zeros(0, np.int64)]).astype(np.int64)
    if same:
        keep = a != b
        a, b = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        code = np.unique(a * len(y) + b)
        a, b = code // len(y), code % len(y)
    ok = np.concatenate([np.einsum("id,id->i", x[a[k : k + (1 << 17)]], y[b[k : k + (1 << 17)]]) >= threshold for k in range(0, len(a), 1 << 17)] or [np.zeros(0, bool)])
    return a[ok], b[ok], {"queries": len(x), "links": int(ok.sum()), "widened": widened, "missed": missed}


#: What became of a pair of shards: the links of its vectors, each as (node, root), how many each has, and the audit.
_NODES = "ids array<bigint>, hashes array<bigint>"
_DONE = "counts array<bigint>, roots array<int>, queries bigint, links bigint, widened bigint, missed bigint"
_SHARD = f"label string, dim int, p bigint, i bigint, j bigint, {_NODES}, sizes array<bigint>, v binary, graph array<binary>, {_DONE}"
_PAIR = f"label string, dim int, i bigint, j bigint, {_NODES}, {_DONE}"


def _columns(schema: str, **values) -> pa.Table:
    """One row of the schema's columns."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    return pa.table({c: pa.array([values[c]], kinds[k]) for c, k in (x.split() for x in schema.split(", "))})


def _linked(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> dict:
    """Roots, and numbers of linked vectors, of nodes that stand for so many equal vectors each."""
    n = len(sizes)
    count = np.bincount(a, sizes[b], n) + np.bincount(b, sizes[a], n) if len(a) else np.zeros(n)
    return {"counts": count.astype(np.int64), "roots": roots(n, a, b).astype(np.int32)}


def _links(alike: DataFrame, threshold: float, shard: int, beam: int, audit: float) -> DataFrame:
    """_PAIR for each shard of (label, dim, id, h, n, v) with itself (i = j), and for each two shards of a label (i < j)."""
    rows_of = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(SHARD_NUMBERS) / F.greatest("dim", F.lit(1)))))
    shards = alike.groupBy("label", "dim").agg(F.ceil(F.count("*") / rows_of).cast("long").alias("p"))
    # Dealt by shard: the join's own partitioning, by label, would put all shards of a label into one task.
    dealt = alike.join(shards, ["label", "dim"]).withColumn("own", F.pmod("h", F.col("p"))).repartition("label", "dim", "own")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("h", "ascending")]).combine_chunks()
        dim, n = table.column("dim")[0].as_py(), len(table)
        x = unit_rows(table.column("v").combine_chunks().flatten().to_numpy().reshape(n, dim))
        graph, sizes = Graph(x.astype(np.float32)), table.column("n").to_numpy()
        a, b, seen = near_pairs(x, None, threshold, beam, audit, graph)
        own = {c: table.column(c)[0].as_py() for c in ("label", "p")}
        k = table.column("own")[0].as_py()
        return _columns(_SHARD, **own, dim=dim, i=k, j=k, ids=table.column("id").to_numpy(), hashes=table.column("h").to_numpy(), sizes=sizes, v=x.tobytes(), graph=graph.stored(), **_linked(a, b, sizes), **seen)

    def meet(table: pa.Table) -> pa.Table:
        ask, have = sorted(table.to_pylist(), key=lambda r: r["own"])
        x, y = (np.frombuffer(r["v"], np.float64).reshape(-1, r["dim"]) for r in (ask, have))
        a, b, seen = near_pairs(x, y, threshold, beam, audit, Graph.from_stored(y.astype(np.float32), have["graph"]))
        both = {c: ask[c] + have[c] for c in ("ids", "hashes", "sizes")}
        return _columns(_PAIR, **{c: ask[c] for c in ("label", "dim", "i", "j")}, **both, **_linked(a, b + len(x), np.array(both["sizes"])), **seen)

    packed = settled(dealt.groupBy("label", "dim", "own").applyInArrow(build, _SHARD), "graphs")
    # Each shard goes to each of its label's others, the later one of two with its graph; the two make a group of their own.
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda k: k != F.col("i")))
    sides = packed.where("p > 1").select("label", "dim", F.col("i").alias("own"), other.alias("other"), "ids", "hashes", "sizes", "v", "graph")
    keyed = sides.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ids", "hashes", "sizes", "v", F.when(F.col("own") > F.col("other"), F.col("graph")).alias("graph"))
    met = keyed.groupBy("label", "dim", "i", "j").applyInArrow(meet, _PAIR)
    return settled(packed.select(*[x.split()[0] for x in _PAIR.split(", ")]).unionByName(met), "links")


def _prepared_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, v, label, usable), and the distinct usable vectors (label, dim, id, h, n, v) of them."""
    prepared(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists("v", lambda c: c != 0)
    rows = settled(rows.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))), "vectors")
    alike = rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    return rows, settled(alike.withColumns({"dim": F.size("v"), "h": F.xxhash64("label", "v")}), "distinct")


def recall_audit(embeddings: DataFrame, threshold: float = 0.98, shard: int = SHARD, beam: int = 48) -> DataFrame:
    """(label, dim, i, j, queries, links, missed, widened, recall) for each pair of shards.

    missed: how often an audit found a query whose beam had passed over a link, and it was widened therefore; recall: the share of
    queries without that. The links themselves are whole after the audit. Odd rows: see embedding_groups.
    """
    _, alike = _prepared_vectors(embeddings)
    share = F.greatest(F.lit(0.0), 1 - F.col("missed") / F.col("queries"))
    return _links(alike, threshold, shard, beam, 1.0).select("label", "dim", "i", "j", "queries", "links", "missed", "widened", share.alias("recall"))


def embedding_groups(embeddings: DataFrame, threshold: float = 0.98, shard: int = SHARD, beam: int = 48, audit: float = 1.0) -> DataFrame:
    """A row for each row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if labels are equal and not null, they have as many dimensions, and cosine >= threshold. Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without vec_id (theirs
    is component null, kept false). Equal vectors link with each other; rows that repeat a vec_id count as vectors each.
    component_id: the smallest vec_id reachable, itself included; kept: vec_id = component_id. Other columns are
    ignored; no rows give none. See recall_audit for what the beams missed before they were widened.
    """
    rows, alike = _prepared_vectors(embeddings)
    done = _links(alike, threshold, shard, beam, audit)
    node = lambda k: F.struct(F.get("ids", k).alias("id"), F.get("hashes", k).alias("h"))
    per_unit = done.select("ids", "hashes", F.posexplode(F.arrays_zip("counts", "roots")).alias("k", "x")).select(node(F.col("k")).alias("a"), node(F.col("x.roots")).alias("b"), F.col("x.counts").alias("count"))
    counts = per_unit.groupBy("a").agg(F.sum("count").alias("count"))
    comps = connected_components(per_unit.select("a", "b"))
    own = alike.select("label", "v", "n", F.struct("id", "h").alias("a")).join(counts, "a").join(comps.withColumnRenamed("node", "a"), "a", "left")
    named = cut(own.select("label", "v", "n", "count", F.coalesce("root.id", "a.id").alias("component_id")))

    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    linked = joined_on_hot(rows.where("usable").select("vec_id", "label", "v"), named, ["label", "v"], "n").select("vec_id", (F.col("count") + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept)
