"""Embedding near-dedup by hierarchical navigable small-world graphs, one for each shard of a label.

Equal vectors are one class. The classes of a label are dealt into shards of bounded size; each shard gets a graph; every class
queries every shard of its label, its own where the graph is built, the others in tasks that hold one graph and some thousands of
queries. A query's beam widens while its worst entry still passes the threshold, and a shard's beams all widen until an audit, exact
answers for some of its queries, is passed. Vectors travel as they were given; cosines are verified in double precision; links of a
pair of shards are counted for each vector, and a spanning forest of them goes on to connected components.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evseq.llm import common

LEAST = 0.98
SHARD = 8192
#: Queries that one task sends to a graph of another shard, about.
PIECE = 4096
#: Neighbours on upper layers, twice as many on the ground; first beam; queries audited in each pair of shards; recall asked.
M, BEAM, AUDIT, RECALL = 12, 32, 256, 0.9999
#: Entries of a beam that are expanded at once.
STRIDE = 4
#: Beam from which on a query is compared with all vectors of the shard instead.
WIDEST = 512
#: Vectors whose neighbours are chosen at once.
AT_ONCE = 256


class Graph:
    """layers[0] is the ground: an n x 2M table of neighbours, -1 where there are fewer. Upper layers hold fewer vectors each."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, levels: np.ndarray | None = None):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(self.v)
        if layers is not None:
            self.layers, self.levels = layers, levels
            return
        rng = np.random.Generator(np.random.PCG64(n))
        self.levels = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(M)).astype(int), 4)
        self.layers = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(int(self.levels.max(initial=0)) + 1)]
        self.inside = 0
        while self.inside < n:
            self.insert(self.inside, min(n, max(64, 2 * self.inside)))
        self.connect()

    def insert(self, start: int, end: int) -> None:
        """Vectors start to end at once: each looks for neighbours among those before, and among its fellows."""
        new = np.arange(start, end)
        fellows = self.v[new] @ self.v[new].T
        np.fill_diagonal(fellows, -2)
        for k, table in enumerate(self.layers):
            here = new[self.levels[new] >= k]
            if not len(here):
                continue
            ids, sims = self.search(self.v[here], BEAM, start, k) if start else (np.full((len(here), 1), -1), np.full((len(here), 1), -2, np.float32))
            near = np.where(self.levels[new][None, :] >= k, fellows[here - start], -2)
            top = min(2 * M, len(new))
            mates = np.argpartition(-near, top - 1, axis=1)[:, :top]
            ids = np.concatenate([ids, np.where(np.take_along_axis(near, mates, 1) > -2, mates + start, -1)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(near, mates, 1)], axis=1)
            picked, got = self.chosen(ids, sims, table.shape[1])
            table[here] = picked
            self.link(table, picked, got, here)
        self.inside = end

    def connect(self) -> None:
        """Vectors that no way on the ground leads to, as fuller neighbours dropped them, are hung on the nearest that is reached."""
        n = len(self.v)
        reached = np.zeros(n, bool)
        todo = np.array([int(np.argmax(self.levels))]) if n else np.zeros(0, np.int64)
        while n:
            while len(todo):
                reached[todo] = True
                near = np.unique(self.layers[0][todo])
                near = near[near >= 0]
                todo = near[~reached[near]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            have = np.flatnonzero(reached)
            sims = self.v[lost] @ self.v[have].T
            k = int(np.argmax(sims.max(axis=1)))
            x, y = int(have[np.argmax(sims[k])]), int(lost[k])
            if (self.layers[0][x] >= 0).all():
                self.layers[0] = np.pad(self.layers[0], ((0, 0), (0, 1)), constant_values=-1)
            self.layers[0][x, np.flatnonzero(self.layers[0][x] < 0)[0]] = y
            todo = np.array([y])

    def chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of candidates (-1: none) and their similarities the `most` to keep: first those nearer to the row's vector than
        to any kept before, then the nearest of the rest."""
        out = [self._chosen(ids[i : i + AT_ONCE], sims[i : i + AT_ONCE], most) for i in range(0, len(ids), AT_ONCE)]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, axis=1)
        ids = np.take_along_axis(ids, order, 1)
        sims = np.where(ids < 0, -2, np.take_along_axis(sims, order, 1)).astype(np.float32)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2  # the same candidate twice
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        real = sims > -2
        v = self.v[ids]
        between = v @ v.transpose(0, 2, 1)
        taken, closest = np.zeros(ids.shape, bool), np.full(ids.shape, -2, np.float32)
        for k in range(ids.shape[1]):
            taken[:, k] = real[:, k] & (sims[:, k] > closest[:, k])
            np.maximum(closest, np.where(taken[:, k, None], between[:, k], -2), out=closest)
        best = np.argsort(-np.where(real, sims + 4 * taken, -9), axis=1, kind="stable")[:, :most]
        ids, sims, real = (np.take_along_axis(x, best, 1) for x in (ids, sims, real))
        ids, sims = np.where(real, ids, -1).astype(np.int32), np.where(real, sims, -2)
        if ids.shape[1] < most:
            more = ((0, 0), (0, most - ids.shape[1]))
            ids, sims = np.pad(ids, more, constant_values=-1), np.pad(sims, more, constant_values=-2)
        return ids, sims

    def link(self, table: np.ndarray, picked: np.ndarray, sims: np.ndarray, of: np.ndarray) -> None:
        """Adds each row's vector to the neighbours of those it picked, of too many the nearest; where they are more than fit, some go."""
        y, s, x = picked.ravel(), sims.ravel(), np.repeat(of, picked.shape[1])
        keep = y >= 0
        y, s, x = y[keep], s[keep], x[keep]
        order = np.lexsort((-s, y))
        y, s, x = y[order], s[order], x[order]
        new = np.r_[True, y[1:] != y[:-1]] if len(y) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        row, place = np.cumsum(new) - 1, np.arange(len(y)) - np.repeat(first, np.diff(np.r_[first, len(y)]))
        keep = place < table.shape[1]
        at = y[first]
        ids, near = np.full((len(at), table.shape[1]), -1, np.int64), np.full((len(at), table.shape[1]), -2, np.float32)
        ids[row[keep], place[keep]], near[row[keep], place[keep]] = x[keep], s[keep]
        for i in range(0, len(at), AT_ONCE):
            part = at[i : i + AT_ONCE]
            have = table[part]
            sim = np.where(have >= 0, np.einsum("nd,nkd->nk", self.v[part], self.v[have]), -2).astype(np.float32)
            table[part] = self._chosen(np.concatenate([have, ids[i : i + AT_ONCE]], axis=1), np.concatenate([sim, near[i : i + AT_ONCE]], axis=1), table.shape[1])[0]

    def search(self, q: np.ndarray, beam: int, n: int | None = None, floor: int = 0, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beams of all queries, in lockstep: neighbours and similarities, best first, among the first n vectors. own: the
        queries' places, if they are vectors of this graph; they start there."""
        n = len(self.v) if n is None else n
        if own is not None:
            return self.walk(q, own[:, None], beam, n, self.layers[0])
        entry = int(np.argmax(self.levels[:n]))
        ids, sims = np.full((len(q), 1), entry, np.int64), None
        for k in range(int(self.levels[entry]), floor - 1, -1):
            ids, sims = self.walk(q, ids, beam if k == floor else 4, n, self.layers[k])
        if sims is None:  # no vector so far is on that layer
            return np.full((len(q), 1), -1, np.int64), np.full((len(q), 1), -2, np.float32)
        return ids, sims

    def walk(self, q: np.ndarray, ids: np.ndarray, beam: int, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)
        seen[rows, ids] = True
        sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", q, self.v[ids]), -2).astype(np.float32)
        done = ids < 0
        active = np.arange(len(q))
        while len(active):
            i, s, d = ids[active], sims[active], done[active]
            pick = np.argsort(np.where(d, 3, -s), axis=1, kind="stable")[:, :STRIDE]
            picked = np.where(np.take_along_axis(d, pick, 1), -1, np.take_along_axis(i, pick, 1))
            np.put_along_axis(d, pick, True, 1)
            near = np.where(picked[:, :, None] >= 0, table[picked], -1).reshape(len(active), -1)
            near = np.where(near < n, near, -1)
            fresh = near >= 0
            fresh &= ~seen[active[:, None], np.where(fresh, near, n)]
            seen[active[:, None], np.where(fresh, near, n)] = True
            near = np.where(fresh, near, -1)
            # The same neighbour by two ways: once.
            order = np.argsort(near, axis=1)
            near = np.take_along_axis(near, order, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            got = np.where(near >= 0, np.einsum("qd,qkd->qk", q[active], self.v[near]), -2).astype(np.float32)
            i, s, d = np.concatenate([i, near], 1), np.concatenate([s, got], 1), np.concatenate([d, near < 0], 1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            i, s, d = (np.take_along_axis(x, top, 1) for x in (i, s, d))
            if i.shape[1] > ids.shape[1]:
                more = ((0, 0), (0, i.shape[1] - ids.shape[1]))
                ids, sims, done = np.pad(ids, more, constant_values=-1), np.pad(sims, more, constant_values=-2), np.pad(done, more, constant_values=True)
            w = i.shape[1]
            ids[active, :w], sims[active, :w], done[active, :w] = i, s, d
            ids[active, w:], sims[active, w:], done[active, w:] = -1, -2, True
            active = active[~d.all(axis=1)]
        return ids, sims


def neighbours(graph: Graph, q: np.ndarray, least: float, own: bool) -> list[np.ndarray | None]:
    """For each query the graph's vectors with cosine `least` or more, or somewhat less; None where a beam of WIDEST, beyond which it
    is cheaper to compare with all, is too narrow. own: the queries are the graph's vectors, in order. All have length one.

    A beam that is full of what is looked for is doubled for its query alone. If the audit isn't passed then, all start with wider ones.
    """
    n, slack = len(graph.v), least - 1e-4
    sample = np.random.Generator(np.random.PCG64(len(q))).permutation(len(q))[:AUDIT]
    exact = q[sample] @ graph.v.T >= least - 1e-5  # well above what is looked for, so that rounding can't fail an audit
    total, first = int(exact.sum()), BEAM
    while True:
        found: list[np.ndarray | None] = [None] * len(q)
        beam, todo = first, np.arange(len(q))
        while len(todo) and beam < min(n, WIDEST):
            wide = []
            for part in np.array_split(todo, -(-len(todo) // 512)):
                ids, sims = graph.search(q[part], beam, own=part if own else None)
                full = (sims[:, -1] >= slack) if sims.shape[1] >= beam else np.zeros(len(part), bool)
                for x, i, s, f in zip(part, ids, sims, full, strict=True):
                    if f:
                        wide.append(x)
                    else:
                        found[x] = i[(i >= 0) & (s >= slack)]
            todo, beam = np.array(wide, np.int64), 2 * beam
        if own:
            symmetric(found)
        hit = sum(int(exact[k].sum() if found[x] is None else exact[k, found[x]].sum()) for k, x in enumerate(sample))
        if hit >= RECALL * total or first >= min(n, WIDEST):
            return found
        first *= 4


def symmetric(found: list[np.ndarray | None]) -> None:
    """What one finds finds it."""
    sizes = [0 if f is None else len(f) for f in found]
    if not sum(sizes):
        return
    x, y = np.repeat(np.arange(len(found)), sizes), np.concatenate([f for f in found if f is not None])
    here = np.array([f is not None for f in found])
    pairs = np.unique(np.concatenate([x * len(found) + y, (y * len(found) + x)[here[y]]]))
    cuts = np.searchsorted(pairs, np.arange(len(found) + 1) * len(found))
    for k in np.flatnonzero(here):
        found[k] = pairs[cuts[k] : cuts[k + 1]] % len(found)


def packed(graph: Graph, uid: np.ndarray, weight: np.ndarray, raw: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, uid=uid, weight=weight, raw=raw, levels=graph.levels, **{f"layer{k}": t for k, t in enumerate(graph.layers)})
    return out.getvalue()


def unpacked(data: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    z = np.load(io.BytesIO(data))
    layers = [z[f"layer{k}"] for k in range(sum(f.startswith("layer") for f in z.files))]
    exact = unit(z["raw"])
    return Graph(exact, layers, z["levels"]), z["uid"], z["weight"], exact


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors, along the last axis, at length one in double precision."""
    x = np.asarray(v, np.float64)
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix of the type given."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, digest (null for what links with nothing), embedding as given."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        digests, dims = [], []
        for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = None if v is None or label is None or any(c is None for c in v) else np.asarray(v, np.float64)
            usable = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if usable else None)
            dims.append(len(v) if usable else None)
        return {"vec_id": batch.column(0), "label": batch.column(2), "dim": dims, "digest": digests, "embedding": batch.column(1)}

    return common.map_rows(vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")), one, f"vec_id long, label long, dim int, digest binary, embedding {kind}")


def links_of(graph: Graph, exact: np.ndarray, uid: np.ndarray, weight: np.ndarray, queries: np.ndarray, mine: np.ndarray, least: float, own: bool) -> list[tuple]:
    """(uid, null, number of linked vectors) for each query that has links with the graph's classes, and (uid, other, 0) for a spanning
    forest of those links. own: the queries are the graph's own vectors, in order."""
    n, out, late = len(exact), [], {}
    part = np.arange(n if own else n + len(queries))  # of the forest: of vectors, then of queries

    def add(k: int, got: np.ndarray) -> None:
        me = k if own else n + k
        got = got[got != k] if own else got
        if len(got):
            out.append((int(mine[k]), None, int(weight[got].sum())))
            parts, first = np.unique(part[got], return_index=True)
            for p, y in zip(parts, got[first], strict=True):
                if p != part[me]:
                    part[part == p] = part[me]
                    out.append((int(mine[k]), int(uid[y]), 0))

    found = neighbours(graph, queries.astype(np.float32), least, own)
    wide = np.array([k for k, f in enumerate(found) if f is None], np.int64)
    for i in range(0, len(wide), 256):
        sims = queries[wide[i : i + 256]] @ exact.T
        for k, row in zip(wide[i : i + 256], sims, strict=True):
            got = np.flatnonzero(row >= least)
            add(int(k), got)
            if own:
                for y in got[[found[y] is not None for y in got]]:
                    late.setdefault(int(y), []).append(k)
    for k, got in enumerate(found):
        if got is not None:
            got = np.union1d(got, late[k]).astype(np.int64) if k in late else got
            add(k, got[exact[got] @ queries[k] >= least])
    return out


FOUND = "uid long, other long, links long"


def near_vectors(vectors: DataFrame, least: float = LEAST, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors link if labels and dimensions are equal and the cosine is `least` or more; null labels, and vectors that are null,
    empty, zero or hold null or non-finite components, link with nothing (n_links 0, component_id their own vec_id). Equal
    vectors link. Repeated rows count as vectors. Empty table: no rows.
    """
    common.prepare(vectors.sparkSession)
    c = clean(vectors)
    classes = c.where("digest is not null").groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    classes = common.checkpoint(classes.withColumn("uid", F.monotonically_increasing_id()))
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("digest"), "shards").cast("int"))
    schema = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("links", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        """A shard's graph, and what its own vectors find in it; the graph goes on if its label has further shards."""
        common.occupy(__name__)
        order = np.argsort(table["uid"].to_numpy())
        raw, uid, weight = vectors_of(table["embedding"])[order], table["uid"].to_numpy()[order], table["weight"].to_numpy()[order]
        exact = unit(raw)
        graph = Graph(exact)
        label, dim, number, many = (table[x][0].as_py() for x in ("label", "dim", "shard", "shards"))
        rows = [(*x, None, None, None, None) for x in links_of(graph, exact, uid, weight, exact, uid, least, True)]
        if many > 1:
            rows.append((None, None, None, label, dim, number, packed(graph, uid, weight, raw)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    built = dealt.select("label", "dim", "shard", "shards", "uid", "weight", "embedding").groupBy("label", "dim", "shard").applyInArrow(build, f"{FOUND}, label long, dim int, shard int, graph binary")
    built = common.checkpoint(built)

    # A unit of work: the graph of shard a, and the queries of other shards that fall into a slot.
    slots = F.ceil(F.col("shards") * shard / PIECE).cast("int")
    graphs = built.where("graph is not null").select("label", "dim", F.col("shard").alias("a"), "graph").join(shards, ["label", "dim"]).withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    queries = dealt.where("shards > 1").withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "digest"), slots).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("a <> shard")
    unit_of = ["label", "dim", "a", "slot"]

    def query(left: pa.Table, right: pa.Table) -> pa.Table:
        common.occupy(__name__)
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            graph, uid, weight, exact = unpacked(left["graph"][0].as_py())
            rows = links_of(graph, exact, uid, weight, unit(vectors_of(right["embedding"])), right["uid"].to_numpy(), least, False)
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({f.name: pa.array(x, f.type) for x, f in zip(columns, list(schema)[:3], strict=True)})

    across = graphs.select(*unit_of, "graph").groupBy(*unit_of).cogroup(queries.select(*unit_of, "uid", "embedding").groupBy(*unit_of)).applyInArrow(query, FOUND)
    found = common.checkpoint(built.where("uid is not null").select("uid", "other", "links").unionByName(across))
    counts = found.where("other is null").groupBy("uid").agg(F.sum("links").alias("links"))
    groups = common.components(found.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    named = classes.select("uid", "label", "dim", "digest", "vec_id", "weight").join(counts, "uid", "left").join(groups.withColumnRenamed("node", "uid"), "uid", "left")
    named = named.withColumn("component", F.coalesce("component", "uid"))
    low = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(low, "component").select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = c.select("vec_id", "label", "dim", "digest").join(named, ["label", "dim", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
