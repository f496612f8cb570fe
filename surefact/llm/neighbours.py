"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of vectors.

Equal vectors are one node that keeps its `k + 1` smallest ids, so that copies neither crowd a graph nor hide others.
Nodes are dealt to shards of about `SHARD` by hash. A graph grows by batches: a greedy beam search from the
medoid proposes neighbours, pruning keeps a near one and drops those that it is `alpha` times nearer to, and
reverse edges are pruned likewise. Queries search every shard by beam, in blocks of about `BLOCK_BYTES`, several times a graph's
size: a graph is sent once for each block, so most of what moves are the queries. What is found is measured again in double
precision on the original vectors, which a graph holds as they are given (single precision stays single).

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part;
only vectors of one length are compared; a (id, vector) row counts once; ties go to the smaller id; a null id
takes no part; of a query id with several vectors the smallest vector asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import cut

SHARD, BLOCK_BYTES = 8192, 16 << 20
DEGREE, BEAM_BUILD, BEAM_SEARCH, ALPHA, EXPAND = 32, 48, 96, 1.2, 4


class Graph:
    """Nodes x (float32 rows), out-edges `out` (-1: none) and the medoid as entry."""

    def __init__(self, x: np.ndarray, out: np.ndarray | None = None, entry: int = 0):
        self.x, self.norm = x, (x * x).sum(axis=1)
        self.out = np.full((len(x), DEGREE), -1, dtype=np.int32) if out is None else out
        self.entry = entry

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances from each row of q to its row of nodes; infinite where there is none."""
        at = np.maximum(nodes, 0)
        d = self.norm[at] - 2 * np.einsum("bnd,bd->bn", self.x[at], q) + (q * q).sum(axis=1)[:, None]
        return np.where(nodes >= 0, np.maximum(d, 0), np.inf).astype(np.float32)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query when every node in it has been expanded: nodes (-1: none) and squared distances, nearest first."""
        n = len(q)
        nodes, seen = np.full((n, beam), -1, dtype=np.int32), np.zeros((n, beam), dtype=bool)
        nodes[:, 0] = self.entry
        dist = np.full((n, beam), np.inf, dtype=np.float32)
        dist[:, :1] = self.distances(q, nodes[:, :1])
        live = np.arange(n)
        while len(live):
            now, known, far = nodes[live], seen[live], dist[live]
            fresh = ~known & (now >= 0)
            go = fresh.any(axis=1)
            live, now, known, far, fresh = live[go], now[go], known[go], far[go], fresh[go]
            if not len(live):
                break
            rank = np.cumsum(fresh, axis=1)
            pick = fresh & (rank <= EXPAND)
            known |= pick
            row, col = np.nonzero(pick)
            wide = np.full((len(live), EXPAND), -1, dtype=np.int32)
            wide[row, rank[row, col] - 1] = now[row, col]
            near = np.where(wide[:, :, None] >= 0, self.out[np.maximum(wide, 0)], -1).reshape(len(live), -1)
            # Each node once: sorted, repeats and those in the beam are dropped.
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            both = np.concatenate([now, near], axis=1)
            order = np.argsort(both, axis=1, kind="stable")
            along = np.take_along_axis(both, order, axis=1)
            twice = np.zeros_like(along, dtype=bool)
            twice[:, 1:] = along[:, 1:] == along[:, :-1]
            drop = np.zeros_like(twice)
            np.put_along_axis(drop, order, twice, axis=1)
            near[drop[:, beam:]] = -1
            d = np.concatenate([far, self.distances(q[live], near)], axis=1)
            best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, axis=1), axis=1, kind="stable"), axis=1)
            both[:, beam:] = near
            nodes[live], dist[live] = np.take_along_axis(both, best, axis=1), np.take_along_axis(d, best, axis=1)
            seen[live] = np.take_along_axis(np.concatenate([known, np.zeros(near.shape, dtype=bool)], axis=1), best, axis=1)
            seen[live] |= nodes[live] < 0
        return nodes, dist

    def prune(self, at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Diverse out-edges for nodes `at` from candidate rows: nearest first, dropping what a kept one is `ALPHA` times nearer to."""
        nodes = np.where(nodes == at[:, None], -1, nodes)
        d = self.distances(self.x[at], nodes)
        order = np.argsort(d, axis=1, kind="stable")
        nodes, d = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(d, order, axis=1)
        live = nodes >= 0
        out = np.full((len(at), DEGREE), -1, dtype=np.int32)
        rows = np.arange(len(at))
        points, norms = self.x[np.maximum(nodes, 0)], self.norm[np.maximum(nodes, 0)]
        for k in range(DEGREE):
            if not live.any():
                break
            first = live.argmax(axis=1)
            some = live[rows, first]
            out[some, k] = nodes[rows, first][some]
            p = points[rows, first]
            between = norms + norms[rows, first][:, None] - 2 * np.einsum("bnd,bd->bn", points, p)
            live &= ~(some[:, None] & (ALPHA * ALPHA * between <= d))
            live[rows, first] = False
        return out

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        g = cls(x)
        n = len(x)
        g.entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(7).permutation(n)
        order = np.append(g.entry, order[order != g.entry]).astype(np.int32)
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(512, done))]
            found, _ = g.search(x[batch], BEAM_BUILD)
            g.out[batch] = g.prune(batch, found)
            # Reverse edges, by target.
            col = g.out[batch]
            row, k = np.nonzero(col >= 0)
            target, source = col[row, k], batch[row]
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            goal, first, count = np.unique(target, return_index=True, return_counts=True)
            for lo in range(0, len(goal), 512):
                some, f, c = goal[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
                more = np.full((len(some), int(c.max())), -1, dtype=np.int32)
                who = np.repeat(np.arange(len(some)), c)
                more[who, np.arange(len(who)) - np.repeat(np.cumsum(c) - c, c)] = source[np.repeat(f - np.cumsum(c) + c, c) + np.arange(len(who))]
                wide = np.concatenate([g.out[some], more], axis=1)
                full = (wide >= 0).sum(axis=1) > DEGREE
                if full.any():
                    g.out[some[full]] = g.prune(some[full], wide[full])
                if (~full).any():
                    w = wide[~full]
                    g.out[some[~full]] = np.take_along_axis(w, np.argsort(w < 0, axis=1, kind="stable"), axis=1)[:, :DEGREE]
            done += len(batch)
        return g


def valid(v: Column) -> Column:
    """A vector that takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def precision(vector: ArrayType) -> type:
    """The numpy type that holds such vectors as they are."""
    return np.float32 if isinstance(vector.elementType, FloatType) else np.float64


def graphs(nodes: DataFrame, shards: int) -> DataFrame:
    """A row (shard, dim, x, out, entry, ids) for each shard of rows (h, v, ids); x are the vectors in their own precision."""
    own = precision(nodes.schema["v"].dataType)

    def build(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(own).reshape(len(v), -1)
        g = Graph.build(x.astype(np.float32))
        return pa.table(
            {"shard": t.column("shard").slice(0, 1), "dim": pa.array([x.shape[1]], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()), "out": pa.array([g.out.tobytes()], pa.binary()),
             "entry": pa.array([g.entry], pa.int32()), "ids": pa.array([t.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))}
        )

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(shards)).cast("int")).withColumn("shard", F.col("shard") * 65536 + F.size("v"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, dim int, x binary, out binary, entry int, ids array<array<long>>")


def blocks_of(queries: DataFrame, n: int) -> DataFrame:
    """Rows (block, dim, q, qid), the queries dealt to n blocks."""

    def gather(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        q = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table({"block": t.column("block").slice(0, 1), "dim": t.column("dim").slice(0, 1), "q": pa.array([q.tobytes()], pa.binary()), "qid": pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64()))})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("dim", F.size("v"))
    return dealt.groupBy("block", "dim").applyInArrow(gather, "block int, dim int, q binary, qid array<long>")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows of (vec_id, embedding), Euclidean, smallest first."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    rows = rows.withColumn("h", F.xxhash64("v"))
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id", "h", "v"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = cut(kept.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = cut(rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")))
    n = nodes.count()
    held = asked.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    built = cut(graphs(nodes, max(1, round(n / shard))))
    n_blocks = max(1, -(-8 * held // BLOCK_BYTES))
    own = precision(nodes.schema["v"].dataType)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    packed = blocks_of(asked, n_blocks)
    # Every block meets every shard of its length, by keys: both sides are dealt out, none is broadcast.
    names = built.select("shard", "dim").groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    left = packed.join(names, "dim").withColumn("shard", F.explode("shards")).select("block", "shard", "q", "qid")
    pairs = left.join(built.withColumn("block", every), ["block", "shard"])

    def ask(t: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for r in t.to_pylist():
            x = np.frombuffer(r["x"], dtype=own).reshape(-1, r["dim"])
            g = Graph(x.astype(np.float32, copy=False), np.frombuffer(r["out"], dtype=np.int32).reshape(len(x), -1), r["entry"])
            q, qid, ids = np.frombuffer(r["q"]).reshape(-1, r["dim"]), r["qid"], r["ids"]
            for lo in range(0, len(q), 512):
                found, _ = g.search(q[lo : lo + 512].astype(np.float32), max(BEAM_SEARCH, 2 * k))
                for query, me, near in zip(q[lo : lo + 512], qid[lo : lo + 512], found, strict=True):
                    near = near[near >= 0]
                    d = np.sqrt(((x[near].astype(np.float64) - query) ** 2).sum(axis=1))
                    who = [ids[i] for i in near.tolist()]
                    vec = np.array([v for w in who for v in w], dtype=np.int64)
                    far = np.repeat(d, [len(w) for w in who])
                    far, vec = far[vec != me], vec[vec != me]
                    best = np.lexsort((vec, far))[:k]
                    out.append((np.full(len(best), me), vec[best], far[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = pairs.groupBy("block", "shard").applyInArrow(ask, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
