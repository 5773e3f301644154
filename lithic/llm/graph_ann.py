"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt to shards of at most about SHARD nodes by a hash. In a shard, nodes are inserted in rounds
that double: a greedy search from the medoid proposes neighbours, relaxed pruning (a neighbour is dropped if a kept
one is closer to it by the factor alpha) keeps diverse edges, and reverse edges are pruned the same way. A query
beam-searches every shard; the best of all shards are ranked by exact double-precision distance.

Defined results: vectors that are null, empty or all zero, or that hold a null or non-finite component take no
part; vectors of different dimensions are never compared. Equal vectors are one node; of a node only the k + 1 smallest ids can be
among a query's k nearest, so only these are kept (exact for the answer, not a cap on it). Repeated rows of one id
are one candidate. Fewer than k candidates: all of them. Ties go to the smaller id. An empty table, or one without
queries, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

SHARD = 4096
DEGREE = 32
BEAM = 64
ALPHA = 1.2
QUERY_BLOCK = 8192


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


class Graph:
    """A directed graph over the rows of x, -1 for no edge."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float32)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(squared(self.x, self.x.mean(axis=0)).argmin())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done = 1
        while done < n:
            fresh = order[done : done + max(8, min(done, 1024))]
            self.insert(fresh, order[:done] if done < 64 else None)
            done += len(fresh)

    @classmethod
    def stored(cls, x: np.ndarray, edges: np.ndarray, start: int) -> Graph:
        """A graph that was built before."""
        g = cls.__new__(cls)
        g.x, g.start, g.edges = np.ascontiguousarray(x, np.float32), start, edges.reshape(len(x), -1)
        return g

    def insert(self, fresh: np.ndarray, all_of: np.ndarray | None) -> None:
        if all_of is not None:  # the first few see each other
            pool = np.concatenate([all_of, fresh])
            seen = np.broadcast_to(pool, (len(fresh), len(pool)))
        else:
            seen = self.search(self.x[fresh], self.beam)[0]
        self.edges[fresh] = self.prune(fresh, seen)
        src = np.repeat(fresh, self.degree)
        dst = self.edges[fresh].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        self.edges[nodes] = self.prune(nodes, np.hstack([self.edges[nodes], wide]))

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """For each node up to degree of its candidates: nearest first, dropping those that a kept one covers."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        for at in range(0, len(nodes), 256):
            own, cand = nodes[at : at + 256], np.array(candidates[at : at + 256], np.int64)
            ordered = np.sort(cand, axis=1)
            repeat = np.zeros(cand.shape, bool)
            repeat[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            cand = ordered
            vectors = self.x[np.maximum(cand, 0)]
            dist = squared(vectors, self.x[own][:, None])
            dist[(cand < 0) | (cand == own[:, None]) | repeat] = np.inf
            rows = np.arange(len(own))
            for k in range(self.degree):
                best = dist.argmin(axis=1)
                ok = np.isfinite(dist[rows, best])
                if not ok.any():
                    break
                pick = cand[rows, best]
                out[at : at + 256][ok, k] = pick[ok]
                to_pick = squared(vectors, self.x[pick][:, None])
                dist[self.alpha**2 * to_pick <= dist] = np.inf
                dist[rows, best] = np.inf
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of the beam for each row of q, nearest first; -1 where it found fewer."""
        nodes_out, dist_out = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), np.inf, np.float32)
        for at in range(0, len(q), 256):
            part = np.ascontiguousarray(q[at : at + 256], np.float32)
            m = len(part)
            rows = np.arange(m)
            ids = np.full((m, beam), -1, np.int64)
            dist = np.full((m, beam), np.inf, np.float32)
            open_ = np.zeros((m, beam), bool)
            seen = np.zeros((m, len(self.x)), bool)
            ids[:, 0], dist[:, 0], open_[:, 0], seen[:, self.start] = self.start, squared(part, self.x[self.start]), True, True
            while True:
                waiting = np.where(open_, dist, np.inf)
                pick = waiting.argmin(axis=1)
                active = np.isfinite(waiting[rows, pick])
                if not active.any():
                    break
                live = rows[active]
                open_[live, pick[active]] = False
                near = self.edges[ids[live, pick[active]]].astype(np.int64)
                fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
                r, c = np.nonzero(fresh)
                seen[live[r], near[r, c]] = True
                d = np.full(near.shape, np.inf, np.float32)
                d[r, c] = squared(self.x[near[r, c]], part[live[r]])
                all_d = np.hstack([dist[live], d])
                keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
                take = lambda a, k=keep: np.take_along_axis(a, k, axis=1)
                dist[live] = take(all_d)
                ids[live] = take(np.hstack([ids[live], np.where(fresh, near, -1)]))
                open_[live] = take(np.hstack([open_[live], fresh]))
            order = np.argsort(dist, axis=1)
            nodes_out[at : at + m], dist_out[at : at + m] = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        return nodes_out, dist_out


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def search(items: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest. items and queries: id, v (array<double>), usable rows only.

    A shard's graph is built once in one task from at most about `shard` nodes and stored; a task searches one shard for
    one block of at most about QUERY_BLOCK queries.
    """
    spark = items.sparkSession
    # One node for each distinct vector and dimension; its k + 1 smallest ids stand for all of them.
    named = items.groupBy("id", "v").agg(F.count(F.lit(1)).alias("_n")).withColumn("node", F.xxhash64("v"))
    rank = Window.partitionBy("node", "v").orderBy("id")
    kept = cut(named.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k + 1).select("node", "v", "id"))
    nodes = kept.groupBy("node", "v").agg(F.min("id").alias("_least"))
    total = nodes.count()
    asked = cut(queries.dropDuplicates(["id", "v"]))
    n_queries = asked.count()
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(1, -(-total // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.hash("node", F.lit(7)), F.lit(shards)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, own in rows.groupby(rows["v"].map(len)):
            own = own.sort_values("node")
            x = matrix(own["v"])
            g = Graph(x) if len(own) > beam else None
            out.append((rows["shard"].iloc[0], dim, own["node"].to_numpy(np.int64).tobytes(), x.tobytes(), g.edges.tobytes() if g else None, g.start if g else 0))
        return pd.DataFrame(out, columns=["shard", "dim", "nodes", "x", "edges", "start"])

    graphs = cut(dealt.select("shard", "node", "v").groupBy("shard").applyInPandas(build, "shard int, dim int, nodes binary, x binary, edges binary, start int"))
    # Each block of queries meets each shard: a stated query set against all rows, in blocks.
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    ask = asked.withColumn("block", F.pmod(F.hash("id", F.lit(9)), F.lit(blocks)))
    every = ask.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "block", F.col("id").alias("query_id"), F.col("v").alias("qv"))
    offered = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = 2 * k + 2

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, qs in right.groupby(right["qv"].map(len)):
            stored = left[left["dim"] == dim]
            if not len(stored):
                continue
            row = stored.iloc[0]
            nodes, x = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["x"], np.float64).reshape(-1, dim)
            q = matrix(qs["qv"])
            if row["edges"] is None:
                found = np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
            else:
                found = Graph.stored(x, np.frombuffer(row["edges"], np.int32), int(row["start"])).search(q, max(beam, wanted))[0]
            for i in range(0, len(q), 256):
                ids = found[i : i + 256]
                d = np.sqrt(((x[np.maximum(ids, 0)] - q[i : i + 256][:, None]) ** 2).sum(axis=-1))
                d[ids < 0] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :wanted]
                r = np.repeat(np.arange(len(ids)), best.shape[1])
                c = best.ravel()
                ok = np.isfinite(d[r, c])
                out.append(pd.DataFrame({"query_id": qs["query_id"].to_numpy()[i + r[ok]], "node": nodes[ids[r[ok], c[ok]]]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "node": np.zeros(0, np.int64)})

    near = offered.groupBy("shard", "block").cogroup(every.groupBy("shard", "block")).applyInPandas(run, "query_id long, node long")
    # The exact check: distances again in the JVM, on the original vectors, by one formula for all.
    scored = near.join(kept, "node").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    square = F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    scored = scored.where("id <> query_id AND size(v) = size(qv)").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min(F.sqrt(square)).alias("score"))
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The contract's query set: rows whose id is divisible by `every`, against all rows."""
    v = F.col(vector).cast("array<double>")
    items = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return search(items, items.where(F.col("id") % every == 0), k)
