"""Approximate nearest neighbours by hierarchical navigable small-world graphs.

Nearness is the inner product in double precision. Equal vectors are one node.
Nodes are dealt by hash into shards of at most about ``SHARD`` (one index, bounded,
however large the table); every row is indexed.

Graph. A node's top layer falls off geometrically, and nodes are numbered by
falling top layer, so the members of a layer are its first nodes and a layer is
one flat array of neighbours, -1 where there are fewer. Nodes are inserted in
that order, block by block: a block's nodes enter at the top, walk greedily
down, search the layer with a beam among the nodes inserted so far (and among
their own block, so that near copies that come together are linked), keep
diverse near ones (a candidate is kept if it is nearer to the node than to any
kept one), and are linked back; a node with too many links keeps diverse ones.
For inner products nodes get one more component that gives all of a shard the
same norm, so the nearest by angle have the largest products.

A block of queries enters at the top, walks greedily down to layer 0 and there
follows a beam of ``BEAM`` nodes until all are expanded; all queries of a block
advance together. Every shard answers with its best, and a ranking over shards
keeps the k best with ties to the smaller id.

Of equal vectors only the k + 1 smallest ids can be among the k nearest of
anything (one may be the query's own), so a node carries those.

Vectors that are null, empty, zero or hold a null or non-finite component take
no part, nor do rows with a null id. Vectors of different lengths never meet.
A query has fewer than k results if there are fewer candidates. Query rows that
are repeated are one query; different vectors under one id are one query each,
with ranks of their own, none of which finds a row of that id. Candidates are
rows: those with equal ids are separate candidates. Only the two named columns
are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .session import cut

SHARD = 1 << 16
#: Links of a node (twice as many places: its own and those back), beams of insertion and of search, nodes of a beam expanded at once.
LINKS, BUILD_BEAM, BEAM, AT_ONCE = 16, 128, 112, 4
#: Queries that a task searches one shard for, those advancing together, and nodes inserted together.
QUERIES, BLOCK, INSERTED = 8192, 128, 256


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def diverse(space: np.ndarray, node: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (nearest first, -1 for none) up to ``most`` that are nearer to it than to a kept one."""
    points = space[near]
    to_node = np.einsum("bcd,bd->bc", points, space[node])
    between = points @ points.transpose(0, 2, 1)
    kept = np.zeros(near.shape, bool)
    worst = np.full(near.shape, -np.inf, space.dtype)
    full = np.zeros(len(node), np.int64)
    for c in range(near.shape[1]):
        take = (near[:, c] >= 0) & (full < most) & (to_node[:, c] > worst[:, c])
        kept[:, c] = take
        full += take
        worst = np.where(take[:, None], np.maximum(worst, between[:, c, :]), worst)
    # free places go to the nearest of the others
    order = np.argsort(~kept, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, axis=1)


def nearest_first(space: np.ndarray, node: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Each node's distinct candidates (-1 for none) in order of nearness."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    near = np.where(candidates >= 0, np.einsum("bcd,bd->bc", space[candidates], space[node]), -np.inf)
    return np.take_along_axis(candidates, np.argsort(-near, axis=1, kind="stable"), axis=1)


def walk(space: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Each query's node after greedy steps in a layer."""
    rows = np.arange(len(queries))
    best = np.einsum("qd,qd->q", space[now], queries)
    moving = rows
    while len(moving):
        around = neighbours[now[moving]]
        worth = np.where(around >= 0, np.einsum("qcd,qd->qc", space[around], queries[moving]), -np.inf)
        pick = worth.argmax(axis=1)
        top = worth[np.arange(len(moving)), pick]
        better = top > best[moving]
        moving, around, pick, top = moving[better], around[better], pick[better], top[better]
        now[moving], best[moving] = around[np.arange(len(moving)), pick], top
    return now


def beam_search(space: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, now: np.ndarray, width: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(nodes nearest first, their products, nodes looked at): a beam of each query in one layer, from one node each."""
    n, count = len(neighbours), len(queries)
    rows = np.arange(count)
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # where -1 points
    beam, worth, open_ = np.full((count, width), -1, np.int64), np.full((count, width), -np.inf), np.zeros((count, width), bool)
    beam[:, 0], worth[:, 0], open_[:, 0] = now, np.einsum("qd,qd->q", space[now], queries), True
    seen[rows, now] = True
    active, looked = rows, count
    while len(active):
        b, w, o, q = beam[active], worth[active], open_[active], np.arange(len(active))[:, None]
        rank = np.where(o, w, -np.inf)
        pick = np.argpartition(-rank, min(at_once, width - 1), axis=1)[:, :at_once]
        chosen = np.take_along_axis(o, pick, axis=1)
        o[q, pick] = False
        around = neighbours[np.where(chosen, b[q, pick], 0)].astype(np.int64)
        around = np.where(chosen[:, :, None], around, -1).reshape(len(active), -1)
        around[seen[active[:, None], around]] = -1
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        around = around[:, (around >= 0).argmax(axis=1).min() :]  # columns that are empty everywhere come first
        seen[active[:, None], around] = True
        seen[active, n] = True
        at, place = np.nonzero(around >= 0)
        looked += len(at)
        fresh = np.full(around.shape, -np.inf)
        fresh[at, place] = np.einsum("cd,cd->c", space[around[at, place]], queries[active[at]])
        all_nodes, all_worth, all_open = np.hstack((b, around)), np.hstack((w, fresh)), np.hstack((o, around >= 0))
        keep = np.argpartition(-all_worth, width - 1, axis=1)[:, :width]
        b, w = np.take_along_axis(all_nodes, keep, axis=1), np.take_along_axis(all_worth, keep, axis=1)
        o = np.take_along_axis(all_open, keep, axis=1) & np.isfinite(w)
        beam[active], worth[active], open_[active] = b, w, o
        active = active[o.any(axis=1)]
    order = np.argsort(-worth, axis=1, kind="stable")
    worth = np.take_along_axis(worth, order, axis=1)
    return np.where(np.isfinite(worth), np.take_along_axis(beam, order, axis=1), -1), worth, looked


class Graph:
    """Layers of one shard, from 0 up: a flat neighbour array each, over the first nodes."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None) -> None:
        """Without layers, ``vectors`` are numbered as ``order`` says and a graph is built over them."""
        self.looked = 0
        if layers is None:
            n = len(vectors)
            chance = (K.mix(np.arange(n, dtype=np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
            top = np.minimum((-np.log(chance + 1e-18) / math.log(LINKS)).astype(int), 8)
            self.order = np.argsort(-top, kind="stable")
            vectors, top = vectors[self.order], top[self.order]
            norms = np.einsum("ij,ij->i", vectors, vectors)
            space = np.hstack((vectors, np.sqrt(np.maximum(0, norms.max() - norms))[:, None])).astype(np.float32)
            space /= max(float(np.sqrt(norms.max())), 1e-30)
            layers = []
            for level in range(int(top[0]), -1, -1):
                layers.insert(0, self._layer(space, int((top >= level).sum()), layers))
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def _layer(space: np.ndarray, members: int, above: list[np.ndarray]) -> np.ndarray:
        """A layer's neighbours, its members inserted block by block; ``above`` are the layers over it, from low to high."""
        out, done = np.full((members, 2 * LINKS), -1, np.int32), 0
        while done < members:
            to = min(members, done + min(INSERTED, max(1, done)))
            new = np.arange(done, to)
            found = np.full((len(new), 1), -1, np.int64)
            if done:
                now = np.zeros(len(new), np.int64)
                for layer in above[::-1]:
                    now = walk(space, layer, space[new], now)
                now = np.where(now < done, now, 0)
                found, _, _ = beam_search(space, out[:done], space[new], now, BUILD_BEAM)
            peers = space[new] @ space[new].T
            np.fill_diagonal(peers, -np.inf)
            near = min(LINKS, len(new) - 1)
            if near:
                found = np.hstack((found, done + np.argpartition(-peers, near - 1, axis=1)[:, :near]))
            own = diverse(space, new, nearest_first(space, new, found), LINKS)
            out[new, : own.shape[1]] = own
            # links back: to the end of the other node's places, or, where they are used up, diverse ones of all
            source, target = np.repeat(new, own.shape[1]), own.ravel()
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            nodes, first, times = np.unique(target, return_index=True, return_counts=True)
            more = np.full((len(nodes), times.max() if len(nodes) else 0), -1, np.int64)
            more[np.repeat(np.arange(len(nodes)), times), np.arange(len(source)) - np.repeat(first, times)] = source
            for a in range(0, len(nodes), INSERTED):
                some = nodes[a : a + INSERTED]
                joined = nearest_first(space, some, np.hstack((out[some].astype(np.int64), more[a : a + INSERTED])))
                joined = joined[:, : max(2 * LINKS, int((joined >= 0).sum(axis=1).max()))]
                crowded = (joined >= 0).sum(axis=1) > 2 * LINKS
                out[some[~crowded]] = joined[~crowded, : 2 * LINKS]
                if crowded.any():
                    out[some[crowded]] = diverse(space, some[crowded], joined[crowded], 2 * LINKS)
            done = to
        return out

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, products) of the k best of each query, -1 where there are fewer."""
        now = np.zeros(len(queries), np.int64)
        for layer in self.layers[:0:-1]:
            now = walk(self.vectors, layer, queries, now)
        nodes, worth, looked = beam_search(self.vectors, self.layers[0], queries, now, max(BEAM, k))
        self.looked += looked
        return nodes[:, :k], worth[:, :k]


INDEX = "dim int, shard int, ids binary, begin binary, vectors binary, layers array<binary>"


def _index(table: pa.Table) -> pa.Table:
    flat = table.column("vector").combine_chunks()
    vectors = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)
    graph, lists = Graph(vectors), table.column("ids").to_pylist()
    begin = np.cumsum([0, *[len(lists[i]) for i in graph.order]])
    one = lambda x, kind: pa.array([x], kind)
    return pa.table({
        "dim": table.column("dim")[:1], "shard": table.column("shard")[:1],
        "ids": one(np.array([x for i in graph.order for x in lists[i]], np.int64).tobytes(), pa.binary()), "begin": one(begin.astype(np.int64).tobytes(), pa.binary()),
        "vectors": one(graph.vectors.tobytes(), pa.binary()), "layers": one([x.tobytes() for x in graph.layers], pa.list_(pa.binary())),
    })


FOUND = "query long, query_id long, vec_id long, score double"


def _search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(left.num_rows if right.num_rows else 0):
            dim = left.column("dim")[i].as_py()
            read = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
            ids, begin = read(left.column("ids")[i], np.int64), read(left.column("begin")[i], np.int64)
            layers = [read(x, np.int32).reshape(-1, 2 * LINKS) for x in left.column("layers")[i]]
            graph = Graph(read(left.column("vectors")[i], np.float64).reshape(-1, dim), layers)
            number, asked = right.column("query").to_numpy(), right.column("query_id").to_numpy()
            queries = right.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1).astype(np.float64)
            for a in range(0, len(asked), BLOCK):
                nodes, products = graph.search(queries[a : a + BLOCK], k + 1)
                query, rank = np.nonzero(nodes >= 0)
                node = nodes[query, rank]
                size = begin[node + 1] - begin[node]
                at = np.repeat(begin[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
                query, score = np.repeat(query, size) + a, np.repeat(products[query, rank], size)
                fine = ids[at] != asked[query]
                # a shard's own k best of each query, ties to the smaller id
                query, found, score = query[fine], ids[at][fine], score[fine]
                order = np.lexsort((found, -score, query))
                query, found, score = query[order], found[order], score[order]
                best = np.arange(len(query)) - np.searchsorted(query, query) < k
                for x, y in zip(out, (number[query], asked[query], found, score), strict=True):
                    x.append(y[best])
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["query", "query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query row, all rows but those of its id."""
    double = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    smallest = Window.partitionBy("vector").orderBy("id")
    nodes = double(vectors).withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    nodes = nodes.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vector"))
    nodes = cut(nodes)
    counts = nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(counts), "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    index = cut(dealt.groupBy("dim", "shard").applyInArrow(_index, INDEX))
    asked = double(queries).distinct().select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), "vector", F.size("vector").alias("dim"))
    asked = cut(asked)
    parts = max(1, math.ceil(asked.count() / QUERIES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
    to_all = asked.join(F.broadcast(counts), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["dim", "shard", "part"]
    found = copies.groupBy(*keys).cogroup(to_all.select("query", "query_id", "vector", *keys).groupBy(*keys)).applyInArrow(_search(k), FOUND)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
