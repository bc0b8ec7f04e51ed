"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are grown on the driver from a bounded sample; each node splits its rows at the median along
the difference of two of them. All rows are routed to a leaf in every tree. Inner products become
distances by one more component, which gives all rows the same norm. A query searches all trees
through one priority queue, by the least margin on the way to a node, until the leaves taken hold a
given share of the sample. That share, and the number of trees, are what queries from the sample
need for a recall of ``TARGET`` at the fewest products: little on clustered rows, much on rows that
lie evenly in all directions.

Leaves hold about ``LEAF`` rows (more only if the table has over ``SAMPLE`` * LEAF / ``LEAST`` rows).
They are dealt in cells, subtrees of some thousand rows, so that a query's vector is sent once for
each cell with the list of its leaves there; exact products are of a leaf's rows with the queries that
take it, and each query's best are kept.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_duplicates import _groups
from .vectors import by_length, matrix, usable_vectors
from .workspace import Workspace

#: Rows that the trees are grown from: those of the smallest seeded hash of their id.
SAMPLE = 65_536
TREES, LEAF, LEAST, TARGET = (1, 2, 4, 8, 16), 32, 8, 0.93
CELL, BLOCK_ROWS, BLOCK_QUERIES, TASK_QUERIES = 4096, 8192, 1024, 400
#: Rows of the sample that ask for their neighbours in it, to tell the share that is needed.
TRIED = 100
HELD = 1 << 18  # candidates gathered before each query's best are taken


@dataclass
class Forest:
    """Full binary trees of one depth, numbered as in a heap; leaf k of tree t is t * leaves + k."""

    normals: np.ndarray  # tree, node, component
    offsets: np.ndarray  # tree, node
    sizes: np.ndarray  # tree, leaf: share of the sample
    norm: float

    def raise_rows(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0))[:, None]]).astype(np.float32)

    def first(self, trees: int) -> "Forest":
        return Forest(self.normals[:trees], self.offsets[:trees], self.sizes[:trees], self.norm)

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x, (trees, inner, _) = self.raise_rows(v), self.normals.shape
        out = np.zeros((len(v), trees), np.int64)
        for t in range(trees):
            node = np.zeros(len(v), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + ((x * self.normals[t, node]).sum(1) > self.offsets[t, node])
            out[:, t] = node - inner + t * (inner + 1)
        return out

    def margins(self, q: np.ndarray) -> np.ndarray:
        """For each query, tree and node: how far the query lies on the right of the node's split."""
        trees, inner, d = self.normals.shape
        norms = np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        x = np.hstack([q / norms * self.norm, np.zeros((len(q), 1))]).astype(np.float32)
        return (x @ self.normals.reshape(-1, d).T).reshape(len(q), trees, inner) - self.offsets[None]

    def search(self, q: np.ndarray, share: float) -> list[list[int]]:
        """For each query the leaves to look into, best first, until they hold ``share`` of the sample (counted in each tree)."""
        trees, inner, _ = self.normals.shape
        sizes, out = self.sizes.tolist(), []
        for m in self.margins(q).tolist():
            queue, got, found = [(-float("inf"), t, 0) for t in range(trees)], 0.0, []
            while queue and got < share:
                p, t, node = heapq.heappop(queue)
                if node >= inner:
                    found.append(t * (inner + 1) + node - inner)
                    got += sizes[t][node - inner]
                    continue
                side = m[t][node]
                heapq.heappush(queue, (max(p, side), t, 2 * node + 1))
                heapq.heappush(queue, (max(p, -side), t, 2 * node + 2))
            out.append(found)
        return out

    def needed(self, q: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """For a query and rows' ``leaves`` (row, tree): the share after which the search has met each row."""
        trees, inner, _ = self.normals.shape
        m, p = self.margins(q[None])[0], np.full((trees, 1), -np.inf, np.float32)
        first = 0
        while first < inner:  # a leaf's priority is the largest margin on the way to it
            side = m[:, first : first + p.shape[1]]
            p = np.stack([np.maximum(p, side), np.maximum(p, -side)], 2).reshape(trees, -1)
            first = 2 * first + 1
        order = np.argsort(p.ravel(), kind="stable")
        after = np.empty(len(order))
        after[order] = np.cumsum(self.sizes.ravel()[order])
        return after[leaves].min(1)


def grow(v: np.ndarray, norm: float, trees: int, depth: int, seed: int = 5) -> Forest:
    """Trees of 2**depth leaves, a level of all nodes at a time."""
    inner, r = 2**depth - 1, np.random.default_rng(seed)
    forest = Forest(np.zeros((trees, inner, v.shape[1] + 1), np.float32), np.zeros((trees, inner), np.float32), np.ones((trees, inner + 1)), norm)
    x = forest.raise_rows(v)
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for level in range(depth if len(x) else 0):
            first, width = 2**level - 1, 2**level
            # two rows of each node at random: the first of a shuffled order, and one of the rest
            shuffled = r.permutation(len(x))
            order = shuffled[np.argsort(node[shuffled], kind="stable")]
            count = np.bincount(node - first, minlength=width)
            start = np.cumsum(count) - count
            some = np.flatnonzero(count > 1)
            a, b = order[start[some]], order[start[some] + 1 + r.integers(0, count[some] - 1)]
            w = x[a] - x[b]
            w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-30)
            forest.normals[t, first + some] = w
            along = (x * forest.normals[t, node]).sum(1)
            ranked = np.lexsort((along, node))
            forest.offsets[t, first + some] = (along[ranked[start[some] + (count[some] - 1) // 2]] + along[ranked[start[some] + count[some] // 2]]) / 2
            node = 2 * node + 1 + (along > forest.offsets[t, node])
        forest.sizes[t] = np.bincount(node - inner, minlength=inner + 1) / max(len(x), 1)
    return forest


def fit(v: np.ndarray, norm: float, rows: int, k: int, trees: tuple[int, ...] = TREES, leaf: int = LEAF, target: float = TARGET) -> tuple[Forest, float]:
    """A forest for a table of so many rows from a sample of it, and the share to search."""
    most = min(rows / leaf, len(v) / min(leaf, LEAST))
    forest = grow(v, norm, max(trees), max(0, int(np.ceil(np.log2(max(most, 1))))))
    asked = np.arange(0, len(v), max(1, len(v) // TRIED))[:TRIED]
    if len(v) < 2 or target >= 1:
        return forest.first(1), 2.0  # all leaves of one tree
    leaves, near = forest.leaves(v), []
    for i in asked:
        s = v @ v[i]
        s[i] = -np.inf
        near.append(np.argpartition(-s, min(k, len(v) - 1) - 1)[: min(k, len(v) - 1)])
    best = None
    for n in trees:
        own = forest.first(n)
        need = np.sort(np.concatenate([own.needed(v[i], leaves[at][:, :n]) for i, at in zip(asked, near)]))
        share = float(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])
        if best is None or share < best[1]:
            best = own, share
    return best


class _Best:
    """The k best rows of each query so far, ties to the smaller id, kept as arrays sorted by query."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def floor(self, queries: np.ndarray) -> np.ndarray:
        """The score that a row must reach for each query: that of its k-th best."""
        last = np.searchsorted(self.query, queries, "right") - 1
        full = last - np.searchsorted(self.query, queries, "left") + 1 == self.k
        out = np.full(len(queries), -np.inf)
        out[full] = self.score[last[full]]
        return out

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        # a row met in two trees has the same score: its repeats stand side by side
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
        query, ids, score = query[new], ids[new], score[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        keep = rank < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]


def _meet(k: int, norm: float):
    """A function over groups of queries (with their leaves) and rows (with their leaf) of a cell: each query's best."""
    slack = 1e-6 * norm * norm

    def run(frames):
        import pandas as pd

        best = _Best(k)
        for g in _groups(frames, ["cell", "r", "q"]):
            n = int((g.side.to_numpy() == 0).sum())
            if n in (0, len(g)):
                continue
            ids, v = g.vec_id.to_numpy(), np.stack(g.v.to_list()).astype(np.float64)
            qi, ri, q, r = ids[:n], ids[n:], v[:n], v[n:]
            q32, r32 = q.astype(np.float32), r.astype(np.float32)
            lists = [np.asarray(x) for x in g.leaves.iloc[:n]]
            asks, leaf = np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate(lists)
            order = np.argsort(leaf, kind="stable")
            asks, leaf = asks[order], leaf[order]
            own = np.concatenate([np.asarray(x) for x in g.leaves.iloc[n:]])
            row = np.argsort(own, kind="stable")
            own = own[row]
            floor, held, size = best.floor(qi), [], 0

            def take():
                a, b = (np.concatenate(x) for x in zip(*held))  # noqa: B023
                # in double precision and a fixed order of addition, so that equal vectors tie wherever they stand
                exact = np.concatenate([np.zeros(0), *((q[a[i : i + 8192]] * r[b[i : i + 8192]]).sum(1) for i in range(0, len(a), 8192))])  # noqa: B023
                best.add(qi[a], ri[b], exact)  # noqa: B023

            at = np.unique(leaf)
            for lo, hi, x, y in zip(np.searchsorted(leaf, at), np.searchsorted(leaf, at, "right"), np.searchsorted(own, at), np.searchsorted(own, at, "right")):
                if x == y:
                    continue
                who, rows = asks[lo:hi], row[x:y]
                a, b = np.nonzero(q32[who] @ r32[rows].T >= (floor[who] - slack)[:, None])
                if len(a):
                    a, b = who[a], rows[b]
                    other = qi[a] != ri[b]
                    held.append((a[other], b[other]))
                    size += len(a)
                    if size > HELD:
                        take()
                        floor, held, size = best.floor(qi), [], 0
            if held:
                take()
        if len(best.query):
            yield pd.DataFrame({"query_id": best.query, "vec_id": best.id, "score": best.score})

    return run


def _found(ws: Workspace, rows: DataFrame, asked: DataFrame, k: int, trees: tuple[int, ...], leaf: int, sample: int, target: float) -> DataFrame:
    """(query_id, vec_id, score) among ``rows`` (vec_id, v), all of one length."""
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).toArrow().sort_by("vec_id").combine_chunks()
    of_sample = matrix(some.column("v").combine_chunks()) if some.num_rows else np.zeros((0, 1))
    norm, count = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))), F.count("*")).first()
    norm = norm or 1.0
    forest, share = fit(of_sample, norm, count, k, trees, leaf, target)
    depth = forest.normals.shape[1].bit_length()
    below = min(depth, max(0, int(np.log2(CELL / leaf))))  # levels of a cell's subtree
    names, schema = ["cell", "leaves", "vec_id", "v"], f"cell long, leaves array<int>, vec_id long, v {rows.schema['v'].dataType.simpleString()}"

    def route(batches):
        for b in batches:
            at = forest.leaves(matrix(b.column(1)))
            row = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
            leaves = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel().astype(np.int32)), 1).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel() >> below), leaves, b.column(0).take(row), b.column(1).take(row)], names)

    def look(batches):
        for b in batches:
            for first in range(0, b.num_rows, 64):
                part = b.slice(first, 64)
                found = forest.search(matrix(part.column(1)), share)
                row = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                leaves = np.array([y for x in found for y in x], np.int64)
                order = np.lexsort((leaves, row))
                row, leaves = row[order], leaves[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (leaves[1:] >> below != leaves[:-1] >> below)
                start = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(leaves)).astype(np.int32)), pa.array(leaves.astype(np.int32)))
                at = pa.array(row[start])
                yield pa.RecordBatch.from_arrays([pa.array(leaves[start] >> below), lists, part.column(0).take(at), part.column(1).take(at)], names)

    # searching trees takes far longer than reading queries: so many of them make a task
    asked = asked.repartition(max(1, -(-asked.count() // TASK_QUERIES)))
    routed, looked = ws.cut(rows.mapInArrow(route, schema)), ws.cut(asked.mapInArrow(look, schema))
    blocks = lambda x, size, name: x.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = ws.cut(blocks(routed, BLOCK_ROWS, "rb").join(blocks(looked, BLOCK_QUERIES, "qb"), "cell"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = routed.join(grid, "cell").select("cell", own("rb").alias("r"), span("qb").alias("q"), F.lit(1).alias("side"), "vec_id", "v", "leaves")
    right = looked.join(grid, "cell").select("cell", span("rb").alias("r"), own("qb").alias("q"), F.lit(0).alias("side"), "vec_id", "v", "leaves")
    pairs = left.unionByName(right).repartition("cell", "r", "q").sortWithinPartitions("cell", "r", "q", "side")
    return pairs.mapInPandas(_meet(k, norm), "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, trees: tuple[int, ...] = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``df`` of largest inner product found for each query.

    ``queries`` holds ids of rows of ``df``; a query is no neighbour of its own. Ties go to the
    smaller id. Vectors that are null, empty or zero or hold null or non-finite components take no
    part, nor do rows without an id; of rows that repeat an id one counts, and so it is with repeated
    queries. A vector's neighbours have as many components as itself. An empty table gives an empty
    result; other columns are ignored. ``target`` is the recall that is aimed at (1.0: all is searched).
    """
    ws = Workspace(df.sparkSession)
    rows = ws.cut(usable_vectors(df, id_col, vector_col))
    ids = queries.select(F.col(f"`{id_col}`").cast("long").alias("vec_id")).distinct()
    asked = ws.cut(rows.join(ids, "vec_id", "left_semi"))
    found = None
    for part in by_length(rows):
        n = part.select(F.size("v")).first()
        some = _found(ws, part, asked if n is None else asked.where(F.size("v") == n[0]), k, trees, leaf, sample, target)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
