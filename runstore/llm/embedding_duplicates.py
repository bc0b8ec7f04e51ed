"""Near-duplicate embeddings by cosine: a pivot-permutation index.

Pivots are vectors of a bounded sample, thinned so that no two have a cosine above ``APART``: a
tight group holds one or few, however large it is. Each vector is described by its ``NEAREST``
nearest pivots in order, the first of which is its home, and posted in the inverted lists of these.
Vectors that share a list are candidates, and every candidate is verified in double precision. A
pair is treated in one list only: that of a home in which both are posted (the smaller, if both
homes are such), else that of the smallest shared pivot. Lists are worked in blocks of bounded size,
which return a count and one link for each vector, never pairs; in a list away from home, vectors of
a crowded home have blocks of their own, which don't meet each other. Equal vectors are one entry
with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal_blocks
from .components import connected_components
from .near_duplicates import _groups
from .vectors import by_length, matrix, usable_vectors
from .workspace import Workspace

LEAST = 0.95
NEAREST = 10
#: Pivots: four times the root of the number of vectors, within these bounds.
FEW, MANY = 32, 32_768
APART = 0.7
#: Rows of a block; lists of more than ``SPLIT`` blocks have up to four times as many in each.
BLOCK, SPLIT = 512, 32


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; first scaled by their largest component, so that no square over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _thinned(v: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows, of which none has a cosine above ``APART`` with one before it."""
    kept = np.zeros((0, v.shape[1]))
    for at in range(0, len(v), 1024):
        part = v[at : at + 1024]
        part = part[(part @ kept.T <= APART).all(1)]
        near = part @ part.T > APART
        keep = np.ones(len(part), bool)
        for i in range(len(part)):
            if keep[i]:
                keep[i + 1 :] &= ~near[i, i + 1 :]
        kept = np.concatenate([kept, part[keep]])
        if len(kept) >= most:
            break
    return kept[:most]


def _belong(pivot: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs posted in the list of ``pivot``, by their nearest pivots in order: which are treated in it."""
    hx, hy = x[:, 0], y[:, 0]
    keep = (hx == hy) & (hx == pivot)
    rest = np.flatnonzero(hx != hy)
    for at in range(0, len(rest), 4096):
        k = rest[at : at + 4096]
        a, b, ha, hb = x[k], y[k], hx[k], hy[k]
        none = np.iinfo(np.int32).max
        first = np.minimum(np.where((b == ha[:, None]).any(1), ha, none), np.where((a == hb[:, None]).any(1), hb, none))
        far = np.flatnonzero(first == none)
        common = (a[far][:, :, None] == b[far][:, None, :]).any(2)
        first[far] = np.where(common, a[far], none).min(1)
        keep[k] = first == pivot
    return keep


def _linked(g) -> np.ndarray:
    """A matrix (rows of the one side, of the other or the same) of pairs that are linked and belong to this list."""
    side = g.side.to_numpy()
    both = side.any()
    n = int((side == 0).sum()) if both else len(g)
    v, perm = _unit(np.stack(g.v.to_list()).astype(np.float64)), np.stack(g.perm.to_list())
    a, b = (v[:n], v[n:]) if both else (v, v)
    px, py = (perm[:n], perm[n:]) if both else (perm, perm)
    s = a @ b.T
    near = s >= LEAST + 1e-9
    i, j = np.nonzero((s >= LEAST - 1e-9) & ~near)
    near[i, j] = (a[i] * b[j]).sum(1) >= LEAST
    if not both:
        np.fill_diagonal(near, False)
    pivot = int(g["pivot"].iloc[0])
    # pairs at home in this list belong to it; only others are looked at one by one
    i, j = np.nonzero(near & ~((px[:, 0] == pivot)[:, None] & (py[:, 0] == pivot)[None, :]))
    for at in range(0, len(i), 1 << 18):
        x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        near[x, y] = _belong(pivot, px[x], py[y])
    return near


def _meet(frames):
    import pandas as pd

    for g in _groups(frames, ["pivot", "lo", "hi"]):
        near = _linked(g)
        if not near.any():
            continue
        ids, weight, n = g.rep.to_numpy(), g.weight.to_numpy().astype(np.float64), len(near)
        both = n < len(g)
        links = np.concatenate([near @ weight[n:], weight[:n] @ near]) if both else near @ weight
        order, rank = np.unique(ids, return_inverse=True)
        low, none = rank.astype(np.int32), np.int32(len(g))
        while True:  # smallest id reachable by links of this block
            before = low.copy()
            other = low[n:] if both else low
            low[:n] = np.minimum(low[:n], np.where(near, other[None, :], none).min(1))
            if both:
                low[n:] = np.minimum(low[n:], np.where(near, low[:n, None], none).min(0))
            if (low == before).all():
                break
        own = np.flatnonzero(links > 0)
        yield pd.DataFrame({"rep": ids[own], "links": links[own].astype(np.int64), "low": order[low[own]]})


def _met(ws: Workspace, reps: DataFrame) -> DataFrame:
    """(rep, links, low) of each block in which a vector has links; reps: (rep, weight, v), of one length."""
    n_pivots = min(MANY, max(FEW, 4 * math.isqrt(reps.count())))
    some = reps.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(2 * n_pivots).select("v").toArrow().column("v").combine_chunks()
    pivots = _thinned(_unit(matrix(some)), n_pivots) if len(some) else np.zeros((0, 1))

    def post(batches):
        for b in batches:
            s = _unit(matrix(b.column("v"))) @ pivots.T
            m = min(NEAREST, s.shape[1])
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
            row = pa.array(np.repeat(np.arange(b.num_rows), m))
            perm = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), m).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *[c.take(row) for c in b.columns], perm.take(row)], ["pivot", "rep", "weight", "v", "perm"])

    posted = ws.cut(reps.mapInArrow(post, f"pivot int, rep long, weight long, v {reps.schema['v'].dataType.simpleString()}, perm array<int>"))
    # vectors of a crowded home don't meet in other lists, since they meet in its own
    rows = posted.select("pivot", F.col("perm")[0].alias("home"), F.col("rep").alias("doc_id"), "weight", "v", "perm")
    dealt = deal_blocks(ws, rows, "pivot", "home", BLOCK, SPLIT, within=F.col("home") == F.col("pivot"))
    dealt = dealt.select("pivot", "lo", "hi", "side", F.col("doc_id").alias("rep"), "weight", "v", "perm")
    met = ws.cut(dealt.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi", "side").mapInPandas(_meet, "rep long, links long, low long"), free_shuffles=True)
    ws.drop(posted)
    return met


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector.

    Vectors found with a cosine of 0.95 or more are linked; vectors of different lengths never are.
    Those that are null, empty or zero or hold null or non-finite components are linked with
    nothing, nor are rows without an id, which come back with a null component, and kept. Of rows that repeat an id one counts; each comes
    back. An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    ws = Workspace(spark)
    unit = usable_vectors(df, id_col, vector_col)
    vectors = ws.cut(unit.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    classes = ws.cut(vectors.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    member = ws.cut(vectors.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]).select("vec_id", "rep", "weight"))
    reps = vectors.join(classes.select(F.col("rep").alias("vec_id"), "weight"), "vec_id")
    reps = ws.cut(reps.select(F.col("vec_id").alias("rep"), "weight", "v"))
    met = None
    for part in by_length(reps):
        found = _met(ws, part)
        met = found if met is None else met.unionByName(found)
    links = ws.cut(met.groupBy("rep").agg(F.sum("links").alias("links")))
    roots = ws.cut(connected_components(ws, met.select(F.col("rep").alias("u"), F.col("low").alias("v"))))
    out = member.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    every = df.select(F.col(id_col).cast("long").alias("vec_id"))
    out = every.join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
