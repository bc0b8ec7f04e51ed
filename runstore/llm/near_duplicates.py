"""Near-duplicate documents by HyperMinHash sketches, confirmed on whole shingle sets.

A document's sorted distinct shingle hashes fall into ``BUCKETS`` buckets by their top bits; each
bucket's least hash is compressed into a register of its count of leading zeros and ``MANTISSA``
further bits. An empty bucket borrows the register of the first full one in an order fixed for that
bucket, so that registers of two documents agree with the Jaccard similarity for short texts too.
Bands of ``ROWS`` registers are hashed; documents that share a band are candidates. With 51 bands of
5, a pair at the threshold of 0.75 shares none with probability 1e-6.

The work follows components, not pairs, and no table of pairs is made within a band. Equal sets are
first joined to their smallest document. In each band the others are compared with its smallest
document, and each document's best candidate there is verified on whole sets. Bands whose members
are then still in several components are compared by registers in blocks, which only say which
components may belong together, and which documents have a candidate in another component. These
documents of such a cluster finally meet with their texts, again in blocks: every pair of different
components whose similarity estimated from the registers, corrected for chance collisions, isn't
under the threshold by more than ``MARGIN`` is verified on whole sets, unless links found before have
joined the two. Members of one large component have blocks of their own, which don't meet each
other, so that a large family and some outliers are sent in proportion to their number.

Sketches of tiny sets stray further. Links of two sets of up to ``TINY`` shingles are found exactly
instead: each set is posted under all its subsets that can be an intersection in a link, and those
that meet under one are linked to the smallest set there where the subset is large enough.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal_blocks
from .components import connected_components
from .textnum import mix, shingle_sets
from .workspace import Workspace, one_row_per_key

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS, BANDS = 5, 51
PERCENT = 75
MARGIN = 0.15  # over five standard deviations of an estimate from 256 registers
TINY = 11  # a set has 67 such subsets at most; with 12 shingles it would have 299
BAND_BLOCK, BLOCK = 1024, 192  # members of a band (by sketches) or of a cluster (with texts) compared at once
CHUNK = 64  # documents verified against one copy of the same text
_rng = np.random.Generator(np.random.PCG64(77))
BORROW = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1)
EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
ROW_CODES = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
SUMS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
BAND_CODES = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def registers(own: np.ndarray) -> np.ndarray:
    """The registers of a sorted distinct set of hashes that isn't empty."""
    at = np.searchsorted(own, EDGES)
    low = own[np.minimum(at, len(own) - 1)]
    full = (at < len(own)) & (low >> np.uint64(64 - BUCKET_BITS) == np.arange(BUCKETS, dtype=np.uint64))
    rest = (low << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    # the binary exponent and first bits of its top 40 bits, which a double holds exactly
    bits = (rest >> np.uint64(24)).astype(np.float64).view(np.uint64)
    exponent = (bits >> np.uint64(52)).astype(np.int64) - 1023
    zeros = np.where(rest >> np.uint64(24) == 0, 40, 39 - exponent)
    mantissa = ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    out = (zeros << MANTISSA | mantissa).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        order = BORROW[empty, :16]
        hit = full[order]
        first = hit.argmax(1)
        found = hit[np.arange(len(empty)), first]
        out[empty[found]] = out[order[found, first[found]]]
        if not found.all():
            late = empty[~found]
            out[late] = out[BORROW[late, full[BORROW[late]].argmax(1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    x = regs[: ROWS * BANDS].astype(np.uint64).reshape(BANDS, ROWS)
    return mix((x * ROW_CODES).sum(1, dtype=np.uint64) + BAND_CODES).view(np.int64)


def _collision_rate(n: float, m: float) -> float:
    """Chance that different minima of buckets in sets of n and m hashes give the same register."""
    i = np.arange(1, 41, dtype=float)[:, None]
    j = np.arange(1 << MANTISSA, dtype=float)[None, :]
    scale = 2.0**MANTISSA
    lo, hi = (scale + j) / (scale * 2**i), (scale + j + 1) / (scale * 2**i)

    def inside(size):
        per = max(size / BUCKETS, 1.0)  # of a full bucket
        return np.exp(per * np.log1p(-np.minimum(lo, 1 - 1e-16))) - np.exp(per * np.log1p(-np.minimum(hi, 1 - 1e-16)))

    return float((inside(n) * inside(m)).sum())


@lru_cache(maxsize=4096)
def _collision_rate_at(a: int, b: int) -> float:
    return _collision_rate(2 ** (a / 2), 2 ** (b / 2))


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the registers' agreement, without what chance adds to it."""
    same = (a == b).mean(-1)
    steps = np.rint(2 * np.log2(np.maximum(np.stack([n, m]), 1))).astype(int)
    pairs, back = np.unique(steps[0] * 1000 + steps[1], return_inverse=True)
    chance = np.array([_collision_rate_at(*divmod(int(p), 1000)) for p in pairs])[back.ravel()].reshape(same.shape)
    return (same - chance) / (1 - chance)


@lru_cache(maxsize=None)
def _subsets(n: int) -> np.ndarray:
    """The subsets of n things that can be what a set of n shares with a linked one, as rows of 0 and 1."""
    least = -(-PERCENT * n // 100)
    some = [x for c in range(least, n + 1) for x in combinations(range(n), c)]
    out = np.zeros((len(some), n), np.uint64)
    for row, x in zip(out, some):
        row[list(x)] = 1
    return out


def _tiny(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set of up to ``TINY`` shingles the subsets that can be an intersection: sizes and two hashes."""
    rows = _subsets(len(own))
    of = lambda h: (rows * mix(h)).sum(1, dtype=np.uint64).view(np.int64)
    return rows.sum(1).astype(np.int64), of(own + SUMS[0]), of(own ^ SUMS[1])


def _tiny_links(ws: Workspace, reps: DataFrame) -> DataFrame:
    """(a, b) that are linked, as many as join all tiny sets that are; reps: sketches.

    If two sets are linked by what they share, so is each with the smallest set that holds it.
    """
    rows = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("subsets").alias("s")).select("doc_id", "n", "s.*")
    rows = ws.cut(rows)
    by = ["shared", "h1", "h2"]
    lead = rows.groupBy(by).agg(F.min(F.struct("n", "doc_id")).alias("lead"), F.count("*").alias("many")).where("many > 1").select(*by, "lead")
    linked = rows.join(lead, by).where(100 * F.col("shared") >= PERCENT * (F.col("n") + F.col("lead.n") - F.col("shared")))
    out = ws.cut(linked.select(F.col("doc_id").alias("a"), F.col("lead.doc_id").alias("b")).where("a != b").distinct(), free_shuffles=True)
    ws.drop(rows)
    return out


SKETCHES = "doc_id long, n_shingles long, lo long, hi long, regs binary, bands array<long>, subsets array<struct<shared: long, h1: long, h2: long>>"


def _lists(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of lists."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return ends, np.concatenate([np.zeros(0, np.int64), *parts])


def _sketch(batches):
    none = np.zeros(0, np.int64)
    for batch in batches:
        n, lo, hi, regs, keys, subsets = [], [], [], [], [], []
        for own in shingle_sets(batch.column(1)):
            n.append(len(own))
            lo.append(int(mix(own + SUMS[0]).sum(dtype=np.uint64))), hi.append(int(mix(own ^ SUMS[1]).sum(dtype=np.uint64)))
            r = registers(own) if len(own) else None
            regs.append(None if r is None else r.tobytes()), keys.append(none if r is None else band_keys(r))
            subsets.append(_tiny(own) if 0 < len(own) <= TINY else (none, none, none))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        of_bands, flat = _lists(keys)
        three = [_lists([x[k] for x in subsets]) for k in range(3)]
        struct = pa.StructArray.from_arrays([pa.array(x) for _, x in three], ["shared", "h1", "h2"])
        columns = [batch.column(0), pa.array(n, pa.int64()), signed(lo), signed(hi), pa.array(regs, pa.binary()), pa.ListArray.from_arrays(pa.array(of_bands), pa.array(flat)), pa.ListArray.from_arrays(pa.array(three[0][0]), struct)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "lo", "hi", "regs", "bands", "subsets"])


def _estimate(batches):
    """Candidates (a, b) with both sketches to those worth verifying, with their estimate."""
    for x in batches:
        if not x.num_rows:
            continue
        ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
        na, nb = (x.column(c).to_numpy() for c in ("na", "nb"))
        est = estimates(ra, rb, na, nb)
        ok = (est >= PERCENT / 100 - MARGIN) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([x.column("a").filter(keep), x.column("b").filter(keep), pa.array(est[ok])], ["a", "b", "est"])


def _maybe(own: np.ndarray, others: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Which others a sketch can't be told to be unlike, and the estimates (0 where told at once)."""
    est = np.zeros(len(others))
    near = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((own == others).sum(1) >= int((PERCENT / 100 - MARGIN) * BUCKETS))
    at = np.flatnonzero(near)
    if len(at):
        est[at] = estimates(own[None, :], others[at], np.full(len(at), n), m[at])
    return est


def _groups(batches, keys: list[str]):
    """Runs of rows of equal keys, as pandas frames, from sorted batches."""
    import pandas as pd

    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = pdf[keys].to_numpy()
        at = 0
        for c in np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1:
            yield pdf.iloc[at:c]
            at = c
        rest = pdf.iloc[at:]
    if rest is not None and len(rest):
        yield rest


def _touching(batches):
    """For each block pair of a band: pairs (u, v) of components that may belong together, as few as
    join all that may, and the documents (doc) with such a candidate in another component."""
    import pandas as pd

    for g in _groups(batches, ["key", "lo", "hi"]):
        root, side, n = g.root.to_numpy(), g.side.to_numpy(), g.n_shingles.to_numpy()
        if (root == root[0]).all():
            continue
        own = root.copy()
        regs = np.frombuffer(b"".join(g.regs), np.uint16).reshape(-1, BUCKETS)
        both = side.any()
        out, active = [], np.zeros(len(g), bool)
        for i in range(len(g)):
            if both and side[i]:
                break  # side 0 comes first
            at = np.flatnonzero((root != root[i]) & (side == 1)) if both else i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            if not len(at):
                continue
            at = at[_maybe(regs[i], regs[at], n[i], n[at]) >= PERCENT / 100 - MARGIN]
            active[at] = True
            active[i] |= len(at) > 0
            for j in at[own[at] != own[i]]:
                if own[j] != own[i]:
                    out.append((root[i], root[j]))
                    own[own == own[j]] = own[i]
        if out:
            docs = g.doc_id.to_numpy()[active]
            u, v = np.array(out).T
            none = [None] * len(docs)
            yield pd.DataFrame({"u": [*u.tolist(), *none], "v": [*v.tolist(), *none], "doc": [*[None] * len(u), *docs.tolist()]}, dtype="Int64")


def _joined(batches):
    """Verified links between components, for each block pair of a cluster."""
    import pandas as pd

    for g in _groups(batches, ["cluster", "lo", "hi"]):
        root, side = g.root.to_numpy().copy(), g.side.to_numpy()
        if (root == root[0]).all():
            continue
        first = root.copy()
        sets = list(shingle_sets(pa.array(g.text, pa.large_string())))
        n = np.array([len(x) for x in sets])
        regs = np.stack([registers(x) for x in sets])
        both = side.any()
        todo = []
        for i in range(len(g)):
            if both and side[i]:
                break
            at = np.flatnonzero((root != root[i]) & (side == 1)) if both else i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            if len(at):
                est = _maybe(regs[i], regs[at], n[i], n[at])
                good = est >= PERCENT / 100 - MARGIN
                todo.append((np.full(good.sum(), i), at[good], est[good]))
        if not todo:
            continue
        i_all, j_all, est = (np.concatenate(x) for x in zip(*todo))
        out = []
        for k in np.argsort(-est, kind="stable"):
            i, j = i_all[k], j_all[k]
            if root[i] != root[j] and similar(sets[i], sets[j]):
                out.append((first[i], first[j]))
                root[root == root[j]] = root[i]
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


def _verify(batches):
    """Rows sorted by (b, chunk), b's own text first (a null), then texts of a: pairs that are linked."""
    held, at = None, None
    for batch in batches:
        b, chunk, a = (batch.column(c).to_pylist() for c in ("b", "chunk", "a"))
        out = []
        for k, own in enumerate(shingle_sets(batch.column("text"))):
            if a[k] is None:
                held, at = own, (b[k], chunk[k])
                continue
            assert at == (b[k], chunk[k])
            if similar(held, own):
                out.append((a[k], b[k]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _verified(ws: Workspace, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. A much paired b is sent once for each CHUNK of a."""
    many = ws.cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk"))
    left = dealt.join(texts, dealt.a == texts.doc_id).select("b", "chunk", "a", "text")
    right = many.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).join(texts, F.col("b") == texts.doc_id)
    rows = left.unionByName(right.select("b", "chunk", F.lit(None).cast("long").alias("a"), "text"))
    rows = rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())
    out = ws.cut(rows.mapInArrow(_verify, "a long, b long"), free_shuffles=True)
    ws.drop(many)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked if 100 * shared >= 75 * united five-word shingles; component_id is the
    smallest doc_id reachable by links. Null and empty texts have no shingles and are linked with
    nothing; texts may be of any length. Rows without an id come back unlinked, with a null component, and kept. Of rows that
    repeat an id, the one with the smallest text counts. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = one_row_per_key(every, "doc_id")
    sketches = ws.cut(every.where("doc_id is null").unionByName(docs).mapInArrow(_sketch, SKETCHES))
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    # Documents of equal sets: (set) -> smallest document
    sets = ws.cut(full.groupBy("n_shingles", "lo", "hi").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    copies = ws.cut(full.select("doc_id", "n_shingles", "lo", "hi").join(sets, ["n_shingles", "lo", "hi"]).select("doc_id", "n_shingles", "rep"), free_shuffles=True)
    reps = full.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = ws.cut(reps.select("doc_id", "n_shingles", F.explode("bands").alias("key")), free_shuffles=True)
    shared = ws.cut(bands.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("_last")).where("lead < _last").select("key", "lead"))
    members = ws.cut(bands.join(shared, "key").select("key", "lead", "doc_id"), free_shuffles=True)
    ws.drop(bands, shared)
    tiny = _tiny_links(ws, reps.where(F.col("n_shingles") <= TINY))
    ends = tiny.select(F.col("a").alias("doc_id")).unionByName(tiny.select(F.col("b").alias("doc_id")))
    involved = ws.cut(members.select("doc_id").unionByName(ends).distinct())
    regs = ws.cut(full.select("doc_id", "n_shingles", "regs").join(involved, "doc_id"))
    texts = ws.cut(docs.join(involved, "doc_id"), free_shuffles=True)

    def paired(pairs: DataFrame) -> DataFrame:
        side = lambda x: regs.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n" + x), F.col("regs").alias("r" + x))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimate, "a long, b long, est double")

    star = ws.cut(paired(members.where("doc_id > lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()))
    best = star.groupBy("a").agg(F.max(F.struct("est", -F.col("b"))).alias("_x")).select("a", (-F.col("_x.col2")).alias("b"))
    links = _verified(ws, best, texts).select("a", "b").unionByName(tiny)
    roots = ws.cut(connected_components(ws, links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    placed = ws.cut(involved.join(roots, involved.doc_id == roots.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("root")))
    inside = ws.cut(members.select("key", "doc_id").join(placed, "doc_id"))
    mixed = ws.cut(inside.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("key"))
    dealt = deal_blocks(ws, inside.join(mixed, "key"), "key", "root", BAND_BLOCK).join(regs, "doc_id")
    touching = ws.cut(dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side").mapInPandas(_touching, "u long, v long, doc long"), free_shuffles=True)
    clusters = connected_components(ws, touching.where("u is not null").select("u", "v")).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    # texts are sent of documents with a candidate in another component only
    active = touching.where("doc is not null").select(F.col("doc").alias("doc_id")).distinct()
    met = ws.cut(placed.join(active, "doc_id").join(clusters, "root"))
    dealt = deal_blocks(ws, met, "cluster", "root", BLOCK).join(texts, "doc_id")
    more = dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "side").mapInPandas(_joined, "u long, v long")
    last = ws.cut(connected_components(ws, more), free_shuffles=True)
    ws.drop(members, texts, regs)
    final = placed.join(last, placed.root == last.node, "left").select("doc_id", F.coalesce(last.root, placed.root).alias("component_id"))
    out = copies.join(final.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(alone)
