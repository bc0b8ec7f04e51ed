"""Passages that occurred before, by a depth-limited radix sort of suffixes.

Every byte position is a suffix, and suffixes are ordered only through their first ``DEPTH`` bytes,
digit by digit from the most significant; equal groups are exactly the repeated windows. What can't
have an equal is dropped before it is sorted:

1. In every window of ``DEPTH`` bytes the ``GRAM``-byte string of smallest hash (the leftmost) is its
   anchor. Equal windows have equal anchors at equal places, so anchors are the first digit, on which
   rows are dealt; an anchor row stands for the run of windows that it governs.
2. Occurrences of an anchor whose whole governed regions are equal form a class. All but the first
   of a class are repeats as a whole, and each task tells this among the anchors it has gathered
   before anything is shuffled, so a hot passage sends one row for some hundred thousand anchors.
   A task that gathers more than ``CROWD`` classes of an anchor spreads them over ``SPREAD`` parts by
   their regions, and tells the anchor's other occurrences that there are several classes.
3. Only where an anchor has several classes do their first occurrences meet with their bytes, and
   their windows are radix-sorted in digits of eight bytes. The windows of an anchor with more than
   ``HOT`` classes are dealt by all their digits: Spark groups them by their bytes over all tasks.

A class is told by two 64-bit hashes, of the anchor and of its region; windows are by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import mix, powers, slices
from .workspace import Workspace, one_row_per_key

DEPTH, GRAM = 100, 32
CROWD, SPREAD, HOT = 64, 64, 4_096
#: Anchors that a task gathers before it tells repeats among them; what is left of them is shuffled.
GATHERED = 1 << 20
_rng = np.random.Generator(np.random.PCG64(31))
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)  # here A-Z differ from a-z
POSITION = np.uint64((1 << 24) - 1)
#: Longer texts are scanned in pieces of so many bytes, whose places fit the bits of ``POSITION``.
PIECE = 1 << 19
LOWEST = np.iinfo(np.int64).min


def _span_hash(sums, down, a, b):
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray):
    """text, anchor, first and last window (byte positions in ``data``), hash of the anchor, hash of the region."""
    n, spread = len(data), DEPTH - GRAM
    starts = [np.arange(a, b - DEPTH + 1) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= DEPTH]
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[data] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # the hash's top bits, then the place: the smallest is the leftmost of the smallest hash
    low = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= spread + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    s = np.concatenate(starts)
    best = np.minimum(low[s], low[s + spread + 1 - size])
    at = (best & POSITION).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
    run = np.flatnonzero(new)
    lo, hi, p = s[run], s[np.append(run[1:], len(s)) - 1], at[run]
    text = np.searchsorted(offsets, lo, "right") - 1
    region = _span_hash(sums, down, lo, hi + DEPTH) * np.uint64(0x9E3779B97F4A7C15) + ((p - lo) * 256 + (hi - lo)).astype(np.uint64)
    return text, p, lo, hi, grams[p], mix(region)


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Ranges of each document joined where they touch, sorted."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    new = np.ones(len(doc), bool)
    # the furthest end so far in the document
    base = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]])) * (1 << 40)
    far = np.maximum.accumulate(b + base) - base
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > far[:-1])
    at = np.flatnonzero(new)
    return doc[at], a[at], np.maximum.reduceat(b, at)


def _scan(batches):
    """Anchor rows (first occurrences among some ``GATHERED`` anchors) and ranges repeated among them.

    An anchor row has its place, and the windows before and after it, in one number.
    """
    parts, n = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, data, offsets in slices(batch.column(1)):
            for k, start, d, o in _pieces(data, offsets):
                text, p, lo, hi, gram, region = anchors(d, o)
                base = o[text] - start if len(text) else text
                parts.append((ids[row + k + text], p - base, lo - base, hi - base, gram.view(np.int64), region.view(np.int64)))
                n += len(p)
                if n >= GATHERED:
                    yield _first_occurrences(parts)
                    parts, n = [], 0
    if parts:
        yield _first_occurrences(parts)


def _first_occurrences(parts) -> pa.RecordBatch:
    """Rows of three kinds: first occurrences (until 0), repeated ranges (until is their end), and marks (until -1) of spread anchors."""
    doc, p, lo, hi, gram, region = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((p, doc, region, gram))
    doc, p, lo, hi, gram, region = (x[order] for x in (doc, p, lo, hi, gram, region))
    again = np.zeros(len(doc), bool)
    again[1:] = (gram[1:] == gram[:-1]) & (region[1:] == region[:-1])
    rd, ra, rb = _merged(doc[again], lo[again], hi[again] + DEPTH)
    first = ~again
    doc, p, lo, hi, gram, region = (x[first] for x in (doc, p, lo, hi, gram, region))
    place = (p << 16) | ((p - lo) << 8) | (hi - lo)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
    many = np.diff(np.append(start, len(gram)))
    part = np.where(np.repeat(many, many) > CROWD, 1 + (region & (SPREAD - 1)), 0)
    marks = gram[start[many > CROWD]]
    n, r, m = len(gram), len(rd), len(marks)
    zeros = lambda k: np.zeros(k, np.int64)
    columns = {
        "gram": (gram, mix(rd.astype(np.uint64)).view(np.int64), marks),
        "part": (part, zeros(r), zeros(m)),
        "region": (region, zeros(r), np.full(m, LOWEST)),
        "doc_id": (doc, rd, np.full(m, LOWEST)),
        "place": (place, ra, zeros(m)),
        "until": (zeros(n), rb, np.full(m, -1)),
    }
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns.values()], list(columns))


def _pieces(data, offsets):
    """The slice as it is, or its texts in pieces: (first text, the piece's start in it, bytes, offsets).

    Pieces overlap by ``DEPTH`` - 1 bytes, so that each window lies in one of them. A region cut by
    a piece's end only makes another class of its anchor.
    """
    if len(data) <= PIECE:
        yield 0, 0, data, offsets
        return
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        for at in range(a, max(a + 1, b - DEPTH + 1), PIECE - DEPTH + 1):
            d = data[at : min(b, at + PIECE)]
            yield k, at - a, d, np.array([0, len(d)])


def _classes(batches):
    """From rows sorted by (gram, part, region, doc_id, place): ranges of all but the first of a class, and the first where a gram has several classes."""
    kept = None  # the last class's first row, and whether it has been sent
    for batch in batches:
        g, s, r, d, p, u = (batch.column(c).to_numpy() for c in ("gram", "part", "region", "doc_id", "place", "until"))
        out = [(np.ones(int((u > 0).sum()), np.int8), g[u > 0], d[u > 0], p[u > 0], u[u > 0])]
        g, s, r, d, p, u = (x[u <= 0] for x in (g, s, r, d, p, u))
        if len(g):
            head = kept is not None
            if head:
                g, s, r, d, p, u = (np.concatenate([[y], x]) for x, y in zip((g, s, r, d, p, u), kept[:6]))
            same = np.zeros(len(g), bool)
            same[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (r[1:] == r[:-1]) & (u[1:] == u[:-1])
            lo = (p >> 16) - ((p >> 8) & 255)
            told = same & (u == 0)
            out.append((np.ones(int(told.sum()), np.int8), g[told], d[told], lo[told], (lo + (p & 255) + DEPTH)[told]))
            first = np.flatnonzero(~same)
            fg, fs = g[first], s[first]
            beside = (fg[1:] == fg[:-1]) & (fs[1:] == fs[:-1])
            near = fs > 0  # a spread gram has several classes
            near[1:] |= beside
            near[:-1] |= beside
            send = near & (u[first] == 0)
            if head and kept[6]:
                send[0] = False
                near[0] = True
            at = first[send]
            out.append((np.full(len(at), 2, np.int8), g[at], d[at], p[at], np.zeros(len(at), np.int64)))
            # if the last class is alone so far, a later batch may bring another of its gram
            last = first[-1]
            kept = (g[last], s[last], r[last], d[last], p[last], u[last], bool(near[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["kind", "gram", "doc_id", "a", "b"])


def _regions(batches):
    """The bytes of the regions asked for: texts joined with lists of (gram, place)."""
    for batch in batches:
        gram, doc, lo, before, more, raw = [], [], [], [], [], []
        for i, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked"))):
            data = text.encode()
            for x in asked:
                p, w, m = x["a"] >> 16, (x["a"] >> 8) & 255, x["a"] & 255
                gram.append(x["gram"]), doc.append(i), lo.append(p - w), before.append(w), more.append(m)
                raw.append(data[p - w : p - w + m + DEPTH])
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(before, pa.int32()), pa.array(more, pa.int32()), pa.array(raw, pa.binary())], ["gram", "doc_id", "lo", "before", "more", "raw"])


def radix_groups(flat: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (their numbers) in groups of two or more equal in the first DEPTH bytes, and their groups.

    ``flat`` must have DEPTH bytes after each start. Passes go from the most significant digit; what
    is alone in its group drops out of later passes.
    """
    which = np.arange(len(start))
    for d in range(0, DEPTH, 8):
        width = min(8, DEPTH - d)
        digit = np.zeros(len(which), np.uint64)
        at = start[which] + d
        for k in range(width):
            digit = (digit << np.uint64(8)) | flat[at + k]
        order = np.lexsort((digit, group))
        which, group, digit = which[order], group[order], digit[order]
        new = np.ones(len(which), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new)
        keep = np.bincount(group)[group] > 1
        which, group = which[keep], group[keep]
        if not len(which):
            break
    return which, group


def _sorted_windows(batches):
    """Ranges of repeated windows, from regions sorted by (gram, doc_id, lo); whole grams at a time."""

    def work(gram, doc, lo, before, more, raw):
        if not raw:
            return None
        size = np.array([len(x) for x in raw])
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        n = more + 1
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Windows can be equal only if their anchor stands at the same place in them
        group = np.unique(np.stack([np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]]))[row], before[row] - j]), axis=1, return_inverse=True)[1].ravel()
        which, group = radix_groups(flat, base[row] + j, group)
        if not len(which):
            return None
        d, s = doc[row[which]], lo[row[which]] + j[which]
        order = np.lexsort((s, d, group))
        d, s, group = d[order], s[order], group[order]
        again = np.zeros(len(d), bool)
        again[1:] = group[1:] == group[:-1]
        return _merged(d[again], s[again], s[again] + DEPTH)

    def columns(t):
        return [t.column(c).to_numpy() for c in ("gram", "doc_id", "lo", "before", "more")] + [t.column("raw").to_pylist()]

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        for part, rest in _whole(t):
            found = work(*columns(part))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc_id", "a", "b"])
    if rest is not None and rest.num_rows:
        found = work(*columns(rest))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc_id", "a", "b"])


def _whole(t: pa.Table):
    """Runs of some thousand rows that end where a gram does; the last gram's rows are the rest."""
    g = t.column("gram").to_numpy()
    cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
    at = 0
    for c in cuts:
        if c - at >= 4000 or c == cuts[-1]:
            yield t.slice(at, c - at), t.slice(c)
            at = c
    if not len(cuts):
        yield t.slice(0, 0), t


def _windows(batches):
    """A row for each window of regions of crowded anchors, with its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            doc, lo, more = (batch.column(c).slice(at, 256).to_numpy() for c in ("doc_id", "lo", "more"))
            raw = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), DEPTH) for x in batch.column("raw").slice(at, 256).to_pylist()]
            n = np.array([len(x) for x in raw])
            total = int(n.sum())
            j = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            window = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(np.arange(0, (total + 1) * DEPTH, DEPTH, dtype=np.int32)), pa.py_buffer(np.concatenate(raw))])
            yield pa.RecordBatch.from_arrays([window, pa.array(np.repeat(doc, n)), pa.array(np.repeat(lo, n) + j)], ["window", "doc_id", "a"])


def _removed(batches):
    for batch in batches:
        rows = []
        for i, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
            data = (text or "").encode()
            a, b = np.array([x["a"] for x in ranges or ()], np.int64), np.array([x["b"] for x in ranges or ()], np.int64)
            _, a, b = _merged(np.zeros(len(a), np.int64), a, b)
            digest, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist()):
                digest.update(data[at:x])
                at = y
            digest.update(data[at:])
            rows.append((i, len(data), int((b - a).sum()), len(a), digest.hexdigest()))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(ws: Workspace, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, a, b): byte ranges, maybe overlapping, whose union is what repeats; docs: one row per doc_id."""
    scanned = docs.mapInArrow(_scan, "gram long, part long, region long, doc_id long, place long, until long")
    told = scanned.repartition("gram", "part").sortWithinPartitions("gram", "part", "region", "doc_id", "place")
    told = ws.cut(told.mapInArrow(_classes, "kind byte, gram long, doc_id long, a long, b long"), free_shuffles=True)
    asked = told.where("kind = 2").groupBy("doc_id").agg(F.collect_list(F.struct("gram", "a")).alias("asked"))
    regions = docs.join(ws.cut(asked), "doc_id").select("doc_id", "text", "asked")
    regions = ws.cut(regions.mapInArrow(_regions, "gram long, doc_id long, lo long, before int, more int, raw binary"), free_shuffles=True)
    crowded = ws.cut(regions.groupBy("gram").count().where(F.col("count") > hot).select("gram"))
    usual = regions.join(crowded, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "doc_id", "lo")
    parts = [told.where("kind = 1").select("doc_id", "a", "b"), ws.cut(usual.mapInArrow(_sorted_windows, "doc_id long, a long, b long"))]
    if not crowded.isEmpty():
        windows = ws.cut(regions.join(crowded, "gram").mapInArrow(_windows, "window binary, doc_id long, a long"))
        first = ws.cut(windows.groupBy("window").agg(F.min(F.struct("doc_id", "a")).alias("first"), F.count("*").alias("n")).where("n > 1"))
        again = windows.join(first, "window").where(F.struct("doc_id", "a") != F.col("first"))
        parts.append(again.select("doc_id", "a", (F.col("a") + DEPTH).alias("b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = ws.cut(out, free_shuffles=True)
    ws.drop(told, regions)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Removed is each byte covered by a 100-byte string that also starts earlier: in a document of
    smaller id, or before in the same one. Texts are UTF-8 of any length; null is empty, and texts
    under 100 bytes keep all. Rows without an id match nothing and keep all. Of rows that repeat an id the one with the smallest text
    counts. An empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = one_row_per_key(every, "doc_id")
    ranges = repeated_ranges(ws, rows, hot).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    ranges = ws.cut(ranges, free_shuffles=True)
    none = every.where("doc_id is null").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
    both = rows.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").unionByName(none)
    return both.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
