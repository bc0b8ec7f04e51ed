"""Document quality: histogram gradient-boosted trees over statistics of whole texts.

Statistics come from numpy passes over the bytes. Trees are grown on binned values, level by level,
on the driver from a bounded sample of labelled rows, and flattened into arrays, which batches walk
with numpy for all rows and trees at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .textnum import SLICE_BYTES, pieces, slices, word_bounds, word_hashes

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "digit", "punct", "odd_punct", "high", "space",
    "lines", "line_words", "short_lines", "ends_in_stop", "distinct", "repeats", "top_word", "odd_end", "capital_words",
    "upper_words", "short_words", "long_words", "lone_punct", "distinct_lines", "pipes",
)
#: At most so many labelled rows are learned from: those of the smallest seeded hash of their id.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 60, 4, 0.2, 5.0, 1.0
_mask = lambda chars: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))
UPPER, LOWER, DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("0123456789")
HIGH = np.arange(256) >= 128
SPACE = _mask(" \t\n\v\f\r")
USUAL = _mask(".,;:'\"-()?")
PUNCT = ~(UPPER | LOWER | DIGIT | HIGH | SPACE)
ODD = PUNCT & ~USUAL
STOP = _mask(".!?:\"'")


#: What is counted in a text: sums that add up over its pieces, then three that don't.
COUNTS = (
    "bytes", "words", "length", "square", "upper", "digit", "punct", "odd", "high", "space", "breaks", "stop", "again",
    "odd_end", "capital", "upper_words", "short_words", "long_words", "lone", "full", "short_lines", "pipes",
    "distinct", "most", "distinct_lines",
)


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of COUNTS for each text; and all hashes of words and of lines."""
    s, e, first = word_bounds(data, offsets)
    n_texts = len(offsets) - 1
    if not len(s):
        return np.zeros((n_texts, len(COUNTS))), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets])
    wsums = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[first])
    length = (e - s).astype(float)
    h = word_hashes(data, s, e)
    own = np.repeat(np.arange(n_texts), np.diff(first))
    # Distinct words and the commonest word's share
    order = np.lexsort((h, own))
    ho, oo = h[order], own[order]
    new = np.ones(len(ho), bool)
    new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n_texts)
    np.maximum.at(most, oo[at], np.diff(np.append(at, len(ho))))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    # Lines
    breaks = data == 10
    stop = np.zeros(len(data), bool)
    stop[1:] = breaks[1:] & STOP[data[:-1]]
    stop[offsets[:-1][offsets[:-1] < len(data)]] = False  # what ends the text before doesn't count
    line_of = np.concatenate([[0], np.cumsum(breaks)])[s]
    line_new = np.ones(len(s), bool)
    line_new[1:] = (line_of[1:] != line_of[:-1]) | (own[1:] != own[:-1])
    la = np.flatnonzero(line_new)
    line_words = np.diff(np.append(la, len(s)))
    line_own = own[la]
    with np.errstate(over="ignore"):
        line_hash = np.add.reduceat(h * (np.arange(len(h)).astype(np.uint64) - np.repeat(la, line_words).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), la)
    lo = np.lexsort((line_hash, line_own))
    line_first = np.ones(len(lo), bool)
    line_first[1:] = (line_hash[lo][1:] != line_hash[lo][:-1]) | (line_own[lo][1:] != line_own[lo][:-1])
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(UPPER[data] | LOWER[data] | HIGH[data])])
    up, let = upper[e] - upper[s], letters[e] - letters[s]
    count = lambda x, w=None: np.bincount(x, w, n_texts)
    out = np.stack([
        np.diff(offsets), np.diff(first), wsums(length), wsums(length**2), sums(UPPER[data]), sums(DIGIT[data]), sums(PUNCT[data]),
        sums(ODD[data]), sums(HIGH[data]), sums(SPACE[data]), sums(breaks), sums(stop), wsums(again), wsums(ODD[data[e - 1]]),
        wsums(UPPER[data[s]]), wsums((up == let) & (let > 1)), wsums(length <= 2), wsums(length >= 16), wsums(let == 0),
        count(line_own), count(line_own, line_words <= 4), sums(data == 124), count(oo[at]), most, count(line_own[lo][line_first]),
    ], 1).astype(float)
    return out, h, line_hash


def _long_counts(data: np.ndarray) -> np.ndarray:
    """COUNTS of a text of any length, piece by piece; a line cut by a piece's end counts as two."""
    total, words, lines = np.zeros((1, len(COUNTS))), [], []
    for a, b in pieces(data):
        own, h, line = _counts(data[a:b], np.array([0, b - a]))
        total += own
        words.append(h), lines.append(line)
    h = np.sort(np.concatenate(words))
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    total[0, -3:] = len(at), np.diff(np.append(at, len(h))).max(initial=0), len(np.unique(np.concatenate(lines)))
    return total


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts, and those without words, have zeros."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for row, data, offsets in slices(texts):
        long = len(offsets) == 2 and len(data) > 2 * SLICE_BYTES
        c = dict(zip(COUNTS, (_long_counts(data) if long else _counts(data, offsets)[0]).T))
        some, per, full, lines = np.maximum(c["bytes"], 1), np.maximum(c["words"], 1), np.maximum(c["full"], 1), c["breaks"] + 1
        mean = c["length"] / per
        block = np.stack([
            np.log1p(c["bytes"]), np.log1p(c["words"]), mean, np.sqrt(np.maximum(c["square"] / per - mean**2, 0)),
            c["upper"] / some, c["digit"] / some, c["punct"] / some, c["odd"] / some, c["high"] / some, c["space"] / some,
            np.log1p(lines), c["words"] / full, c["short_lines"] / full, c["stop"] / lines, c["distinct"] / per, c["again"] / per,
            c["most"] / per, c["odd_end"] / per, c["capital"] / per, c["upper_words"] / per, c["short_words"] / per,
            c["long_words"] / per, c["lone"] / per, c["distinct_lines"] / full, c["pipes"] / per,
        ], 1)
        block[c["words"] == 0] = 0
        out[row : row + len(block)] = block
    return out


@dataclass
class Forest:
    """Full binary trees of one depth: feature and threshold by node, value by leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(math.log2(self.leaf.shape[1])) if self.leaf.size else 0):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = np.full(len(x), self.base)
        if self.leaf.size:
            total += self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0 and 1. Without both labels the score is the labels' mean (1/2 if none)."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(mean / (1 - mean))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 0)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for c in x.T]
    # value > cuts[k] goes right of cut k: the bin is the number of cuts under the value
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    n, f = bins.shape
    flat = bins + np.arange(f) * BINS
    limit = np.array([len(c) for c in cuts])
    inner, raw = 2**DEPTH - 1, np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feat, thr, node = np.zeros(inner, int), np.full(inner, np.inf, np.float32), np.zeros(n, int)
        for depth in range(DEPTH):
            width, start = 2**depth, 2**depth - 1
            at = ((node - start)[:, None] * (f * BINS) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            ok = (hl >= LEAST / 20) & (ht - hl >= LEAST / 20) & (np.arange(BINS)[None, None, :] < limit[None, :, None])
            gain = np.where(ok, gain, -1).reshape(width, -1)
            pick = gain.argmax(1)
            for k in range(width):
                if gain[k, pick[k]] > 1e-6:
                    feat[start + k] = pick[k] // BINS
                    thr[start + k] = cuts[pick[k] // BINS][pick[k] % BINS]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = RATE * gs / (hs + RIDGE)
        raw = raw + value[leaf]
        features.append(feat), thresholds.append(thr), leaves.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)


def held_out(column) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text is 1 modulo 3. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def _fit(docs: DataFrame, labels: DataFrame, sample: int) -> Forest:
    """A forest from at most ``sample`` labelled ids; each distinct (id, label) counts once, and of
    rows that repeat an id the one of the smallest statistics.

    The sample is bounded, so it is sent to the documents, and only theirs are measured here.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    known = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "quality").limit(sample)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(2))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["doc_id", "quality", "x"])

    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<float>")
    # a row for each id, however often it is repeated
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.stack(rows.x.to_list()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return fit_forest(x, rows.quality.to_numpy(float))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, from its whole text only.

    A forest is fitted to ``labels`` (doc_id, quality) of rows that aren't held out, at most
    ``sample`` of them. Null and empty texts get the score of all-zero statistics; texts may be of
    any length (a line of over 1 MB may count as several). Rows give rows,
    repeated and null ids too (a null id is held out); without labels the score is one half.
    """
    rows = _rows(docs, id_col, text_col)
    forest = _fit(rows, labels, sample)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(statistics(batch.column(1))))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``least`` or more."""
    forest = _fit(_rows(docs, id_col, text_col), labels, sample)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(forest.scores(statistics(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
