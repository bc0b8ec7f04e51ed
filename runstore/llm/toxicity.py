"""Toxicity by a classifier chain of linear models over the words of whole texts.

Categories are predicted one after another; each model sees a text's telling words, its length and
the probabilities of the categories before it. In training these are out-of-fold predictions, so that
a later model learns how far it may trust an earlier one: each fold's words are chosen and its models
fitted without it, and near copies stand in one fold. Words are runs of letters, whatever punctuation
or case they are dressed in; beginnings of words and pairs of neighbours count as words. The last
category is the label ``toxic``; those before it are kinds of toxic rows, found in the labelled rows
themselves: groups by which telling words occur together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .textnum import SLICE_BYTES, mix, pieces, shingle_sets, slices, word_bounds, word_hashes
from .workspace import Workspace, one_row_per_key

KINDS = 3
CATEGORIES = (*(f"kind{k + 1}" for k in range(KINDS)), "toxic")
#: At most so many labelled rows are learned from: those of the smallest seeded hash of their id.
SAMPLE = 10_000
#: A telling word stands in so many rows, and is so many standard deviations from the rate of all rows.
LEAST_ROWS, LEAST_DEVIATIONS = 4, 5.0
FOLDS, STEPS, RATE, PENALTY, ROUNDS = 5, 150, 0.3, 1e-4, 20
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = False
NOT_LETTER[128:] = False


PREFIXES = (4, 5, 6, 7)
_rng = np.random.Generator(np.random.PCG64(23))
PREFIX_CODES = dict(zip(PREFIXES, _rng.integers(1, 1 << 63, len(PREFIXES), dtype=np.uint64)))
PAIR_CODES = _rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
SKETCH_CODES = _rng.integers(1, 1 << 63, 4, dtype=np.uint64)


def _features(data: np.ndarray, offsets: np.ndarray):
    """Text and hash of every word, beginning of a longer word, and pair of words, repeats included."""
    s, e, first = word_bounds(data, offsets, NOT_LETTER)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = word_hashes(data, s, e)
    yield own, h
    for n, code in PREFIX_CODES.items():
        long = e - s > n
        yield own[long], mix(word_hashes(data, s[long], s[long] + n) ^ code)
    near = own[1:] == own[:-1]
    yield own[1:][near], mix(h[:-1][near] * PAIR_CODES[0] + h[1:][near] * PAIR_CODES[1])


def _parts(data: np.ndarray, offsets: np.ndarray):
    """The slice, or its only text in pieces; each starts with the last word of the one before, for the pair of both."""
    if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
        yield data, offsets
        return
    back = 0
    for a, b in pieces(data):
        part = data[a - back : b]
        yield part, np.array([0, len(part)])
        s, _, _ = word_bounds(part, np.array([0, len(part)]), NOT_LETTER)
        back = len(part) - int(s[-1]) if len(s) and len(part) - s[-1] < SLICE_BYTES else 0


def _distinct(own: np.ndarray, h: np.ndarray):
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[new], h[new]


def distinct_words(texts: pa.Array):
    """For slices of texts: first row, number of texts, and the text and hash of each distinct feature."""
    for row, data, offsets in slices(texts):
        own, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for part in _parts(data, offsets):
            for more_own, more in _features(*part):
                own, h = _distinct(np.concatenate([own, more_own]), np.concatenate([h, more]))
        yield row, len(offsets) - 1, own, h


def known_words(texts: pa.Array, vocabulary: np.ndarray):
    """Text and place in the sorted ``vocabulary``, for each distinct feature of each text that is in it."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    top = np.zeros(1 << 16, bool)
    top[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    for row, data, offsets in slices(texts) if len(vocabulary) else ():
        mine = []
        for part in _parts(data, offsets):
            for own, h in _features(*part):
                maybe = top[(h >> np.uint64(48)).astype(np.int64)]
                own, h = _distinct(own[maybe], h[maybe])
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[at] == h
                mine.append((own[hit], at[hit]))
        own, at = _distinct(*(np.concatenate(x) for x in zip(*mine)))  # pieces of a text may share words
        rows.append(row + own), cols.append(at)
    return np.concatenate(rows), np.concatenate(cols)


@dataclass
class Linear:
    """Logistic regression on present words and dense columns."""

    words: np.ndarray
    dense: np.ndarray
    base: float

    def scores(self, n: int, row, col, dense: np.ndarray) -> np.ndarray:
        z = self.base + np.bincount(row, self.words[col], n)[:n] + dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(n: int, row, col, width: int, dense: np.ndarray, y: np.ndarray) -> Linear:
    """Penalised likelihood by Adam over all rows; without both labels, a constant."""
    rate = (y.sum() + 0.5) / (n + 1)
    m = Linear(np.zeros(width), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
    if n == 0 or y.min() == y.max():
        return m
    w = np.zeros(width + dense.shape[1] + 1)
    w[-1] = m.base
    mean, var = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        m.words, m.dense, m.base = w[:width], w[width:-1], w[-1]
        d = m.scores(n, row, col, dense) - y
        g = np.concatenate([np.bincount(col, d[row], width), dense.T @ d, [d.sum()]]) / n
        g[:-1] += PENALTY * w[:-1]
        mean += 0.1 * (g - mean)
        var += 0.01 * (g * g - var)
        w = w - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-9)
    m.words, m.dense, m.base = w[:width], w[width:-1], float(w[-1])
    return m


def lengths(texts: pa.Array) -> np.ndarray:
    """The logarithm of each text's bytes, as a column near 0: long texts hold some telling words by chance."""
    out = np.zeros((len(texts), 1))
    for row, _, offsets in slices(texts):
        out[row : row + len(offsets) - 1, 0] = np.log1p(np.diff(offsets)) / 2 - 3.5
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


@dataclass
class Chain:
    vocabulary: np.ndarray
    models: list[Linear]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A row for each text, a column for each category."""
        row, col = known_words(texts, self.vocabulary)
        dense, out = lengths(texts), np.zeros((len(texts), len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = m.scores(len(texts), row, col, dense)
            dense = np.hstack([dense, _logit(out[:, k : k + 1])])
        return out


def kinds(n: int, row: np.ndarray, col: np.ndarray, width: int, toxic: np.ndarray) -> np.ndarray:
    """A kind (0 to KINDS - 1) for each toxic row by its words, -1 for all other rows: spherical k-means from far-off starts.

    Kind 0 is the most frequent, and so on.
    """
    out = np.full(n, -1)
    mine = np.flatnonzero((toxic == 1) & (np.bincount(row, minlength=n)[:n] > 0))
    if not len(mine) or not width:
        return out
    place = np.full(n, -1)
    place[mine] = np.arange(len(mine))
    use = place[row] >= 0
    x = np.zeros((len(mine), width), np.float32)
    x[place[row[use]], col[use]] = 1
    x /= np.sqrt(np.maximum(x.sum(0), 1))  # words that many have tell less of a kind
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = [int((x @ x.sum(0)).argmax())]
    for _ in range(KINDS - 1):
        at.append(int((x @ x[at].T).max(1).argmin()))
    centre = x[at]
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(1)
        centre = np.stack([x[own == k].sum(0) if (own == k).any() else centre[k] for k in range(KINDS)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    order = np.argsort(-np.bincount(own, minlength=KINDS), kind="stable")
    out[mine] = np.argsort(order)[own]
    return out


def fit_chain(n: int, row: np.ndarray, col: np.ndarray, vocabulary: np.ndarray, chosen: np.ndarray, toxic: np.ndarray, fold: np.ndarray, length: np.ndarray) -> Chain:
    """``row`` and ``col``: the places in ``vocabulary`` of each row's words. ``chosen``: a row for each
    fold that tells the words chosen without it, and a last one for those chosen from all rows."""
    telling = chosen[-1][col]
    kind = kinds(n, row[telling], col[telling], len(vocabulary), toxic)
    labels = [(kind == k).astype(float) for k in range(KINDS)] + [toxic]
    dense, models = length, []
    for y in labels:
        models.append(fit_linear(n, row[telling], col[telling], len(vocabulary), dense, y))
        out = np.zeros(n)
        for f in range(FOLDS):
            own, rest = fold == f, fold != f
            number = np.cumsum(rest) - 1
            known = chosen[f][col]
            use = rest[row] & known
            m = fit_linear(int(rest.sum()), number[row[use]], col[use], len(vocabulary), dense[rest], y[rest])
            out[own] = m.scores(n, row[known], col[known], dense)[own]
        dense = np.hstack([dense, _logit(out[:, None])])
    return Chain(vocabulary, models)


def folds(ids: np.ndarray, sketches: list) -> np.ndarray:
    """A fold for each row; rows that share a number of their sketches at the same place, and rows of one id, are in one."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[tuple, int] = {}
    for i, (own, sketch) in enumerate(zip(ids.tolist(), sketches)):
        for name in [(-1, own), *enumerate(() if sketch is None else map(int, sketch))]:
            j = first.setdefault(name, i)
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = np.array([find(i) for i in range(len(ids))], np.int64)
    return (mix(ids[groups].astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def _sketches(batches):
    """(doc_id, toxic, sketch): the least of each row's five-word shingles in some orders."""
    for b in batches:
        out = [np.array([mix(own ^ c).min() for c in SKETCH_CODES], np.uint64).view(np.int64) if len(own) else None for own in shingle_sets(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "toxic", "sketch"])


def _counts(batches):
    """(word, fold, seen, bad) of rows (doc_id, toxic, text, fold)."""
    for b in batches:
        toxic, fold = b.column(1).to_numpy(), b.column(3).to_numpy()
        for row, _, own, h in distinct_words(b.column(2)):
            words, place = np.unique(h, return_inverse=True)
            key, at = np.unique(place * FOLDS + fold[row + own], return_inverse=True)
            bad = np.bincount(at, toxic[row + own], len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words[key // FOLDS].view(np.int64)), pa.array(key % FOLDS), pa.array(np.bincount(at, minlength=len(key))), pa.array(bad)], ["word", "fold", "seen", "bad"])


def _fit(ours: DataFrame) -> Chain:
    """A chain from labelled rows (doc_id, toxic, text), whose number is bounded."""
    spark = ours.sparkSession
    seen = ours.mapInArrow(_sketches, "doc_id long, toxic int, sketch array<long>").toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    ids, toxic = seen.doc_id.to_numpy(np.int64), seen.toxic.to_numpy(float)
    fold = folds(ids, list(seen.sketch))
    dealt = ours.join(F.broadcast(spark.createDataFrame(list(dict(zip(ids.tolist(), fold.tolist())).items()), "doc_id long, fold long")), "doc_id")
    counted = dealt.select("doc_id", "toxic", "text", "fold").mapInArrow(_counts, "word long, fold long, seen long, bad long")
    sums, tests = [], []
    for f in range(FOLDS + 1):  # all rows but a fold; at last all rows
        of = (lambda c: F.sum(c)) if f == FOLDS else (lambda c: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)))  # noqa: B023
        sums += [of("seen").alias(f"seen{f}"), of("bad").alias(f"bad{f}")]
        use = fold != f
        rate = toxic[use].mean() if use.any() else 0.0
        z = (F.col(f"bad{f}") - F.col(f"seen{f}") * rate) / F.sqrt(F.greatest(F.col(f"seen{f}"), F.lit(1)) * max(rate * (1 - rate), 1e-9))
        tests.append((F.col(f"seen{f}") >= LEAST_ROWS) & (F.abs(z) >= LEAST_DEVIATIONS))
    words = counted.groupBy("word").agg(*sums).select("word", F.array(*tests).alias("chosen")).where(F.exists("chosen", lambda c: c)).toPandas().sort_values("word", kind="stable")
    hashes = words.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    vocabulary, chosen = hashes[order], np.array(words.chosen.to_list(), bool).reshape(-1, FOLDS + 1)[order].T

    def places(batches):
        for b in batches:
            row, col = known_words(b.column(2), vocabulary)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(col[order].astype(np.int32))), pa.array(lengths(b.column(2))[:, 0])], ["doc_id", "toxic", "col", "length"])

    got = ours.mapInArrow(places, "doc_id long, toxic int, col array<int>, length double").toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    col = np.concatenate([np.zeros(0, np.int64), *got.col]).astype(np.int64)
    row = np.repeat(np.arange(len(got)), [len(x) for x in got.col]) if len(got) else col
    return fit_chain(len(got), row, col, vocabulary, chosen, toxic, fold, got.length.to_numpy(float).reshape(-1, 1))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, a probability for each category, predicted, for each row of ``docs``.

    A chain is fitted to ``labels`` (doc_id, toxic) of rows that aren't held out, at most ``sample``
    of them; of rows that repeat a labelled id the one with the smallest text is learned from.
    Telling words are counted on the executors; the driver gets those of the labelled rows that pass
    the test, and which of these each row has. Null and empty texts have no words; texts may be of
    any length. Rows give rows, repeated and null ids too (a null id is held out); without labels the
    probabilities are one half. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    known = ws.cut(known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "toxic").limit(sample))
    # at most ``sample`` ids are sent to the documents; their texts are read from one small table from here on
    texts = one_row_per_key(ws.cut(rows.join(F.broadcast(known.select("doc_id").distinct()), "doc_id")), "doc_id")
    chain = _fit(ws.cut(texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")))

    def run(batches):
        for b in batches:
            p = chain.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(len(CATEGORIES))]], ["doc_id", *CATEGORIES])

    scored = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *CATEGORIES, (F.col("toxic") >= 0.5).cast("int").alias("predicted"))
