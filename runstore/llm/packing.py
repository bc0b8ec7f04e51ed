"""Packing documents into windows of tokens, by non-negative least squares over length combinations.

A document's ids are cut into whole windows and a rest. Lengths are counted in classes of ``GRID``
tokens, rounded up. The driver gets this histogram only (a row for each class), enumerates the
combinations of up to ``PARTS`` classes that fill a window, solves for how often to repeat each,
rounds down, and packs what is left over greedily, largest class first. Pieces then find their
sequence from their rank in their class: a rank within the task that cut them, plus the counts of
the tasks before it. No text or id is shuffled.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WINDOW, GRID, PARTS = 1024, 8, 3
CLASSES = WINDOW // GRID
STRETCH = 1 << 20  # characters given to the tokenizer at once
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, rank long"


@lru_cache(maxsize=4)
def _encoder(json_path: str | None, ranks_path: str | None):
    """A function from a text to its ids.

    The ranks hold the same vocabulary as the tokenizer's file, and give the same ids several times
    as fast; a text that holds a special token's string goes to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):  # they hold no space, so that no stretch cuts one
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _stretches(text: str):
    """A text in stretches that a tokenizer's pattern parts too: each ends before a space that follows another character."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.rfind(" ", at + 1, at + STRETCH)
        while cut > at and text[cut - 1].isspace():
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:  # none here: the first one after it
            cut = text.find(" ", at + STRETCH)
            while cut >= 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut
    yield text[at:]


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, json_path: str | None, ranks_path: str | None) -> DataFrame:
    """Pieces of whole windows and rests, ranked in their class within each task."""

    def run(batches):
        encode, seen, task = _encoder(json_path, ranks_path), [0] * (CLASSES + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = array("I")
                for stretch in _stretches(text or ""):
                    ids.extend(encode(stretch))
                ids.append(0)
                raw, n = ids.tobytes(), len(ids)
                for start in range(0, n, WINDOW):
                    length = min(WINDOW, n - start)
                    c = -(-length // GRID)
                    rows.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, c, task, seen[c]))
                    seen[c] += 1
            types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def solve(combos: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """How often to repeat each combination: least squares against ``counts``, none negative, by coordinates."""
    used = [sorted({c: combo.count(c) for c in combo}.items()) for combo in combos]
    rest, x, size = counts.astype(float).tolist(), [0.0] * len(combos), [sum(m * m for _, m in u) for u in used]
    total = max(1.0, float(counts.sum()))
    for _ in range(rounds):
        moved = 0.0
        for j, u in enumerate(used):
            step = max(-x[j], sum(m * rest[c] for c, m in u) / size[j])
            if step:
                x[j] += step
                moved += abs(step)
                for c, m in u:
                    rest[c] -= m * step
        if moved < 1e-4 * total:
            break
    return np.array(x)


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a sequence, largest first; how many such sequences), which use up ``counts`` exactly."""
    left, out = counts.astype(np.int64).copy(), []
    combos = [c for k in range(1, PARTS + 1) for c in combinations_with_replacement(range(1, CLASSES + 1), k) if sum(c) == CLASSES and all(counts[i] for i in c)]
    x = solve(combos, counts) if combos else np.zeros(0)
    for j in np.argsort(-x, kind="stable"):
        classes, need = np.unique(combos[j], return_counts=True)
        n = int(min(np.floor(x[j] + 1e-9), (left[classes] // need).min()))
        if n > 0:
            left[classes] -= n * need
            out.append((tuple(sorted(combos[j], reverse=True)), n))
    while left.any():
        room, pattern = CLASSES, []
        for c in np.flatnonzero(left)[::-1]:
            m = int(min(room // c, left[c]))
            pattern += [int(c)] * m
            room -= m * int(c)
        classes, need = np.unique(pattern, return_counts=True)
        n = int((left[classes] // need).min())
        left[classes] -= n * need
        out.append((tuple(pattern), n))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most 1024 tokens. A null or empty text is its closing id 0 alone. Each row is
    a document of its own, repeated and null ids too; texts may be of any length. An empty table gives no piece; other columns
    are ignored. ``json_path`` and ``ranks_path`` name the vocabulary's files.
    """
    ws = Workspace(docs.sparkSession)
    pieces = ws.cut(cut_pieces(docs, id_col, text_col, json_path, ranks_path))
    by_task = ws.cut(pieces.groupBy("class", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(CLASSES + 1, np.int64)
    for r in by_task.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row for each class
        counts[r["class"]] = r.n
    before = ws.cut(by_task.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n")).drop("n"))
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, base = np.zeros(CLASSES + 1, np.int64), 0
    for pattern, n in plan(counts):
        for c in dict.fromkeys(pattern):
            m = pattern.count(c)
            ranges.setdefault(c, []).append((int(taken[c]), base, m, pattern.index(c)))
            taken[c] += n * m
        base += n
    lookup = {c: tuple(np.array(col, np.int64) for col in zip(*rows)) for c, rows in ranges.items()}

    def place(batches):
        for batch in batches:
            cls, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("class", "rank"))
            sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int32)
            for c in np.unique(cls):
                first, start, many, at = lookup[int(c)]
                own = np.flatnonzero(cls == c)
                k = np.searchsorted(first, rank[own], "right") - 1
                i = rank[own] - first[k]
                sequence[own], slot[own] = start[k] + i // many[k], at[k] + i % many[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], [*batch.schema.names[:5], "sequence_id", "slot"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = pieces.join(before, ["class", "task"]).select(*names, "class", (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot int")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))
