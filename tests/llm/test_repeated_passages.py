import hashlib

import numpy as np
import pytest

from runstore.llm import repeated_passages as R


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - R.DEPTH + 1):
            w = b[s : s + R.DEPTH]
            if w in seen:
                gone[s : s + R.DEPTH] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot", [R.HOT, 1])
def test_like_brute_force(docs, corpus, hot):
    """With ``hot`` of 1 nearly every anchor takes the way for crowded ones."""
    assert result(R.remove_repeats(docs, hot=hot)) == brute(corpus)


def test_overlaps_boundaries_and_ties(spark):
    a = "".join(chr(97 + k * 7 % 26) + str(k) for k in range(60))
    rows = [(5, a), (3, a[:99]), (4, a[:100]), (9, "x" * 250), (8, a + a), (2, "y" + a[20:130])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(R.remove_repeats(df)) == brute(rows)


def test_odd_ids_and_empty_table(spark, nothing):
    text = "abcdefghij" * 30
    rows = [(None, text), (1, text), (1, text), (2, None)]
    got = [tuple(r) for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = brute([(1, text), (2, None)])
    assert sorted(got, key=str) == sorted([(None, 300, 0, 0, hashlib.sha256(text.encode()).hexdigest()), *[(i, *v) for i, v in want.items()]], key=str)
    assert R.remove_repeats(nothing).count() == 0


def test_radix_groups_are_the_equal_windows():
    r = np.random.default_rng(3)
    flat = r.integers(0, 2, 4000).astype(np.uint8)
    flat[2000:2400] = flat[100:500]
    start = r.permutation(3900)
    which, group = R.radix_groups(flat, start, np.zeros(3900, int))
    found = {}
    for w, g in zip(which, group):
        found.setdefault(g, set()).add(start[w])
    want = {}
    for s in start:
        want.setdefault(flat[s : s + 100].tobytes(), set()).add(s)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def ranges_of(rows, monkeypatch, piece):
    """Anchors by (doc_id, place, gram), and the windows that each governs, from a scan in pieces."""
    import pyarrow as pa

    monkeypatch.setattr(R, "PIECE", piece)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    out = {}
    for b in R._scan([batch]):
        for gram, doc, place, until in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "place", "until"))):
            assert until == 0
            p = place >> 16
            lo = p - ((place >> 8) & 255)
            out.setdefault((doc, p, gram), set()).update(range(lo, lo + (place & 255) + 1))
    return out


def test_pieces_hold_every_window_once(monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, bytes(r.integers(97, 123, n).astype(np.uint8)).decode()) for i, n in enumerate((5000, 0, 99, 100, 1000, 1001, 1099, 1901, 1902))]
    whole = ranges_of(rows, monkeypatch, 1 << 22)
    assert ranges_of(rows, monkeypatch, 1000) == whole
    assert sum(map(len, whole.values())) == sum(max(0, len(t) - R.DEPTH + 1) for _, t in rows)


def test_a_text_of_more_than_16_mb(spark):
    text = np.random.default_rng(7).bytes(9 << 20).hex()
    step = R.PIECE - R.DEPTH + 1
    again = text[step - 300 : step + 300] + "|" + text[-700:]
    text += "|" + text[5000:5400]
    n = len(text)
    assert n > 1 << 24
    df = spark.createDataFrame([(1, text), (2, again), (3, "short")], "doc_id long, text string")
    got = result(R.remove_repeats(df))
    kept = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (n, 400, 1, kept(text[:-400])), 2: (1301, 1300, 2, kept("|")), 3: (5, 0, 0, kept("short"))}


@pytest.mark.parametrize(("crowd", "rows_of_batch"), [(64, 1000), (2, 1000), (2, 5), (1, 1)])
def test_spread_anchors_lose_no_repeat(monkeypatch, crowd, rows_of_batch):
    """Tasks that spread an anchor, and tasks that don't, together find what brute force does."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(R, "CROWD", crowd)
    monkeypatch.setattr(R, "SPREAD", 4)
    r = random.Random(5)
    prose = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    line = "All rights are reserved by the owners of this very line of text, as ever."
    rows = [(i, prose(r.randrange(30, 90)) + line + prose(r.randrange(30, 90))) for i in range(40)]
    rows += [(40 + i, prose(20) + rows[3 * i][1][10:190] + prose(20)) for i in range(12)]
    rows += [(60 + i, rows[i][1]) for i in range(5)]
    parts = []
    for own in (rows[::3], rows[1::3][:4], rows[2::3], rows[1::3][4:]):  # one task each, some with few of them
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in own]), pa.array([t for _, t in own])], ["doc_id", "text"])
        parts += R._scan([batch])
    table = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("gram", "part", "region", "doc_id", "place")]).combine_chunks()
    assert (max(table.column("part").to_pylist()) > 0) == (crowd < 64)
    gone, asked = {i: set() for i, _ in rows}, {}
    for b in R._classes(table.to_batches(max_chunksize=rows_of_batch)):
        for kind, gram, doc, x, y in zip(*(b.column(k).to_pylist() for k in range(5))):
            if kind == 1:
                gone[doc].update(range(x, y))
            else:
                p = x >> 16
                asked.setdefault(gram, []).append((doc, p - ((x >> 8) & 255), x & 255))
    text = dict(rows)
    for regions in asked.values():
        seen = set()
        for doc, s in sorted({(doc, lo + j) for doc, lo, more in regions for j in range(more + 1)}):
            window = text[doc][s : s + R.DEPTH]
            if window in seen:
                gone[doc].update(range(s, s + R.DEPTH))
            seen.add(window)
    want = brute(rows)
    assert {i: len(x) for i, x in gone.items()} == {i: x[1] for i, x in want.items()} and sum(x[1] for x in want.values()) > 2000
