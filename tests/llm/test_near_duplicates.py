import random
import re

import numpy as np

from runstore.llm import near_duplicates as N
from runstore.llm.textnum import shingle_sets
import pyarrow as pa


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_like_brute_force(docs, corpus):
    assert result(N.near_duplicates(docs)) == brute(corpus)


def test_small_blocks_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "BAND_BLOCK", 3)
    monkeypatch.setattr(N, "CHUNK", 2)
    assert result(N.near_duplicates(docs)) == brute(corpus)


def test_empty_table(nothing):
    out = N.near_duplicates(nothing)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "zz"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, None)]
    got = sorted([tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True), (7, 0, 7, True)], key=str)


def test_estimates_follow_jaccard():
    r = np.random.default_rng(1)
    for size in (6, 40, 3000):
        for j in (0.5, 0.75, 0.9):
            shared = round(2 * size * j / (1 + j))
            found = []
            for _ in range(60):
                x = r.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64) * np.uint64(2)
                a, b = np.sort(x[:size]), np.sort(x[size - shared :])
                found.append(N.estimates(N.registers(a)[None], N.registers(b)[None], np.array([size]), np.array([size]))[0])
            true = shared / (2 * size - shared)
            assert abs(np.mean(found) - true) < 0.05 and min(found) > true - N.MARGIN - 0.15 * (size < 10)


def test_registers_hold_zeros_and_mantissa():
    x = np.array([1 << 50, (3 << 60) | 5], np.uint64)
    regs = N.registers(x)
    # bucket 0 holds 1 << 50, whose bits after the bucket's 8 begin with 5 zeros; the mantissa is 0
    assert regs[0] == 5 << N.MANTISSA and len(regs) == N.BUCKETS and set(regs) == {regs[0], regs[0x30]}


def test_words_are_those_of_the_pattern(corpus):
    sets = list(shingle_sets(pa.array([t for _, t in corpus], pa.large_string())))
    assert [len(s) for s in sets] == [len(shingles(t)) for _, t in corpus]


def test_tiny_sets_that_sketches_lose(spark):
    """Texts of 8 and 7 words with 3 of 4 shingles in common, by seeds whose sketches stray too far."""
    rows = []
    for s in (297, 1243, 4894, 6992, 7446, 14285, 16233, 27191, 30634, 36854, 40495, 41538, 43382, 50755, 54187, 55479, 59688):
        rows += [(2 * s, " ".join(f"{s}x{k}" for k in range(8))), (2 * s + 1, " ".join(f"{s}x{k}" for k in range(7)))]
    rows += [(200_000 + k, " ".join(f"t{j}" for j in range(k, k + 12 + k % 4))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(N.near_duplicates(df)) == brute(rows)


def test_a_family_and_outliers_are_sent_in_proportion(spark, monkeypatch):
    """Texts of one large component meet outliers' blocks, and not each other again."""
    from runstore.llm.blocks import deal_blocks
    from runstore.llm.workspace import Workspace

    rows = [(1, 5, i) for i in range(2000)] + [(1, 10_000 + i, 10_000 + i) for i in range(30)] + [(2, 7, 90_003), (2, 8, 90_004)]
    df = spark.createDataFrame(rows, "cluster long, root long, doc_id long")
    dealt = deal_blocks(Workspace(spark), df, "cluster", "root", 100).collect()
    times = {}
    for r in dealt:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times[i] == 1 for i in range(2000)) and all(times[10_000 + i] == 21 for i in range(30))  # 20 blocks, and their own
    met = {}
    for r in dealt:
        met.setdefault((r.cluster, r.lo, r.hi), {}).setdefault(r.side, set()).add(r.doc_id)
    pairs = {(a, b) for sides in met.values() for a in sides.get(0, ()) for b in sides.get(1, sides.get(0, ()))}
    assert all((a, 10_000) in pairs or (10_000, a) in pairs for a in range(2000)) and ((90_003, 90_004) in pairs or (90_004, 90_003) in pairs)


def test_a_large_family_with_outliers(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "BAND_BLOCK", 6)
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(1 if i < 100 else 4):  # the last share less, some of them too little
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert result(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert 1 < sum(kept for _, _, kept in want.values()) < 25


def test_components_of_paths_stars_and_circles(spark):
    from runstore.llm.components import connected_components
    from runstore.llm.workspace import Workspace

    r = random.Random(2)
    path = list(range(100, 160))
    r.shuffle(path)
    edges = [*zip(path, path[1:]), *[(7, i) for i in range(200, 230)], (301, 302), (302, 303), (303, 301), (5, 5), (-3, 4), (4, 9)]
    roots = {r.node: r.root for r in connected_components(Workspace(spark), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 100 for i in range(100, 160)} | {i: 7 for i in (7, *range(200, 230))} | {301: 301, 302: 301, 303: 301} | {-3: -3, 4: -3, 9: -3}
    assert connected_components(Workspace(spark), spark.createDataFrame([], "u long, v long")).count() == 0
