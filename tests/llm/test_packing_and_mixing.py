import hashlib
import re
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runstore.llm import mixing as M
from runstore.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def unpacked(pieces, rows, tokenizer):
    """Check every piece against the tokens of its document; returns the share of padding."""
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    for i, own in groupby(sorted(pieces, key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids[i]) and 0 < r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids.pop(i))
    assert not ids
    n = used = 0
    for _, own in groupby(sorted(pieces, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 1024
        n, used = n + 1, used + at
    return 1 - used / (1024 * n)


def test_round_trip(docs, corpus, tokenizer):
    pieces = P.pack(docs).collect()
    assert unpacked(pieces, corpus, tokenizer) < 0.05
    assert all(set(r.asDict()) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} for r in pieces[:1])


def test_ids_are_the_tokenizers(tokenizer):
    encode = P._encoder(None, None)
    for text in ("", " a  b\n\n\tc ", "naïve <|endoftext|> text", "I'll DON'T we've", "🙂👨‍👩‍👧 日本語 ٣", "\x00\x1c", "a" * 5000, " " * 3000):
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents_are_the_tokenizers(tokenizer):
    encode = P._encoder(None, None)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(list(encode(t)) == w.ids for t, w in zip(texts, want))


def test_odd_ids_and_empty_table(spark, nothing):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = P.pack(df).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 3), ("1", 3), ("2", 1), ("None", 2)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4 and P.pack(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, P.CLASSES), st.integers(0, 3000), max_size=40))
def test_plans_use_up_the_histogram(h):
    counts = np.zeros(P.CLASSES + 1, np.int64)
    for c, n in h.items():
        counts[c] = n
    used = np.zeros_like(counts)
    for pattern, n in P.plan(counts):
        assert n > 0 and sum(pattern) <= P.CLASSES and list(pattern) == sorted(pattern, reverse=True)
        for c in pattern:
            used[c] += n
    assert (used == counts).all()


def test_solution_is_near_the_best():
    r = np.random.default_rng(1)
    combos = [(c, P.CLASSES - c) for c in range(1, P.CLASSES // 2 + 1)]
    truth = r.integers(0, 500, len(combos))
    counts = np.zeros(P.CLASSES + 1)
    for (a, b), n in zip(combos, truth):
        counts[a] += n
        counts[b] += n
    x = P.solve(combos, counts)
    assert (x >= 0).all() and np.abs(x - truth).max() < 1


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 500), st.lists(st.tuples(st.sampled_from([0.0, 0.5, 1.0, 2.0, 7.0]), st.integers(0, 200)), max_size=6))
def test_shares(amount, children):
    weights, limits = [c[0] for c in children], [c[1] for c in children]
    got = M.share_out(amount, weights, limits)
    open_ = [i for i in range(len(got)) if weights[i] > 0]
    assert all(0 <= g <= x for g, x in zip(got, limits)) and sum(got) == min(amount, sum(limits[i] for i in open_))
    # who isn't at the limit has the same share for a weight, but for rounding
    rates = [(got[i] / weights[i], 1.01 / weights[i]) for i in open_ if got[i] < limits[i]]
    assert all(abs(a - b) <= x + y for a, x in rates for b, y in rates)


def test_shortages_go_to_brothers_first():
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}
    got = M.leaf_budgets(tokens, {("a",): 1.0, ("b",): 1.0}, 600, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 290, ("b", "x"): 300}
    tokens[("a", "y")] = 100  # now all of a lacks, and b takes over
    assert M.leaf_budgets(tokens, {}, 600, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 490}


def brute_mix(rows, weights, budget, seed, epochs):
    """(doc_id, epoch) pairs, by plain sorting; rows: (doc_id, leaf, tokens)."""
    tokens = {}
    for _, leaf, n in rows:
        tokens[leaf] = tokens.get(leaf, 0) + n
    out = []
    for leaf, b in M.leaf_budgets(tokens, weights, budget, epochs).items():
        own, left, epoch = [(i, n) for i, x, n in rows if x == leaf], b, 0
        key = lambda i: hashlib.md5(f"{seed}:{epoch}:{'' if i is None else i}".encode()).hexdigest()  # noqa: E731, B023
        while tokens[leaf] and left >= tokens[leaf]:
            out += [(i, epoch) for i, _ in own]
            left, epoch = left - tokens[leaf], epoch + 1
        if left:
            for _, same in groupby(sorted(own, key=lambda r: key(r[0])), key=lambda r: key(r[0])):
                same = list(same)
                left -= sum(n for _, n in same)
                if left < 0:
                    break
                out += [(i, epoch) for i, _ in same]
    return sorted(out, key=str)


@pytest.mark.parametrize("per_bucket", [M.PER_BUCKET, 2])
def test_mix_like_brute_force(docs, corpus, monkeypatch, per_bucket):
    monkeypatch.setattr(M, "PER_BUCKET", per_bucket)
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {("en",): 3.0, ("en", "src1"): 0.5, ("", "src2"): 9.0}
    rows = [(i, ("en" if i % 2 else "", f"src{i % 3}"), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in corpus]
    total = sum(n for _, _, n in rows)
    for share, epochs in ((0.3, 1), (1.0, 1), (1.4, 3)):
        got = M.mix_sources(docs, levels, weights, share, seed=4, epochs=epochs)
        assert got.columns == [*docs.columns, "_mix"]
        assert sorted([(r.doc_id, r._mix.epoch) for r in got.collect()], key=str) == brute_mix(rows, weights, round(share * total), 4, epochs)


def test_mix_odd_rows(spark, nothing):
    df = spark.createDataFrame([(1, "a b", None), (1, "c d", None), (None, "e", "x"), (3, None, "x"), (4, "", "x")], "doc_id long, text string, lang string")
    levels = {"lang": F.col("lang")}
    assert M.mix_sources(df, levels, {}, 1.0).count() in (4, 5) and M.mix_sources(df, levels, {}, 0).count() == 0
    assert {r.doc_id for r in M.mix_sources(df, levels, {}, 2, seed=1).collect()} <= {1, None, 3, 4}
    assert M.mix_sources(nothing, levels, {}, 0.5).count() == 0


def test_mix_with_clashing_names(spark):
    names = ["_mix", "_leaf", "_whole", "_last", "_epoch", "row", "leaf", "epoch", "tokens", "key", "part", "ident", "last"]
    rows = [(i, "a b c d", *[f"{n}{i}" for n in names]) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = M.mix_sources(df, {"domain": F.col("doc_id") % 2}, {}, 0.5, as_col="chosen")
    assert out.columns == [*df.columns, "chosen"]
    got = out.collect()
    assert len(got) == 14 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    gone = M.mix_sources(df, {"domain": F.col("doc_id") % 2}, {}, 0.5)  # a column of the result's name gives way
    assert sorted(gone.columns) == sorted(df.columns) and {r._mix.tokens for r in gone.collect()} == {4}


def test_mix_finds_bounds_in_levels(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), "s") for i in range(3000)] + [(None, "x y", "s")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = None
    for per_bucket in (10**6, 100, 0.01):  # no level, one, three
        monkeypatch.setattr(M, "PER_BUCKET", per_bucket)
        got = sorted([(str(r.doc_id), r._mix.epoch) for r in M.mix_sources(df, {"source": F.col("source")}, {}, 1.4, seed=3, epochs=2).collect()])
        want = want or got
        assert got == want and 3500 < len(got) < 7000
