"""Quality and toxicity."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from runstore.llm import quality as Q
from runstore.llm import toxicity as X
from .conftest import prose


def made(n, seed):
    """Clean prose, and junk of three kinds; some texts hold an insult."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text, good, toxic = prose(r, r.randrange(20, 120)), 1, 0
        if i % 4 == 0:
            k, good = i % 3, 0
            text = " ".join(w + r.choice(("%%%", "$$$")) for w in text.split()) if k == 0 else " ".join(w.upper() + "!!" for w in text.split()) if k == 1 else " ".join(w for w in text.split()[:9] for _ in range(12))
        if i % 5 == 0:
            words, toxic = text.split(), 1
            words[r.randrange(len(words))] = r.choice(("idiot", "Stupid", "moron!!", "worthless%%%", "scum."))
            text = " ".join(words)
        rows.append((i, text, good, toxic))
    return rows


def tables(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark):
    rows = made(900, 1)
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in Q.score_quality(docs, labels).collect()}
    assert len(got) == 900 and all(got[i].held_out == held(i) for i, *_ in rows)
    out = [(got[i].predicted, good) for i, _, good, _ in rows if held(i)]
    assert np.mean([a == b for a, b in out]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    # labels of held-out rows are never learned from
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert {r.doc_id: r.score for r in Q.score_quality(docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    kept = {r.doc_id for r in Q.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_toxicity_on_held_out_rows(spark):
    rows = made(1500, 2)
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in X.score_toxicity(docs, labels).collect()}
    out = [(got[i].predicted, t) for i, _, _, t in rows if held(i)]
    assert np.mean([a == b for a, b in out]) >= 0.97
    assert all(0 <= r[c] <= 1 for r in got.values() for c in X.CATEGORIES)


def learned(rows):
    """What the operator gathers from the executors, from one batch: word places, choices by fold, folds."""
    ids, texts, toxic = np.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.large_string()), np.array([float(r[3]) for r in rows])
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(toxic.astype(np.int32)), texts], ["doc_id", "toxic", "text"])
    sketches = [x for b in X._sketches([batch]) for x in b.column(2).to_pylist()]
    fold = X.folds(ids, [None if x is None else np.array(x) for x in sketches])
    counted = [b.to_pandas() for b in X._counts([batch.append_column("fold", pa.array(fold))])]
    seen = {}
    for t in counted:
        for w, f, s, b in t.itertuples(index=False):
            x = seen.setdefault(w, np.zeros((2, X.FOLDS)))
            x[:, f] += s, b
    words = np.array(sorted(seen, key=lambda w: np.uint64(w & (1 << 64) - 1)), np.int64)
    chosen = []
    for f in range(X.FOLDS + 1):
        use = np.arange(X.FOLDS) != f
        rate = toxic[fold != f].mean()
        n, bad = (np.array([seen[w][k][use].sum() for w in words]) for k in (0, 1))
        chosen.append((n >= X.LEAST_ROWS) & (abs(bad - n * rate) >= X.LEAST_DEVIATIONS * np.sqrt(np.maximum(n, 1) * rate * (1 - rate))))
    some = np.any(chosen, 0)
    vocabulary = words[some].view(np.uint64)
    return texts, toxic, fold, vocabulary, np.array(chosen)[:, some], X.known_words(texts, vocabulary)


def test_chain_feeds_earlier_categories():
    rows = made(600, 3)
    texts, toxic, fold, vocabulary, chosen, (row, col) = learned(rows)
    chain = X.fit_chain(len(rows), row, col, vocabulary, chosen, toxic, fold, X.lengths(texts))
    assert [len(m.dense) for m in chain.models] == [1, 2, 3, 4]  # the length, and the categories before
    kind = X.kinds(len(rows), row, col, len(vocabulary), toxic)
    assert set(kind[toxic == 0]) == {-1} and set(kind) == {-1, 0, 1, 2}
    p = chain.scores(texts)
    assert all(p[kind == k, k].mean() > 0.5 > p[toxic == 0, k].mean() for k in range(X.KINDS))


def test_folds_learn_nothing_from_their_own_rows():
    rows = made(300, 4)
    rows += [(1000 + i, t.replace(" ", "  "), q, x) for i, t, q, x in rows[:40]]  # copies
    _, toxic, fold, vocabulary, chosen, _ = learned(rows)
    assert (fold[300:] == fold[:40]).all() and len(set(fold)) == X.FOLDS
    other = [(i, t, q, 1 - x if fold[k] == 0 else x) for k, (i, t, q, x) in enumerate(rows)]
    _, _, again, words, choice, _ = learned(other)
    assert (again == fold).all()  # folds don't depend on labels, nor do words chosen without a fold on the fold's
    assert set(vocabulary[chosen[0]]) == set(words[choice[0]]) and set(vocabulary[chosen[-1]]) != set(words[choice[-1]])


def test_repeated_labelled_ids_are_learned_from_once(spark):
    rows = made(400, 6)
    docs, labels = tables(spark, rows)
    many = docs.unionByName(docs.where("doc_id < 40").crossJoin(spark.range(30)).drop("id"))
    for score, names in ((Q.score_quality, ["score"]), (X.score_toxicity, list(X.CATEGORIES))):
        want = {r.doc_id: [r[n] for n in names] for r in score(docs, labels).collect()}
        got = score(many, labels).collect()
        assert len(got) == 400 + 40 * 30 and all([r[n] for n in names] == want[r.doc_id] for r in got)


def test_odd_rows_and_labels(spark, docs, corpus, labels, nothing):
    for score, n in ((Q.score_quality, "score"), (X.score_toxicity, "toxic")):
        extra = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr("cast(null AS long) AS doc_id", "text", "lang", "source", "n_chars", "key", "root", "kept", "vec_id"))
        got = score(extra, labels).collect()
        assert len(got) == len(corpus) + 5 and all(r.held_out for r in got if r.doc_id is None)
        assert score(nothing, labels).count() == 0
        none = score(docs, labels.limit(0)).collect()
        assert len(none) == len(corpus) and all(abs(r[n] - 0.5) < 1e-9 for r in none)
    assert Q.keep_good(nothing, labels).columns == nothing.columns


def test_statistics_of_batches_and_single_texts_agree(corpus, monkeypatch):
    texts = pa.array([t for _, t in corpus], pa.large_string())
    whole = Q.statistics(texts)
    alone = np.concatenate([Q.statistics(pa.array([t], pa.large_string())) for _, t in corpus])
    assert whole.shape == (len(corpus), len(Q.FEATURES)) and np.isfinite(whole).all() and np.allclose(whole, alone)


def plain_statistics(text):
    """The same statistics by plain loops over bytes, words and lines."""
    b = (text or "").encode()
    low = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not words:
        return [0.0] * len(Q.FEATURES)
    upper, lower, digit, space = (lambda c: 65 <= c <= 90), (lambda c: 97 <= c <= 122), (lambda c: 48 <= c <= 57), (lambda c: c in b" \t\n\v\f\r")
    letter = lambda c: upper(c) or lower(c) or c >= 128
    punct = lambda c: not (letter(c) or digit(c) or space(c))
    odd = lambda c: punct(c) and c not in b".,;:'\"-()?"
    per, n, mean = len(words), len(b), sum(map(len, words)) / len(words)
    share = lambda f: sum(map(f, b)) / n
    of_words = lambda f: sum(bool(f(w)) for w in words) / per
    lines = [[low(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", x)] for x in b.split(b"\n")]
    full = [x for x in lines if x]
    count = collections.Counter(map(low, words))
    return [
        math.log1p(n), math.log1p(per), mean, math.sqrt(max(0, sum(len(w) ** 2 for w in words) / per - mean**2)),
        share(upper), share(digit), share(punct), share(odd), share(lambda c: c >= 128), share(space), math.log1p(len(lines)), per / len(full),
        sum(len(x) <= 4 for x in full) / len(full), sum(b[i] == 10 and b[i - 1] in b".!?:\"'" for i in range(1, n)) / len(lines), len(count) / per,
        sum(low(x) == low(y) for x, y in zip(words, words[1:])) / per, max(count.values()) / per, of_words(lambda w: odd(w[-1])), of_words(lambda w: upper(w[0])),
        of_words(lambda w: sum(map(letter, w)) > 1 and sum(map(letter, w)) == sum(map(upper, w))), of_words(lambda w: len(w) <= 2), of_words(lambda w: len(w) >= 16),
        of_words(lambda w: not any(map(letter, w))), len(set(map(tuple, full))) / len(full), b.count(b"|") / per,
    ]


def test_statistics_like_plain_loops(corpus):
    texts = [t for _, t in corpus if len(t or "") < 5000] + ["Ends so.", "\nstarts with a break", "A|B | c\n\nA|b | C\nÉTÉ AB 12 x1 !!", "a.\n\n\n"]
    got = Q.statistics(pa.array(texts, pa.large_string()))
    assert np.allclose(got, [plain_statistics(t) for t in texts], rtol=1e-4, atol=1e-6)


def plain_words(text):
    """A text's words, beginnings and pairs, by plain loops."""
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
    return {("word", w) for w in words} | {(n, w[:n]) for w in words for n in X.PREFIXES if len(w) > n} | {("pair", *p) for p in zip(words, words[1:])}


def test_chain_scores_like_plain_python():
    rows = made(300, 7)
    texts, toxic, fold, vocabulary, chosen, (row, col) = learned(rows)
    chain = X.fit_chain(len(rows), row, col, vocabulary, chosen, toxic, fold, X.lengths(texts))
    one = lambda w: X.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    place = {int(h): k for k, h in enumerate(vocabulary)}
    for k in range(0, 300, 11):
        known = set()
        for what, *w in plain_words(rows[k][1]):
            h = one(w[0]) if what == "word" else X.mix(one(w[0]) ^ X.PREFIX_CODES[what]) if what != "pair" else X.mix(one(w[0]) * X.PAIR_CODES[0] + one(w[1]) * X.PAIR_CODES[1])
            if int(h[0]) in place:
                known.add(place[int(h[0])])
        dense, want = [math.log1p(len(rows[k][1].encode())) / 2 - 3.5], []
        for m in chain.models:
            z = m.base + sum(m.words[j] for j in known) + sum(a * b for a, b in zip(m.dense, dense))
            want.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
            p = min(max(want[-1], 1e-6), 1 - 1e-6)
            dense.append(math.log(p) - math.log1p(-p))
        assert np.allclose(chain.scores(texts.slice(k, 1))[0], want, atol=1e-9)


def test_flat_forest_walks_like_trees():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 6)).astype(np.float32)
    y = (x[:, 1] + x[:, 2] > 0).astype(float)
    f = Q.fit_forest(x, y)
    assert ((f.scores(x) > 0.5) == y).mean() > 0.95

    def walk(row):
        z = f.base
        for feature, threshold, leaf in zip(f.feature, f.threshold, f.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose([walk(row) for row in x[:50]], f.scores(x[:50]))


def test_readme_states_the_bounds_in_force():
    import pathlib

    from runstore.llm import quality, toxicity

    rows = (pathlib.Path(__file__).parents[2] / "README.md").read_text().splitlines()
    for name, sample in (("op2_toxicity", toxicity.SAMPLE), ("op7_quality", quality.SAMPLE)):
        assert any(f"`{name}`" in r and f"at most {sample:,} labelled rows" in r for r in rows)
