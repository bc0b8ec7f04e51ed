import numpy as np
import pytest

from runstore.llm import embedding_duplicates as E
from runstore.llm import neighbours as A


@pytest.fixture(scope="module")
def table(spark, vectors_schema):
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 16))
    centre = r.normal(size=16)
    v[200:320] = centre + 0.05 * r.normal(size=(120, 16))  # a large group of near copies
    v[400:460] = v[399]  # and one of exact copies
    v[500:520] = 3 * v[480:500]  # of another length
    v[600:700] = 0.97 * v[700:800] + 0.03 * np.linalg.norm(v[700:800], axis=1)[:, None] * r.normal(size=(100, 16)) / 4
    rows = [(int(i), [float(np.float32(x)) for x in v[i]]) for i in range(900)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [None] + [1.0] * 15), (1080, [float("nan")] + [1.0] * 15), (1100, [float("inf")] + [1.0] * 15), (1120, [1.0] * 5), (None, [1.0] * 16), (None, None)]
    rows = [rows[i] for i in r.permutation(900)]
    return rows, spark.createDataFrame([(i, x, 1, "z") for i, x in rows + odd], vectors_schema).repartition(5), odd


def good(rows):
    rows = sorted(rows)
    return np.array([i for i, _ in rows]), np.array([x for _, x in rows])


def test_neighbours(table):
    rows, df, _ = table
    ids, v = good(rows)
    got = {}
    for r in A.nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == queries
    hit = 0
    for i in queries:
        s = (v * v[i]).sum(1)
        assert len(got[i]) == 20 and all(x != i and y == s[x] for x, y in got[i])
        assert got[i] == sorted(got[i], key=lambda p: (-p[1], p[0]))
        best = sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:20]
        hit += len(set(best) & {x for x, _ in got[i]})
    assert hit >= 0.9 * 20 * len(queries)


def test_neighbours_are_exact_if_all_is_searched(table, monkeypatch):
    rows, df, _ = table
    ids, v = good(rows)
    monkeypatch.setattr(A, "BLOCK_ROWS", 100)
    monkeypatch.setattr(A, "CELL", 64)
    monkeypatch.setattr(A, "HELD", 500)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 10)
    got = {(r.query_id, r.rank): r.vec_id for r in A.nearest(df, df.where("vec_id % 20 = 0"), k=20, target=1.0).collect()}
    for i in ids[::20]:
        s = (v * v[i]).sum(1)
        best = sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:20]
        assert [got[i, k + 1] for k in range(20)] == best


def test_few_rows(spark, vectors_schema):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [1.0, 0.0], 1, ""), (2, [1.0, 0.0], 1, "")], vectors_schema)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in A.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    none = df.limit(0)
    assert A.nearest(none, none).count() == 0 and E.near_duplicate_vectors(none).count() == 0
    got = sorted(tuple(r) for r in E.near_duplicate_vectors(df).collect())
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (2, 2, 0, False)]


def links(ids, v):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= E.LEAST
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], 10**9).min(1))
        if (new == low).all():
            return near.sum(1), low
        low = new


@pytest.mark.parametrize("block", [512, 30])
def test_near_duplicates(table, monkeypatch, block):
    rows, df, odd = table
    monkeypatch.setattr(E, "BLOCK", block)
    ids, v = good(rows)
    n, low = links(ids, v)
    got = E.near_duplicate_vectors(df).collect()
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(rows) + len(odd)
    found = np.array([by[i].n_links for i in ids])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum() > 0
    assert np.mean([by[i].component_id == x for i, x in zip(ids, low)]) > 0.99
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i, _ in odd if i is not None)
    assert sum(r.vec_id is None and r.n_links == 0 and r.kept for r in got) == 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


@pytest.mark.parametrize("n", [3000, 9000])
def test_a_large_group_of_near_copies(spark, vectors_schema, n):
    r = np.random.default_rng(8)
    v = r.normal(size=(n, 64))
    v[::3] = r.normal(size=64) + 0.2 * r.normal(size=(n // 3, 64))  # cosines of 0.95 and more, no two alike
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1, "") for i, x in enumerate(v)], vectors_schema).repartition(4)
    want, low = links(np.arange(n), v.astype(np.float64))
    assert want.sum() > (n // 3) ** 2 * 0.9
    got = {x.vec_id: x for x in E.near_duplicate_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    assert [got[i].component_id for i in range(n)] == low.tolist()


def test_each_pair_belongs_to_one_list():
    r = np.random.default_rng(9)
    perm = np.array([r.permutation(14)[:10] for _ in range(300)], np.int32)
    x, y = perm[:150], perm[150:]
    lists = sum(E._belong(p, x, y) & (x == p).any(1) & (y == p).any(1) for p in range(14))
    assert (lists == (x[:, :, None] == y[:, None, :]).any((1, 2))).all()


def test_each_length_is_a_space_of_its_own(spark, vectors_schema):
    r = np.random.default_rng(3)
    long, short = r.normal(size=(50, 8)), r.normal(size=(6, 3))
    long[7] = 2 * long[3]
    short[5] = short[1]
    rows = [(20 * i if i < 6 else 1000 + i, x.tolist(), 1, "") for i, x in enumerate([*short, *long])]  # the smallest ids are short
    df = spark.createDataFrame(rows, vectors_schema)
    by = {i: np.float32(x).astype(float) for i, x, _, _ in rows}
    found = E.near_duplicate_vectors(df).collect()
    want = {}
    for x in (short, long):
        ids = np.array([i for i in by if len(by[i]) == x.shape[1]])
        want |= {int(i): (int(n), int(c)) for i, n, c in zip(ids, *links(ids, np.array([by[i] for i in ids])))}
    assert {x.vec_id: (x.n_links, x.component_id) for x in found} == want and want[100][1] == 20 and want[1013][1] == 1009
    got = {}
    for x in A.nearest(df, df, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert set(got) == set(by) and all(len(by[j]) == len(by[i]) for i, near in got.items() for j in near)
    for i in list(by)[:6]:
        assert got[i] == sorted((j for j in list(by)[:6] if j != i), key=lambda j: (-(by[i] * by[j]).sum(), j))[:4]


@pytest.mark.parametrize("n", [300, 4000])
def test_share_follows_the_data(n):
    """Clustered rows need few products; rows in all directions many. The order of leaves is that of the queue."""
    r = np.random.default_rng(6)
    clustered = np.repeat(r.normal(size=(n // 25, 32)), 25, axis=0) + 0.1 * r.normal(size=(n, 32))
    for v, most in ((clustered, 0.6 if n == 300 else 0.1), (r.normal(size=(n, 32)), 1.5)):
        forest, share = A.fit(v, float(np.linalg.norm(v, axis=1).max()), n, 20)
        assert 0 < share < most
        leaves, hit = forest.leaves(v), 0
        assert np.bincount(leaves.ravel()).max() <= 2 * A.LEAF
        for i in range(0, n, n // 60):
            s = v @ v[i]
            s[i] = -np.inf
            best = np.argsort(-s)[:20]
            found = forest.search(v[i : i + 1], share)[0]
            hit += np.isin(leaves[best], found).any(1).sum()
            for j, need in zip(best[:5], forest.needed(v[i], leaves[best[:5]])):
                assert set(leaves[j]) & set(forest.search(v[i : i + 1], need - 1e-9)[0])
        assert hit >= 0.88 * 20 * len(range(0, n, n // 60))
