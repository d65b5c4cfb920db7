"""Vector searches against brute force, with awkward rows."""

import numpy as np
import pytest

from sparkhound.llm import anisotropic, mtree, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block string"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:340] = x[0]  # ties
    rows = [(k, v.tolist(), 0, 0.0, "b") for k, v in enumerate(x)]
    odd = [(1000, None, 0, 0.0, "b"), (1100, [], 0, 0.0, "b"), (1200, [0.0] * 16, 0, 0.0, "b"), (1300, [float("nan")] * 16, 0, 0.0, "b"), (1400, [float("inf")] * 16, 0, 0.0, "b"), (1500, [None] * 16, 0, 0.0, "b"), (None, [1.0] * 16, 0, 0.0, "b")]
    return spark.createDataFrame(rows + odd, SCHEMA), x


def _exact(x, ids, q, score, top):
    s = score(x, x[q])
    s[q] = np.inf
    order = np.lexsort((ids, s))[:top]
    return [(int(ids[k]), s[k]) for k in order]


def test_nearest(table):
    df, x = table
    got = {}
    for r in anisotropic.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 100))
    ids, y, hit = np.arange(600), x.astype(np.float64), 0
    for q, found in got.items():
        want = _exact(y, ids, q, lambda a, b: np.sqrt(((a - b) ** 2).sum(1)), 10)
        hit += len({v for v, _ in found} & {v for v, _ in want})
        assert all(abs(s - np.sqrt(((y[v] - y[q]) ** 2).sum())) < 1e-12 for v, s in found)
    assert hit / (10 * len(got)) >= 0.9
    assert [v for v, _ in got[0]] == list(range(300, 310))


def _page(x, rerank, q, bounds):
    quantiser = anisotropic.Quantiser.fit(x)
    codes = anisotropic.encoded(x.astype(np.float64), quantiser)
    return anisotropic.search_page(np.arange(len(x)), np.arange(len(x)), x, codes, None, q, x[q], bounds, quantiser, 10, rerank)


def test_tight_groups_are_searched_whole():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[:1000] = x[0] + 0.02 * rng.normal(size=(1000, 32))  # a third of the rows, near copies
    x = x[rng.permutation(3000)].astype(np.float32)
    ids, q = np.arange(3000), np.arange(0, 3000, 50)
    y, got = x.astype(np.float64), {}
    for query, v, _, _ in _page(x, anisotropic.RERANK, q, np.full(len(q), np.inf)):
        got.setdefault(int(q[query]), []).append(v)
    want = {k: _exact(y, ids, k, lambda a, b: np.sqrt(((a - b) ** 2).sum(1)), 10) for k in q.tolist()}
    assert got == {k: [v for v, _ in w] for k, w in want.items()}
    # a bound brought along keeps all within it
    bounds = np.array([want[k][4][1] for k in q.tolist()])
    got = {}
    for query, v, _, _ in _page(x, anisotropic.RERANK, q, bounds):
        got.setdefault(int(q[query]), []).append(v)
    assert all(got[k][:5] == [v for v, _ in want[k][:5]] for k in q.tolist())


@pytest.mark.parametrize("page_rows,cells", [(8192, 1024), (300, 16)])
def test_recall_at_ten_thousand_rows(spark, page_rows, cells):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(10_000, 24)).astype(np.float32)
    x[:3300] = x[0] + 0.05 * rng.normal(size=(3300, 24)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, y, ids, hit, n = {}, x.astype(np.float64), np.arange(10_000), 0, 0
    for r in anisotropic.nearest(df, rerank=20, page_rows=page_rows, cells=cells).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == list(range(0, 10_000, 100))
    for q, found in got.items():
        want = {v for v, _ in _exact(y, ids, q, lambda a, b: np.sqrt(((a - b) ** 2).sum(1)), 10)}
        hit, n = hit + len(want & set(found)), n + 10
    assert hit / n >= 0.99


def test_double_vectors_are_not_rounded(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2]), (100, [0.3, 0.7]), (3, [1e30, -1e30])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in anisotropic.nearest(df).collect()}
    assert got[0, 1] == (100, float(np.sqrt(((np.array([0.1, 0.2]) - np.array([0.3, 0.7])) ** 2).sum())))
    assert got[0, 2][0] == 3
    few = df.where("vec_id < 200 AND vec_id <> 3").unionByName(spark.createDataFrame([(50, [0.99609375, 1.0])], df.schema))
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in mtree.top_products(few).collect()}
    a = {k: np.floor(256 * np.array(v)).astype(int) for k, v in ((0, [0.1, 0.2]), (100, [0.3, 0.7]), (50, [0.99609375, 1.0]))}
    assert scores == {(p, q): int(a[p] @ a[q]) for p in a for q in a if p != q}


def test_scores_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OVERFLOW"):
        mtree.top_products(df).collect()


def test_unlike_lengths_never_meet(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8 if k % 3 else 5).tolist()) for k in range(200)] + [(1000, [1.0]), (1001, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    size = {k: len(v) for k, v in rows}
    for found in (anisotropic.nearest(df, page_rows=30, cells=3), mtree.top_products(df, page_rows=30, cells=3)):
        pairs = [(r["query_id"], r["vec_id"]) for r in found.collect()]
        assert pairs and all(size[a] == size[b] for a, b in pairs) and (1000, 1001) in pairs


def test_anisotropic_loss_falls_below_plain_codes():
    x = np.random.default_rng(0).normal(size=(800, 16))
    q = anisotropic.Quantiser.fit(x)
    codes = q.encode(x)
    plain = q.encode(x, sweeps=0)
    loss = lambda c: sum(_loss(x[k], q.books[np.arange(len(q.books)), c[k]].reshape(-1)) for k in range(len(x)))
    assert loss(codes) <= loss(plain)


def _loss(x, y):
    r, u = x - y[: len(x)], x / np.linalg.norm(x)
    along = r @ u
    return anisotropic.ETA * along**2 + (r @ r - along**2)


def test_top_products(table):
    df, x = table
    got = {}
    for r in mtree.top_products(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    a = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    ids = np.r_[np.arange(600), 1200]
    a = np.vstack([a, np.zeros((1, 16), np.int64)])
    assert sorted(got) == [*range(0, 600, 50), 1200]
    for q, found in got.items():
        k = int(np.flatnonzero(ids == q)[0])
        s = (a @ a[k]).astype(float)
        s[k] = -np.inf
        order = np.lexsort((ids, -s))[:5]
        assert found == [(int(ids[j]), int(s[j])) for j in order]


def test_tree_skips_distances():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(1000, 4)) * 0.01 + c for c in rng.normal(size=(20, 4)) * 10])
    tree = mtree.MTree(points)
    score = lambda rows: -((points[rows] - points[5]) ** 2).sum(1)
    found, computed = tree.search(points, points[5], score, 3)
    assert found[0][1] == 5 and computed < len(points) / 4


def test_small_and_empty(table, monkeypatch):
    df, _ = table
    monkeypatch.setattr(vectors, "QUERIES", 2)
    monkeypatch.setattr(vectors, "PACKETS", 2)
    many = sorted(tuple(r) for r in mtree.top_products(df, page_rows=100, cells=3).collect())
    assert len(many) == 13 * 5 and many == sorted(tuple(r) for r in mtree.top_products(df).collect())
    few = df.where("vec_id IN (0, 7)")
    assert [tuple(r)[:3] for r in anisotropic.nearest(few).collect()] == [(0, 1, 7)]
    assert anisotropic.nearest(df.limit(0)).count() == 0 and mtree.top_products(df.limit(0)).count() == 0
    twice = df.where("vec_id IN (0, 7)").unionByName(df.where("vec_id = 0"))
    assert mtree.top_products(twice).count() == 4
