import numpy as np
import pytest

from cavern.llm import search


def frame(spark, n=400, dims=8, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.2, (n, dims)).astype(np.float32)
    x[n // 2 : n // 2 + 30] = x[0]
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(9000, None, 1), (9050, [float("nan")] * dims, 1), (9100, [None] * dims, 1), (None, [1.0] * dims, 1), (9200, [0.0] * dims, 1), (9300, [1.0, 2.0], 1), (9400, [1.0, 2.5], 1), (3, rows[3][1], 2), (9500, [], 1)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def plain(vectors, queries, k, score, nearest):
    out = []
    for q in queries:
        found = sorted(((score(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])), key=lambda t: (t[0] if nearest else -t[0], t[1]))
        out += [(q, rank + 1, i, s) for rank, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("chunk", [10**6, 9])
def test_whole_search_is_exact(spark, chunk):
    x, df = frame(spark)
    got = search.nearest(df, k=10, every=100, trees=3, search=1e9, chunk=chunk).collect()
    vectors = {i: v.astype(float) for i, v in enumerate(x)} | {9300: np.array([1.0, 2.0]), 9400: np.array([1.0, 2.5])}
    want = plain(vectors, [0, 100, 200, 300, 9300, 9400], 10, lambda a, b: np.sqrt(((a - b) ** 2).sum()), True)
    assert [r[:3] for r in sorted(tuple(r) for r in got)] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in sorted(tuple(r) for r in got)], [r[3] for r in want], rtol=1e-12)
    assert search.nearest(df.limit(0)).count() == 0


def test_recall_of_the_forest(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = search.nearest(df).collect()
    t = df.toPandas()
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        true = set(ids[ids != q][np.lexsort((ids[ids != q], d[ids != q]))[:10]])
        own = {r.vec_id for r in got if r.query_id == q}
        assert len(own) == 10
        hits, total = hits + len(true & own), total + 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("chunk", [10**6, 9])
def test_products_equal_brute_force(spark, chunk):
    x, df = frame(spark)
    vectors = {i: np.floor(256 * v.astype(float)).astype(int) for i, v in enumerate(x)} | {9200: np.zeros(8, int), 9300: np.array([256, 512]), 9400: np.array([256, 640])}
    want = plain(vectors, [q for q in vectors if q % 50 == 0], 5, lambda a, b: int(a @ b), False)
    assert sorted(tuple(r) for r in search.top_k(df, chunk=chunk).collect()) == want
    assert search.top_k(df.limit(0)).count() == 0


def test_blocks_and_large_integers():
    q, x = np.array([[2**29, 2**29 + 1]]), np.array([[2**29, 1], [2**29, 2], [-(2**29), 7]])
    own = search.TopProducts(np.array([5]), q, 2)
    for k in range(3):
        own.add(np.array([k + 1]), x[k : k + 1])
    ids, score = own.kept[0]
    assert ids.tolist() == [2, 1] and [int(s) for s in score] == [2**58 + 2 * (2**29 + 1), 2**58 + 2**29 + 1]
    r = np.random.default_rng(4)
    q, x = r.integers(-99, 99, (7, 32)), r.integers(-99, 99, (300, 32))
    own = search.TopProducts(np.arange(7), q, 4)
    for at in range(0, 300, 50):
        own.add(np.arange(at, at + 50), x[at : at + 50])
    for k in range(7):
        want = sorted((-int(v @ q[k]), i) for i, v in enumerate(x) if i != k)[:4]
        assert [(-int(s), i) for i, s in zip(*own.kept[k])] == want


def test_one_queue_over_all_trees():
    r = np.random.default_rng(6)
    x = r.normal(size=(500, 6))
    x[50:120] = x[0]
    forest = search.Forest(x, trees=3, leaf=8)

    def priorities(v):
        out, todo = {}, [(root, 0.0) for root in forest.roots]
        while todo:
            node, far = todo.pop()
            if node < 0:
                out[-1 - node] = far
                continue
            m = forest.planes[node] @ v - forest.cuts[node]
            todo += [(forest.children[node, side], far + (m * m if side != (m >= 0) else 0)) for side in (0, 1)]
        return out

    for wanted in (1, 100, 900):
        for v, found in zip(x[:70], forest.search(x[:70], wanted)):
            own = priorities(v)
            held = [forest.leaf_sizes[k] for k in found.tolist()]
            assert sum(held) >= wanted > sum(held[:-1]) and len(set(found.tolist())) == len(found)
            assert max(own[k] for k in found.tolist()) <= min([p for k, p in own.items() if k not in found] or [np.inf]) + 1e-9
    assert forest.leaves(x).shape == (500, 3)


def test_statistics_bound_distances():
    r = np.random.default_rng(3)
    a, b = r.normal(size=(50, 64)), r.normal(size=(50, 64))
    true = ((a - b) ** 2).sum(axis=1)
    last = np.zeros(50)
    for s in search.RESOLUTIONS:
        bound = ((search.statistics(a, s) - search.statistics(b, s)) ** 2).sum(axis=1)
        assert (bound <= true + 1e-9).all() and (bound >= last - 1e-9).all()
        last = bound
