import math
import random

import numpy as np
import pandas as pd
import pytest

from cavern.functions.distances import euclidean, manhattan
from cavern.operators import filtration as fl
from cavern.operators import reduce
from cavern.operators.homology import compute_persistent_homology, forest
from cavern.plans.model import is_infinite
from cavern.sources import clouds


def cloud(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, coords array<float>")


def plain_pairs(points, max_dim, threshold=None, metric=lambda a, b: math.dist(a, b)):
    """Textbook boundary reduction."""
    from itertools import combinations

    n = len(points)
    d = {(i, j): metric(points[i], points[j]) for i in range(n) for j in range(n)}
    t = threshold if threshold is not None else min(max(d[i, j] for j in range(n)) for i in range(n))
    simplices = sorted((max((d[i, j] for i, j in combinations(s, 2)), default=0.0), len(s), s) for k in range(max_dim + 2) for s in combinations(range(n), k + 1))
    simplices = [x for x in simplices if x[0] <= t]
    at = {s: i for i, (_, _, s) in enumerate(simplices)}
    low, paired, out = {}, set(), []
    for i, (r, size, s) in enumerate(simplices):
        column = {at[s[:k] + s[k + 1 :]] for k in range(size)} if size > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            j = max(column)
            low[j] = column
            paired |= {i, j}
            if simplices[j][0] != r:
                out.append((simplices[j][1] - 1, simplices[j][0], r))
    out += [(size - 1, r, math.inf) for i, (r, size, s) in enumerate(simplices) if i not in paired and size <= max_dim + 1]
    return sorted(x for x in out if x[0] <= max_dim)


def close(got, want):
    got, want = sorted(tuple(r) for r in got), sorted(want)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5) and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)


def spheres():
    """An octahedron, a larger one and an icosahedron, apart from each other: three classes of dimension 2."""
    axes = [[s * (k == j) for j in range(3)] for k in range(3) for s in (-1.0, 1.03)]
    g = (1 + 5**0.5) / 2
    icosahedron = [v for a in (-1, 1.01) for b in (-g, g) for v in ([0, a, b], [a, b, 0], [b, 0, a])]
    return [*axes, *([3 + 1.7 * x, 2 + 1.6 * y, 1.5 * z] for x, y, z in axes), *([9 + x, y, z - 1] for x, y, z in icosahedron)]


@pytest.mark.parametrize("matrix_points", [4000, 0])
def test_spheres_in_dimension_2(spark, monkeypatch, matrix_points):
    """With the matrix of the whole cloud, and by the neighbours of each vertex without one."""
    monkeypatch.setattr(reduce, "MATRIX_POINTS", matrix_points)
    want = plain_pairs(points32(spheres()), 2)
    assert len([x for x in want if x[0] == 2]) >= 3
    close(compute_persistent_homology(cloud(spark, spheres()), 2, key="id").pairs.collect(), want)


def test_local_points_below_a_threshold(spark, monkeypatch):
    monkeypatch.setattr(reduce, "MATRIX_POINTS", 12)
    monkeypatch.setattr(reduce, "BATCH_BYTES", 200)
    r = random.Random(9)
    points = [[r.uniform(-10, 10) for _ in range(3)] for _ in range(28)]
    for threshold in (6.0, 9.0):
        got = compute_persistent_homology(cloud(spark, points), 2, threshold=threshold, precision="float64", partitions=3)
        close(got.pairs.collect(), plain_pairs(points32(points), 2, threshold))


def test_triangles_on_a_circle_and_a_torus(spark):
    """450 points, one class of dimension 1; 2,000 points of a torus, one that never dies in dimension 0."""
    points = []
    for k in range(150):
        x, y = (100 * f(k * math.pi / 75) for f in (math.cos, math.sin))
        points += [[x + 0.01 / 3**0.5 * math.cos(a), y + 0.01 / 3**0.5 * math.sin(a)] for a in (0.1, 0.1 + 2 * math.pi / 3, 0.1 + 4 * math.pi / 3)]
    pairs = compute_persistent_homology(cloud(spark, points), 1, precision="float64").dim(1).collect()
    assert len([p for p in pairs if p.death - p.birth > 1]) == 1
    torus = compute_persistent_homology(clouds.torus2(spark, 2000), 0)
    assert torus.dim(0).where(is_infinite()).count() == 1 and torus.dim(0).count() == 2000


def test_forest_equals_kruskal():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(2, 12)
        edges = [(a, b, float(r.randint(0, 4))) for a in range(n) for b in range(a) if r.random() < 0.6]
        top, want = list(range(n)), []
        for a, b, w in sorted(edges, key=lambda e: (e[2], -e[0], -e[1])):
            if top[a] != top[b]:
                want.append((a, b, w))
                top = [top[a] if t == top[b] else t for t in top]
        assert sorted(map(tuple, forest(pd.DataFrame(edges, columns=["a", "b", "w"])).itertuples(index=False))) == sorted(want)


@pytest.mark.parametrize("seed,threshold,partitions", [(1, None, 3), (2, 9.0, 1), (3, 6.0, 4)])
def test_random_clouds(spark, seed, threshold, partitions):
    r = random.Random(seed)
    points = [[r.uniform(-10, 10) for _ in range(3)] for _ in range(16)]
    got = compute_persistent_homology(cloud(spark, points), 2, threshold=threshold, precision="float64", partitions=partitions)
    close(got.pairs.collect(), plain_pairs(points32(points), 2, threshold))


def points32(points):
    return [[float(np.float32(x)) for x in p] for p in points]


def test_ties_and_manhattan(spark):
    grid = [[float(i), float(j)] for i in range(4) for j in range(3)] + [[0.0, 0.0]]
    close(compute_persistent_homology(cloud(spark, grid), 1).pairs.collect(), plain_pairs(grid, 1))
    metric = lambda a, b: sum(abs(x - y) for x, y in zip(a, b))
    close(compute_persistent_homology(cloud(spark, grid), 1, distance=manhattan(), precision="float64").pairs.collect(), plain_pairs(grid, 1, metric=metric))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "id long, coords array<float>")
    got = compute_persistent_homology(empty, 2)
    assert got.pairs.count() == 0 and got.dim(2).count() == 0
    close(compute_persistent_homology(cloud(spark, [[1, 2, 3]]), 1).pairs.collect(), [(0, 0.0, math.inf)])
    assert compute_persistent_homology(cloud(spark, [[0, 0], [1, 0]]), 1, threshold=-1.0).pairs.count() == 0
    close(compute_persistent_homology(cloud(spark, [[0, 0], [1, 0], [9, 0]]), 1, threshold=2.0).pairs.collect(), [(0, 0.0, 1.0), (0, 0.0, math.inf), (0, 0.0, math.inf)])
    with pytest.raises(ValueError):
        compute_persistent_homology(empty, -1)
    for bad in ([[1.0, float("nan")], [1.0, 2.0]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(Exception, match="NaN|lengths"):
            compute_persistent_homology(cloud(spark, bad), 0).pairs.count()


@pytest.mark.parametrize(
    "points,want",
    [([], 0), ([[1, 2, 3]], 0), ([[0, 0], [1, 0], [0.5, 3**0.5 / 2]], 1), ([[math.cos(k * math.pi / 3), math.sin(k * math.pi / 3)] for k in range(6)], 2), ([[0, 0], [1, 0], [2, 0], [3, 0]], 2), ([[0, 0], [5, 0], [-5, 0], [0, 5], [0, -5]], 5)],
)
def test_enclosing_radius(spark, points, want):
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, coords array<float>")
    assert fl.enclosing_radius(fl.points_table(df, key="id"), block_points=2) == pytest.approx(want)


def test_blocks_equal_theta_join(spark):
    r = random.Random(5)
    p = fl.points_table(cloud(spark, [[r.uniform(-1, 1) for _ in range(5)] for _ in range(40)]), key="id")
    for precision in ("float32", "float64"):
        d = euclidean(precision)
        assert sorted(map(tuple, fl.edges(p, 1.2, d, precision, 7).collect())) == sorted(map(tuple, fl.pairwise(p, d).where("w <= 1.2D").collect()))
