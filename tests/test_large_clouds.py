import dataclasses

import numpy as np
import pytest

from cavern.functions.distances import euclidean, manhattan, rounded
from cavern.operators import filtration as fl
from cavern.operators import nearest
from cavern.operators.homology import spanning_forest


def cloud(spark, x, kind="double"):
    return fl.points_table(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], f"id long, coords array<{kind}>"), key="id")


def odd_points(n=90, dims=6):
    """Some copies, some points nearer than the digits, some far off."""
    x = np.random.default_rng(4).normal(size=(n, dims))
    x[10:16], x[20:25], x[30:33] = x[:6], x[40:45] * (1 + 1e-9), x[50:53] * 1000
    return x


@pytest.mark.parametrize("precision", ["float32", "float64"])
@pytest.mark.parametrize("scale,shift", [(1, 0), (1e-6, 0), (1e5, 10), (1e-30, 1), (1e18, 0)])
def test_within_equals_blocks(precision, scale, shift):
    """What a matrix product finds is bit for bit what the block holds."""
    x, y = ((odd_points()[k:] + shift) * scale for k in (0, 7))
    x, y = x.astype(precision), y.astype(precision)
    for d in (euclidean(precision), rounded(euclidean(precision), 6), rounded(manhattan(), 6)):
        w = d.block(x, y)
        rough, slack = d.rough(x, y)
        assert (d.least(rough, slack) <= w).all() and (rough <= d.most(w) + slack).all()
        for limit in (np.inf, float(np.quantile(w, 0.05)), float(np.median(w)), 0.0):
            r, c = np.nonzero(w <= limit)
            got = d.within(x, y, limit)
            assert np.array_equal(got[0], r) and np.array_equal(got[1], c) and np.array_equal(got[2], w[r, c])


def shuffled_points(df):
    """Whether the plan sends points through an exchange."""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [None, 2.5])
def test_edges_by_chunks(spark, monkeypatch, limit):
    """Several broadcast chunks give each edge once, and no point or edge is shuffled for them."""
    monkeypatch.setattr(fl, "CHUNK_BYTES", 6 * 8 * 25)
    x = odd_points()
    d = rounded(euclidean("float64"), 6)
    got = fl.edges(cloud(spark, x), limit, d, "float64", 8)
    assert not shuffled_points(got)
    w = d.block(x, x)
    want = [(a, b, w[a, b]) for a in range(len(x)) for b in range(a) if limit is None or w[a, b] <= limit]
    assert sorted(map(tuple, got.collect())) == want


def plain_forest(w, limit):
    """Lengths of a spanning forest's edges, by Kruskal."""
    top, out = list(range(len(w))), []
    for x, a, b in sorted((w[a, b], a, b) for a in range(len(w)) for b in range(a) if w[a, b] <= limit):
        if top[a] != top[b]:
            out.append(x)
            top = [top[a] if t == top[b] else t for t in top]
    return out


@pytest.mark.parametrize("listed", [1, 8])
@pytest.mark.parametrize("kind,limit", [("float64", None), ("float64", 2.0), ("float32", None), ("manhattan", None)])
def test_forest_of_nearest_neighbours(spark, monkeypatch, listed, kind, limit):
    """Three clusters with more points, and more ties and copies, than a list holds: their links must be asked for. The
    edge table isn't made."""
    monkeypatch.setattr(nearest, "NEIGHBOURS", listed)
    monkeypatch.setattr(fl, "CHUNK_BYTES", 6 * 8 * 40)
    monkeypatch.setattr(fl, "edges", None)
    x = np.concatenate([odd_points(60), 30 + 0.1 * odd_points(60), np.round(2 * odd_points(60)) / 2 - 40])
    precision = "float32" if kind == "float32" else "float64"
    x = x.astype(precision)
    d = {"float64": rounded(euclidean("float64"), 6), "float32": euclidean(), "manhattan": rounded(manhattan(), 6)}[kind]
    points, tree = nearest.nearest_forest(cloud(spark, x), limit, d, precision, spanning_forest, 16)
    same = np.unique(x, axis=0)
    want = plain_forest(d.block(same, same), np.inf if limit is None else limit)
    assert points.count() == len(same) and sorted(r.w for r in tree.collect()) == sorted(map(float, want))


@pytest.mark.parametrize("kind", ["float64", "float32", "manhattan"])
def test_radius_by_chunks(spark, monkeypatch, kind):
    """With several chunks and ties; few points are measured against all others exactly."""
    monkeypatch.setattr(fl, "CHUNK_BYTES", 6 * 8 * 60)
    calls = spark.sparkContext.accumulator(0)
    precision = "float32" if kind == "float32" else "float64"
    d = {"float64": rounded(euclidean("float64"), 6), "float32": euclidean(), "manhattan": rounded(manhattan(), 6)}[kind]
    counting = dataclasses.replace(d, block=lambda x, y: (calls.add(len(x) * len(y)), d.block(x, y))[1])
    x = odd_points(200).astype(precision)
    x[30:33] /= 100
    for own in (x, np.concatenate([np.eye(6), -np.eye(6), np.eye(6)]).astype(precision)):
        calls.value = 0
        got = fl.enclosing_radius(cloud(spark, own), counting, precision, 16)
        assert got == float(d.block(own, own).max(axis=1).min())
        assert kind == "manhattan" or len(own) < 100 or 0 < calls.value < len(own) ** 2 / 10


def test_threshold_takes_no_block(spark):
    """Pairs beyond the threshold cost a matrix product, not their distance."""
    calls = spark.sparkContext.accumulator(0)
    d = rounded(euclidean("float64"), 6)
    counting = dataclasses.replace(d, block=lambda x, y: (calls.add(len(x) * len(y)), d.block(x, y))[1], pairs=lambda x, y: (calls.add(len(x)), d.pairs(x, y))[1])
    x = np.random.default_rng(5).normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = d.block(x, x)
    got = fl.edges(cloud(spark, x), 1.25, counting, "float64", 64)
    assert sorted(map(tuple, got.collect())) == [(a, b, w[a, b]) for a in range(300) for b in range(a) if w[a, b] <= 1.25]
    assert calls.value < 320  # the points themselves, and what may round either way


def test_float32_edges_without_shuffle(spark, monkeypatch):
    """Blocks of 8 points sent each point 24 times before; now it is in one part, whatever the number of blocks."""
    monkeypatch.setattr(fl, "CHUNK_BYTES", 6 * 4 * 70)
    x = np.tile(odd_points(), (2, 1)).astype(np.float32) + 3
    points = cloud(spark, x, "float")
    got = fl.edges(points, 2.5, block_points=8)
    assert not shuffled_points(got) and fl.dealt(points, 8).count() == len(x)
    w = euclidean().block(x, x)
    assert sorted(map(tuple, got.collect())) == [(a, b, w[a, b]) for a in range(len(x)) for b in range(a) if w[a, b] <= 2.5]
