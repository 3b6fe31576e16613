import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cavern.functions.distances import euclidean, manhattan
from cavern.functions.influence import Gaussian
from cavern.operators import filtration as fl
from cavern.operators import incidence as inc
from cavern.operators.cns import CombinatorialNumberSystem, binomial
from cavern.operators.image import gaussian_image, integral_over_rectangle, persistence_image
from cavern.operators.reduce import Filtration, columns_of, reduce_columns
from cavern.plans.model import BoundsConfig
from cavern.sources import clouds
from cavern.sources.cli import bench, demo


def test_number_system():
    s = CombinatorialNumberSystem(8, 4)
    assert s.encode((7, 6)) == 27 and s.encode((7, 6, 5)) == 55 and [s.decode(i, 2) for i in range(3)] == [(1, 0), (2, 0), (2, 1)]
    assert [x[0] for x in s.facets((3, 2, 0))] == [1, 3, 5]
    for k in range(1, 5):
        every = [s.decode(i, k) for i in range(s.count(k))]
        assert [s.encode(c) for c in every] == list(range(len(every))) and every == list(s.combinations(0, k))
        assert np.array_equal(s.decode_all(np.arange(len(every)), k), np.array(every)) and np.array_equal(s.encode_all(np.array(every)), np.arange(len(every)))
    for combo in [(5, 2, 1), (7, 6, 0)]:
        up = s.cofacets(combo)
        assert [i for i, _ in up] == sorted((i for i, _ in up), reverse=True) and len(up) == 5
        assert [i for i, _, _ in s.facets(combo)] == sorted(i for i, _, _ in s.facets(combo))
    with pytest.raises(IndexError):
        s.decode(28, 2)
    with pytest.raises(OverflowError):
        CombinatorialNumberSystem(100_000, 5)


def test_cofacets_of_an_edge():
    assert [i for i, _ in CombinatorialNumberSystem(8, 3).cofacets((2, 0))] == [36, 21, 11, 5, 2, 0]


def test_binomial_column(spark):
    rows = spark.range(0, 60).select("id", *(binomial(F.col("id"), k).alias(f"k{k}") for k in range(5))).collect()
    assert all(r[f"k{k}"] == math.comb(r.id, k) for r in rows for k in range(5))


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 4.0]), ([1.1, 2.0], [3.2, 6.07])], "u array<float>, v array<float>")
    got = [r[0] for r in df.select(euclidean().between(F.col("u"), F.col("v"))).collect()]
    assert got == [float(np.float32(math.sqrt(8))), float(np.float32(math.sqrt(17))), pytest.approx(math.sqrt(2.1**2 + 4.07**2), rel=1e-6)]
    assert [r[0] for r in df.select(manhattan().between(F.col("u"), F.col("v"))).collect()][:2] == [4.0, 5.0]


def own(points, threshold=np.inf, dim=2):
    return Filtration(np.array(points, np.float32), euclidean(), threshold, dim)


def test_radius_and_cofacets():
    assert own([[0, 0], [3, 0], [0, 4]]).every.radius(np.array([[2, 1, 0]]))[0] == 5
    f = own([[0, 0], [1, 0], [0, 1], [1, 1], [10, 10]])
    assert [-i for _, i in sorted(f.coboundary(0, 1))] == [1, 0, 4]
    assert sorted(-i for _, i in own([[0, 0], [1, 0], [0, 1], [1, 1], [10, 10]], 5).coboundary(0, 1)) == [0, 1]


def test_columns_and_apparent_pairs():
    f = own([[0, 0], [1, 0], [0, 1]], 2)
    assert sorted(columns_of(f, np.arange(3), 1)["index"]) == [0, 1] and columns_of(f, np.array([0, 2]), 1)["index"].tolist() == [0]
    flat = own([[0, 0.1], [-0.5, 0], [0.5, 0]], 2)
    assert columns_of(flat, np.arange(3), 1)["index"].tolist() == [0, 1] and flat.apparent_birth(0, float(flat.every.radius(np.array([[2, 1, 0]]))[0]), 1) == 2
    assert columns_of(f, np.empty(0, np.int64), 1).empty


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 25), st.integers(2, 4), st.floats(0, 20), st.integers(0, 2), st.integers(0, 10**6))
def test_pivots_are_unique(n, dims, threshold, dim, seed):
    f = own(np.random.default_rng(seed).uniform(-10, 10, (n, dims)), threshold, 3)
    columns = columns_of(f, np.arange(f.system.count(dim + 1)), dim)
    got = reduce_columns(columns.assign(summands=pd.Series([[i] for i in columns["index"]], dtype=object)), f, dim)
    pivots = got["pivot"][got["pivot"] >= 0]
    assert pivots.is_unique


def test_partitions(spark):
    cases = [([(0, 9, 25), (10, 19, 25), (20, 29, 25), (30, 39, 25)], 4, [9, 19, 29]), ([(0, 9, 10), (10, 19, 10), (20, 29, 10), (30, 39, 70)], 2, [29]), ([(0, 9, 50), (10, 19, 0), (20, 29, 50)], 2, [9]), ([(0, 9, 10)], 100, [9]), ([], 4, []), ([(0, 9, 5)], 1, [])]
    for histogram, parts, want in cases:
        assert inc.equal_depth_boundaries(histogram, parts) == want
    df = spark.createDataFrame([(5,), (9,), (15,), (-1,), (35,)], "pivot long")
    assert [r[0] for r in df.select(inc.partition_of(F.col("pivot"), [9, 19, 29])).collect()] == [0, 0, 1, 0, 3]


def test_pivot_of_entries(spark):
    df = spark.createDataFrame([([(7, 1.0), (3, 2.0)],), ([],), (None,)], "top_entries array<struct<index:long,radius:float>>")
    assert [r[0] for r in df.select(inc.pivot_or_none()).collect()] == [7, -1, -1]


PAIRS = [(0, 0.0, 10.0), (0, 1.0, 2.3), (0, 0.2, 18.6), (0, 0.0, 6.2), (0, 8.0, 15.0), (0, 0.0, math.inf)]
BOUNDS = BoundsConfig(0.0, 12.1, 0.0, 12.1)


def test_gaussian_images(spark):
    df = spark.createDataFrame(PAIRS, "dim int, birth double, death double")
    exact = gaussian_image(df, 100, 100, 1.0, bounds=BOUNDS, method="exact").to_dense_matrix().toArray()
    phi = lambda e, m: 0.5 * math.erf((e - m) / math.sqrt(2))
    size = 12.1 / 100
    for i, j in ((0, 0), (3, 80), (66, 57), (99, 99)):
        want = sum((d - b) * (phi(size * (i + 1), b) - phi(size * i, b)) * (phi(size * (j + 1), d - b) - phi(size * j, d - b)) for _, b, d in PAIRS if d < math.inf)
        assert exact[i, j] == pytest.approx(want, abs=1e-12)
    fast = gaussian_image(df, 100, 100, 1.0, bounds=BOUNDS).to_dense_matrix().toArray()
    assert np.abs(fast - exact).max() < 1e-4
    small = [persistence_image(df, 6, 5, Gaussian(1.0, 2.0) if k else (lambda b, p, x, y: Gaussian(1.0, 2.0)(b, p, x, y)), bounds=BOUNDS).to_dense_matrix().toArray() for k in (0, 1)]
    assert np.allclose(small[0], small[1], atol=1e-12)
    one = lambda b, p, x, y: F.lit(1.0)
    flat = persistence_image(df.limit(1), 2, 2, one, lambda b, p: F.lit(1.0), BoundsConfig(0.0, 2.0, 0.0, 2.0), samples=4, method="random", seed=3)
    assert flat.to_dense_matrix().toArray().tolist() == [[1.0, 1.0], [1.0, 1.0]]


def test_image_errors_and_empty(spark):
    df = spark.createDataFrame(PAIRS, "dim int, birth double, death double")
    with pytest.raises(ValueError, match="min_birth.*min_persistence"):
        gaussian_image(df, 2, 2, 1.0, bounds=BoundsConfig(10.0, 0.0, 1.0, 1.0))
    with pytest.raises(ArithmeticError, match="birth"):
        gaussian_image(df.where("birth = 0"), 2, 2, 1.0)
    with pytest.raises(ArithmeticError):
        gaussian_image(df.limit(0), 2, 2, 1.0)
    assert gaussian_image(df.limit(0), 2, 2, 1.0, bounds=BOUNDS).to_dense_matrix().toArray().sum() == 0


def test_integrals():
    assert integral_over_rectangle(lambda x, y: 3.0, (0, 0), 2, 5) == pytest.approx(30)
    assert integral_over_rectangle(lambda x, y: x + y, (1, 1), 2, 2, 100_000, seed=1) == pytest.approx(16, abs=0.1)


def test_sources_and_sinks(spark, tmp_path):
    for cloud, dims in ((clouds.torus2(spark, 50), 3), (clouds.torus3(spark, 20), 100), (clouds.sphere(spark, 20), 100), (clouds.uniform(spark, 10, 4, seed=1), 4)):
        assert {len(r.coords) for r in cloud.collect()} == {dims}
    assert all(abs((math.hypot(r.coords[0], r.coords[1]) - 2) ** 2 + r.coords[2] ** 2 - 1) < 0.25 for r in clouds.torus2(spark, 200).collect())
    cloud = clouds.from_collection(spark, [[1, 2], [3, 4.5]])
    clouds.write_points_text(cloud, f"{tmp_path}/cloud")
    assert [r.coords for r in clouds.read_points_csv(spark, f"{tmp_path}/cloud").orderBy("id").collect()] == [[1, 2], [3, 4.5]]
    (tmp_path / "pairs.csv").write_text("0.0,1.5\n0.0,inf\n")
    pairs = clouds.read_pairs_csv(spark, f"{tmp_path}/pairs.csv", 0)
    assert [tuple(r) for r in pairs.collect()] == [(0, 0.0, 1.5), (0, 0.0, math.inf)]
    clouds.write_pairs_csv(pairs, 1, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/dim_0").count() == 2
    assert clouds.from_parquet(spark, "/root/testdata/sf0.001/embeddings.parquet", "vec_id", "embedding").count() == 500


def test_jobs(spark):
    assert bench(spark, "torus2-4000", n=40)[0] == 40
    assert set(demo(spark, 12, 3, 2)) == {0, 1, 2} and set(demo(spark, 8, 2, 1, image=True)) == {1}
