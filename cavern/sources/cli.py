"""Command line: benchmark cases and the demonstration job."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..operators.homology import compute_persistent_homology
from ..operators.image import gaussian_image
from . import clouds

#: (cloud, points, dimension, threshold) by case.
CASES = {
    "torus2-4000": (clouds.torus2, 4_000, 1, None),
    "torus2-100000": (clouds.torus2, 100_000, 1, 0.5),
    "torus3-1000": (clouds.torus3, 1_000, 2, None),
    "torus3-100000": (clouds.torus3, 100_000, 2, 0.3),
    "sphere10-100000": (clouds.sphere, 100_000, 2, 0.8),
}


def bench(spark: SparkSession, case: str, output: str | None = None, cloud_output: str | None = None, input_path: str | None = None, n: int | None = None) -> dict[int, int]:
    """Runs a case on its generated cloud, or on a CSV of points; writes pairs or returns their number by dimension."""
    make, points, max_dim, threshold = CASES[case]
    cloud: DataFrame = clouds.read_points_csv(spark, input_path) if input_path else make(spark, n or points)
    if cloud_output:
        clouds.write_points_text(cloud, cloud_output)
    found = compute_persistent_homology(cloud, max_dim, threshold=threshold, key="id")
    if output:
        clouds.write_pairs_csv(found.pairs, max_dim, output)
    return {r["dim"]: r["count"] for r in found.pairs.groupBy("dim").count().collect()}


def demo(spark: SparkSession, n: int = 50, dims: int = 8, max_dim: int = 3, image: bool = False) -> dict[int, object]:
    """A uniform cloud's pairs by dimension, or a 100 x 100 image for each dimension from 1 on; an image that can't be
    made gives its error."""
    found = compute_persistent_homology(clouds.uniform(spark, n, dims, seed=None), max_dim, key="id")
    if not image:
        counts = {r["dim"]: r["count"] for r in found.pairs.groupBy("dim").count().collect()}
        return {k: counts.get(k, 0) for k in range(max_dim + 1)}
    out: dict[int, object] = {}
    for k in range(1, max_dim + 1):
        try:
            out[k] = gaussian_image(found.dim(k), 100, 100, 1.0).to_dense_matrix()
        except ArithmeticError as e:
            out[k] = e
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cavern")
    jobs = parser.add_subparsers(dest="job", required=True)
    b = jobs.add_parser("bench")
    b.add_argument("--case", choices=CASES, required=True)
    b.add_argument("--inputPath")
    b.add_argument("--outputPath")
    b.add_argument("--pointsCloudOutputPath")
    b.add_argument("--numberOfPoints", type=int)
    d = jobs.add_parser("demo")
    d.add_argument("--numberOfPoints", type=int, default=50)
    d.add_argument("--dim", type=int, default=8)
    d.add_argument("--maxSimplicesDim", type=int, default=3)
    d.add_argument("--computePersistenceImage", action="store_true")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("cavern").getOrCreate()
    if own.job == "bench":
        print(bench(spark, own.case, own.outputPath, own.pointsCloudOutputPath, own.inputPath, own.numberOfPoints))
    else:
        print(demo(spark, own.numberOfPoints, own.dim, own.maxSimplicesDim, own.computePersistenceImage))


if __name__ == "__main__":
    main()
