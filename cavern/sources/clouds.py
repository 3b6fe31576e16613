"""Sources and sinks: generated clouds, tables of vectors, CSV and text files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _noise(seed: int, width: float) -> Column:
    return (F.rand(seed) - 0.5) * width


def _cloud(spark: SparkSession, n: int, coords: list[Column]) -> DataFrame:
    return spark.range(n).select(F.col("id"), *(c.alias(f"c{k}") for k, c in enumerate(coords))).select("id", F.array(*(F.col(f"c{k}").cast("float") for k in range(len(coords)))).alias("coords"))


def torus2(spark: SparkSession, n: int, seed: int = 42, major: float = 2.0, minor: float = 1.0, noise: float = 0.05) -> DataFrame:
    """A noisy 2-torus in three dimensions."""
    u, v = F.rand(seed) * 2 * math.pi, F.rand(seed + 1) * 2 * math.pi
    ring = F.lit(major) + F.lit(minor) * F.cos(v)
    return _cloud(spark, n, [ring * F.cos(u) + _noise(seed + 2, noise), ring * F.sin(u) + _noise(seed + 3, noise), F.lit(minor) * F.sin(v) + _noise(seed + 4, noise)])


def torus3(spark: SparkSession, n: int, seed: int = 42, dims: int = 100, noise: float = 0.01) -> DataFrame:
    """A 3-torus, three circles in six coordinates, noisy in all of `dims` dimensions."""
    angles = [F.rand(seed + k) * 2 * math.pi for k in range(3)]
    own = [f(a) for a in angles for f in (F.cos, F.sin)]
    return _cloud(spark, n, [(own[k] if k < 6 else F.lit(0.0)) + _noise(seed + 10 + k, noise) for k in range(dims)])


def sphere(spark: SparkSession, n: int, sphere_dim: int = 10, seed: int = 42, dims: int = 100, noise: float = 0.01) -> DataFrame:
    """A sphere, Gaussian vectors brought to length one, noisy in all of `dims` dimensions."""
    raw = spark.range(n).select("id", *(F.randn(seed + k).alias(f"g{k}") for k in range(sphere_dim + 1)))
    length = F.sqrt(sum((F.col(f"g{k}") * F.col(f"g{k}") for k in range(sphere_dim + 1)), F.lit(0.0)))
    coords = [(F.col(f"g{k}") / length if k <= sphere_dim else F.lit(0.0)) + _noise(seed + 1000 + k, noise) for k in range(dims)]
    return raw.select("id", F.array(*(c.cast("float") for c in coords)).alias("coords"))


def uniform(spark: SparkSession, n: int, dims: int, high: float = 1000.0, seed: int | None = None) -> DataFrame:
    """Uniform in a cube; without a seed each run differs."""
    return _cloud(spark, n, [(F.rand() if seed is None else F.rand(seed + k)) * high for k in range(dims)])


def from_collection(spark: SparkSession, points: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "id long, coords array<float>")


def from_parquet(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """(id, coords) of a table; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("coords"))


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headerless file of one point a line; the text's order is kept by file and offset."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    coords = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("float"))
    return lines.select(F.monotonically_increasing_id().alias("id"), coords.alias("coords"))


def read_pairs_csv(spark: SparkSession, path: str, dim: int, header: bool = False) -> DataFrame:
    """A headerless file of birth,death, or one whose header names them; inf is infinity."""
    number = lambda c: F.when(F.lower(F.trim(c)).isin("inf", "infinity", "+inf"), F.lit(float("inf"))).otherwise(F.trim(c).cast("double"))
    rows = spark.read.option("header", True).csv(path) if header else spark.read.schema("birth string, death string").csv(path)
    return rows.select(F.lit(dim).alias("dim"), number("birth").alias("birth"), number("death").alias("death"))


def write_points_text(cloud: DataFrame, path: str) -> None:
    """One comma-joined line a point, in one file."""
    cloud.select(F.concat_ws(",", F.transform("coords", lambda x: x.cast("string"))).alias("value")).coalesce(1).write.text(path)


def write_pairs_csv(pairs: DataFrame, max_dim: int, path: str) -> None:
    """A CSV folder with header for each dimension, dim_0, dim_1, ..."""
    for dim in range(max_dim + 1):
        pairs.where(F.col("dim") == dim).write.option("header", True).csv(f"{path}/dim_{dim}")
