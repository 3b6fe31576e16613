"""Schemas and value objects of point clouds, persistence pairs and images."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")

PAIRS = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("birth", T.DoubleType()), T.StructField("death", T.DoubleType())])


def is_infinite() -> Column:
    """Whether a pair never dies."""
    return F.col("death") == F.lit(INFINITY)


def is_finite() -> Column:
    return ~is_infinite()


def persistence() -> Column:
    """death - birth; infinity for a pair that never dies."""
    return (F.col("death") - F.col("birth")).alias("persistence")


@dataclass(frozen=True)
class Persistence:
    """The pairs of all dimensions, one DataFrame (dim, birth, death)."""

    pairs: DataFrame
    max_dim: int

    def dim(self, k: int) -> DataFrame:
        if not 0 <= k <= self.max_dim:
            raise IndexError(f"dimension {k} is not in 0..{self.max_dim}")
        return self.pairs.where(F.col("dim") == k)


@dataclass(frozen=True)
class ImageBound:
    low: float
    high: float


@dataclass(frozen=True)
class BoundsConfig:
    """Bounds of an image's axes; one that is missing is taken from the pairs."""

    min_birth: float | None = None
    max_birth: float | None = None
    min_persistence: float | None = None
    max_persistence: float | None = None

    def validate(self) -> None:
        said = [
            f"min_{name} ({low}) must be below max_{name} ({high})"
            for name, low, high in (("birth", self.min_birth, self.max_birth), ("persistence", self.min_persistence, self.max_persistence))
            if low is not None and high is not None and low >= high
        ]
        if said:
            raise ValueError("; ".join(said))


@dataclass(frozen=True)
class PersistenceImage:
    """pixels (i, j, value), i along birth and j along persistence, every pixel once."""

    pixels: DataFrame
    n_birth: int
    n_persistence: int
    birth: ImageBound
    persistence: ImageBound

    def to_dense_matrix(self) -> DenseMatrix:
        """Rows along birth, columns along persistence; an image is small by its parameters."""
        values = [0.0] * (self.n_birth * self.n_persistence)
        for r in self.pixels.collect():
            values[r.j * self.n_birth + r.i] = r.value
        return DenseMatrix(self.n_birth, self.n_persistence, values)
