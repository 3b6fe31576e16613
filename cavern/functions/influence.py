"""Influence distributions and weightings of persistence images, as column builders."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (birth, persistence, x, y) to the density at (x, y) of a pair at (birth, persistence).
Influence = Callable[[Column, Column, Column, Column], Column]
#: (birth, persistence) to a weight.
Weighting = Callable[[Column, Column], Column]


def by_persistence(birth: Column, persistence: Column) -> Column:
    return persistence


@dataclass(frozen=True)
class Gaussian:
    """An axis-parallel Gaussian; it factorises, which images make use of."""

    var_birth: float
    var_persistence: float

    def __post_init__(self) -> None:
        if self.var_birth <= 0 or self.var_persistence <= 0:
            raise ValueError("variances must be positive")

    def __call__(self, birth: Column, persistence: Column, x: Column, y: Column) -> Column:
        norm = 1 / (2 * math.pi * math.sqrt(self.var_birth) * math.sqrt(self.var_persistence))
        return F.lit(norm) * F.exp(-(x - birth) * (x - birth) / (2 * self.var_birth) - (y - persistence) * (y - persistence) / (2 * self.var_persistence))

    @staticmethod
    def axis_midpoint(centres: np.ndarray, variance: float, low: float, size: float, n: int, samples: int) -> np.ndarray:
        """[pair, pixel]: the integral over each pixel's side by the midpoint rule."""
        at = low + size * (np.arange(n * samples) + 0.5) / samples
        density = np.exp(-((at[None, :] - centres[:, None]) ** 2) / (2 * variance)) / math.sqrt(2 * math.pi * variance)
        return density.reshape(len(centres), n, samples).sum(axis=2) * size / samples

    @staticmethod
    def axis_exact(centres: np.ndarray, variance: float, low: float, size: float, n: int) -> np.ndarray:
        """[pair, pixel]: the integral by differences of the error function."""
        edges = (low + size * np.arange(n + 1)[None, :] - centres[:, None]) / math.sqrt(2 * variance)
        values = np.array([math.erf(e) for e in edges.ravel()]).reshape(edges.shape)
        return np.diff(values, axis=1) / 2
