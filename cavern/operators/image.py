"""Persistence images: weighted sums of influence distributions, integrated over a grid of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.influence import Gaussian, Influence, Weighting, by_persistence
from ..plans.model import BoundsConfig, ImageBound, PersistenceImage, is_finite, persistence

#: Sample points along each side of a pixel.
SAMPLES = 3


def finite_points(pairs: DataFrame) -> DataFrame:
    """(birth, persistence) of the pairs that die."""
    return pairs.where(is_finite()).select(F.col("birth").cast("double").alias("birth"), persistence().cast("double").alias("persistence"))


def resolve_bounds(points: DataFrame, bounds: BoundsConfig) -> tuple[ImageBound, ImageBound]:
    """The axes' bounds: as given, else the least and largest of the points; zero without points."""
    bounds.validate()
    given = (bounds.min_birth, bounds.max_birth, bounds.min_persistence, bounds.max_persistence)
    found = given
    if None in given:
        row = points.agg(F.min("birth"), F.max("birth"), F.min("persistence"), F.max("persistence")).first()
        found = tuple(g if g is not None else (r if r is not None else 0.0) for g, r in zip(given, row))
    return ImageBound(float(found[0]), float(found[1])), ImageBound(float(found[2]), float(found[3]))


def pixel_sizes(birth: ImageBound, persist: ImageBound, n_birth: int, n_persistence: int) -> tuple[float, float]:
    """Sides of a pixel; an error unless both are positive and finite."""
    out = []
    for name, bound, n in (("birth", birth, n_birth), ("persistence", persist, n_persistence)):
        size = (bound.high - bound.low) / n if n > 0 else float("inf")
        if not 0 < size < float("inf"):
            raise ArithmeticError(f"pixels have no positive size along {name}: bounds {bound.low} to {bound.high}, {n} pixels")
        out.append(size)
    return out[0], out[1]


def grid(spark, n_birth: int, n_persistence: int) -> DataFrame:
    """Every pixel (i, j) once."""
    return spark.range(n_birth * n_persistence).select((F.col("id") % n_birth).cast("int").alias("i"), F.call_function("div", F.col("id"), F.lit(n_birth)).cast("int").alias("j"))


def persistence_image(
    pairs: DataFrame, n_birth: int, n_persistence: int, influence: Influence, weighting: Weighting = by_persistence, bounds: BoundsConfig = BoundsConfig(), samples: int = SAMPLES, method: str = "midpoint", seed: int = 0
) -> PersistenceImage:
    """The image of pairs (birth, death) of one dimension; pairs that never die have no part.

    method: midpoint takes `samples` squared points of a fixed grid in each pixel; exact integrates Gaussians by the
    error function; random takes `samples` points drawn in each pixel, from a seed.
    """
    bounds.validate()
    points = finite_points(pairs)
    birth, persist = resolve_bounds(points, bounds)
    sizes = pixel_sizes(birth, persist, n_birth, n_persistence)
    weighted = points.select("birth", "persistence", weighting(F.col("birth"), F.col("persistence")).alias("weight"))
    if isinstance(influence, Gaussian) and method in ("midpoint", "exact"):
        sums = _separable(weighted, influence, birth, persist, sizes, n_birth, n_persistence, samples if method == "midpoint" else None)
    elif method == "exact":
        raise ValueError("only Gaussian influences are integrated exactly")
    else:
        sums = _general(weighted, influence, birth, persist, sizes, n_birth, n_persistence, samples, method, seed)
    pixels = grid(pairs.sparkSession, n_birth, n_persistence).join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))
    return PersistenceImage(pixels, n_birth, n_persistence, birth, persist)


def _separable(weighted, influence, birth, persist, sizes, n_birth, n_persistence, samples) -> DataFrame:
    """A Gaussian factorises: a vector along each axis for each pair, and a sum of outer products in each partition."""

    def axis(centres, variance, low, size, n):
        if samples is None:
            return Gaussian.axis_exact(centres, variance, low, size, n)
        return Gaussian.axis_midpoint(centres, variance, low, size, n, samples)

    def outer(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_birth, n_persistence))
        for pdf in it:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                x = axis(part["birth"].to_numpy(float), influence.var_birth, birth.low, sizes[0], n_birth)
                y = axis(part["persistence"].to_numpy(float), influence.var_persistence, persist.low, sizes[1], n_persistence)
                total += (x * part["weight"].to_numpy(float)[:, None]).T @ y
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "value": total[i, j]})

    return weighted.mapInPandas(outer, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def _general(weighted, influence, birth, persist, sizes, n_birth, n_persistence, samples, method, seed) -> DataFrame:
    """Pairs by sample points of the broadcast grid, whose size is a parameter, in Catalyst expressions."""
    points = grid(weighted.sparkSession, n_birth, n_persistence)
    if method == "random":
        points = points.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples)))).select("i", "j", (F.col("i") + F.rand(seed)).alias("x"), (F.col("j") + F.rand(seed + 1)).alias("y"))
        share = 1 / samples
    else:
        each = F.sequence(F.lit(0), F.lit(samples - 1))
        points = points.withColumn("sx", F.explode(each)).withColumn("sy", F.explode(each))
        points = points.select("i", "j", (F.col("i") + (F.col("sx") + 0.5) / samples).alias("x"), (F.col("j") + (F.col("sy") + 0.5) / samples).alias("y"))
        share = 1 / samples**2
    points = points.select("i", "j", (F.lit(birth.low) + F.lit(sizes[0]) * F.col("x")).alias("x"), (F.lit(persist.low) + F.lit(sizes[1]) * F.col("y")).alias("y"))
    area = sizes[0] * sizes[1] * share
    value = F.col("weight") * influence(F.col("birth"), F.col("persistence"), F.col("x"), F.col("y")) * area
    return weighted.crossJoin(F.broadcast(points)).groupBy("i", "j").agg(F.sum(value).alias("value"))


def gaussian_image(pairs: DataFrame, n_birth: int, n_persistence: int, var_birth: float, var_persistence: float | None = None, bounds: BoundsConfig = BoundsConfig(), **options) -> PersistenceImage:
    """With Gaussian influence, of one variance for both axes or of two."""
    return persistence_image(pairs, n_birth, n_persistence, Gaussian(var_birth, var_birth if var_persistence is None else var_persistence), bounds=bounds, **options)


def integral_over_rectangle(f, corner: tuple[float, float], lx: float, ly: float, samples: int = 20, seed: int | None = None) -> float:
    """The integral of a numpy function of (x, y) over a rectangle: area times the mean at random points, or at the
    midpoints of a grid of samples squared points where no seed is given."""
    if seed is None:
        at = (np.arange(samples) + 0.5) / samples
        x, y = (g.ravel() for g in np.meshgrid(corner[0] + lx * at, corner[1] + ly * at))
    else:
        r = np.random.default_rng(seed)
        x, y = corner[0] + lx * r.random(samples), corner[1] + ly * r.random(samples)
    return float(lx * ly * np.mean(f(x, y) + np.zeros(len(x))))
