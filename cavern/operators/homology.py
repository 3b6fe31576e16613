"""Persistent homology of a point cloud: spanning forests in dimension 0, cohomology reduction above."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import Distance, euclidean
from ..plans.model import INFINITY, PAIRS, Persistence
from ..plans.session import Shared, checkpointed
from .filtration import edges, enclosing_radius, points_table, simplices
from .nearest import joined, nearest_forest
from .reduce import Filtration, columns_of, construct, reduce_matrix

#: Edges that one task of the spanning forest takes.
FOREST_EDGES = 2_000_000
#: Edges that a task holds before it thins them.
HELD_EDGES = 500_000
#: Bytes of coordinates that the reduction above dimension 0 broadcasts at most.
CLOUD_BYTES = 512 << 20


def forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of a minimum spanning forest, by Boruvka's rounds; ties go to the larger index, as cohomology pairs them."""
    a, b, w = (pdf[c].to_numpy() for c in ("a", "b", "w"))
    order = np.lexsort((-b, -a, w))
    points, ends = np.unique(np.stack([a[order], b[order]]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    edge, keep = np.arange(len(u)), np.zeros(len(u), bool)
    component = np.arange(len(points))
    while True:
        apart = component[u] != component[v]
        u, v, edge = u[apart], v[apart], edge[apart]
        if not len(edge):
            return pdf.iloc[order[keep]]
        first = np.full(len(points), len(keep))
        for end in (u, v):
            np.minimum.at(first, component[end], edge)
        chosen = np.flatnonzero(first < len(keep))
        at = np.searchsorted(edge, first[chosen])
        keep[first[chosen]] = True
        component = joined(component, chosen, component[u[at]], component[v[at]])


def forest_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's forest, thinned whenever as many edges again have come."""
    held: list[pd.DataFrame] = []
    least = HELD_EDGES
    for pdf in it:
        held.append(pdf)
        if sum(map(len, held)) >= least:
            held = [forest(pd.concat(held, ignore_index=True))]
            least = max(HELD_EDGES, 2 * len(held[0]))
    if any(map(len, held)):
        yield forest(pd.concat(held, ignore_index=True))


def spanning_forest(edge_table: DataFrame) -> DataFrame:
    """(a, b, w): the forest of the union is the forest of the parts' forests, so parts are thinned, then put together.

    The last part is the forest itself, which has fewer edges than the cloud has points."""
    schema = edge_table.select("a", "b", "w").schema
    rows = checkpointed(edge_table.select("a", "b", "w").mapInPandas(forest_batches, schema))
    while (parts := -(-rows.count() // FOREST_EDGES)) > 1:
        before = rows.rdd.getNumPartitions()
        rows = checkpointed(rows.repartition(min(parts, max(1, before // 2)), "a").mapInPandas(forest_batches, schema))
        if rows.rdd.getNumPartitions() == 1:
            return rows
    return checkpointed(rows.coalesce(1).mapInPandas(forest_batches, schema))


def pairs_of_dim0(points: DataFrame, tree: DataFrame) -> DataFrame:
    """A pair (0, w) for each forest edge of positive length, and an infinite one for each component."""
    finite = tree.where("w > 0").select(F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.col("w").cast("double").alias("death"))
    count = points.count() - tree.count()
    return finite.unionByName(points.sparkSession.range(count).select(F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.lit(INFINITY).alias("death")))


def pairs_of_columns(columns: DataFrame, dim: int) -> DataFrame:
    """(radius, pivot radius) of each column, without pairs of length zero; a column without pivot never dies."""
    death = F.when(F.col("pivot") < 0, F.lit(INFINITY)).otherwise(F.col("pivot_radius"))
    return columns.select(F.lit(dim).alias("dim"), F.col("radius").alias("birth"), death.alias("death")).where("birth <> death")


def persistence_of(points: DataFrame, max_dim: int, distance: Distance | None = None, threshold: float | None = None, precision: str = "float32", partitions: int | None = None) -> Persistence:
    """The pairs of a table (point_id, coords) with dense ids."""
    if max_dim < 0:
        raise ValueError("max_dim can't be negative")
    spark = points.sparkSession
    distance = distance or euclidean(precision)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = checkpointed(points)
    if not points.head(1) or (threshold is not None and threshold < 0):
        return Persistence(spark.createDataFrame([], PAIRS), max_dim)
    if threshold is None:
        threshold = enclosing_radius(points, distance, precision)
    # Both sides of every comparison come from one precision.
    threshold = float(np.dtype(precision).type(threshold))
    if not max_dim:
        return Persistence(pairs_of_dim0(*nearest_forest(points, threshold, distance, precision, spanning_forest)), max_dim)
    edge_table = checkpointed(edges(points, threshold, distance, precision))
    tree = spanning_forest(edge_table)
    found = pairs_of_dim0(points, tree)
    size = points.agg(F.sum(F.size("coords")) * np.dtype(precision).itemsize).first()[0]
    if size > CLOUD_BYTES:
        raise MemoryError(f"the cloud has {size} bytes of coordinates; above dimension 0 every task needs them all, and at most {CLOUD_BYTES} are broadcast")
    rows = points.orderBy("point_id").toPandas()
    coords = np.stack(rows["coords"].to_numpy()).astype(np.dtype(precision))
    own = Filtration(coords, distance, threshold, max_dim)
    filtration, system = Shared(spark, own), own.system
    # The deaths of one dimension are cleared from the next: they are births of nothing.
    deaths = tree.select((F.expr("a * (a - 1) div 2").cast("long") + F.col("b")).alias("index"))
    for dim in range(1, max_dim + 1):
        known = simplices(edge_table, dim).select("index") if threshold < INFINITY else spark.range(system.count(dim + 1)).select(F.col("id").alias("index"))
        known = known.join(deaths, "index", "left_anti")
        columns = reduce_matrix(construct(known, filtration, dim), filtration, dim, system.count(dim + 2), partitions)
        found = found.unionByName(pairs_of_columns(columns, dim))
        # Apparent pairs are in no column, so their deaths are listed beside the pivots.
        deaths = columns.where("pivot >= 0").select(F.col("pivot").alias("index")).unionByName(apparent_deaths(edge_table, filtration, dim)) if dim < max_dim else deaths
    return Persistence(found, max_dim)


def apparent_deaths(edge_table: DataFrame, filtration, dim: int) -> DataFrame:
    """index of the cofacets in zero apparent pairs with simplices of dimension dim."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield columns_of(filtration.value, pdf["index"].to_numpy(np.int64), dim, apparent=True)[["pivot"]].rename(columns={"pivot": "index"})

    return simplices(edge_table, dim).select("index").repartitionByRange("index").sortWithinPartitions("index").mapInPandas(work, "index long")


def compute_persistent_homology(
    cloud: DataFrame, max_dim: int, distance: Distance | None = None, threshold: float | None = None, coords: str = "coords", key: str | None = None, precision: str = "float32", partitions: int | None = None
) -> Persistence:
    """Pairs (dim, birth, death) of the Vietoris-Rips filtration over Z/2 for dimensions 0 to max_dim.

    cloud has a column of float arrays. Without a threshold the enclosing radius is taken; a given one is used as
    it is. precision is float32 or float64.
    """
    return persistence_of(points_table(cloud, coords, key), max_dim, distance, threshold, precision, partitions)
