"""Facets, cofacets, pivots, apparent pairs, clearing and the pivot histogram, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cns import index_of
from .filtration import vertex_columns


def facets(simplex_table: DataFrame, dim: int, edge_table: DataFrame | None = None) -> DataFrame:
    """(tidx, tradius, position, removed, eidx): the facets of each simplex by rising index, from its vertex columns.

    With the edge table, `eradius` is the facet's own radius.
    """
    names = vertex_columns(dim)
    each = [F.struct(F.lit(k).alias("position"), F.col(names[k]).alias("removed"), index_of([F.col(c) for c in names[:k] + names[k + 1 :]]).alias("eidx")) for k in range(dim + 1)]
    table = simplex_table
    if edge_table is not None:
        for i in range(dim + 1):
            for j in range(i + 1, dim + 1):
                table = table.join(edge_table.select(F.col("a").alias(f"v{i}"), F.col("b").alias(f"v{j}"), F.col("w").alias(f"w{i}_{j}")), [f"v{i}", f"v{j}"])

        def radius(k: int) -> Column:
            found = [F.col(f"w{i}_{j}") for i in range(dim + 1) for j in range(i + 1, dim + 1) if k not in (i, j)]
            return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(0.0).cast(edge_table.schema["w"].dataType)

        each = [F.struct(F.lit(k).alias("position"), F.col(names[k]).alias("removed"), index_of([F.col(c) for c in names[:k] + names[k + 1 :]]).alias("eidx"), radius(k).alias("eradius")) for k in range(dim + 1)]
    return table.select(F.col("index").alias("tidx"), F.col("radius").alias("tradius"), F.inline(F.array(*each)))


def incidences(lower: DataFrame, upper: DataFrame, dim: int) -> DataFrame:
    """(eidx, eradius, tidx, tradius) of each simplex of dimension `dim` and each of its cofacets in the complex."""
    return facets(upper, dim + 1).join(lower.select(F.col("index").alias("eidx"), F.col("radius").alias("eradius")), "eidx").select("eidx", "eradius", "tidx", "tradius")


def pivots(incidence: DataFrame) -> DataFrame:
    """(eidx, eradius, pivot, pivot_radius): of each simplex's cofacets the least radius, ties to the largest index."""
    best = F.max_by(F.struct("tidx", "tradius"), F.struct((-F.col("tradius")).alias("r"), F.col("tidx"))).alias("best")
    return incidence.groupBy("eidx", "eradius").agg(best).select("eidx", "eradius", F.col("best.tidx").alias("pivot"), F.col("best.tradius").alias("pivot_radius"))


def pivot_or_none(column: str = "top_entries") -> Column:
    """The pivot's index of an array of (index, radius) entries in order; -1 if there is none."""
    return F.coalesce(F.try_element_at(F.col(column), F.lit(1)).getField("index"), F.lit(-1).cast("long"))


def apparent_pairs(incidence: DataFrame) -> DataFrame:
    """(eidx, tidx, radius) where the simplex's largest cofacet and the cofacet's smallest facet of equal radius meet."""
    tied = incidence.where("eradius = tradius")
    up = tied.groupBy("eidx").agg(F.max("tidx").alias("tidx"), F.first("eradius").alias("radius"))
    down = tied.groupBy("tidx").agg(F.min("eidx").alias("eidx"))
    return up.join(down, ["eidx", "tidx"])


def cleared(simplex_table: DataFrame, previous_pivots: DataFrame) -> DataFrame:
    """The simplices that were no pivot (column `pivot`) one dimension below."""
    return simplex_table.join(previous_pivots.select(F.col("pivot").alias("index")), "index", "left_anti")


def pivot_histogram(pivot_table: DataFrame, chunk: int) -> DataFrame:
    """(pivots_start, pivots_end, count): how many pivots fall in each run of `chunk` indices."""
    start = F.call_function("div", F.col("pivot"), F.lit(chunk).cast("long")) * chunk
    return pivot_table.groupBy(start.alias("pivots_start")).count().select("pivots_start", (F.col("pivots_start") + chunk - 1).alias("pivots_end"), "count")


def equal_depth_boundaries(histogram: list[tuple[int, int, int]], partitions: int) -> list[int]:
    """Rising last pivots of the parts: the chunk ends whose running count is nearest to each multiple of a part's share.

    The histogram's rows are (start, end, count); there are at most ten a partition, so they fit the driver.
    """
    rows = sorted(histogram)
    total = sum(count for _, _, count in rows)
    if not total or partitions <= 1:
        return []
    running, ends = 0, []
    for _, end, count in rows[:-1]:
        running += count
        ends.append((running, end))
    wanted = [total * k / partitions for k in range(1, partitions)]
    found = {min(ends, key=lambda e: abs(e[0] - w))[1] for w in wanted} if ends else set()
    if len(found) < partitions - 1:
        found.add(rows[-1][1])
    return sorted(found)


def partition_of(pivot: Column, boundaries: list[int]) -> Column:
    """The part of a pivot: the number of boundaries below it; none (-1) is in part 0."""
    return F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in boundaries)), lambda b: b < pivot)) if boundaries else F.lit(0)
