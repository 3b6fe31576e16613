"""Reduction of the coboundary matrix over Z/2: numpy kernels, run by Spark in pivot ranges until no pivot moves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import Distance
from .cns import CombinatorialNumberSystem
from .incidence import equal_depth_boundaries, partition_of, pivot_histogram

#: Points up to which a matrix of distances is held (64 MB of float32): of the whole cloud, else of a vertex's neighbours.
MATRIX_POINTS = 4_000
#: Bytes of distances from simplices to points that are looked at together, and of neighbours that a worker remembers.
BATCH_BYTES, NEIGHBOUR_BYTES = 32 << 20, 64 << 20
BATCH = 2_048


class Local:
    """The points that simplices of one largest vertex can have for cofacets, and their distances.

    Vertices and points are numbered by their places in `ids`, which rise; so a larger vertex has a larger place.
    """

    def __init__(self, cloud: Filtration, ids: np.ndarray, whole: bool):
        self.ids, self.points, self.block, self.threshold = ids, cloud.coords[ids], cloud.distance.block, cloud.threshold
        self.matrix = self.block(self.points, self.points) if whole and len(ids) <= MATRIX_POINTS else None

    def batch(self) -> int:
        return int(min(BATCH, max(1, BATCH_BYTES // max(1, len(self.ids) * self.points.itemsize))))

    def rows(self, vertices: np.ndarray) -> np.ndarray:
        """[vertex, point]: distances from the vertices to every point."""
        if self.matrix is not None:
            return self.matrix[vertices]
        own, into = np.unique(vertices, return_inverse=True)
        return self.block(self.points[own], self.points)[into]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distance of each pair of vertices."""
        if self.matrix is not None:
            return self.matrix[a, b]
        x, at_x = np.unique(a, return_inverse=True)
        y, at_y = np.unique(b, return_inverse=True)
        return self.block(self.points[x], self.points[y])[at_x, at_y]

    def radius(self, vertices: np.ndarray) -> np.ndarray:
        """Radii of simplices [simplex, vertex]."""
        out = np.zeros(len(vertices), self.points.dtype)
        for i in range(vertices.shape[1]):
            for j in range(i):
                out = np.maximum(out, self.between(vertices[:, i], vertices[:, j]))
        return out

    def cofacet_radii(self, vertices: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """[simplex, point]: the radius with the point added; infinite where it is a vertex or beyond the threshold."""
        out = np.repeat(radius[:, None], len(self.ids), axis=1)
        for i in range(vertices.shape[1]):
            np.maximum(out, self.rows(vertices[:, i]), out=out)
        out[np.arange(len(vertices))[:, None], vertices] = np.inf
        out[out > self.threshold] = np.inf
        return out

    def pivots(self, vertices: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each simplex's cofacets, the added point (-1: no cofacet) and radius of the first: least radius, largest index."""
        radii = self.cofacet_radii(vertices, radius)
        # With a simplex fixed, a larger vertex added makes a larger index.
        added = len(self.ids) - 1 - np.argmin(radii[:, ::-1], axis=1)
        least = radii[np.arange(len(vertices)), added]
        return np.where(np.isinf(least), -1, added), least

    def first_facet_is(self, cofacets: np.ndarray, radius: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Whether the facet without `added` is the smallest-index facet of the cofacet's radius: no larger vertex can go."""
        out = np.ones(len(cofacets), bool)
        for k in range(cofacets.shape[1]):
            larger = cofacets[:, k] > added
            same = self.radius(np.delete(cofacets, k, axis=1)) == radius
            out &= ~(larger & same)
        return out


def with_vertex(vertices: np.ndarray, added: np.ndarray) -> np.ndarray:
    return -np.sort(-np.column_stack([vertices, added]), axis=1)


class Filtration:
    """Simplices by index over a cloud, their radii and cofacets; sent to every task."""

    def __init__(self, coords: np.ndarray, distance: Distance, threshold: float, max_dim: int):
        self.coords, self.distance = coords, distance
        self.n, self.threshold = len(coords), threshold
        self.system = CombinatorialNumberSystem(self.n, max_dim + 2)
        self.every = Local(self, np.arange(self.n), True) if self.n <= MATRIX_POINTS else None
        self.neighbours = None

    def __getstate__(self):
        return self.__dict__ | {"neighbours": None}

    def _neighbours(self, v: int) -> np.ndarray:
        near = self.distance.block(self.coords[v : v + 1], self.coords)[0] <= self.threshold
        near[v] = True
        return np.flatnonzero(near)

    def local(self, v: int, whole: bool) -> Local:
        """What simplices of the largest vertex v need; `whole` for many of them."""
        if self.every is not None:
            return self.every
        if self.neighbours is None:
            self.neighbours = lru_cache(maxsize=max(16, NEIGHBOUR_BYTES // (8 * self.n)))(self._neighbours)
        return Local(self, self.neighbours(v), whole)

    def groups(self, indices: np.ndarray, dim: int) -> Iterator[tuple[Local, np.ndarray, np.ndarray]]:
        """Batches (local, indices, vertices as places) of the simplices in the complex."""
        vertices = self.system.decode_all(indices, dim + 1)
        if self.every is not None:
            bounds = [0, len(indices)]
        else:
            order = np.argsort(vertices[:, 0], kind="stable")
            indices, vertices = indices[order], vertices[order]
            bounds = [0, *(np.flatnonzero(np.diff(vertices[:, 0])) + 1).tolist(), len(indices)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            local = self.local(int(vertices[a, 0]), True)
            places = np.minimum(np.searchsorted(local.ids, vertices[a:b]), len(local.ids) - 1)
            own = np.flatnonzero((local.ids[places] == vertices[a:b]).all(axis=1))
            for at in range(0, len(own), local.batch()):
                part = own[at : at + local.batch()]
                yield local, indices[a:b][part], places[part]

    def single(self, vertices: np.ndarray) -> tuple[Local, np.ndarray]:
        """The local points of one simplex [1, vertex] of the complex, and its vertices' places."""
        local = self.local(int(vertices[0, 0]), False)
        return local, np.searchsorted(local.ids, vertices)

    def apparent_birth(self, cofacet: int, radius: float, dim: int) -> int | None:
        """The simplex of dimension dim in a zero apparent pair with this cofacet."""
        own = np.array([self.system.decode(cofacet, dim + 2)])
        for k in range(dim + 2):  # the larger the vertex that goes, the smaller the facet's index
            facet = np.delete(own, k, axis=1)
            local, places = self.single(facet)
            r = local.radius(places)
            if r[0] == radius:
                added, least = local.pivots(places, r)
                return int(self.system.encode_all(facet)[0]) if added[0] >= 0 and local.ids[added[0]] == own[0, k] and least[0] == radius else None
        return None

    def coboundary(self, index: int, dim: int) -> list[tuple[float, int]]:
        """(radius, -index) of the cofacets in the complex."""
        own = np.array([self.system.decode(index, dim + 1)])
        local, places = self.single(own)
        radii = local.cofacet_radii(places, local.radius(places))[0]
        added = np.flatnonzero(np.isfinite(radii))
        if not len(added):
            return []
        cofacets = with_vertex(np.repeat(own, len(added), axis=0), local.ids[added])
        return list(zip(radii[added].tolist(), (-self.system.encode_all(cofacets)).tolist()))


def columns_of(filtration: Filtration, indices: np.ndarray, dim: int, apparent: bool = False) -> pd.DataFrame:
    """index, radius, pivot (-1: none), pivot_radius of the simplices in the complex but no births of apparent pairs;
    with `apparent`, of just these births."""
    out = []
    for local, own, places in filtration.groups(indices, dim):
        radius = local.radius(places)
        inside = radius <= filtration.threshold
        own, places, radius = own[inside], places[inside], radius[inside]
        added, least = local.pivots(places, radius)
        pivot = np.where(added >= 0, filtration.system.encode_all(local.ids[with_vertex(places, np.maximum(added, 0))]), -1)
        tied = np.flatnonzero((added >= 0) & (least == radius))
        keep = np.full(len(own), not apparent)
        keep[tied] ^= local.first_facet_is(with_vertex(places[tied], added[tied]), radius[tied], added[tied])
        out.append(pd.DataFrame({"index": own[keep], "radius": radius[keep].astype(float), "pivot": pivot[keep], "pivot_radius": least[keep].astype(float)}))
    none = pd.DataFrame({"index": np.empty(0, np.int64), "radius": np.empty(0), "pivot": np.empty(0, np.int64), "pivot_radius": np.empty(0)})
    return pd.concat([none, *out], ignore_index=True)


class WorkingColumn:
    """A column under reduction: a heap of cofacets in which equal ones cancel, and its summands."""

    def __init__(self, filtration: Filtration, dim: int, summands: list[int]):
        self.filtration, self.dim = filtration, dim
        self.heap: list[tuple[float, int]] = []
        self.summands: set[int] = set()
        for s in summands:
            self.add(s)

    def add(self, simplex: int) -> None:
        self.summands ^= {simplex}
        own = self.filtration.coboundary(simplex, self.dim)
        if len(own) * 4 > len(self.heap):
            self.heap += own
            heapq.heapify(self.heap)
        else:
            for x in own:
                heapq.heappush(self.heap, x)

    def pivot(self) -> tuple[int, float]:
        """The index and radius of the first cofacet that doesn't cancel; -1 if none is left."""
        heap = self.heap
        while heap:
            first = heapq.heappop(heap)
            if heap and heap[0] == first:
                heapq.heappop(heap)
                continue
            heapq.heappush(heap, first)
            return -first[1], first[0]
        return -1, float("inf")


def reduce_columns(columns: pd.DataFrame, filtration: Filtration, dim: int) -> pd.DataFrame:
    """Reduces columns (index, radius, pivot, pivot_radius, summands) among themselves, from the first in the filtration on.

    An earlier column is added to a later one while both have the same pivot; a pivot that is the death of an
    apparent pair takes its birth's column, which is in no partition.
    """
    columns = columns.sort_values(["radius", "index"], ascending=[False, True], ignore_index=True)
    owner: dict[int, int] = {}
    reduced: list[list[int]] = []
    births: dict[int, int | None] = {}
    pivots, radii, changed = columns["pivot"].tolist(), columns["pivot_radius"].tolist(), [False] * len(columns)
    for k, start in enumerate(columns["summands"]):
        working: WorkingColumn | None = None
        pivot, radius = int(pivots[k]), radii[k]
        own = list(start)
        while pivot >= 0:
            if pivot in owner:
                more = reduced[owner[pivot]]
            else:
                if pivot not in births:
                    births[pivot] = filtration.apparent_birth(pivot, radius, dim)
                if births[pivot] is None:
                    break
                more = [births[pivot]]
            working = working or WorkingColumn(filtration, dim, own)
            for s in more:
                working.add(s)
            pivot, radius = working.pivot()
            changed[k] = True
        if working:
            own = sorted(working.summands)
        if pivot >= 0:
            owner[pivot] = k
        reduced.append(own)
        pivots[k], radii[k] = pivot, radius
    return columns.assign(pivot=np.array(pivots, np.int64), pivot_radius=radii, summands=reduced, changed=changed)


SCHEMA = "index long, radius double, pivot long, pivot_radius double, summands array<long>"


def construct(simplex_indices: DataFrame, filtration, dim: int) -> DataFrame:
    """From (index) of the simplices that aren't cleared to the columns of the coboundary matrix."""

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = columns_of(filtration.value, pdf["index"].to_numpy(np.int64), dim)
            yield found.assign(summands=pd.Series([[i] for i in found["index"]], dtype=object))

    # In ranges of indices, so that simplices of one largest vertex come together.
    return simplex_indices.select("index").repartitionByRange("index").sortWithinPartitions("index").mapInPandas(build, SCHEMA)


def reduce_matrix(columns: DataFrame, filtration, dim: int, count: int, partitions: int) -> DataFrame:
    """Columns to columns with unique pivots. Each pass deals them by ranges of pivots with equal shares and reduces
    each range on its own; when no pivot has changed, all columns of a pivot have met, so pivots are unique."""
    from ..plans.session import checkpointed

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [p for p in it if len(p)]
        if own:
            yield reduce_columns(pd.concat(own), filtration.value, dim)

    columns = checkpointed(columns)
    # Finer than the parts, so that their cuts come near equal shares, and few enough for the driver.
    chunk = max(1, count // (10 * partitions))
    while True:
        histogram = [tuple(r) for r in pivot_histogram(columns.where("pivot >= 0"), chunk).collect()]
        cuts = equal_depth_boundaries(histogram, partitions)
        dealt = columns.repartitionById(max(1, len(cuts) + 1), partition_of(F.col("pivot"), cuts).cast("int"))
        columns = checkpointed(dealt.select("index", "radius", "pivot", "pivot_radius", "summands").mapInPandas(work, SCHEMA + ", changed boolean"))
        if not columns.where("changed").head(1):
            return columns.select("index", "radius", "pivot", "pivot_radius")
