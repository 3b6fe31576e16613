"""The minimum spanning forest of a cloud from each point's nearest neighbours, without its edge table.

Equal points are one. Each point's nearest neighbours are found, with a bound below which it has no other edge. The
forest of these edges is grown by Boruvka's rounds, in which a component takes its least edge out if no bound of its
points is below it. Where that stops, the points with such bounds ask the whole cloud for edges out of their component;
the largest component need not ask. So every round at least halves the components, and the weights are those of the
minimum spanning forest of all edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import Distance
from ..plans.session import checkpointed
from . import filtration as fl

#: Nearest points that are listed of each chunk.
NEIGHBOURS = 8


def joined(component: np.ndarray, chosen: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each point's component once the chosen ones went along an edge each, whose ends are in x and y."""
    n = len(component)
    up = np.arange(n)
    up[chosen] = np.where(x == chosen, y, x)
    up[(up[up] == np.arange(n)) & (np.arange(n) < up)] = -1  # one of two that chose the same edge
    up = np.where(up < 0, np.arange(n), up)
    while (up[up] != up).any():
        up = up[up]
    return up[component]


def grown(component: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, the edges taken, and each component's least edge out (infinite for none), of edges in their order.

    An edge out is taken if no point of its component has a bound below it."""
    n = len(component)
    at, taken = np.arange(len(w)), []
    while True:
        at = at[component[a[at]] != component[b[at]]]
        first = np.full(n, len(w))
        for end in (a, b):
            np.minimum.at(first, component[end[at]], at)
        least = np.append(w, np.inf)[first]
        known = np.full(n, np.inf)
        np.minimum.at(known, component, bound)
        chosen = np.flatnonzero((first < len(w)) & (least <= known))
        if not len(chosen):
            return component, np.concatenate(taken) if taken else np.empty(0, int), least
        own = first[chosen]
        taken.append(np.unique(own))
        component = joined(component, chosen, component[a[own]], component[b[own]])


def neighbours(rows: DataFrame, distance: Distance, kind: np.dtype, limit: float, block_points: int) -> DataFrame:
    """(a, b, w) within the limit to the nearest points of each chunk, and (a, -1, bound): a's other edges are no shorter."""

    def work(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, y = shared.value
            for own, x in fl.blocks_of(batches, kind, block_points):
                m = len(own)
                r, c, s = np.empty(0, int), np.empty(0, int), np.empty(0)
                kth, slack, pending = np.full(m, np.inf), 0.0, 0
                for k in range(0, len(ids), block_points):
                    rough, step = distance.rough(x, y[k : k + block_points])
                    slack = max(slack, step)
                    _, i, j = np.intersect1d(own, ids[k : k + block_points], assume_unique=True, return_indices=True)
                    rough[i, j] = np.inf
                    if rough.shape[1] > NEIGHBOURS:
                        # No more of a block than it can add to a list.
                        cut = np.minimum(kth, np.partition(rough, NEIGHBOURS - 1, axis=1)[:, NEIGHBOURS - 1]) if np.isinf(kth).any() else kth
                        p, q = np.nonzero((rough <= cut[:, None]) & (rough < np.inf))
                    else:
                        p, q = np.nonzero(rough < np.inf)
                    r, c, s = np.concatenate([r, p]), np.concatenate([c, q + k]), np.concatenate([s, rough[p, q]])
                    pending += len(p)
                    if pending > m * NEIGHBOURS // 2 or k + block_points >= len(ids):
                        order = np.lexsort((s, r))
                        starts = np.searchsorted(r[order], np.arange(m + 1))
                        order = order[np.arange(len(order)) - starts[r[order]] < NEIGHBOURS]
                        r, c, s, pending = r[order], c[order], s[order], 0
                        last = np.full(m, -np.inf)
                        np.maximum.at(last, r, s)
                        kth = np.where(np.bincount(r, minlength=m) == NEIGHBOURS, last, np.inf)
                w = distance.pairs(x[r], y[c]) if distance.pairs else s
                keep = w <= limit
                a = np.concatenate([own[r[keep]], own])
                b = np.concatenate([ids[c[keep]], np.full(m, -1)])
                value = np.concatenate([w[keep], distance.least(kth, slack)])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.float64())], ["a", "b", "w"])

        return nearest

    return fl.united([rows.select("point_id", "coords").mapInArrow(work(shared), "a int, b int, w double") for _, shared in fl.chunks(rows, kind)])


def ways_out(rows: DataFrame, asking: DataFrame, distance: Distance, kind: np.dtype, block_points: int) -> DataFrame:
    """(label, w, a, b): the least edge out of each asking component that is at most its bound. rows have a label."""

    def work(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, labels, bounds = shared.value
            for others, y, theirs in fl.blocks_of(batches, kind, block_points):
                for k in range(0, len(ids), block_points):
                    mine, bound = labels[k : k + block_points], bounds[k : k + block_points]
                    rough, slack = distance.rough(x[k : k + block_points], y)
                    rough[mine[:, None] == theirs[None, :]] = np.inf
                    names, at = np.unique(mine, return_inverse=True)
                    least = np.full(len(names), np.inf)
                    np.minimum.at(least, at, rough.min(axis=1))
                    p, q = np.nonzero((rough <= np.minimum(least[at] + 2 * slack, distance.most(bound) + slack)[:, None]) & (rough < np.inf))
                    w = np.concatenate([distance.pairs(x[k + p[j : j + 4096]], y[q[j : j + 4096]]) for j in range(0, len(p), 4096)]) if distance.pairs and len(p) else rough[p, q]
                    order = np.lexsort((w, at[p]))
                    _, first = np.unique(at[p][order], return_index=True)
                    best = order[first]
                    best = best[w[best] <= bound[p[best]]]
                    if len(best):
                        columns = [pa.array(mine[p[best]], pa.int32()), pa.array(w[best], pa.float64()), pa.array(ids[k + p[best]], pa.int32()), pa.array(others[q[best]], pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, ["label", "w", "a", "b"])

        return out

    found = fl.united([rows.mapInArrow(work(shared), "label int, w double, a int, b int") for _, shared in fl.chunks(asking, kind)])
    return found.groupBy("label").agg(F.min(F.struct("w", "a", "b")).alias("edge")).select("label", "edge.w", "edge.a", "edge.b")


def nearest_forest(points: DataFrame, limit: float | None, distance: Distance, precision: str, forest: Callable[[DataFrame], DataFrame], block_points: int = fl.BLOCK_POINTS) -> tuple[DataFrame, DataFrame]:
    """(points that differ, edges (a, b, w) of their minimum spanning forest within the limit).

    `forest` thins a table of edges to its own forest, which has fewer edges than there are points; it, a bound and a
    component for each point are held on the driver, some 50 bytes a point. Of edges of one length any may be taken."""
    spark, kind = points.sparkSession, np.dtype(precision)
    limit = np.inf if limit is None else limit
    rows = fl.dealt(points.groupBy("coords").agg(F.min("point_id").alias("point_id")).select("point_id", "coords"), block_points)
    if rows.isEmpty():
        return rows, spark.createDataFrame([], "a int, b int, w double")
    found = checkpointed(neighbours(rows, distance, kind, limit, block_points))
    bounds = found.where("b < 0").groupBy("a").agg(F.min("w").alias("w")).toArrow().sort_by("a")
    ids, bound = bounds.column("a").to_numpy(), bounds.column("w").to_numpy().copy()
    tree = forest(found.where("b >= 0")).toArrow()
    a, b, w = (tree.column(c).to_numpy() for c in "abw")
    component, kept = np.arange(len(ids)), []
    while True:
        order = np.lexsort((-b, -a, w))
        a, b, w = a[order], b[order], w[order]
        component, taken, least = grown(component, np.searchsorted(ids, a), np.searchsorted(ids, b), w, bound)
        kept.append((a[taken], b[taken], w[taken]))
        # A component asks for what may be shorter than its least edge out, or within the limit if it has none.
        top = np.minimum(least, limit)[component]
        asks = np.where(least[component] < np.inf, bound < top, bound <= top) & (bound < np.inf)
        asks &= component != np.bincount(component).argmax()
        if not asks.any():
            break
        labels = spark.createDataFrame(pa.table({"point_id": ids, "label": component.astype(np.int32)}))
        own = spark.createDataFrame(pa.table({"point_id": ids[asks], "label": component[asks].astype(np.int32), "bound": top[asks]}))
        asking = checkpointed(rows.join(own, "point_id").select("point_id", "coords", "label", "bound"))
        answer = ways_out(checkpointed(rows.join(labels, "point_id").select("point_id", "coords", "label")), asking, distance, kind, block_points).toArrow()
        label, *edge = (answer.column(c).to_numpy() for c in ("label", "a", "b", "w"))
        # Now no edge out of the component, from a point that asked, is shorter than its least.
        after = least.copy()
        np.minimum.at(after, label, edge[2])
        bound[asks] = after[component[asks]]
        a, b, w = (np.concatenate(c) for c in zip((a, b, w), edge))
    columns = [np.concatenate(c) for c in zip(*kept)]
    return rows, spark.createDataFrame(pa.table(dict(zip("abw", columns))))
