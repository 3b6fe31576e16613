"""Operators 5 and 9: nearest neighbours by a forest of random-projection trees, and exact top-k by segment statistics.

Both hold a stated set of queries against all rows. Queries are broadcast in chunks of bounded size; each task reads
its rows once for every chunk and keeps the k best of each query, which are all that is shuffled.

Shared cases: vectors that are null, hold null or non-finite components, or whose id is null take no part
(operator 5: zero vectors neither); a query's own row is every row of its id; vectors of other lengths than a
query's are no candidates of it; equal vectors tie, and the smaller id goes first; rows that repeat an id and its
vector count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, written

# ---------------------------------------------------------------- shared

#: Numbers that the queries broadcast at once hold: components, and leaves (at most 32 MB).
CHUNK_COMPONENTS = 4_000_000
#: Rows of a table that a task takes in one round.
ROWS = 8_192


def vectors(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding of the rows that take part, each once."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & (F.size(e) > 0)
    fine = fine if zero else fine & F.exists(e, lambda x: x != 0)
    own = rows.select("vec_id", "embedding")
    return own.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine).dropDuplicates(["vec_id", "embedding"])


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def ranked(found: DataFrame, k: int, nearest: bool, kind: str) -> DataFrame:
    """(query_id, vec_id, score) to the k best of each query, with rank; ties go to the smaller vec_id."""
    first = F.asc("score") if nearest else F.desc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(first, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(kind).alias("score"))


def best(ids: np.ndarray, scores: np.ndarray, k: int, nearest: bool) -> np.ndarray:
    """Indices of the k best, in order."""
    key = scores if nearest else -scores
    if len(key) > k:
        near = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
        return near[np.lexsort((ids[near], key[near]))[:k]]
    return np.lexsort((ids, key))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(length, vec_id, vectors) of a batch's vectors of each length, and what other columns it has."""
    others = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("vec_id", "embedding")]
    ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("embedding")
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        yield n, ids[own], flat[offsets[own][:, None] + np.arange(n)].astype(np.float64), *(c[own] for c in others)


def collected(rows: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """(vec_id, vectors) and other columns, by length, of rows of bounded number."""
    table = rows.toArrow().combine_chunks()
    return {n: own for batch in table.to_batches() for n, *own in by_length(batch)}


def against_all(own: DataFrame, asked: DataFrame, search: Callable, kind: str, chunk: int) -> DataFrame:
    """(query_id, vec_id, score): what search(queries, batches) finds in the tasks, over all chunks of queries."""
    spark = own.sparkSession
    schema = f"query_id long, vec_id long, score {kind}"
    size = asked.agg(F.sum(F.size("embedding") + (F.size("leaves") if "leaves" in asked.columns else F.lit(0)) + 1)).first()[0] or 0
    chunks = n_parts(size, chunk)
    found = None
    for k in range(chunks if size else 0):
        part = asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(chunks)) == k)
        shared = spark.sparkContext.broadcast(collected(part))
        rows = own.mapInArrow(lambda it, shared=shared: search(shared.value, it), schema)
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found


def as_batch(query: list[np.ndarray], vec: list[np.ndarray], score: list[np.ndarray], kind) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.empty(0) for c in (query, vec, score)]
    arrays = [pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, kind))]
    return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])


# ---------------------------------------------------------------- operator 5

#: Vectors that the forest's planes are fitted on; every vector is indexed.
SAMPLE = 20_000
TREES, LEAF = 32, 16
#: Vectors that the leaves searched for a query hold, counted once a tree: so many times the table's number to a power.
SEARCH, POWER = 6.0, 0.75
#: Queries whose leaves a task looks up at once: one for each bit of a word.
QUERIES = 64


class Forest:
    """Random-projection trees fitted on a sample; a node splits at the median of a projection.

    Nodes are numbered over all trees; a leaf's number is -1 - its index. A leaf's priority is the sum of the squared
    margins by which a query lies on the other side on the way down.
    """

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        planes, cuts, children, self.roots, sizes = [], [], [], [], []
        for _ in range(trees):
            self.roots.append(0)
            todo = [(np.arange(len(sample)), -1, len(self.roots) - 1)]
            while todo:
                rows, parent, side = todo.pop()
                here = None
                if len(rows) > leaf:
                    a, b = rng.choice(len(rows), 2, replace=False)
                    plane = sample[rows[a]] - sample[rows[b]]
                    plane = plane if plane.any() else rng.standard_normal(sample.shape[1])
                    plane = plane / np.linalg.norm(plane)
                    at = sample[rows] @ plane
                    cut = np.median(at)
                    left = at < cut
                    if left.any() and not left.all():
                        here = len(planes)
                        planes.append(plane)
                        cuts.append(cut)
                        children.append([0, 0])
                        todo += [(rows[left], here, 0), (rows[~left], here, 1)]
                if here is None:
                    here = -1 - len(sizes)
                    sizes.append(len(rows))
                if parent < 0:
                    self.roots[side] = here
                else:
                    children[parent][side] = here
        self.planes = np.array(planes).reshape(-1, sample.shape[1])
        self.cuts, self.children, self.leaf_sizes = np.array(cuts), np.array(children, np.int64).reshape(-1, 2), sizes

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            inner = np.flatnonzero(node >= 0)
            while len(inner):
                n = node[inner]
                right = np.einsum("ij,ij->i", x[inner], self.planes[n]) >= self.cuts[n]
                node[inner] = self.children[n, right.astype(int)]
                inner = inner[node[inner] >= 0]
            out[:, t] = -1 - node
        return out

    def search(self, x: np.ndarray, wanted: float) -> list[np.ndarray]:
        """For each query, the leaves that one queue over all trees gives, until they hold `wanted` sample vectors."""
        left, right = self.children.T.tolist()
        out = []
        for at in range(0, len(x), QUERIES):
            own = x[at : at + QUERIES]
            for margin in own @ self.planes.T - self.cuts if len(self.cuts) else np.empty((len(own), 0)):
                margin = margin.tolist()
                queue = [(0.0, root) for root in self.roots]
                heapq.heapify(queue)
                found, got = [], 0
                while queue and got < wanted:
                    far, node = heapq.heappop(queue)
                    while node >= 0:
                        m = margin[node]
                        heapq.heappush(queue, (far + m * m, left[node] if m >= 0 else right[node]))
                        node = right[node] if m >= 0 else left[node]
                    found.append(-1 - node)
                    got += self.leaf_sizes[-1 - node]
                out.append(np.array(found, np.int32))
        return out


class Forests(dict):
    """Forests by length; a length without one has a tree of a single leaf."""

    def __missing__(self, n: int) -> Forest:
        return Forest(np.zeros((1, n)), 1)


def probe_batches(batches: Iterator[pa.RecordBatch], forests: Forests, wanted: Callable[[int], float]) -> Iterator[pa.RecordBatch]:
    """Queries with the leaves that are searched for them."""
    for batch in batches:
        found: list = [None] * batch.num_rows
        for n, _, x, own in by_length(batch.append_column("at", pa.array(np.arange(batch.num_rows)))):
            for k, leaves in zip(own.tolist(), forests[n].search(x, wanted(n))):
                found[k] = leaves
        yield batch.append_column("leaves", pa.array(found, pa.list_(pa.int32())))


def candidates(leaves: np.ndarray, number: int, searched: list[np.ndarray]) -> np.ndarray:
    """For vectors in the leaves [vector, tree], as many bits as queries: those for which one of its leaves is searched."""
    bits = np.zeros(number, np.uint64)
    for j, own in enumerate(searched):
        bits[own] |= np.uint64(1 << j)
    out = np.zeros(len(leaves), np.uint64)
    for tree in leaves.T:
        out |= bits[tree]
    return out


def k_nearest(ids: np.ndarray, x: np.ndarray, near: np.ndarray, rough: np.ndarray, slack: float, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and exact distance of the k nearest of the vectors x[near], by squared distances `rough` that are off by the slack at most."""
    if len(near) > k:
        near = near[rough[near] <= np.partition(rough[near], k - 1)[k - 1] + slack]
    score, own = np.sqrt(((x[near] - query) ** 2).sum(axis=1)), ids[near]
    at = best(own, score, k, True)
    return own[at], score[at]


def nearest_batches(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[np.ndarray, ...]], forests: Forests, k: int) -> Iterator[pa.RecordBatch]:
    """A task's k nearest candidates of each query."""
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for whole in batches:
        for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
            for n, ids, x in by_length(batch):
                if n not in asked:
                    continue
                query_ids, queries, searched = asked[n]
                leaves, x2 = forests[n].leaves(x), (x**2).sum(axis=1)
                for at in range(0, len(queries), QUERIES):
                    part = slice(at, at + QUERIES)
                    bits = candidates(leaves, len(forests[n].leaf_sizes), searched[part])
                    q2 = (queries[part] ** 2).sum(axis=1)
                    rough = x2 + q2[:, None] - 2 * (queries[part] @ x.T)
                    for j, q in enumerate(range(at, at + len(q2))):
                        near = np.flatnonzero((bits >> np.uint64(j) & np.uint64(1)).astype(bool) & (ids != query_ids[q]))
                        if not len(near):
                            continue
                        own, score = k_nearest(ids, x, near, rough[j], 1e-9 * (q2[j] + x2.max()), queries[q], k)
                        if (n, q) in kept:
                            own, score = np.r_[kept[n, q][0], own], np.r_[kept[n, q][1], score]
                            first = best(own, score, k, True)
                            own, score = own[first], score[first]
                        kept[n, q] = own, score
    yield as_batch([np.full(len(own), asked[n][0][q]) for (n, q), (own, _) in kept.items()], [own for own, _ in kept.values()], [score for _, score in kept.values()], np.float64)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, search: float = SEARCH, chunk: int = CHUNK_COMPONENTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id divisible by `every`) its k nearest found, by Euclidean distance.

    The leaves searched for a query hold search * n ** POWER vectors, counted once a tree, of n in the table."""
    own = written(vectors(rows, zero=False), "vectors")
    n = max(own.count(), 1)
    fitted = collected(own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample))
    # The leaves hold that share of the sample's vectors, and hold k besides the query's own.
    sizes = {length: max(search * n ** (POWER - 1) * len(x), trees * (k + 2)) for length, (_, x) in fitted.items()}
    forests = rows.sparkSession.sparkContext.broadcast(Forests({length: Forest(x, trees, leaf) for length, (_, x) in fitted.items()}))
    asked = own.where(F.col("vec_id") % every == 0)
    probed = asked.mapInArrow(lambda it: probe_batches(it, forests.value, lambda length: sizes.get(length, 1)), asked.select("*", F.array().cast("array<int>").alias("leaves")).schema)
    found = against_all(own, written(probed, "queries"), lambda queries, it: nearest_batches(it, queries, forests.value, k), "double", chunk)
    return ranked(found, k, True, "double")


# ---------------------------------------------------------------- operator 9

#: Numbers of segments, from coarse to fine.
RESOLUTIONS = (1, 4, 16)
#: Queries and candidates whose statistics are compared at once.
QUERY_ROWS, CANDIDATE_ROWS = 2_048, 1_024


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows f(v) such that |f(q) - f(v)| is at most |q - v|: each segment's mean and deviation, by the root of its length."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    roots = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([np.stack([p.mean(axis=1) for p in parts], 1) * roots, np.stack([p.std(axis=1) for p in parts], 1) * roots], 1)


class TopProducts:
    """The k largest inner products of each query with rows of other ids, all integers; rows come block by block.

    q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2, so that a lower bound of the distance bounds the product from above. Once a
    query has k rows, the least of their products is held against the bounds of further rows, from coarse to fine.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.q = queries.astype(np.float64)
        self.q2, self.levels = (self.q**2).sum(axis=1), [statistics(self.q, s) for s in RESOLUTIONS]
        self.largest = float(np.abs(queries).max(initial=0))
        self.kept = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def survivors(self, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the pairs that no bound rules out."""
        row, column = np.nonzero(self.ids[:, None] != ids[None, :])
        v2 = (v**2).sum(axis=1)
        slack = 1e-9 * (self.q2.max(initial=0) + v2.max(initial=0) + 1)
        for s, a in zip(RESOLUTIONS, self.levels):
            if not np.isfinite(self.least).any():
                break
            b = statistics(v, s)
            if len(row) * 4 > len(a) * len(b):
                bound = ((self.q2[:, None] + v2[None, :]) - ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T)) / 2
                stay = bound[row, column] + slack >= self.least[row]
            else:
                stay = (self.q2[row] + v2[column] - ((a[row] - b[column]) ** 2).sum(axis=1)) / 2 + slack >= self.least[row]
            row, column = row[stay], column[stay]
        return row, column

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        row, column = self.survivors(ids, x.astype(np.float64))
        if not len(row):
            return
        exact = self.largest * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52
        wq, wx = (a.astype(np.float64 if exact else object) for a in (self.queries, x))
        if exact and len(row) * 8 > len(wq) * len(wx):
            product = (wq @ wx.T)[row, column]
        else:
            product = np.concatenate([(wq[row[p : p + 65_536]] * wx[column[p : p + 65_536]]).sum(axis=1) for p in range(0, len(row), 65_536)])
        bounds = np.searchsorted(row, np.arange(len(wq) + 1))
        for r in np.unique(row).tolist():
            part = slice(bounds[r], bounds[r + 1])
            own, score = np.r_[self.kept[r][0], ids[column[part]]], np.r_[self.kept[r][1], product[part]]
            pick = best(own, score, self.k, False) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda j: (-score[j], own[j]))[: self.k])
            self.kept[r] = own[pick], score[pick]
            if len(pick) == self.k:
                self.least[r] = float(score[pick[-1]])


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x).astype(np.int64)


def product_batches(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[np.ndarray, ...]], k: int) -> Iterator[pa.RecordBatch]:
    """A task's k largest products of each query."""
    parts = {n: [TopProducts(ids[at : at + QUERY_ROWS], whole(x[at : at + QUERY_ROWS]), k) for at in range(0, len(ids), QUERY_ROWS)] for n, (ids, x) in asked.items()}
    for rows in batches:
        for batch in (rows.slice(at, CANDIDATE_ROWS) for at in range(0, rows.num_rows, CANDIDATE_ROWS)):
            for n, ids, x in by_length(batch):
                for own in parts.get(n, ()):
                    own.add(ids, whole(x))
    found = [(q, *kept) for own in sum(parts.values(), []) for q, kept in zip(own.ids, own.kept)]
    yield as_batch([np.full(len(ids), q) for q, ids, _ in found], [ids for _, ids, _ in found], [score for _, _, score in found], np.int64)


def top_k(rows: DataFrame, k: int = 5, every: int = 50, chunk: int = CHUNK_COMPONENTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id divisible by `every`) its k largest integer inner products.

    Components count as floor(256 x). What leaves a task is k rows a query.
    """
    own = written(vectors(rows, zero=True), "vectors")
    found = against_all(own, own.where(F.col("vec_id") % every == 0), lambda queries, it: product_batches(it, queries, k), "long", chunk)
    return ranked(found, k, False, "long")
