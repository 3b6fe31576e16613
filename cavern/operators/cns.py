"""The combinatorial number system: simplices of n vertices as integers, with their facets and cofacets."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1


class CombinatorialNumberSystem:
    """Combinations of up to `largest` of n elements; their counts must fit 64 bits."""

    def __init__(self, n: int, largest: int):
        if n < 0 or largest < 0:
            raise ValueError("sizes can't be negative")
        if math.comb(n, min(largest, n // 2)) > LONG_MAX:
            raise OverflowError(f"combinations of {largest} of {n} don't fit 64 bits")
        self.n, self.largest = n, largest
        #: binomials[k][v] = C(v, k), rising with v, for decoding by binary search.
        self.binomials = [[math.comb(v, k) for v in range(n + 1)] for k in range(largest + 1)]
        self.table = np.array(self.binomials, np.int64)

    def count(self, k: int) -> int:
        return math.comb(self.n, k)

    def decode(self, index: int, k: int) -> tuple[int, ...]:
        """The combination of k elements, largest first."""
        if not 0 <= index < self.count(k):
            raise IndexError(f"index {index} is outside 0..{self.count(k) - 1}")
        out = []
        for size in range(k, 0, -1):
            v = bisect_right(self.binomials[size], index) - 1
            out.append(v)
            index -= self.binomials[size][v]
        return tuple(out)

    def decode_all(self, indices: np.ndarray, k: int) -> np.ndarray:
        """[combination, element]; a row for each index, largest element first."""
        rest, out = indices.astype(np.int64), np.empty((len(indices), k), np.int64)
        for at, size in enumerate(range(k, 0, -1)):
            out[:, at] = np.searchsorted(self.table[size], rest, "right") - 1
            rest = rest - self.table[size][out[:, at]]
        return out

    def encode(self, combination: Sequence[int]) -> int:
        """The index of a combination given largest first."""
        return sum(self.binomials[len(combination) - at][v] for at, v in enumerate(combination))

    def encode_all(self, combinations: np.ndarray) -> np.ndarray:
        k = combinations.shape[1]
        return sum((self.table[k - at][combinations[:, at]] for at in range(k)), np.zeros(len(combinations), np.int64))

    def combinations(self, start: int, k: int) -> Iterator[tuple[int, ...]]:
        """All combinations from an index on, in order."""
        return (self.decode(i, k) for i in range(start, self.count(k)))

    def facets(self, combination: Sequence[int]) -> list[tuple[int, int, int]]:
        """(index, position removed, element removed), by rising index."""
        return [(self.encode([*combination[:at], *combination[at + 1 :]]), at, v) for at, v in enumerate(combination)]

    def cofacets(self, combination: Sequence[int]) -> list[tuple[int, int]]:
        """(index, element added), by falling index."""
        own = set(combination)
        return [(self.encode(sorted([*combination, v], reverse=True)), v) for v in range(self.n - 1, -1, -1) if v not in own]


def binomial(v: Column, k: int) -> Column:
    """C(v, k) as a long, exact while k times it fits 64 bits: each factor is divided away before the next."""
    out = F.lit(1).cast("long")
    for d in range(k):
        out = F.call_function("div", out * (v.cast("long") - d), F.lit(d + 1).cast("long"))
    return out


def index_of(vertices: Sequence[Column]) -> Column:
    """The index of a simplex whose vertex columns are given largest first."""
    out = F.lit(0).cast("long")
    for at, v in enumerate(vertices):
        out = out + binomial(v, len(vertices) - at)
    return out
