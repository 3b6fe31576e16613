"""Distances: column builders that stay in Catalyst, each with a numpy form for whole blocks of points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Distance:
    """between(u, v): a Column of two array columns. block(x, y): the matrix of distances of two numpy blocks.

    A Euclidean distance has pairs(x, y) too: the same values, bit for bit, of x's rows and y's rows one by one, and the
    digits it is rounded to. Its blocks are looked through by one matrix product, and what is kept is computed exactly.
    """

    between: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    digits: int | None = None

    def _squares(self, x: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, float] | None:
        """Squared distances by a matrix product, and by how much they may differ from the squares of block(x, y) before
        rounding; None for numbers too large or small for it."""
        p, q = (np.einsum("ij,ij->i", v, v, dtype=np.float64) for v in (x, y))
        top = (np.sqrt(p.max(initial=0)) + np.sqrt(q.max(initial=0))) ** 2
        if not 1e-20 < top < 1e30:
            return None
        left = np.column_stack([x, p, np.ones(len(x))]).astype(kind)
        right = np.column_stack([-2.0 * y, np.ones(len(y)), q]).astype(kind)
        # Twice the rounding errors of the product, of the block's own sums and roots and of the casts.
        return left @ right.T, 2 * (x.shape[1] + 8) * max(np.finfo(kind).eps, np.finfo(x.dtype).eps) * top

    def _unit(self) -> float:
        return 0.0 if self.digits is None else 10.0**-self.digits

    def rough(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """A matrix that orders pairs as block(x, y) does, but for differences of at most the second value: squares of
        Euclidean distances, before rounding; other distances themselves."""
        if self.pairs is None:
            return self.block(x, y), 0.0
        found = self._squares(x, y, "float32")
        if found is None:
            w = self.block(x, y).astype(np.float64)
            top = w[np.isfinite(w)].max(initial=0)
            found = w * w, 1e-6 * top * top + 2 * top * self._unit() + self._unit() ** 2
        return found

    def least(self, rough: np.ndarray, slack: float) -> np.ndarray:
        """What the distances of these rough values are at least."""
        return rough.astype(np.float64) if self.pairs is None else np.sqrt(np.maximum(rough.astype(np.float64) - slack, 0)) * (1 - 1e-12) - self._unit()

    def most(self, distance: np.ndarray) -> np.ndarray:
        """What the rough values of these distances are at most, but for the slack."""
        return distance if self.pairs is None else (np.asarray(distance, np.float64) + self._unit()) ** 2

    def within(self, x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and values of what block(x, y) has up to the limit, row by row."""
        by_root = self.digits is not None and x.dtype == np.float64
        found = self._squares(x, y, "float64" if by_root else "float32") if self.pairs and (by_root or limit < np.inf) else None
        if found is not None:
            s, slack = found
            r, c = np.nonzero(s <= self.most(limit) + slack) if limit < np.inf else (i.ravel() for i in np.indices(s.shape, np.int32))
            if by_root:
                root = np.sqrt(np.maximum(s[r, c] if limit < np.inf else s.ravel(), 0))
                w = np.round(root, self.digits)
                # A root this near the middle between two rounded values, or this small, may round otherwise than the block's.
                least = 1e4 * np.sqrt(slack)
                scaled = root * 10.0**self.digits
                doubt = np.flatnonzero((np.abs(scaled - np.rint(scaled)) >= 0.5 - 10.0**self.digits * slack / least - 1e-15 * scaled) | (root < least))
            else:
                w, doubt = np.empty(len(r), x.dtype), np.arange(len(r))
            if 8 * len(doubt) <= s.size:
                for k in range(0, len(doubt), GATHERED):
                    own = doubt[k : k + GATHERED]
                    w[own] = self.pairs(x[r[own]], y[c[own]])
                keep = w <= limit
                return (r, c, w) if keep.all() else (r[keep], c[keep], w[keep])
        w = self.block(x, y)
        r, c = np.nonzero(w <= limit)
        return r, c, w[r, c]


def _fold(term: Callable[[Column, Column], Column], zero: str) -> Callable[[Column, Column], Column]:
    return lambda u, v: F.aggregate(F.zip_with(u, v, term), F.lit(0).cast(zero), lambda a, x: (a + x).cast(zero))


def _block(term: Callable[[np.ndarray], np.ndarray], end: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Coordinate by coordinate, in the blocks' own precision."""

    def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(y)), x.dtype)
        for k in range(x.shape[1] if len(x) else 0):
            out += term(x[:, k, None] - y[None, :, k])
        return end(out)

    return block


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, summed as in a block."""
    d = np.ascontiguousarray((x - y).T)
    d *= d
    out = np.zeros(len(x), x.dtype)
    for row in d:
        out += row
    return np.sqrt(out.astype(np.float64)).astype(x.dtype)


#: Pairs that are gathered at once.
GATHERED = 2048


def euclidean(precision: str = "float32") -> Distance:
    """float32: squares are summed in float32, the root is taken in double and cast back. float64: double throughout."""
    kind = {"float32": "float", "float64": "double"}[precision]
    squares = _fold(lambda x, y: ((x.cast(kind) - y.cast(kind)) * (x.cast(kind) - y.cast(kind))).cast(kind), kind)
    return Distance(lambda u, v: F.sqrt(squares(u, v)).cast(kind), _block(lambda d: d * d, lambda s: np.sqrt(s.astype(np.float64)).astype(s.dtype)), _pairs)


def manhattan() -> Distance:
    return Distance(_fold(lambda x, y: F.abs(x.cast("double") - y.cast("double")), "double"), _block(np.abs, lambda s: s))


def rounded(distance: Distance, digits: int) -> Distance:
    """The distance rounded, so that ties are the same wherever it is computed."""
    pairs = distance.pairs if distance.digits is None else None
    return Distance(lambda u, v: F.round(distance.between(u, v), digits), lambda x, y: np.round(distance.block(x, y), digits), (lambda x, y: np.round(pairs(x, y), digits)) if pairs else None, digits if pairs else None)


def from_pandas_udf(udf, block: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Distance:
    """A user's vectorised function of two array columns, with its block form."""
    return Distance(lambda u, v: udf(u, v), block)
