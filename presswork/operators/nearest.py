"""The nearest of many stated points by cosine, with exact pruning by pivots."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Similarities are told apart to so many decimals; of those equal to that, the point with the lower id is nearer.
DECIMALS = 6
#: By what a bound must fall short of the best similarity before points are passed over: rounding and the arc cosine's error are both less.
SLACK = 1e-5


def unit(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of length 1; NaN for vectors that are NULL, of another size, of length 0, or have NULL or non-finite components."""
    out = np.full((len(vectors), size), np.nan)
    vectors = vectors.cast(pa.list_(pa.float64()))
    right = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    if size and len(right):
        out[right] = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(all="ignore"):
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(np.isfinite(length) & (length > 0), out / length, np.nan)


class Group(NamedTuple):
    """Points whose nearest pivot is the same, and the largest angle between it and one of them."""

    members: np.ndarray
    radius: float


class Points:
    """Unit vectors in groups round pivots, each the point farthest from the pivots before it.

    A vector at angle a from a pivot is at least a - radius from every point of its
    group (angles obey the triangle inequality), so that a group whose least angle is
    beyond the best one found holds no nearer point and is passed over.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: int | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        order = order[~np.isnan(vectors[order]).any(axis=1)]
        self.ids, self.vectors = ids[order], vectors[order]
        wanted = min(len(order), pivots or int(np.ceil(np.sqrt(len(order)))))
        nearest, group, chosen = np.full(len(order), -2.0), np.zeros(len(order), dtype=np.int64), []
        while len(chosen) < wanted:
            p = int(np.argmin(nearest)) if chosen else 0
            if chosen and nearest[p] > 1 - SLACK:  # all others stand on a pivot
                break
            similar = self.vectors @ self.vectors[p]
            nearer = similar > nearest
            group[nearer], nearest[nearer] = len(chosen), similar[nearer]
            chosen.append(p)
        self.pivots = self.vectors[chosen]
        angle = np.arccos(np.clip(nearest, -1, 1))
        at = [np.flatnonzero(group == g) for g in range(len(chosen))]
        self.groups = [Group(a, float(angle[a].max(initial=0.0))) for a in at]

    def nearest(self, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Write the best similarity and point id of each row into ``best`` and ``which``, unless those there are as near; returns how many points each row was compared with."""
        if not len(self.ids):
            return np.zeros(len(rows), dtype=np.int64)
        compared = np.full(len(rows), len(self.pivots), dtype=np.int64)
        angle = np.arccos(np.clip(rows @ self.pivots.T, -1, 1))
        radius = np.array([g.radius for g in self.groups])
        most = np.cos(np.maximum(angle - radius, 0))
        first = np.argmin(np.where(np.isnan(angle), np.inf, angle), axis=1)

        def compare(at: np.ndarray, g: int) -> None:
            members = self.groups[g].members
            similar = np.floor(rows[at] @ self.vectors[members].T * 10**DECIMALS + 0.5) / 10**DECIMALS
            j = np.argmax(similar, axis=1)  # members are in the order of ids: the first of equals
            s, i = similar[np.arange(len(at)), j], self.ids[members[j]]
            better = (s > best[at]) | (s == best[at]) & (i < which[at])
            best[at[better]], which[at[better]] = s[better], i[better]
            compared[at] += len(members)

        known = ~np.isnan(rows).any(axis=1)
        for g in range(len(self.groups)):
            if len(at := np.flatnonzero(known & (first == g))):
                compare(at, g)
        for g in range(len(self.groups)):
            if len(at := np.flatnonzero(known & (first != g) & (most[:, g] >= best - SLACK))):
                compare(at, g)
        return np.where(known, compared, 0)


def search(batches: Iterator[pa.RecordBatch], points: Points, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, vector, similarity, point, compared) with what these points add."""
    for b in batches:
        similarity, point, compared = (b.column(i) for i in (2, 3, 4))
        best = similarity.fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
        which = point.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).copy()
        more = points.nearest(unit(b.column(1), size), best, which)
        none = np.isneginf(best)
        out = [b.column(0), b.column(1), pa.array(best, mask=none), pa.array(which, mask=none), pa.array(compared.to_numpy(zero_copy_only=False) + more)]
        yield pa.RecordBatch.from_arrays(out, names=b.schema.names)
