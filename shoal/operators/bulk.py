"""The bulk build of one bounded collection with numpy: the same levels and parents as inserting its points one by one.

From the finest zoom to the coarsest the first independent set of what is left is found in rounds. Points lie in cells so small
that two in one cell always conflict; in a round the earliest undecided point of each cell looks at the 25 cells around it and
joins if no earlier undecided point is within the scale; then everything that it covers drops out. Work per round is linear in
the undecided points, however many share a place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from shoal.functions.geometry import Options

_REACH = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
_STRIDE = np.int64(1) << 32


class _Cells:
    """Points by cell: the cells' keys, sorted, and the points of each, in their order of arrival."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float):
        side = radius / math.sqrt(2) * 0.999999
        self.cx, self.cy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
        self.key = self.cx * _STRIDE + self.cy

    def group(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points sorted by cell, distinct keys, first place of each and the end)."""
        order = of[np.argsort(self.key[of], kind="stable")]
        k = self.key[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        return order, k[first], np.append(first, len(k))

    def near(self, who: np.ndarray, order: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (one of who, a grouped point of a cell around it), cell offset by cell offset."""
        for dx, dy in _REACH:
            want = self.key[who] + dx * _STRIDE + dy
            at = np.searchsorted(keys, want)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == want)
            a, b = bounds[at[hit]], bounds[at[hit] + 1]
            n = b - a
            left = np.repeat(who[hit], n)
            yield left, order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(left))]


def first_independent_set(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """A mask of the points that are more than the radius from every earlier point that is in the set."""
    cells, r2 = _Cells(x, y, radius), radius * radius
    chosen = np.zeros(len(x), bool)
    open_ = np.arange(len(x))
    while len(open_):
        order, keys, bounds = cells.group(open_)
        ahead = order[bounds[:-1]]
        waits = np.zeros(len(x), bool)
        for p, q in cells.near(ahead, order, keys, bounds):
            earlier = q < p
            p, q = p[earlier], q[earlier]
            d2 = (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2
            waits[p[d2.astype(np.float64) <= r2]] = True
        joins = ahead[~waits[ahead]]
        chosen[joins] = True
        gone = np.zeros(len(x), bool)
        for p, q in cells.near(joins, order, keys, bounds):
            d2 = (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2
            gone[q[d2.astype(np.float64) <= r2]] = True
        open_ = open_[~gone[open_]]
    return chosen


def _parents(x: np.ndarray, y: np.ndarray, text_rank: np.ndarray, children: np.ndarray, centers: np.ndarray, radius: float) -> np.ndarray:
    """The nearest earlier center of each child; ties by the id as text."""
    cells, r2 = _Cells(x, y, radius), radius * radius
    order, keys, bounds = cells.group(centers)
    far = np.iinfo(np.int64).max
    best, parent = np.full(len(x), far), np.full(len(x), -1)
    for p, q in cells.near(children, order, keys, bounds):  # a cell holds one center at most
        d2 = (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2
        ok = (q < p) & (d2.astype(np.float64) <= r2)
        p, q, d2 = p[ok], q[ok], d2[ok]
        better = (d2 < best[p]) | ((d2 == best[p]) & (text_rank[q] < text_rank[parent[p]]))
        p, q, d2 = p[better], q[better], d2[better]
        best[p], parent[p] = d2, q
    return parent[children]


def build(num: np.ndarray, x: np.ndarray, y: np.ndarray, opts: Options) -> tuple[np.ndarray, np.ndarray]:
    """(level, parent's index or -1) of points given in ascending num."""
    n = len(num)
    level, parent = np.zeros(n, np.int64), np.full(n, -1)
    text_rank = np.empty(n, np.int64)
    text_rank[np.argsort(num.astype(str), kind="stable")] = np.arange(n)
    left = np.arange(n)
    for z in range(opts.max_zoom, -1, -1):
        if not len(left):
            break
        radius = opts.scale(z)
        chosen = first_independent_set(x[left], y[left], radius)
        rest, centers = left[~chosen], left[chosen]
        if len(rest):
            level[rest] = z + 1
            local = np.searchsorted(left, rest), np.searchsorted(left, centers)
            parent[rest] = left[_parents(x[left], y[left], text_rank[left], *local, radius)]
        left = centers
    return level, parent
