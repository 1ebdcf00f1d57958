"""The order-dependent replay of one collection: plain Python, without Spark.

A point's level is the coarsest zoom at which it is a center (max_zoom + 1 if at none). Centers of a zoom are more than its
scale apart, and every other point hangs from the nearest center of the zoom above its level. ``Net`` keeps this under
upserts and removals; sums are not kept, since reads aggregate assignments anyway.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from shoal.functions.geometry import Options


@dataclass
class Point:
    x: int
    y: int
    cat: int
    level: int = 0
    parent: int | None = None
    children: set[int] = field(default_factory=set)


class Net:
    def __init__(self, opts: Options):
        self.opts = opts
        self.points: dict[int, Point] = {}
        self.scales = [opts.scale(z) for z in range(opts.max_zoom + 1)]
        self.cells: list[dict[tuple[int, int], set[int]]] = [defaultdict(set) for _ in self.scales]
        self.counts = dict.fromkeys(("inserts", "removes", "moves", "moves_fast", "moves_rebuilt", "promotions", "reparents", "probes"), 0)

    def _cell(self, zoom: int, x: int, y: int) -> tuple[int, int]:
        side = 2 * self.scales[zoom]
        return math.floor(x / side), math.floor(y / side)

    def _enter(self, num: int) -> None:
        p = self.points[num]
        for z in range(p.level, len(self.scales)):
            self.cells[z][self._cell(z, p.x, p.y)].add(num)

    def _leave(self, num: int) -> None:
        p = self.points[num]
        for z in range(p.level, len(self.scales)):
            cell = self._cell(z, p.x, p.y)
            self.cells[z][cell].discard(num)
            if not self.cells[z][cell]:
                del self.cells[z][cell]

    def covering(self, zoom: int, x: int, y: int, but: int) -> list[tuple[int, str, int]]:
        """(squared distance, id as text, id) of the centers of a zoom that cover the place."""
        r = self.scales[zoom]
        x0, y0 = self._cell(zoom, x - r, y - r)
        x1, y1 = self._cell(zoom, x + r, y + r)
        grid, out = self.cells[zoom], []
        for cx in range(x0, x1 + 1):
            for cy in range(y0, y1 + 1):
                for num in grid.get((cx, cy), ()):
                    self.counts["probes"] += 1
                    p = self.points[num]
                    d2 = (p.x - x) ** 2 + (p.y - y) ** 2
                    if num != but and d2 <= r * r:
                        out.append((d2, str(num), num))
        return out

    def _hang(self, num: int, finest: int) -> None:
        """Place a detached point: below the nearest center of the finest zoom that covers it, or as a root."""
        p = self.points[num]
        p.level, p.parent = 0, None
        for z in range(min(finest, self.opts.max_zoom), -1, -1):
            found = self.covering(z, p.x, p.y, num)
            if found:
                p.level, p.parent = z + 1, min(found)[2]
                self.points[p.parent].children.add(num)
                break
        self._enter(num)

    def _detach(self, num: int) -> None:
        """Take a point out; its children find new places, those of coarse levels first."""
        p = self.points[num]
        self._leave(num)
        for child in sorted(p.children, key=lambda c: (self.points[c].level, str(c))):
            c = self.points[child]
            was = c.level
            self._leave(child)
            self._hang(child, was - 1)
            self.counts["promotions"] += c.level < was
            self.counts["reparents"] += 1
        p.children = set()
        if p.parent is not None:
            self.points[p.parent].children.discard(num)
            p.parent = None

    def upsert(self, num: int, x: int, y: int, cat: int = 0) -> None:
        """Insert a point, or move it; a move keeps its category."""
        p = self.points.get(num)
        if p is None:
            self.points[num] = Point(x, y, cat)
            self._hang(num, self.opts.max_zoom)
            self.counts["inserts"] += 1
            return
        if (p.x, p.y) == (x, y):
            return
        self.counts["moves"] += 1
        if self._may_stay(num, p, x, y):
            self._leave(num)
            p.x, p.y = x, y
            self._enter(num)
            self.counts["moves_fast"] += 1
        else:
            self._detach(num)
            p.x, p.y = x, y
            self._hang(num, self.opts.max_zoom)
            self.counts["moves_rebuilt"] += 1

    def _may_stay(self, num: int, p: Point, x: int, y: int) -> bool:
        """Whether the place keeps separation, and parent and children within their slack."""
        if any(self.covering(z, x, y, num) for z in range(self.opts.max_zoom, p.level - 1, -1)):
            return False
        links = [(p.parent, p.level)] if p.parent is not None else []
        links += [(c, self.points[c].level) for c in p.children]
        for other, level in links:
            q = self.points[other]
            if (q.x - x) ** 2 + (q.y - y) ** 2 > self.opts.slack(level - 1) ** 2:
                return False
        return True

    def remove(self, num: int) -> bool:
        if num not in self.points:
            return False
        self._detach(num)
        del self.points[num]
        self.counts["removes"] += 1
        return True

    def restore(self, rows: list[tuple[int, int, int, int, int, int | None]]) -> None:
        """Take up the rows of an earlier net as they were."""
        for num, x, y, cat, level, parent in rows:
            self.points[num] = Point(x, y, cat, level, parent)
        for num, p in self.points.items():
            if p.parent is not None:
                self.points[p.parent].children.add(num)
            self._enter(num)

    def rows(self) -> list[tuple[int, int, int, int, int, int | None]]:
        """(num, qx, qy, cat, tz, parent), by num."""
        return [(n, p.x, p.y, p.cat, p.level, p.parent) for n, p in sorted(self.points.items())]
