"""Options of a collection, the fixed-point projection, and everything that follows from the scale of a zoom."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The world is a square of this many units a side.
WORLD = 1 << 30
#: The projection keeps to this share of the square.
EDGE = 0.9999999


class EngineError(Exception):
    """An error with the code that clients match on."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Options:
    """The geometry of a collection, and its limits."""

    min_zoom: int = 0
    max_zoom: int = 16
    radius: float = 40.0
    extent: float = 512.0
    hysteresis: float = 0.25
    categories: tuple[str, ...] = field(default=())
    max_props_bytes: int = 1024
    ttl_seconds: int = 300

    def __post_init__(self) -> None:
        if not 0 <= self.min_zoom <= self.max_zoom <= 20:
            raise EngineError("bad_request", "zooms must be within 0 and 20")
        if not (self.radius > 0 and self.extent > 0 and math.isfinite(self.radius) and math.isfinite(self.extent)):
            raise EngineError("bad_request", "radius and extent must be positive")
        if not self.hysteresis >= 0:
            raise EngineError("bad_request", "hysteresis must not be negative")

    def scale(self, zoom: int) -> float:
        """The separation of centers at a zoom, in world units."""
        return WORLD * self.radius / (self.extent * 2.0**zoom)

    def slack(self, zoom: int) -> float:
        """How far a child may drift from its parent."""
        return (1 + self.hysteresis) * self.scale(zoom)

    def level(self, zoom: float) -> int:
        """The level that answers a zoom: rounded down, within the collection's range."""
        if not math.isfinite(zoom):
            raise EngineError("bad_request", "zoom must be a finite number")
        return max(self.min_zoom, min(self.max_zoom, math.floor(zoom)))

    def same_geometry(self, other: Options) -> bool:
        return (self.min_zoom, self.max_zoom, self.radius, self.extent, self.hysteresis, self.categories) == (other.min_zoom, other.max_zoom, other.radius, other.extent, other.hysteresis, other.categories)


def _to_world(share: Column) -> Column:
    inside = F.when(share < 0, F.lit(0.0)).when(share >= 1, F.lit(EDGE)).otherwise(share)
    return F.round(inside * WORLD).cast("bigint")


def project_x(lng: Column) -> Column:
    """Longitude to fixed-point x."""
    return _to_world((lng + 180.0) / 360.0)


def project_y(lat: Column) -> Column:
    """Latitude to fixed-point y (Web Mercator)."""
    s = F.sin(F.radians(lat))
    inside = F.lit(0.5) - F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) * 0.25 / math.pi
    return _to_world(F.when(s >= 1, F.lit(-1.0)).when(s <= -1, F.lit(2.0)).otherwise(inside))


def unproject_x(x: Column) -> Column:
    return x / float(WORLD) * 360.0 - 180.0


def unproject_y(y: Column) -> Column:
    turn = (F.lit(0.5) - y / float(WORLD)) * (2 * math.pi)
    return F.atan(F.exp(turn)) * (360.0 / math.pi) - 90.0


def project_point(lng: float, lat: float) -> tuple[int, int]:
    """One point, at the driver: for the corners of a box."""
    s = math.sin(math.radians(lat))
    share_y = 0.5 - math.log((1 + s) / (1 - s)) * 0.25 / math.pi if abs(s) < 1 else (-1.0 if s > 0 else 2.0)

    def place(v: float) -> int:
        v = 0.0 if v < 0 else EDGE if v >= 1 else v
        return math.floor(v * WORLD + 0.5)

    return place((lng + 180) / 360), place(share_y)


def level_column(zoom: Column, opts: Options) -> Column:
    return F.greatest(F.least(F.floor(zoom).cast("int"), F.lit(opts.max_zoom)), F.lit(opts.min_zoom))


def tile_unit(v: Column, tile: Column, zoom: int, extent: float) -> Column:
    """World coordinate to the units of a tile."""
    return F.round((v / float(WORLD) * float(1 << zoom) - tile) * extent).cast("bigint")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def parse_zoom(text: str | None) -> float:
    """A zoom from a request: 0 if there is none."""
    if text is None or not text.strip():
        return 0.0
    try:
        zoom = float(text)
    except ValueError:
        raise EngineError("bad_request", f"zoom must be a number, not {text}") from None
    if not math.isfinite(zoom):
        raise EngineError("bad_request", "zoom must be a finite number")
    return zoom


def parse_box(text: str | None) -> tuple[float, float, float, float]:
    """west,south,east,north; the whole world if absent."""
    if text is None:
        return -180.0, -85.0511, 180.0, 85.0511
    try:
        box = tuple(float(p) for p in text.split(","))
    except ValueError:
        box = ()
    if len(box) != 4 or not all(map(math.isfinite, box)):
        raise EngineError("bad_request", "bbox must be four finite numbers: west,south,east,north")
    return box  # type: ignore[return-value]


def world_box(box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """The box in world units as x0, y0, x1, y1; swapped corners are put in order."""
    (x0, y1), (x1, y0) = project_point(box[0], box[1]), project_point(box[2], box[3])
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
