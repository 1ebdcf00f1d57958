"""Synthetic fleets: devices around hubs and on their own, by integer arithmetic on the row number, so every run agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Hub centers in world units and how far devices stand from them.
HUBS = ((398458880, 609000000), (418458880, 618000000), (438458880, 627000000), (458458880, 636000000))
JITTER = 1_342_177
WORLD = 1 << 30

_HASH = "(((({n} % 1000003) * ({n} % 1000003)) % 1000003 * {a} + {n} * {b}) % {m})"


def hashed(n: str, a: int, b: int, modulus: int) -> str:
    """A number below the modulus that looks random; the same text works in Spark and DuckDB."""
    return _HASH.format(n=n, a=a, b=b, m=modulus)


def fleet_sql(n: str, lone_every: int = 10) -> tuple[str, str, str]:
    """Expressions of x, y and category of device n: one in lone_every stands anywhere, the others near a hub."""
    pick = f"({n} % {len(HUBS)})"
    axis = lambda k: "(CASE " + " ".join(f"WHEN {pick} = {i} THEN {h[k]}" for i, h in enumerate(HUBS)) + " END)"
    out = []
    for k, (a, b) in enumerate(((7919, 104729), (15485863, 1299709))):
        near = f"{axis(k)} + {hashed(n, a, b, 2 * JITTER)} - {JITTER}"
        out.append(f"(CASE WHEN {n} % {lone_every} = 0 THEN {hashed(n, a, b, WORLD)} ELSE {near} END)")
    return out[0], out[1], f"CAST({n} % 3 AS INT)"


def fleet(spark: SparkSession, devices: int, collection: str = "fleet") -> DataFrame:
    """points(collection, num, qx, qy, cat) for the bulk build, made where they are needed."""
    x, y, cat = fleet_sql("id")
    return spark.range(devices).selectExpr(f"'{collection}' AS collection", "id AS num", f"{x} AS qx", f"{y} AS qy", f"{cat} AS cat")
