"""Position reports from JSON: both request shapes, strict fields, validation, and all-or-nothing batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.geometry import EngineError, Options, finite, project_x, project_y

FIELDS = ("id", "lng", "lat", "cat", "props")
_RAW = "array<struct<id:string,lng:double,lat:double,cat:string,props:string>>"


#: Bytes that a request body may have, unless said otherwise.
MAX_BODY = 8 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value): one request body, or one NDJSON report, a line of text."""
    return spark.read.text(path).withColumn("batch", F.monotonically_increasing_id())


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value) of a file in either form: lines if the first one that is not blank is JSON on its own, else one body over
    all lines. Blank lines are left out."""
    lines = read_lines(spark, path).where(F.length(F.trim("value")) > 0)
    head = lines.limit(1).select((F.try_parse_json("value").isNotNull()).alias("whole")).head(1)
    if not head or head[0]["whole"]:
        return lines
    return spark.read.text(path, wholetext=True).withColumn("batch", F.monotonically_increasing_id())


def within_limit(bodies: DataFrame, max_bytes: int = MAX_BODY) -> DataFrame:
    """bodies with ``problem`` for those that are too large; they are to be refused before they are parsed."""
    return bodies.withColumn("problem", F.when(F.octet_length("value") > max_bytes, f"a body must not exceed {max_bytes} bytes"))


def parse(bodies: DataFrame) -> DataFrame:
    """bodies(batch, value) to reports(batch, at, id, lng, lat, cat, props, unknown).

    A body is an array of reports, an object with ``points``, or a single report (NDJSON). Properties keep their text;
    a JSON null counts as absent. unknown tells whether the report has a field that is not one of FIELDS."""
    texts = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).when(
        F.array_contains(F.json_object_keys("value"), "points"), F.from_json(F.get_json_object("value", "$.points"), "array<string>")
    ).otherwise(F.array("value"))
    one = bodies.select("batch", F.posexplode(texts).alias("at", "text"))
    parsed = F.from_json("text", "struct<id:string,lng:double,lat:double,cat:string,props:string>").alias("r")
    unknown = F.size(F.array_except(F.json_object_keys("text"), F.array(*map(F.lit, FIELDS)))) > 0
    return one.select("batch", "at", parsed, F.coalesce(unknown, F.lit(True)).alias("unknown")).select("batch", "at", "r.*", "unknown")


def category_number(cat: Column, labels: tuple[str, ...]) -> Column:
    """A category by label first, then by number; absent or empty is 0; null if there is no such category."""
    at = F.array_position(F.array(*map(F.lit, labels)), cat) if labels else F.lit(0)
    number = F.expr("1") * cat.try_cast("int")
    inside = number.isNotNull() & (number >= 0) & ((number < len(labels)) if labels else F.lit(True))
    return F.when(cat.isNull() | (cat == ""), F.lit(0)).when(at > 0, (at - 1).cast("int")).when(inside, number if labels else F.lit(0))


def problems(reports: DataFrame, opts: Options) -> DataFrame:
    """reports with ``problem``: why a report is refused, or null."""
    props, cap = F.col("props"), opts.max_props_bytes
    is_object = F.ltrim(props).startswith("{") & F.json_object_keys(props).isNotNull()
    problem = (
        F.when(F.col("unknown"), "unknown field")
        .when(F.col("id").isNull(), "id is missing")
        .when(~(finite(F.col("lng")) & finite(F.col("lat"))), "lng and lat must be finite")
        .when(category_number(F.col("cat"), opts.categories).isNull(), "no such category; there are: " + ", ".join(opts.categories))
        .when(props.isNotNull() & ~is_object, "props must be an object")
        .when(props.isNotNull() & (F.octet_length(props) > cap), f"props must not exceed {cap} bytes")
    )
    return reports.withColumn("problem", problem)


def accepted(reports: DataFrame, opts: Options) -> DataFrame:
    """The reports of batches in which every report is sound, projected; a bad report refuses its whole batch."""
    checked = problems(reports, opts)
    bad = checked.where(F.col("problem").isNotNull()).select("batch").distinct()
    ok = checked.join(bad, "batch", "left_anti").drop("problem", "unknown")
    return ok.withColumn("cat", category_number(F.col("cat"), opts.categories)).withColumn("qx", project_x(F.col("lng"))).withColumn("qy", project_y(F.col("lat")))


def category_of(selector: str | None, opts: Options) -> int | None:
    """A reader's category: None for no filter, a label, or a number in range."""
    if not selector:
        return None
    if selector in opts.categories:
        return opts.categories.index(selector)
    if selector.isascii() and selector.isdigit() and int(selector) < len(opts.categories):
        return int(selector)
    raise EngineError("bad_request", f"no category {selector}; there are: {', '.join(opts.categories)}")
