"""The engine's registered queries over the test tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions import features as feat
from shoal.functions import geometry as geo
from shoal.functions.geometry import Options
from shoal.operators import net, replay, search, state
from shoal.plans import catalog, reads, tiles, verify
from shoal.sources import reports as ingest
from shoal.sources import fleet, snapshot, views
from shoal.sources.tables import built, materialise, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

OPTS = Options(categories=("click", "error", "purchase", "signup", "view"), ttl_seconds=86_400)
LAST = OPTS.max_zoom
R0 = OPTS.scale(0)
BOX = (-47.0, -26.0, -40.0, -19.0)
DAY = "86400000000"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# --- the stored hierarchy of sites: built by the first query of an application that reads it


def nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, ("nodes", sf), f"{sf}/customer.parquet", lambda: net.build_nodes(views.sites(spark, sf), OPTS))


def segments_of(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, ("segments", sf), f"{sf}/customer.parquet", lambda: net.segments(nodes_of(spark, sf), OPTS))


SITES = f"sites AS ({views.SITES_DUCK})"
REPORTS = f"reports AS ({views.REPORTS_DUCK})"
#: The sequential build, a point at a time, over the list of points placed so far.
NODES = f"""WITH RECURSIVE {SITES},
ordered AS (SELECT row_number() OVER (ORDER BY num) AS rn, num, qx, qy, cat FROM sites),
build AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(num BIGINT, qx BIGINT, qy BIGINT, cat INTEGER, tz INTEGER, parent BIGINT)[]) AS placed
  UNION ALL
  SELECT i + 1, list_append(placed, {{'num': num, 'qx': qx, 'qy': qy, 'cat': cat, 'tz': CAST(coalesce(1 - best.z, 0) AS INTEGER), 'parent': best.n}})
  FROM (
    SELECT b.i, b.placed, o.num, o.qx, o.qy, o.cat,
           list_min([{{'z': -list_max([z for z in range(m.tz, {LAST + 1}) if CAST((m.qx - o.qx) * (m.qx - o.qx) + (m.qy - o.qy) * (m.qy - o.qy) AS DOUBLE) <= pow({R0} / pow(2, z), 2)]),
                       'd': (m.qx - o.qx) * (m.qx - o.qx) + (m.qy - o.qy) * (m.qy - o.qy), 't': CAST(m.num AS VARCHAR), 'n': m.num}}
                     for m in b.placed if m.tz <= {LAST} AND CAST((m.qx - o.qx) * (m.qx - o.qx) + (m.qy - o.qy) * (m.qy - o.qy) AS DOUBLE) <= pow({R0} / pow(2, m.tz), 2)]) AS best
    FROM build b JOIN ordered o ON o.rn = b.i + 1)),
nodes AS MATERIALIZED (
  SELECT 'sites' AS collection, n.num, n.qx, n.qy, n.cat, n.tz, n.parent
  FROM (SELECT unnest(placed) AS n FROM (SELECT placed FROM build ORDER BY i DESC LIMIT 1))),
chain AS (
  SELECT num, qx, qy, cat, num AS rep, tz AS low, {LAST} AS high FROM nodes
  UNION ALL
  SELECT c.num, c.qx, c.qy, c.cat, p.num, p.tz, c.low - 1 FROM chain c JOIN nodes n ON n.num = c.rep JOIN nodes p ON p.num = n.parent),
assignment AS (SELECT num, qx, qy, cat, rep, CAST(unnest(range(low, high + 1)) AS INTEGER) AS zoom FROM chain WHERE low <= high)
"""


def nodes_sql(body: str) -> str:
    return NODES + body


# --- projection and formats

_POINTS = """SELECT c_custkey AS num, CAST((c_custkey * 7919) % 360000 AS DOUBLE) / 1000e0 - 180e0 AS lng, CAST((c_custkey * 104729) % 170000 AS DOUBLE) / 1000e0 - 85e0 AS lat FROM customer"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_POINTS.replace("FROM customer", "FROM {t}"), t=spark.read.parquet(f"{sf}/customer.parquet"))


def _clamp_sql(v: str) -> str:
    return f"CAST(round((CASE WHEN {v} < 0 THEN 0e0 WHEN {v} >= 1 THEN 0.9999999e0 ELSE {v} END) * 1073741824) AS BIGINT)"


@query("project_points", f"SELECT num, {_clamp_sql('((lng + 180) / 360)')} AS qx, {_clamp_sql('(0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) * 0.25e0 / pi())')} AS qy FROM ({_POINTS})")
def project_points(spark, sf):
    return _points(spark, sf).select("num", geo.project_x(F.col("lng")).alias("qx"), geo.project_y(F.col("lat")).alias("qy"))


@query("unproject_points", f"WITH {SITES} SELECT num, round(qx / 1073741824e0 * 360 - 180, 6) AS lng, round(atan(exp((0.5e0 - qy / 1073741824e0) * 2 * pi())) * 360 / pi() - 90, 6) AS lat FROM sites")
def unproject_points(spark, sf):
    s = views.sites(spark, sf)
    return s.select("num", F.round(geo.unproject_x(F.col("qx")), 6).alias("lng"), F.round(geo.unproject_y(F.col("qy")), 6).alias("lat"))


@query("zoom_level_clamp", "SELECT l_orderkey, l_linenumber, CAST(greatest(least(floor(l_quantity / 2 - 1), 16), 0) AS INTEGER) AS level FROM lineitem")
def zoom_level_clamp(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", geo.level_column(F.col("l_quantity") / 2 - 1, OPTS).alias("level"))


@query("tile_coords", f"WITH {SITES} SELECT num, CAST(floor(qx / 1073741824e0 * 256) AS BIGINT) AS tx, CAST(floor(qy / 1073741824e0 * 256) AS BIGINT) AS ty, CAST(round((qx / 1073741824e0 * 256 - floor(qx / 1073741824e0 * 256)) * 512) AS BIGINT) AS x, CAST(round((qy / 1073741824e0 * 256 - floor(qy / 1073741824e0 * 256)) * 512) AS BIGINT) AS y FROM sites")
def tile_coords(spark, sf):
    s = views.sites(spark, sf)
    t = lambda c: F.floor(F.col(c) / float(geo.WORLD) * 256.0)
    s = s.withColumn("tx", t("qx")).withColumn("ty", t("qy"))
    return s.select("num", "tx", "ty", geo.tile_unit(F.col("qx"), F.col("tx"), 8, 512.0).alias("x"), geo.tile_unit(F.col("qy"), F.col("ty"), 8, 512.0).alias("y"))


@query("count_abbreviation", "SELECT o_orderkey, n, CASE WHEN n >= 10000 THEN CAST(CAST(round(n / 1000e0) AS BIGINT) AS VARCHAR) || 'k' WHEN n >= 1000 THEN CAST(CAST(round(n / 100e0) AS BIGINT) // 10 AS VARCHAR) || CASE WHEN CAST(round(n / 100e0) AS BIGINT) % 10 = 0 THEN '' ELSE '.' || CAST(CAST(round(n / 100e0) AS BIGINT) % 10 AS VARCHAR) END || 'k' ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT o_orderkey, (o_orderkey * 37) % 123457 AS n FROM orders)")
def count_abbreviation(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") * 37) % 123457).alias("n"))
    return o.withColumn("label", feat.count_abbreviation(F.col("n")))


@query("mvt_scalar_tags", "SELECT event_id, 'k' AS key, CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'uint' ELSE 'string' END AS kind, v AS value FROM (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events) WHERE v IS NOT NULL")
def mvt_scalar_tags(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    return feat.scalar_tags(e).select("event_id", "key", "kind", "value")


@query("synthetic_fleet", f"SELECT o_orderkey AS num, {fleet.fleet_sql('o_orderkey')[0]} AS qx, {fleet.fleet_sql('o_orderkey')[1]} AS qy, {fleet.fleet_sql('o_orderkey')[2]} AS cat FROM orders")
def synthetic_fleet(spark, sf):
    x, y, cat = fleet.fleet_sql("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS num", f"{x} AS qx", f"{y} AS qy", f"{cat} AS cat")


# --- reports as JSON

def _bodies(spark: SparkSession, sf: str, extra: str = "''") -> DataFrame:
    """One request body per 50th of the events: arrays and objects with points, half each."""
    one = f"""CONCAT('{{"id":"dev-', user_id, '","lng":', event_id % 360 - 180, ',"lat":', event_id % 170 - 85, ',"cat":"', event_type, '","props":', props, {extra}, '}}')"""
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "event_id % 50 AS batch", f"{one} AS j")
    joined = e.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "j"))), lambda x: x["j"]), ",").alias("body"))
    return joined.selectExpr("batch", """IF(batch % 2 = 0, CONCAT('[', body, ']'), CONCAT('{"points":[', body, ']}')) AS value""")


_PARSED = "'dev-' || CAST(user_id AS VARCHAR) AS id, CAST(event_id % 360 - 180 AS DOUBLE) AS lng, CAST(event_id % 170 - 85 AS DOUBLE) AS lat, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS cat"


@query("parse_reports", f"SELECT event_id % 50 AS batch, CAST((event_id - (SELECT min(m.event_id) FROM events m WHERE m.event_id % 50 = e.event_id % 50)) // 50 AS INTEGER) AS at, {_PARSED}, replace(props, ' ', '') AS props FROM events e")
def parse_reports(spark, sf):
    ok = ingest.accepted(ingest.parse(_bodies(spark, sf)), OPTS)
    return ok.select("batch", "at", "id", "lng", "lat", "cat", F.regexp_replace("props", " ", "").alias("props"))


@query("reject_unknown_fields", "SELECT event_id % 50 AS batch, count(*) AS reports, CAST(count(*) FILTER (event_id % 30 = 0) AS BIGINT) AS refused FROM events GROUP BY ALL")
def reject_unknown_fields(spark, sf):
    bodies = _bodies(spark, sf, "IF(event_id % 30 = 0, ',\"speed\":1', '')")
    checked = ingest.problems(ingest.parse(bodies), OPTS)
    return checked.groupBy("batch").agg(F.count(F.lit(1)).alias("reports"), F.count(F.when(F.col("problem") == "unknown field", 1)).alias("refused"))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        """SELECT event_id AS seq, event_id div 40 AS batch, CONCAT('dev-', user_id) AS id, IF(event_id % 101 = 0, double('NaN'), double(event_id % 360 - 180)) AS lng,
        IF(event_id % 211 = 0, double('Infinity'), double(event_id % 170 - 85)) AS lat, event_type AS cat, props, false AS unknown FROM {t}""",
        t=spark.read.parquet(f"{sf}/events.parquet"),
    )


@query("reject_nonfinite", "SELECT event_id AS seq FROM events WHERE event_id % 101 = 0 OR event_id % 211 = 0")
def reject_nonfinite(spark, sf):
    return ingest.problems(_typed(spark, sf), OPTS).where(F.col("problem").startswith("lng")).select("seq")


@query("props_size_cap", "SELECT event_id AS seq FROM events WHERE props IS NOT NULL AND octet_length(encode(props)) > 8 AND NOT (event_id % 101 = 0 OR event_id % 211 = 0)")
def props_size_cap(spark, sf):
    opts = Options(categories=OPTS.categories, max_props_bytes=8)
    return ingest.problems(_typed(spark, sf), opts).where(F.col("problem").startswith("props must not")).select("seq")


@query("batch_atomicity", "SELECT event_id AS seq FROM events WHERE event_id // 40 NOT IN (SELECT event_id // 40 FROM events WHERE event_id % 101 = 0 OR event_id % 211 = 0)")
def batch_atomicity(spark, sf):
    return ingest.accepted(_typed(spark, sf), OPTS).select("seq")


@query("category_resolve", "SELECT event_id, CAST(CASE sel WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 WHEN '' THEN 0 ELSE CASE WHEN TRY_CAST(sel AS INTEGER) BETWEEN 0 AND 4 THEN TRY_CAST(sel AS INTEGER) END END AS INTEGER) AS cat FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id % 7 AS VARCHAR) WHEN 2 THEN '' ELSE 'typo' END AS sel FROM events)")
def category_resolve(spark, sf):
    e = spark.sql("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id % 7 AS STRING) WHEN 2 THEN '' ELSE 'typo' END AS sel FROM {t}", t=spark.read.parquet(f"{sf}/events.parquet"))
    return e.select("event_id", ingest.category_number(F.col("sel"), OPTS.categories).alias("cat"))


@query("report_default_category", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END END AS INTEGER) AS cat FROM events")
def report_default_category(spark, sf):
    """Every event as a report: a third without a category, a third with an empty one."""
    given = F.expr("CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", ingest.category_number(given, OPTS.categories).alias("cat"))


@query("body_limit", "SELECT event_id AS batch, CASE WHEN octet_length(encode(props)) > 8 THEN 'a body must not exceed 8 bytes' END AS problem FROM events")
def body_limit(spark, sf):
    bodies = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("batch"), F.col("props").alias("value"))
    return ingest.within_limit(bodies, 8).select("batch", "problem")


# --- devices

_LIVES = f"""WITH {REPORTS}, marked AS (
  SELECT *, CASE WHEN lag(op) OVER w IS NULL OR lag(op) OVER w = 'remove' OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {DAY} THEN 1 ELSE 0 END AS begins
  FROM reports WINDOW w AS (PARTITION BY collection, id ORDER BY seq)),
lived AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY collection, id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS life FROM marked),
lives AS (
  SELECT collection, id, life, arg_max(qx, seq) FILTER (op = 'upsert') AS qx, arg_max(qy, seq) FILTER (op = 'upsert') AS qy, arg_min(cat, seq) FILTER (op = 'upsert') AS cat,
         arg_max(props, seq) FILTER (op = 'upsert' AND props IS NOT NULL) AS props, min(ts) AS first_seen, max(ts) FILTER (op = 'upsert') AS last_seen,
         CAST(count(*) FILTER (op = 'upsert') AS BIGINT) AS reports, arg_max(op, seq) AS ended
  FROM lived GROUP BY ALL),
newest AS (SELECT collection, id, max(life) AS life FROM lives GROUP BY ALL),
live AS (
  SELECT l.* FROM lives l JOIN newest USING (collection, id, life)
  WHERE ended = 'upsert' AND epoch_us(last_seen) >= (SELECT max(epoch_us(ts)) FROM reports) - {DAY}),
interned AS (
  SELECT collection, id, row_number() OVER (PARTITION BY collection ORDER BY first_seq) - 1 AS num
  FROM (SELECT collection, id, min(seq) AS first_seq FROM reports WHERE op = 'upsert' GROUP BY ALL))
"""


def _as_of(spark: SparkSession, sf: str):
    return F.lit(str(views.reports(spark, sf).agg(F.max("ts").cast("string")).first()[0])).cast("timestamp_ntz")


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return state.live_devices(views.reports(spark, sf), OPTS.ttl_seconds, _as_of(spark, sf))


@query("intern_ids", _LIVES + "SELECT * FROM interned")
def intern_ids(spark, sf):
    return state.intern_ids(views.reports(spark, sf))


@query("latest_position", f"WITH {REPORTS} SELECT collection, id, arg_max(qx, seq) AS qx, arg_max(qy, seq) AS qy, max(seq) AS seq FROM reports WHERE op = 'upsert' GROUP BY ALL")
def latest_position(spark, sf):
    r = views.reports(spark, sf).where("op = 'upsert'")
    last = r.groupBy("collection", "id").agg(F.max_by(F.struct("qx", "qy"), "seq").alias("at"), F.max("seq").alias("seq"))
    return last.select("collection", "id", "at.qx", "at.qy", "seq")


@query("coalesce_reports", f"WITH {REPORTS} SELECT collection, id, time_bucket(INTERVAL '12 hours', ts) AS flush, arg_max(qx, seq) AS qx, arg_max(qy, seq) AS qy, arg_max(cat, seq) AS cat, max(seq) AS seq, arg_max(props, seq) FILTER (props IS NOT NULL) AS props, count(*) AS queued, count(*) - 1 AS merged FROM reports WHERE op = 'upsert' GROUP BY ALL")
def coalesce_reports(spark, sf):
    return state.coalesce_reports(views.reports(spark, sf), "12 hours")


@query("report_chunks", f"WITH {REPORTS} SELECT collection, seq, (row_number() OVER (PARTITION BY collection ORDER BY seq) - 1) // 1000 AS chunk FROM reports")
def report_chunks(spark, sf):
    return state.chunked(views.reports(spark, sf), 1000).select("collection", "seq", "chunk")


@query("device_lives", _LIVES + "SELECT collection, id, life, first_seen, last_seen, reports, ended FROM lives")
def device_lives(spark, sf):
    return state.life_states(state.lives(views.reports(spark, sf), OPTS.ttl_seconds)).select("collection", "id", "life", "first_seen", "last_seen", "reports", "ended")


@query("sticky_category", _LIVES + "SELECT collection, id, life, cat FROM lives")
def sticky_category(spark, sf):
    return state.life_states(state.lives(views.reports(spark, sf), OPTS.ttl_seconds)).select("collection", "id", "life", "cat")


@query("last_props", _LIVES + "SELECT collection, id, life, props FROM lives")
def last_props(spark, sf):
    return state.life_states(state.lives(views.reports(spark, sf), OPTS.ttl_seconds)).select("collection", "id", "life", "props")


@query("props_bytes", _LIVES + "SELECT collection, CAST(coalesce(sum(octet_length(encode(props))), 0) AS BIGINT) AS props_bytes FROM live GROUP BY collection")
def props_bytes(spark, sf):
    return _live(spark, sf).groupBy("collection").agg(F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).cast("bigint").alias("props_bytes"))


@query("ttl_expired", f"WITH {REPORTS} SELECT collection, id, max(ts) AS last_seen FROM reports GROUP BY ALL HAVING arg_max(op, seq) = 'upsert' AND max(epoch_us(ts)) < (SELECT max(epoch_us(ts)) FROM reports) - {DAY}")
def ttl_expired(spark, sf):
    return state.expired(views.reports(spark, sf), OPTS.ttl_seconds, _as_of(spark, sf))


@query("live_devices", _LIVES + "SELECT collection, id, life, qx, qy, cat, props, first_seen, last_seen, reports FROM live")
def live_devices(spark, sf):
    return _live(spark, sf)


@query("contains_device", _LIVES + "SELECT i.collection, i.id, live.id IS NOT NULL AS live FROM interned i LEFT JOIN live USING (collection, id)")
def contains_device(spark, sf):
    ids = state.intern_ids(views.reports(spark, sf)).select("collection", "id")
    return reads.contains(_live(spark, sf), ids)


@query("device_info", _LIVES + "SELECT collection, id, num, round(qx / 1073741824e0 * 360 - 180, 6) AS lng, round(atan(exp((0.5e0 - qy / 1073741824e0) * 2 * pi())) * 360 / pi() - 90, 6) AS lat, ['click', 'error', 'purchase', 'signup', 'view'][cat + 1] AS cat, cat AS cat_index, epoch_us(last_seen) // 1000 AS last_seen_ms, props FROM live JOIN interned USING (collection, id)")
def device_info(spark, sf):
    live = _live(spark, sf).join(state.intern_ids(views.reports(spark, sf)), ["collection", "id"])
    label = F.element_at(F.array(*map(F.lit, OPTS.categories)), F.col("cat") + 1)
    return live.select("collection", "id", "num", F.round(geo.unproject_x(F.col("qx")), 6).alias("lng"), F.round(geo.unproject_y(F.col("qy")), 6).alias("lat"), label.alias("cat"), F.col("cat").alias("cat_index"), F.unix_millis(F.col("last_seen").cast("timestamp")).alias("last_seen_ms"), "props")


@query("device_age", _LIVES + "SELECT collection, id, greatest((SELECT max(epoch_us(ts)) // 1000 FROM reports) - epoch_us(last_seen) // 1000, 0) AS age_ms FROM live")
def device_age(spark, sf):
    return _live(spark, sf).select("collection", "id", F.greatest(F.unix_millis(_as_of(spark, sf).cast("timestamp")) - F.unix_millis(F.col("last_seen").cast("timestamp")), F.lit(0)).alias("age_ms"))


@query("remove_then_rereport", _LIVES + "SELECT a.collection, a.id, b.life, b.cat, b.props FROM lives a JOIN lives b ON a.collection = b.collection AND a.id = b.id AND b.life = a.life + 1 WHERE a.ended = 'remove'")
def remove_then_rereport(spark, sf):
    all_lives = state.life_states(state.lives(views.reports(spark, sf), OPTS.ttl_seconds))
    ended = all_lives.where("ended = 'remove'").select("collection", "id", (F.col("life") + 1).alias("life"))
    return all_lives.join(ended, ["collection", "id", "life"], "left_semi").select("collection", "id", "life", "cat", "props")


# --- searches

_R8 = OPTS.scale(8)
_D2 = "((a.qx - b.qx) * (a.qx - b.qx) + (a.qy - b.qy) * (a.qy - b.qy))"
_PAIRS = f"WITH {SITES}, pairs AS (SELECT a.num AS probe, b.num AS other, {_D2} AS d2 FROM sites a JOIN sites b ON a.num <> b.num AND CAST({_D2} AS DOUBLE) <= {_R8 * _R8}) "


@query("grid_cells", f"WITH {SITES} SELECT num, CAST(floor(qx / {2 * _R8}) AS BIGINT) AS cx, CAST(floor(qy / {2 * _R8}) AS BIGINT) AS cy FROM sites")
def grid_cells(spark, sf):
    return search.with_cell(views.sites(spark, sf), 2 * _R8).select("num", "cx", "cy")


@query("cell_occupancy", f"WITH {SITES} SELECT CAST(floor(qx / {2 * _R8}) AS BIGINT) AS cx, CAST(floor(qy / {2 * _R8}) AS BIGINT) AS cy, count(*) AS n FROM sites GROUP BY ALL")
def cell_occupancy(spark, sf):
    return search.with_cell(views.sites(spark, sf), 2 * _R8).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query("radius_scan_pairs", f"WITH {SITES}, p AS (SELECT a.num AS probe, b.num AS other, {_D2} AS d2 FROM sites a JOIN sites b ON CAST({_D2} AS DOUBLE) <= {OPTS.scale(12) ** 2}) SELECT * FROM p")
def radius_scan_pairs(spark, sf):
    s = views.sites(spark, sf)
    return search.within_dealt(s, s, OPTS.scale(12)).select("probe", "other", "d2")


@query("radius_scan_count", _PAIRS + "SELECT probe, count(*) AS n FROM pairs GROUP BY probe")
def radius_scan_count(spark, sf):
    return search.counts(views.sites(spark, sf), _R8).select(F.col("num").alias("probe"), "n")


@query("covered_semi_join", _PAIRS + "SELECT DISTINCT probe AS num FROM pairs")
def covered_semi_join(spark, sf):
    s = views.sites(spark, sf)
    return search.covered(s, s, _R8).select("num")


@query("uncovered_anti_join", f"WITH {SITES} SELECT num FROM sites a WHERE NOT EXISTS (SELECT 1 FROM sites b WHERE b.num <> a.num AND CAST({_D2} AS DOUBLE) <= {OPTS.scale(12) ** 2})")
def uncovered_anti_join(spark, sf):
    s = views.sites(spark, sf)
    return search.uncovered(s, s, OPTS.scale(12)).select("num")


@query("nearest_neighbour", _PAIRS + "SELECT probe, other, d2 FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d2, CAST(other AS VARCHAR)) AS n FROM pairs) WHERE n = 1")
def nearest_neighbour(spark, sf):
    s = views.sites(spark, sf)
    return search.nearest(s, s, _R8).select("probe", "other", "d2")


# --- the hierarchy and its reads


@query("net_nodes", nodes_sql("SELECT num, qx, qy, cat, tz, parent FROM nodes"))
def net_nodes(spark, sf):
    return net.build_nodes(views.sites(spark, sf), OPTS).drop("collection")


def _representative(zoom: int) -> None:
    @query(f"representative_z{zoom}", nodes_sql(f"SELECT num, rep FROM assignment WHERE zoom = {zoom}"))
    def run(spark, sf):
        return net.at_zoom(segments_of(spark, sf), zoom).select("num", "rep")


for _z in (4, 8, 12):
    _representative(_z)


@query("children_list", nodes_sql("SELECT parent, string_agg(CAST(num AS VARCHAR), ',' ORDER BY tz, CAST(num AS VARCHAR)) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent"))
def children_list(spark, sf):
    kids = nodes_of(spark, sf).where("parent IS NOT NULL").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("tz", F.col("num").cast("string").alias("n")))).alias("k"))
    return kids.select("parent", F.array_join(F.transform("k", lambda x: x["n"]), ",").alias("children"))


@query("tree_depth", nodes_sql("SELECT num, count(*) AS depth FROM chain GROUP BY num"))
def tree_depth(spark, sf):
    # every ancestor of a point represents it at some zoom, but a leaf itself at none
    walks = segments_of(spark, sf).groupBy("num").agg(F.count(F.lit(1)).alias("n"))
    leaf = (F.col("tz") > LAST).cast("bigint")
    return nodes_of(spark, sf).join(walks, "num").select("num", (F.col("n") + leaf).alias("depth"))


_CLUSTERS = "SELECT rep, count(*) AS cnt, CAST(sum(qx) AS BIGINT) AS sx, CAST(sum(qy) AS BIGINT) AS sy, min(num) AS one FROM assignment WHERE zoom = {z} AND {where} GROUP BY rep"
_PLACED = "round(sx / cnt / 1073741824e0 * 360 - 180, 6) AS lng, round(atan(exp((0.5e0 - sy / cnt / 1073741824e0) * 2 * pi())) * 360 / pi() - 90, 6) AS lat"


def _features(found: DataFrame) -> DataFrame:
    f = reads.features(found)
    return f.select("rep", "is_cluster", "num", "cluster_id", "count", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def _features_sql(zoom: int, where: str = "true", having: str = "true") -> str:
    return nodes_sql(f"SELECT rep, cnt > 1 AS is_cluster, CASE WHEN cnt = 1 THEN one END AS num, CASE WHEN cnt > 1 THEN rep * 32 + {zoom} END AS cluster_id, cnt AS count, {_PLACED} FROM ({_CLUSTERS.format(z=zoom, where=where)}) WHERE {having}")


def _world(zoom: int) -> None:
    @query(f"clusters_world_z{zoom}", _features_sql(zoom))
    def run(spark, sf):
        return _features(reads.clusters(segments_of(spark, sf), OPTS, zoom))


for _z in (0, 4, 8, 12, 16):
    _world(_z)

_FLEET = fleet.fleet_sql("c_custkey")


@query("fleet_clusters", _features_sql(7).replace(views.SITES_DUCK, f"SELECT c_custkey AS num, {_FLEET[0]} AS qx, {_FLEET[1]} AS qy, {_FLEET[2]} AS cat FROM customer"))
def fleet_clusters(spark, sf):
    """A synthetic fleet as large as the customers."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("'fleet' AS collection", "c_custkey AS num", f"{_FLEET[0]} AS qx", f"{_FLEET[1]} AS qy", f"{_FLEET[2]} AS cat")
    return _features(reads.clusters(net.segments(net.build_nodes(rows, OPTS), OPTS), OPTS, 7))


_X0, _Y0, _X1, _Y1 = geo.world_box(BOX)
_IN_BOX = f"sx / cnt BETWEEN {_X0} AND {_X1} AND sy / cnt BETWEEN {_Y0} AND {_Y1}"


@query("clusters_bbox", _features_sql(10, having=_IN_BOX))
def clusters_bbox(spark, sf):
    return _features(reads.clusters(segments_of(spark, sf), OPTS, 10, box=BOX))


@query("clusters_filtered", _features_sql(8, where="cat = 2"))
def clusters_filtered(spark, sf):
    return _features(reads.clusters(segments_of(spark, sf), OPTS, 8, cat=2))


@query("filtered_singletons", _features_sql(6, where="cat = 3", having="cnt = 1"))
def filtered_singletons(spark, sf):
    return _features(reads.clusters(segments_of(spark, sf), OPTS, 6, cat=3)).where("count = 1")


@query("cluster_cube", nodes_sql("SELECT zoom, rep, cat, count(*) AS cnt, CAST(sum(qx) AS BIGINT) AS sx, CAST(sum(qy) AS BIGINT) AS sy, CAST(grouping(cat) AS INTEGER) AS whole FROM assignment GROUP BY GROUPING SETS ((zoom, rep), (zoom, rep, cat))"))
def cluster_cube(spark, sf):
    return net.cube(segments_of(spark, sf)).drop("collection")


@query("category_slices", nodes_sql("SELECT zoom, cat, count(*) AS cnt, count(DISTINCT rep) AS reps FROM assignment GROUP BY zoom, cat"))
def category_slices(spark, sf):
    return net.cube(segments_of(spark, sf)).where("whole = 0").groupBy("zoom", "cat").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("reps"))


@query("centers_per_level", nodes_sql(f"SELECT CAST(l AS INTEGER) AS level, count(*) AS centers FROM nodes JOIN (SELECT unnest(range({LAST + 2})) AS l) ON tz <= l GROUP BY l"))
def centers_per_level(spark, sf):
    return reads.centers_per_level(nodes_of(spark, sf), OPTS).select("level", "centers")


@query("grid_entries", nodes_sql(f"SELECT CAST(sum(greatest({LAST + 1} - tz, 0)) AS BIGINT) AS entries FROM nodes"))
def grid_entries(spark, sf):
    return reads.grid_entries(nodes_of(spark, sf), OPTS).select("entries")


@query("memory_bytes", nodes_sql(f"SELECT CAST(sum(56 + 16 * greatest({LAST + 1} - tz, 0) + length(CAST(num AS VARCHAR))) AS BIGINT) AS memory_bytes FROM nodes"))
def memory_bytes(spark, sf):
    named = nodes_of(spark, sf).select("collection", F.col("num").cast("string").alias("id"), F.lit(None).cast("string").alias("props"))
    return reads.memory_bytes(nodes_of(spark, sf), named, OPTS).select("memory_bytes")


@query("distinct_reps", nodes_sql("SELECT zoom, count(DISTINCT rep) AS reps FROM assignment GROUP BY zoom"))
def distinct_reps(spark, sf):
    return net.assignment(segments_of(spark, sf)).groupBy("zoom").agg(F.count_distinct("rep").alias("reps"))


@query("expansion_zoom", nodes_sql(f"SELECT c.num AS rep, CAST(coalesce(min(k.tz), {LAST + 1}) AS INTEGER) AS expansion FROM nodes c LEFT JOIN nodes k ON k.parent = c.num AND k.tz > 6 WHERE c.tz <= 6 GROUP BY c.num"))
def expansion_zoom(spark, sf):
    return reads.expansion_zooms(nodes_of(spark, sf), OPTS, 6).select("rep", "expansion")


@query("cluster_children", nodes_sql("SELECT b.rep, count(*) AS cnt, CAST(sum(b.qx) AS BIGINT) AS sx, CAST(sum(b.qy) AS BIGINT) AS sy FROM assignment a JOIN assignment b ON a.num = b.num WHERE a.zoom = 3 AND a.rep = 1 AND b.zoom = (SELECT min(tz) FROM nodes WHERE parent = 1 AND tz > 3) GROUP BY b.rep"))
def cluster_children(spark, sf):
    return reads.children(segments_of(spark, sf), nodes_of(spark, sf), OPTS, 1 * 32 + 3, "sites").select("rep", "cnt", "sx", "sy")


@query("cluster_leaves_page", nodes_sql("SELECT num, qx, qy, cat FROM assignment WHERE zoom = 3 AND rep = 1 ORDER BY num LIMIT 10 OFFSET 5"))
def cluster_leaves_page(spark, sf):
    return reads.leaves(segments_of(spark, sf), nodes_of(spark, sf), 1 * 32 + 3, "sites", 10, 5).select("num", "qx", "qy", "cat")


@query("cluster_of_device", nodes_sql("SELECT rep, count(*) AS cnt, CAST(sum(qx) AS BIGINT) AS sx, CAST(sum(qy) AS BIGINT) AS sy FROM assignment WHERE zoom = 9 AND rep = (SELECT rep FROM assignment WHERE zoom = 9 AND num = 77) GROUP BY rep"))
def cluster_of_device(spark, sf):
    return reads.cluster_of(segments_of(spark, sf), OPTS, F.lit(77), 9.7, "sites").select("rep", "cnt", "sx", "sy")


@query("geojson_features", nodes_sql("SELECT rep, cnt > 1 AS is_cluster, CASE WHEN cnt > 1 THEN '{\"cluster\":true,\"cluster_id\":' || CAST(rep * 32 + 8 AS VARCHAR) || ',\"point_count\":' || CAST(cnt AS VARCHAR) || ',\"point_count_abbreviated\":\"' || CAST(cnt AS VARCHAR) || '\"}' ELSE '{\"id\":\"' || CAST(one AS VARCHAR) || '\"}' END AS properties FROM (" + _CLUSTERS.format(z=8, where="true") + ")"))
def geojson_features(spark, sf):
    f = reads.features(reads.clusters(segments_of(spark, sf), OPTS, 8))
    g = feat.geojson(f).join(f.select("rep", "is_cluster"), "rep")
    return g.select("rep", "is_cluster", F.get_json_object("feature", "$.properties").alias("properties"))


_TILES = f"""SELECT tx, ty, rep, CAST(round((sx / cnt / 1073741824e0 * 256 - tx) * 512) AS BIGINT) AS x, CAST(round((sy / cnt / 1073741824e0 * 256 - ty) * 512) AS BIGINT) AS y, cnt
FROM (SELECT *, unnest(range(CAST(greatest(ceil(sy / cnt / 1073741824e0 * 256 - 1 - {OPTS.radius / OPTS.extent}), 0) AS BIGINT), CAST(least(floor(sy / cnt / 1073741824e0 * 256 + {OPTS.radius / OPTS.extent}), 255) AS BIGINT) + 1)) AS ty
FROM (SELECT *, unnest(range(CAST(greatest(ceil(sx / cnt / 1073741824e0 * 256 - 1 - {OPTS.radius / OPTS.extent}), 0) AS BIGINT), CAST(least(floor(sx / cnt / 1073741824e0 * 256 + {OPTS.radius / OPTS.extent}), 255) AS BIGINT) + 1)) AS tx
FROM ({_CLUSTERS.format(z=8, where="true")})))"""


@query("tile_features", nodes_sql(_TILES))
def tile_features(spark, sf):
    return reads.tile_features(segments_of(spark, sf), OPTS, 8).select("tx", "ty", "rep", "x", "y", "cnt")


@query("tile_json", nodes_sql(f"SELECT tx, ty, rep, '{{\"cluster\":' || CASE WHEN cnt > 1 THEN 'true' ELSE 'false' END || ',\"id\":' || CAST(rep AS VARCHAR) || ',\"count\":' || CAST(cnt AS VARCHAR) || ',\"x\":' || CAST(x AS VARCHAR) || ',\"y\":' || CAST(y AS VARCHAR) || '}}' AS feature, 512 AS extent FROM ({_TILES})"))
def tile_json(spark, sf):
    return tiles.tile_json(reads.tile_features(segments_of(spark, sf), OPTS, 8), OPTS).select("tx", "ty", "rep", "feature", "extent")


@query("tile_mvt")
def tile_mvt(spark, sf):
    return tiles.tile_mvt(reads.tile_features(segments_of(spark, sf), OPTS, 8), OPTS)


def _verified(name: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    @query(f"verify_{name}", "SELECT CAST(0 AS BIGINT) AS violations")
    def run(spark, sf):
        return make(nodes_of(spark, sf), segments_of(spark, sf)).agg(F.count(F.lit(1)).alias("violations"))


_verified("covering", lambda n, s: verify.bad_levels(n, OPTS))
_verified("separation", lambda n, s: verify.bad_separation(n, OPTS))
_verified("partition", lambda n, s: verify.bad_partition(n, s, OPTS))
_verified("radius", lambda n, s: verify.bad_radius(n, s, OPTS))
_verified("slices", lambda n, s: verify.bad_slices(s))
_verified("reachable", verify.unreachable)
_verified("grid", lambda n, s: verify.bad_grid(n, s, OPTS))


@query("partition_fingerprint", nodes_sql("SELECT zoom, count(*) AS points, bit_xor(CAST('0x' || substr(md5(CAST(num AS VARCHAR) || '>' || CAST(rep AS VARCHAR)), 1, 15) AS BIGINT)) AS fingerprint FROM assignment GROUP BY zoom"))
def partition_fingerprint(spark, sf):
    return net.fingerprints(segments_of(spark, sf)).select("zoom", "points", "fingerprint")


@query("point_positions", nodes_sql("SELECT num, cat, round(qx / 1073741824e0 * 360 - 180, 6) AS lng, round(atan(exp((0.5e0 - qy / 1073741824e0) * 2 * pi())) * 360 / pi() - 90, 6) AS lat FROM nodes"))
def point_positions(spark, sf):
    n = nodes_of(spark, sf)
    return n.select("num", "cat", F.round(geo.unproject_x(F.col("qx")), 6).alias("lng"), F.round(geo.unproject_y(F.col("qy")), 6).alias("lat"))


# --- catalog

_STATS = _LIVES + ", stats AS (SELECT collection, count(*) AS reports, CAST(count(*) FILTER (op = 'remove') AS BIGINT) AS removals, max(ts) AS last_report, (SELECT count(*) FROM live l WHERE l.collection = r.collection) AS devices, (SELECT CAST(coalesce(sum(octet_length(encode(props))), 0) AS BIGINT) FROM live l WHERE l.collection = r.collection) AS props_bytes FROM reports r GROUP BY collection) "


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.stats(_live(spark, sf), views.reports(spark, sf))


@query("collections_list", _STATS + "SELECT collection, devices FROM stats ORDER BY collection")
def collections_list(spark, sf):
    return catalog.listed(_stats(spark, sf)).select("collection", "devices")


@query("collection_stats", _STATS + "SELECT collection, devices, props_bytes, reports, removals, last_report FROM stats")
def collection_stats(spark, sf):
    return _stats(spark, sf)


@query("health_totals", _STATS + "SELECT 'ok' AS status, count(*) AS collections, CAST(sum(devices) AS BIGINT) AS devices FROM stats")
def health_totals(spark, sf):
    return catalog.health(_stats(spark, sf))


@query("metrics_text", _STATS + ", e AS (" + "SELECT collection, CAST(count(*) FILTER (NOT gone AND (life < newest OR late)) AS BIGINT) AS expired FROM (SELECT l.collection, l.life, n.life AS newest, ended = 'remove' AS gone, epoch_us(last_seen) < (SELECT max(epoch_us(ts)) FROM reports) - " + DAY + " AS late FROM lives l JOIN newest n USING (collection, id) WHERE l.reports > 0) GROUP BY collection)" + ", m AS (UNPIVOT (SELECT collection, devices, reports, removals, props_bytes, expired FROM stats JOIN e USING (collection)) ON devices, reports, removals, props_bytes, expired INTO NAME metric VALUE v) SELECT collection, metric, 'shoal_' || metric || '{collection=\"' || collection || '\"} ' || CAST(v AS VARCHAR) AS line FROM m")
def metrics_text(spark, sf):
    expired = state.life_counts(views.reports(spark, sf), OPTS.ttl_seconds, _as_of(spark, sf)).select("collection", "expired")
    return catalog.metrics_text(catalog.full_stats(_stats(spark, sf), expired))


@query("value_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def value_percentiles(spark, sf):
    found = catalog.percentiles(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value")
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


def _devices(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf).join(state.intern_ids(views.reports(spark, sf)), ["collection", "id"]).select(*snapshot.COLUMNS)


@query("snapshot_roundtrip", _LIVES + "SELECT collection, num, id, qx, qy, cat, last_seen, props FROM live JOIN interned USING (collection, id)")
def snapshot_roundtrip(spark, sf):
    import uuid

    path = snapshot.write(_devices(spark, sf), f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")
    return snapshot.read(spark, path)


@query("restore_ttl_filter", _LIVES + "SELECT collection, id, row_number() OVER (PARTITION BY collection ORDER BY num) - 1 AS num FROM live JOIN interned USING (collection, id) WHERE epoch_us(last_seen) >= (SELECT max(epoch_us(ts)) FROM reports) - 21600000000")
def restore_ttl_filter(spark, sf):
    opts = Options(categories=OPTS.categories, ttl_seconds=21_600)
    return snapshot.restore(_devices(spark, sf), opts, _as_of(spark, sf)).select("collection", "id", "num")


@query("restore_shrunken_categories", _LIVES + "SELECT collection, id, CAST(CASE WHEN cat < 3 THEN cat ELSE 0 END AS INTEGER) AS cat FROM live")
def restore_shrunken_categories(spark, sf):
    opts = Options(categories=OPTS.categories[:3], ttl_seconds=OPTS.ttl_seconds)
    return snapshot.restore(_devices(spark, sf), opts, _as_of(spark, sf)).select("collection", "id", "cat")


# --- replay

_COUNTED = _LIVES + f""", w AS (
  SELECT *, CASE WHEN op = 'upsert' AND lag(op) OVER v = 'upsert' AND (lag(qx) OVER v <> qx OR lag(qy) OVER v <> qy) THEN 1 ELSE 0 END AS moved
  FROM lived WINDOW v AS (PARTITION BY collection, id, life ORDER BY seq)),
each AS (
  SELECT l.collection, l.id, l.life, l.reports, l.ended = 'remove' AS gone, n.life AS newest, epoch_us(l.last_seen) < (SELECT max(epoch_us(ts)) FROM reports) - {DAY} AS late,
         (SELECT sum(moved) FROM w WHERE w.collection = l.collection AND w.id = l.id AND w.life = l.life) AS moves
  FROM lives l JOIN newest n USING (collection, id) WHERE l.reports > 0)
SELECT collection, CAST(count(*) FILTER (NOT gone AND life = newest AND NOT late) AS BIGINT) AS devices, CAST(sum(reports) AS BIGINT) AS reports, count(*) AS inserts,
       CAST(count(*) FILTER (gone OR life < newest OR late) AS BIGINT) AS removes, CAST(count(*) FILTER (NOT gone AND (life < newest OR late)) AS BIGINT) AS expired, CAST(sum(moves) AS BIGINT) AS moves
FROM each GROUP BY collection"""


def _end(spark: SparkSession, sf: str) -> int:
    return views.reports(spark, sf).agg(F.max(state.micros(F.col("ts")))).first()[0]


@query("life_counts", _COUNTED)
def life_counts(spark, sf):
    return state.life_counts(views.reports(spark, sf), OPTS.ttl_seconds, _as_of(spark, sf))


@query("replay_stats", _COUNTED)
def replay_stats(spark, sf):
    """What the order-dependent replay counts of things that windows can count as well."""
    found = replay.replay_counts(views.reports(spark, sf), OPTS, _end(spark, sf))
    return found.select("collection", "devices", "reports", "inserts", "removes", "expired", "moves")


@query("replay_devices", _LIVES + "SELECT collection, id, num, qx, qy, cat, last_seen, props FROM live JOIN interned USING (collection, id)")
def replay_devices(spark, sf):
    return replay.replay_devices(views.reports(spark, sf), OPTS, _end(spark, sf))


@query("replay_moves")
def replay_moves(spark, sf):
    return replay.replay_nodes(views.reports(spark, sf), OPTS, _end(spark, sf))


@query("replay_violations", "SELECT unnest(['covering', 'separation', 'partition', 'radius', 'slices', 'reachable', 'grid']) AS invariant, CAST(0 AS BIGINT) AS violations")
def replay_violations(spark, sf):
    """All invariants of the hierarchy that moves, removals and expiry have left."""
    nodes = materialise(replay.replay_nodes(views.reports(spark, sf), OPTS, _end(spark, sf)).drop("id"), "replayed")
    return verify.verify(nodes, net.segments(nodes, OPTS), OPTS)


@query("fast_move_share")
def fast_move_share(spark, sf):
    return catalog.fast_share(replay.replay_counts(views.reports(spark, sf), OPTS))


@query("stream_devices", _LIVES + """, clock AS (SELECT collection, max(epoch_us(ts)) AS c FROM reports GROUP BY collection)
SELECT l.collection, l.id, i.num, l.qx, l.qy, l.cat, l.last_seen, l.props
FROM lives l JOIN newest USING (collection, id, life) JOIN interned i USING (collection, id) JOIN clock USING (collection)
WHERE ended = 'upsert' AND epoch_us(last_seen) >= c - """ + DAY)
def stream_devices(spark, sf):
    """The live engine over the reports, which arrive in three lots: the snapshot that its sink keeps, in the end."""
    import uuid

    from shoal.streaming import live

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    r = views.reports(spark, sf).select("collection", "seq", "ts", "op", "id", "qx", "qy", "cat", "props")
    low, high = r.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // 3 + 1
    for k in range(3):
        r.where((F.col("seq") >= low + k * step) & (F.col("seq") < low + (k + 1) * step)).write.mode("append").parquet(f"{base}/in")
        stream = live.keep(live.read_reports(spark, f"{base}/in", r.schema, 1 << 20), OPTS, "changes")
        live.run_available(stream, live.snapshot_sink(f"{base}/out"), f"{base}/state")
    return snapshot.read(spark, f"{base}/out")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["clusters_world_z4"](spark, sf)
