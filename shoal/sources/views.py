"""Points and position reports derived from the star-schema tables, with integer arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def home_x(k: str) -> str:
    return f"(398458880 + ({k} % 5) * 20000000 + ((((({k} * {k}) % 1000003) * 7919 + {k} * 104729) % 2000003) >> CAST(({k} % 4) * 4 AS INT)))"


def home_y(k: str) -> str:
    return f"(609000000 + ({k} % 5) * 9000000 + ((((({k} * {k}) % 999983) * 15485863 + {k} * 1299709) % 2000003) >> CAST(({k} % 4) * 4 AS INT)))"


_W = "(CASE WHEN event_id % 7 = 0 THEN 2000003 ELSE 2001 END)"
SITES = f"""
SELECT 'sites' AS collection, c_custkey AS num, {home_x('c_custkey')} AS qx, {home_y('c_custkey')} AS qy,
       CAST(c_nationkey % 5 AS INT) AS cat, c_mktsegment AS segment
FROM customer"""
REPORTS = f"""
SELECT CONCAT('c', CAST(user_id % 4 AS STRING)) AS collection, event_id AS seq, ts,
       CASE WHEN event_id % 53 = 0 THEN 'remove' ELSE 'upsert' END AS op, CONCAT('dev-', CAST(user_id AS STRING)) AS id, user_id,
       {home_x('user_id')} + (((event_id * event_id) % 1000003) * 7919 + event_id * 104729) % {_W} AS qx,
       {home_y('user_id')} + (((event_id * event_id) % 999983) * 15485863 + event_id * 1299709) % {_W} AS qy,
       CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cat,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props, event_type AS label, event_id, value
FROM events"""
#: The same for DuckDB.
SITES_DUCK, REPORTS_DUCK = (s.replace("AS STRING", "AS VARCHAR") for s in (SITES, REPORTS))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SITES.replace("FROM customer", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPORTS.replace("FROM events", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/events.parquet"))
