"""The driver's tables seen as observations, forecasts and the like, in Spark and in the reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro import schema


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OBS_SQL = """obs AS (SELECT 'site_' || CAST(user_id % 4 AS VARCHAR(9)) AS site_id, CAST(ts AS TIMESTAMP) AS datetime_utc,
  CASE event_type WHEN 'view' THEN 'temperature_2m' WHEN 'click' THEN 'wind_speed_10m' WHEN 'purchase' THEN 'precipitation'
    WHEN 'error' THEN 'relative_humidity_2m' ELSE 'wind_direction_10m' END AS variable,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'view' THEN value / 5 - 10 WHEN event_type = 'error' THEN value / 2
    WHEN event_type = 'signup' THEN value % 360 ELSE value / 4 END AS value,
  'src_' || CAST(event_id % 2 AS VARCHAR(9)) AS source, 'measured' AS method,
  CASE WHEN event_id % 11 = 0 THEN 'missing' ELSE 'ok' END AS qc_flag, event_id FROM events)"""


def obs(spark: SparkSession, sf_dir: str, half_hours: bool = False) -> DataFrame:
    """One row for each key: of events that share one, the lowest id's. half_hours: times are cut to them, as a logger's would be."""
    e = _table(spark, sf_dir, "events")
    kind = F.col("event_type")
    value = F.when(F.col("event_id") % 11 == 0, None).when(kind == "view", F.col("value") / 5 - 10).when(kind == "error", F.col("value") / 2).when(kind == "signup", F.col("value") % 360).otherwise(F.col("value") / 4)
    name = F.when(kind == "view", "temperature_2m").when(kind == "click", "wind_speed_10m").when(kind == "purchase", "precipitation").when(kind == "error", "relative_humidity_2m").otherwise("wind_direction_10m")
    d = e.select(
        F.concat(F.lit("site_"), (F.col("user_id") % 4).cast("string")).alias("site_id"), (F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800) * 1800) if half_hours else F.col("ts").cast("timestamp")).alias("datetime_utc"), name.alias("variable"), value.alias("value"),
        F.concat(F.lit("src_"), (F.col("event_id") % 2).cast("string")).alias("source"), F.lit("measured").alias("method"), F.when(F.col("event_id") % 11 == 0, "missing").otherwise("ok").alias("qc_flag"), "event_id",
    )
    rest = [c for c in d.columns if c not in schema.OBS_KEY]
    one = d.groupBy(*schema.OBS_KEY).agg(F.min_by(F.struct(*rest), F.col("event_id")).alias("r")).select(*schema.OBS_KEY, "r.*")
    return one.select(*schema.OBS.names)


OBS1_SQL = OBS_SQL + """, o1 AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY site_id, datetime_utc, variable, source ORDER BY event_id) = 1)"""
OBSH_SQL = OBS1_SQL.replace("CAST(ts AS TIMESTAMP) AS datetime_utc", "time_bucket(INTERVAL 30 MINUTE, CAST(ts AS TIMESTAMP)) AS datetime_utc")

FC_SQL = """fc AS (SELECT 'site_' || CAST(l_suppkey % 4 AS VARCHAR(9)) AS site_id, 'model_' || CAST(l_partkey % 2 AS VARCHAR(9)) AS source,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'm' || CAST(l_partkey % 3 AS VARCHAR(9)) END AS model, CAST(o_orderdate AS TIMESTAMP) AS issue_time, CAST(l_shipdate AS TIMESTAMP) AS valid_time,
  CAST(l_linenumber AS INTEGER) AS member, 'temperature_2m' AS variable, l_quantity - 10 AS value, l_orderkey, l_linenumber,
  l_extendedprice / 2000 AS forecast, l_extendedprice / 2100 + l_tax * 20 AS observation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    d = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select(
        F.concat(F.lit("site_"), (F.col("l_suppkey") % 4).cast("string")).alias("site_id"), F.concat(F.lit("model_"), (F.col("l_partkey") % 2).cast("string")).alias("source"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string"))).alias("model"), F.col("o_orderdate").cast("timestamp").alias("issue_time"), F.col("l_shipdate").cast("timestamp").alias("valid_time"),
        F.col("l_linenumber").cast("int").alias("member"), F.lit("temperature_2m").alias("variable"), (F.col("l_quantity") - 10).alias("value"), "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / 2000).alias("forecast"), (F.col("l_extendedprice") / 2100 + F.col("l_tax") * 20).alias("observation"),
    )


def wide_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's numbers as the variables that the consistency relations name."""
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 1.0 - 20).alias("temperature_2m"), (F.col("l_tax") * 500 - 10).alias("dewpoint_2m"), (F.col("l_discount") * 1100).alias("relative_humidity_2m"),
        (F.col("l_quantity") / 2).alias("wind_speed_10m"), (F.col("l_tax") * 300).alias("wind_gusts_10m"), (F.col("l_extendedprice") / 100).alias("direct_radiation"), (F.col("l_discount") * 3000).alias("diffuse_radiation"), (F.col("l_quantity") * 20).alias("clear_sky_ceiling"),
    )


WIDE_SQL = """w AS (SELECT l_orderkey, l_linenumber, l_quantity * 1.0 - 20 AS temperature_2m, l_tax * 500 - 10 AS dewpoint_2m, l_discount * 1100 AS relative_humidity_2m,
  l_quantity / 2 AS wind_speed_10m, l_tax * 300 AS wind_gusts_10m, l_extendedprice / 100 AS direct_radiation, l_discount * 3000 AS diffuse_radiation, l_quantity * 20 AS clear_sky_ceiling FROM lineitem)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.cast("string").alias("station_id"), (k % 180 - 90 + (k % 7) / 10).alias("latitude"), (k * 7 % 360 - 180 + (k % 11) / 20).alias("longitude"), F.when(k % 5 == 0, None).otherwise((k % 60).cast("string")).alias("identity"))


STATIONS_SQL = """st AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_suppkey % 180 - 90 + (s_suppkey % 7) / 10 AS latitude, s_suppkey * 7 % 360 - 180 + (s_suppkey % 11) / 20 AS longitude,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 60 AS VARCHAR) END AS identity FROM supplier)"""
