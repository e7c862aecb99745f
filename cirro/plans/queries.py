"""Registered queries, and the SQL that each must equal.

Doubles are rounded to a few places on both sides, for sums differ in their order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro import registry, sites, store
from cirro.functions import physics
from cirro.operators import aggregate, correct, fill, qc, reshape, stations, transfer, verify
from cirro.plans import serve, views
from cirro.plans.views import FC_SQL, OBS1_SQL, OBSH_SQL, STATIONS_SQL, WIDE_SQL
from cirro.schema import OBS, OBS_KEY
from cirro.sources import base, vendors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VARS = ["temperature_2m", "wind_speed_10m", "precipitation", "relative_humidity_2m", "wind_direction_10m"]
SITE = (-34.75, 148.2, 220.0)


_NOW = dt.datetime(2026, 1, 1)


def _sites(spark: SparkSession, sf: str) -> list[sites.Site]:
    """The four sites that views.obs() has."""
    return [sites.Site(f"site_{k}", *SITE, "UTC") for k in range(4)]


def _stored(spark: SparkSession, sf: str) -> store.Store:
    """A store of its own in the folder that executors share, with the half-hourly observations."""
    s = store.Store(spark, store.scratch(spark))
    s.write_obs(views.obs(spark, sf, True), _NOW, check=False)
    return s


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def r(c: str | Column, n: int = 5) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, n) + 0.0  # off exact ties; -0.0 becomes 0.0
    return out.alias(name) if name else out


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYS = "site_id, datetime_utc, variable, source"
_RANK = "CASE qc_flag WHEN 'ok' THEN 0 WHEN 'suspect' THEN 1 WHEN 'fail' THEN 2 ELSE 3 END"
_RANGE = """CASE variable WHEN 'temperature_2m' THEN value < -50 OR value > 60 WHEN 'wind_speed_10m' THEN value < 0 OR value > 120
  WHEN 'precipitation' THEN value < 0 OR value > 500 WHEN 'relative_humidity_2m' THEN value < 0 OR value > 100 ELSE value < 0 OR value > 360 END"""
_LIMIT = "CASE variable WHEN 'temperature_2m' THEN 8 WHEN 'wind_speed_10m' THEN 25 WHEN 'relative_humidity_2m' THEN 40 WHEN 'wind_direction_10m' THEN 150 END"
_SERIES = "PARTITION BY site_id, source, variable ORDER BY datetime_utc"
_STEP = f"""CASE WHEN variable = 'wind_direction_10m' THEN least(abs(value - lag(value) OVER s) % 360, 360 - abs(value - lag(value) OVER s) % 360) ELSE abs(value - lag(value) OVER s) END"""
_STEP_SQL = f", st AS (SELECT *, {_STEP} AS step FROM o1 WINDOW s AS ({_SERIES}))"
_FLAGGED_SQL = _STEP_SQL + f""", f AS (SELECT {_KEYS}, value, method, CASE greatest({_RANK}, CASE WHEN {_RANGE} THEN 2 ELSE 0 END, CASE WHEN variable <> 'precipitation' AND step > {_LIMIT} THEN 1 ELSE 0 END)
  WHEN 0 THEN 'ok' WHEN 1 THEN 'suspect' WHEN 2 THEN 'fail' ELSE 'missing' END AS qc_flag FROM st)"""
_CLASS_SQL = """CASE WHEN variable = 'precipitation' THEN sum(value) WHEN variable = 'wind_direction_10m'
  THEN (degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) + 360) - 360 * floor((degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) + 360) / 360) ELSE avg(value) END"""


def _expected_sql(of: str) -> str:
    return f""", gaps AS (SELECT variable, epoch_us(d) - lag(epoch_us(d)) OVER (PARTITION BY variable ORDER BY d) AS gap FROM (SELECT DISTINCT variable, datetime_utc AS d FROM {of}) x),
  modes AS (SELECT variable, gap FROM (SELECT variable, gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY variable, gap) y QUALIFY row_number() OVER (PARTITION BY variable ORDER BY n DESC, gap) = 1),
  expd AS (SELECT v.variable, coalesce(greatest(1, CAST(round(3.6e9 / gap) AS INTEGER)), 1) AS expected FROM (SELECT DISTINCT variable FROM {of}) v LEFT JOIN modes USING (variable))"""


def _hourly_sql(of: str) -> str:
    return _expected_sql(of) + f""", h AS (SELECT site_id, variable, date_trunc('hour', datetime_utc) AS hour, {_CLASS_SQL} AS value, count(*) AS n_ok, arg_min(source, epoch_us(datetime_utc) * 2 + CAST(right(source, 1) AS INTEGER)) AS source
  FROM {of} WHERE qc_flag = 'ok' AND value IS NOT NULL GROUP BY site_id, variable, date_trunc('hour', datetime_utc)),
  hourly AS (SELECT site_id, hour AS datetime_utc, h.variable, value, source FROM h JOIN expd ON h.variable = expd.variable WHERE n_ok / expected >= 0.75)"""


def _pivot_sql(of: str, time: str = "datetime_utc") -> str:
    cols = ", ".join(f"round(max(value) FILTER (variable = '{v}') + 1e-9, 5) + 0.0 AS {v}" for v in VARS)
    return f"SELECT site_id, {time} AS datetime_utc, {cols} FROM {of} GROUP BY site_id, {time}"


# flags, hourly values, wide table
@query(f"WITH {OBSH_SQL}{_FLAGGED_SQL}{_hourly_sql('f')} {_pivot_sql('hourly')}")
def flagship(spark, sf):
    flagged = qc.qc_step(qc.qc_range(views.obs(spark, sf, True)))
    wide = reshape.widen_obs(aggregate.aggregate_hourly(flagged), VARS)
    return wide.select("site_id", "datetime_utc", *map(r, VARS))



@query(f"WITH {OBS1_SQL} SELECT site_id, datetime_utc, {', '.join(f'round(max(value) FILTER (variable = {v!r} AND rk = 1) + 1e-9, 5) + 0.0 AS {v}' for v in VARS)} FROM (SELECT *, row_number() OVER (PARTITION BY site_id, datetime_utc, variable ORDER BY source) AS rk FROM o1) x GROUP BY site_id, datetime_utc")
def widen_obs(spark, sf):
    return reshape.widen_obs(views.obs(spark, sf), VARS).select("site_id", "datetime_utc", *map(r, VARS))


@query("SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS site_id, CAST(l_shipdate AS TIMESTAMP) AS datetime_utc, variable, round(value + 1e-9, 5) + 0.0 AS value, 'wide' AS source, 'measured' AS method, 'ok' AS qc_flag FROM (SELECT l_orderkey, l_shipdate, l_quantity * 1.0 AS temperature_2m, l_tax * 100 AS dewpoint_2m, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 100 END AS wind_speed_10m FROM lineitem) UNPIVOT (value FOR variable IN (temperature_2m, dewpoint_2m, wind_speed_10m))")
def narrow_obs(spark, sf):
    wide = t(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("site_id"), F.col("l_shipdate").cast("timestamp").alias("datetime_utc"), (F.col("l_quantity") * 1.0).alias("temperature_2m"), (F.col("l_tax") * 100).alias("dewpoint_2m"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 100).alias("wind_speed_10m"))
    return reshape.narrow_obs(wide, "wide").withColumn("value", r("value"))


@query(f"WITH {OBS1_SQL} SELECT {_KEYS}, CASE greatest({_RANK}, CASE WHEN {_RANGE} THEN 2 ELSE 0 END) WHEN 0 THEN 'ok' WHEN 2 THEN 'fail' ELSE 'missing' END AS qc_flag FROM o1")
def qc_range(spark, sf):
    return qc.qc_range(views.obs(spark, sf)).select(*OBS_KEY, "qc_flag")


@query(f"WITH {OBS1_SQL}{_STEP_SQL} SELECT {_KEYS}, CASE WHEN qc_flag = 'missing' THEN 'missing' WHEN variable <> 'precipitation' AND step > {_LIMIT} THEN 'suspect' ELSE 'ok' END AS qc_flag FROM st")
def qc_step(spark, sf):
    return qc.qc_step(views.obs(spark, sf)).select(*OBS_KEY, "qc_flag")


@query(f"WITH {OBS1_SQL}{_STEP_SQL} SELECT {_KEYS}, round(step + 1e-9, 5) + 0.0 AS step FROM st WHERE variable = 'wind_direction_10m'")
def qc_step_circular(spark, sf):
    return views.obs(spark, sf).where("variable = 'wind_direction_10m'").withColumn("step", qc.step_value()).select(*OBS_KEY, r("step"))


_QUANT = "o1q AS (SELECT site_id, datetime_utc, variable, source, floor(value / 40) AS value, qc_flag FROM o1)"


@query(f"""WITH {OBS1_SQL}, {_QUANT}, c AS (SELECT *, CASE WHEN lag(value) OVER s = value THEN 0 ELSE 1 END AS changed FROM o1q WINDOW s AS ({_SERIES})), g AS (SELECT *, sum(changed) OVER ({_SERIES} ROWS UNBOUNDED PRECEDING) AS run FROM c),
  l AS (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE count(value) OVER (PARTITION BY site_id, source, variable, run) END AS run_length FROM g)
  SELECT {_KEYS}, run_length, CASE WHEN qc_flag = 'missing' THEN 'missing' WHEN variable <> 'precipitation' AND run_length > 6 THEN 'suspect' ELSE 'ok' END AS qc_flag FROM l""")
def qc_persistence(spark, sf):
    o = views.obs(spark, sf).withColumn("value", F.floor(F.col("value") / 40).cast("double"))
    runs = qc.with_run_length(o)
    bad = F.when((F.col("variable") != "precipitation") & (F.col("run_length") > qc.PERSISTENCE_RUN), 1).otherwise(0)
    return runs.withColumn("qc_flag", qc.downgrade(F.col("qc_flag"), bad)).select(*OBS_KEY, "run_length", "qc_flag")


@query("""WITH h AS (SELECT dayofyear(o_orderdate) AS d, o_totalprice / 5000 AS value FROM orders), e AS (SELECT (d - 1 + k + 366) % 366 + 1 AS day_of_year, value FROM h, range(-7, 8) r(k)), env AS (SELECT day_of_year, quantile_cont(value, 0.02) AS p_low, quantile_cont(value, 0.98) AS p_high FROM e GROUP BY day_of_year)
  SELECT o_orderkey, CASE WHEN o_totalprice / 5000 < p_low OR o_totalprice / 5000 > p_high THEN 'suspect' ELSE 'ok' END AS qc_flag, round(p_low + 1e-9, 4) AS p_low, round(p_high + 1e-9, 4) AS p_high FROM orders JOIN env ON dayofyear(o_orderdate) = day_of_year""")
def qc_climatology(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("datetime_utc"), F.lit("temperature_2m").alias("variable"), (F.col("o_totalprice") / 5000).alias("value"), F.lit("ok").alias("qc_flag"))
    env = qc.climatology_envelope(o, 0.02, 0.98)
    flagged = qc.qc_climatology(o, env)
    e = F.broadcast(env.select(F.col("day_of_year").alias("d"), r("p_low", 4), r("p_high", 4)))  # 366 rows
    return flagged.join(e, F.dayofyear("datetime_utc") == F.col("d")).select("o_orderkey", "qc_flag", "p_low", "p_high")


@query(f"""WITH {OBSH_SQL}{_hourly_sql('o1')}, d AS (SELECT variable, datetime_utc, median(value) AS med, count(*) AS n FROM hourly WHERE site_id <> 'site_0' GROUP BY variable, datetime_utc HAVING count(*) >= 2),
  m AS (SELECT d.variable, d.datetime_utc, d.med, 1.4826 * median(abs(value - med)) AS mad FROM hourly JOIN d ON hourly.variable = d.variable AND hourly.datetime_utc = d.datetime_utc WHERE site_id <> 'site_0' GROUP BY ALL)
  SELECT h.site_id, h.datetime_utc, h.variable, round(h.value + 1e-9, 5) + 0.0 AS value, CASE WHEN mad > 0 AND abs(h.value - med) / mad > 3.5 THEN 'suspect' ELSE 'ok' END AS qc_flag FROM hourly h LEFT JOIN m ON h.variable = m.variable AND h.datetime_utc = m.datetime_utc WHERE h.site_id = 'site_0'""")
def qc_spatial_mad(spark, sf):
    hourly = aggregate.aggregate_hourly(views.obs(spark, sf, True))
    out = qc.qc_spatial(hourly.where("site_id = 'site_0'"), hourly.where("site_id <> 'site_0'"))
    return out.select("site_id", "datetime_utc", "variable", r("value"), "qc_flag")


_SUN = """sun AS (SELECT *, 2 * pi() * (dayofyear(t) - 1) / 365 AS g FROM s0), sun2 AS (SELECT *, 1361 * (1.000110 + 0.034221 * cos(g) + 0.001280 * sin(g) + 0.000719 * cos(2 * g) + 0.000077 * sin(2 * g)) AS e0,
  0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl,
  229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eot FROM sun),
  sky AS (SELECT *, greatest(-1, least(1, sin(radians(-34.75)) * sin(decl) + cos(radians(-34.75)) * cos(decl) * cos((hour(t) + minute(t) / 60 + floor(second(t)) / 3600 + 148.2 / 15 + eot / 60 - 12) * 15 * pi() / 180))) AS cz FROM sun2)"""


@query(f"""WITH s0 AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM events), {_SUN} SELECT event_id, round(cz + 1e-9, 4) + 0.0 AS cos_zenith,
  round(CASE WHEN cz > 0.1 THEN (0.0000509 * 220 + 0.868) * e0 * cz * exp(-(0.0000392 * 220 + 0.0387) / cz * (exp(-220 / 8000) + exp(-220 / 1250) * 2)) * exp(0.01 * pow(1 / cz, 1.8)) ELSE 0 END + 1e-9, 2) + 0.0 AS ghi FROM sky""")
def clear_sky(spark, sf):
    time = F.col("ts").cast("timestamp")
    cz = physics.cos_zenith(time, *SITE[:2])
    ghi = F.when(cz > 0.1, physics.clear_sky_irradiance(time, *SITE)).otherwise(0.0)
    return t(spark, sf, "events").select("event_id", r(cz, 4).alias("cos_zenith"), r(ghi, 2).alias("ghi"))


@query(f"""WITH s0 AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS t, value * 6 AS x FROM events), {_SUN} SELECT event_id,
  CASE WHEN (cz <= 0 AND x > 1) OR (cz > 0 AND x > 1.5 * e0 * pow(greatest(cz, 0), 1.2) + 100) THEN 'fail' WHEN cz > 0 AND x > 1.2 * e0 * pow(greatest(cz, 0), 1.2) + 50 THEN 'suspect' ELSE 'ok' END AS qc_flag FROM sky""")
def qc_solar(spark, sf):
    o = t(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("datetime_utc"), F.lit("direct_radiation").alias("variable"), (F.col("value") * 6).alias("value"), F.lit("ok").alias("qc_flag"))
    return qc.qc_solar(o, *SITE[:2]).select("event_id", "qc_flag")


@query(f"""WITH {WIDE_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN dewpoint_2m > temperature_2m THEN 'suspect' ELSE 'ok' END AS flag_dewpoint_2m, CASE WHEN relative_humidity_2m > 100 THEN 'suspect' ELSE 'ok' END AS flag_relative_humidity_2m,
  CASE WHEN wind_gusts_10m < wind_speed_10m THEN 'suspect' ELSE 'ok' END AS flag_wind_gusts_10m, CASE WHEN direct_radiation + diffuse_radiation > clear_sky_ceiling THEN 'suspect' ELSE 'ok' END AS flag_direct_radiation,
  (dewpoint_2m > temperature_2m OR relative_humidity_2m > 100 OR wind_gusts_10m < wind_speed_10m OR direct_radiation + diffuse_radiation > clear_sky_ceiling) AS violated FROM w""")
def qc_consistency_flag(spark, sf):
    return qc.consistency_flags(views.wide_part(spark, sf)).select("l_orderkey", "l_linenumber", "flag_dewpoint_2m", "flag_relative_humidity_2m", "flag_wind_gusts_10m", "flag_direct_radiation", "violated")


@query(f"""WITH {WIDE_SQL} SELECT l_orderkey, l_linenumber, round(least(dewpoint_2m, temperature_2m) + 1e-9, 4) + 0.0 AS dewpoint_2m, round(least(relative_humidity_2m, 100) + 1e-9, 4) + 0.0 AS relative_humidity_2m, round(greatest(wind_gusts_10m, wind_speed_10m) + 1e-9, 4) + 0.0 AS wind_gusts_10m,
  round(CASE WHEN direct_radiation + diffuse_radiation > clear_sky_ceiling THEN direct_radiation * clear_sky_ceiling / (direct_radiation + diffuse_radiation) ELSE direct_radiation END + 1e-9, 4) + 0.0 AS direct_radiation,
  CAST(dewpoint_2m > temperature_2m AS INTEGER) + CAST(relative_humidity_2m > 100 AS INTEGER) + CAST(wind_gusts_10m < wind_speed_10m AS INTEGER) + CAST(direct_radiation + diffuse_radiation > clear_sky_ceiling AS INTEGER) AS n_violations FROM w""")
def consistency_enforce(spark, sf):
    return qc.enforce_consistency(views.wide_part(spark, sf)).select("l_orderkey", "l_linenumber", *[r(c, 4) for c in ("dewpoint_2m", "relative_humidity_2m", "wind_gusts_10m", "direct_radiation")], "n_violations")


@query(f"WITH {OBS1_SQL}{_FLAGGED_SQL} SELECT {_KEYS}, qc_flag FROM f")
def qc_worst_flag(spark, sf):
    return qc.qc_range(qc.qc_step(views.obs(spark, sf))).select(*OBS_KEY, "qc_flag")


@query("""WITH log AS (SELECT 'site_' || CAST(user_id % 4 AS VARCHAR) AS site_id, date_trunc('day', CAST(ts AS TIMESTAMP)) AS datetime_utc, event_type AS variable, 'range' AS rule, CASE WHEN value > 50 THEN 'fail' ELSE 'ok' END AS outcome, CAST(event_id AS VARCHAR) AS detail, ts AS logged_at, event_id FROM events)
  SELECT site_id, datetime_utc, variable, rule, outcome, detail FROM log QUALIFY row_number() OVER (PARTITION BY site_id, datetime_utc, variable, rule ORDER BY logged_at DESC, event_id DESC) = 1""")
def qc_log_latest(spark, sf):
    log = t(spark, sf, "events").select(F.concat(F.lit("site_"), (F.col("user_id") % 4).cast("string")).alias("site_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("datetime_utc"), F.col("event_type").alias("variable"), F.lit("range").alias("rule"), F.when(F.col("value") > 50, "fail").otherwise("ok").alias("outcome"), F.col("event_id").cast("string").alias("detail"), F.col("ts").alias("logged_at"), "event_id")
    return reshape.newest_per_key(log, ("site_id", "datetime_utc", "variable", "rule"), [F.col("logged_at"), F.col("event_id")]).drop("logged_at", "event_id")


@query(f"WITH {OBSH_SQL}{_hourly_sql('o1')} SELECT site_id, datetime_utc, variable, source, round(value + 1e-9, 5) + 0.0 AS value FROM hourly")
def aggregate_hourly(spark, sf):
    return aggregate.aggregate_hourly(views.obs(spark, sf, True)).select("site_id", "datetime_utc", "variable", "source", r("value"))


@query(f"WITH {OBSH_SQL}{_expected_sql('o1')} SELECT variable, expected FROM expd")
def expected_per_hour(spark, sf):
    return aggregate.expected_per_hour(views.obs(spark, sf, True))


@query("SELECT user_id, round((degrees(atan2(avg(sin(radians(value % 360))), avg(cos(radians(value % 360))))) + 360) % 360 + 1e-9, 4) + 0.0 AS direction, count(*) AS n FROM events GROUP BY user_id")
def circular_mean(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(r(physics.circular_mean(F.col("value") % 360), 4).alias("direction"), F.count(F.lit(1)).alias("n"))


_LOCAL = "timezone('Australia/Sydney', timezone('UTC', datetime_utc))"
_UTC = "timezone('UTC', timezone('Australia/Sydney', {}))"


@query(f"""WITH {OBS1_SQL}, l AS (SELECT *, {_LOCAL} AS lt FROM o1 WHERE qc_flag = 'ok' AND value IS NOT NULL), d AS (SELECT *, CAST(lt AS DATE) + CASE WHEN variable = 'precipitation' AND hour(lt) >= 9 THEN 1 ELSE 0 END AS day FROM l)
  SELECT site_id, variable, {_UTC.format("CAST(day AS TIMESTAMP) + CASE WHEN variable = 'precipitation' THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END")} AS datetime_utc, round({_CLASS_SQL} + 1e-9, 4) + 0.0 AS value FROM d GROUP BY site_id, variable, day""")
def aggregate_daily_local(spark, sf):
    return aggregate.aggregate_daily(views.obs(spark, sf), "Australia/Sydney").select("site_id", "variable", "datetime_utc", r("value", 4))


@query(f"WITH {OBS1_SQL}, l AS (SELECT *, {_LOCAL} AS lt FROM o1 WHERE variable = 'precipitation') SELECT {_KEYS}, CAST(CAST(lt AS DATE) + CASE WHEN hour(lt) >= 9 THEN 1 ELSE 0 END AS DATE) AS day FROM l")
def rain_day(spark, sf):
    return views.obs(spark, sf).where("variable = 'precipitation'").withColumn("day", aggregate.local_day(F.col("variable"), F.col("datetime_utc"), "Australia/Sydney")).select(*OBS_KEY, "day")


def _interp_sql(x: str, name: str) -> str:
    """A line by row number; ends are held."""
    return f"""SELECT *, coalesce(x, px + (i - pi) / nullif(ni - pi, 0) * (nx - px), px, nx) AS {name} FROM (SELECT *, last_value(x IGNORE NULLS) OVER b AS px, last_value(xi IGNORE NULLS) OVER b AS pi, first_value(x IGNORE NULLS) OVER a AS nx, first_value(xi IGNORE NULLS) OVER a AS ni
  FROM (SELECT *, CASE WHEN x IS NOT NULL THEN i END AS xi FROM (SELECT *, {x} AS x, row_number() OVER ({_SERIES}) AS i FROM o1)) WINDOW b AS ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {OBS1_SQL} SELECT {_KEYS}, round(filled + 1e-9, 4) + 0.0 AS filled FROM ({_interp_sql('value', 'filled')}) WHERE variable = 'temperature_2m'")
def fill_linear(spark, sf):
    return fill.fill_linear(views.obs(spark, sf).where("variable = 'temperature_2m'")).select(*OBS_KEY, r("filled", 4))


@query(f"""WITH {OBS1_SQL}, s AS ({_interp_sql('sin(radians(value))', 's')}), c AS ({_interp_sql('cos(radians(value))', 'c')})
  SELECT s.site_id, s.datetime_utc, s.variable, s.source, round(coalesce(s.value, (degrees(atan2(s.s, c.c)) + 360) % 360) + 1e-9, 3) + 0.0 AS filled FROM s JOIN c ON s.site_id = c.site_id AND s.datetime_utc = c.datetime_utc AND s.variable = c.variable AND s.source = c.source WHERE s.variable = 'wind_direction_10m'""")
def fill_circular(spark, sf):
    return fill.fill_circular(views.obs(spark, sf).where("variable = 'wind_direction_10m'")).select(*OBS_KEY, r("filled", 3))


@query(f"""WITH {OBS1_SQL}, n AS (SELECT *, last_value(value IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, first_value(value IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rt FROM o1 WHERE variable = 'precipitation')
  SELECT {_KEYS}, round(coalesce(value, CASE WHEN l = 0 AND rt = 0 THEN 0.0 END, l, rt, 0.0) + 1e-9, 4) + 0.0 AS filled FROM n""")
def fill_rain(spark, sf):
    return fill.fill_rain(views.obs(spark, sf).where("variable = 'precipitation'")).select(*OBS_KEY, r("filled", 4))


@query(f"""WITH {OBS1_SQL}, s AS (SELECT *, CASE WHEN value IS NULL AND NOT coalesce(lag(value IS NULL) OVER ({_SERIES}), false) THEN 1 ELSE 0 END AS st FROM o1), g AS (SELECT *, sum(st) OVER ({_SERIES} ROWS UNBOUNDED PRECEDING) AS g FROM s)
  SELECT {_KEYS}, CAST(g AS BIGINT) AS gap_id, round((epoch_us(max(datetime_utc) OVER p) - epoch_us(min(datetime_utc) OVER p)) / 3.6e9 + 1e-9, 5) AS span_hours FROM g WHERE value IS NULL WINDOW p AS (PARTITION BY site_id, source, variable, g)""")
def gap_runs(spark, sf):
    return fill.gap_runs(views.obs(spark, sf)).where("gap_id is not null").select(*OBS_KEY, F.col("gap_id").cast("long").alias("gap_id"), r("span_hours"))


_DONOR = ", o AS (SELECT * FROM o1 WHERE site_id = 'site_0' AND variable <> 'wind_direction_10m'), hr AS (SELECT site_id, date_trunc('hour', datetime_utc) AS hour, variable, avg(value) AS value FROM o1 WHERE site_id IN ('site_0', 'site_1') AND variable <> 'wind_direction_10m' GROUP BY ALL), g AS (SELECT * FROM hr WHERE site_id = 'site_0'), d AS (SELECT * FROM hr WHERE site_id = 'site_1' AND value IS NOT NULL)"


def _gappy(spark, sf, site: str, source: str) -> DataFrame:
    """Hourly means of a site; hours of nulls alone are gaps."""
    o = views.obs(spark, sf).where((F.col("site_id") == site) & (F.col("variable") != "wind_direction_10m"))
    h = o.groupBy("site_id", F.date_trunc("hour", "datetime_utc").alias("datetime_utc"), "variable").agg(F.avg("value").alias("value"))
    return h.withColumns({"source": F.lit(source), "method": F.lit("measured"), "qc_flag": F.when(F.col("value").isNull(), "missing").otherwise("ok")}).select(*OBS.names)


@query(f"""WITH {OBS1_SQL}{_DONOR}, off AS (SELECT g.variable, avg(d.value) - avg(g.value) AS o FROM g JOIN d ON g.variable = d.variable AND g.hour = d.hour WHERE g.value IS NOT NULL GROUP BY g.variable)
  SELECT g.site_id, g.hour AS datetime_utc, g.variable, round(coalesce(g.value, d.value - coalesce(off.o, 0)) + 1e-9, 4) + 0.0 AS value, CASE WHEN g.value IS NULL AND d.value IS NOT NULL THEN 'donor' ELSE 'own' END AS source, CASE WHEN g.value IS NULL AND d.value IS NOT NULL THEN 'donor_fill' ELSE 'measured' END AS method
  FROM g LEFT JOIN d ON g.variable = d.variable AND g.hour = d.hour LEFT JOIN off ON g.variable = off.variable""")
def fill_donor_mean_bias(spark, sf):
    return fill.fill_medium(_gappy(spark, sf, "site_0", "own"), _gappy(spark, sf, "site_1", "donor")).select("site_id", "datetime_utc", "variable", r("value", 4), "source", "method")


@query(f"WITH {OBS1_SQL}{_DONOR} SELECT g.site_id, g.hour AS datetime_utc, g.variable, round(coalesce(g.value, d.value) + 1e-9, 4) + 0.0 AS value, CASE WHEN g.value IS NULL AND d.value IS NOT NULL THEN 'model_fill' ELSE 'measured' END AS method FROM g LEFT JOIN d ON g.variable = d.variable AND g.hour = d.hour")
def fill_macro(spark, sf):
    return fill.fill_macro(_gappy(spark, sf, "site_0", "own"), _gappy(spark, sf, "site_1", "model")).select("site_id", "datetime_utc", "variable", r("value", 4), "method")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN greatest(0, least(100, 100 * exp(17.625 * (l_tax * 100) / (243.04 + l_tax * 100)) / exp(17.625 * (l_quantity - 10) / (243.04 + l_quantity - 10)))) ELSE l_discount * 1000 END + 1e-9, 4) + 0.0 AS value,
  CASE WHEN l_linenumber % 2 = 0 THEN 'derived' ELSE 'measured' END AS method FROM lineitem""")
def fill_derive_rh(spark, sf):
    l = t(spark, sf, "lineitem")
    gap = F.col("l_linenumber") % 2 == 0
    cells = F.array(
        F.struct(F.lit("temperature_2m").alias("variable"), (F.col("l_quantity") - 10).alias("value")), F.struct(F.lit("dewpoint_2m").alias("variable"), (F.col("l_tax") * 100).alias("value")),
        F.struct(F.lit("relative_humidity_2m").alias("variable"), F.when(~gap, F.col("l_discount") * 1000).alias("value")),
    )
    o = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("site_id"), F.col("l_shipdate").cast("timestamp").alias("datetime_utc"), F.explode(cells).alias("c"), "l_orderkey", "l_linenumber").select("site_id", "datetime_utc", "c.variable", "c.value", F.lit("s").alias("source"), F.lit("measured").alias("method"), F.when(F.col("c.value").isNull(), "missing").otherwise("ok").alias("qc_flag"), "l_orderkey", "l_linenumber")
    return fill.fill_derive(o).where("variable = 'relative_humidity_2m'").select("l_orderkey", "l_linenumber", r("value", 4), "method")


@query()
def fill_tier(spark, sf):
    return fill.fill_tier(_gappy(spark, sf, "site_0", "own"), _gappy(spark, sf, "site_1", "donor"), _gappy(spark, sf, "site_2", "model")).withColumn("value", r("value", 4))


def _pairs(spark, sf) -> DataFrame:
    return views.fc(spark, sf).select("source", "forecast", "observation", "issue_time", "valid_time", "l_orderkey", "l_linenumber")


_PROBS = "[" + ", ".join(str(k / 100) for k in range(101)) + "]"
_GRID = f"{FC_SQL}, grids AS (SELECT source, quantile_cont(forecast, {_PROBS}) AS xs, quantile_cont(observation, {_PROBS}) AS ys FROM fc GROUP BY source), knots AS (SELECT source, k, xs[k + 1] AS x, ys[k + 1] AS y FROM grids, range(0, 101) q(k))"


@query(f"WITH {_GRID} SELECT source, CAST(k AS INTEGER) AS k, round(x + 1e-9, 4) + 0.0 AS x, round(y + 1e-9, 4) + 0.0 AS y FROM knots")
def fit_qmap(spark, sf):
    c = transfer.fit_qmap(_pairs(spark, sf), ("source",))
    return c.select("source", F.posexplode(F.arrays_zip("source_quantiles", "target_quantiles")).alias("k", "q")).select("source", "k", r(F.col("q.source_quantiles"), 4).alias("x"), r(F.col("q.target_quantiles"), 4).alias("y"))


@query(f"""WITH {_GRID}, seg AS (SELECT source, k, x AS x0, y AS y0, lead(x) OVER (PARTITION BY source ORDER BY k) AS x1, lead(y) OVER (PARTITION BY source ORDER BY k) AS y1 FROM knots)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN x1 IS NULL THEN y0 WHEN x1 = x0 THEN y0 ELSE y0 + (forecast - x0) / (x1 - x0) * (y1 - y0) END + 1e-9, 3) + 0.0 AS corrected FROM fc JOIN seg ON fc.source = seg.source AND forecast >= x0 AND (x1 IS NULL OR forecast < x1)""")
def apply_qmap(spark, sf):
    p = _pairs(spark, sf)
    return transfer.apply_qmap(transfer.fit_qmap(p, ("source",)), p, ("source",)).select("l_orderkey", "l_linenumber", r("corrected", 3))


_SERIES_SQL = f"{FC_SQL}, d AS (SELECT min(forecast) AS f, min(observation) AS o FROM fc GROUP BY valid_time)"


@query(f"WITH {_SERIES_SQL}, o AS (SELECT avg(f) - avg(o) AS d FROM d) SELECT l_orderkey, l_linenumber, round(forecast - d + 1e-9, 4) + 0.0 AS corrected FROM fc, o")
def transfer_mean_bias(spark, sf):
    p = _pairs(spark, sf)
    return transfer.apply_transfer(_transfer(p, "mean_bias"), p.withColumn("value", F.col("forecast")), "corrected").select("l_orderkey", "l_linenumber", r("corrected", 4))


def _transfer(p: DataFrame, method: str) -> dict:
    """Forecasts and observations as two series, at each valid time the lowest of each."""
    series = lambda c: p.select(F.col("valid_time").alias("datetime_utc"), F.lit("s").alias("source"), F.col(c).alias("value"))
    return transfer.fit_transfer(series("forecast"), series("observation"), method)


@query(f"""WITH {_SERIES_SQL}, g AS (SELECT quantile_cont(f, {_PROBS}) AS xs, quantile_cont(o, {_PROBS}) AS ys FROM d), knots AS (SELECT k, xs[k + 1] AS x0, ys[k + 1] AS y0, xs[k + 2] AS x1, ys[k + 2] AS y1 FROM g, range(0, 101) q(k))
  SELECT l_orderkey, l_linenumber, round(CASE WHEN x1 IS NULL OR x1 = x0 OR forecast < x0 THEN y0 ELSE y0 + (forecast - x0) / (x1 - x0) * (y1 - y0) END + 1e-9, 3) + 0.0 AS corrected FROM fc JOIN (SELECT CASE WHEN k = 0 THEN -1e300 ELSE x0 END AS low, * FROM knots) ON forecast >= low AND (x1 IS NULL OR forecast < x1)""")
def transfer_qmap(spark, sf):
    p = _pairs(spark, sf)
    return transfer.apply_transfer(_transfer(p, "qmap"), p.withColumn("value", F.col("forecast")), "corrected").select("l_orderkey", "l_linenumber", r("corrected", 3))


@query(f"WITH {FC_SQL}, m AS (SELECT source, regr_slope(observation, forecast) AS b, regr_intercept(observation, forecast) AS a, var_pop(observation) AS vo, covar_pop(observation, forecast) AS cv FROM fc GROUP BY source) SELECT l_orderkey, l_linenumber, round(a + b * forecast + 1e-9, 4) + 0.0 AS mean, round(greatest(sqrt(greatest(vo - b * cv, 0)), 0.001) + 1e-9, 4) AS sd FROM fc JOIN m ON fc.source = m.source")
def emos_apply(spark, sf):
    p = _pairs(spark, sf)
    return correct.apply_emos(correct.fit_emos(p, ("source",)), p, ("source",)).select("l_orderkey", "l_linenumber", r("mean", 4), r("sd", 4))


@query("""WITH w AS (SELECT p_partkey, (p_partkey * 37) % 360 AS d, p_size / 2 AS s, (p_partkey % 7) - 3 AS bu, (p_partkey % 5) - 2 AS bv FROM part), c AS (SELECT *, -s * sin(radians(d)) AS u, -s * cos(radians(d)) AS v, CASE WHEN sqrt(bu * bu + bv * bv) > 1e-9 THEN atan2(-bu, -bv) ELSE 0 END AS a FROM w),
  e AS (SELECT p_partkey, u * cos(a) - v * sin(a) AS x, u * sin(a) + v * cos(a) AS y FROM c) SELECT p_partkey, round(abs((degrees(atan2(-x, -y)) + 720) % 360 - 180) + 1e-9, 4) AS off_south FROM e""")
def wind_direction_corrected(spark, sf):
    k = F.col("p_partkey")
    d = physics.correct_wind_direction((k * 37 % 360).cast("double"), F.col("p_size") / 2, (k % 7 - 3).cast("double"), (k % 5 - 2).cast("double"))
    return t(spark, sf, "part").select("p_partkey", r(F.abs(d - 180), 4).alias("off_south"))


@query("""WITH w AS (SELECT p_partkey, p_size * 1.0 AS s, [80, 120, 180][CAST(p_partkey % 3 + 1 AS INTEGER)] AS h, p_size * 0.8 AS c10, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_partkey % 11 END AS r10 FROM part)
  SELECT p_partkey, round(CASE WHEN r10 = 0 THEN s ELSE s * greatest(1.0 / 3, least(3, 1 + (c10 / r10 - 1) * (10.0 / h))) END + 1e-9, 5) AS speed, 'experimental' AS tier FROM w""")
def model_only_rescaled(spark, sf):
    k, site = F.col("p_partkey"), F.col("p_partkey").cast("string").alias("site_id")
    time = F.lit("2026-01-01").cast("timestamp").alias("datetime_utc")
    p = t(spark, sf, "part")
    o = p.select(site, time, F.concat(F.lit("wind_speed_"), F.get(F.array(*map(F.lit, (80, 120, 180))), (k % 3).cast("int")), F.lit("m")).alias("variable"), F.col("p_size").cast("double").alias("value"))
    ten = p.select(site, time, (F.col("p_size") * 0.8).alias("corrected"), F.when(k % 4 == 0, 0.0).otherwise((k % 11).cast("double")).alias("raw"))
    return correct.model_only_correct(o, ten).select(F.col("site_id").cast("long").alias("p_partkey"), r("value").alias("speed"), "tier")


@query("""WITH w AS (SELECT o_orderkey, unnest(['temperature_2m', 'dewpoint_2m', 'relative_humidity_2m', 'wind_speed_10m', 'wind_gusts_10m']) AS variable, o_custkey % 40 - 10 AS tt, o_orderkey % 50 - 15 AS td, o_orderkey % 130 AS rh, o_custkey % 20 AS ws, o_orderkey % 30 AS wg FROM orders)
  SELECT o_orderkey, variable, CAST(CASE variable WHEN 'temperature_2m' THEN tt WHEN 'dewpoint_2m' THEN least(td, tt) WHEN 'relative_humidity_2m' THEN least(rh, 100) WHEN 'wind_speed_10m' THEN ws ELSE greatest(wg, ws) END AS DOUBLE) AS value FROM w""")
def consistency_long(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {"temperature_2m": c % 40 - 10, "dewpoint_2m": k % 50 - 15, "relative_humidity_2m": k % 130, "wind_speed_10m": c % 20, "wind_gusts_10m": k % 30}
    wide = t(spark, sf, "orders").select("o_orderkey", *[x.cast("double").alias(n) for n, x in values.items()])
    return qc.consistency_pass_long(wide.unpivot(["o_orderkey"], list(values), "variable", "value"), ["o_orderkey"]).select("o_orderkey", "variable", "value")


# bitemporal store
_STORED = """cur AS (SELECT 'site_' || CAST(o_custkey % 4 AS VARCHAR) AS site_id, CAST(o_orderkey AS VARCHAR) AS variable, o_totalprice AS value FROM orders WHERE o_orderkey % 5 <> 0),
  inc AS (SELECT 'site_' || CAST(o_custkey % 4 AS VARCHAR) AS site_id, CAST(o_orderkey AS VARCHAR) AS variable, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 2 = 0)"""


def _ingests(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = t(spark, sf, "orders")
    key = F.col("o_orderkey")
    base = o.select(F.concat(F.lit("site_"), (F.col("o_custkey") % 4).cast("string")).alias("site_id"), F.col("o_orderdate").cast("timestamp").alias("datetime_utc"), key.cast("string").alias("variable"), "o_totalprice", key.alias("k"), F.lit("s").alias("source"), F.lit("measured").alias("method"), F.lit("ok").alias("qc_flag"))
    cur = base.where("k % 5 <> 0").withColumn("value", F.col("o_totalprice")).select(*OBS.names, F.lit("2020-01-01").cast("timestamp").alias("ingested_at"), F.lit(False).alias("superseded"))
    inc = base.where("k % 2 = 0").withColumn("value", F.when(F.col("k") % 3 == 0, F.col("o_totalprice") + 1).when(F.col("k") % 7 == 0, None).otherwise(F.col("o_totalprice"))).select(*OBS.names)
    return cur, inc


@query(f"""WITH {_STORED}, j AS (SELECT coalesce(c.site_id, i.site_id) AS site_id, coalesce(c.variable, i.variable) AS variable, c.value AS cv, i.value AS iv, c.site_id IS NOT NULL AS hc, i.site_id IS NOT NULL AS hi FROM cur c FULL JOIN inc i ON c.site_id = i.site_id AND c.variable = i.variable)
  SELECT site_id, variable, round(cv + 1e-9, 2) AS value, (hi AND cv IS DISTINCT FROM iv) AS superseded, CASE WHEN NOT hi THEN 'kept' WHEN cv IS DISTINCT FROM iv THEN 'superseded' ELSE 'unchanged' END AS action FROM j WHERE hc
  UNION ALL SELECT site_id, variable, round(iv + 1e-9, 2), false, 'new' FROM j WHERE hi AND (NOT hc OR cv IS DISTINCT FROM iv)""")
def supersede_merge(spark, sf):
    cur, inc = _ingests(spark, sf)
    return store.supersede(cur, inc, F.lit("2020-02-01")).select("site_id", "variable", r("value", 2), "superseded", "action")


@query("""WITH v AS (SELECT 'site_' || CAST(user_id % 4 AS VARCHAR) AS site_id, event_type AS variable, date_trunc('day', CAST(ts AS TIMESTAMP)) AS d, CAST(ts AS TIMESTAMP) AS ing, value FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events))
  SELECT site_id, variable, d AS datetime_utc, round(value + 1e-9, 5) AS value FROM v QUALIFY row_number() OVER (PARTITION BY site_id, variable, d ORDER BY ing DESC, value DESC) = 1""")
def as_of_read(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stored = e.select(F.concat(F.lit("site_"), (F.col("user_id") % 4).cast("string")).alias("site_id"), F.date_trunc("day", "ts").alias("datetime_utc"), F.col("event_type").alias("variable"), "value", F.lit("s").alias("source"), F.lit("measured").alias("method"), F.lit("ok").alias("qc_flag"), F.col("ts").alias("ingested_at"))
    limit = e.agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("limit"))
    known = stored.crossJoin(F.broadcast(limit))  # one row
    return store.as_of(known, F.col("limit")).select("site_id", "variable", "datetime_utc", r("value", 5))


@query(f"WITH {FC_SQL}, k AS (SELECT DISTINCT site_id, source, model, issue_time FROM fc WHERE l_orderkey % 2 = 0) SELECT l_orderkey, l_linenumber, site_id, source, model FROM fc WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.site_id = fc.site_id AND k.source = fc.source AND k.model IS NOT DISTINCT FROM fc.model AND k.issue_time = fc.issue_time)")
def forecast_dedup(spark, sf):
    f = views.fc(spark, sf)
    return store.new_rows(f, f.where("l_orderkey % 2 = 0"), ("site_id", "source", "model", "issue_time")).select("l_orderkey", "l_linenumber", "site_id", "source", "model")


@query("""WITH silo AS (SELECT CAST(o_orderdate AS DATE) AS day, 'precipitation' AS variable, avg(o_totalprice / 1000) AS value FROM orders GROUP BY 1), aws AS (SELECT CAST(l_shipdate AS DATE) AS day, 'precipitation' AS variable, avg(l_quantity) AS value FROM lineitem GROUP BY 1)
  SELECT day, variable, round(value + 1e-9, 4) AS value, 'aws' AS source FROM aws UNION ALL SELECT day, variable, round(value + 1e-9, 4), 'silo' FROM silo WHERE NOT EXISTS (SELECT 1 FROM aws WHERE aws.day = silo.day AND aws.variable = silo.variable)""")
def history_daily_composite(spark, sf):
    silo = t(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg(F.col("o_totalprice") / 1000).alias("value")).select("day", F.lit("precipitation").alias("variable"), "value", F.lit("silo").alias("source"))
    aws = t(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("value")).select("day", F.lit("precipitation").alias("variable"), "value", F.lit("aws").alias("source"))
    return serve.own_or_interpolated(aws, silo).select("day", "variable", r("value", 4), "source")


@query(f"WITH {FC_SQL} SELECT l_orderkey, l_linenumber, site_id, source, model, issue_time FROM fc QUALIFY issue_time = max(issue_time) OVER (PARTITION BY site_id, source, model)")
def latest_issuance(spark, sf):
    return reshape.latest_issuance(views.fc(spark, sf)).select("l_orderkey", "l_linenumber", "site_id", "source", "model", "issue_time")


@query(f"WITH {FC_SQL} SELECT site_id, valid_time, round(avg(value) FILTER (member <> 7) + 1e-9, 4) + 0.0 AS temperature_2m, CAST(NULL AS DOUBLE) AS cape FROM fc GROUP BY site_id, valid_time")
def widen_forecast_mean(spark, sf):
    f = views.fc(spark, sf).withColumn("stat", F.when(F.col("member") == 7, "p10"))
    return reshape.widen_forecast(f, ["temperature_2m", "cape"], ("site_id",)).select("site_id", "valid_time", r("temperature_2m", 4), "cape")


@query(f"WITH {FC_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'dNA' ELSE 'd' || CAST(CAST(greatest(1, ceil((epoch_us(valid_time) - epoch_us(issue_time)) / 3.6e9 / 24)) AS BIGINT) AS VARCHAR) END AS lead_bucket FROM fc")
def lead_bucket(spark, sf):
    from cirro.schema import hours

    lead = F.when(F.col("l_linenumber") != 7, hours("valid_time") - hours("issue_time"))
    return views.fc(spark, sf).select("l_orderkey", "l_linenumber", reshape.lead_bucket(lead).alias("lead_bucket"))


@query(f"""WITH {FC_SQL}, truth AS (SELECT 'site_' || CAST(o_custkey % 4 AS VARCHAR) AS site_id, CAST(o_orderdate AS TIMESTAMP) AS valid_time, arg_min(o_totalprice / 5000, o_orderkey) AS observation FROM orders GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, fc.site_id, fc.source, round(fc.value + 1e-9, 4) AS forecast, round(truth.observation + 1e-9, 4) AS observation FROM fc JOIN truth ON fc.site_id = truth.site_id AND fc.valid_time = truth.valid_time WHERE l_linenumber <= 4""")
def verification_pairs(spark, sf):
    from cirro.schema import LEAD

    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    f = views.fc(spark, sf).drop("forecast", "observation").withColumns({"member": F.when(F.col("l_linenumber") > 4, F.col("member")), "stat": F.lit(None).cast("string"), "lead_time": F.lit(None).cast(LEAD), "model": key})
    o = t(spark, sf, "orders").select(F.concat(F.lit("site_"), (F.col("o_custkey") % 4).cast("string")).alias("site_id"), F.col("o_orderdate").cast("timestamp").alias("datetime_utc"), F.lit("temperature_2m").alias("variable"), (F.col("o_totalprice") / 5000).alias("value"), F.col("o_orderkey").alias("source"), F.lit("ok").alias("qc_flag"))
    p = verify.verification_pairs(f, o)
    return p.select(F.split("model", "-")[0].cast("long").alias("l_orderkey"), F.split("model", "-")[1].cast("int").alias("l_linenumber"), "site_id", "source", r("forecast", 4), r("observation", 4))


@query(f"WITH {FC_SQL} SELECT site_id, source, CAST(count(*) AS INTEGER) AS n_pairs, round(avg(abs(forecast - observation)) + 1e-9, 5) AS mae, round(sqrt(avg(pow(forecast - observation, 2))) + 1e-9, 5) AS rmse FROM fc GROUP BY site_id, source")
def mae_rmse(spark, sf):
    s = verify.score(views.fc(spark, sf), ("site_id", "source"))
    return s.select("site_id", "source", "n_pairs", r("mae"), r("rmse"))


@query(f"WITH {FC_SQL}, s AS (SELECT site_id, sqrt(avg(pow(forecast - observation, 2))) AS a, sqrt(avg(pow(value - observation, 2))) AS b FROM fc GROUP BY site_id) SELECT site_id, round(1 - a / b + 1e-9, 5) + 0.0 AS skill FROM s")
def skill_score(spark, sf):
    s = views.fc(spark, sf).groupBy("site_id").agg(verify.rmse(F.col("forecast"), F.col("observation")).alias("a"), verify.rmse(F.col("value"), F.col("observation")).alias("b"))
    return s.select("site_id", r(physics.skill_score(F.col("a"), F.col("b"))).alias("skill"))


@query(f"WITH {FC_SQL}, d AS (SELECT site_id, source, valid_time, avg(observation) AS observation FROM fc GROUP BY ALL) SELECT site_id, source, valid_time, round(observation + 1e-9, 4) + 0.0 AS observation, round(lag(observation) OVER (PARTITION BY site_id, source ORDER BY valid_time) + 1e-9, 4) + 0.0 AS persistence FROM d")
def baseline_persistence(spark, sf):
    d = views.fc(spark, sf).groupBy("site_id", "source", "valid_time").agg(F.avg("observation").alias("observation")).withColumn("issue_time", F.col("valid_time"))
    return verify.persistence(d, ("site_id", "source")).select("site_id", "source", "valid_time", r("observation", 4), r("persistence", 4))


@query("""WITH s AS (SELECT dayofyear(o_orderdate) AS d, count(*) AS n, sum(o_totalprice / 1000) AS s, sum(pow(o_totalprice / 1000, 2)) AS ss FROM orders GROUP BY 1), e AS (SELECT (d - 1 + k + 366) % 366 + 1 AS doy, n, s, ss FROM s, range(-7, 8) r(k))
  SELECT CAST(doy AS INTEGER) AS doy, round(sum(s) / sum(n) + 1e-9, 4) AS mean, round(sqrt((sum(ss) - sum(n) * pow(sum(s) / sum(n), 2)) / (sum(n) - 1)) + 1e-9, 3) AS sd, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY doy""")
def baseline_climatology(spark, sf):
    h = t(spark, sf, "orders").select(F.lit("x").alias("variable"), F.col("o_orderdate").cast("timestamp").alias("datetime_utc"), (F.col("o_totalprice") / 1000).alias("value"))
    return verify.climatology(h).select("doy", r("mean", 4), r("sd", 3), "n")


@query(f"WITH {FC_SQL}, m AS (SELECT source, regr_slope(observation, forecast) AS b, regr_intercept(observation, forecast) AS a, var_pop(observation) AS vo, covar_pop(observation, forecast) AS cv, count(*) AS n FROM fc GROUP BY source) SELECT source, round(a + 1e-9, 4) + 0.0 AS intercept, round(b + 1e-9, 5) + 0.0 AS slope, round(ln(greatest(sqrt(greatest(vo - b * cv, 0)), 0.001)) + 1e-9, 4) + 0.0 AS log_sd, n AS n_pairs FROM m")
def emos_fit(spark, sf):
    f = correct.fit_emos(_pairs(spark, sf), ("source",))
    return f.select("source", r("intercept", 4), r("slope"), r("log_sd", 4), "n_pairs")


@query()
def mean_bias_fit(spark, sf):
    c = correct.fit_mean_bias(_pairs(spark, sf), ("source",))
    return c.select("source", *[F.round(F.col(f"`{n}`"), 6).alias(n.strip("()")) for n in c.columns if n != "source"])


@query()
def mean_bias_apply(spark, sf):
    p = _pairs(spark, sf)
    return correct.apply_mean_bias(correct.fit_mean_bias(p, ("source",)), p, ("source",)).select("l_orderkey", "l_linenumber", r("corrected", 4))


# ensembles
def _cases(spark, sf) -> DataFrame:
    e = t(spark, sf, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("members"), (F.col("label") / 10.0 - 0.5).alias("truth"))


_CASES = "c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS members, label / 10.0 - 0.5 AS truth FROM embeddings)"


@query(f"WITH {_CASES} SELECT CAST(1 + len(list_filter(members, lambda x: x < truth)) AS INTEGER) AS rank, count(*) AS n FROM c GROUP BY 1")
def rank_histogram(spark, sf):
    return verify.rank_histogram(_cases(spark, sf))


@query(f"WITH {_CASES}, h AS (SELECT 1 + len(list_filter(members, lambda x: x < truth)) AS rank, count(*) AS n, max(len(members)) AS m FROM c GROUP BY 1), b AS (SELECT max(m) + 1 AS bins, sum(n) / (max(m) + 1) AS mean FROM h) SELECT round((sum(n * n) - max(bins) * max(mean) * max(mean)) / max(mean) + 1e-9, 3) AS histogram_flatness FROM h, b")
def histogram_flatness(spark, sf):
    c = _cases(spark, sf)
    members = c.agg(F.max(F.size("members"))).first()[0] or 0
    return verify.histogram_flatness(verify.rank_histogram(c), members).select(r("histogram_flatness", 3))


@query(f"WITH {_CASES}, p AS (SELECT list_avg(members) AS m, list_var_samp(members) AS v, truth, len(members) AS k FROM c) SELECT round(sqrt((1 + 1 / max(k)) * avg(v)) / sqrt(avg(pow(m - truth, 2))) + 1e-9, 4) AS spread_error_ratio FROM p")
def spread_error_ratio(spark, sf):
    return verify.spread_error_ratio(_cases(spark, sf)).select(r("spread_error_ratio", 4))


@query("SELECT l_returnflag, round(avg(pow(l_discount * 10 - CAST(l_tax > 0.04 AS DOUBLE), 2)) + 1e-9, 5) AS brier FROM lineitem GROUP BY l_returnflag")
def brier(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(verify.brier(F.col("l_discount") * 10, F.col("l_tax") > 0.04)).alias("brier"))


@query("WITH g AS (SELECT greatest(1, CAST(ceil((l_linenumber / 8) * 5) AS INTEGER)) AS bin, avg(l_linenumber / 8) AS mean_probability, avg(CAST(l_tax > 0.04 AS DOUBLE)) AS observed_frequency, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, round(mean_probability + 1e-9, 5) AS mean_probability, round(observed_frequency + 1e-9, 5) AS observed_frequency, coalesce(n, 0) AS n FROM range(1, 6) r(b) LEFT JOIN g ON bin = b")
def reliability(spark, sf):
    d = t(spark, sf, "lineitem").select((F.col("l_linenumber") / 8).alias("p"), (F.col("l_tax") > 0.04).alias("o"))
    return verify.reliability_table(d, "p", "o").select("bin", r("mean_probability"), r("observed_frequency"), "n")


@query("SELECT CAST(l_linenumber AS INTEGER) AS member, round(sum(l_quantity) + 1e-9, 2) AS total FROM lineitem GROUP BY 1")
def cumulative_by_member(spark, sf):
    return verify.cumulative_by_member(t(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("member"), F.col("l_quantity").alias("value"))).withColumn("total", r("total", 2))


@query()
def crps(spark, sf):
    s = verify.crps_gaussian(F.col("observation"), F.col("forecast"), F.lit(2.0))
    return views.fc(spark, sf).select("l_orderkey", "l_linenumber", r(s, 5).alias("crps"))


@query("""WITH d AS (SELECT o_orderpriority AS source, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS day, o_totalprice / 1000 AS f, o_totalprice / 1100 + o_custkey % 10 AS o FROM orders), b AS (SELECT *, min(day) OVER (PARTITION BY source) AS d0 FROM d), w AS (SELECT *, d0 + CAST(floor((day - d0) / 30) AS BIGINT) * 30 AS origin FROM b),
  fit AS (SELECT g.source, g.origin, avg(b.o - b.f) AS off FROM (SELECT DISTINCT source, origin FROM w) g JOIN b ON b.source = g.source AND b.day < g.origin - 1 GROUP BY 1, 2)
  SELECT w.source, round(avg(abs(f + off - o)) + 1e-9, 4) AS mae, round(sqrt(avg(pow(f + off - o, 2))) + 1e-9, 4) AS rmse, count(*) AS n_scored FROM w JOIN fit ON w.source = fit.source AND w.origin = fit.origin GROUP BY 1""")
def rolling_origin_mean_bias(spark, sf):
    p = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("timestamp").alias("valid_time"), (F.col("o_totalprice") / 1000).alias("forecast"), (F.col("o_totalprice") / 1100 + F.col("o_custkey") % 10).alias("observation"))
    return verify.rolling_origin_offset(p, ("source",)).select("source", r("mae", 4), r("rmse", 4), "n_scored")


@query()
def block_bootstrap(spark, sf):
    d = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 1000 - 100).alias("x"))
    return verify.bootstrap_by(d, "x", ("priority",), "day").select("priority", r("mean"), r("low"), r("high"), "significant")


@query("""WITH s AS (SELECT n_nationkey, (n_nationkey % 13) * 2.5 AS months, n_nationkey * 30 AS n, n_nationkey % 3 <> 0 AS arch, CASE WHEN n_nationkey % 4 = 0 THEN 'history_daily' ELSE 'observed' END AS truth, n_nationkey % 2 = 0 AS promote FROM nation),
  k AS (SELECT *, CASE WHEN truth = 'history_daily' AND n >= 365 AND arch THEN 5 WHEN months >= 24 AND arch THEN 5 WHEN months >= 6 THEN 4 WHEN months >= 1 THEN 3 ELSE 2 END AS rk FROM s)
  SELECT n_nationkey, ['raw', 'physical', 'mean_bias', 'qmap', 'emos'][CASE WHEN promote THEN rk ELSE greatest(rk - 1, 1) END] AS tier FROM k""")
def tier_select(spark, sf):
    k = F.col("n_nationkey")
    tier = correct.select_tier((k % 13) * 2.5, k * 30, k % 3 != 0, F.when(k % 4 == 0, "history_daily").otherwise("observed"), k % 2 == 0)
    return t(spark, sf, "nation").select("n_nationkey", tier.alias("tier"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS variable, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'd1' END AS lead_bucket, coalesce(1.0 * (n_nationkey % 5) < 2.0 AND n_nationkey % 2 = 0, false) AS promote, CASE WHEN n_nationkey % 7 <> 0 THEN round(greatest(0, least(1, 1 - (n_nationkey % 5) / (n_nationkey % 7))) + 1e-9, 5) + 0.0 END AS shrink_weight FROM nation""")
def skill_verdict(spark, sf):
    k = F.col("n_nationkey")
    key = [k.cast("string").alias("variable"), F.when(k % 3 != 0, "d1").alias("lead_bucket")]
    n = t(spark, sf, "nation")
    s = n.select(*key, (k % 5).cast("double").alias("candidate"), F.lit(2.0).alias("incumbent"), (k % 7).cast("double").alias("climatology"))
    return verify.skill_verdict(s, n.select(*key, (k % 2 == 0).alias("significant"))).select("variable", "lead_bucket", "promote", r("shrink_weight"))


@query("""WITH p AS (SELECT CAST(n_regionkey AS VARCHAR) AS site_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'd1' END AS lead_bucket, CAST(n_nationkey AS VARCHAR) AS variable, n_nationkey FROM nation)
  SELECT site_id, variable, lead_bucket, tier, round(CASE WHEN n_nationkey % 5 = 0 THEN CASE WHEN tier = 'qmap' THEN 1.0 ELSE 0.0 END ELSE greatest(0, least(1, 1 - CASE WHEN tier = 'qmap' THEN n_nationkey / 10 ELSE n_nationkey / 5 END / (n_nationkey % 5))) END + 1e-9, 5) + 0.0 AS weight FROM p, (VALUES ('qmap'), ('raw')) v(tier)""")
def serve_shrink_weight(spark, sf):
    k = F.col("n_nationkey")
    rows = F.array(*[F.struct(F.lit(n).alias("tier"), x.cast("double").alias("rmse")) for n, x in (("qmap", k / 10), ("raw", k / 5), ("climatology", F.when(k % 5 != 0, k % 5)))])
    rep = t(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("site_id"), F.lit("s").alias("source"), k.cast("string").alias("variable"), F.when(k % 4 != 0, "d1").alias("lead_bucket"), F.explode(rows).alias("x")).select("site_id", "source", "variable", "lead_bucket", "x.*")
    return correct.serve_weight(rep).select("site_id", "variable", "lead_bucket", "tier", r("weight"))


@query("SELECT p_partkey, round(p_size / 50 * p_retailprice + (1 - p_size / 50) * 1000 + 1e-9, 4) + 0.0 AS shrunk FROM part")
def shrink(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r(physics.shrink(F.col("p_retailprice"), F.lit(1000.0), F.col("p_size") / 50), 4).alias("shrunk"))


# stations and donors
_HAV = "2 * 6371 * asin(least(1, sqrt(pow(sin(radians(latitude + 34.75) / 2), 2) + cos(radians(-34.75)) * cos(radians(latitude)) * pow(sin(radians(longitude - 148.2) / 2), 2))))"


@query(f"WITH {STATIONS_SQL}, d AS (SELECT *, {_HAV} AS km FROM st) SELECT station_id, identity, round(km + 1e-9, 3) AS distance_km FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY coalesce(identity, 'x' || station_id) ORDER BY km, station_id) = 1) ORDER BY km, station_id LIMIT 10")
def nearest_stations(spark, sf):
    return stations.nearest_stations(views.stations(spark, sf), -34.75, 148.2, 10).select("station_id", "identity", r("distance_km", 3))


_PRIO = "CASE source WHEN 'bom_obs' THEN 1 WHEN 'ghcnh' THEN 2 WHEN 'openmeteo' THEN 3 WHEN 'silo' THEN 4 ELSE 5 END"


@query(f"""WITH d AS (SELECT CAST(s_nationkey AS VARCHAR) AS site_id, ['bom_obs', 'ghcnh', 'openmeteo', 'silo', 'own'][CAST(s_suppkey % 5 + 1 AS INTEGER)] || CASE WHEN s_suppkey % 5 = 4 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS source, CAST(s_suppkey AS VARCHAR) AS nr, CAST(s_suppkey % 3 AS VARCHAR) AS identity, s_suppkey * 13 % 101 + s_suppkey / 1000 AS distance_km FROM supplier),
  o AS (SELECT *, {_PRIO} AS priority FROM d QUALIFY row_number() OVER (PARTITION BY site_id, identity ORDER BY distance_km, {_PRIO}, source) = 1) SELECT site_id, nr, source, priority, CAST(row_number() OVER (PARTITION BY site_id ORDER BY priority, distance_km, source) AS INTEGER) AS rank FROM o""")
def rank_donors(spark, sf):
    k = F.col("s_suppkey")
    names = F.array(*map(F.lit, ("bom_obs", "ghcnh", "openmeteo", "silo", "own")))
    d = t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("site_id"), F.concat(F.get(names, (k % 5).cast("int")), F.when(k % 5 == 4, k.cast("string")).otherwise("")).alias("source"), k.cast("string").alias("nr"), (k % 3).cast("string").alias("identity"), (k * 13 % 101 + k / 1000).alias("distance_km"))
    return stations.rank_donors(d, ("site_id",)).select("site_id", "nr", "source", "priority", "rank")


@query(f"WITH {OBS1_SQL}, b AS (SELECT min(date_trunc('day', datetime_utc)) AS lo FROM o1) SELECT variable, round(count(value) / 241 + 1e-9, 6) AS coverage FROM o1, b WHERE datetime_utc BETWEEN lo AND lo + INTERVAL 10 DAY GROUP BY variable")
def station_coverage(spark, sf):
    import datetime as dt

    o = views.obs(spark, sf)
    lo = o.agg(F.date_trunc("day", F.min("datetime_utc"))).first()[0]
    return stations.station_coverage(o, lo, lo + dt.timedelta(days=10)).withColumn("coverage", r("coverage", 6))


@query("""WITH c AS (SELECT p_partkey, ['0','1','2','10','11','15','21','25','26','35','75','76','99'][CAST(p_partkey % 13 + 1 AS INTEGER)] AS code FROM part) SELECT p_partkey, code, CASE WHEN code IN ('0','1','2') THEN 'measured' WHEN code IN ('35','75','76') THEN 'model_fill' WHEN code <> '99' THEN 'imputed' END AS method, CASE WHEN code = '35' THEN 'suspect' WHEN code <> '99' THEN 'ok' END AS qc_flag FROM c""")
def silo_qcode_map(spark, sf):
    codes = F.array(*map(F.lit, [*vendors.SILO_CODES, "99"]))
    d = t(spark, sf, "part").select("p_partkey", F.get(codes, (F.col("p_partkey") % 13).cast("int")).alias("code"))
    method, flag = vendors.silo_code(F.col("code"))
    return d.select("p_partkey", "code", method.alias("method"), flag.alias("qc_flag"))


@query("""WITH sh AS (SELECT k AS hour, (k * 7 % 24) / 10 AS x FROM range(0, 24) r(k)), st AS (SELECT sum(x) AS s, min(x) AS mn, max(x) AS mx, avg(x) AS m FROM sh)
  SELECT CAST(p_partkey AS VARCHAR) AS site_id, 'precipitation' AS variable, timezone('UTC', timezone('Australia/Sydney', TIMESTAMP '2024-03-10')) + hour * INTERVAL 1 HOUR AS datetime_utc, round(x / s * p_size + 1e-9, 5) AS value FROM part, sh, st
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'temperature_2m', timezone('UTC', timezone('Australia/Sydney', TIMESTAMP '2024-03-10')) + hour * INTERVAL 1 HOUR, round(p_size + (x - mn) / (mx - mn) * 10 + 1e-9, 5) FROM part, sh, st""")
def silo_disaggregate(spark, sf):
    size = F.col("p_size").cast("double")
    cells = F.array(*[F.struct(F.lit(n).alias("variable"), v.alias("value")) for n, v in (("precipitation", size), ("temperature_2m_min", size), ("temperature_2m_max", size + 10))])
    daily = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("site_id"), F.lit("2024-03-10").cast("date").alias("day"), F.explode(cells).alias("c")).select("site_id", "day", "c.*")
    shape = spark.range(24).select(F.col("id").cast("int").alias("hour"), (F.col("id") * 7 % 24 / 10).alias("value"))
    return aggregate.disaggregate_daily(daily, shape, "Australia/Sydney").select("site_id", "variable", "datetime_utc", r("value"))


_POINTS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"


@query(f"SELECT p_partkey, {_POINTS}[CAST(round(((p_partkey * 37) % 3600) / 10 / 22.5 + 0.0001) AS INTEGER) % 16 + 1] AS point, (p_partkey % 16) * 22.5 AS angle FROM part")
def compass(spark, sf):
    k = F.col("p_partkey")
    deg = k * 37 % 3600 / 10 + 0.00225
    names = F.array(*map(F.lit, physics.COMPASS))
    return t(spark, sf, "part").select("p_partkey", physics.angle_to_compass(deg).alias("point"), physics.compass_to_angle(F.get(names, (k % 16).cast("int"))).alias("angle"))


@query("""WITH w AS (SELECT p_partkey, (p_partkey * 37) % 360 AS d, p_size / 2 AS s FROM part), c AS (SELECT *, -s * sin(radians(d)) AS u, -s * cos(radians(d)) AS v FROM w) SELECT p_partkey, round(u + 1e-9, 4) + 0.0 AS u, round(v + 1e-9, 4) + 0.0 AS v, round(sqrt(u * u + v * v) + 1e-9, 4) AS speed FROM c""")
def wind_uv(spark, sf):
    d, s = (F.col("p_partkey") * 37 % 360).cast("double"), F.col("p_size") / 2
    u, v = physics.to_u(d, s), physics.to_v(d, s)
    return t(spark, sf, "part").select("p_partkey", r(u, 4).alias("u"), r(v, 4).alias("v"), r(physics.uv_speed(u, v), 4).alias("speed"))


@query("SELECT p_partkey, round((p_size / 2) * ln(10 / 0.03) / ln((2 + p_partkey % 30) / 0.03) + 1e-9, 5) AS speed FROM part")
def height_correct(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r(physics.height_correct(F.col("p_size") / 2, (2 + F.col("p_partkey") % 30).cast("double"), 10.0, 0.03)).alias("speed"))


@query("SELECT p_partkey, round(p_size - 0.0065 * (p_partkey % 500) + 1e-9, 5) + 0.0 AS temperature FROM part")
def lapse(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r(physics.lapse_correct(F.col("p_size").cast("double"), F.col("p_partkey") % 500)).alias("temperature"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 4 = 0 OR p_partkey % 6 = 0 THEN p_size ELSE p_size * greatest(1.0 / 3, least(3, 1 + (p_size / (p_partkey % 6) - 1) * (10.0 / 80))) END + 1e-9, 5) AS speed FROM part")
def profile_rescale(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    return t(spark, sf, "part").select("p_partkey", r(physics.profile_rescale(s, 80.0, s, (k % 6).cast("double"), k % 4 == 0)).alias("speed"))


@query("SELECT p_partkey, round(100 * (1 + 0.1 * p_size) * (1 + 0.02 * greatest(p_partkey % 50 - 10, 0)) + 1e-9, 4) AS blh FROM part")
def diagnostic_blh(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r(physics.boundary_layer_height(F.lit(500.0), F.col("p_size").cast("double"), (F.col("p_partkey") % 50 - 10).cast("double")), 4).alias("blh"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_size + p_partkey % 10 > 0 THEN 500 * p_size / (p_size + p_partkey % 10) ELSE p_size END + 1e-9, 5) AS direct, round(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 10 ELSE 500 * (1 - p_size / (p_size + p_partkey % 10)) END + 1e-9, 5) AS diffuse FROM part")
def radiation_resplit(spark, sf):
    k = F.col("p_partkey")
    a, b = physics.radiation_resplit(F.col("p_size").cast("double"), (k % 10).cast("double"), F.lit(500.0), k % 3 != 0)
    return t(spark, sf, "part").select("p_partkey", r(a).alias("direct"), r(b).alias("diffuse"))


@query("""WITH h AS (SELECT p_partkey, (p_size - 10) * 1.0 AS tt, 5 + p_partkey % 95 AS rh FROM part), d AS (SELECT *, ln(rh / 100) + 17.625 * tt / (243.04 + tt) AS g FROM h), e AS (SELECT *, 243.04 * g / (17.625 - g) AS td FROM d) SELECT p_partkey, round(td + 1e-9, 4) + 0.0 AS dewpoint, round(100 * exp(17.625 * td / (243.04 + td)) / exp(17.625 * tt / (243.04 + tt)) + 1e-9, 3) AS humidity FROM e""")
def humidity(spark, sf):
    temp, rh = (F.col("p_size") - 10) * 1.0, (5 + F.col("p_partkey") % 95).cast("double")
    td = physics.dewpoint(temp, rh)
    return t(spark, sf, "part").select("p_partkey", r(td, 4).alias("dewpoint"), r(physics.relative_humidity(temp, td), 3).alias("humidity"))


# parsing
@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_props(spark, sf):
    return base.at_path(t(spark, sf, "events"), "props", "k").select("event_id", F.col("x").try_cast("long").alias("k"))


@query("WITH n AS (SELECT p_partkey, 'temperature_2m_member' || lpad(CAST(p_partkey % 51 AS VARCHAR), 2, '0') AS name FROM part) SELECT p_partkey, regexp_extract(name, '^(.*)_member([0-9]+)$', 1) AS variable, CAST(regexp_extract(name, '^(.*)_member([0-9]+)$', 2) AS INTEGER) AS member FROM n")
def parse_member_columns(spark, sf):
    name = F.concat(F.lit("temperature_2m_member"), F.lpad((F.col("p_partkey") % 51).cast("string"), 2, "0"))
    variable, member = vendors.member_of(name)
    return t(spark, sf, "part").select("p_partkey", variable.alias("variable"), member.alias("member"))


@query("SELECT p_partkey, round(p_size / 3.6 + 1e-9, 6) AS wind, round(p_size - 273.15 + 1e-9, 4) AS temperature, round(p_size / 0.0864 + 1e-9, 4) AS radiation FROM part")
def unit_conversion(spark, sf):
    x = F.col("p_size").cast("double")
    return t(spark, sf, "part").select("p_partkey", r(registry.to_canonical(x, "km/h", "wind_speed_10m"), 6).alias("wind"), r(registry.to_canonical(x, "K", "temperature_2m"), 4).alias("temperature"), r(registry.to_canonical(x, "MJ/m2/day", "direct_radiation"), 4).alias("radiation"))


def _dictionary_sql() -> str:
    """The built-in variables as they are declared; the query reads them back from the registry's table."""
    text = lambda x: "NULL" if x is None else f"'{x}'"
    number = lambda x: "NULL::DOUBLE" if x is None else f"{float(x)!r}::DOUBLE"
    rows = ", ".join(f"({text(n)}, {text(v.unit)}, {number(v.min)}, {number(v.max)}, {text(v.statistical_class)}, {text(v.measurability_class)})" for n, v in registry.variables().items())
    return f"SELECT * FROM (VALUES {rows}) v(variable, unit, min, max, statistical_class, measurability_class)"


@query(_dictionary_sql())
def dictionary(spark, sf):
    return registry.dictionary(spark).select("variable", "unit", "min", "max", "statistical_class", "measurability_class")


@query(f"WITH {OBSH_SQL}{_hourly_sql('o1')} {_pivot_sql('hourly')}")
def met_wide_record(spark, sf):
    """Every site's observations go through a store of their own and come back as its wide table."""
    s = _stored(spark, sf)
    out = None
    for site in _sites(spark, sf):
        wide = serve.met_wide(s, site, (None, None), "record", VARS, _NOW).df.select(F.lit(site.site_id).alias("site_id"), F.col("time").alias("datetime_utc"), *map(r, VARS))
        out = wide if out is None else out.unionByName(wide)
    return out


@query(f"WITH {OBSH_SQL} SELECT site_id, datetime_utc, variable, source, round(value + 1e-9, 5) + 0.0 AS value, qc_flag FROM o1")
def store_round_trip(spark, sf):
    """Observations written, written again (nothing new), compacted and read back."""
    s = _stored(spark, sf)
    s.write_obs(views.obs(spark, sf, True), _NOW, "supersede", check=False)
    s.compact(["observations"])
    return s.read_obs().select("site_id", "datetime_utc", "variable", "source", r("value"), "qc_flag")


@query(f"WITH {OBSH_SQL}{_hourly_sql('o1')} SELECT site_id, datetime_utc, variable, source, round(value + 1e-9, 5) + 0.0 AS value FROM hourly")
def met_history_hourly(spark, sf):
    return serve.met_history(_stored(spark, sf), sites.Sites(_sites(spark, sf))).select("site_id", "datetime_utc", "variable", "source", r("value"))


@query()
def content_hash(spark, sf):
    from cirro.plans.table import column_hashes

    wide = reshape.widen_obs(aggregate.aggregate_hourly(views.obs(spark, sf, True)), VARS).withColumnRenamed("datetime_utc", "time").drop("site_id")
    return column_hashes(wide)
