"""Parse layers and adapters of public weather services. Bodies come from the driver, rows are made by Spark."""

from __future__ import annotations

import datetime as dt
import json
import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro import registry, schema
from cirro.errors import EngineError
from cirro.functions import physics
from cirro.operators.stations import nearest_stations
from cirro.sites import Site, resolve_secret
from cirro.sources.base import Adapter, adapter, parse_time
from cirro.sources.http import Breaker, Http, Rung, ladder_fetch

# Open-Meteo products: subdomain and path (fixed values).
PRODUCTS = {
    "forecast": ("api", "/v1/forecast"),
    "ensemble": ("ensemble-api", "/v1/ensemble"),
    "historical": ("archive-api", "/v1/archive"),
    "historical_forecast": ("historical-forecast-api", "/v1/forecast"),
    "previous_runs": ("previous-runs-api", "/v1/previous-runs"),
    "single_runs": ("api", "/v1/forecast"),
    "seasonal": ("seasonal-api", "/v1/seasonal"),
}
SPLICE_DAYS = 46
STATS = ("mean", "p10", "p50", "p90")


def _lead(valid: Column, issue: Column) -> Column:
    return (valid - issue).cast("interval day to second")


def _block(spark: SparkSession, body: str, block: str) -> DataFrame:
    """name, time, value, unit of every series in a block of parallel arrays; one pass over the body."""
    df = spark.createDataFrame([(body,)], "body string")
    series = F.from_json(F.get_json_object("body", f"$.{block}"), "map<string,array<string>>")
    units = F.from_json(F.get_json_object("body", f"$.{block}_units"), "map<string,string>")
    d = df.select(F.explode(F.map_entries(series)).alias("e"), F.element_at(series, "time").alias("t"), units.alias("u")).where("e.key <> 'time'")
    z = d.select(F.col("e.key").alias("name"), "u", "t", F.col("e.value").alias("x")).select("name", "u", F.explode(F.arrays_zip("t", "x")).alias("z"))
    return z.select("name", parse_time(F.col("z.t"), "UTC").alias("time"), F.col("z.x").try_cast("double").alias("value"), "u")


def _to_canonical(df: DataFrame, base: Column) -> DataFrame:
    """value in the unit of the variable named base; the unit of a suffixed series is that of its base name."""
    known = registry.variables()
    d = df.withColumn("variable", base).where(F.col("variable").isin(*known))
    unit = F.coalesce(F.element_at("u", F.col("variable")), registry.by_variable(F.col("variable"), {n: v.unit for n, v in known.items()}))
    pairs = {}
    for n, v in known.items():
        for (a, b), f in registry._UNITS.items():
            if b == v.unit:
                pairs[f"{n}|{a}"] = f
        for alias, a in registry._ALIASES.items():
            if a == v.unit:
                pairs[f"{n}|{alias}"] = (1.0, 0.0)
            elif (a, v.unit) in registry._UNITS:
                pairs[f"{n}|{alias}"] = registry._UNITS[a, v.unit]
        pairs[f"{n}|{v.unit}"] = (1.0, 0.0)
    key = F.concat_ws("|", F.col("variable"), unit)
    scale, offset = (registry.by_variable(key, {k: float(f[i]) for k, f in pairs.items()}) for i in (0, 1))
    return d.withColumn("value", F.col("value") * scale + offset)


def openmeteo_obs(spark: SparkSession, body: str, site: Site, source_id: str) -> DataFrame:
    d = _to_canonical(_block(spark, body, "hourly"), F.col("name"))
    fixed = {"site_id": F.lit(site.site_id), "source": F.lit(source_id), "method": F.lit("model_fill"), "qc_flag": F.lit("ok")}
    return d.withColumnRenamed("time", "datetime_utc").withColumns(fixed).select(*schema.OBS.names)


def member_of(name: Column) -> tuple[Column, Column]:
    """Variable and member of a column's name; a name without one is the variable."""
    number = F.regexp_extract(name, r"^(.*)_member([0-9]+)$", 2)
    return F.when(number != "", F.regexp_extract(name, r"^(.*)_member([0-9]+)$", 1)).otherwise(name), F.when(number != "", number.try_cast("int"))


def openmeteo_forecast(spark: SparkSession, body: str, product: str, site: Site, source_id: str, model: str | None, now: dt.datetime) -> DataFrame:
    """Canonical forecasts of any product: plain, members, earlier runs, history without lead, seasonal."""
    d = _block(spark, body, "daily" if product == "seasonal" else "hourly")
    null = F.lit(None)
    issue, member, stat, name = F.lit(now).cast("timestamp"), null.cast("int"), null.cast("string"), F.col("name")
    lead = _lead(F.col("time"), issue)
    if product in ("ensemble", "seasonal"):
        name, member = member_of(F.col("name"))
    if product == "seasonal":
        tail = F.regexp_extract("name", f"^(.*)_({'|'.join(STATS)})$", 2)
        stat = F.when(tail != "", tail)
        name = F.when(tail != "", F.regexp_extract("name", f"^(.*)_({'|'.join(STATS)})$", 1)).otherwise(name)
    if product == "previous_runs":
        days = F.coalesce(F.regexp_extract("name", r"^(.*)_previous_day([0-9]+)$", 2).try_cast("int"), F.lit(0))
        name = F.regexp_replace("name", r"_previous_day[0-9]+$", "")
        lead = F.make_dt_interval(days)
        issue = F.col("time") - lead
    if product == "historical_forecast":
        lead = null.cast(schema.LEAD)
    days_ahead = schema.hours("time") / 24 - schema.hours(F.lit(now)) / 24
    own = F.when(days_ahead <= SPLICE_DAYS, "ec46").otherwise("seas5") if product == "seasonal" else F.lit(model)
    d = d.withColumns({"issue_time": issue, "member": member, "stat": stat, "lead_time": lead, "model": own.cast("string")})
    d = _to_canonical(d, name).withColumnRenamed("time", "valid_time").withColumns({"site_id": F.lit(site.site_id), "source": F.lit(source_id)})
    if product == "ensemble":
        d = d.where("member is not null")
    if product == "seasonal":
        d = d.where("member is not null or stat is not null")
    return d.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.FORECAST.fields])


class OpenMeteo(Adapter):
    attribution = "Weather data by Open-Meteo.com (CC BY 4.0)"

    def __init__(self, product: str = "forecast", models: list[str] | None = None, api_key_env: str | None = None, source_id: str = "openmeteo", http: Http | None = None):
        if product not in PRODUCTS:
            raise EngineError("unknown_adapter", product)
        super().__init__(source_id, ("temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "wind_direction_10m"))
        self.product, self.models, self.api_key_env, self.http = product, models or [], api_key_env, http or Http()

    def url(self, site: Site, variables: list[str], window: tuple) -> str:
        host, path = PRODUCTS[self.product]
        key = resolve_secret(self.api_key_env)
        block = "daily" if self.product == "seasonal" else "hourly"
        names = [f"{v}_previous_day{k}" for v in variables for k in range(1, 8)] if self.product == "previous_runs" else variables
        q = {"latitude": site.latitude, "longitude": site.longitude, block: ",".join(names), "wind_speed_unit": "ms", "temperature_unit": "celsius", "precipitation_unit": "mm", "timezone": "UTC"}
        if self.models:
            q["models"] = ",".join(self.models)
        if self.product in ("historical", "historical_forecast") and window[0]:
            q |= {"start_date": f"{window[0]:%Y-%m-%d}", "end_date": f"{window[1]:%Y-%m-%d}"}
        if key:
            q["apikey"] = key
        return f"https://{'customer-' if key else ''}{host}.open-meteo.com{path}?{urllib.parse.urlencode(q)}"

    def fetch(self, spark, site, variables, window, now):
        if self.product != "historical":
            raise EngineError("unsupported_response", f"{self.product} has forecasts only")
        return openmeteo_obs(spark, self.http.get(self.url(site, variables, window)), site, self.source_id)

    def fetch_forecast(self, spark, site, variables, window, now):
        if self.product == "historical":
            return super().fetch_forecast(spark, site, variables, window, now)
        return openmeteo_forecast(spark, self.http.get(self.url(site, variables, window)), self.product, site, self.source_id, self.models[0] if self.models else None, now)


# SILO quality codes (fixed values): method and flag of each.
SILO_CODES = {
    "0": ("measured", "ok"), "1": ("measured", "ok"), "2": ("measured", "ok"),
    "10": ("imputed", "ok"), "11": ("imputed", "ok"), "15": ("imputed", "ok"), "21": ("imputed", "ok"), "25": ("imputed", "ok"), "26": ("imputed", "ok"),
    "35": ("model_fill", "suspect"), "75": ("model_fill", "ok"), "76": ("model_fill", "ok"),
}
# SILO variables (fixed values): ours and their unit. Extremes keep names of their own, so that they don't collide.
SILO_VARIABLES = {
    "air_tmax": ("temperature_2m_max", "degC"), "air_tmin": ("temperature_2m_min", "degC"), "rainfall": ("precipitation", "mm"),
    "radiation": ("direct_radiation", "MJ/m2/day"), "mslp": ("pressure_msl", "hPa"), "rh_tmax": ("relative_humidity_2m_max", "%"), "rh_tmin": ("relative_humidity_2m_min", "%"),
}


def silo_code(code: Column) -> tuple[Column, Column]:
    """Method and flag; null for codes without a meaning."""
    return tuple(registry.by_variable(code, {k: v[i] for k, v in SILO_CODES.items()}) for i in (0, 1))


def silo_obs(df: DataFrame, site: Site, source_id: str = "silo") -> DataFrame:
    """df: date, variable_name, value, value_quality. Stamped nine o'clock local; a code without a meaning is an error."""
    method, flag = silo_code(F.col("value_quality"))
    name = registry.by_variable(F.col("variable_name"), {k: v[0] for k, v in SILO_VARIABLES.items()})
    scale = registry.by_variable(F.col("variable_name"), {k: 1 / 0.0864 if u == "MJ/m2/day" else 1.0 for k, (_, u) in SILO_VARIABLES.items()})
    stamp = F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(9), F.col("date").cast("date").cast("timestamp")), site.timezone)
    d = df.withColumns({"variable": name, "value": F.col("value") * scale, "datetime_utc": stamp, "method": method, "qc_flag": flag, "site_id": F.lit(site.site_id), "source": F.lit(source_id)}).where("variable is not null and value is not null")
    bad = d.where("method is null").select("value_quality").take(1)
    if bad:
        raise EngineError("unknown_silo_code", str(bad[0][0]))
    return d.select(*schema.OBS.names)


def silo_long(wide: DataFrame) -> DataFrame:
    """Columns <v> and <v>_source of a day become rows."""
    names = [c for c in wide.columns if c in SILO_VARIABLES]
    cells = F.array(*[F.struct(F.lit(n).alias("variable_name"), F.col(n).cast("double").alias("value"), F.col(f"{n}_source").cast("string").alias("value_quality")) for n in names])
    return wide.select("date", F.explode(cells).alias("c")).select("date", "c.*")


# GHCNh columns (fixed values): ours and their unit.
GHCNH_VARIABLES = {"air_temp": ("temperature_2m", "degC"), "wd": ("wind_direction_10m", "degree"), "ws": ("wind_speed_10m", "m/s")}


def ghcnh_obs(df: DataFrame, site: Site, source_id: str = "ghcnh") -> DataFrame:
    here = [c for c in GHCNH_VARIABLES if c in df.columns]
    wide = df.select(F.col("date").cast("timestamp").alias("datetime_utc"), *[F.col(c).cast("double").alias(GHCNH_VARIABLES[c][0]) for c in here])
    long = wide.unpivot(["datetime_utc"], [GHCNH_VARIABLES[c][0] for c in here], "variable", "value").where("value is not null")
    return long.withColumns({"site_id": F.lit(site.site_id), "source": F.lit(source_id), "method": F.lit("measured"), "qc_flag": F.lit("ok")}).select(*schema.OBS.names)


def years_in(window: tuple[dt.datetime, dt.datetime]) -> list[int]:
    return list(range(window[0].year, window[1].year + 1))


class Rows(Adapter):
    """An adapter over a client that returns a table: client(site, window) gives a DataFrame, to_obs its observations."""

    def __init__(self, source_id: str, provides: tuple[str, ...], client, to_obs, needs: str | None = None, catalogue: DataFrame | None = None, stations: int = 1, cadence: dict | None = None):
        super().__init__(source_id, provides, cadence)
        self.client, self.to_obs, self.needs, self.catalogue, self.stations = client, to_obs, needs, catalogue, stations

    def fetch(self, spark, site, variables, window, now):
        if self.needs and not site.get_resolved(self.needs):
            raise EngineError("unresolved_station", f"{site.site_id}: {self.source_id}")
        return self.to_obs(self.client(site, window), site, self.source_id).where(F.col("variable").isin(list(variables)))

    def resolve_station(self, site: Site, **_: object) -> Site:
        if self.catalogue is None:
            raise EngineError("unresolved_station", f"{site.site_id}: no catalogue")
        near = nearest_stations(self.catalogue, site.latitude, site.longitude, self.stations).select("station_id", "distance_km").collect()
        return site.set_resolved([self.needs or self.source_id], {"stations": [{"id": r[0], "distance_km": r[1]} for r in near]})


def precis_forecast(spark: SparkSession, xml: str, site_id: str, source: str = "bom_forecast") -> DataFrame:
    """The first area's periods that have a maximum temperature."""
    d = _periods(spark, xml).where("maximum is not null")
    issue, valid = F.col("issue_time"), F.col("valid_time")
    cols = {"site_id": F.lit(site_id), "source": F.lit(source), "model": F.lit(None), "issue_time": issue, "valid_time": valid, "lead_time": _lead(valid, issue), "member": F.lit(None), "stat": F.lit(None), "variable": F.lit("temperature_2m"), "value": F.col("maximum")}
    return d.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in schema.FORECAST.fields])


def precis_aux(spark: SparkSession, xml: str, site_id: str, source: str = "bom_forecast") -> DataFrame:
    d = _periods(spark, xml).select("issue_time", "valid_time", F.explode(F.arrays_zip("kinds", "texts")).alias("t"))
    return d.select(F.lit(site_id).alias("site_id"), F.lit(source).alias("source"), "issue_time", "valid_time", F.col("t.kinds").alias("field"), F.col("t.texts").alias("value_text"))


def _periods(spark: SparkSession, xml: str) -> DataFrame:
    df = spark.createDataFrame([(xml,)], "xml string")
    area = "/product/forecast/area[1]"
    n = df.select("xml", F.xpath_int("xml", F.lit(f"count({area}/forecast-period)")).alias("n")).where("n > 0")
    each = n.select("xml", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    # the path must be a literal, so all periods' values are read at once and picked by position
    starts = F.expr(f"xpath(xml, '{area}/forecast-period/@start-time-local')")
    k = int(n.agg(F.max("n")).first()[0] or 0)
    pick = lambda tail, f: F.coalesce(*[F.when(F.col("i") == i, F.expr(f"{f}(xml, '{area}/forecast-period[{i}]{tail}')")) for i in range(1, k + 1)]) if k else F.lit(None)
    maximum = pick('/element[@type="air_temperature_maximum"]/text()', "xpath_string")
    return each.select(
        F.to_timestamp(F.expr("xpath_string(xml, '/product/amoc/issue-time-utc')")).alias("issue_time"),
        F.to_timestamp(F.get(starts, F.col("i") - 1)).alias("valid_time"),
        F.nullif(maximum, F.lit("")).try_cast("double").alias("maximum"),
        pick("//text/@type", "xpath").alias("kinds"), pick("//text/text()", "xpath").alias("texts"),
    )


def _station_rows(spark: SparkSession, body: str, path: str, element: str, time: Column, cells: dict[str, tuple[Column, str]], site_id: str, source: str) -> DataFrame:
    df = spark.createDataFrame([(body,)], "body string").select(F.explode(F.from_json(F.get_json_object("body", path), f"array<{element}>")).alias("r"))
    parts = F.array(*[F.struct(F.lit(v).alias("variable"), registry.to_canonical(x.cast("double"), unit, v).alias("value")) for v, (x, unit) in cells.items()])
    long = df.select(time.alias("datetime_utc"), F.explode(parts).alias("c")).where("c.value is not null")
    return long.select(F.lit(site_id).alias("site_id"), "datetime_utc", "c.variable", "c.value", F.lit(source).alias("source"), F.lit("measured").alias("method"), F.lit("ok").alias("qc_flag"))


def bom_72h_obs(spark: SparkSession, body: str, site_id: str, source: str = "bom_obs") -> DataFrame:
    cells = {"temperature_2m": (F.col("r.air_temp"), "degC"), "wind_speed_10m": (F.col("r.wind_spd_kmh"), "km/h"), "wind_direction_10m": (physics.compass_to_angle(F.col("r.wind_dir")), "degree"), "relative_humidity_2m": (F.col("r.rel_hum"), "%")}
    return _station_rows(spark, body, "$.observations.data", "struct<aifstime_utc:string,air_temp:double,wind_spd_kmh:double,wind_dir:string,rel_hum:double>", F.to_timestamp("r.aifstime_utc", "yyyyMMddHHmmss"), cells, site_id, source)


def bom_web_obs(spark: SparkSession, body: str, site_id: str, source: str = "bom_obs") -> DataFrame:
    cells = {"temperature_2m": (F.col("r.temp"), "degC"), "wind_speed_10m": (F.col("r.wind.speed_kilometre"), "km/h"), "wind_direction_10m": (physics.compass_to_angle(F.col("r.wind.direction")), "degree"), "relative_humidity_2m": (F.col("r.humidity"), "%")}
    return _station_rows(spark, body, "$.data", "struct<time:string,temp:double,wind:struct<speed_kilometre:double,direction:string>,humidity:double>", F.to_timestamp("r.time"), cells, site_id, source)


def geohash_of(body: str) -> str:
    hits = json.loads(body).get("data") or []
    if not hits or not hits[0].get("geohash"):
        raise EngineError("no_geohash")
    return hits[0]["geohash"]


class Ladder(Adapter):
    """A source behind a ladder of transports; to_rows parses what a rung returns. last_transport names the rung that worked."""

    def __init__(self, source_id: str, provides: tuple[str, ...], ladder: list[Rung], product: str, to_rows, forecast: bool = False, breaker: Breaker | None = None, to_aux=None):
        super().__init__(source_id, provides)
        self.ladder, self.product, self.to_rows, self.forecast, self.breaker, self.to_aux, self.last_transport = ladder, product, to_rows, forecast, breaker or Breaker(), to_aux, None

    def _body(self, site: Site, window: tuple, now: dt.datetime):
        self.last_transport, body = ladder_fetch(self.ladder, {"product": self.product, "site": site, "window": window}, self.breaker, now)
        return body

    def fetch(self, spark, site, variables, window, now):
        if self.forecast:
            raise EngineError("unsupported_response", f"{self.source_id} has forecasts only")
        return self.to_rows(spark, self._body(site, window, now), site.site_id, self.source_id).where(F.col("variable").isin(list(variables)))

    def fetch_forecast(self, spark, site, variables, window, now):
        if not self.forecast:
            return super().fetch_forecast(spark, site, variables, window, now)
        return self.to_rows(spark, self._body(site, window, now), site.site_id, self.source_id).where(F.col("variable").isin(list(variables)))

    def fetch_forecast_aux(self, spark, site, window, now):
        if self.to_aux is None:
            return super().fetch_forecast_aux(spark, site, window, now)
        return self.to_aux(spark, self._body(site, window, now), site.site_id, self.source_id)


# ECMWF open data: index columns and the grid parameters of variables (fixed values).
INDEX = "domain string, date string, time string, expver string, class string, type string, stream string, step string, levtype string, number string, param string, _offset long, _length long"
GRID_PARAMS = {"temperature_2m": ("2t",), "wind_speed_10m": ("10u", "10v"), "wind_direction_10m": ("10u", "10v")}


def ecmwf_index(spark: SparkSession, lines: list[str]) -> DataFrame:
    df = spark.createDataFrame([(x,) for x in lines if x.strip()], "line string").select(F.from_json("line", INDEX).alias("i")).select("i.*")
    return df.withColumn("member", F.col("number").try_cast("double")).drop("number")


def ecmwf_select(index: DataFrame, params: list[str], steps: list[int], members: list[int] | None = None) -> DataFrame:
    out = index.where(F.col("param").isin(params) & F.col("step").isin([str(s) for s in steps]))
    return out if members is None else out.where(F.col("member").isin(members))


def normalise_step(step: Column) -> Column:
    """24h is 24, 0-24 is 24."""
    return F.regexp_extract(step, r"([0-9]+)h?$", 1).try_cast("int")


def grid_points(spark: SparkSession, body: str) -> DataFrame:
    """band, param, unit, step, member, value of a decoder's JSON: messages with keys and neighbours, the first of which is nearest."""
    element = "array<struct<keys:struct<shortName:string,step:string,perturbationNumber:string>,neighbours:array<struct<value:double,unit:string,units:string>>>>"
    d = spark.createDataFrame([(body,)], "body string").select(F.posexplode(F.from_json("body", element)))
    n = F.get(F.col("col.neighbours"), F.lit(0))
    unit = F.regexp_replace(F.coalesce(n["unit"], n["units"]), r"\*\*", "")
    return d.select((F.col("pos") + 1).alias("band"), F.col("col.keys.shortName").alias("param"), unit.alias("unit"), normalise_step(F.col("col.keys.step")).alias("step"), F.col("col.keys.perturbationNumber").try_cast("int").alias("member"), n["value"].alias("value"))


def uv_to_wind(points: DataFrame) -> DataFrame:
    """step, member, variable, value of speed and direction; a component without the other gives nothing."""
    w = points.groupBy("step", "member").agg(F.max(F.when(F.col("param") == "10u", F.col("value"))).alias("u"), F.max(F.when(F.col("param") == "10v", F.col("value"))).alias("v")).where("u is not null and v is not null")
    both = F.array(F.struct(F.lit("wind_speed_10m").alias("variable"), physics.uv_speed(F.col("u"), F.col("v")).alias("value")), F.struct(F.lit("wind_direction_10m").alias("variable"), physics.uv_direction(F.col("u"), F.col("v")).alias("value")))
    return w.select("step", "member", F.explode(both).alias("c")).select("step", "member", "c.variable", "c.value")


def issue_cycles(start: dt.datetime, end: dt.datetime, now: dt.datetime) -> list[dt.datetime]:
    """Six-hourly cycles in the window, none after now."""
    at = start.replace(hour=start.hour // 6 * 6, minute=0, second=0, microsecond=0)
    out = []
    while at <= min(end, now):
        if at >= start:
            out.append(at)
        at += dt.timedelta(hours=6)
    return out


def have_decoder() -> bool:
    """Is a decoder for GRIB messages installed? Installing one is left to the deployment."""
    import shutil

    return shutil.which("grib_ls") is not None


class Ecmwf(Adapter):
    """Open-data ensembles: index, byte ranges of the wanted messages, and a decoder given as a function from bytes to its JSON."""

    attribution = "ECMWF open data (CC BY 4.0)"

    def __init__(self, stream: str = "enfo", resolution: str = "0p25", source_id: str = "ecmwf", http: Http | None = None, decode=None):
        super().__init__(source_id, tuple(GRID_PARAMS))
        self.stream, self.resolution, self.http, self.decode = stream, resolution, http or Http(), decode

    def base_url(self, cycle: dt.datetime, step: int) -> str:
        return f"https://data.ecmwf.int/forecasts/{cycle:%Y%m%d}/{cycle:%H}z/ifs/{self.resolution}/{self.stream}/{cycle:%Y%m%d%H}0000-{step}h-{self.stream}-ef"

    def fetch_forecast(self, spark, site, variables, window, now):
        if self.decode is None:
            raise EngineError("decoder_missing")
        cycle = issue_cycles(window[0], window[1], now)[-1]
        step = int((window[1] - window[0]).total_seconds() // 3600)
        url = self.base_url(cycle, step)
        params = sorted({p for v in variables for p in GRID_PARAMS.get(v, ())})
        wanted = ecmwf_select(ecmwf_index(spark, self.http.get(f"{url}.index", parse="lines")), params, [step]).select("_offset", "_length").orderBy("_offset").collect()
        raw = b"".join(self.http.get(f"{url}.grib2", headers={"Range": f"bytes={r[0]}-{r[0] + r[1] - 1}"}, parse="raw") for r in wanted)
        points = grid_points(spark, self.decode(raw, site.latitude, site.longitude))
        plain = points.where("param = '2t'").select("step", "member", F.lit("temperature_2m").alias("variable"), (F.col("value") - F.when(F.col("unit") == "K", 273.15).otherwise(0.0)).alias("value"))
        d = plain.unionAll(uv_to_wind(points)).where(F.col("variable").isin(list(variables)))
        lead = F.make_dt_interval(F.lit(0), F.col("step"))
        cols = {"site_id": F.lit(site.site_id), "source": F.lit(self.source_id), "model": F.lit("ecmwf_ifs025"), "issue_time": F.lit(cycle), "valid_time": F.lit(cycle).cast("timestamp") + lead, "lead_time": lead, "member": F.col("member"), "stat": F.lit(None), "variable": F.col("variable"), "value": F.col("value")}
        return d.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in schema.FORECAST.fields])


@adapter("openmeteo")
def _openmeteo(name: str, config: dict) -> Adapter:
    return OpenMeteo(config.get("product", "forecast"), config.get("models"), config.get("api_key_env"), name)


@adapter("ecmwf")
def _ecmwf(name: str, config: dict) -> Adapter:
    return Ecmwf(config.get("stream", "enfo"), config.get("resolution", "0p25"), name)


def _need_client(what: str):
    def client(*_: object):
        raise EngineError("unsupported_response", f"{what} needs a client; give one to Rows()")

    return client


@adapter("silo")
def _silo(name: str, config: dict) -> Adapter:
    return Rows(name, tuple(v for v, _ in SILO_VARIABLES.values()), _need_client("silo"), silo_obs)


@adapter("ghcnh")
def _ghcnh(name: str, config: dict) -> Adapter:
    return Rows(name, tuple(v for v, _ in GHCNH_VARIABLES.values()), _need_client("ghcnh"), ghcnh_obs, needs="ghcnh", cadence={"live": False, "lag_days": 7})


@adapter("bom_obs")
def _bom_obs(name: str, config: dict) -> Adapter:
    http, url = Http(), config.get("feed_url")
    ladder = [Rung("feed", lambda r: http.get(url), ("obs",))] if url else []
    return Ladder(name, ("temperature_2m", "wind_speed_10m", "wind_direction_10m", "relative_humidity_2m"), ladder, "obs", bom_72h_obs)


@adapter("bom_forecast")
def _bom_forecast(name: str, config: dict) -> Adapter:
    http, url = Http(), config.get("feed_url")
    ladder = [Rung("feed", lambda r: http.get(url), ("precis",))] if url else []
    return Ladder(name, ("temperature_2m",), ladder, "precis", precis_forecast, forecast=True, to_aux=precis_aux)



def register_daily_extremes() -> None:
    """Puts the names of daily extremes in the dictionary, so that observations with them are valid."""
    for name in ("temperature_2m", "relative_humidity_2m"):
        v = registry.variable(name)
        for end in ("max", "min"):
            registry.register_variable(registry.Variable(f"{name}_{end}", v.unit, v.min, v.max, v.statistical_class, "site_measurable", None, f"daily {end} of {name}"))
