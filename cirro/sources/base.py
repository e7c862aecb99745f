"""Adapters: the contract, declarative mappings, files and REST endpoints."""

from __future__ import annotations

import base64
import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro import registry, schema
from cirro.errors import EngineError
from cirro.sites import Site, resolve_secret
from cirro.sources.http import Http

# Time formats, tried in this order (fixed values).
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


class Adapter:
    """A source of observations or forecasts; subclasses override what they support."""

    def __init__(self, source_id: str, provides: tuple[str, ...], cadence: dict | None = None):
        self.source_id, self.provides, self.cadence = source_id, tuple(provides), cadence or {}

    attribution: str | None = None

    def fetch(self, spark: SparkSession, site: Site, variables: list[str], window: tuple, now: dt.datetime) -> DataFrame:
        raise NotImplementedError

    def fetch_forecast(self, spark: SparkSession, site: Site, variables: list[str], window: tuple, now: dt.datetime) -> DataFrame:
        raise EngineError("no_forecast_support", self.source_id)

    def fetch_forecast_aux(self, spark: SparkSession, site: Site, window: tuple, now: dt.datetime) -> DataFrame:
        raise EngineError("no_forecast_aux_support", self.source_id)

    def resolve_station(self, site: Site, **_: object) -> Site:
        return site


def check_fetch_result(df: DataFrame, variables: list[str]) -> DataFrame:
    """Valid observations of one source and of no other variables than those asked for; one pass."""
    out = schema.new_obs(df)
    r = out.agg(F.count_distinct("source").alias("n"), F.count(F.when(~F.col("variable").isin(variables), 1)).alias("more")).first()
    if r["n"] > 1:
        raise EngineError("mixed_source")
    if r["more"]:
        raise EngineError("unrequested_variable", f"{r['more']} rows")
    return out


def parse_time(text: Column, zone: str) -> Column:
    """UTC instant of a local time in the first format that fits, else null."""
    return F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]), zone)


@dataclass(frozen=True)
class Mapping:
    """time: {tz, path or column}; variables: list of {variable, unit, path or column}."""

    format: str
    time: dict
    variables: tuple[dict, ...]

    def __post_init__(self):
        where = {"json": "path", "csv": "column"}.get(self.format)
        if where is None or not self.time.get("tz") or not self.time.get(where) or not self.variables:
            raise EngineError("bad_mapping", f"format {self.format}, time {self.time}")
        for v in self.variables:
            if not {"variable", "unit", where} <= set(v):
                raise EngineError("bad_mapping", f"a variable needs variable, unit and {where}: {v}")
            registry.unit_factors(v["unit"], registry.canonical_unit(v["variable"]))


def _checked(long: DataFrame) -> DataFrame:
    bad = long.where("_raw_time is not null and datetime_utc is null").select("_raw_time").take(1)
    if bad:
        raise EngineError("bad_mapping", f"time {bad[0][0]!r}")
    return long.drop("_raw_time")


def _canonical(long: DataFrame, site: Site, source_id: str, method: str = "measured") -> DataFrame:
    fixed = {"site_id": F.lit(site.site_id), "source": F.lit(source_id), "method": F.lit(method), "qc_flag": F.lit("ok")}
    return long.withColumns({k: v for k, v in fixed.items() if k not in long.columns})


def at_path(df: DataFrame, body: str, path: str, array: bool = False) -> DataFrame:
    """df with x: what the JSON in body has at a slash-separated path, as text or as an array of texts; null where it isn't there."""
    x = F.get_json_object(body, "$." + path.replace("/", "."))
    return df.withColumn("x", F.from_json(x, "array<string>") if array else x)


def apply_json(spark: SparkSession, body: str, mapping: Mapping, site: Site, source_id: str) -> DataFrame:
    """Parallel arrays at slash-separated paths become long rows; a path that isn't there gives none."""
    df = spark.createDataFrame([(body,)], "body string")
    parts = []
    for v in mapping.variables:
        value = registry.to_canonical(F.col("z.x").try_cast("double"), v["unit"], v["variable"])
        times = at_path(df, "body", mapping.time["path"], True).withColumnRenamed("x", "t")
        z = at_path(times, "body", v["path"], True).where("x is not null").select(F.explode(F.arrays_zip("t", "x")).alias("z"))
        parts.append(z.where("z.t is not null").select(F.col("z.t").alias("_raw_time"), parse_time(F.col("z.t"), mapping.time["tz"]).alias("datetime_utc"), F.lit(v["variable"]).alias("variable"), value.alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return _canonical(_checked(out), site, source_id).select(*schema.OBS.names)


def apply_csv(df: DataFrame, mapping: Mapping, site: Site, source_id: str) -> DataFrame:
    """Value columns of a table of strings become long rows in one unpivot; columns that aren't there give none."""
    here = [v for v in mapping.variables if v["column"] in df.columns]
    if mapping.time["column"] not in df.columns:
        raise EngineError("bad_mapping", f"no column {mapping.time['column']}")
    t = F.col(f"`{mapping.time['column']}`")
    wide = df.select(t.alias("_raw_time"), parse_time(t, mapping.time["tz"]).alias("datetime_utc"), *[registry.to_canonical(F.col(f"`{v['column']}`").try_cast("double"), v["unit"], v["variable"]).alias(v["variable"]) for v in here])
    long = wide.unpivot(["_raw_time", "datetime_utc"], [v["variable"] for v in here], "variable", "value")
    return _canonical(_checked(long), site, source_id).select(*schema.OBS.names)


def _windowed(df: DataFrame, variables: list[str], window: tuple) -> DataFrame:
    out = df.where(F.col("variable").isin(list(variables)))
    start, end = window
    out = out if start is None else out.where(F.col("datetime_utc") >= F.lit(start))
    return out if end is None else out.where(F.col("datetime_utc") <= F.lit(end))


class FileSource(Adapter):
    """Delimited files that match a glob; Spark lists and reads them, whatever store they are in."""

    def __init__(self, source_id: str, glob: str, mapping: Mapping, provides: tuple[str, ...] = (), cadence: dict | None = None, delim: str = ",", has_header: bool = True, na: str = "", skip: int = 0):
        super().__init__(source_id, provides or tuple(v["variable"] for v in mapping.variables), cadence)
        self.glob, self.mapping, self.options, self.skip = glob, mapping, {"sep": delim, "header": str(has_header).lower(), "nullValue": na}, skip

    def fetch(self, spark, site, variables, window, now):
        try:
            if self.skip:
                lines = spark.read.option("wholetext", True).text(self.glob).select(F.explode(F.slice(F.split("value", r"\r?\n"), self.skip + 1, 1 << 30)).alias("value")).where("value <> ''")
                head = lines.first()
                names = head[0].split(self.options["sep"]) if head else []
                cells = F.split("value", self.options["sep"])
                df = lines.where(F.col("value") != (head[0] if head else "")).select(*[F.get(cells, F.lit(i)).alias(n.strip()) for i, n in enumerate(names)])
            else:
                df = spark.read.options(**self.options).csv(self.glob)
        except Exception as e:  # no file matches
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema.OBS)
        return _windowed(apply_csv(df, self.mapping, site, self.source_id), variables, window).orderBy("datetime_utc", "variable")


@dataclass
class RestSource(Adapter):
    """A JSON endpoint: {site}, {from} and {to} in its address; header or basic authorisation from the environment."""

    source_id: str
    endpoint: str
    mapping: Mapping
    auth: str = "none"
    token_env: str | None = None
    user_env: str | None = None
    header: str = "Authorization"
    prefix: str = "Bearer "
    provides: tuple[str, ...] = ()
    cadence: dict = field(default_factory=dict)
    http: Http = field(default_factory=Http)

    def __post_init__(self):
        self.provides = self.provides or tuple(v["variable"] for v in self.mapping.variables)

    def _headers(self) -> dict[str, str]:
        if self.auth == "none":
            return {}
        token = resolve_secret(self.token_env)
        if self.auth == "basic":
            return {"Authorization": "Basic " + base64.b64encode(f"{resolve_secret(self.user_env)}:{token}".encode()).decode()}
        return {self.header: self.prefix + (token or "")}

    def url(self, site: Site, window: tuple) -> str:
        say = lambda t: "" if t is None else t.strftime("%Y-%m-%dT%H:%M:%SZ")
        return self.endpoint.replace("{site}", site.site_id).replace("{from}", say(window[0])).replace("{to}", say(window[1]))

    def fetch(self, spark, site, variables, window, now):
        body = self.http.get(self.url(site, window), headers=self._headers())
        parsed = json.loads(body)
        if isinstance(parsed, dict) and (parsed.get("next") or parsed.get("next_cursor")):
            raise EngineError("unsupported_response", "the response has further pages")
        return _windowed(apply_json(spark, body, self.mapping, site, self.source_id), variables, window)


ADAPTERS: dict[str, Callable[[str, dict], Adapter]] = {}


def adapter(kind: str):
    def put(f):
        ADAPTERS[kind] = f
        return f

    return put


def adapters_for_site(site: Site) -> dict[str, Adapter]:
    import cirro.sources.vendors  # noqa: F401  registers its kinds

    out = {}
    for name, config in site.sources.items():
        kind = config.get("kind", config.get("adapter", name))
        if kind not in ADAPTERS:
            raise EngineError("unknown_adapter", str(kind))
        out[name] = ADAPTERS[kind](name, config)
    return out


def _mapping(config: dict) -> Mapping:
    m = config["mapping"]
    return Mapping(m["format"], m["time"], tuple(m["variables"]))


@adapter("file")
def _file(name: str, config: dict) -> Adapter:
    return FileSource(name, config["glob"], _mapping(config), tuple(config.get("provides", ())), **{k: config[k] for k in ("delim", "has_header", "na", "skip") if k in config})


@adapter("rest")
def _rest(name: str, config: dict) -> Adapter:
    return RestSource(name, config["endpoint"], _mapping(config), **{k: config[k] for k in ("auth", "token_env", "user_env", "header", "prefix") if k in config})
