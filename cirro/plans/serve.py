"""Corrections from stored calibrations, curated histories, read API and the wide table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro import registry, schema
from cirro.errors import EngineError
from cirro.functions import physics
from cirro.operators import correct, qc, reshape, transfer, verify
from cirro.operators import aggregate as agg
from cirro.plans.table import UNVERIFIED, MetTable
from cirro.sites import Site, Sites, as_sites
from cirro.store import Store

POOL_DAYS, LEAST_HOURLY = 1095, 5
# Columns of the wide table unless others are asked for.
CONTRACT = (
    "temperature_2m", "relative_humidity_2m", "dewpoint_2m", "surface_pressure", "pressure_msl", "precipitation", "cloud_cover", "direct_radiation", "diffuse_radiation", "wind_speed_10m",
    "wind_direction_10m", "wind_gusts_10m", "wind_speed_80m", "wind_speed_120m", "wind_speed_180m", "boundary_layer_height", "soil_moisture_0_to_1cm", "soil_moisture_1_to_3cm", "cape", "uv_index",
)


def apply_tier(tier: str, coefficients: DataFrame, new: DataFrame, time: str = "valid_time") -> DataFrame:
    """new with corrected: forecast through one calibration (emos gives its mean)."""
    if tier == "mean_bias":
        return correct.apply_mean_bias(coefficients, new, (), time=time)
    if tier == "qmap":
        return transfer.apply_qmap(coefficients, new)
    if tier == "emos":
        one = F.broadcast(coefficients.select(F.col("intercept").alias("_a"), F.col("slope").alias("_b")).limit(1))
        return new.crossJoin(one).withColumn("corrected", F.col("_a") + F.col("_b") * F.col("forecast")).drop("_a", "_b")  # one row
    return new.withColumn("corrected", F.col("forecast"))


def climatology_series(store: Store, site_id: str, times: DataFrame, now: dt.datetime, fallback: Column | None = None) -> DataFrame:
    """times (variable, time) with climatology: by day and hour of the last three years (five values at least), else by day, else the fallback."""
    history = store.read_obs(site_id, start=now - dt.timedelta(days=POOL_DAYS), end=now).where("qc_flag = 'ok'")
    hourly = verify.climatology(history, window_hours=1).where(F.col("n") >= LEAST_HOURLY).select(F.col("variable").alias("_hv"), F.col("doy").alias("_hd"), F.col("hod").alias("_hh"), F.col("mean").alias("_hm"))
    daily = verify.climatology(history).select(F.col("variable").alias("_dv"), F.col("doy").alias("_dd"), F.col("mean").alias("_dm"))
    d, h = F.dayofyear("time"), F.hour("time")
    # at most 366 x 24 rows a variable
    j = times.join(F.broadcast(hourly), (F.col("variable") == F.col("_hv")) & (d == F.col("_hd")) & (h == F.col("_hh")), "left").join(F.broadcast(daily), (F.col("variable") == F.col("_dv")) & (d == F.col("_dd")), "left")
    return j.withColumn("climatology", F.coalesce("_hm", "_dm", fallback if fallback is not None else F.lit(None).cast("double"))).drop("_hv", "_hd", "_hh", "_hm", "_dv", "_dd", "_dm")


def _calibrated(store: Store, site_id: str, df: DataFrame, time: str) -> DataFrame:
    """df (variable, source, forecast) with corrected and tier. One branch for each calibration in the site's manifest, a configured few."""
    newest: dict[tuple, dict] = {}
    for r in store.manifest(site_id):
        k = (r["variable"], r["source"])
        if k not in newest or r["version"] > newest[k]["version"]:
            newest[k] = r
    only = [n for n, v in registry.variables().items() if v.measurability_class == "model_only"]
    is_one = [(F.col("variable") == v) & (F.col("source") == s) for v, s in newest]
    rest = df
    for c in is_one:
        rest = rest.where(~c)
    out = rest.withColumns({"corrected": F.col("forecast"), "tier": F.when(F.col("variable").isin(only), "raw").otherwise("physical")})
    for (v, s), r in newest.items():
        _, coefficients = store.read_calibration(site_id, v, s)
        own = df.where((F.col("variable") == v) & (F.col("source") == s))
        out = out.unionByName(apply_tier(r["tier"], coefficients, own, time).withColumn("tier", F.lit(r["tier"])))
    return out


def correct_forecast(store: Store, site: Site, fc: DataFrame, now: dt.datetime) -> DataFrame:
    """Forecasts corrected by their calibrations, fitted ones drawn towards the climatology by their skill, then made consistent; adds tier."""
    own = fc.withColumnRenamed("value", "forecast").withColumn("lead_bucket", reshape.lead_bucket(schema.lead_hours()))
    d = _calibrated(store, site.site_id, own, "valid_time")
    w = correct.serve_weight(store.read_report(site.site_id)).select(F.col("source").alias("_s"), F.col("variable").alias("_v"), F.col("lead_bucket").alias("_l"), F.col("tier").alias("_t"), "weight")
    d = d.join(F.broadcast(w), (F.col("source") == F.col("_s")) & (F.col("variable") == F.col("_v")) & F.col("lead_bucket").eqNullSafe(F.col("_l")) & (F.col("tier") == F.col("_t")), "left").drop("_s", "_v", "_l", "_t")  # a site's report
    d = climatology_series(store, site.site_id, d.withColumn("time", F.col("valid_time")), now, F.col("corrected")).drop("time")
    fitted = F.col("tier").isin(*registry.FITTED_TIERS)
    value = F.when(fitted, physics.shrink(F.col("corrected"), F.col("climatology"), F.coalesce("weight", F.lit(1.0)))).otherwise(F.col("corrected"))
    out = d.withColumn("value", value).select(*schema.FORECAST.names, "tier")
    return qc.consistency_pass_long(out, ["site_id", "source", "model", "issue_time", "valid_time", "member", "stat"], (site.latitude, site.longitude, site.elevation), "valid_time")


def correct_apply(store: Store, site: Site, source: str, target: str, now: dt.datetime, variables: list[str] | None = None, force_tier: str | None = None) -> DataFrame:
    """A source's record or forecast, corrected, with tier; a stored tier other than force_tier is an error."""
    if target not in ("forecast", "record"):
        raise EngineError("bad_mode", target)
    rows = [r for r in store.manifest(site.site_id) if r["source"] == source and (variables is None or r["variable"] in variables)]
    if force_tier and any(r["tier"] != force_tier for r in rows):
        raise EngineError("tier_mismatch", force_tier)
    if target == "forecast":
        fc = store.read_forecast(site.site_id, source)
        return correct_forecast(store, site, fc if variables is None else fc.where(F.col("variable").isin(variables)), now)
    obs = store.read_obs(site.site_id, variables).where(F.col("source") == source).withColumnRenamed("value", "forecast")
    return _calibrated(store, site.site_id, obs, "datetime_utc").withColumn("value", F.col("corrected")).select(*schema.OBS.names, "tier")


def history_hourly(store: Store, site: Site, start=None, end=None, at=None, variables: list[str] | None = None) -> DataFrame:
    return agg.aggregate_hourly(store.read_obs(site.site_id, variables, start, end, at=at))


def own_or_interpolated(own: DataFrame, other: DataFrame, day: str = "day") -> DataFrame:
    """own, and of other the variables and days that own hasn't."""
    return own.unionByName(other.join(own.select("variable", day).distinct(), ["variable", day], "left_anti"))


def history_daily(store: Store, site: Site, start=None, end=None, at=None, variables: list[str] | None = None, literal: bool = False) -> DataFrame:
    """Daily values of the station's own record, and of the interpolated daily source (silo, corrected) where there is none for the variable and local day.

    Sub-daily rows are aggregated to days first; literal=True passes them through as they are.
    """
    clean = store.read_obs(site.site_id, variables, start, end, at=at).where("qc_flag not in ('fail', 'missing')")
    silo = clean.where("source = 'silo'").withColumnRenamed("value", "forecast")
    silo = _calibrated(store, site.site_id, silo, "datetime_utc").withColumn("value", F.col("corrected")).select(*schema.OBS.names, "tier")
    own = clean.where("source <> 'silo'")
    if not literal:
        own = agg.aggregate_daily(agg.aggregate_hourly(own), site.timezone)
    own = own.withColumn("tier", F.lit("raw"))
    # stamps are of nine o'clock or midnight, so the local date is the day
    day = lambda df: df.withColumn("_day", F.to_date(F.from_utc_timestamp("datetime_utc", site.timezone)))
    both = own_or_interpolated(day(own), day(silo), "_day").drop("_day")
    return qc.consistency_pass_long(both, ["site_id", "datetime_utc"]).orderBy("site_id", "variable", "datetime_utc")


def met_history(store: Store, sites: Site | Sites, resolution: str = "hourly", variables: list[str] | None = None, start=None, end=None, at=None) -> DataFrame:
    if resolution not in ("hourly", "daily"):
        raise EngineError("bad_mode", resolution)
    build = history_hourly if resolution == "hourly" else history_daily
    return _bind([build(store, s, start, end, at, variables) for s in as_sites(sites)])


def _bind(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def met_record(store: Store, sites: Site | Sites, variables: list[str] | None = None, start=None, end=None, at=None) -> DataFrame:
    """All sites in one scan."""
    return store.read_obs(as_sites(sites).ids, variables, start, end, at=at)


def met_forecast_archive(store: Store, sites: Site | Sites, source=None, **window) -> DataFrame:
    return store.read_forecast(as_sites(sites).ids, source, **window)


def met_verification(store: Store, sites: Site | Sites, source: str | None = None) -> DataFrame:
    df = store.read_report().where(F.col("site_id").isin(as_sites(sites).ids))
    return df if source is None else df.where(F.col("source") == source)


def met_connect(store: Store):
    """SQL over the stored tables; experimental."""
    return store.connect()


def met_wide(store: Store, site: Site | Sites, window: tuple[dt.datetime, dt.datetime], kind: str = "forecast", variables: list[str] | None = None, now: dt.datetime | None = None) -> MetTable:
    """One site's wide table: the newest issuances corrected, or the record by hours, with provenance."""
    if len(as_sites(site)) != 1:
        raise EngineError("single_site")
    own = next(iter(as_sites(site)))
    names = list(variables or CONTRACT)
    now = now or registry.now_utc()
    if kind == "forecast":
        fc = reshape.latest_issuance(store.read_forecast(own.site_id, valid_from=window[0], valid_to=window[1]))
        long = correct_forecast(store, own, fc.where(F.col("variable").isin(names)), now)
        wide = reshape.widen_forecast(long, names).withColumnRenamed("valid_time", "time")
    elif kind == "record":
        long = history_hourly(store, own, *window, variables=names).withColumn("tier", F.lit("raw"))
        wide = reshape.widen_obs(long, names).drop("site_id").withColumnRenamed("datetime_utc", "time")
    else:
        raise EngineError("bad_mode", kind)
    manifest = store.manifest(own.site_id)
    found = {r["variable"]: r for r in long.groupBy("variable").agg(F.min_by(F.struct("tier", "source"), "source").alias("r")).select("variable", "r.*").collect()}  # a row for each variable

    def hours_of(v: str, source: str) -> float | None:
        rows = [r for r in manifest if (r["variable"], r["source"]) == (v, source) and r.get("train_start")]
        if not rows:
            return None
        last = max(rows, key=lambda r: r["version"])
        return (dt.datetime.fromisoformat(str(last["train_end"])) - dt.datetime.fromisoformat(str(last["train_start"]))).total_seconds() / 3600

    prov = {v: {"tier": found[v]["tier"], "train_overlap": hours_of(v, found[v]["source"]), "source": found[v]["source"]} if v in found else {"tier": UNVERIFIED, "train_overlap": None, "source": None} for v in names}
    return MetTable(wide.orderBy("time"), prov, {"site_id": own.site_id, "from": window[0], "to": window[1], "kind": kind}, {"schema": 1, "manifest": max((r["version"] for r in manifest), default=0)})
