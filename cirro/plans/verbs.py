"""Pipeline verbs: sync, refit, backfill. State passes through the store; `now` is always given."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro import registry, schema
from cirro.errors import EngineError
from cirro.operators import correct, fill, qc, stations, transfer, verify
from cirro.plans import serve
from cirro.sites import Site, Sites, as_sites
from cirro.sources.base import Adapter, adapters_for_site, check_fetch_result
from cirro.store import Store

QC_LOOKBACK, FILL_LOOKBACK = dt.timedelta(days=1), dt.timedelta(days=7)
REFETCH, LIVE, ISSUES, BACKFILL = dt.timedelta(days=7), dt.timedelta(hours=6), dt.timedelta(days=3), dt.timedelta(days=3650)
STEP, BUFFER = dt.timedelta(days=30), dt.timedelta(days=1)
#: Of each source, whether an issue that was missed can be had later.
MISSED = {"bom_forecast": "issues that were missed can't be had again", "openmeteo": "issues that were missed can be had later as previous runs"}


def for_each_site(sites: Site | Sites, work: Callable[[Site], dict | None], on_error: str = "isolate") -> list[dict]:
    """A status row for each site; an error in one leaves the others alone unless on_error is 'stop'."""
    out = []
    for s in as_sites(sites):
        try:
            out.append({"site_id": s.site_id, "status": "ok", "message": None} | (work(s) or {}))
        except Exception as e:  # noqa: BLE001  a site's failure is a row of the result
            if on_error == "stop":
                raise
            out.append({"site_id": s.site_id, "status": "error", "message": str(e)})
    return out


def qc_run(store: Store, site: Site, now: dt.datetime, donors: DataFrame | None = None, envelope: DataFrame | None = None) -> dict[str, int]:
    """Rules over what came since the last run and a day before; changed rows supersede, findings go to the log."""
    mark = store.watermark(site.site_id, "qc")
    obs = store.read_obs(site.site_id, start=None if mark is None else mark - QC_LOOKBACK, end=now)
    # written beside the store once; counted, logged and merged from there
    with store.side(qc.run_rules(obs, donors, envelope, (site.latitude, site.longitude, site.elevation))) as ruled:
        lacking = {k: v for k, v, given in (("spatial", "no donors", donors), ("climatology", "no climatology yet", envelope)) if given is None}
        log = qc.log_of(ruled)
        if lacking:
            log = log.unionByName(qc.skipped(ruled, lacking))
        n_log = log.count()
        if n_log:
            store.write_qc_log(log, now)
        old = obs.select(*schema.OBS_KEY, F.col("qc_flag").alias("_old"))
        changed = ruled.join(old, list(schema.OBS_KEY)).where("qc_flag <> _old").select(*schema.OBS.names)
        counts = store.write_obs(changed, now, "supersede", check=False)
    store.set_watermark(site.site_id, "qc", now)
    return {"n_flagged": counts["n_superseded"], "n_log_rows": n_log}


def fill_run(store: Store, site: Site, now: dt.datetime, donor: DataFrame | None = None, model: DataFrame | None = None) -> int:
    mark = store.watermark(site.site_id, "fill")
    obs = store.read_obs(site.site_id, start=None if mark is None else mark - FILL_LOOKBACK, end=now)
    done = fill.fill_tier(obs, donor, model, (site.latitude, site.longitude, site.elevation))
    filled = done.where("method in ('imputed', 'derived', 'donor_fill', 'model_fill')")
    key = [*schema.OBS_KEY]
    before = obs.select(*key, F.col("value").alias("_v"), F.col("method").alias("_m"))
    changed = filled.join(before, key, "left").where("_m is null or not (value <=> _v) or method <> _m").select(*schema.OBS.names)
    counts = store.write_obs(changed, now, "supersede", check=False)
    store.set_watermark(site.site_id, "fill", now)
    return counts["n_new"] + counts["n_superseded"]


def acquire_obs(store: Store, source: Adapter, site: Site, window: tuple, now: dt.datetime, variables: list[str] | None = None) -> DataFrame:
    names = list(variables or source.provides)
    return check_fetch_result(source.fetch(store.spark, site, names, window, now), names)


def missed_notes(sources: dict[str, Adapter] | list[str]) -> dict[str, str]:
    return {s: MISSED.get(s, "not known whether issues that were missed can be had again") for s in sources}


def archive_forecasts(store: Store, site: Site, sources: dict[str, Adapter], now: dt.datetime, missed: bool = False) -> dict:
    """Archives three days of issues of every source; missed=True only tells what can't be had again."""
    if missed:
        return {"notes": missed_notes(sources)}
    added = {}
    for name, a in sources.items():
        added[name] = store.write_forecast(a.fetch_forecast(store.spark, site, list(a.provides), (now - ISSUES, now + ISSUES), now))
        try:
            store.write_forecast_aux(a.fetch_forecast_aux(store.spark, site, (now - ISSUES, now + ISSUES), now))
        except EngineError as e:
            if e.code != "no_forecast_aux_support":
                raise
    return {"added": added}


def _sources(site: Site, names: list[str] | None, given: dict[str, Adapter] | None) -> dict[str, Adapter]:
    have = given if given is not None else adapters_for_site(site)
    return {k: v for k, v in have.items() if names is None or k in names}


def _ingest(store: Store, site: Site, sources: dict[str, Adapter], window_of: Callable[[str], tuple], now: dt.datetime, table: str) -> list[str]:
    """Fetches and upserts each source; returns what failed."""
    failed = []
    for name, a in sources.items():
        try:
            obs = acquire_obs(store, a, site, window_of(name), now)
            store.write_obs(obs, now, "supersede", check=False)
            if getattr(a, "last_transport", None):
                store.write_transport(obs.select(*schema.TRANSPORT_KEY).withColumn("transport", F.lit(a.last_transport)), now)
            store.set_watermark(site.site_id, table, now, name)
        except Exception as e:  # noqa: BLE001  the next source goes on; the site is degraded
            failed.append(f"{name}: {e}")
    return failed


def met_sync_daily(store: Store, sites: Site | Sites, now: dt.datetime, config: dict | None = None, adapters: Callable[[Site], dict[str, Adapter]] | None = None) -> list[dict]:
    config = config or {}

    def work(site: Site) -> dict:
        given = adapters(site) if adapters else None
        archive_forecasts(store, site, _sources(site, config.get("forecast_sources", []), given), now)
        refetch = config.get("refetch_windows", {})
        failed = _ingest(store, site, _sources(site, config.get("obs_sources"), given), lambda n: store.fetch_window(site.site_id, "observations", n, refetch.get(n, REFETCH), now), now, "observations")
        flags, n = qc_run(store, site, now), fill_run(store, site, now)
        return {"status": "degraded" if failed else "ok", "message": "; ".join(failed) or None, "n_filled": n} | flags

    return for_each_site(sites, work)


def met_sync_live(store: Store, sites: Site | Sites, now: dt.datetime, config: dict | None = None, adapters: Callable[[Site], dict[str, Adapter]] | None = None) -> list[dict]:
    config = config or {}

    def work(site: Site) -> dict:
        given = adapters(site) if adapters else None
        live = {k: a for k, a in _sources(site, config.get("obs_sources"), given).items() if a.cadence.get("live", True)}
        failed = _ingest(store, site, live, lambda _: (now - LIVE, now), now, "live")
        qc_run(store, site, now)
        fill_run(store, site, now)
        try:
            archive_forecasts(store, site, _sources(site, config.get("forecast_sources", []), given), now)
        except Exception as e:  # noqa: BLE001
            failed.append(str(e))
        store.set_watermark(site.site_id, "live", now)
        return {"status": "degraded" if failed else "ok", "message": "; ".join(failed) or None}

    return for_each_site(sites, work)


def verification_pairs(store: Store, site: Site, source: str | None = None, variables: list[str] | None = None) -> DataFrame:
    fc = store.read_forecast(site.site_id, source, members=False)
    obs = store.read_obs(site.site_id, variables)
    return verify.verification_pairs(fc if variables is None else fc.where(F.col("variable").isin(variables)), obs)


def _gate(months: float, n: int) -> str:
    return "emos" if months >= 24 else "qmap" if months >= 6 else "mean_bias" if months >= 1 else "physical"


def correct_refit(store: Store, site: Site, source: str, variable: str, now: dt.datetime) -> dict:
    """Fits what the pairs allow, sets it against the incumbent on the same rolling origins, and writes a new version if it is better and significantly so.

    One series of a site, source and variable: some thousands of pairs a year, scored in one group.
    """
    if registry.variable(variable).measurability_class == "model_only":
        return {"variable": variable, "source": source, "action": "model_only"}
    pairs = verification_pairs(store, site, source, [variable])
    summary = correct.training_summary(pairs.where("forecast is not null"), ("site_id",)).first()
    if summary is None:
        return {"variable": variable, "source": source, "action": "no_pairs"}
    tier = _gate(summary["overlap_months"], summary["n_pairs"])
    if tier == "physical":
        return {"variable": variable, "source": source, "action": "too_short"}
    held = [r for r in store.manifest(site.site_id) if (r["variable"], r["source"]) == (variable, source)]
    incumbent = max(held, key=lambda r: r["version"])["tier"] if held else "raw"
    if tier == incumbent:
        # the same fit scores the same on the same origins: no version without a win
        return {"variable": variable, "source": source, "action": "kept", "tier": incumbent}
    errors = {}
    for name in (tier, incumbent):
        d = verify.rolling_origin_errors(pairs.select("site_id", "issue_time", "valid_time", "forecast", "observation"), lambda f, n=name: correct.fit_tier(n, f), lambda m, f, n=name: correct.apply_tier(n, m, f), ("site_id",), STEP, BUFFER)
        # a row for each valid time of one series
        errors[name] = d.groupBy("valid_time").agg(F.avg(F.pow("error", 2)).alias("e")).toPandas().set_index("valid_time")["e"]
    both = pd.concat([errors[tier].rename("c"), errors[incumbent].rename("i")], axis=1).dropna().sort_index()
    mean, low, high, significant = verify.block_bootstrap((both["i"] - both["c"]).to_numpy(), 7, 500, 1)
    rmse = np.sqrt(both.mean()) if len(both) else None
    if rmse is None or not (rmse["c"] < rmse["i"] and significant):
        return {"variable": variable, "source": source, "action": "kept", "tier": incumbent}
    span = pairs.agg(F.min("valid_time").alias("a"), F.max("valid_time").alias("b")).first()
    fits = {"mean_bias": lambda: correct.fit_mean_bias(pairs, ()), "qmap": lambda: transfer.fit_qmap(pairs), "emos": lambda: correct.fit_emos(pairs.where("lead_bucket <> 'dNA'"), ())}
    version = store.write_calibration(site.site_id, variable, source, tier, fits[tier](), {"train_start": span["a"].isoformat(), "train_end": span["b"].isoformat(), "n_pairs": summary["n_pairs"]}, now)
    return {"variable": variable, "source": source, "action": "promoted", "tier": tier, "version": version, "gain": float(np.nan_to_num(mean)), "interval": (low, high)}


def verify_run(store: Store, site: Site, sources: list[str], now: dt.datetime) -> DataFrame:
    """Writes, in place of the last, the scores of raw forecasts, persistence, climatology and the calibrations, and the ensembles' diagnostics."""
    by = ("site_id", *verify.SCORE)
    pairs = verification_pairs(store, site).where(F.col("source").isin(sources))
    rows = verify.score(pairs, by).withColumn("tier", F.lit("raw"))
    rows = rows.unionByName(verify.score(verify.persistence(pairs, by).where("persistence is not null"), by, "persistence").withColumn("tier", F.lit("persistence")))
    clim = serve.climatology_series(store, site.site_id, pairs.withColumn("time", F.col("valid_time")), now).where("climatology is not null")
    rows = rows.unionByName(verify.score(clim, by, "climatology").withColumn("tier", F.lit("climatology")))
    done = serve._calibrated(store, site.site_id, pairs, "valid_time").where(F.col("tier").isin(*registry.FITTED_TIERS))
    rows = rows.unionByName(verify.score(done, (*by, "tier"), "corrected"))
    store.write_report(rows.select(*schema.REPORT.names), [site.site_id])
    members = store.read_forecast(site.site_id).where(F.col("source").isin(sources))
    store.write_diagnostics(verify.diagnostics(verify.ensemble_cases(members, store.read_obs(site.site_id))).select(*schema.DIAGNOSTICS.names))
    return store.read_report(site.site_id)


def met_refit(store: Store, sites: Site | Sites, now: dt.datetime, config: dict | None = None) -> list[dict]:
    config = config or {}

    def work(site: Site) -> dict:
        sources = config.get("forecast_sources") or [r[0] for r in store.read_forecast(site.site_id).select("source").distinct().collect()]
        there = [tuple(r) for r in store.read_forecast(site.site_id).where(F.col("source").isin(sources)).select("source", "variable").distinct().collect()]
        results = [correct_refit(store, site, s, v, now) for s, v in sorted(there)]
        verify_run(store, site, sources, now)
        return {"results": results}

    out = for_each_site(sites, work)
    store.compact()
    return out


def ingest_export(store: Store, site: Site, source: Adapter, now: dt.datetime) -> dict[str, int]:
    """A station's export file, upserted."""
    return store.write_obs(acquire_obs(store, source, site, (None, None), now), now, "supersede", check=False)


def met_backfill(store: Store, sites: Site | Sites, now: dt.datetime, config: dict | None = None, adapters: Callable[[Site], dict[str, Adapter]] | None = None, exports: dict[str, Adapter] | None = None) -> list[dict]:
    """Ten years of every source, exports, a first refit, coverage and notes on gaps. An error stops it."""
    config = config or {}

    def work(site: Site) -> dict:
        window = (now - BACKFILL, now)
        for a in _sources(site, config.get("obs_sources"), adapters(site) if adapters else None).values():
            store.write_obs(acquire_obs(store, a, site, window, now), now, "supersede", check=False)
        if exports and site.site_id in exports:
            ingest_export(store, site, exports[site.site_id], now)
        qc_run(store, site, now)
        fill_run(store, site, now)
        met_refit(store, site, now, config)
        cover = {r["variable"]: r["coverage"] for r in stations.station_coverage(store.read_obs(site.site_id), *window).collect()}  # a row for each variable
        return {"coverage": cover, "notes": missed_notes(config.get("forecast_sources") or list(MISSED))}

    return for_each_site(sites, work, on_error="stop")
