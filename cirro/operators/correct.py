"""Bias correction: physical steps, fitted tiers, selection, shrinkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro import registry
from cirro.errors import EngineError
from cirro.functions import physics
from cirro.sites import Site

YEAR = 365.25
HARMONICS = 2
MIN_SD = 1e-3


def correct_physical(obs: DataFrame, site: Site, grid_elevation: float | None = None) -> DataFrame:
    """Winds from their instrument's height to 10 m, temperatures by the lapse rate from the grid's elevation; tier physical. Variables without an instrument stay."""
    value = F.col("value")
    new = value
    for i in site.instruments:
        for v in i.variables:
            if v.startswith("wind_speed"):
                if i.roughness is None:
                    raise EngineError("missing_roughness", i.name)
                new = F.when(F.col("variable") == v, physics.height_correct(value, i.height, 10.0, i.roughness)).otherwise(new)
    delta = 0.0 if grid_elevation is None else site.elevation - grid_elevation
    new = F.when(F.col("variable").startswith("temperature_"), physics.lapse_correct(value, F.lit(delta))).otherwise(new)
    return obs.withColumns({"value": new, "tier": F.lit("physical")})


def _angles(time: Column) -> tuple[Column, Column]:
    """Day of the year with the hour as its fraction, and the hour."""
    hod = F.hour(time).cast("double")
    return F.dayofyear(time) + hod / 24, hod


def harmonic_columns(time: Column, n: int = HARMONICS) -> dict[str, Column]:
    doy, hod = _angles(time)
    out = {}
    for k in range(1, n + 1):
        out |= {f"sin_doy{k}": F.sin(2 * np.pi * k / YEAR * doy), f"cos_doy{k}": F.cos(2 * np.pi * k / YEAR * doy)}
    return out | {"sin_hod": F.sin(2 * np.pi / 24 * hod), "cos_hod": F.cos(2 * np.pi / 24 * hod)}


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares from normal equations, columns taken in order; those that add nothing get zero."""
    n = len(right)
    out, use = np.zeros(n), []
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g = gram / np.outer(scale, scale)
    for k in range(n):
        trial = [*use, k]
        rest = g[k, k] - (g[k, use] @ np.linalg.solve(g[np.ix_(use, use)], g[use, k]) if use else 0.0)
        if rest > 1e-8:
            use = trial
    if use:
        out[use] = np.linalg.solve(g[np.ix_(use, use)], (right / scale)[use]) / scale[use]
    return out


def fit_mean_bias(pairs: DataFrame, key: tuple[str, ...], n_harmonics: int = HARMONICS, shrink: bool = True, time: str = "valid_time") -> DataFrame:
    """Coefficients of observation less forecast on annual and daily harmonics, for each key.

    The cross products are sums, so the data are aggregated where they lie and only a row of them per
    key reaches the solver, however many pairs there are. Annual coefficients are damped by min(1, 2 x
    coverage of the year).
    """
    h = harmonic_columns(F.col(time), n_harmonics)
    names = ["(Intercept)", *h]
    d = pairs.where("forecast is not null and observation is not null").select(*key, F.dayofyear(time).alias("_doy"), (F.col("observation") - F.col("forecast")).alias("_y"), F.lit(1.0).alias("x0"), *[c.alias(f"x{i}") for i, c in enumerate(h.values(), 1)])
    n = len(names)
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(n) for j in range(i, n)]
    moments = d.groupBy(*key).agg(F.array(*sums).alias("g"), F.array(*[F.sum(F.col(f"x{i}") * F.col("_y")) for i in range(n)]).alias("r"), F.least(F.lit(1.0), (F.max("_doy") - F.min("_doy") + 1) / YEAR).alias("coverage_fraction"))

    def solve(batches):
        for frame in batches:
            rows = []
            for g, r, cover in zip(frame["g"], frame["r"], frame["coverage_fraction"], strict=True):
                gram = np.zeros((n, n))
                gram[np.triu_indices(n)] = np.asarray(g)
                c = _solve(gram + np.triu(gram, 1).T, np.asarray(r))
                if shrink:
                    c[[i for i, name in enumerate(names) if "doy" in name]] *= min(1.0, 2 * cover)
                rows.append(c)
            out = frame[list(key)].copy()
            for i in range(n):
                out[f"c{i}"] = [x[i] for x in rows]
            out["coverage_fraction"] = frame["coverage_fraction"]
            yield out

    fields = ", ".join([*[f"{k} {t}" for k, t in d.dtypes if k in key], *[f"c{i} double" for i in range(n)], "coverage_fraction double"])
    solved = moments.mapInPandas(solve, fields)
    return solved.select(*key, *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], F.lit(float(n_harmonics)).alias("n_harmonics"), "coverage_fraction")


def apply_mean_bias(coefficients: DataFrame, new: DataFrame, key: tuple[str, ...], n_harmonics: int = HARMONICS, time: str = "valid_time", out: str = "corrected") -> DataFrame:
    h = harmonic_columns(F.col(time), n_harmonics)
    c = coefficients.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(["(Intercept)", *h])]).alias("_c"))
    j = new.join(c, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left") if key else new.crossJoin(F.broadcast(c))  # without a key one row
    total = F.col("_c.c0")
    for i, x in enumerate(h.values(), 1):
        total = total + F.col(f"_c.c{i}") * x
    return j.withColumn(out, F.col("forecast") + total).drop("_c", *[f"_k_{k}" for k in key])


def fit_emos(pairs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Gaussian regression with a constant scale, in closed form: intercept, slope, log_sd of each key. A null lead is an error."""
    if "lead_bucket" in pairs.columns and not pairs.where("lead_bucket is null or lead_bucket = 'dNA'").isEmpty():
        raise EngineError("lead_unresolved")
    both = pairs.where("forecast is not null and observation is not null")
    slope = F.coalesce(F.regr_slope("observation", "forecast"), F.lit(0.0))
    m = both.groupBy(*key).agg(slope.alias("slope"), F.avg("observation").alias("mo"), F.avg("forecast").alias("mf"), F.var_pop("observation").alias("vo"), F.covar_pop("observation", "forecast").alias("cv"), F.count(F.lit(1)).alias("n"))
    sd = F.greatest(F.sqrt(F.greatest(F.col("vo") - F.col("slope") * F.col("cv"), F.lit(0.0))), F.lit(MIN_SD))
    return m.select(*key, F.lit("ml").alias("method"), (F.col("mo") - F.col("slope") * F.col("mf")).alias("intercept"), "slope", F.log(sd).alias("log_sd"), F.col("n").alias("n_pairs"))


def apply_emos(fit: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    c = fit.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.struct("intercept", "slope", "log_sd").alias("_c"))
    j = new.join(c, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    return j.withColumns({"mean": F.col("_c.intercept") + F.col("_c.slope") * F.col("forecast"), "sd": F.exp("_c.log_sd")}).drop("_c", *[f"_k_{k}" for k in key])


def model_only_correct(obs: DataFrame, ten_metres: DataFrame | None = None, stable: Column | bool = False, cap: float = 3.0) -> DataFrame:
    """Winds aloft that only models have, with tier: raw as they are, or, if the corrected and raw wind at 10 m are given
    (site_id, datetime_utc, corrected, raw), rescaled with height and experimental. The height is in the variable's name; variables
    without one and times without a wind at 10 m stay as they are.
    """
    if ten_metres is None:
        return obs.withColumn("tier", F.lit("raw"))
    w = ten_metres.groupBy(F.col("site_id").alias("_site"), F.col("datetime_utc").alias("_time")).agg(F.min(F.struct("corrected", "raw")).alias("_w"))
    j = obs.join(w, (F.col("site_id") == F.col("_site")) & (F.col("datetime_utc") == F.col("_time")), "left")
    height = F.regexp_extract("variable", "_([0-9]+)m$", 1).try_cast("double")
    calm = stable if isinstance(stable, Column) else F.lit(bool(stable))
    new = physics.profile_rescale(F.col("value"), height, F.col("_w.corrected"), F.col("_w.raw"), calm, cap=cap)
    return j.withColumns({"value": F.coalesce(new, "value"), "tier": F.lit("experimental")}).select(*obs.columns, "tier")


def training_summary(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, overlap_months, n_pairs of training pairs."""
    span = (F.unix_micros(F.max("valid_time")) - F.unix_micros(F.min("valid_time"))) / 86400e6
    return pairs.groupBy(*by).agg((span / 30.44).alias("overlap_months"), F.count(F.lit(1)).cast("int").alias("n_pairs"))


def select_tier(months: Column, n_pairs: Column, has_archive: Column, truth_source: Column, promote: Column) -> Column:
    """The tier that the training data allow, a rung lower (raw at least) where the verdict says no."""
    pseudo = truth_source == "history_daily"
    tier = (
        F.when(pseudo & (n_pairs >= 365) & has_archive, "emos")
        .when((months >= 24) & has_archive, "emos").when(months >= 6, "qmap").when(months >= 1, "mean_bias").otherwise("physical")
    )
    rank = F.array_position(F.array(*map(F.lit, registry.TIERS)), tier) - 1
    return F.get(F.array(*map(F.lit, registry.TIERS)), F.when(F.coalesce(promote, F.lit(False)), rank).otherwise(F.greatest(rank - 1, F.lit(0))).cast("int"))


def serve_weight(report: DataFrame) -> DataFrame:
    """site_id, source, variable, lead_bucket, tier, weight: 1 - rmse over climatology's, between 0 and 1; without both 1 for fitted tiers, 0 for others."""
    key = ["site_id", "source", "variable", "lead_bucket"]
    clim = report.where("tier = 'climatology'").select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("rmse").alias("_clim"))
    j = report.where(F.col("tier").isin(*registry.TIERS)).join(clim, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    w = 1 - F.col("rmse") / F.nullif("_clim", F.lit(0.0))
    fallback = F.col("tier").isin(*registry.FITTED_TIERS).cast("double")
    usable = w.isNotNull() & ~F.isnan(w)
    return j.select(*key, "tier", F.when(usable, F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))).otherwise(fallback).alias("weight"))


def fit_tier(tier: str, train: pd.DataFrame):
    """The same fits on one series in memory, for rolling origins; None where there is too little."""
    x, y = train["forecast"].to_numpy(float), train["observation"].to_numpy(float)
    if tier == "mean_bias":
        design = _design(train["valid_time"])
        doy = train["valid_time"].dt.dayofyear
        c = _solve(design.T @ design, design.T @ (y - x))
        c[1 : 1 + 2 * HARMONICS] *= min(1.0, 2 * min(1.0, (doy.max() - doy.min() + 1) / YEAR))
        return c
    if tier == "qmap":
        return np.quantile(x, np.linspace(0, 1, 101)), np.quantile(y, np.linspace(0, 1, 101))
    if tier == "emos":
        if len(x) < 2 or x.std() == 0:
            return (y.mean(), 0.0)
        slope = np.cov(x, y, bias=True)[0, 1] / x.var()
        return y.mean() - slope * x.mean(), slope
    return ()


def apply_tier(tier: str, model, frame: pd.DataFrame) -> np.ndarray:
    x = frame["forecast"].to_numpy(float)
    if tier == "mean_bias":
        return x + _design(frame["valid_time"]) @ model
    if tier == "qmap":
        xs, ys = model
        return np.where(x > xs[-1], x + ys[-1] - xs[-1], np.where(x < xs[0], x + ys[0] - xs[0], np.interp(x, xs, ys)))
    if tier == "emos":
        return model[0] + model[1] * x
    return x


def _design(time: pd.Series) -> np.ndarray:
    hod = time.dt.hour.to_numpy(float)
    doy = time.dt.dayofyear.to_numpy(float) + hod / 24
    cols = [np.ones(len(time))]
    for k in range(1, HARMONICS + 1):
        cols += [np.sin(2 * np.pi * k * doy / YEAR), np.cos(2 * np.pi * k * doy / YEAR)]
    return np.column_stack([*cols, np.sin(2 * np.pi * hod / 24), np.cos(2 * np.pi * hod / 24)])
