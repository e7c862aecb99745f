"""Verification: pairs, scores, baselines, ensembles, rolling origins, bootstrap."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirro.operators.reshape import lead_bucket
from cirro.schema import hours, lead_hours

SCORE = ("source", "variable", "lead_bucket")


def verification_pairs(fc: DataFrame, obs: DataFrame) -> DataFrame:
    """Forecast values beside ok observations of the variable and time; members and statistics don't count, of several observations the lowest source's does."""
    truth = obs.where("qc_flag = 'ok' and value is not null").groupBy("site_id", "variable", F.col("datetime_utc").alias("valid_time")).agg(F.min_by("value", F.struct("source", "value")).alias("observation"))
    plain = fc.where("member is null and stat is null and value is not null").withColumnRenamed("value", "forecast")
    j = plain.join(truth, ["site_id", "variable", "valid_time"])
    return j.withColumn("lead_bucket", lead_bucket(lead_hours())).select("site_id", "source", "model", "issue_time", "valid_time", "lead_time", "lead_bucket", "variable", "forecast", "observation")


def mae(forecast: Column, observation: Column) -> Column:
    return F.avg(F.abs(forecast - observation))


def rmse(forecast: Column, observation: Column) -> Column:
    return F.sqrt(F.avg(F.pow(forecast - observation, 2)))


def score(pairs: DataFrame, by: tuple[str, ...] = ("site_id", *SCORE), forecast: str = "forecast") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.col(forecast) - F.col("observation")).cast("int").alias("n_pairs"), mae(F.col(forecast), F.col("observation")).alias("mae"), rmse(F.col(forecast), F.col("observation")).alias("rmse"))


def crps_gaussian(observation: Column, mu: Column, sigma: Column) -> Column:
    """Closed form; the normal distribution function by an Arrow-batched erf, which SQL lacks."""
    z = (observation - mu) / sigma
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / F.lit(float(np.sqrt(2 * np.pi))) - F.lit(float(1 / np.sqrt(np.pi))))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    from math import erf, sqrt

    return z.map(lambda x: 0.5 * (1 + erf(x / sqrt(2))), na_action="ignore")


def persistence(pairs: DataFrame, by: tuple[str, ...] = ("site_id", *SCORE)) -> DataFrame:
    """The observation before in the group; its first row has none."""
    return pairs.withColumn("persistence", F.lag("observation").over(Window.partitionBy(*by).orderBy("valid_time", "issue_time")))


def climatology_sums(history: DataFrame, by: tuple[str, ...], hourly: bool) -> DataFrame:
    key = [*by, F.dayofyear("datetime_utc").alias("doy"), *([F.hour("datetime_utc").alias("hod")] if hourly else [])]
    return history.where("value is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.pow("value", 2)).alias("ss"))


def climatology(history: DataFrame, by: tuple[str, ...] = ("variable",), window_days: int = 7, window_hours: int | None = None) -> DataFrame:
    """by, doy[, hod], mean, sd, n of history within window_days (and window_hours) around each day of the year (and hour).

    Sums by day are spread over the window, so the range join becomes a group-by of at most
    366 x 24 x window rows a key, whatever the length of the history.
    """
    daily = climatology_sums(history, by, window_hours is not None)
    around = lambda c, k, n, low: F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda i: F.pmod(F.col(c) - low + i, F.lit(n)) + low)
    d = daily.withColumn("doy", F.explode(around("doy", window_days, 366, 1)))
    key = [*by, "doy"]
    if window_hours is not None:
        d = d.withColumn("hod", F.explode(around("hod", window_hours, 24, 0)))
        key.append("hod")
    out = d.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("n") * mean * mean) / F.nullif(F.col("n") - 1, F.lit(0)))))
    return out.select(*key, mean.alias("mean"), sd.alias("sd"), "n")


def rank_histogram(cases: DataFrame, members: str = "members", truth: str = "truth", seed: int | None = None) -> DataFrame:
    """rank, n: the truth's place among the members, 1 to m + 1; ties to the lowest place, or with a seed at random among the equal ones."""
    below, ties = F.size(F.filter(members, lambda x: x < F.col(truth))), F.size(F.filter(members, lambda x: x == F.col(truth)))
    rank = 1 + below if seed is None else 1 + below + F.floor(F.rand(seed) * (ties + 1)).cast("int")
    return cases.groupBy(rank.cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def histogram_flatness(histogram: DataFrame, n_members: int) -> DataFrame:
    """Sum of squared deviations of the m + 1 bins from their mean, over the mean; bins without a case count as zero."""
    bins = n_members + 1
    mean = F.sum("n") / bins
    return histogram.agg(((F.sum(F.col("n") * F.col("n")) - bins * mean * mean) / mean).alias("histogram_flatness"))


def mean_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def spread_error_ratio(cases: DataFrame, members: str = "members", truth: str = "truth") -> DataFrame:
    m = mean_of(F.col(members))
    var = F.aggregate(F.col(members), F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_m"), 2)) / (F.size(members) - 1)
    d = cases.withColumn("_m", m).withColumns({"_v": var, "_e": F.pow(F.col("_m") - F.col(truth), 2), "_k": F.size(members)})
    return d.agg((F.sqrt((1 + 1 / F.max("_k")) * F.avg("_v")) / F.sqrt(F.avg("_e"))).alias("spread_error_ratio"))


def brier(probability: Column, outcome: Column) -> Column:
    return F.avg(F.pow(probability - outcome.cast("double"), 2))


def reliability_table(df: DataFrame, probability: str, outcome: str, bins: int = 5) -> DataFrame:
    """bin (from 1), mean_probability, observed_frequency, n; bins closed on the right, the lowest on both sides, empty ones null."""
    b = F.greatest(F.lit(1), F.ceil(F.col(probability) * bins)).cast("int").alias("bin")
    got = df.groupBy(b).agg(F.avg(probability).alias("mean_probability"), F.avg(F.col(outcome).cast("double")).alias("observed_frequency"), F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cumulative_by_member(members: DataFrame) -> DataFrame:
    return members.groupBy("member").agg(F.sum("value").alias("total"))


def ensemble_cases(fc: DataFrame, obs: DataFrame) -> DataFrame:
    """site_id, source, variable, lead_bucket, valid_time, issue_time, members, truth of complete cases with two members or more."""
    truth = obs.where("qc_flag = 'ok' and value is not null").groupBy("site_id", "variable", F.col("datetime_utc").alias("valid_time")).agg(F.min_by("value", F.struct("source", "value")).alias("truth"))
    own = fc.where("member is not null and value is not null").groupBy("site_id", "source", "variable", "issue_time", "valid_time", lead_bucket(lead_hours()).alias("lead_bucket")).agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "value"))), lambda x: x["value"]).alias("members"))
    size = F.max(F.size("members")).over(Window.partitionBy("site_id", "source", "variable", "lead_bucket"))
    return own.join(truth, ["site_id", "variable", "valid_time"]).withColumn("_size", size).where((F.size("members") == F.col("_size")) & (F.col("_size") >= 2)).drop("_size")


def diagnostics(cases: DataFrame) -> DataFrame:
    """Flatness, spread and Brier score (of rain or none) of each site, source, variable and lead bucket."""
    key = ["site_id", "source", "variable", "lead_bucket"]
    m = mean_of(F.col("members"))
    rank = 1 + F.size(F.filter("members", lambda x: x < F.col("truth")))
    var = F.aggregate(F.col("members"), F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_m"), 2)) / (F.size("members") - 1)
    wet = F.size(F.filter("members", lambda x: x > 0)) / F.size("members")
    d = cases.withColumn("_m", m).withColumns({"_v": var, "_e": F.pow(F.col("_m") - F.col("truth"), 2), "_k": F.size("members"), "_rank": rank, "_b": F.when(F.col("variable") == "precipitation", F.pow(wet - (F.col("truth") > 0).cast("double"), 2))})
    bins = d.groupBy(*key, "_rank").agg(F.count(F.lit(1)).alias("n"), F.max("_k").alias("_k"), F.sum("_v").alias("v"), F.sum("_e").alias("e"), F.sum("_b").alias("b"))
    k, n = F.max("_k"), F.sum("n")
    flat = (F.sum(F.col("n") * F.col("n")) - n * n / (k + 1)) / (n / (k + 1))
    return bins.groupBy(*key).agg(k.cast("int").alias("n_members"), n.cast("int").alias("n_cases"), flat.alias("histogram_flatness"), (F.sqrt((1 + 1 / k) * F.sum("v") / n) / F.sqrt(F.sum("e") / n)).alias("spread_error_ratio"), (F.sum("b") / n).alias("brier_score"))


def rolling_origin_offset(pairs: DataFrame, by: tuple[str, ...], step_days: int = 30, buffer_days: int = 1) -> DataFrame:
    """Rolling-origin scores of a constant offset: by, mae, rmse, n_scored. Origins are every step from the first valid time; an origin learns from
    what lies a buffer before it and is scored on its step. Sums by day, cumulated, give every origin's fit in one pass.
    """
    day = F.floor(hours("valid_time") / 24)
    d = pairs.where("forecast is not null and observation is not null").withColumn("_day", day)
    # a row for each key; pairs needn't be sorted or gathered for it
    d = d.join(d.groupBy(*by).agg(F.min("_day").alias("_first")), list(by))
    d = d.withColumn("_origin", F.col("_first") + F.floor((F.col("_day") - F.col("_first")) / step_days) * step_days)
    sums = d.groupBy(*by, "_day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("observation") - F.col("forecast")).alias("s"))
    origins = d.select(*by, "_origin").distinct()
    before = Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marks = sums.select(*by, F.col("_day").alias("_at"), "n", "s", F.lit(None).cast("long").alias("_origin")).unionByName(origins.select(*by, (F.col("_origin") - buffer_days - 1).alias("_at"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.col("_origin").cast("long").alias("_origin")))
    fit = marks.withColumns({"_n": F.sum("n").over(before), "_s": F.sum("s").over(before)}).where("_origin is not null and _n > 0").select(*by, "_origin", (F.col("_s") / F.col("_n")).alias("_offset"))
    out = d.join(fit, [*by, "_origin"]).withColumn("_e", F.col("forecast") + F.col("_offset") - F.col("observation"))
    return out.groupBy(*by).agg(F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.pow("_e", 2))).alias("rmse"), F.count(F.lit(1)).alias("n_scored"))


def rolling_origin_errors(pairs: DataFrame, fit: Callable, apply: Callable, by: tuple[str, ...], step: dt.timedelta = dt.timedelta(days=30), buffer: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """by, valid_time, error of every scored row, for any pair of functions: fit(train) gives a model or None, apply(model, frame) forecasts.

    A series of one site, source, variable and lead is one group: some thousands of rows a year.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["forecast", "observation"]).sort_values(["valid_time", "issue_time"])
        out = []
        if len(frame):
            origin, last = frame["valid_time"].min(), frame["valid_time"].max()
            while origin <= last:
                train, test = frame[frame["valid_time"] < origin - buffer], frame[(frame["valid_time"] >= origin) & (frame["valid_time"] < origin + step)]
                model = fit(train) if len(train) and len(test) else None
                if model is not None:
                    out.append(test.assign(error=np.asarray(apply(model, test), dtype=float) - test["observation"]))
                origin += step
        got = pd.concat(out) if out else frame.iloc[:0].assign(error=pd.Series(dtype=float))
        return got[[*by, "valid_time", "error"]]

    fields = ", ".join(f"{n} {t}" for n, t in pairs.dtypes if n in by)
    return pairs.groupBy(*by).applyInPandas(run, f"{fields}, valid_time timestamp, error double")


def block_bootstrap(x: np.ndarray, block: int = 7, replicates: int = 500, seed: int = 1, confidence: float = 0.95) -> tuple[float, float, float, bool]:
    """Mean, its interval from moving blocks, and whether that leaves out zero."""
    x = np.asarray(x, dtype=float)
    x = x[~np.isnan(x)]
    n = len(x)
    if n < 2:
        return (float(x.mean()) if n else float("nan"), float("nan"), float("nan"), False)
    block = min(block, n)
    starts = np.random.default_rng(seed).integers(0, n - block + 1, size=(replicates, -(-n // block)))
    sums = np.concatenate([[0.0], np.cumsum(x)])
    lengths = np.full(starts.shape[1], block)
    lengths[-1] = n - block * (starts.shape[1] - 1)
    means = (sums[starts + lengths] - sums[starts]).sum(axis=1) / n
    low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(x.mean()), float(low), float(high), bool(low > 0 or high < 0)


def bootstrap_by(df: DataFrame, value: str, by: tuple[str, ...], order: str, **options) -> DataFrame:
    """by, mean, low, high, significant of each group's ordered series."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = block_bootstrap(frame.sort_values(order)[value].to_numpy(), **options)
        return pd.DataFrame([[*frame.iloc[0][list(by)], *got]], columns=[*by, "mean", "low", "high", "significant"])

    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes if n in by)
    return df.groupBy(*by).applyInPandas(run, f"{fields}, mean double, low double, high double, significant boolean")


def skill_verdict(scores: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """scores (variable, lead_bucket, candidate, incumbent, climatology) with promote and shrink_weight; null lead buckets match."""
    b = bootstrap.select(F.col("variable").alias("_v"), F.col("lead_bucket").alias("_l"), "significant")
    j = scores.join(b, F.col("variable").eqNullSafe(F.col("_v")) & F.col("lead_bucket").eqNullSafe(F.col("_l")), "left").drop("_v", "_l")
    w = 1 - F.col("candidate") / F.nullif("climatology", F.lit(0.0))
    return j.withColumns({"promote": F.coalesce((F.col("candidate") < F.col("incumbent")) & F.col("significant"), F.lit(False)), "shrink_weight": F.when(w.isNotNull(), F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))})
