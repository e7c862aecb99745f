"""Empirical quantile maps, mean offsets, and piecewise-linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro.errors import EngineError

PROBS = [k / 100 for k in range(101)]
LEAST_GROUP = 20
POOLED = "__pooled__"


def quantile_grid(value: Column) -> Column:
    """Aggregate: 101 quantiles, linear between order statistics."""
    return F.percentile(value, F.array(*map(F.lit, PROBS)))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piecewise(x: Column, xs: Column, ys: Column) -> Column:
    """y at x of a line through at most 127 sorted knots; ends are held, of equal knots the last counts. JVM-side, no join with the knots."""
    n = F.size(xs)

    def line(at: Column) -> Column:
        """at: knots at or below x."""
        lo, hi = F.greatest(at - 1, F.lit(0)), F.least(at, n - 1)
        x0, x1, y0, y1 = F.get(xs, lo), F.get(xs, hi), F.get(ys, lo), F.get(ys, hi)
        inside = F.coalesce(y0 + (x - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (y1 - y0), y0)
        return F.when(x.isNull(), F.lit(None)).when(at == 0, F.get(ys, F.lit(0))).when(at >= n, F.get(ys, n - 1)).otherwise(inside)

    # by halves: as many knots as lie at or below x, in seven looks
    halves = F.array(*[F.lit(1 << k) for k in range(6, -1, -1)])
    return _let(F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(F.get(xs, at + step - 1) <= x, step).otherwise(F.lit(0))), line)


def fit_transfer(source: DataFrame, target: DataFrame, method: str = "mean_bias") -> dict:
    """A map from source to target of one variable, on common times: an offset, or 101 quantiles of each. Never sees a lead."""
    if method not in ("mean_bias", "qmap"):
        raise EngineError("bad_mode", method)
    s = source.groupBy("datetime_utc").agg(F.min_by("value", F.struct("source", "value")).alias("s")).where("s is not null")
    t = target.groupBy("datetime_utc").agg(F.min_by("value", F.struct("source", "value")).alias("t")).where("t is not null")
    r = s.join(t, "datetime_utc").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("ms"), F.avg("t").alias("mt"), quantile_grid(F.col("s")).alias("qs"), quantile_grid(F.col("t")).alias("qt")).first()
    if not r["n"]:
        raise EngineError("transfer_no_overlap")
    return {"method": method, "n": r["n"]} | ({"offset": r["ms"] - r["mt"]} if method == "mean_bias" else {"source_quantiles": list(r["qs"]), "target_quantiles": list(r["qt"])})


def apply_transfer(transfer: dict, series: DataFrame, out: str = "value") -> DataFrame:
    if transfer["method"] == "mean_bias":
        return series.withColumn(out, F.col("value") - transfer["offset"])
    knots = [F.array(*map(F.lit, transfer[k])) for k in ("source_quantiles", "target_quantiles")]
    return series.withColumn(out, piecewise(F.col("value"), *knots))


def quantile_grids(df: DataFrame, key: tuple[str, ...], value: str, out: str) -> DataFrame:
    """key, n, out: the 101 quantiles of each key, exact.

    Each key's values are sorted, which spills where an aggregate would have to hold them all, and only
    the order statistics that the grid lies between, about two hundred a key, go on.
    """
    own = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_x"))
    counts = own.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_x")).cast("long") - 1)
    keyed = counts.select(*[F.col(k).alias(f"_c_{k}") for k in key], "_n")
    j = ranked.join(keyed, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in key]) if key else ranked.crossJoin(F.broadcast(keyed))  # without a key one row
    step = F.greatest(F.col("_n") - 1, F.lit(1))
    # a grid point lies within one place of the row: the last k with k step < 100 (r + 1) has k step > 100 (r - 1)
    k = F.floor((F.col("_r") * 100 + 99) / step)
    near = j.where((k * step > F.col("_r") * 100 - 100) | (F.col("_r") == 0))
    at = near.groupBy(*key).agg(F.max("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_m"))

    def point(i: Column) -> Column:
        place = i * (F.col("n") - 1)
        low = F.floor(place / 100)
        part = (place - low * 100) / 100
        x0 = F.element_at("_m", low)
        return F.when(part == 0, x0).otherwise(x0 + part * (F.element_at("_m", low + 1) - x0))

    return at.select(*key, "n", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long")), point).alias(out))


def fit_qmap(pairs: DataFrame, key: tuple[str, ...] = (), group: str | None = None) -> DataFrame:
    """Coefficients of each key: group, n, probs, source_quantiles, target_quantiles, shift_lo, shift_hi; a pooled row and one for each group.

    pairs: forecast, observation. Pairs with a null don't count.
    """
    both = pairs.where("forecast is not null and observation is not null")

    def grids(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
        s, t = quantile_grids(df, by, "forecast", "source_quantiles"), quantile_grids(df, by, "observation", "target_quantiles")
        t = t.select(*[F.col(k).alias(f"_t_{k}") for k in by], "target_quantiles")
        j = s.join(t, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in by]) if by else s.crossJoin(F.broadcast(t))  # without a key one row
        return j.drop(*[f"_t_{k}" for k in by])

    out = grids(both, key).withColumn("group", F.lit(POOLED))
    if group:
        named = both.withColumn("_g", F.col(group).cast("string"))
        out = out.unionByName(grids(named, (*key, "_g")).withColumnRenamed("_g", "group"))
    end = lambda i: F.get("target_quantiles", F.lit(i)) - F.get("source_quantiles", F.lit(i))
    return out.select(*key, "group", F.col("n").cast("int").alias("n"), F.array(*map(F.lit, PROBS)).alias("probs"), "source_quantiles", "target_quantiles", end(100).alias("shift_hi"), end(0).alias("shift_lo"))


def qmap_value(x: Column, c: str) -> Column:
    """x through the map in struct column c; beyond its ends by the ends' shifts."""
    xs, ys = F.col(f"{c}.source_quantiles"), F.col(f"{c}.target_quantiles")
    return F.when(x > F.get(xs, F.lit(100)), x + F.col(f"{c}.shift_hi")).when(x < F.get(xs, F.lit(0)), x + F.col(f"{c}.shift_lo")).otherwise(piecewise(x, xs, ys))


def apply_qmap(coefficients: DataFrame, new: DataFrame, key: tuple[str, ...] = (), group: str | None = None, out: str = "corrected") -> DataFrame:
    """new with out: forecast through its group's map if that has 20 pairs or more, else through the pooled one.

    Coefficients are a row for each key and group, broadcast if they are few (the planner's threshold decides).
    """
    packed = coefficients.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("group").alias("_g"), "n", F.struct("source_quantiles", "target_quantiles", "shift_hi", "shift_lo").alias("_c"))
    same = lambda: [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    pooled = packed.where(F.col("_g") == POOLED).withColumnRenamed("_c", "_pooled").drop("n", "_g")
    d = new.join(pooled, same(), "left") if key else new.crossJoin(F.broadcast(pooled))  # without a key one pooled row
    d = d.drop(*[f"_k_{k}" for k in key])
    if group:
        own = packed.where((F.col("_g") != POOLED) & (F.col("n") >= LEAST_GROUP)).withColumnRenamed("_c", "_own").drop("n")
        d = d.join(own, [*same(), F.col(group).cast("string") == F.col("_g")], "left").drop("_g", *[f"_k_{k}" for k in key])
        d = d.withColumn("_use", F.coalesce("_own", "_pooled")).drop("_own", "_pooled")
    else:
        d = d.withColumnRenamed("_pooled", "_use")
    return d.withColumn(out, qmap_value(F.col("forecast"), "_use")).drop("_use")
