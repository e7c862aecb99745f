"""Gap filling: interpolation by class, derivation, donors, models. A gap is a null value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro import registry
from cirro.errors import EngineError
from cirro.functions import physics
from cirro.operators.qc import SERIES, series
from cirro.operators.stations import donor_priority
from cirro.operators.transfer import apply_transfer, fit_transfer

MICRO_HOURS = 3


def gap_runs(obs: DataFrame) -> DataFrame:
    """obs with gap_id and span_hours (last less first null time) of null runs; null for other rows."""
    w = series()
    gap = F.col("value").isNull()
    start = (gap & ~F.coalesce(F.lag(gap).over(w), F.lit(False))).cast("int")
    run = obs.withColumn("_g", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy(*SERIES, "_g", F.col("value").isNull())
    span = (F.unix_micros(F.max("datetime_utc").over(own)) - F.unix_micros(F.min("datetime_utc").over(own))) / 3.6e9
    return run.withColumns({"gap_id": F.when(gap, F.col("_g")), "span_hours": F.when(gap, span)}).drop("_g")


def _before_and_after(order: str = "datetime_utc") -> tuple[Window, Window]:
    """The rows of a series up to the current one, and those from the last one back to it: frames that only grow, so each row is taken up once."""
    own = Window.partitionBy(*SERIES)
    return tuple(own.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow) for c in (F.col(order), F.col(order).desc()))


def interpolate(df: DataFrame, source: Column, out: str) -> DataFrame:
    """df with out: source, and where it is null a line by row number between its neighbours in the series; ends are held."""
    d = df.withColumn("_x", source).withColumn("_i", F.row_number().over(series()))
    back, ahead = _before_and_after("_i")
    has = F.when(F.col("_x").isNotNull(), F.struct("_x", "_i"))
    d = d.withColumns({"_p": F.last(has, True).over(back), "_n": F.last(has, True).over(ahead)})
    line = F.col("_p._x") + (F.col("_i") - F.col("_p._i")) / F.nullif(F.col("_n._i") - F.col("_p._i"), F.lit(0)) * (F.col("_n._x") - F.col("_p._x"))
    return d.withColumn(out, F.coalesce(F.col("_x"), line, F.col("_p._x"), F.col("_n._x"))).drop("_x", "_i", "_p", "_n")


def fill_linear(obs: DataFrame) -> DataFrame:
    return interpolate(obs, F.col("value"), "filled")


def fill_circular(obs: DataFrame) -> DataFrame:
    """By sine and cosine, so that it never goes the long way round."""
    d = interpolate(obs, F.sin(F.radians("value")), "_s")
    d = interpolate(d, F.cos(F.radians("value")), "_c")
    way = physics.wrap_degrees(F.degrees(F.atan2("_s", "_c")) + 360)
    return d.withColumn("filled", F.coalesce(F.col("value"), way)).drop("_s", "_c")


def fill_rain(obs: DataFrame) -> DataFrame:
    """Dry between dry neighbours, else the value before, else the one after, else dry."""
    back, ahead = _before_and_after()
    left, right = F.last("value", True).over(back), F.last("value", True).over(ahead)
    return obs.withColumn("filled", F.coalesce(F.col("value"), F.when((left == 0) & (right == 0), 0.0), left, right, F.lit(0.0)))


def _with_temperature(obs: DataFrame) -> DataFrame:
    w = Window.partitionBy("site_id", "datetime_utc")
    t = F.when((F.col("variable") == "temperature_2m") & (F.col("qc_flag") == "ok"), F.col("value"))
    return obs.withColumn("_t", F.min_by(t, F.when(t.isNotNull(), F.col("source"))).over(w))


def micro_values(obs: DataFrame, site: tuple[float, float, float] | None = None) -> DataFrame:
    """obs with filled: the value, or what its class's treatment puts in its place. All classes in one pass over the series.

    Humidity goes through the dewpoint where temperature is known, else it is interpolated and clamped; radiation
    through its share of the clear sky, 0 at night.
    """
    kind = registry.class_of(F.col("variable"))
    d = _with_temperature(obs).withColumn("_kind", kind)
    rh = (F.col("variable") == "relative_humidity_2m") & F.col("_t").isNotNull()
    sky = physics.clear_sky_irradiance(F.col("datetime_utc"), *site) if site is not None else F.lit(None).cast("double")
    d = d.withColumn("_sky", F.when(F.col("_kind") == "clear_sky_indexed", sky))
    x = (
        F.when(F.col("_kind") == "circular", F.sin(F.radians("value")))
        .when(F.col("_kind") == "clear_sky_indexed", F.when(F.col("_sky") > 1, F.col("value") / F.nullif("_sky", F.lit(0.0))))
        .when(rh, physics.dewpoint(F.col("_t"), F.col("value")))
        .otherwise(F.col("value"))
    )
    d = interpolate(d, x, "_a")
    d = interpolate(d, F.when(F.col("_kind") == "circular", F.cos(F.radians("value"))).otherwise(F.col("value")), "_b")
    d = fill_rain(d).withColumnRenamed("filled", "_rain")
    bounds = registry.variables()
    low = registry.by_variable(F.col("variable"), {n: float(v.min) for n, v in bounds.items() if v.min is not None}, -1e308)
    high = registry.by_variable(F.col("variable"), {n: float(v.max) for n, v in bounds.items() if v.max is not None}, 1e308)
    new = (
        F.when(F.col("_kind") == "circular", physics.wrap_degrees(F.degrees(F.atan2("_a", "_b")) + 360))
        .when(F.col("_kind") == "intermittent", F.col("_rain"))
        .when(F.col("_kind") == "clear_sky_indexed", F.when(F.col("_sky") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_a") * F.col("_sky"))))
        .when(rh, physics.relative_humidity(F.col("_t"), F.col("_a")))
        .when(F.col("_kind") == "bounded", F.least(F.greatest(F.col("_b"), low), high))
        .otherwise(F.col("_b"))
    )
    return d.withColumn("filled", F.coalesce(F.col("value"), new)).drop("_t", "_kind", "_sky", "_a", "_b", "_rain")


def _put(df: DataFrame, columns: list[str], new: Column, method: str, where: Column | None = None, source: Column | None = None) -> DataFrame:
    """Gaps get new, its method and flag ok; what stays null stays as it was."""
    hit = F.col("value").isNull() & new.isNotNull()
    hit = hit if where is None else hit & where
    d = df.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_new": new})
    sets = {"value": F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value")), "method": F.when(F.col("_hit"), F.lit(method)).otherwise(F.col("method")), "qc_flag": F.when(F.col("_hit"), F.lit("ok")).otherwise(F.col("qc_flag"))}
    if source is not None:
        sets["source"] = F.when(F.col("_hit"), source).otherwise(F.col("source"))
    return d.withColumns(sets).select(*columns)


def fill_micro(obs: DataFrame, site: tuple[float, float, float] | None = None) -> DataFrame:
    if site is None and not obs.where((registry.class_of(F.col("variable")) == "clear_sky_indexed") & F.col("value").isNull()).isEmpty():
        raise EngineError("fill_missing_site")
    return _put(micro_values(obs, site), obs.columns, F.col("filled"), "imputed")


def fill_derive(obs: DataFrame) -> DataFrame:
    """Humidity from temperature and dewpoint, dewpoint from temperature and humidity, of ok inputs of the site and time."""
    w = Window.partitionBy("site_id", "datetime_utc")
    ok = lambda n: (F.col("variable") == n) & (F.col("qc_flag") == "ok") & F.col("value").isNotNull()
    at = lambda n: F.min_by(F.when(ok(n), F.col("value")), F.when(ok(n), F.struct("source", "value"))).over(w)
    d = obs.withColumns({"_t": at("temperature_2m"), "_td": at("dewpoint_2m"), "_rh": at("relative_humidity_2m")})
    new = F.when(F.col("variable") == "relative_humidity_2m", physics.relative_humidity(F.col("_t"), F.col("_td"))).when(F.col("variable") == "dewpoint_2m", physics.dewpoint(F.col("_t"), F.col("_rh")))
    return _put(d, obs.columns, new, "derived")


def _first_match(right: DataFrame, name: str) -> DataFrame:
    """One value for each variable and time, of the lowest source."""
    return right.where("value is not null").groupBy(F.col("variable").alias("r_var"), F.col("datetime_utc").alias("r_time")).agg(F.min_by(F.struct("value", "source"), F.struct("source", "value")).alias(name))


def _on() -> Column:
    return (F.col("variable") == F.col("r_var")) & (F.col("datetime_utc") == F.col("r_time"))


def pick_donor(donors: DataFrame) -> DataFrame:
    """donors less all but one source for each variable: of those with a value the one of best rank (column rank, else the ladder's priority), then of first name."""
    place = F.col("rank") if "rank" in donors.columns else donor_priority(F.col("source"))
    best = donors.where("value is not null").groupBy(F.col("variable").alias("p_var")).agg(F.min(F.struct(place.alias("rank"), "source")).alias("p"))
    # a row for each variable
    return donors.join(F.broadcast(best), (F.col("variable") == F.col("p_var")) & (F.col("source") == F.col("p.source"))).select(*donors.columns)


def fill_medium(obs: DataFrame, donor: DataFrame) -> DataFrame:
    """Gaps from the best donor of each variable, less its mean difference over common times; a donor without overlap as it is. The donor's source is named."""
    d = obs.join(_first_match(pick_donor(donor), "_d"), _on(), "left")
    w = Window.partitionBy("site_id", "variable")
    both = F.col("value").isNotNull() & F.col("_d.value").isNotNull()
    offset = F.coalesce(F.avg(F.when(both, F.col("_d.value"))).over(w) - F.avg(F.when(both, F.col("value"))).over(w), F.lit(0.0))
    d = d.withColumn("_moved", F.col("_d.value") - offset)
    return _put(d, obs.columns, F.col("_moved"), "donor_fill", source=F.col("_d.source"))


def fill_macro(obs: DataFrame, model: DataFrame) -> DataFrame:
    return _put(obs.join(_first_match(model, "_m"), _on(), "left"), obs.columns, F.col("_m.value"), "model_fill")


def fill_model_only(obs: DataFrame, model: DataFrame) -> DataFrame:
    """Every row that the model has a value for, gap or not."""
    d = obs.join(_first_match(model, "_m"), _on(), "left")
    hit = F.col("_m.value").isNotNull()
    return d.withColumns({"value": F.coalesce("_m.value", "value"), "method": F.when(hit, F.lit("model_fill")).otherwise(F.col("method")), "qc_flag": F.when(hit, F.lit("ok")).otherwise(F.col("qc_flag"))}).select(*obs.columns)


def fill_tier(obs: DataFrame, donor: DataFrame | None = None, model: DataFrame | None = None, site: tuple[float, float, float] | None = None, micro_hours: float = MICRO_HOURS) -> DataFrame:
    """Short gaps (by span, of all classes but intermittent) are interpolated, then humidity derived, then donors, then models; model_only variables take the model everywhere."""
    only = [n for n, v in registry.variables().items() if v.measurability_class == "model_only"]
    alone = F.col("variable").isin(only)
    short = (F.col("span_hours") <= micro_hours) & (registry.class_of(F.col("variable")) != "intermittent") & ~alone
    d = gap_runs(obs)
    d = _put(micro_values(d, site), obs.columns, F.col("filled"), "imputed", where=short)
    d = fill_derive(d)
    if donor is not None:
        d = fill_medium(d, donor.where(~alone))
    if model is not None:
        j = d.join(_first_match(model, "_m"), _on(), "left")
        hit = F.col("_m.value").isNotNull() & (alone | F.col("value").isNull())
        d = j.withColumns({"value": F.when(hit, F.col("_m.value")).otherwise(F.col("value")), "method": F.when(hit, F.lit("model_fill")).otherwise(F.col("method")), "qc_flag": F.when(hit, F.lit("ok")).otherwise(F.col("qc_flag"))}).select(*obs.columns)
    return d


__all__ = ["apply_transfer", "fill_circular", "fill_derive", "fill_linear", "fill_macro", "fill_medium", "fill_micro", "fill_model_only", "fill_rain", "fill_tier", "fit_transfer", "gap_runs", "interpolate", "pick_donor"]
