"""Hourly and local-day aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro import registry
from cirro.functions.physics import circular_mean
from cirro.schema import OBS

COMPLETE = 0.75
RAIN_DAY_HOUR = 9


def expected_per_hour(obs: DataFrame) -> DataFrame:
    """variable, expected: samples an hour by the modal gap between distinct times, of equal modes the shortest; 1 for fewer than two times.

    Neighbours are found within a day of a variable, with the first time of the next day at hand, so a
    variable's history is never in one task.
    """
    times = obs.select("variable", F.col("datetime_utc").cast("timestamp").alias("t")).distinct().withColumn("day", F.date_trunc("day", "t"))
    w = Window.partitionBy("variable", "day").orderBy("t")
    inner = times.withColumn("gap", F.unix_micros("t") - F.unix_micros(F.lag("t").over(w)))
    days = times.groupBy("variable", "day").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    across = days.withColumn("gap", F.unix_micros("first") - F.unix_micros(F.lag("last").over(Window.partitionBy("variable").orderBy("day")))).select("variable", "gap")
    gaps = inner.select("variable", "gap").unionAll(across).where("gap is not null").groupBy("variable", "gap").count()
    mode = gaps.groupBy("variable").agg(F.min_by("gap", F.struct(-F.col("count"), F.col("gap"))).alias("gap"))
    every = obs.select("variable").distinct()
    return every.join(mode, "variable", "left").select("variable", F.coalesce(F.greatest(F.lit(1), F.round(F.lit(3.6e9) / F.col("gap")).cast("int")), F.lit(1)).alias("expected"))


def class_value(variable: Column, value: Column) -> Column:
    """Aggregate of a group of one variable: sum of intermittent, vector mean of circular, mean of other values."""
    kind = F.first(registry.class_of(variable))
    return F.when(kind == "intermittent", F.sum(value)).when(kind == "circular", circular_mean(value)).otherwise(F.avg(value))


def aggregate_hourly(obs: DataFrame, by_source: bool = False, complete: float = COMPLETE) -> DataFrame:
    """Hours with at least `complete` of the samples expected; flags ok, method aggregated.

    Sources are pooled, as a caller of the plain form sees it, and the earliest row's source is named;
    by_source=True keeps them apart. Null and not-ok values don't count.
    """
    expected = expected_per_hour(obs)
    key = ["site_id", "variable", F.date_trunc("hour", "datetime_utc").alias("datetime_utc"), *(["source"] if by_source else [])]
    ok = obs.where("qc_flag = 'ok' and value is not null")
    source = [] if by_source else [F.min_by("source", F.struct("datetime_utc", "source")).alias("source")]
    hourly = ok.groupBy(*key).agg(class_value(F.col("variable"), F.col("value")).alias("value"), F.count(F.lit(1)).alias("n_ok"), *source)
    # a row for each variable
    out = hourly.join(F.broadcast(expected), "variable").where(F.col("n_ok") / F.col("expected") >= complete)
    return out.withColumns({"method": F.lit("aggregated"), "qc_flag": F.lit("ok")}).select(*OBS.names)


def local_day(variable: Column, time: Column, zone: Column | str) -> Column:
    """Local date; rain at or after nine belongs to the next day."""
    local = F.from_utc_timestamp(time, zone)
    rain = (variable == "precipitation") & (F.hour(local) >= RAIN_DAY_HOUR)
    return F.date_add(F.to_date(local), F.when(rain, 1).otherwise(0))


def day_stamp(variable: Column, day: Column, zone: Column | str) -> Column:
    """UTC instant of local midnight, for rain of nine o'clock."""
    clock = F.when(variable == "precipitation", F.lit(RAIN_DAY_HOUR)).otherwise(F.lit(0))
    return F.to_utc_timestamp(F.timestamp_add("HOUR", clock, day.cast("timestamp")), zone)


def aggregate_daily(hourly: DataFrame, zone: Column | str) -> DataFrame:
    """Local days, of 23 or 25 hours where clocks change; no completeness gate. zone: an IANA name, or a column of hourly with one."""
    day = local_day(F.col("variable"), F.col("datetime_utc"), zone)
    ok = hourly.where("qc_flag = 'ok' and value is not null").withColumn("_day", day).withColumn("_zone", zone if isinstance(zone, Column) else F.lit(zone))
    out = ok.groupBy("site_id", "variable", "_day", "_zone").agg(class_value(F.col("variable"), F.col("value")).alias("value"), F.min_by("source", F.struct("datetime_utc", "source")).alias("source"))
    out = out.withColumn("datetime_utc", day_stamp(F.col("variable"), F.col("_day"), F.col("_zone")))
    return out.withColumns({"method": F.lit("aggregated"), "qc_flag": F.lit("ok")}).select(*OBS.names)


def disaggregate_daily(daily: DataFrame, shape: DataFrame, zone: str) -> DataFrame:
    """Twenty-four hourly rows of each daily value, after a shape (hour 0..23, value; by site and variable if it has them).

    Rain: shape / sum * total, 0 if either is 0. temperature_2m_max and _min together: the shape stretched to
    [min, max], the midpoint if it is flat. Other variables: the shape moved to the daily mean.
    daily: site_id, day (date), variable, value.
    """
    keys = [c for c in ("site_id", "variable") if c in shape.columns]
    base = F.regexp_replace("variable", "_(max|min)$", "")
    d = daily.withColumn("base", base).groupBy("site_id", "day", F.col("base").alias("variable")).agg(
        F.max(F.when(F.col("variable").endswith("_max"), F.col("value"))).alias("hi"),
        F.max(F.when(F.col("variable").endswith("_min"), F.col("value"))).alias("lo"),
        F.max(F.when(F.col("variable") == F.col("base"), F.col("value"))).alias("total"),
    )
    stats = shape.groupBy(*keys).agg(F.sum("value").alias("s"), F.min("value").alias("mn"), F.max("value").alias("mx"), F.avg("value").alias("mean"), F.collect_list(F.struct("hour", F.col("value").alias("x"))).alias("shape"))
    j = d.join(stats, keys) if keys else d.crossJoin(F.broadcast(stats))  # without keys there is one shape
    x = F.col("h.x")
    rain = F.when((F.col("s") == 0) | (F.col("total") == 0), 0.0).otherwise(x / F.nullif("s", F.lit(0.0)) * F.col("total"))
    pair = F.when(F.col("mx") == F.col("mn"), (F.col("hi") + F.col("lo")) / 2).otherwise(F.col("lo") + (x - F.col("mn")) / F.nullif(F.col("mx") - F.col("mn"), F.lit(0.0)) * (F.col("hi") - F.col("lo")))
    value = F.when(F.col("variable") == "precipitation", rain).when(F.col("hi").isNotNull() & F.col("lo").isNotNull(), pair).otherwise(F.col("total") + x - F.col("mean"))
    e = j.withColumn("h", F.explode("shape"))
    time = F.timestamp_add("HOUR", F.col("h.hour"), F.to_utc_timestamp(F.col("day").cast("timestamp"), zone))
    return e.select("site_id", time.alias("datetime_utc"), "variable", value.alias("value"), F.lit("disaggregated").alias("method")).where("value is not null")
