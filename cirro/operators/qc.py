"""Quality rules. A rule gives a rank (0 ok to 3 missing); flags only ever get worse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro import registry
from cirro.errors import EngineError
from cirro.functions import physics
from cirro.operators.reshape import widen_obs
from cirro.schema import OBS

# Largest step between consecutive samples (fixed values).
STEP_LIMITS = {
    "temperature_2m": 8, "dewpoint_2m": 8, "surface_pressure": 15, "pressure_msl": 15,
    "relative_humidity_2m": 40, "wind_speed_10m": 25, "wind_gusts_10m": 40,
    "wind_speed_80m": 25, "wind_speed_120m": 25, "wind_speed_180m": 25,
    "wind_direction_10m": 150, "wind_direction_80m": 150, "wind_direction_120m": 150, "wind_direction_180m": 150,
    "cloud_cover": 100, "boundary_layer_height": 3000, "direct_radiation": 1200, "diffuse_radiation": 800,
}
PERSISTENCE_RUN = 6
MAD_SCALE, MAD_LIMIT = 1.4826, 3.5
SUSPECT, FAIL = 1, 2
SERIES = ("site_id", "source", "variable")


def series() -> Window:
    return Window.partitionBy(*SERIES).orderBy("datetime_utc")


def downgrade(flag: Column, rank: Column) -> Column:
    return registry.flag_name(F.greatest(registry.flag_rank(flag), F.coalesce(rank, F.lit(0))))


def _apply(obs: DataFrame, rank: Column) -> DataFrame:
    """obs with qc_flag worsened by rank; columns of obs in their order."""
    return obs.withColumn("_rank", rank).withColumn("qc_flag", downgrade(F.col("qc_flag"), F.col("_rank"))).select(*obs.columns)


def range_rank() -> Column:
    v = registry.variables()
    low = registry.by_variable(F.col("variable"), {n: float(x.min) for n, x in v.items() if x.min is not None})
    high = registry.by_variable(F.col("variable"), {n: float(x.max) for n, x in v.items() if x.max is not None})
    return F.when((F.col("value") < low) | (F.col("value") > high), FAIL).otherwise(0)


def step_value() -> Column:
    """Distance to the sample before in the series, around the circle for circular variables."""
    periods = {n: float(x.circular_period) for n, x in registry.variables().items() if x.circular_period}
    before = F.lag("value").over(series())
    period = registry.by_variable(F.col("variable"), periods)
    return F.when(period.isNotNull(), physics.circular_distance(F.col("value"), before, period)).otherwise(F.abs(F.col("value") - before))


def step_rank() -> Column:
    limits = {n: float(STEP_LIMITS[n]) if n in STEP_LIMITS else (x.max - x.min) / 2.0 for n, x in registry.variables().items() if n in STEP_LIMITS or (x.min is not None and x.max is not None)}
    on = registry.class_of(F.col("variable")) != "intermittent"
    return F.when(on & (step_value() > registry.by_variable(F.col("variable"), limits)), SUSPECT).otherwise(0)


def with_run_length(obs: DataFrame) -> DataFrame:
    """run_length: how many consecutive samples have this value; nulls end a run and have null."""
    w = series()
    changed = F.coalesce((F.lag("value").over(w) != F.col("value")).cast("int"), F.lit(1))
    run = obs.withColumn("_run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.withColumn("run_length", F.when(F.col("value").isNotNull(), F.count("value").over(Window.partitionBy(*SERIES, "_run")))).drop("_run")


def qc_range(obs: DataFrame) -> DataFrame:
    return _apply(obs, range_rank())


def qc_step(obs: DataFrame) -> DataFrame:
    return _apply(obs, step_rank())


def qc_persistence(obs: DataFrame) -> DataFrame:
    on = registry.class_of(F.col("variable")) != "intermittent"
    out = with_run_length(obs)
    return out.withColumn("qc_flag", downgrade(F.col("qc_flag"), F.when(on & (F.col("run_length") > PERSISTENCE_RUN), SUSPECT).otherwise(0))).select(*obs.columns)


def climatology_envelope(history: DataFrame, low: float = 0.001, high: float = 0.999, window_days: int = 7) -> DataFrame:
    """variable, day_of_year, p_low, p_high over days of the year within window_days, around the year's end."""
    doy = history.where("value is not null").select("variable", "value", F.dayofyear("datetime_utc").alias("d"))
    days = F.transform(F.sequence(F.lit(-window_days), F.lit(window_days)), lambda k: F.pmod(F.col("d") - 1 + k, F.lit(366)) + 1)
    p = F.percentile("value", F.array(F.lit(low), F.lit(high)))
    return doy.select("variable", "value", F.explode(days).alias("day_of_year")).groupBy("variable", "day_of_year").agg(p[0].alias("p_low"), p[1].alias("p_high"))


def qc_climatology(obs: DataFrame, envelope: DataFrame) -> DataFrame:
    """Values outside their day's envelope are suspect; days without one say nothing. The envelope has 366 rows a variable."""
    e = F.broadcast(envelope.select(F.col("variable").alias("e_var"), F.col("day_of_year").alias("e_day"), "p_low", "p_high"))
    j = obs.join(e, (F.col("variable") == F.col("e_var")) & (F.dayofyear("datetime_utc") == F.col("e_day")), "left")
    bad = (F.col("value") < F.col("p_low")) | (F.col("value") > F.col("p_high"))
    return j.withColumn("qc_flag", downgrade(F.col("qc_flag"), F.when(bad, SUSPECT).otherwise(0))).select(*obs.columns)


def donor_consensus(donors: DataFrame) -> DataFrame:
    """variable, datetime_utc, med, mad (scaled), n of ok donor values, at least two."""
    ok = donors.where("qc_flag = 'ok' and value is not null").groupBy("variable", "datetime_utc").agg(F.collect_list("value").alias("xs"))
    two = ok.where(F.size("xs") >= 2).withColumn("s", F.array_sort("xs"))
    mid = lambda a: (F.get(a, ((F.size(a) - 1) / 2).cast("int")) + F.get(a, (F.size(a) / 2).cast("int"))) / 2
    med = two.withColumn("med", mid(F.col("s")))
    off = med.withColumn("o", F.array_sort(F.transform("xs", lambda x: F.abs(x - F.col("med")))))
    return off.select("variable", "datetime_utc", "med", (mid(F.col("o")) * MAD_SCALE).alias("mad"), F.size("xs").alias("n"))


def qc_spatial(obs: DataFrame, donors: DataFrame) -> DataFrame:
    """Values over 3.5 scaled deviations from the neighbours' median at that time are suspect."""
    alone = [n for n, v in registry.variables().items() if v.measurability_class == "model_only"]
    if not obs.where(F.col("variable").isin(alone)).isEmpty():
        raise EngineError("spatial_not_applicable")
    c = donor_consensus(donors).withColumnsRenamed({"variable": "c_var", "datetime_utc": "c_time"})
    j = obs.join(c, (F.col("variable") == F.col("c_var")) & (F.col("datetime_utc") == F.col("c_time")), "left")
    bad = (F.col("mad") > 0) & (F.abs(F.col("value") - F.col("med")) / F.nullif("mad", F.lit(0.0)) > MAD_LIMIT)
    return j.withColumn("qc_flag", downgrade(F.col("qc_flag"), F.when(bad, SUSPECT).otherwise(0))).select(*obs.columns)


def solar_rank(latitude: Column | float, longitude: Column | float) -> Column:
    t, x = F.col("datetime_utc"), F.col("value")
    up = physics.cos_zenith(t, latitude, longitude) > 0
    limit = lambda s, p: physics.radiation_limit(t, latitude, longitude, s, p)
    fail = (~up & (x > 1)) | (up & (x > limit(1.5, 100)))
    rank = F.when(fail, FAIL).when(up & (x > limit(1.2, 50)), SUSPECT).otherwise(0)
    return F.when(registry.class_of(F.col("variable")) == "clear_sky_indexed", rank).otherwise(0)


def qc_solar(obs: DataFrame, latitude: Column | float, longitude: Column | float) -> DataFrame:
    return _apply(obs, solar_rank(latitude, longitude))


CEILING = "clear_sky_ceiling"
# Relations between variables of one time, in the order in which they are enforced (fixed values): left sides, relation, right side.
RELATIONS = (
    (("dewpoint_2m",), "le", "temperature_2m"),
    (("relative_humidity_2m",), "le", 100.0),
    (("wind_gusts_10m",), "ge", "wind_speed_10m"),
    (("direct_radiation", "diffuse_radiation"), "le", CEILING),
)


def _relation(columns: list[str], spec: tuple) -> Column | None:
    """Is the relation violated? None if a column lacks; nulls violate nothing."""
    left, op, right = spec
    if not {*left, *([right] if isinstance(right, str) else [])} <= set(columns):
        return None
    total = reduce(lambda a, b: a + b, map(F.col, left))
    bound = F.col(right) if isinstance(right, str) else F.lit(right)
    return F.coalesce(total > bound if op == "le" else total < bound, F.lit(False))


def consistency_flags(wide: DataFrame) -> DataFrame:
    """violated, and flag_<left side> for every relation whose columns are there."""
    flags: dict[str, Column] = {}
    hit = F.lit(False)
    for spec in RELATIONS:
        bad = _relation(wide.columns, spec)
        if bad is not None:
            hit = hit | bad
            for v in spec[0]:
                flags[f"flag_{v}"] = F.when(bad, "suspect").otherwise(flags.get(f"flag_{v}", F.lit("ok")))
    return wide.withColumns(flags | {"violated": hit})


def enforce_consistency(wide: DataFrame) -> DataFrame:
    """Left sides cut to what the relations allow, in order, sums in proportion; n_violations counts them."""
    out, count = wide, F.lit(0)
    out = out.withColumn("n_violations", count)
    for spec in RELATIONS:
        bad = _relation(out.columns, spec)
        if bad is None:
            continue
        left, _, right = spec
        bound = F.col(right) if isinstance(right, str) else F.lit(right)
        total = reduce(lambda a, b: a + b, map(F.col, left))
        new = {v: F.when(bad, bound if len(left) == 1 else F.col(v) * bound / F.nullif(total, F.lit(0.0))).otherwise(F.col(v)) for v in left}
        out = out.withColumns(new | {"n_violations": F.col("n_violations") + bad.cast("int")})
    return out


def consistency_pass_long(long: DataFrame, keys: list[str], site: tuple[float, float, float] | None = None, time: str = "datetime_utc") -> DataFrame:
    """The same over (variable, value) rows that share keys; one shuffle, no pivot and join back.

    The sky's ceiling is a variable of its own where there is such a row, else what a cloudless sky gives at the site (latitude, longitude,
    elevation); without either radiation stays as it is.
    """
    names = sorted({v for left, _, right in RELATIONS for v in (*left, *([right] if isinstance(right, str) else []))})
    w = Window.partitionBy(*keys)
    wide = long.withColumns({n: F.max(F.when(F.col("variable") == n, F.col("value"))).over(w) for n in names})
    if site is not None:
        wide = wide.withColumn(CEILING, F.coalesce(CEILING, physics.clear_sky_irradiance(F.col(time), *site)))
    done = enforce_consistency(wide)
    new = F.coalesce(*[F.when(F.col("variable") == n, F.col(n)) for n in names], F.col("value"))
    return done.withColumn("value", new).select(*long.columns)


def consistency_rank(site: tuple[float, float, float] | None = None) -> Column:
    """Rank by the relations of the row's own variable, over rows of one site and time; radiation is held against the cloudless sky if the site (latitude, longitude, elevation) is known."""
    w = Window.partitionBy("site_id", "datetime_utc")
    at = lambda n: F.min_by(F.when(F.col("variable") == n, F.col("value")), F.when(F.col("variable") == n, F.struct("source", "value"))).over(w)
    out = F.lit(0)
    for left, op, right in RELATIONS:
        bound = at(right) if isinstance(right, str) else F.lit(right)
        if right == CEILING and site is not None:
            bound = F.coalesce(bound, physics.clear_sky_irradiance(F.col("datetime_utc"), *site))
        x = reduce(lambda a, b: a + b, map(at, left))
        out = F.when(F.col("variable").isin(*left) & F.coalesce(x > bound if op == "le" else x < bound, F.lit(False)), SUSPECT).otherwise(out)
    return out


def rules_for(variable: str) -> list[str]:
    v = registry.variable(variable)
    rules = ["range", "climatology", "consistency"]
    if v.statistical_class != "intermittent":
        rules += ["step", "persistence"]
    if v.measurability_class != "model_only":
        rules.append("spatial")
    if v.statistical_class == "clear_sky_indexed":
        rules.append("solar")
    return sorted(rules)


def run_rules(obs: DataFrame, donors: DataFrame | None = None, envelope: DataFrame | None = None, site: tuple[float, float, float] | None = None) -> DataFrame:
    """obs with new flags and hits, an array of (rule, outcome) of what was found; all rules in one plan.

    site: latitude, longitude, elevation. Each variable has the rules that rules_for() names. Step and persistence share one window; without donors, envelope or site their rules are left out.
    """
    out = with_run_length(obs)
    has = lambda rule: F.col("variable").isin([n for n in registry.variables() if rule in rules_for(n)])
    ranks = {"range": range_rank(), "step": step_rank(), "persistence": F.when(has("persistence") & (F.col("run_length") > PERSISTENCE_RUN), SUSPECT).otherwise(0), "consistency": consistency_rank(site)}
    if site is not None:
        ranks["solar"] = solar_rank(*site[:2])
    out = out.withColumns({f"_{k}": r for k, r in ranks.items()})
    if donors is not None:
        c = donor_consensus(donors).withColumnsRenamed({"variable": "c_var", "datetime_utc": "c_time"})
        out = out.join(c, (F.col("variable") == F.col("c_var")) & (F.col("datetime_utc") == F.col("c_time")), "left")
        out = out.withColumn("_spatial", F.when(has("spatial") & (F.col("mad") > 0) & (F.abs(F.col("value") - F.col("med")) / F.nullif("mad", F.lit(0.0)) > MAD_LIMIT), SUSPECT).otherwise(0))
    if envelope is not None:
        e = F.broadcast(envelope.select(F.col("variable").alias("e_var"), F.col("day_of_year").alias("e_day"), "p_low", "p_high"))
        out = out.join(e, (F.col("variable") == F.col("e_var")) & (F.dayofyear("datetime_utc") == F.col("e_day")), "left")
        out = out.withColumn("_climatology", F.when((F.col("value") < F.col("p_low")) | (F.col("value") > F.col("p_high")), SUSPECT).otherwise(0))
    names = [*ranks, *(["spatial"] if donors is not None else []), *(["climatology"] if envelope is not None else [])]
    hits = F.filter(F.array(*[F.when(F.coalesce(F.col(f"_{k}"), F.lit(0)) > 0, F.struct(F.lit(k).alias("rule"), registry.flag_name(F.col(f"_{k}")).alias("outcome"))) for k in names]), lambda x: x.isNotNull())
    worst = F.greatest(F.lit(0), *[F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in names]) if names else F.lit(0)
    return out.withColumn("hits", hits).withColumn("qc_flag", downgrade(F.col("qc_flag"), worst)).select(*OBS.names, "hits")


def log_of(ruled: DataFrame) -> DataFrame:
    e = ruled.select("site_id", "datetime_utc", "variable", F.explode("hits").alias("h"))
    return e.select("site_id", "datetime_utc", "variable", F.col("h.rule").alias("rule"), F.col("h.outcome").alias("outcome"), F.concat(F.col("h.rule"), F.lit(" rule")).alias("detail"))


def skipped(obs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Log rows, one for each site, variable and rule that couldn't be held against it: rules gives the reason. Stamped with the variable's first time."""
    first = obs.groupBy("site_id", "variable").agg(F.min("datetime_utc").alias("datetime_utc"))
    has = reduce(lambda a, b: a | b, [(F.col("rule") == k) & F.col("variable").isin([n for n in registry.variables() if k in rules_for(n)]) for k in rules], F.lit(False))
    why = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v).alias("why")) for k, v in rules.items()])
    e = first.withColumn("s", F.explode(why)).select("site_id", "datetime_utc", "variable", F.col("s.rule").alias("rule"), F.lit("ok").alias("outcome"), F.concat(F.lit("skipped: "), F.col("s.why")).alias("detail"))
    return e.where(has)


def flag_wide(obs: DataFrame, variables: list[str]) -> DataFrame:
    return consistency_flags(widen_obs(obs, variables))
