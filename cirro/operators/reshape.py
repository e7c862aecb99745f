"""Long to wide and back, latest issuances, keyed picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro.schema import OBS


def _pick(variables: list[str], value: Column, order: list[Column]) -> list[Column]:
    return [F.min_by(F.when(F.col("variable") == v, value), F.when(F.col("variable") == v, F.struct(*order))).alias(v) for v in variables]


def widen_obs(obs: DataFrame, variables: list[str], extra_key: tuple[str, ...] = ()) -> DataFrame:
    """A row for each (site, time) in obs, a column for each variable; of several rows the lowest source's counts, absent variables are null. One aggregation, no pivot pass."""
    order = [F.col("source"), F.col("value")]
    return obs.groupBy("site_id", *extra_key, "datetime_utc").agg(*_pick(variables, F.col("value"), order))


def narrow_obs(wide: DataFrame, source: str, method: str = "measured", qc_flag: str = "ok") -> DataFrame:
    """Value columns stacked; nulls are left out."""
    values = [c for c in wide.columns if c not in ("site_id", "datetime_utc")]
    long = wide.unpivot(["site_id", "datetime_utc"], [F.col(c).cast("double").alias(c) for c in values], "variable", "value").where("value is not null")
    return long.select("site_id", "datetime_utc", "variable", "value", F.lit(source).alias("source"), F.lit(method).alias("method"), F.lit(qc_flag).alias("qc_flag")).select(*OBS.names)


def widen_forecast(fc: DataFrame, variables: list[str], key: tuple[str, ...] = ()) -> DataFrame:
    """A row for each valid time, the mean over members; statistics don't count but keep their times."""
    plain = F.col("stat").isNull()
    return fc.groupBy(*key, "valid_time").agg(*[F.avg(F.when(plain & (F.col("variable") == v), F.col("value"))).alias(v) for v in variables])


def latest_issuance(fc: DataFrame, by: tuple[str, ...] = ("site_id", "source", "model")) -> DataFrame:
    """Rows of the newest issue time of each source and model; a null model is one of its own."""
    newest = fc.groupBy(*[F.col(c).alias(f"_n_{c}") for c in by]).agg(F.max("issue_time").alias("_newest"))  # a row for each source and model
    same = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in by]
    return fc.join(newest, [*same, F.col("issue_time") == F.col("_newest")], "left_semi")


def newest_per_key(df: DataFrame, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row for each key, the greatest by order (last-write-wins, as-of reads, current versions); an aggregation, so that partial maxima go before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def lead_bucket(lead_hours: Column) -> Column:
    """d1, d2, ... by days begun; dNA for a null lead."""
    days = F.greatest(F.lit(1), F.ceil(lead_hours / 24))
    return F.when(lead_hours.isNull(), "dNA").otherwise(F.concat(F.lit("d"), days.cast("string")))
