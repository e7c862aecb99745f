"""Stations and donors by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro.functions.physics import haversine_km

# Priority of sources as donors (fixed values); others come after.
PRIORITY = {"bom_obs": 1, "ghcnh": 2, "openmeteo": 3, "silo": 4}


def nearest_stations(catalogue: DataFrame, latitude: float, longitude: float, n: int) -> DataFrame:
    """The n nearest, each identity once; ties by station id. A top-n, never a full sort."""
    d = catalogue.withColumn("distance_km", haversine_km(latitude, longitude, F.col("latitude"), F.col("longitude")))
    return dedup_by_identity(d, "station_id").orderBy("distance_km", "station_id").limit(n)


def dedup_by_identity(df: DataFrame, tie: str) -> DataFrame:
    """Of rows of one identity the nearest; null identities stay apart."""
    own = df.withColumn("_own", F.coalesce(F.col("identity").cast("string"), F.concat(F.lit("\x00"), F.col(tie).cast("string"))))
    rest = [c for c in df.columns]
    return own.groupBy("_own").agg(F.min_by(F.struct(*rest), F.struct("distance_km", tie)).alias("r")).select("r.*")


def donor_priority(source: Column) -> Column:
    """A source's place on the ladder; sources that aren't on it come last."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[source], F.lit(5))


def rank_donors(donors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """donors (source, identity, distance_km) with priority and rank, each identity once (nearest, then higher priority), by priority and distance."""
    d = donors.withColumn("priority", donor_priority(F.col("source")))
    rest = d.columns
    own = F.coalesce(F.col("identity").cast("string"), F.concat(F.lit("\x00"), F.col("source")))
    once = d.groupBy(*by, own.alias("_own")).agg(F.min_by(F.struct(*[c for c in rest if c not in by]), F.struct("distance_km", "priority", "source")).alias("r")).select(*by, "r.*")
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a site's donors are a configured few
    return once.withColumn("rank", F.row_number().over(w.orderBy("priority", "distance_km", "source")))


def station_coverage(obs: DataFrame, start, end) -> DataFrame:
    """variable, coverage: non-null values in the window over its hourly slots, both ends counted."""
    slots = int((end - start).total_seconds() // 3600) + 1
    inside = obs.where(F.col("datetime_utc").between(F.lit(start), F.lit(end)))
    return inside.groupBy("variable").agg((F.count("value") / slots).alias("coverage"))
