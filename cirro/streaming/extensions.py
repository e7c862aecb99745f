"""Streaming forms of the batch operators. Extensions: the batch verbs need none of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cirro import schema
from cirro.operators.aggregate import class_value
from cirro.store import Store


def hourly_windows(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly values of an unbounded stream of observations; hours close `late` after their end."""
    ok = stream.where("qc_flag = 'ok' and value is not null").withWatermark("datetime_utc", late)
    out = ok.groupBy(F.window("datetime_utc", "1 hour"), "site_id", "variable").agg(class_value(F.col("variable"), F.col("value")).alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select("site_id", "variable", F.col("window.start").alias("datetime_utc"), "value", "n")


def deduplicated_forecasts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """First rows of each forecast key within the watermark."""
    return stream.withWatermark("issue_time", late).dropDuplicatesWithinWatermark([c for c in schema.FORECAST_KEY if c != "issue_time"] + ["issue_time"])


def supersede_stream(stream: DataFrame, store: Store, checkpoint: str, now=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)) -> StreamingQuery:
    """Each micro-batch is upserted; late data supersede and are never dropped. Replays of a batch change nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.write_obs(batch.dropDuplicates(list(schema.OBS_KEY)), now(), "supersede", check=False)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
