"""Streaming extensions against their batch forms, and the verbs that test_core leaves out."""

import datetime as dt

import pytest

from cirro.errors import EngineError
from cirro.operators import aggregate, qc
from cirro.plans import serve, verbs
from cirro.sources.base import Adapter
from cirro.store import Store
from cirro.streaming import extensions
from tests.test_core import SITE, T0, Fake, H, forecast, obs, rows


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def _stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_windows_equal_batch_hours(spark, tmp_path):
    df = obs(spark, rows([1, 2, 3, 4, 5, 6], step=dt.timedelta(minutes=20)), rows([1, 2], "precipitation", step=dt.timedelta(minutes=30)))
    q = extensions.hourly_windows(_stream(spark, df, str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["variable"], r["datetime_utc"].hour): r["value"] for r in spark.table("hours").collect()}
    want = {(r["variable"], r["datetime_utc"].hour): r["value"] for r in aggregate.aggregate_hourly(df, complete=0).collect()}
    assert got == want


def test_late_data_supersede_and_replays_change_nothing(spark, store, tmp_path):
    store.write_obs(obs(spark, rows([20, 21])), T0, "supersede")
    for n in range(2):
        extensions.supersede_stream(_stream(spark, obs(spark, rows([22, 21])), str(tmp_path / f"in{n}")), store, str(tmp_path / f"cp{n}"), lambda: T0 + H).awaitTermination(120)
    assert [r["value"] for r in store.read_obs("test").orderBy("datetime_utc").collect()] == [22, 21]
    assert store.read_obs("test", include_superseded=True).count() == 3


def test_stream_deduplicates_forecasts(spark, tmp_path):
    fc = forecast(spark, [1, 2])
    q = extensions.deduplicated_forecasts(_stream(spark, fc.unionAll(fc).drop("lead_time"), str(tmp_path / "in"))).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_live_sync_skips_slow_sources_and_degrades(spark, store):
    now = T0 + 3 * H

    class Slow(Fake):
        def __init__(self):
            super().__init__(lambda: 1 / 0)
            self.cadence = {"live": False}

    give = lambda s: {"a": Fake(lambda: obs(spark, rows([15, 16, 17])), lambda: forecast(spark, [1])), "b": Slow()}
    out = verbs.met_sync_live(store, SITE, now, {"forecast_sources": ["a"]}, give)
    assert out[0]["status"] == "ok" and store.watermark("test", "live") == now and store.read_obs("test").count() == 3
    bad = verbs.met_sync_live(store, SITE, now, {}, lambda s: {"a": Fake(lambda: 1 / 0)})
    assert bad[0]["status"] == "degraded"


def test_backfill_reports_coverage_and_stops_on_errors(spark, store):
    now = T0 + 5 * H
    export = Fake(lambda: obs(spark, rows([1.0], "precipitation", source="export")))
    export.provides = ("precipitation",)
    out = verbs.met_backfill(store, SITE, now, {}, lambda s: {"a": Fake(lambda: obs(spark, rows([15, 16, 17])))}, {"test": export})
    assert out[0]["status"] == "ok" and set(out[0]["coverage"]) == {"temperature_2m", "precipitation"} and set(out[0]["notes"]) == {"bom_forecast", "openmeteo"}
    with pytest.raises(ZeroDivisionError):
        verbs.met_backfill(store, SITE, now, {}, lambda s: {"a": Fake(lambda: 1 / 0)})


def test_archive_twice_adds_nothing(spark, store):
    a = {"m": Fake(None, lambda: forecast(spark, [1, 2, 3]))}
    assert [verbs.archive_forecasts(store, SITE, a, T0)["added"]["m"] for _ in range(2)] == [3, 0]
    assert list(verbs.archive_forecasts(store, SITE, a, T0, missed=True)["notes"]) == ["m"]


def test_qc_and_fill_are_incremental(spark, store):
    store.write_obs(obs(spark, rows([15, 40, None, 16])), T0, "supersede")
    first = verbs.qc_run(store, SITE, T0 + 4 * H)
    again = verbs.qc_run(store, SITE, T0 + 4 * H)
    assert first["n_flagged"] >= 1 and again["n_flagged"] == 0
    assert verbs.fill_run(store, SITE, T0 + 4 * H) >= 1 and verbs.fill_run(store, SITE, T0 + 4 * H) == 0
    assert store.read_qc_log("test").where("rule = 'step'").count() >= 1
    assert set(qc.rules_for("cape")) & {"spatial"} == set() and "solar" in qc.rules_for("direct_radiation")


def test_wide_record_and_single_site(spark, store):
    store.write_obs(obs(spark, rows([15, 16]), rows([1, 2], "precipitation")), T0)
    w = serve.met_wide(store, SITE, (T0, T0 + 5 * H), "record", ["temperature_2m", "cape"])
    assert w.df.count() == 2 and w.provenance["cape"]["tier"] == "unverified" and w.provenance["temperature_2m"]["tier"] == "raw"
    assert "temperature_2m: raw" in repr(w)
    with pytest.raises(EngineError):
        serve.met_wide(store, SITE, (T0, T0), "nothing")
    fc = serve.correct_apply(store, SITE, "src", "record", T0)
    assert {r["tier"] for r in fc.collect()} == {"physical"} and fc.count() == 4


def test_adapter_defaults(spark):
    a = Adapter("x", ("temperature_2m",))
    assert a.resolve_station(SITE) is SITE and a.attribution is None
    for f in (a.fetch_forecast, lambda *x: a.fetch_forecast_aux(*x[:2], *x[3:])):
        with pytest.raises(EngineError):
            f(spark, SITE, [], (None, None), T0)


def test_envelope_flags_outliers(spark):
    history = obs(spark, rows([15 + i % 3 for i in range(400)], step=dt.timedelta(days=1), start=dt.datetime(2024, 1, 1)))
    flags = [r["qc_flag"] for r in qc.qc_climatology(obs(spark, rows([16, 40])), qc.climatology_envelope(history)).orderBy("datetime_utc").collect()]
    assert flags == ["ok", "suspect"]
