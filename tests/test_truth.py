"""Cases that a green query can't show: limits, flags, hashes, choices."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from cirro import registry
from cirro.operators import correct, fill, qc
from cirro.plans import verbs
from cirro.plans.table import MetTable
from tests.test_core import SITE, T0, H, col, forecast, obs, rows, store  # noqa: F401

PLACE = (SITE.latitude, SITE.longitude, SITE.elevation)


def test_long_series_are_filled_in_proportion(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("s").alias("site_id"), F.timestamp_seconds(F.col("id") * 600).alias("datetime_utc"), F.lit("temperature_2m").alias("variable"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("value"), F.lit("x").alias("source"))
    began = time.time()
    off = fill.fill_linear(df).agg(F.max(F.abs(F.col("filled") - F.least(F.unix_seconds("datetime_utc") / 600, F.lit(float((n - 1) // 7 * 7)))))).first()[0]
    rain = fill.fill_rain(df).where("filled is null").count()
    assert off < 1e-6 and rain == 0 and time.time() - began < 30


def test_radiation_is_held_against_the_sky(spark):
    noon = dt.datetime(2026, 1, 1, 2)
    df = obs(spark, rows([1300], "direct_radiation", start=noon), rows([990], "diffuse_radiation", start=noon))
    cut = {r["variable"]: r["value"] for r in qc.consistency_pass_long(df, ["site_id", "datetime_utc"], PLACE).collect()}
    assert 500 < sum(cut.values()) < 1400 and cut["direct_radiation"] / cut["diffuse_radiation"] == pytest.approx(1300 / 990)
    assert set(col(qc.run_rules(df, site=PLACE).where("array_contains(hits.rule, 'consistency')"), "variable")) == {"direct_radiation", "diffuse_radiation"}
    assert sum(col(qc.consistency_pass_long(df, ["site_id", "datetime_utc"]), "value")) == 2290


def test_model_only_variables_have_no_neighbours(spark):
    df = obs(spark, rows([90], "wind_speed_80m"), rows([90], "wind_speed_10m"))
    donors = obs(spark, *[rows([x], v, source=f"d{x}") for x in (3, 4, 5) for v in ("wind_speed_80m", "wind_speed_10m")])
    got = {r["variable"]: [h["rule"] for h in r["hits"]] for r in qc.run_rules(df, donors).collect()}
    assert "spatial" in got["wind_speed_10m"] and "spatial" not in got["wind_speed_80m"]


def test_rules_that_cannot_run_are_logged_once(spark, store):  # noqa: F811
    store.write_obs(obs(spark, rows([20, 21, 22]), rows([5, 5.5, 6], "wind_speed_80m")), T0)
    out = verbs.qc_run(store, SITE, T0 + dt.timedelta(days=1))
    log = sorted((r["variable"], r["rule"], r["outcome"], r["detail"]) for r in store.read_qc_log("test").where("detail like 'skipped%'").collect())
    assert log == [("temperature_2m", "climatology", "ok", "skipped: no climatology yet"), ("temperature_2m", "spatial", "ok", "skipped: no donors"), ("wind_speed_80m", "climatology", "ok", "skipped: no climatology yet")] and out["n_flagged"] == 0


def test_changed_values_stay_marked_through_filter_and_union(spark):
    df = spark.createDataFrame([(T0, 1.0), (T0 + H, 3.0)], "time timestamp, x double")
    table = MetTable(df, {"x": {"tier": "qmap", "train_overlap": 24, "source": "s"}})
    assert table.filter("x > 1").validate().provenance["x"]["tier"] == "qmap"
    with pytest.warns(UserWarning):
        changed = table.with_column("x", F.lit(99.0)).filter("true").validate()
    with pytest.warns(UserWarning):
        joined = table.with_column("x", F.lit(99.0)).union(table).validate()
    assert changed.provenance["x"]["tier"] == joined.provenance["x"]["tier"] == "unverified"


def test_one_donor_fills_by_the_ladder(spark):
    gap = obs(spark, rows([10, None, None, 13]))
    donors = obs(spark, rows([20, 21, None, 23], source="bom_obs"), rows([99, 99, 99, 99], source="aaa"))
    out = fill.fill_medium(gap, donors).orderBy("datetime_utc").collect()
    assert [r["value"] for r in out] == [10, 11, None, 13] and out[1]["source"] == "bom_obs"


def test_a_refit_without_a_win_writes_nothing(spark, store):  # noqa: F811
    start, day = dt.datetime(2025, 1, 1), dt.timedelta(days=1)
    truth = [15 + (i * 37 % 11 - 5) / 5 for i in range(300)]
    store.write_obs(obs(spark, rows(truth, start=start, step=day)), T0)
    store.write_forecast(forecast(spark, [x + 4 for x in truth], start=start, step=day))
    first = verbs.correct_refit(store, SITE, "model", "temperature_2m", T0)
    again = verbs.correct_refit(store, SITE, "model", "temperature_2m", T0)
    assert first["action"] == "promoted" and again == {"variable": "temperature_2m", "source": "model", "action": "kept", "tier": first["tier"]} and len(store.manifest("test")) == 1


def test_an_empty_report_replaces_the_old_one(spark, store):  # noqa: F811
    row = spark.createDataFrame([("test", "m", "temperature_2m", "d1", "raw", 3, 1.0, 1.0)], "site_id string, source string, variable string, lead_bucket string, tier string, n_pairs int, mae double, rmse double")
    store.write_report(row)
    assert store.read_report("test").count() == 1
    store.write_report(row.limit(0), ["test"])
    assert store.read_report("test").count() == 0


def test_text_files_are_replaced_whole(store):  # noqa: F811
    for k in range(3):
        store.set_watermark("test", "qc", T0 + k * H)
    assert store.watermark("test", "qc") == T0 + 2 * H


def test_winds_aloft_follow_ten_metres(spark):
    df = obs(spark, rows([8, 8], "wind_speed_80m"))
    assert set(col(correct.model_only_correct(df), "tier")) == {"raw"}
    ten = spark.createDataFrame([("test", T0, 6.0, 5.0)], "site_id string, datetime_utc timestamp, corrected double, raw double")
    assert col(correct.model_only_correct(df, ten), "value") == [pytest.approx(8 * (1 + 0.2 / 8)), 8]


def test_notes_go_by_source():
    notes = verbs.missed_notes(["bom_forecast", "openmeteo", "other"])
    assert "again" in notes["bom_forecast"] and "later" in notes["openmeteo"] and "not known" in notes["other"] and len(registry.variables()) == 23
