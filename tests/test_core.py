import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cirro import registry, schema, sites
from cirro.errors import CODES, EngineError
from cirro.functions import physics
from cirro.operators import aggregate, correct, fill, qc, reshape, stations, transfer, verify
from cirro.plans.table import MetTable, assert_single_tier, ingest
from cirro.plans import serve, verbs
from cirro.sites import Instrument, Site, Sites
from cirro.sources import base, http, vendors
from cirro.store import Store

T0 = dt.datetime(2026, 1, 1)
H = dt.timedelta(hours=1)
SITE = Site("test", -34.75, 148.2, 220.0, "Australia/Sydney", instruments=(Instrument("mast", ("wind_speed_10m",), 2.0, 0.03), Instrument("thermo", ("temperature_2m",), 2.0)))


def rows(values, variable="temperature_2m", start=T0, step=H, site="test", source="src", flag=None):
    return [(site, start + i * step, variable, None if v is None else float(v), source, "measured", flag or ("missing" if v is None else "ok")) for i, v in enumerate(values)]


def obs(spark, *parts):
    return spark.createDataFrame([r for p in parts for r in p], schema.OBS)


def col(df, name, order="datetime_utc"):
    return [r[name] for r in df.orderBy(order).collect()]


def forecast(spark, values, start=T0, lead=24, member=None, source="model", stat=None, variable="temperature_2m", step=H):
    out = []
    for i, v in enumerate(values):
        valid = start + i * step
        out.append(("test", source, "m", valid - lead * H if lead else start, valid, lead * H if lead else None, member, stat, variable, float(v)))
    return spark.createDataFrame(out, schema.FORECAST)


def code(f):
    with pytest.raises(EngineError) as e:
        f()
    assert e.value.code in CODES
    return e.value.code


# registry, schema, sites
def test_dictionary_and_enums(spark):
    assert len(registry.variables()) == 23 and registry.dictionary(spark).count() == 23
    assert code(lambda: registry.variable("nope")) == "unknown_variable"
    assert code(lambda: registry.validate_qc_flag("bad")) == "invalid_qc_flag"
    assert registry.tier_rank("emos") == 4 and registry.tier_rank("unverified") == -1
    registry.register_variable(registry.Variable("soil_temp", "degC", -20, 60, "linear", "site_measurable"))
    assert "soil_temp" in registry.variables()
    registry.reset_dictionary()
    assert "soil_temp" not in registry.variables()
    assert registry.parse_period("30 days") == dt.timedelta(days=30) and code(lambda: registry.parse_period("soon")) == "bad_period"
    assert code(lambda: registry.unit_factors("MJ/m2", "W/m2")) == "bad_units"


@pytest.mark.parametrize(("change", "expected"), [(("variable", "nope"), "unknown_variable"), (("qc_flag", "x"), "invalid_qc_flag"), (("method", "x"), "invalid_method"), (("value", 99.0), "out_of_range")])
def test_new_obs_rejects(spark, change, expected):
    df = obs(spark, rows([15])).withColumn(change[0], F.lit(change[1]))
    assert code(lambda: schema.new_obs(df)) == expected


def test_new_obs_and_forecast_keys(spark):
    assert code(lambda: schema.new_obs(obs(spark, rows([1]), rows([2])))) == "duplicate_key"
    assert code(lambda: schema.new_obs(obs(spark, rows([1])).drop("value"))) == "missing_column"
    assert schema.new_obs(obs(spark, rows([1, None, 3]))).count() == 3
    assert code(lambda: schema.new_forecast(forecast(spark, [1], member=1, stat="p10"))) == "member_and_stat"
    assert code(lambda: schema.new_forecast(forecast(spark, [1]).withColumn("lead_time", F.expr("INTERVAL '1' DAY * 2")))) == "bad_lead"
    assert code(lambda: schema.new_forecast(forecast(spark, [1]).unionAll(forecast(spark, [2])))) == "duplicate_key"


def test_sites(tmp_path):
    assert code(lambda: Site("bad id", 0, 0, 0, "UTC")) == "bad_site"
    assert code(lambda: Site("a", 0, 0, 0, "Mars/X")) == "bad_site"
    assert code(lambda: Instrument("w", ("wind_speed_10m",), 10)) == "bad_instrument"
    assert code(lambda: Sites([SITE, SITE])) == "duplicate_site"
    moved = SITE.set_resolved(["bom", "geohash"], "r3g")
    assert moved.get_resolved("bom", "geohash") == "r3g" and SITE.resolved == {}
    path = str(tmp_path / "s.yaml")
    sites.write_sites_yaml(moved, path)
    assert sites.read_sites_yaml(path)["test"] == moved
    (tmp_path / "d.yaml").write_text("store_root: /x\nrefetch_windows: {silo: 30 days}\n")
    assert sites.read_deployment_config(str(tmp_path / "d.yaml"))["refetch_windows"]["silo"].days == 30
    (tmp_path / "e.yaml").write_text("sources: {a: {api_key: abc}}\n")
    assert code(lambda: sites.read_deployment_config(str(tmp_path / "e.yaml"))) == "inline_secret"
    assert sites.redact("key abc", ["abc"]) == "key ***"


# physics
def test_clear_sky_values(spark):
    times = [dt.datetime(2026, 1, 1, h) for h in (0, 2, 4, 14)]
    d = spark.createDataFrame([(t,) for t in times], "t timestamp").select("t", physics.clear_sky_irradiance(F.col("t"), -34.75, 148.2, 220.0).alias("g"))
    got = {r[0].hour: r[1] for r in d.collect()}
    assert got[14] == 0 and 800 < got[2] < 1200 and got[2] > got[4] > 0


def test_physics_round_trips(spark):
    d = spark.range(1).select(
        physics.relative_humidity(F.lit(20.0), physics.dewpoint(F.lit(20.0), F.lit(55.0))).alias("rh"), physics.circular_distance(F.lit(350.0), F.lit(10.0), 360).alias("d"),
        physics.uv_direction(physics.to_u(F.lit(225.0), F.lit(5.0)), physics.to_v(F.lit(225.0), F.lit(5.0))).alias("dir"), physics.compass_to_angle(F.lit("sw")).alias("sw"),
        physics.angle_to_compass(F.lit(359.0)).alias("n"), physics.height_correct(F.lit(3.0), 2, 10, 0.03).alias("w"), physics.haversine_km(0.0, 0.0, F.lit(0.0), F.lit(90.0)).alias("km"),
    ).first()
    assert d["rh"] == pytest.approx(55) and d["d"] == 20 and d["dir"] == pytest.approx(225) and d["sw"] == 225 and d["n"] == "N"
    assert d["w"] == pytest.approx(3 * math.log(10 / 0.03) / math.log(2 / 0.03)) and d["km"] == pytest.approx(6371 * math.pi / 2)


# qc
def test_rules(spark):
    assert col(qc.qc_range(obs(spark, rows([45, 150, 55]))), "qc_flag") == ["ok", "fail", "ok"]
    assert col(qc.qc_step(obs(spark, rows([10, 25, 26]))), "qc_flag") == ["ok", "suspect", "ok"]
    assert col(qc.qc_step(obs(spark, rows([350, 10, 200], "wind_direction_10m"))), "qc_flag") == ["ok", "ok", "suspect"]
    assert col(qc.qc_persistence(obs(spark, rows([5] * 7 + [6]))), "qc_flag") == ["suspect"] * 7 + ["ok"]
    assert col(qc.qc_persistence(obs(spark, rows([5, 5, 5, None, 5, 5, 5, 5]))), "qc_flag").count("suspect") == 0
    night, day = rows([500], "direct_radiation", dt.datetime(2026, 1, 1, 14)), rows([500, 3000], "direct_radiation", dt.datetime(2026, 1, 1, 1))
    assert col(qc.qc_solar(obs(spark, day, night), SITE.latitude, SITE.longitude), "qc_flag") == ["ok", "fail", "fail"]


def test_spatial(spark):
    donors = obs(spark, *[rows([v], site=f"d{i}", source=f"d{i}") for i, v in enumerate((15, 15.5, 16))])
    assert col(qc.qc_spatial(obs(spark, rows([30])), donors), "qc_flag") == ["suspect"]
    assert col(qc.qc_spatial(obs(spark, rows([15.2])), donors), "qc_flag") == ["ok"]
    assert col(qc.qc_spatial(obs(spark, rows([30])), donors.limit(1)), "qc_flag") == ["ok"]
    assert code(lambda: qc.qc_spatial(obs(spark, rows([1], "cape")), donors)) == "spatial_not_applicable"


def test_flags_never_improve(spark):
    df = obs(spark, rows([45, 50], flag="fail"))
    assert set(col(qc.run_rules(df), "qc_flag")) == {"fail"}


def test_consistency(spark):
    wide = spark.createDataFrame([(20.0, 25.0, 110.0, 3.0, 5.0, 600.0, 600.0, 900.0), (20.0, None, 50.0, None, 5.0, 1.0, 1.0, 900.0)], "temperature_2m double, dewpoint_2m double, relative_humidity_2m double, wind_gusts_10m double, wind_speed_10m double, direct_radiation double, diffuse_radiation double, clear_sky_ceiling double")
    a, b = qc.enforce_consistency(wide).collect()
    assert (a["dewpoint_2m"], a["relative_humidity_2m"], a["wind_gusts_10m"], a["direct_radiation"], a["n_violations"]) == (20, 100, 5, 450, 4)
    assert b["n_violations"] == 0 and b["dewpoint_2m"] is None
    long = obs(spark, rows([20]), rows([25], "dewpoint_2m"))
    assert {r["variable"]: r["value"] for r in qc.consistency_pass_long(long, ["site_id", "datetime_utc"]).collect()} == {"temperature_2m": 20, "dewpoint_2m": 20}


# aggregation
def test_hourly(spark):
    ten = dt.timedelta(minutes=10)
    df = obs(spark, rows([0.5] * 6, "precipitation", step=ten), rows([15, 16, 17, 18, 19, 20], step=ten), rows([350, 10] * 3, "wind_direction_10m", step=ten), rows([1, 1, 1], "surface_pressure", step=ten))
    got = {r["variable"]: r["value"] for r in aggregate.aggregate_hourly(df).collect()}
    assert got["precipitation"] == 3.0 and got["temperature_2m"] == 17.5 and min(got["wind_direction_10m"], 360 - got["wind_direction_10m"]) == pytest.approx(0, abs=1e-6)
    assert "surface_pressure" not in got
    assert {r["variable"]: r["expected"] for r in aggregate.expected_per_hour(df).collect()}["temperature_2m"] == 6


def test_daily_daylight_saving_and_rain_days(spark):
    start = dt.datetime(2026, 4, 3, 0)
    df = obs(spark, rows([1.0] * 96, "precipitation", start))
    got = {r["datetime_utc"]: r["value"] for r in aggregate.aggregate_daily(df, "Australia/Sydney").collect()}
    assert got[dt.datetime(2026, 4, 4, 23)] == 25.0  # clocks go back on the fifth
    day = lambda h: aggregate.aggregate_daily(obs(spark, rows([1.0], "precipitation", dt.datetime(2026, 1, 14, h))), "Australia/Sydney").first()["datetime_utc"]
    assert day(21) == dt.datetime(2026, 1, 14, 22) and day(23) == dt.datetime(2026, 1, 15, 22)


def test_disaggregation(spark):
    daily = spark.createDataFrame([("a", dt.date(2026, 1, 1), v, x) for v, x in (("precipitation", 12.0), ("temperature_2m_max", 28.0), ("temperature_2m_min", 12.0))], "site_id string, day date, variable string, value double")
    shape = spark.range(24).select(F.col("id").cast("int").alias("hour"), F.col("id").cast("double").alias("value"))
    got = aggregate.disaggregate_daily(daily, shape, "UTC").groupBy("variable").agg(F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")).collect()
    by = {r["variable"]: r for r in got}
    assert by["precipitation"]["s"] == pytest.approx(12) and by["precipitation"]["n"] == 24
    assert by["temperature_2m"]["lo"] == 12 and by["temperature_2m"]["hi"] == 28


# filling
def test_interpolation(spark):
    assert col(fill.fill_linear(obs(spark, rows([None, 1, None, None, 4, None]))), "filled") == [1, 1, 2, 3, 4, 4]
    ways = col(fill.fill_circular(obs(spark, rows([350, None, 10], "wind_direction_10m"))), "filled")
    assert min(ways[1], 360 - ways[1]) == pytest.approx(0, abs=1e-9)
    assert col(fill.fill_rain(obs(spark, rows([0, None, 0, None, 2, None], "precipitation"))), "filled") == [0, 0, 0, 0, 2, 2]


def test_fill_router(spark):
    own = obs(spark, rows([10, None, 12, None, None, None, None, None, None, 20]))
    donor = obs(spark, rows([12, 13, 14, 15, 16, 17, 18, 19, 20, 22], source="donor"))
    got = fill.fill_tier(own, donor)
    assert col(got, "method") == ["measured", "imputed", "measured", *["donor_fill"] * 6, "measured"]
    assert col(got, "value")[3] == pytest.approx(13) and col(got, "source")[3] == "donor"
    assert [round(x, 6) for x in col(fill.gap_runs(own).where("gap_id = 2"), "span_hours")] == [5.0] * 6
    only = fill.fill_tier(obs(spark, rows([1, 2], "cape")), model=obs(spark, rows([5, 6], "cape", source="m")))
    assert col(only, "value") == [5, 6]
    assert code(lambda: fill.fill_micro(obs(spark, rows([None], "direct_radiation")))) == "fill_missing_site"


def test_derive_and_humidity(spark):
    df = obs(spark, rows([20, 20, 20]), rows([50, None, 60], "relative_humidity_2m"), rows([None, 10, None], "dewpoint_2m"))
    got = {(r["variable"], r["datetime_utc"].hour): r for r in fill.fill_derive(df).collect()}
    assert got["relative_humidity_2m", 1]["method"] == "derived" and 0 < got["relative_humidity_2m", 1]["value"] < 100
    assert got["dewpoint_2m", 0]["method"] == "derived"


def test_transfer(spark):
    a, b = obs(spark, rows(range(50), source="a")), obs(spark, rows([v - 2 for v in range(50)], source="b"))
    m = transfer.fit_transfer(a, b)
    assert m["offset"] == 2 and col(transfer.apply_transfer(m, a), "value")[:3] == [-2, -1, 0]
    q = transfer.fit_transfer(a, b, "qmap")
    assert col(transfer.apply_transfer(q, a), "value")[10] == pytest.approx(8)
    assert code(lambda: transfer.fit_transfer(a, obs(spark, rows([1], start=dt.datetime(2030, 1, 1))))) == "transfer_no_overlap"


# correction and verification
def test_fitted_tiers_recover(spark):
    start = dt.datetime(2025, 1, 1)
    data = []
    for i in range(730):
        t = start + i * 12 * H
        truth = 15 + 10 * math.sin(2 * math.pi * i / 730) + ((i * 37) % 11 - 5) / 5
        data.append(("test", t, truth + 3 + 2 * math.sin(2 * math.pi * t.timetuple().tm_yday / 365.25), truth))
    pairs = spark.createDataFrame(data, "site_id string, valid_time timestamp, forecast double, observation double")
    err = lambda df: df.agg(F.avg(F.abs(F.col("corrected") - F.col("observation")))).first()[0]
    assert err(correct.apply_mean_bias(correct.fit_mean_bias(pairs, ("site_id",)), pairs, ("site_id",))) < 0.2
    assert err(transfer.apply_qmap(transfer.fit_qmap(pairs, ("site_id",)), pairs, ("site_id",))) < 1.7
    e = correct.apply_emos(correct.fit_emos(pairs, ("site_id",)), pairs, ("site_id",)).withColumnRenamed("mean", "corrected")
    assert err(e) < 1.7 and e.first()["sd"] > 0
    far = transfer.apply_qmap(transfer.fit_qmap(pairs), pairs.limit(2).withColumn("forecast", F.lit(100.0))).first()
    top = pairs.agg(F.max("forecast"), F.max("observation")).first()
    assert far["corrected"] == pytest.approx(100 + top[1] - top[0])
    assert code(lambda: correct.fit_emos(pairs.withColumn("lead_bucket", F.lit("dNA")), ("site_id",))) == "lead_unresolved"


def test_physical(spark):
    got = {r["variable"]: r["value"] for r in correct.correct_physical(obs(spark, rows([3], "wind_speed_10m"), rows([20])), SITE, grid_elevation=120.0).collect()}
    assert got["temperature_2m"] == pytest.approx(20 - 0.65) and got["wind_speed_10m"] > 3


def test_scores(spark):
    p = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (3.0, 3.0)], "forecast double, observation double")
    assert p.agg(verify.mae(F.col("forecast"), F.col("observation"))).first()[0] == pytest.approx(2 / 3)
    b = spark.createDataFrame([(0.0, False), (0.5, True), (1.0, True), (0.5, False)], "p double, o boolean")
    assert b.agg(verify.brier(F.col("p"), F.col("o"))).first()[0] == pytest.approx(0.125)
    table = {r["bin"]: r for r in verify.reliability_table(b, "p", "o").collect()}
    assert table[1]["n"] == 1 and table[3]["n"] == 2 and table[2]["mean_probability"] is None and table[5]["n"] == 1
    m = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 9.0), (2, 1.0)], "member int, value double")
    assert sorted(r["total"] for r in verify.cumulative_by_member(m).collect()) == [10, 10]
    c = p.select(verify.crps_gaussian(F.col("observation"), F.col("forecast"), F.lit(1.0)).alias("c")).collect()
    assert c[0]["c"] == pytest.approx((math.sqrt(2) - 1) / math.sqrt(math.pi))
    low = verify.block_bootstrap([1.0, 1.2, 0.9, 1.1] * 20)
    assert low[1] > 0 and low[3] and verify.block_bootstrap([1.0, -1.0] * 40)[3] is False


def test_pairs_and_issuance(spark):
    fc = forecast(spark, [10, 11, 12]).unionAll(forecast(spark, [90, 91], member=1)).unionAll(forecast(spark, [80], stat="p10"))
    o = obs(spark, rows([9, 10, 50]), rows([1, 1, 1], source="zz")).withColumn("qc_flag", F.when(F.col("value") == 50, "fail").otherwise(F.col("qc_flag")))
    got = verify.verification_pairs(fc, o).orderBy("valid_time").collect()
    assert [(r["forecast"], r["observation"], r["lead_bucket"]) for r in got] == [(10, 9, "d1"), (11, 10, "d1"), (12, 1, "d1")]
    old = forecast(spark, [20]).withColumn("issue_time", F.lit(T0 - 48 * H))
    assert [r["value"] for r in reshape.latest_issuance(forecast(spark, [30]).unionAll(old)).collect()] == [30]
    w = reshape.widen_forecast(forecast(spark, [10], member=1).unionAll(forecast(spark, [20], member=2)), ["temperature_2m", "cape"]).first()
    assert (w["temperature_2m"], w["cape"]) == (15, None)


def test_donors_and_stations(spark):
    d = spark.createDataFrame([("ghcnh", "072150", 3.0), ("bom_obs", "072150", 3.0), ("silo", "x", 1.0)], "source string, identity string, distance_km double")
    assert [(r["source"], r["rank"]) for r in stations.rank_donors(d).orderBy("rank").collect()] == [("bom_obs", 1), ("silo", 2)]


# store
@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_supersede_and_as_of(spark, store):
    n1, n2 = dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1)
    assert store.write_obs(obs(spark, rows([20, 21, None])), n1, "supersede") == {"n_new": 3, "n_superseded": 0, "n_unchanged": 0}
    assert store.write_obs(obs(spark, rows([22, 21, None])), n2, "supersede") == {"n_new": 0, "n_superseded": 1, "n_unchanged": 2}
    assert store.write_obs(obs(spark, rows([22, 21, None])), n2, "supersede")["n_unchanged"] == 3
    assert col(store.read_obs("test"), "value") == [22, 21, None]
    assert col(store.read_obs("test", at=dt.datetime(2026, 2, 2)), "value") == [20, 21, None]
    assert store.read_obs("test", include_superseded=True).count() == 4
    assert store.read_obs("test", start=T0 + H, end=T0 + H).count() == 1
    assert code(lambda: store.write_obs(obs(spark, rows([1])), n1, "merge")) == "bad_mode"
    store.connect()
    assert spark.sql("select count(*) from observations where not superseded").first()[0] == 3


def test_forecast_archive(spark, store):
    two, three = forecast(spark, [1, 2]), forecast(spark, [1, 2, 3])
    assert store.write_forecast(two) == 2 and store.write_forecast(three) == 1 and store.write_forecast(three) == 0
    assert store.read_forecast("test").count() == 3
    aux = spark.createDataFrame([("test", "bom", T0, T0, "precis", "Sunny.")], schema.AUX)
    assert store.write_forecast_aux(aux) == 1 and store.write_forecast_aux(aux) == 0


def test_control_tables(spark, store):
    store.write_obs(obs(spark, rows([1])), T0)
    store.write_obs(obs(spark, rows([2], source="b")), T0)
    assert store.compact(["observations"]) == {"observations": 1} and store.read_obs("test").count() == 2
    assert code(lambda: store.compact(["nope"])) == "unknown_table"
    store.set_watermark("test", "qc", T0)
    assert store.watermark("test", "qc") == T0 and store.fetch_window("test", "qc", "", H, T0)[0] == T0 - H
    c = transfer.fit_qmap(spark.createDataFrame([(float(i), float(i + 5)) for i in range(50)], "forecast double, observation double"))
    assert [store.write_calibration("test", "temperature_2m", "silo", "qmap", c, {}, T0) for _ in range(2)] == [1, 2]
    assert store.read_calibration("test", "temperature_2m", "silo")[0]["version"] == 2
    assert code(lambda: store.read_calibration("test", "temperature_2m", "x")) == "calib_not_found"
    log = spark.createDataFrame([("test", T0, "temperature_2m", "range", "ok", "")], schema.QC_LOG)
    store.write_qc_log(log, T0)
    store.write_qc_log(log.withColumn("outcome", F.lit("fail")), T0 + H)
    assert [r["outcome"] for r in store.read_qc_log("test").collect()] == ["fail"]


# sources
def test_parse_layers(spark):
    m = base.Mapping("json", {"path": "hourly/time", "tz": "UTC"}, ({"variable": "wind_speed_10m", "unit": "km/h", "path": "hourly/wind"}, {"variable": "temperature_2m", "unit": "degC", "path": "hourly/none"}))
    got = base.apply_json(spark, '{"hourly": {"time": ["2026-01-01T00:00", "2026-01-01T01:00"], "wind": [36, null]}}', m, SITE, "rest")
    assert col(got, "value") == [10.0, None]
    assert code(lambda: base.Mapping("json", {"path": "t"}, ())) == "bad_mapping"
    bad = '{"hourly": {"time": ["yesterday"], "wind": [1]}}'
    assert code(lambda: base.apply_json(spark, bad, m, SITE, "rest").collect()) == "bad_mapping"
    body = '{"hourly": {"time": ["2026-01-01T00:00"], "temperature_2m_member01": [17.5], "temperature_2m_member02": [18], "temperature_2m": [1]}, "hourly_units": {"temperature_2m": "K"}}'
    ens = vendors.openmeteo_forecast(spark, body.replace('"K"', '"degC"'), "ensemble", SITE, "om", None, T0).orderBy("member").collect()
    assert [(r["member"], r["value"]) for r in ens] == [(1, 17.5), (2, 18.0)]
    prev = '{"hourly": {"time": ["2026-01-05T00:00"], "temperature_2m_previous_day2": [9]}}'
    r = vendors.openmeteo_forecast(spark, prev, "previous_runs", SITE, "om", None, T0).first()
    assert r["issue_time"] == dt.datetime(2026, 1, 3) and r["lead_time"] == dt.timedelta(days=2)
    seasonal = '{"daily": {"time": ["2026-01-02", "2026-03-02"], "temperature_2m_mean": [1, 2], "temperature_2m_member01": [3, 4]}}'
    s = vendors.openmeteo_forecast(spark, seasonal, "seasonal", SITE, "om", None, T0).orderBy("valid_time", "member").collect()
    assert [(r["model"], r["member"], r["stat"]) for r in s] == [("ec46", None, "mean"), ("ec46", 1, None), ("seas5", None, "mean"), ("seas5", 1, None)]
    hist = vendors.openmeteo_obs(spark, '{"hourly": {"time": ["2020-01-01T00:00"], "wind_speed_10m": [36]}, "hourly_units": {"wind_speed_10m": "km/h"}}', SITE, "om").first()
    assert (hist["value"], hist["method"]) == (10.0, "model_fill")


def test_vendor_rows(spark):
    xml = '<product><amoc><issue-time-utc>2026-01-01T00:00:00Z</issue-time-utc></amoc><forecast><area><forecast-period start-time-local="2026-01-01T00:00:00+11:00"><element type="air_temperature_maximum">30</element><text type="precis">Sunny.</text><text type="uv">High</text></forecast-period><forecast-period start-time-local="2026-01-02T00:00:00+11:00"><text type="precis">Rain.</text></forecast-period></area></forecast></product>'
    f = vendors.precis_forecast(spark, xml, "test").collect()
    assert [(r["value"], r["valid_time"]) for r in f] == [(30.0, dt.datetime(2025, 12, 31, 13))]
    assert sorted((r["field"], r["value_text"]) for r in vendors.precis_aux(spark, xml, "test").collect()) == [("precis", "Rain."), ("precis", "Sunny."), ("uv", "High")]
    o = {r["variable"]: r["value"] for r in vendors.bom_72h_obs(spark, '{"observations": {"data": [{"aifstime_utc": "20251231150000", "air_temp": 18.5, "wind_spd_kmh": 36, "wind_dir": "SW"}]}}', "test").collect()}
    assert o == {"temperature_2m": 18.5, "wind_speed_10m": 10.0, "wind_direction_10m": 225.0}
    assert vendors.bom_web_obs(spark, '{"data": [{"time": "2026-01-01T02:00:00Z", "temp": 18.4, "wind": {"speed_kilometre": 36, "direction": "N"}, "humidity": 61}]}', "test").count() == 4
    silo = spark.createDataFrame([(dt.date(2026, 1, 15), "rainfall", 5.0, "25"), (dt.date(2026, 7, 15), "radiation", 8.64, "35")], "date date, variable_name string, value double, value_quality string")
    got = vendors.silo_obs(silo, SITE).orderBy("datetime_utc").collect()
    assert [(r["datetime_utc"], r["method"], r["qc_flag"]) for r in got] == [(dt.datetime(2026, 1, 14, 22), "imputed", "ok"), (dt.datetime(2026, 7, 14, 23), "model_fill", "suspect")]
    assert got[1]["value"] == pytest.approx(100)
    assert code(lambda: vendors.silo_obs(silo.withColumn("value_quality", F.lit("99")), SITE)) == "unknown_silo_code"
    g = vendors.grid_points(spark, '[{"keys": {"shortName": "10u", "step": "0-24", "perturbationNumber": "1"}, "neighbours": [{"value": 3, "unit": "m s**-1"}]}, {"keys": {"shortName": "10v", "step": "24h", "perturbationNumber": "1"}, "neighbours": [{"value": 4}]}]')
    assert {r["variable"]: round(r["value"], 3) for r in vendors.uv_to_wind(g).collect()}["wind_speed_10m"] == 5.0
    ix = vendors.ecmwf_index(spark, ['{"step": "24", "param": "2t", "number": "1", "_offset": 0, "_length": 5}', '{"step": "48", "param": "2t", "number": "1"}'])
    assert vendors.ecmwf_select(ix, ["2t"], [24], [1]).count() == 1
    assert code(lambda: vendors.geohash_of('{"data": []}')) == "no_geohash"
    assert vendors.issue_cycles(T0, T0 + 13 * H, T0 + 7 * H) == [T0, T0 + 6 * H]


def test_file_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,temp_c,wind_kmh\n2026-01-01 00:00,15,36\n2026-01-01 01:00,,18\n")
    m = base.Mapping("csv", {"column": "timestamp", "tz": "UTC"}, ({"variable": "temperature_2m", "unit": "degC", "column": "temp_c"}, {"variable": "wind_speed_10m", "unit": "km/h", "column": "wind_kmh"}))
    s = base.FileSource("file", str(tmp_path / "*.csv"), m)
    assert col(s.fetch(spark, SITE, ["wind_speed_10m"], (None, None), T0), "value") == [10.0, 5.0]
    assert base.FileSource("file", str(tmp_path / "none*.csv"), m).fetch(spark, SITE, ["wind_speed_10m"], (None, None), T0).count() == 0
    assert code(lambda: s.fetch_forecast(spark, SITE, [], (None, None), T0)) == "no_forecast_support"
    assert code(lambda: base.adapters_for_site(Site("a", 0, 0, 0, "UTC", sources={"x": {"kind": "nope"}}))) == "unknown_adapter"


def test_ladder_and_http(tmp_path):
    def gone(_):
        raise EngineError("http_gone")

    def down(_):
        raise EngineError("http_server_error")

    b = http.Breaker(str(tmp_path / "b.json"))
    ladder = [http.Rung("a", gone, ("obs",)), http.Rung("b", lambda _: "rows", ("obs",))]
    assert [http.ladder_fetch(ladder, {"product": "obs"}, b, T0)[0] for _ in range(4)] == ["b"] * 4
    assert b.tripped("a") and http.Breaker.read(str(tmp_path / "b.json")).strikes("a") == 3
    assert code(lambda: http.ladder_fetch([http.Rung("c", down, ("obs",))], {"product": "obs"}, b, T0)) == "ladder_exhausted" and b.strikes("c") == 0
    import io
    import urllib.error

    calls = []

    def opener(_):
        calls.append(1)
        if len(calls) < 2:
            raise urllib.error.HTTPError("u", 503, "", {}, None)
        return io.BytesIO(b'{"a": 1}')

    assert http.Http(open=opener, sleep=lambda _: None).get("http://x", parse="json") == {"a": 1} and len(calls) == 2


# tables and verbs
def test_met_table(spark):
    df = spark.createDataFrame([(T0, 1.0, 2.0), (T0 + H, 3.0, 4.0)], "time timestamp, a double, b double")
    prov = {v: {"tier": "qmap", "train_overlap": 24, "source": "x"} for v in ("a", "b")}
    table = MetTable(df, prov)
    assert set(table.validate().provenance["a"].values()) == {"qmap", 24, "x"}
    with pytest.warns(UserWarning):
        changed = table.with_column("a", F.col("a") + 1).with_column("c", F.lit(1.0)).validate()
    assert [changed.provenance[v]["tier"] for v in "abc"] == ["unverified", "qmap", "unverified"]
    with pytest.warns(UserWarning):
        assert not isinstance(table.select("time", "a"), MetTable)
    with pytest.warns(UserWarning):
        assert table.union(MetTable(df, prov | {"a": prov["a"] | {"tier": "raw"}})).provenance["a"]["tier"] == "unverified"
    assert ingest(df).provenance["a"]["tier"] == "unverified" and assert_single_tier(table) == "qmap"
    assert code(lambda: MetTable(df, {})) == "bad_provenance" and code(lambda: ingest(df.drop("time"))) == "bad_ingest"


class Fake(base.Adapter):
    def __init__(self, make, fc=None):
        super().__init__("src", ("temperature_2m",))
        self.make, self.fc = make, fc

    def fetch(self, spark, site, variables, window, now):
        return self.make()

    def fetch_forecast(self, spark, site, variables, window, now):
        return self.fc()


def test_sync_is_idempotent_and_isolates(spark, store):
    now = T0 + 8 * H
    good = Fake(lambda: obs(spark, rows([15, 16, 40, None, 18])), lambda: forecast(spark, [1, 2]))

    def broken():
        raise EngineError("http_gone")

    config = {"obs_sources": ["a", "b"], "forecast_sources": ["a"]}
    give = lambda s: {"a": good, "b": Fake(broken)}
    first = verbs.met_sync_daily(store, SITE, now, config, give)
    assert first[0]["status"] == "degraded" and "http_gone" in first[0]["message"]
    n = store.read_obs("test", include_superseded=True).count()
    assert store.read_obs("test").where("qc_flag = 'suspect'").count() >= 1
    assert store.read_obs("test").where("method = 'imputed'").count() == 1
    assert store.read_forecast("test").count() == 2
    assert verbs.for_each_site([SITE, Site("two", 0, 0, 0, "UTC")], lambda s: None if s.site_id == "test" else 1 / 0)[1]["status"] == "error"
    assert n >= 6


def test_refit_promotes_and_serves(spark, store):
    start = dt.datetime(2025, 1, 1)
    truth = [15 + 8 * math.sin(2 * math.pi * i / 365) + ((i * 37) % 11 - 5) / 5 for i in range(300)]
    day = dt.timedelta(days=1)
    store.write_obs(obs(spark, rows(truth, start=start, step=day)), T0)
    store.write_forecast(forecast(spark, [x + 4 for x in truth], start=start, step=day))
    out = verbs.met_refit(store, SITE, T0)
    assert out[0]["status"] == "ok" and out[0]["results"][0]["action"] == "promoted" and out[0]["results"][0]["tier"] == "qmap"
    tiers = {r["tier"] for r in store.read_report("test").collect()}
    assert {"raw", "persistence", "climatology", "qmap"} <= tiers
    wide = serve.met_wide(store, SITE, (start, start + 400 * day), variables=["temperature_2m"], now=T0)
    assert wide.provenance["temperature_2m"]["tier"] == "qmap" and wide.provenance["temperature_2m"]["train_overlap"] > 0
    again = verbs.met_refit(store, SITE, T0)
    assert again[0]["status"] == "ok" and store.read_report("test").where("tier = 'raw'").count() == 1


def test_history_prefers_the_station(spark, store):
    store.write_obs(obs(spark, rows([30.5] * 24, start=dt.datetime(2026, 1, 14, 13)), rows([29.0, 20.0], start=dt.datetime(2026, 1, 14, 22), step=dt.timedelta(days=1), source="silo")), T0)
    got = serve.met_history(store, SITE, "daily").collect()
    assert sorted((r["source"], r["value"]) for r in got) == [("silo", 20.0), ("src", 30.5)]
    c = transfer.fit_qmap(spark.createDataFrame([(float(i), float(i + 5)) for i in range(50)], "forecast double, observation double"))
    store.write_calibration("test", "temperature_2m", "silo", "qmap", c, {}, T0)
    silo = [r for r in serve.met_history(store, SITE, "daily").collect() if r["source"] == "silo"]
    assert silo[0]["value"] == pytest.approx(25) and silo[0]["tier"] == "qmap"
