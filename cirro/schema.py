"""Canonical tables, their checks and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirro import registry
from cirro.errors import EngineError

_S, _D, _TS, _I = T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType()
LEAD = T.DayTimeIntervalType(T.DayTimeIntervalType.DAY, T.DayTimeIntervalType.SECOND)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


OBS = _struct(site_id=_S, datetime_utc=_TS, variable=_S, value=_D, source=_S, method=_S, qc_flag=_S)
OBS_KEY = ("site_id", "datetime_utc", "variable", "source")
STORED_OBS = T.StructType([*OBS.fields, T.StructField("ingested_at", _TS), T.StructField("superseded", T.BooleanType())])
FORECAST = _struct(site_id=_S, source=_S, model=_S, issue_time=_TS, valid_time=_TS, lead_time=LEAD, member=_I, stat=_S, variable=_S, value=_D)
FORECAST_KEY = ("site_id", "source", "model", "issue_time", "valid_time", "member", "stat", "variable")
AUX = _struct(site_id=_S, source=_S, issue_time=_TS, valid_time=_TS, field=_S, value_text=_S)
AUX_KEY = ("site_id", "source", "issue_time", "valid_time", "field")
QC_LOG = _struct(site_id=_S, datetime_utc=_TS, variable=_S, rule=_S, outcome=_S, detail=_S)
QC_LOG_KEY = ("site_id", "datetime_utc", "variable", "rule")
TRANSPORT = _struct(site_id=_S, datetime_utc=_TS, variable=_S, source=_S, transport=_S)
TRANSPORT_KEY = ("site_id", "datetime_utc", "variable", "source")
REPORT = _struct(site_id=_S, source=_S, variable=_S, lead_bucket=_S, tier=_S, n_pairs=_I, mae=_D, rmse=_D)
DIAGNOSTICS = _struct(site_id=_S, source=_S, variable=_S, lead_bucket=_S, n_members=_I, n_cases=_I, histogram_flatness=_D, spread_error_ratio=_D, brier_score=_D)


def assert_columns(df: DataFrame, spec: T.StructType, table: str) -> None:
    """Columns of the spec are there with its types; timestamps without zone count as UTC. Driver only."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in spec.fields if f.name not in have]
    if missing:
        raise EngineError("missing_column", f"{table} lacks {', '.join(missing)}")
    for f in spec.fields:
        got = have[f.name]
        if isinstance(f.dataType, T.TimestampType):
            if not isinstance(got, T.TimestampType | T.TimestampNTZType):
                raise EngineError("non_utc_time", f"{table}.{f.name} is {got.simpleString()}")
        elif isinstance(f.dataType, T.DoubleType | T.IntegerType):
            if not isinstance(got, T.NumericType | T.NullType):
                raise EngineError("wrong_type", f"{table}.{f.name} is {got.simpleString()}")
        elif not isinstance(got, type(f.dataType) | T.NullType):
            raise EngineError("wrong_type", f"{table}.{f.name} is {got.simpleString()}")


def project(df: DataFrame, spec: T.StructType) -> DataFrame:
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in spec.fields])


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _raise(counts: dict[str, int], order: list[str], table: str) -> None:
    for code in order:
        if counts.get(code):
            raise EngineError(code, f"{counts[code]} rows of {table}")


def _duplicates(df: DataFrame, key: tuple[str, ...]) -> bool:
    return not df.groupBy(*key).count().where("count > 1").isEmpty()


def new_obs(df: DataFrame, check: bool = True) -> DataFrame:
    """Canonical observations, projected; check=False leaves out the pass over the rows.

    In order: columns, unknown variables, flags, methods, ranges (of ok values, strictly outside), keys.
    """
    assert_columns(df, OBS, "observations")
    out = project(df, OBS)
    if not check:
        return out
    v = registry.variables()
    low, high = registry.by_variable(F.col("variable"), {n: float(x.min) for n, x in v.items() if x.min is not None}), registry.by_variable(F.col("variable"), {n: float(x.max) for n, x in v.items() if x.max is not None})
    counts = out.agg(
        _count(~F.coalesce(F.col("variable").isin(*v), F.lit(False))).alias("unknown_variable"),
        _count(~F.coalesce(F.col("qc_flag").isin(*registry.QC_FLAGS), F.lit(False))).alias("invalid_qc_flag"),
        _count(~F.coalesce(F.col("method").isin(*registry.METHODS), F.lit(False))).alias("invalid_method"),
        _count((F.col("qc_flag") == "ok") & ((F.col("value") < low) | (F.col("value") > high))).alias("out_of_range"),
    ).first()
    _raise(counts.asDict(), ["unknown_variable", "invalid_qc_flag", "invalid_method", "out_of_range"], "observations")
    if _duplicates(out, OBS_KEY):
        raise EngineError("duplicate_key", "observations")
    return out


def new_forecast(df: DataFrame, check: bool = True) -> DataFrame:
    """Canonical forecasts: known variables, never a member and a statistic, leads that fit the times to a millionth of an hour, unique null-safe keys."""
    assert_columns(df, FORECAST, "forecasts")
    out = project(df, FORECAST)
    if not check:
        return out
    off = F.abs(hours("valid_time") - hours("issue_time") - lead_hours())
    counts = out.agg(
        _count(~F.coalesce(F.col("variable").isin(*registry.variables()), F.lit(False))).alias("unknown_variable"),
        _count(F.col("member").isNotNull() & F.col("stat").isNotNull()).alias("member_and_stat"),
        _count(F.col("lead_time").isNotNull() & (off > 1e-6)).alias("bad_lead"),
    ).first()
    _raise(counts.asDict(), ["unknown_variable", "member_and_stat", "bad_lead"], "forecasts")
    if _duplicates(out, FORECAST_KEY):
        raise EngineError("duplicate_key", "forecasts")
    return out


def new_forecast_aux(df: DataFrame, check: bool = True) -> DataFrame:
    assert_columns(df, AUX, "forecast_aux")
    out = project(df, AUX)
    if check and _duplicates(out, AUX_KEY):
        raise EngineError("duplicate_key", "forecast_aux")
    return out


def hours(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp")) / F.lit(3.6e9)


def lead_hours(column: str = "lead_time") -> Column:
    return F.col(column).cast("interval second").cast("decimal(20,6)").cast("double") / 3600


def same_key(a: DataFrame, b: DataFrame, key: tuple[str, ...]) -> Column:
    """Null-safe equality: null models, members and statistics are keys like any other."""
    out = a[key[0]].eqNullSafe(b[key[0]])
    for c in key[1:]:
        out = out & a[c].eqNullSafe(b[c])
    return out
