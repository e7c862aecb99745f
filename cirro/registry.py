"""Closed sets, the variable dictionary, units and the clock."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro.errors import EngineError, warn

# Closed sets (fixed values), each from best or lowest on.
QC_FLAGS = ("ok", "suspect", "fail", "missing")
METHODS = ("measured", "aggregated", "donor_fill", "model_fill", "imputed", "disaggregated", "derived")
TIERS = ("raw", "physical", "mean_bias", "qmap", "emos")
STATISTICAL_CLASSES = ("linear", "circular", "bounded", "intermittent", "clear_sky_indexed")
MEASURABILITY_CLASSES = ("site_measurable", "derived_measurable", "donor_observable", "model_only")
FITTED_TIERS = TIERS[2:]


def _validator(code: str, allowed: tuple[str, ...]):
    def check(values: str | Iterable[str]) -> None:
        bad = sorted({str(v) for v in ([values] if isinstance(values, str) or values is None else values)} - set(allowed))
        if bad:
            raise EngineError(code, f"{', '.join(bad)}; allowed: {', '.join(allowed)}")

    return check


validate_qc_flag = _validator("invalid_qc_flag", QC_FLAGS)
validate_method = _validator("invalid_method", METHODS)
validate_tier = _validator("invalid_tier", TIERS)
validate_statistical_class = _validator("invalid_statistical_class", STATISTICAL_CLASSES)
validate_measurability_class = _validator("invalid_measurability_class", MEASURABILITY_CLASSES)


def tier_rank(tier: str) -> int:
    """0 for raw; tiers outside the set, such as unverified, rank below it."""
    return TIERS.index(tier) if tier in TIERS else -1


def flag_rank(flag: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, QC_FLAGS)), flag).cast("int") - 1


def flag_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, QC_FLAGS)), rank)


def now_utc() -> dt.datetime:
    """The only place where the clock is read; every verb takes `now` instead."""
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class Variable:
    variable: str
    unit: str
    min: float | None
    max: float | None
    statistical_class: str
    measurability_class: str
    circular_period: float | None = None
    description: str = ""


# Built-in variables (fixed values): unit, range, statistical class, measurability, period.
_BUILT_IN = (
    Variable("temperature_2m", "degC", -50, 60, "linear", "site_measurable"),
    Variable("relative_humidity_2m", "%", 0, 100, "bounded", "site_measurable"),
    Variable("dewpoint_2m", "degC", -60, 40, "linear", "derived_measurable"),
    Variable("surface_pressure", "hPa", 700, 1100, "linear", "site_measurable"),
    Variable("pressure_msl", "hPa", 870, 1085, "linear", "derived_measurable"),
    Variable("precipitation", "mm", 0, 500, "intermittent", "site_measurable"),
    Variable("cloud_cover", "%", 0, 100, "bounded", "donor_observable"),
    Variable("direct_radiation", "W/m2", 0, 1400, "clear_sky_indexed", "derived_measurable"),
    Variable("diffuse_radiation", "W/m2", 0, 1000, "clear_sky_indexed", "derived_measurable"),
    Variable("wind_speed_10m", "m/s", 0, 120, "linear", "site_measurable"),
    Variable("wind_direction_10m", "degree", 0, 360, "circular", "site_measurable", 360),
    Variable("wind_gusts_10m", "m/s", 0, 150, "linear", "site_measurable"),
    Variable("wind_speed_80m", "m/s", 0, 150, "linear", "model_only"),
    Variable("wind_speed_120m", "m/s", 0, 150, "linear", "model_only"),
    Variable("wind_speed_180m", "m/s", 0, 150, "linear", "model_only"),
    Variable("wind_direction_80m", "degree", 0, 360, "circular", "model_only", 360),
    Variable("wind_direction_120m", "degree", 0, 360, "circular", "model_only", 360),
    Variable("wind_direction_180m", "degree", 0, 360, "circular", "model_only", 360),
    Variable("boundary_layer_height", "m", 0, 5000, "linear", "model_only"),
    Variable("soil_moisture_0_to_1cm", "m3/m3", 0, 1, "bounded", "model_only"),
    Variable("soil_moisture_1_to_3cm", "m3/m3", 0, 1, "bounded", "model_only"),
    Variable("cape", "J/kg", 0, 8000, "linear", "model_only"),
    Variable("uv_index", "1", 0, 20, "bounded", "model_only"),
)

_EXTRA: dict[str, Variable] = {}


def variables() -> dict[str, Variable]:
    return {v.variable: v for v in _BUILT_IN} | _EXTRA


def variable(name: str) -> Variable:
    if name not in (known := variables()):
        raise EngineError("unknown_variable", name)
    return known[name]


def register_variable(v: Variable) -> None:
    """Adds a variable for this process, or replaces one that was added."""
    validate_statistical_class(v.statistical_class)
    validate_measurability_class(v.measurability_class)
    if v.statistical_class == "circular" and not v.circular_period:
        raise EngineError("invalid_statistical_class", f"{v.variable} is circular and has no period")
    if v.min is not None and v.max is not None and v.min > v.max:
        raise EngineError("out_of_range", f"{v.variable}: {v.min} > {v.max}")
    if v.variable in {b.variable for b in _BUILT_IN}:
        raise EngineError("duplicate_key", f"{v.variable} is built in")
    _EXTRA[v.variable] = v


def reset_dictionary() -> None:
    _EXTRA.clear()


DICT_SCHEMA = "variable string, unit string, min double, max double, statistical_class string, measurability_class string, circular_period double, description string"


def dictionary(spark: SparkSession) -> DataFrame:
    """One row for each variable; a few dozen, so joins broadcast it."""
    return spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in astuple(v)) for v in variables().values()], DICT_SCHEMA)


def by_variable(column: Column, of: dict[str, object], default: object = None) -> Column:
    """A value for each variable by a literal map: no join, and the expression stays in the scan's stage."""
    known = {k: v for k, v in of.items() if v is not None}
    if not known:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[column], F.lit(default))


def class_of(column: Column) -> Column:
    return by_variable(column, {n: v.statistical_class for n, v in variables().items()})


# Scale and offset to the canonical unit (fixed values): canonical = value * scale + offset.
_UNITS: dict[tuple[str, str], tuple[float, float]] = {
    ("km/h", "m/s"): (1 / 3.6, 0.0),
    ("kt", "m/s"): (1852 / 3600, 0.0),
    ("mph", "m/s"): (0.44704, 0.0),
    ("K", "degC"): (1.0, -273.15),
    ("degF", "degC"): (5 / 9, -160 / 9),
    ("Pa", "hPa"): (0.01, 0.0),
    ("kPa", "hPa"): (10.0, 0.0),
    ("mbar", "hPa"): (1.0, 0.0),
    ("m", "mm"): (1000.0, 0.0),
    ("cm", "mm"): (10.0, 0.0),
    ("inch", "mm"): (25.4, 0.0),
    ("kg/m2", "mm"): (1.0, 0.0),
    ("1", "%"): (100.0, 0.0),
    ("kW/m2", "W/m2"): (1000.0, 0.0),
    ("MJ/m2/day", "W/m2"): (1 / 0.0864, 0.0),
    ("rad", "degree"): (57.29577951308232, 0.0),
    ("km", "m"): (1000.0, 0.0),
    ("%", "m3/m3"): (0.01, 0.0),
    ("kJ/kg", "J/kg"): (1000.0, 0.0),
}
_ALIASES = {"C": "degC", "celsius": "degC", "°C": "degC", "kmh": "km/h", "km/hr": "km/h", "knots": "kt", "W m-2": "W/m2", "m s**-1": "m/s", "m s-1": "m/s", "deg": "degree", "degrees": "degree", "°": "degree", "percent": "%", "m3 m-3": "m3/m3"}


def unit_factors(from_unit: str, to_unit: str) -> tuple[float, float]:
    a, b = _ALIASES.get(from_unit, from_unit), _ALIASES.get(to_unit, to_unit)
    if a == b:
        return 1.0, 0.0
    if (a, b) not in _UNITS:
        raise EngineError("bad_units", f"{from_unit} to {to_unit}")
    return _UNITS[a, b]


def canonical_unit(name: str) -> str:
    return variable(name).unit


def to_canonical(value: Column, from_unit: str, name: str, carried: str | None = None) -> Column:
    """The value in the variable's unit; a unit that the value carries itself beats the stated one, with a warning."""
    if carried and carried != from_unit:
        warn("carried_unit", f"{name} carries {carried}, not {from_unit}")
        from_unit = carried
    scale, offset = unit_factors(from_unit, canonical_unit(name))
    out = value if scale == 1.0 else value * F.lit(scale)
    return out if offset == 0.0 else out + F.lit(offset)


_PERIOD = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(second|minute|hour|day|week)s?\s*")


def parse_period(text: str) -> dt.timedelta:
    m = _PERIOD.fullmatch(text or "")
    if not m:
        raise EngineError("bad_period", repr(text))
    return dt.timedelta(**{f"{m[2]}s": float(m[1])})
