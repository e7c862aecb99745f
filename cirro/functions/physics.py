"""Scalar functions of weather and position: Column in, Column out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
RADIUS_KM = 6371.0
SOLAR_CONSTANT = 1361.0
LINKE_TURBIDITY = 3.0
# Magnus coefficients (fixed values).
MAGNUS_B, MAGNUS_C = 17.625, 243.04
# The sixteen points of the compass, 22.5 degrees apart (fixed values).
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def _series(angle: Column, constant: float, *terms: tuple[float, float]) -> Column:
    """constant + sum of a_k cos(k angle) + b_k sin(k angle)."""
    out = F.lit(constant)
    for k, (a, b) in enumerate(terms, 1):
        out = out + a * F.cos(k * angle) + b * F.sin(k * angle)
    return out


def day_angle(time: Column) -> Column:
    return (F.dayofyear(time) - 1) * F.lit(2 * PI / 365)


def distance_factor(time: Column) -> Column:
    """Squared ratio of mean to actual sun distance, Spencer's series."""
    return _series(day_angle(time), 1.000110, (0.034221, 0.001280), (0.000719, 0.000077))


def declination(time: Column) -> Column:
    return _series(day_angle(time), 0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))


def equation_of_time(time: Column) -> Column:
    """Minutes."""
    return 229.18 * _series(day_angle(time), 0.000075, (0.001868, -0.032077), (-0.014615, -0.040849))


def cos_zenith(time: Column, latitude: Column | float, longitude: Column | float) -> Column:
    lat, lon = (x if isinstance(x, Column) else F.lit(float(x)) for x in (latitude, longitude))
    clock = F.hour(time) + F.minute(time) / 60.0 + F.second(time) / 3600.0
    angle = (clock + lon / 15 + equation_of_time(time) / 60 - 12) * F.lit(15 * PI / 180)
    out = F.sin(F.radians(lat)) * F.sin(declination(time)) + F.cos(F.radians(lat)) * F.cos(declination(time)) * F.cos(angle)
    return F.greatest(F.least(out, F.lit(1.0)), F.lit(-1.0))


def clear_sky_irradiance(time: Column, latitude: Column | float, longitude: Column | float, elevation: Column | float) -> Column:
    """Global irradiance of a cloudless sky in W/m2 by the published Ineichen-Perez form; 0 at night."""
    elev = elevation if isinstance(elevation, Column) else F.lit(float(elevation))
    elev = F.coalesce(elev, F.lit(0.0))
    cz = cos_zenith(time, latitude, longitude)
    mass = 1 / F.greatest(cz, F.lit(1e-6))
    gain, loss = 0.0000509 * elev + 0.868, 0.0000392 * elev + 0.0387
    depth = F.exp(-elev / 8000) + F.exp(-elev / 1250) * (LINKE_TURBIDITY - 1)
    # far below the horizon the last factor would overflow; the branch is not taken there
    out = gain * SOLAR_CONSTANT * distance_factor(time) * cz * F.exp(-loss * mass * depth + 0.01 * F.pow(mass, 1.8))
    return F.when(cz > 0, F.greatest(out, F.lit(0.0))).otherwise(0.0)


def radiation_limit(time: Column, latitude: Column | float, longitude: Column | float, scale: float, plus: float) -> Column:
    """scale E0 cosZ^1.2 + plus: 1.5 and 100 bound what is possible, 1.2 and 50 what is not extremely rare."""
    cz = F.greatest(cos_zenith(time, latitude, longitude), F.lit(0.0))
    return scale * SOLAR_CONSTANT * distance_factor(time) * F.pow(cz, 1.2) + plus


def dewpoint(temperature: Column, humidity: Column) -> Column:
    g = F.log(F.greatest(humidity, F.lit(1e-6)) / 100) + MAGNUS_B * temperature / (MAGNUS_C + temperature)
    return MAGNUS_C * g / (MAGNUS_B - g)


def relative_humidity(temperature: Column, dew: Column) -> Column:
    e = lambda t: F.exp(MAGNUS_B * t / (MAGNUS_C + t))
    return clamp(100 * e(dew) / e(temperature), 0.0, 100.0)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def wrap_degrees(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def circular_mean(degrees: Column) -> Column:
    """Aggregate: direction of the mean unit vector; nulls don't count."""
    return wrap_degrees(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))) + 360)


def circular_distance(a: Column, b: Column, period: Column | float) -> Column:
    p = period if isinstance(period, Column) else F.lit(float(period))
    d = F.pmod(F.abs(a - b), p)
    return F.least(d, p - d)


def height_correct(speed: Column, from_height: Column | float, to_height: Column | float, roughness: Column | float) -> Column:
    """Logarithmic wind profile."""
    f, t, z = (x if isinstance(x, Column) else F.lit(float(x)) for x in (from_height, to_height, roughness))
    return speed * F.log(t / z) / F.log(f / z)


def lapse_correct(value: Column, elevation_delta: Column | float, rate: float = 0.0065) -> Column:
    return value - rate * elevation_delta


def haversine_km(lat1: Column | float, lon1: Column | float, lat2: Column, lon2: Column) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1))
    h = F.pow(F.sin(F.radians(lat2 - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - b) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def compass_to_angle(point: Column) -> Column:
    """Degrees of a compass point; unknown points are null."""
    at = F.array_position(F.array(*map(F.lit, COMPASS)), F.upper(F.trim(point)))
    return F.when(at > 0, (at - 1) * 22.5)


def angle_to_compass(degrees: Column) -> Column:
    """Nearest of the sixteen points, halves to the even one."""
    return F.get(F.array(*map(F.lit, COMPASS)), F.pmod(F.bround(degrees / 22.5).cast("int"), F.lit(16)))


def to_u(direction: Column, speed: Column) -> Column:
    return -speed * F.sin(F.radians(direction))


def to_v(direction: Column, speed: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def uv_direction(u: Column, v: Column) -> Column:
    """Where the wind comes from."""
    return wrap_degrees(F.degrees(F.atan2(-u, -v)) + 360)


def uv_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def correct_wind_direction(direction: Column, speed: Column, bias_u: Column, bias_v: Column) -> Column:
    """The wind vector turned by the direction of the bias vector; a bias of no length turns nothing."""
    turn = F.when(uv_speed(bias_u, bias_v) > 1e-9, F.radians(uv_direction(bias_u, bias_v))).otherwise(0.0)
    u, v = to_u(direction, speed), to_v(direction, speed)
    return uv_direction(u * F.cos(turn) - v * F.sin(turn), u * F.sin(turn) + v * F.cos(turn))


def profile_rescale(raw: Column, height: Column | float, corrected_10m: Column, raw_10m: Column, stable: Column, reference: float = 10.0, cap: float = 3.0) -> Column:
    """Wind aloft follows the correction at 10 m, damped with height; not in stable air."""
    h = height if isinstance(height, Column) else F.lit(float(height))
    ratio = 1 + (corrected_10m / F.nullif(raw_10m, F.lit(0.0)) - 1) * (reference / h)
    return F.when(stable | raw_10m.isNull() | (raw_10m == 0), raw).otherwise(raw * clamp(ratio, 1 / cap, cap))


def boundary_layer_height(raw: Column, wind: Column, temperature: Column) -> Column:
    """Diagnostic height from corrected surface values; null inputs leave the raw one."""
    return F.coalesce(100 * (1 + 0.1 * wind) * (1 + 0.02 * F.greatest(temperature, F.lit(0.0))), raw)


def radiation_resplit(direct: Column, diffuse: Column, global_corrected: Column, has_pyranometer: Column | bool) -> tuple[Column, Column]:
    """Direct and diffuse parts of a corrected global, in the old ratio; nothing to split stays as it is."""
    has = has_pyranometer if isinstance(has_pyranometer, Column) else F.lit(bool(has_pyranometer))
    total = direct + diffuse
    use = has & (total > 0) & global_corrected.isNotNull()
    share = direct / F.nullif(total, F.lit(0.0))
    return F.when(use, global_corrected * share).otherwise(direct), F.when(use, global_corrected * (1 - share)).otherwise(diffuse)


def shrink(corrected: Column, climatology: Column, weight: Column | float) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * corrected + (1 - w) * climatology


def skill_score(score: Column, baseline: Column) -> Column:
    return 1 - score / F.nullif(baseline, F.lit(0.0))
