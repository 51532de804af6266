"""Agro-climatic formulas as Column expressions of doubles; no Python runs on rows."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seven metrics in their usual order.
METRICS = ("temperature_avg", "temperature_min", "solar_radiation", "eto", "water_balance", "frost_risk", "soil_moisture")
#: Weather fields: name, other name, value if neither is known.
WEATHER = (("t_avg", "temperature_avg", 15.0), ("t_min", "temperature_min", 10.0), ("t_max", "temperature_max", 20.0), ("rh_avg", "humidity", 60.0), ("wind_speed_ms", "wind_speed", 2.0), ("solar_rad_w_m2", "solar_radiation", 200.0), ("precip_mm", "precipitation", 0.0), ("elevation_m", "elevation", 0.0))
#: Loam, if a parcel's soil isn't known: sand, silt, clay in percent.
LOAM = (50.0, 30.0, 20.0)
_R = 11.6  # W/m2 for 1 MJ/m2 and day


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weather_field(name: str) -> Column:
    main, other, default = next(w for w in WEATHER if w[0] == name)
    return F.coalesce(F.col(main), F.col(other), F.lit(default))


def lapse_temperature(t: Column, station_z: Column, z: Column) -> Column:
    return t - 0.0065 * (z - station_z)


def tilted_radiation(rad: Column, lat: Column, aspect: Column, slope: Column, doy: Column) -> Column:
    """Radiation on a slope. The hour angle is the sunset's, so the beam ratio is at one of its limits nearly everywhere."""
    phi, sigma, az = F.radians(lat), F.radians(slope), F.radians(aspect)
    delta = 0.409 * F.sin(2 * pi * doy / 365 - 1.39)
    omega = F.acos(_clip(-F.tan(phi) * F.tan(delta), -1.0, 1.0))
    dr = 1 + 0.033 * F.cos(2 * pi * doy / 365)
    ra = 1440 / pi * 0.0820 * dr * (omega * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(omega))
    rso = 0.75 * ra
    q = _clip(rad / _R / F.when(rso > 0.01, rso).otherwise(0.01), 0.0, 1.0)
    kappa = -F.cos(az)
    tilt = (
        F.sin(delta) * F.sin(phi) * F.cos(sigma) - F.sin(delta) * F.cos(phi) * F.sin(sigma) * kappa
        + F.cos(delta) * F.cos(phi) * F.cos(sigma) * F.cos(omega)
        + F.cos(delta) * F.sin(phi) * F.sin(sigma) * kappa * F.sin(omega)
    )
    flat = F.sin(delta) * F.sin(phi) + F.cos(delta) * F.cos(phi) * F.cos(omega)
    rb = _clip(tilt / F.when(F.abs(flat) <= 1e-10, 1e-10).otherwise(flat), 0.1, 2.0)
    return _clip(_R * F.greatest(F.lit(0.0), (0.75 + 0.25 * q) * rb * ra - 0.25 * (rb - 1) * rso), 0.0, 1200.0)


def vapour_pressure(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def evapotranspiration(t_avg: Column, t_min: Column, t_max: Column, rad: Column, wind: Column, humidity: Column, z: Column) -> Column:
    """Penman-Monteith reference evapotranspiration in mm a day, between 0 and 15."""
    gamma = 0.000665 * 101.3 * F.pow((293 - 0.0065 * z) / 293, 5.26)
    es = (vapour_pressure(t_min) + vapour_pressure(t_max)) / 2
    ea = es * humidity / 100
    slope = 4098 * vapour_pressure(t_avg) / F.pow(t_avg + 237.3, 2)
    rs = rad / _R
    relative = rs / F.greatest(rs, F.lit(1e-10))
    rnl = 4.903e-9 * F.pow(t_avg + 273.16, 4) * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * relative - 0.35)
    rn = F.greatest(0.77 * rs - rnl, F.lit(0.0))
    below = slope + gamma * (1 + 0.34 * wind)
    return F.when(below <= 1e-10, 0.0).otherwise(_clip((0.408 * slope * rn + gamma * 900 / (t_avg + 273) * wind * (es - ea)) / F.greatest(below, F.lit(1e-10)), 0.0, 15.0))


def water_balance(precip: Column, eto: Column) -> Column:
    return precip - eto


def frost_risk(t_min: Column, z: Column, tile_min_z: Column) -> Column:
    """Percent; cold air pools at the bottom of the tile."""
    pool = 2 * F.exp(-(z - tile_min_z) / 50)
    return 100 / (1 + F.exp(0.5 * (t_min - pool - 1)))


def wilting_point(sand: Column, clay: Column) -> Column:
    return F.greatest(-0.024 * sand + 0.487 * clay + 0.011 * sand * clay + 0.013, F.lit(0.01))


def field_capacity(sand: Column, clay: Column) -> Column:
    return F.greatest(-0.251 * sand + 0.195 * clay + 0.017 * sand * clay + 0.027, wilting_point(sand, clay) + 0.01)


def soil_moisture(awc: Column, fc: Column, wp: Column, precip_5d: Column, eto_5d: Column, current: Column | None = None) -> Column:
    start = 0.6 * fc if current is None else current
    return F.greatest(wp, F.least(fc, start + 0.7 * precip_5d / awc - eto_5d / awc))
