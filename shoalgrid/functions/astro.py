"""Low-precision positions of Sun and Moon as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RAD = math.pi / 180
_TILT = 23.439 * RAD


def _linear(base: float, rate: float, days: Column) -> Column:
    return (F.lit(base) + F.lit(rate) * days) * F.lit(RAD)


def altitude(right_ascension: Column, declination: Column, days: Column, lat: float, lon: float) -> Column:
    """Degrees above the horizon, from the local sidereal time."""
    turn = F.pmod(F.lit(18.697374558) + F.lit(24.06570982441908) * days, F.lit(24.0)) + F.lit(lon / 15)
    hour = (turn - F.floor(turn / 24) * 24) * F.lit(15 * RAD) - right_ascension
    return F.asin(F.lit(math.sin(lat * RAD)) * F.sin(declination) + F.lit(math.cos(lat * RAD)) * F.cos(declination) * F.cos(hour)) / F.lit(RAD)


def sun_longitude(days: Column) -> Column:
    anomaly = _linear(357.528, 0.9856003, days)
    return _linear(280.460, 0.9856474, days) + F.lit(1.915 * RAD) * F.sin(anomaly) + F.lit(0.020 * RAD) * F.sin(anomaly * 2)


def sun_altitude(days: Column, lat: float, lon: float) -> Column:
    """days: since 2000-01-01 12:00 UTC."""
    lam = sun_longitude(days)
    return altitude(F.atan2(F.lit(math.cos(_TILT)) * F.sin(lam), F.cos(lam)), F.asin(F.lit(math.sin(_TILT)) * F.sin(lam)), days, lat, lon)


def moon_longitude(days: Column) -> Column:
    return _linear(218.316, 13.176396, days) + F.lit(6.289 * RAD) * F.sin(_linear(134.963, 13.064993, days))


def moon_latitude(days: Column) -> Column:
    return F.lit(5.128 * RAD) * F.sin(_linear(93.272, 13.229350, days))


def moon_altitude(days: Column, lat: float, lon: float) -> Column:
    lam, beta = moon_longitude(days), moon_latitude(days)
    dec = F.asin(F.sin(beta) * F.lit(math.cos(_TILT)) + F.cos(beta) * F.lit(math.sin(_TILT)) * F.sin(lam))
    ra = F.atan2(F.sin(lam) * F.lit(math.cos(_TILT)) - F.tan(beta) * F.lit(math.sin(_TILT)), F.cos(lam))
    return altitude(ra, dec, days, lat, lon)


def azimuth(right_ascension: Column, declination: Column, days: Column, lat: float, lon: float) -> Column:
    """Degrees clockwise from north."""
    turn = F.pmod(F.lit(18.697374558) + F.lit(24.06570982441908) * days, F.lit(24.0)) + F.lit(lon / 15)
    hour = (turn - F.floor(turn / 24) * 24) * F.lit(15 * RAD) - right_ascension
    south = F.atan2(F.sin(hour), F.cos(hour) * F.lit(math.sin(lat * RAD)) - F.tan(declination) * F.lit(math.cos(lat * RAD)))
    return F.pmod(south / F.lit(RAD) + 180, F.lit(360.0))


def sun_azimuth(days: Column, lat: float, lon: float) -> Column:
    lam = sun_longitude(days)
    return azimuth(F.atan2(F.lit(math.cos(_TILT)) * F.sin(lam), F.cos(lam)), F.asin(F.lit(math.sin(_TILT)) * F.sin(lam)), days, lat, lon)


#: Days of a mean month, and a new moon (2000-01-06 18:14 UTC) in days from 2000-01-01 12:00.
SYNODIC, NEW_MOON = 29.530588853, 5.259722222222222


def moon_age(days: Column) -> Column:
    """Days since the mean new moon."""
    return F.pmod(days - F.lit(NEW_MOON), F.lit(SYNODIC))


def moon_fraction(days: Column) -> Column:
    """Lit share of the disc."""
    return (F.lit(1.0) - F.cos(moon_latitude(days)) * F.cos(moon_longitude(days) - sun_longitude(days))) / F.lit(2.0)


def moon_waxing(days: Column) -> Column:
    return F.pmod((moon_longitude(days) - sun_longitude(days)) / F.lit(RAD), F.lit(360.0)) < 180
