"""Solar position, altitude and events as Column expressions over UTC minutes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RISE_ALTITUDE = -0.833  # fixed: the upper limb with refraction
TWILIGHT_ALTITUDE = -6.0


def _fraction(day: Column, hour: Column, year: Column) -> Column:
    """The fractional year in radians."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return 2 * math.pi / F.when(leap, 366.0).otherwise(365.0) * (day - 1 + (hour - 12) / 24)


def equation_of_time(g: Column) -> Column:
    """Minutes; a published Fourier series with fixed coefficients."""
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def declination(g: Column) -> Column:
    """Radians; a published Fourier series with fixed coefficients."""
    return 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)


def subsolar(ts: Column) -> dict[str, Column]:
    """Where the sun is overhead at a UTC instant, taken to the minute: lat, lon, and the series behind them."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    g = _fraction(F.dayofyear(ts), minute / 60.0, F.year(ts))
    eot = equation_of_time(g)
    lon = -15 * (minute / 60.0 - 12 + eot / 60)
    return {"lat": F.degrees(declination(g)), "lon": F.pmod(lon + 180, F.lit(360.0)) - 180, "eot": eot, "decl": declination(g)}


def altitude(ts: Column, lat: Column, lon: Column) -> Column:
    """Degrees above the horizon."""
    sun = subsolar(ts)
    s = F.sin(F.radians(lat)) * F.sin(sun["decl"]) + F.cos(F.radians(lat)) * F.cos(sun["decl"]) * F.cos(F.radians(lon - sun["lon"]))
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s))))


def daylight(alt: Column) -> Column:
    return F.when(alt >= 0, "day").when(alt >= TWILIGHT_ALTITUDE, "civil-twilight").otherwise("night")


def events(ts: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """kind (events, polar-day, polar-night), sunrise and sunset in minutes of the UTC day, null at the poles' seasons; by the declination at noon."""
    g = _fraction(F.dayofyear(ts), F.lit(12.0), F.year(ts))
    eot, dec = equation_of_time(g), declination(g)
    cos_h = (math.sin(math.radians(RISE_ALTITUDE)) - F.sin(F.radians(lat)) * F.sin(dec)) / (F.cos(F.radians(lat)) * F.cos(dec))
    kind = F.when(cos_h < -1, "polar-day").when(cos_h > 1, "polar-night").otherwise("events")
    h = F.degrees(F.acos(F.when(kind == "events", cos_h)))
    noon = 720 - 4 * lon - eot
    return {"kind": kind, "sunrise_min": noon - 4 * h, "sunset_min": noon + 4 * h}


def overlay_alpha(alt: Column, most: float = 0.5) -> Column:
    """From nothing by day to most below civil twilight, in proportion between."""
    return F.when(alt >= 0, 0.0).when(alt <= TWILIGHT_ALTITUDE, most).otherwise(alt / TWILIGHT_ALTITUDE * most)


def parse_minute(text: Column) -> Column:
    """A timestamp from yyyy-MM-ddTHH:mmZ; null unless it reads back the same."""
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm'Z'"))
    return F.when(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm'Z'") == text, parsed)


def format_minute(ts: Column) -> Column:
    return F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd'T'HH:mm'Z'")
