"""Spherical geometry as Column expressions; angles in degrees, lengths in kilometres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
MOLLWEIDE_M = 6378137.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def half_chord_squared(lat1, lon1, lat2, lon2) -> Column:
    """The haversine of the angle between two points, held within [0, 1]."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return 2 * EARTH_KM * F.asin(F.sqrt(half_chord_squared(lat1, lon1, lat2, lon2)))


def haversine_atan2_km(lat1, lon1, lat2, lon2) -> Column:
    h = half_chord_squared(lat1, lon1, lat2, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def chord_km(lat1, lon1, lat2, lon2) -> Column:
    """The straight line through the globe."""
    return 2 * EARTH_KM * F.sqrt(half_chord_squared(lat1, lon1, lat2, lon2))


def unit_vector(lat, lon) -> dict[str, Column]:
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return {"ux": F.cos(lat) * F.cos(lon), "uy": F.cos(lat) * F.sin(lon), "uz": F.sin(lat)}


def vector_distance_km(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Along the surface, from the chord between two unit vectors."""
    d = F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in ("ux", "uy", "uz")), F.lit(0.0)))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), d / 2))


def vector_to_lat(uz) -> Column:
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _col(uz)))))


def vector_to_lon(ux, uy) -> Column:
    return F.degrees(F.atan2(_col(uy), _col(ux)))


def turn_from(start, lon) -> Column:
    """How far east of start a longitude lies, in [0, 360).

    The remainder is taken twice, as in SQL: ``pmod`` leaves a positive one as it is, and what lies on an edge
    depends on the last bit.
    """
    return ((_col(lon) - _col(start)) % 360.0 + 360.0) % 360.0


def normalize_lon(lon) -> Column:
    """Into [-180, 180), without a negative zero."""
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0 + 0.0


def antipode(lat, lon) -> dict[str, Column]:
    return {"lat": -_col(lat) + 0.0, "lon": normalize_lon(_col(lon) + 180.0)}


def cell_area_km2(north, south, width_deg) -> Column:
    return EARTH_KM * EARTH_KM * F.radians(_col(width_deg)) * (F.sin(F.radians(_col(north))) - F.sin(F.radians(_col(south))))


def geodesic_points(lat1, lon1, lat2, lon2, n: int) -> Column:
    """n + 1 points (step, lat, lon) of the shorter great circle, ends exact; empty between antipodes, copies where the ends agree."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    a, b = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    omega = 2 * F.asin(F.sqrt(half_chord_squared(lat1, lon1, lat2, lon2)))

    def at(k: Column) -> Column:
        t = k / F.lit(float(n))
        s = F.sin(omega)
        wa = F.when(omega < 1e-12, 1 - t).otherwise(F.sin((1 - t) * omega) / F.nullif(s, F.lit(0.0)))
        wb = F.when(omega < 1e-12, t).otherwise(F.sin(t * omega) / F.nullif(s, F.lit(0.0)))
        x, y, z = (wa * a[c] + wb * b[c] for c in ("ux", "uy", "uz"))
        lat = F.when(k == 0, lat1).when(k == n, lat2).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
        lon = F.when(k == 0, lon1).when(k == n, lon2).otherwise(vector_to_lon(x, y))
        return F.struct(k.alias("step"), lat.alias("lat"), F.when(lon == -180.0, 180.0).otherwise(lon).alias("lon"))

    empty = F.array().cast("array<struct<step:int,lat:double,lon:double>>")
    return F.when(math.pi - omega < 1e-9, empty).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n)), at))


def midpoint(lat1, lon1, lat2, lon2) -> dict[str, Column]:
    """Half way along the great circle; between antipodes, the second point."""
    a, b = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    x, y, z = (a[c] + b[c] for c in ("ux", "uy", "uz"))
    far = x * x + y * y + z * z < 1e-18
    return {
        "lat": F.when(far, _col(lat2)).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))),
        "lon": F.when(far, _col(lon2)).otherwise(vector_to_lon(x, y)),
    }


def circle_points(lat, lon, radius_km, n: int) -> Column:
    """n + 1 points (step, lat, lon) at one distance, the last like the first; at least 3 segments."""
    n = max(3, n)
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    d = _col(radius_km) / EARTH_KM

    def at(k: Column) -> Column:
        bearing = F.pmod(k, F.lit(n)) * (2 * math.pi / n)
        sin_lat = F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(bearing)
        out_lat = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sin_lat)))
        out_lon = lon + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * sin_lat)
        return F.struct(k.alias("step"), F.degrees(out_lat).alias("lat"), normalize_lon(F.degrees(out_lon)).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def mollweide_inverse(x_m, y_m) -> dict[str, Column]:
    """Mollweide metres to latitude and longitude; out of the ellipse, the arcsine is held at its ends."""
    x, y = _col(x_m), _col(y_m)
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v))
    theta = F.asin(clamp(y / (MOLLWEIDE_M * math.sqrt(2))))
    lat = F.asin(clamp((2 * theta + F.sin(2 * theta)) / math.pi))
    lon = math.pi * x / (2 * MOLLWEIDE_M * math.sqrt(2) * F.cos(theta))
    return {"lat": F.degrees(lat), "lon": F.degrees(lon)}


def triangle_excess(a: dict[str, Column], b: dict[str, Column], c: dict[str, Column]) -> Column:
    """The signed solid angle of a spherical triangle of unit vectors."""
    dot = lambda u, v: sum((u[k] * v[k] for k in ("ux", "uy", "uz")), F.lit(0.0))
    triple = a["ux"] * (b["uy"] * c["uz"] - b["uz"] * c["uy"]) - a["uy"] * (b["ux"] * c["uz"] - b["uz"] * c["ux"]) + a["uz"] * (b["ux"] * c["uy"] - b["uy"] * c["ux"])
    return 2 * F.atan2(triple, 1 + dot(a, b) + dot(b, c) + dot(c, a))


def gnomonic(lat0, lon0, lat, lon) -> dict[str, Column]:
    """Projection to the plane that touches (lat0, lon0); null beyond the horizon."""
    p0, l0, p, l = (F.radians(_col(v)) for v in (lat0, lon0, lat, lon))
    c = F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(l - l0)
    seen = F.when(c > 1e-12, c)
    return {"x": F.cos(p) * F.sin(l - l0) / seen, "y": (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(l - l0)) / seen}
