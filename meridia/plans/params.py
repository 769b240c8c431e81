"""Query parameters in link form, for single links and for columns of them.

Each parameter names the modes it belongs to, a check and a default; what isn't valid counts as absent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions.scalars import ALPHA_MAX, ALPHA_MIN, DEFAULT_ALPHA, DEFAULT_REACH_LEVEL, RADIUS_MAX_KM, RADIUS_MIN_KM, REACH_LEVELS

# Fixed: the names of modes in links, and of those no longer there.
MODES = ("antipodes", "isolation", "borders", "circle", "climate", "sunline", "truesize", "reshaped", "surnames", "names")
POINT = re.compile(r"^(-?\d{1,2}(?:\.\d+)?),(-?\d{1,3}(?:\.\d+)?)$")
TIME = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z$")


@dataclass(frozen=True)
class Parameter:
    modes: tuple[str, ...]
    pattern: str
    default: object
    convert: type = str
    allowed: tuple | None = None
    least: float | None = None
    most: float | None = None

    def read(self, mode: str | None, raw: str | None):
        if mode not in self.modes or raw is None or not re.fullmatch(self.pattern, raw):
            return self.default
        value = self.convert(raw)
        if self.allowed is not None and value not in self.allowed:
            return self.default
        if self.least is not None and not self.least <= value <= self.most:
            return self.default
        return value


PARAMETERS = {
    "alpha": Parameter(("isolation",), r"\d*\.?\d+", DEFAULT_ALPHA, float, None, ALPHA_MIN, ALPHA_MAX),
    "view": Parameter(("isolation",), "field|city", "city"),
    "reach": Parameter(("isolation",), r"\d*\.?\d+", DEFAULT_REACH_LEVEL, float, REACH_LEVELS),
    "radius": Parameter(("circle",), r"\d{1,5}", None, float, None, RADIUS_MIN_KM, RADIUS_MAX_KM),
    "metric": Parameter(("reshaped",), "population|gdp|co2|lights", "population"),
    "country": Parameter(("truesize",), r"\d{3}", None),
    "to": Parameter(("borders",), r"\d{3}", None),
    "time": Parameter(("sunline",), TIME.pattern[1:-1], None),
    "label": Parameter(("names",), "local|literal", "literal"),
    "surname": Parameter(("surnames",), "local|latin|chinese", "local"),
}


def parse(query: str) -> dict:
    """mode, lat, lon and every parameter of a link's query string."""
    given = {k: v[0] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
    mode = given.get("mode")
    mode = mode if mode in MODES else None
    point = POINT.match(given.get("point", ""))
    lat, lon = (float(x) for x in point.groups()) if point else (None, None)
    if lat is None or abs(lat) > 90 or abs(lon) > 180:
        lat = lon = None
    else:
        lon = (lon + 180) % 360 - 180 + 0.0
    return {"mode": mode, "lat": lat, "lon": lon} | {k: p.read(mode, given.get(k)) for k, p in PARAMETERS.items()}


def serialize(state: dict) -> str:
    """The query string of a state: version 2, points with four decimals, defaults left out."""
    out = {"v": "2"}
    if state.get("mode"):
        out["mode"] = state["mode"]
    if state.get("lat") is not None:
        out["point"] = f"{state['lat'] + 0.0:.4f},{state['lon'] + 0.0:.4f}"
    for k, p in PARAMETERS.items():
        if state.get("mode") in p.modes and state.get(k) != p.default:
            out[k] = f"{state[k]:g}" if isinstance(state[k], float) else str(state[k])
    return "?" + urlencode(out, safe=",:")


def same_point(a: dict, b: dict) -> bool:
    return all(a[k] is not None and b[k] is not None and f"{a[k]:.4f}" == f"{b[k]:.4f}" for k in ("lat", "lon"))


def columns(query: Column) -> dict[str, Column]:
    """mode, lat and lon of a column of query strings, null where they aren't valid."""
    text = F.concat(F.lit("&"), F.regexp_replace(query, r"^\?", ""))
    mode = F.regexp_extract(text, r"&mode=([^&]*)", 1)
    point = r"&point=(-?\d{1,2}(?:\.\d+)?)(?:,|%2C)(-?\d{1,3}(?:\.\d+)?)(?:&|$)"
    lat, lon = (F.regexp_extract(text, point, k).try_cast("double") for k in (1, 2))
    good = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return {"mode": F.when(mode.isin(*MODES), mode), "lat": F.when(good, lat), "lon": F.when(good, F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)}
