"""Points through a displacement field and back, and the error of a round trip.

A field gives, at the corners of a mesh in longitude and sine of latitude, how far a place on the map lies
from its place on the globe. From the map to the globe is an interpolation, an equi-join with the four
corners. From the globe to the map has no closed form: tasks solve batches of points by damped Newton
steps, from the point itself, along a continuation from the unmoved map, and last from places around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.stats import nearest_rank

MOST_CORNERS = 4_000_000  #: 64 MB of a field at most go to each task
SOLVED = 1e-10  # squared degrees
FACTOR, ADDEND, SEED = 1664525, 1013904223, 0x4D524533  # fixed values of the published sample stream


def _turned(x: Column) -> Column:
    return F.pmod(x + 180, F.lit(360.0)) - 180


def sample_displacement(points: DataFrame, field: DataFrame, height: int, width: int, key: str) -> DataFrame:
    """(key, x, y, dlon, ds): the field at points (key, x, y), shares of the map's width and, from the south, height.

    field: (j, i, dlon, ds), a node at each corner, j from 0 to height, i from 0 to width. Longitudes are
    turned to the lower left corner's before they are weighed; columns wrap, rows end at the poles.
    """
    at = points.select(key, "x", "y", (F.pmod("x", F.lit(1.0)) * width).alias("sx"), (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("y"))) * height).alias("sy"))
    at = at.withColumn("i0", F.least(F.lit(width - 1), F.floor("sx"))).withColumn("j0", F.least(F.lit(height - 1), F.floor("sy")))
    four = at.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(4))))).withColumn("i", F.col("i0") + F.col("k") % 2).withColumn("j", F.col("j0") + F.expr("k div 2"))
    tx, ty = F.col("sx") - F.col("i0"), F.col("sy") - F.col("j0")
    w = F.when(F.col("k") % 2 == 0, 1 - tx).otherwise(tx) * F.when(F.col("k") < 2, 1 - ty).otherwise(ty)
    met = four.withColumn("w", w).join(field, ["j", "i"]).groupBy(key, "x", "y").agg(F.sort_array(F.collect_list(F.struct("k", "w", "dlon", "ds"))).alias("ks"))
    base = F.col("ks")[0]["dlon"]
    lon = F.aggregate("ks", F.lit(0.0), lambda s, k: s + (base + _turned(k["dlon"] - base)) * k["w"])
    return met.select(key, "x", "y", lon.alias("dlon"), F.aggregate("ks", F.lit(0.0), lambda s, k: s + k["ds"] * k["w"]).alias("ds"))


def morph_latitude(start: Column, end: Column, t: float) -> Column:
    """From one latitude to another, evenly in sine of latitude, measured from the nearer pole so that poles stay exact."""
    if t <= 0 or t >= 1:
        return start if t <= 0 else end
    a, b = F.radians(start), F.radians(end)
    north = (1 - t) * F.sin(a) + t * F.sin(b) >= 0
    pole = F.when(north, F.lit(np.pi / 2)).otherwise(F.lit(-np.pi / 2))
    part = lambda x: F.pow(F.sin((pole - x) / 2), F.lit(2))
    away = 2 * F.asin(F.least(F.lit(1.0), F.sqrt((1 - t) * part(a) + t * part(b))))
    return F.degrees(F.when(north, pole - away).otherwise(pole + away))


def to_globe(points: DataFrame, field: DataFrame, height: int, width: int, key: str, t: float = 1.0) -> DataFrame:
    """(key, lat, lon): where on the globe the places (key, lat, lon) of a map are, which has moved by ``t``, from 0 to 1."""
    lon = _turned(F.col("lon"))
    spots = points.select(key, ((lon + 180) / 360).alias("x"), ((F.sin(F.radians("lat")) + 1) / 2).alias("y"), lon.alias("from_lon"), F.col("lat").alias("from_lat"))
    met = spots.join(sample_displacement(spots, field, height, width, key).select(key, "dlon", "ds"), key)
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("y") + F.col("ds") / 2))
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * y - 1))))
    return met.select(key, morph_latitude(F.col("from_lat"), lat, t).alias("lat"), _turned(F.col("from_lon") + _turned(F.col("dlon")) * t).alias("lon"))


# ---- the same in tasks


def _wrap(x: np.ndarray) -> np.ndarray:
    return (x + 180) % 360 - 180


class Field:
    """A field's corners as arrays, for tasks that solve points."""

    def __init__(self, corners: pd.DataFrame, height: int, width: int):
        if len(corners) != (height + 1) * (width + 1):
            raise ValueError("a field needs each corner of its mesh once")
        by = corners.sort_values(["j", "i"])
        self.height, self.width = height, width
        self.dlon, self.ds = (by[c].to_numpy(float).reshape(height + 1, width + 1) for c in ("dlon", "ds"))

    def globe(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = ((_wrap(lon) + 180) / 360) % 1, (np.sin(np.radians(lat)) + 1) / 2
        sx, sy = x * self.width, np.clip(y, 0, 1) * self.height
        i, j = np.minimum(self.width - 1, sx.astype(int)), np.minimum(self.height - 1, sy.astype(int))
        tx, ty = sx - i, sy - j
        base, dlon, ds = self.dlon[j, i], 0.0, 0.0
        for dj, di, w in ((0, 0, (1 - tx) * (1 - ty)), (0, 1, tx * (1 - ty)), (1, 0, (1 - tx) * ty), (1, 1, tx * ty)):
            dlon = dlon + (base + _wrap(self.dlon[j + dj, i + di] - base)) * w
            ds = ds + self.ds[j + dj, i + di] * w
        return _wrap(lon + dlon), np.degrees(np.arcsin(np.clip(2 * np.clip(y + ds / 2, 0, 1) - 1, -1, 1)))

    def moved(self, lon: np.ndarray, lat: np.ndarray, amount: float) -> tuple[np.ndarray, np.ndarray]:
        """The globe's place of a map's that has moved by a part only."""
        x, y = self.globe(lon, lat)
        if amount >= 1:
            return x, y
        a, b = np.radians(lat), np.radians(y)
        north = (1 - amount) * np.sin(a) + amount * np.sin(b) >= 0
        pole = np.where(north, np.pi / 2, -np.pi / 2)
        away = 2 * np.arcsin(np.minimum(1, np.sqrt((1 - amount) * np.sin((pole - a) / 2) ** 2 + amount * np.sin((pole - b) / 2) ** 2)))
        return lon + _wrap(x - lon) * amount, np.degrees(np.where(north, pole - away, pole + away))


def _off(field: Field, lon, lat, to_lon, to_lat, amount=1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far a map's places lead from the places asked for, in degrees, and the squared distance on the globe."""
    x, y = field.moved(lon, lat, amount)
    ex, ey = _wrap(x - to_lon), y - to_lat
    return ex, ey, (ex * np.maximum(0.001, np.cos(np.radians(to_lat)))) ** 2 + ey**2


def _newton(field: Field, lon, lat, to_lon, to_lat, amount=1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Damped Newton steps for all points at once; a point stops where it is close, flat, or no shorter step is nearer."""
    lon, lat = lon.copy(), lat.copy()
    open_ = np.arange(len(lon))
    for _ in range(rounds):
        x, y, tx, ty = lon[open_], lat[open_], to_lon[open_], to_lat[open_]
        ex, ey, norm = _off(field, x, y, tx, ty, amount)
        left = (np.abs(ex) >= 1e-7) | (np.abs(ey) >= 1e-7)
        open_, x, y, tx, ty, ex, ey, norm = (v[left] for v in (open_, x, y, tx, ty, ex, ey, norm))
        if not len(open_):
            break
        hx, hy = 0.001, np.where(y > 89.999, -0.0001, 0.0001)
        here = field.moved(x, y, amount)
        east, north = field.moved(x + hx, y, amount), field.moved(x, y + hy, amount)
        a, b = _wrap(east[0] - here[0]) / hx, _wrap(north[0] - here[0]) / hy
        c, d = (east[1] - here[1]) / hx, (north[1] - here[1]) / hy
        det = a * d - b * c
        steep = np.abs(det) >= 1e-10
        open_, x, y, tx, ty, ex, ey, norm, a, b, c, d, det = (v[steep] for v in (open_, x, y, tx, ty, ex, ey, norm, a, b, c, d, det))
        dx, dy = np.clip((d * ex - b * ey) / det, -30, 30), np.clip((a * ey - c * ex) / det, -20, 20)
        took, wait = np.zeros(len(open_), bool), np.arange(len(open_))
        for halving in range(13):
            nx, ny = x[wait] - dx[wait] / 2**halving, np.clip(y[wait] - dy[wait] / 2**halving, -90, 90)
            nearer = _off(field, nx, ny, tx[wait], ty[wait], amount)[2] < norm[wait]
            some = wait[nearer]
            lon[open_[some]], lat[open_[some]], took[some] = nx[nearer], ny[nearer], True
            wait = wait[~nearer]
            if not len(wait):
                break
        open_ = open_[took]
    return _wrap(lon), lat


def solve_points(field: Field, to_lon: np.ndarray, to_lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lon, lat, squared error) of the map's places that lead to the globe's."""
    lon, lat = _newton(field, to_lon, to_lat, to_lon, to_lat)
    norm = _off(field, lon, lat, to_lon, to_lat)[2]

    def better(some: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        n = _off(field, x, y, to_lon[some], to_lat[some])[2]
        less = n < norm[some]
        at = some[less]
        lon[at], lat[at], norm[at] = x[less], y[less], n[less]

    some = np.flatnonzero(norm >= SOLVED)
    if len(some):
        x, y = to_lon[some], to_lat[some]
        for stage in range(1, 17):
            x, y = _newton(field, x, y, to_lon[some], to_lat[some], stage / 16)
        better(some, x, y)
    for step_lon in (-30, -15, 15, 30):
        for step_lat in (-20, -10, 10, 20):
            some = np.flatnonzero(norm > SOLVED)
            if len(some):
                better(some, *_newton(field, _wrap(to_lon[some] + step_lon), np.clip(to_lat[some] + step_lat, -90, 90), to_lon[some], to_lat[some]))
    return lon, lat, norm


def load_field(field: DataFrame, height: int, width: int) -> Field:
    """The corners at the driver, to be sent to tasks; a mesh has a fixed size, and one beyond MOST_CORNERS is an error."""
    if (height + 1) * (width + 1) > MOST_CORNERS:
        raise ValueError(f"a field of more than {MOST_CORNERS} corners doesn't go to tasks")
    return Field(field.select("j", "i", "dlon", "ds").limit(MOST_CORNERS + 1).toPandas(), height, width)


def to_map(points: DataFrame, field: DataFrame, height: int, width: int, key: str) -> DataFrame:
    """(key, lat, lon, error): where on the map the globe's places (key, lat, lon) are, and the degrees by which that misses."""
    corners = load_field(field, height, width)
    kind = points.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lon, lat, norm = solve_points(corners, _wrap(batch.column("lon").to_numpy(zero_copy_only=False).astype(float)), batch.column("lat").to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lat), pa.array(lon), pa.array(np.sqrt(norm))], [key, "lat", "lon", "error"])

    whole = points.filter("lat is not null and lon is not null").select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return whole.mapInArrow(run, f"{key} {kind}, lat double, lon double, error double")


# ---- round trip


def stream_states(at: np.ndarray, seed: int = SEED) -> np.ndarray:
    """States of the linear congruential stream after so many steps each, by powers of its step: no state needs the one before."""
    left, state = at.astype(np.uint64), np.full(len(at), seed, np.uint64)
    factor, addend, low = FACTOR, ADDEND, np.uint64(0xFFFFFFFF)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        state[odd] = (state[odd] * np.uint64(factor) + np.uint64(addend)) & low
        factor, addend = factor * factor & 0xFFFFFFFF, (factor + 1) * addend & 0xFFFFFFFF
        left >>= np.uint64(1)
    return state


def round_trip_errors(spark: SparkSession, field: DataFrame, height: int, width: int, samples: int = 400_000) -> DataFrame:
    """(sample, degrees): how far each sampled place of the map is from where it is found again from the globe.

    Samples are even in area, and the same however many tasks draw them. One that is not found is an error.
    """
    corners = load_field(field, height, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            x, y = ((stream_states(2 * n + k) + 0.5) / 2**32 for k in (1, 2))
            lon, lat = x * 360 - 180, np.degrees(np.arcsin(np.clip(2 * y - 1, -1, 1)))
            found_lon, found_lat, norm = solve_points(corners, *corners.globe(lon, lat))
            if (norm > SOLVED).any():
                raise ValueError(f"{int((norm > SOLVED).sum())} samples are not found again, the first {int(n[norm > SOLVED][0])}")
            a, b = np.radians(lat), np.radians(found_lat)
            h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(_wrap(lon - found_lon)) / 2) ** 2
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(2 * np.degrees(np.arcsin(np.sqrt(np.clip(h, 0, 1)))))], ["sample", "degrees"])

    return spark.range(samples).mapInArrow(run, "sample long, degrees double")


def round_trip_summary(errors: DataFrame) -> DataFrame:
    """One row: samples and the errors that half, 99 % and 99.9 % of them have at most, and the largest."""
    marks = nearest_rank(errors, "degrees", (0.5, 0.99)).withColumnsRenamed({"n": "samples"})
    rest = errors.agg(F.expr("percentile_disc(0.999) WITHIN GROUP (ORDER BY degrees)").alias("p999"), F.max("degrees").alias("worst"))
    return marks.join(F.broadcast(rest))
