"""Places with another class at the same latitude, and far places with the same class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import EARTH_KM, haversine_km
from meridia.operators.graph import cut
from meridia.operators.nearest import P, T, spread, with_vector

MAX_LATITUDE_GAP, MIN_OTHER_KM, MIN_TWIN_KM, LIMIT = 1.0, 500.0, 3000.0, 3
FAR_LEVEL = 2  # cubes of a quarter of the radius
#: Rows of latitude are a degree wide, then a quarter of that at each level, down to a 1024th.
ROW_LEVELS, ROW_PARTS, PARTS = 6, 4, 64


def first_of_each(df: DataFrame, point: str, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first row of each key by order, then the first ``limit`` of those, for each point."""
    # an aggregation, so that a task keeps one row a key before anything is shuffled or sorted
    heads = df.groupBy(point, key).agg(F.min_by(F.struct(*(c for c in df.columns if c not in (point, key))), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("_row")).select(point, key, "_row.*")
    return heads.withColumn("position", F.row_number().over(Window.partitionBy(point).orderBy(*order))).filter(F.col("position") <= limit)


_ORDER = ("population", "city_id")


def _order() -> list[Column]:
    return [-F.col("population"), F.col("city_id")]


def _leading(cities: DataFrame, by: list[str], least_km: float) -> DataFrame:
    """The cities that may be the largest of their group (by) from ``least_km`` on, for a point anywhere.

    They end with the first that is twice as far from the group's largest: whoever is too near to that one is
    far enough from this one. Parts of a group are thinned out first, so that no task has all of a large one.
    """
    out = cities.withColumn("_part", F.pmod(F.hash("city_id"), F.lit(PARTS)))
    for keys in ([*by, "_part"], by):
        order = Window.partitionBy(*keys).orderBy(*_order())
        top = F.first(F.struct("lat", "lon")).over(order)
        out = out.withColumn("_off", (haversine_km(top["lat"], top["lon"], "lat", "lon") > 2 * least_km + 0.01).cast("int"))
        out = out.withColumn("_done", F.max("_off").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("coalesce(_done, 0) = 0").drop("_off", "_done")
    return out.drop("_part")


def _rows_within(points: DataFrame) -> DataFrame:
    """points with level and row: the widest rows of latitude that lie wholly within the gap of p_lat; level ROW_LEVELS has the narrow ones that its ends cut."""
    south, north, slack = F.col("p_lat") - MAX_LATITUDE_GAP, F.col("p_lat") + MAX_LATITUDE_GAP, 1e-9
    # up to the last row, without any where it comes before the first
    run = lambda level, first, last: F.when(last >= first, F.transform(F.sequence(first, last), lambda r: F.struct(F.lit(level).alias("level"), r.alias("row")))).otherwise(F.array().cast("array<struct<level:int,row:bigint>>"))
    pieces, wider = [], None
    for level in range(ROW_LEVELS):
        size = ROW_PARTS**level
        first, last = F.ceil((south + slack) * size), F.floor((north - slack) * size) - 1
        if wider is None:
            pieces.append(run(level, first, last))
        else:
            pieces += [run(level, first, wider[0] * ROW_PARTS - 1), run(level, (wider[1] + 1) * ROW_PARTS, last)]
        wider = first, last
    pieces += [run(ROW_LEVELS, F.floor((south - slack) * size), first - 1), run(ROW_LEVELS, last + 1, F.floor((north + slack) * size))]
    return spread(points.withColumn("_at", F.explode(F.concat(*pieces))).select(*points.columns, "_at.level", "_at.row"))


def same_latitude(points: DataFrame, cities: DataFrame, key: str = "point_id") -> DataFrame:
    """Cities within a degree of latitude and beyond 500 km whose class differs: the largest of each class, three at most.

    points: key, p_lat, p_lon, p_class; cities: city_id, lat, lon, population, class, country_id. A point meets the
    leading cities of each class in a few rows of latitude that make up its two degrees, and city by city only
    those in the 1024ths of a degree at both ends; of a class's cities on one latitude only the leading ones.
    """
    kept = cities.filter("class > 0").select("city_id", "lat", "lon", "population", "class", "country_id")
    alike = cut(_leading(kept, ["class", "lat"], MIN_OTHER_KM))
    row = lambda level: F.floor(F.col("lat") * ROW_PARTS**level)
    rows = F.array(*(F.struct(F.lit(level).alias("level"), row(level).alias("row")) for level in range(ROW_LEVELS)))
    wide = _leading(alike.withColumn("_at", F.explode(rows)).select(*alike.columns, "_at.level", "_at.row"), ["class", "level", "row"], MIN_OTHER_KM)
    ends = alike.withColumn("level", F.lit(ROW_LEVELS)).withColumn("row", row(ROW_LEVELS - 1))
    met = _rows_within(points).join(wide.unionByName(ends), ["level", "row"]).withColumn("distance_km", F.round(haversine_km("p_lat", "p_lon", "lat", "lon"), 6))
    kept = met.filter((F.abs(F.col("lat") - F.col("p_lat")) <= MAX_LATITUDE_GAP) & (F.col("class") != F.col("p_class")) & (F.col("distance_km") >= MIN_OTHER_KM)).drop("level", "row")
    return first_of_each(kept, key, "class", _order(), LIMIT).select(key, F.lit("same-latitude").alias("list"), "position", "city_id", "class", "country_id", "distance_km")


def far_twins(points: DataFrame, cities: DataFrame, key: str = "point_id") -> DataFrame:
    """Cities of the same class from 3000 km on: the largest of each country, three at most.

    Only a class's leading cities of a country count. Those in one cube of space have a head, the largest. A cube that is far
    enough as a whole offers its head only, one that is too near as a whole nothing; just the cities
    of cubes across the limit are met one by one. Heads are as many as places, not as cities.
    """
    side, limit = F.lit(2.0**-FAR_LEVEL), 2 * math.sin(MIN_TWIN_KM / 2 / EARTH_KM)
    placed = with_vector(cut(_leading(cities.filter("class > 0").select("city_id", "lat", "lon", "population", "class", "country_id"), ["class", "country_id"], MIN_TWIN_KM)), "lat", "lon", T)
    for axis in T:
        placed = placed.withColumn(f"{axis}_at", F.floor(F.col(axis) / side))
    box = [f"{axis}_at" for axis in T]
    group = ["class", "country_id", *box]
    rows = F.struct("city_id", "lat", "lon", "population")
    heads = placed.groupBy(*group).agg(F.min_by(rows, F.struct(-F.col("population"), "city_id")).alias("head"))
    asked = with_vector(points, "p_lat", "p_lon", P)
    centre = tuple(((F.col(b) + 0.5) * side) for b in box)
    to = F.sqrt(sum(((F.col(x) - c) * (F.col(x) - c) for x, c in zip(P, centre)), F.lit(0.0)))
    slack = math.sqrt(3) / 2 * 2.0**-FAR_LEVEL + 1e-6
    met = asked.join(heads, F.col("p_class") == F.col("class")).withColumn("_to", to).filter(F.col("_to") + slack >= limit)
    own = [c for c in points.columns]
    whole = met.filter(F.col("_to") - slack >= limit).select(*own, "class", "country_id", "head.*")
    parted = met.filter(F.col("_to") - slack < limit).select(*own, *group).join(placed.select(*group, "city_id", "lat", "lon", "population"), group).select(*own, "class", "country_id", "city_id", "lat", "lon", "population")
    found = whole.unionByName(parted).withColumn("distance_km", F.round(haversine_km("p_lat", "p_lon", "lat", "lon"), 6)).filter(F.col("distance_km") >= MIN_TWIN_KM)
    return first_of_each(found, key, "country_id", _order(), LIMIT).select(key, F.lit("far-twin").alias("list"), "position", "city_id", "class", "country_id", "distance_km")


def twins(points: DataFrame, cities: DataFrame, key: str = "point_id") -> DataFrame:
    """Both lists; a point of class 0, at sea, has only the first."""
    return same_latitude(points, cities, key).unionByName(far_twins(points, cities, key))
