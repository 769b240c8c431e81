"""Nearest-neighbour joins on the sphere.

Unit vectors are dealt into cubes of side 2**-level, a cube in space having no pole or date line. All
points within one side of a point lie in its cube or one of the 26 around it. Each point first finds
the finest level at which any target is that close. There, and again at the level that covers the bound
so found, it meets one target for each smaller cube (FINER levels below), so that no cube's key has more
than a few hundred rows, however many targets lie in it. Only smaller cubes that could hold something
nearer are opened. All are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.geo import antipode, haversine_atan2_km, haversine_km, unit_vector

LEVELS = 13  #: sides from 1 down to 2**-12 of the radius, about 1.6 km
_AXES = ("ux", "uy", "uz")
FINER = 4  #: how many levels below a cube its smaller ones are
_SPAN = 16384  # more than there are cubes along an axis at any level
_AROUND = [(i * _SPAN + j) * _SPAN + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
P, T = ("_px", "_py", "_pz"), ("_tx", "_ty", "_tz")


def _cube(vector: tuple[str, str, str]) -> Column:
    """One number for the cube of a unit vector at the row's level; the cubes around it differ by fixed numbers."""
    return cube_at(vector, F.col("level"))


def cube_at(vector: tuple[str, str, str], level: Column) -> Column:
    side = F.pow(F.lit(2.0), level)
    # a coordinate of exactly 1 is in the last cube, so that the 27 of level 0 hold the whole sphere
    x, y, z = (F.least(F.floor(F.col(v) * side), side.cast("long") - 1) + _SPAN // 2 for v in vector)
    return (x * _SPAN + y) * _SPAN + z


def spread(df: DataFrame) -> DataFrame:
    """df, whose rows an explode has multiplied, never to be broadcast: Spark takes its size for that of the rows before."""
    return df.hint("merge")


def in_cubes(df: DataFrame, vector: tuple[str, str, str], step: int = 1) -> DataFrame:
    """A row for each level, or each ``step`` levels from 0 on, with the cube of its vector."""
    return spread(df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1), F.lit(step)))).withColumn("cube", _cube(vector)))


def around(df: DataFrame, vector: tuple[str, str, str]) -> DataFrame:
    """A row for each of the cubes around a vector at the row's level."""
    return spread(df.withColumn("cube", _cube(vector)).withColumn("_step", F.explode(F.array(*map(F.lit, _AROUND)))).withColumn("cube", F.col("cube") + F.col("_step")).drop("_step"))


def covering_level(chord: Column) -> Column:
    """The finest level whose cubes around a point hold all that is within a chord, with room for rounding."""
    reach = chord * (1 + 1e-6) + 1e-8
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(-F.log2(reach)))).cast("int")


def chord(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    return F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)), F.lit(0.0)))


def with_vector(df: DataFrame, lat: str, lon: str, names: tuple[str, str, str]) -> DataFrame:
    u = unit_vector(lat, lon)
    return df.select("*", *(u[a].alias(n) for a, n in zip(_AXES, names)))


def nearest_join(points: DataFrame, targets: DataFrame, key: str, order: list[Column], distance=haversine_km) -> DataFrame:
    """Each row of points (key, lat, lon, ...) with the target (t_lat, t_lon, ...) that is nearest, then first by order.

    Distances count to six decimals, so that ties are ties. Adds ``distance_km`` and the targets'
    columns; points without any target have nulls.
    """
    kept = [c for c in targets.columns if c not in points.columns]
    first = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))
    # of targets in one place only the first by order can be asked for
    sole = targets.groupBy("t_lat", "t_lon").agg(F.min_by(F.struct(*targets.columns), first).alias("t")).select("t.*")
    p, t = with_vector(points.select(key, "lat", "lon"), "lat", "lon", P), with_vector(sole, "t_lat", "t_lon", T)
    dealt = in_cubes(t.select(*T), T).withColumn("finer", F.least(F.col("level") + FINER, F.lit(LEVELS - 1)))
    each = dealt.withColumn("small", cube_at(T, F.col("finer"))).groupBy("level", "cube", "finer", "small").agg(F.min(F.struct(*T)).alias("one")).select("level", "cube", "finer", "small", "one.*")
    # a point is close to a target at a level where the cubes around the one hold the other; the fewer of both look around
    if points.count() <= targets.count():
        own, occupied = around(in_cubes(p, P), P), each.select("level", "cube").distinct()
    else:
        own, occupied = in_cubes(p, P), each.select("level", F.explode(F.transform(F.array(*map(F.lit, _AROUND)), lambda step: F.col("cube") - step)).alias("cube")).distinct()
    close = own.select(key, "level", "cube").join(occupied, ["level", "cube"], "left_semi").groupBy(key).agg(F.max("level").alias("level"))
    bound = around(p.join(close, key), P).join(each, ["level", "cube"]).groupBy(key).agg(F.min(chord(P, T)).alias("_bound"))
    asked = around(p.join(bound, key).withColumn("level", covering_level(F.col("_bound"))), P).join(each, ["level", "cube"])
    room = F.col("_bound") * (1 + 1e-6) + 1e-8
    opened = asked.filter(chord(P, T) <= room + 3**0.5 * F.pow(F.lit(2.0), -F.col("finer"))).select(key, "lat", "lon", *P, "_bound", F.col("finer").alias("level"), F.col("small").alias("cube"))
    met = opened.join(in_cubes(t, T), ["level", "cube"]).filter(chord(P, T) <= room)
    met = met.withColumn("distance_km", F.round(distance("lat", "lon", "t_lat", "t_lon"), 6))
    best = met.groupBy(key).agg(F.min_by(F.struct("distance_km", *kept), F.struct(F.col("distance_km").alias("d"), first.alias("o"))).alias("best"))
    return points.join(best, key, "left").select(*points.columns, "best.distance_km", *(F.col(f"best.{c}") for c in kept))


def as_targets(cities: DataFrame) -> DataFrame:
    return cities.select(F.col("city_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), "population")


def nearest_city(points: DataFrame, cities: DataFrame, key: str) -> DataFrame:
    """Ties: the larger population, then the smaller id."""
    return nearest_join(points, as_targets(cities), key, [-F.col("population"), F.col("city_id")], distance=haversine_atan2_km)


def nearest_focal(points: DataFrame, focal: DataFrame, key: str) -> DataFrame:
    """Ties: the smaller id as text."""
    return nearest_join(points, as_targets(focal), key, [F.col("city_id").cast("string")])


def antipode_relation(points: DataFrame, cities: DataFrame, key: str) -> DataFrame:
    """For each point: its antipode and the nearest city to either end, in one row."""
    far = antipode("lat", "lon")
    ends = points.select(key, F.explode(F.array(F.struct(F.lit(0).alias("far"), F.col("lat"), F.col("lon")), F.struct(F.lit(1).alias("far"), far["lat"].alias("lat"), far["lon"].alias("lon")))).alias("e")).select(key, "e.*")
    ends = ends.withColumn("end", F.struct(key, "far"))
    found = nearest_city(ends, cities, "end")
    pick = lambda far, c: F.max(F.when(F.col("far") == far, F.col(c)))
    return found.groupBy(key).agg(*(pick(f, c).alias(f"{n}_{c}") for f, n in ((0, "here"), (1, "far")) for c in ("lat", "lon", "city_id", "distance_km")))
