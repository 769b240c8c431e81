"""Record holders, competitors and rankings of big cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import haversine_km
from meridia.operators.assets import numbered
from meridia.operators.graph import cut
from meridia.operators.nearest import P, T, around, chord, covering_level, in_cubes, with_vector

FLOOR = 0.1


#: Cubes of a 16th of the radius hold much of the table, but few cities have no rival so near: the smaller
#: of two of them has the larger as a rival, so they are far from each other.
COARSE, MOST_WIDE = 4, 500_000


def _met(asked: DataFrame, dealt: DataFrame) -> DataFrame:
    """asked (level, cube, ...), a written table, with the cities of their cubes: what asks for wide cubes is broadcast, up to MOST_WIDE rows, counted."""
    wide = F.col("level") < COARSE
    if asked.filter(wide).count() > MOST_WIDE:
        return asked.join(dealt, ["level", "cube"])
    far = dealt.filter(wide).join(F.broadcast(asked.filter(wide)), ["level", "cube"])
    near = asked.filter(~wide).join(dealt.filter(~wide), ["level", "cube"])
    return near.unionByName(far.select(near.columns))


def _rival_chord(cities: DataFrame, focal: DataFrame) -> DataFrame:
    """(focal_id, rival): the chord to a near city at least as large; null where there is none.

    Cubes of every other level know their largest population and how many cities have it. At the finest of
    them at which the cubes around a focal city hold a rival, the nearest in those cubes is taken: it is the nearest
    of all if it is within a side, else a bound that is at most twice the cube's diagonal.
    """
    dealt = in_cubes(cities.select("city_id", "population", *T), T)
    largest = in_cubes(cities.select("population", *T), T, 2).groupBy("level", "cube", "population").agg(F.count("*").alias("n")).groupBy("level", "cube").agg(F.max(F.struct("population", "n")).alias("top"))
    own = around(in_cubes(focal.select("focal_id", "focal_population", *P), P, 2), P)
    met = own.join(largest, ["level", "cube"]).filter(F.col("top.population") >= F.col("focal_population"))
    # the city itself is one of those of its own size
    level = met.groupBy("focal_id", "level").agg(F.sum(F.when(F.col("top.population") > F.col("focal_population"), 2).otherwise(F.col("top.n"))).alias("n")).filter("n > 1").groupBy("focal_id").agg(F.max("level").alias("level"))
    asked = cut(around(focal.join(level, "focal_id"), P))
    rival = (F.col("city_id") != F.col("focal_id")) & (F.col("population") >= F.col("focal_population"))
    found = _met(asked, dealt).filter(rival).groupBy("focal_id").agg(F.min(chord(P, T)).alias("rival"))
    return focal.select("focal_id").join(found, "focal_id", "left")


def record_holders(cities: DataFrame, focal_population: float, ring_km: float = 20.0) -> DataFrame:
    """(focal_id, focal_population, position, city_id, population, distance_km): ever larger cities with distance.

    Cities are taken by distance, larger population, id; one that is larger than all before is a
    holder if it has at least a tenth of the focal population, up to the first at least as large as
    the focal city. Smaller ones can't change that, and none beyond a rival counts, so a
    focal city meets only the cubes within a near rival's distance. The one city that may lack a rival, the
    largest, meets all. A city larger than all before is so in its ring of ``ring_km``, too; rings are
    thinned out to those first, so that no task sorts all that a far-reaching city meets.
    """
    # dealt out first: a file of one row group is one task, which would make all rows of all levels
    cities = with_vector(cut(cities.select("city_id", "population", "lat", "lon").repartition("city_id")), "lat", "lon", T)
    focal = cities.filter(F.col("population") >= focal_population).select(F.col("city_id").alias("focal_id"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), F.col("population").alias("focal_population"), *(F.col(t).alias(p) for t, p in zip(T, P)))
    reach = focal.join(_rival_chord(cities, focal), "focal_id").withColumn("rival", F.coalesce("rival", F.lit(2.0)))
    asked = cut(around(reach.withColumn("level", covering_level(F.col("rival"))), P))
    met = _met(asked, in_cubes(cities, T)).filter((F.col("city_id") != F.col("focal_id")) & (F.col("population") >= FLOOR * F.col("focal_population")) & (chord(P, T) <= F.col("rival") * (1 + 1e-6) + 1e-8))
    met = met.withColumn("distance_km", F.round(haversine_km("f_lat", "f_lon", "lat", "lon"), 6)).select("focal_id", "focal_population", "city_id", "population", "distance_km")

    def larger(rows: DataFrame, order) -> DataFrame:
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("largest", F.max("population").over(before)).filter(F.col("largest").isNull() | (F.col("population") > F.col("largest"))).drop("largest")

    by = ("distance_km", F.col("population").desc(), "city_id")
    order = Window.partitionBy("focal_id").orderBy(*by)
    thinned = larger(met.withColumn("ring", F.floor(F.col("distance_km") / ring_km)), Window.partitionBy("focal_id", "ring").orderBy(*by)).drop("ring")
    records = larger(thinned, order)
    done = F.max((F.col("population") >= F.col("focal_population")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = records.withColumn("done", F.coalesce(done, F.lit(0))).filter("done = 0")
    return kept.select("focal_id", "focal_population", F.row_number().over(order).alias("position"), "city_id", "population", "distance_km")


def competitors(holders: DataFrame, alpha: float) -> DataFrame:
    """The first holder with at least alpha times the focal population; nulls where there is none."""
    fits = F.when(F.col("population") >= alpha * F.col("focal_population"), F.col("position"))
    return holders.groupBy("focal_id", "focal_population").agg(F.min_by(F.when(fits.isNotNull(), F.struct("city_id", "population", "distance_km")), F.coalesce(fits, F.lit(1 << 30))).alias("c")).select("focal_id", "focal_population", F.col("c.city_id").alias("city_id"), F.col("c.population").alias("population"), F.col("c.distance_km").alias("distance_km"))


def ranking(found: DataFrame) -> DataFrame:
    """Focal cities with a competitor: the farthest first, then larger, then by id; with their number and the total."""
    there = cut(found.filter(F.col("city_id").isNotNull()))  # ranges are drawn from it, dealt and counted
    ranked = numbered(there, [F.col("distance_km").desc(), F.col("focal_population").desc(), "focal_id"], "rank", 1)
    return ranked.withColumn("rank", F.col("rank").cast("int")).crossJoin(F.broadcast(there.agg(F.count("*").alias("total"))))


def referenced(cities: DataFrame, holders: DataFrame) -> DataFrame:
    """The cities that are focal or hold a record, numbered by id."""
    ids = holders.select(F.col("focal_id").alias("city_id")).unionByName(holders.select("city_id")).distinct()
    return numbered(cities.join(ids, "city_id", "left_semi"), "city_id", "index", 0).withColumn("index", F.col("index").cast("int"))
