"""Streaming forms: nearest cities for arriving points, counts in windows, the sun as time passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import solar
from meridia.functions.geo import haversine_km


def sun_over(ticks: DataFrame, places: DataFrame) -> DataFrame:
    """(ts, point_id, altitude, state) for each tick (ts) and each of a few places."""
    met = ticks.crossJoin(F.broadcast(places))
    alt = F.round(solar.altitude(F.col("ts"), F.col("lat"), F.col("lon")), 6)
    return met.select("ts", "point_id", alt.alias("altitude"), solar.daylight(alt).alias("state"))


def nearest_in_cells(events: DataFrame, cities: DataFrame, step: float = 5.0) -> DataFrame:
    """Arriving points with the nearest city of their own and the surrounding cells, null if there is none.

    Cities are gathered by cell beforehand, so a stream meets them in one equi-join and keeps no state.
    """
    across, down = int(360 / step), int(180 / step)
    span = F.array(*map(F.lit, (-1, 0, 1)))
    spread = cities.withColumn("i", F.least(F.floor((F.col("lat") + 90) / step), F.lit(down - 1))).withColumn("j", F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / step))
    spread = spread.withColumn("di", F.explode(span)).withColumn("dj", F.explode(span)).filter((F.col("i") + F.col("di")).between(0, down - 1))
    cell = ((F.col("i") + F.col("di")) * across + F.pmod(F.col("j") + F.col("dj"), F.lit(across))).cast("int")
    near = spread.groupBy(cell.alias("cell")).agg(F.collect_list(F.struct("city_id", F.col("lat").alias("y"), F.col("lon").alias("x"), "population")).alias("near"))
    i, j = F.least(F.floor((F.col("lat") + 90) / step), F.lit(down - 1)), F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / step)
    met = events.withColumn("cell", (i * across + j).cast("int")).join(near, "cell", "left")
    ranked = F.transform("near", lambda c: F.struct(F.round(haversine_km(F.col("lat"), F.col("lon"), c["y"], c["x"]), 6).alias("distance_km"), (-c["population"]).alias("p"), c["city_id"].alias("city_id")))
    best = F.array_min(ranked)
    return met.select(*events.columns, best["city_id"].alias("city_id"), best["distance_km"].alias("distance_km"))


def window_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by type in windows of time; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
