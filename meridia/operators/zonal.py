"""Sums of a raster by labels, their roll-up, conservation and density targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.raster import row_weight


def zonal_sum(raster: DataFrame, labels: DataFrame, excluded: list[int] | None = None) -> DataFrame:
    """(label, kind, total): by the label of each cell. Cells without one are unassigned (label 0); excluded labels are told apart."""
    met = raster.join(labels, ["r", "c"], "left").withColumn("label", F.coalesce("lab", F.lit(0)))
    kind = F.when(F.col("label") == 0, "unassigned").when(F.col("label").isin(*(excluded or [-1])), "excluded").otherwise("unit")
    return met.groupBy("label", kind.alias("kind")).agg(F.sum("v").alias("total"), F.count("*").alias("cells"))


def zonal_weighted(coarse: DataFrame, labels: DataFrame, factor: int, height: int) -> DataFrame:
    """(label, total): each coarse cell's value split over its labelled fine cells by their area on the sphere.

    A coarse cell without any label goes to label 0 whole.
    """
    fine = labels.filter("lab > 0").select(F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c"), "lab", row_weight(F.col("r"), height).alias("w"))
    share = fine.groupBy("r", "c", "lab").agg(F.sum("w").alias("w"))
    share = share.withColumn("part", F.col("w") / F.sum("w").over(Window.partitionBy("r", "c")))
    met = coarse.join(share, ["r", "c"], "left")
    return met.groupBy(F.coalesce("lab", F.lit(0)).alias("label")).agg(F.sum(F.col("v") * F.coalesce("part", F.lit(1.0))).alias("total"))


def roll_up(zonal: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, total, children): sums of the children that have a total; null where none has."""
    return parents.join(zonal.select(F.col("label"), "total"), "label", "left").groupBy("parent").agg(F.sum("total").alias("total"), F.count("total").alias("children"))


def conservation(raster: DataFrame, zonal: DataFrame) -> DataFrame:
    """One row: the sums before and after, and whether they agree within 1e-9 of the first."""
    a, b = raster.agg(F.sum("v").cast("double").alias("source")), zonal.agg(F.sum("total").cast("double").alias("assigned"))
    off = F.abs(F.col("source") - F.col("assigned"))
    return a.crossJoin(b).select("source", "assigned", (off <= 1e-9 * F.greatest(F.abs("source"), F.lit(1.0))).alias("conserved"))


def density_targets(units: DataFrame) -> DataFrame:
    """(label, area, value) to densities, shares and target areas.

    Without a value, a unit gets the mean density; with 0, a hundredth of it. Densities are brought to
    mean 1, so that targets keep the whole area.
    """
    whole = Window.partitionBy()
    known = F.col("value").isNotNull()
    mean = F.sum(F.when(known, F.col("value"))).over(whole) / F.sum(F.when(known, F.col("area"))).over(whole)
    density = F.when(~known, mean).when(F.col("value") == 0, mean / 100).otherwise(F.col("value") / F.col("area"))
    dense = units.withColumn("density", density).withColumn("mass", F.col("density") * F.col("area"))
    share = F.col("mass") / F.sum("mass").over(whole)
    target = share * F.sum("area").over(whole)
    return dense.select("label", "area", "value", F.round("density", 9).alias("density"), F.round(share, 9).alias("share"), F.round(target, 6).alias("target_area"), F.round(target / F.col("area"), 6).alias("ratio"))


def pair_overlay(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    """(la, lb, area, cells) of two label rasters over each other."""
    met = a.select("r", "c", F.col("lab").alias("la")).join(b.select("r", "c", F.col("lab").alias("lb")), ["r", "c"])
    return met.groupBy("la", "lb").agg(F.round(F.sum(row_weight(F.col("r"), height)), 9).alias("area"), F.count("*").alias("cells"))


def border_lengths(labels: DataFrame, width: int) -> DataFrame:
    """(la, lb, edges): how many cell edges two labels share; columns wrap."""
    right = labels.select(F.col("r").alias("r2"), F.pmod(F.col("c") - 1, F.lit(width)).alias("c2"), F.col("lab").alias("l2"))
    below = labels.select((F.col("r") - 1).alias("r2"), F.col("c").alias("c2"), F.col("lab").alias("l2"))
    met = labels.join(right.unionByName(below), (F.col("r") == F.col("r2")) & (F.col("c") == F.col("c2")) & (F.col("lab") != F.col("l2")))
    return met.groupBy(F.least("lab", "l2").alias("la"), F.greatest("lab", "l2").alias("lb")).agg(F.count("*").alias("edges"))


def transfer(pairs: DataFrame, edges: DataFrame, least: float = 0.95) -> DataFrame:
    """Where each region lb of the overlay goes: to the unit with least or more of its area, else to the one it shares the longest edge with, then by area, then label."""
    whole = Window.partitionBy("lb")
    shares = pairs.withColumn("share", F.col("area") / F.sum("area").over(whole))
    long = edges.select("la", "lb", "edges")
    ranked = shares.join(long, ["la", "lb"], "left")
    order = whole.orderBy((F.col("share") >= least).desc(), F.coalesce("edges", F.lit(0)).desc(), F.col("area").desc(), "la")
    return ranked.withColumn("n", F.row_number().over(order)).filter("n = 1").select("lb", "la", F.round("share", 6).alias("share"), F.when(F.col("share") >= least, "dominant").otherwise("remnant").alias("rule"))


def compare_totals(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(id, equal) of two (id, total) tables: both null, equal, or less than ``tolerance`` of the second apart."""
    met = a.select("id", F.col("total").alias("x")).join(b.select("id", F.col("total").alias("y")), "id", "full_outer")
    near = (F.col("x") == F.col("y")) | (F.abs(F.col("x") - F.col("y")) < tolerance * F.abs("y"))
    return met.select("id", F.when(F.col("x").isNull() & F.col("y").isNull(), True).otherwise(F.coalesce(near, F.lit(False))).alias("equal"))


def overlay_borders(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(la, lb, edges): how many cell edges each label of b shares with each label of a across it; rows wrap.

    a, b: (r, c, lab). A cell of b counts for each of its four neighbours that a different label of b has.
    """
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    own = b.select("r", "c", F.col("lab").alias("lb"))
    around = own.select("lb", F.explode(steps).alias("s"), "r", "c").select("lb", (F.col("r") + F.col("s.i")).alias("r"), F.pmod(F.col("c") + F.col("s.j"), F.lit(width)).alias("c"))
    other = b.select("r", "c", F.col("lab").alias("other"))
    return around.join(other, ["r", "c"]).filter("lb <> other").join(a.select("r", "c", F.col("lab").alias("la")), ["r", "c"]).groupBy("la", "lb").agg(F.count("*").alias("edges"))
