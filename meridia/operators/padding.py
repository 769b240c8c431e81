"""What is left of a region's cells when those nearest its border give way until it has its target area."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.reach import spread


def _neighbours(labels: DataFrame, height: int, width: int) -> DataFrame:
    """(a, b, va, vb, hours): each cell with its eight neighbours, columns wrapping, at their spherical distance in radians; vb null beyond the raster."""
    dlat, dlon = math.pi / height, 2 * math.pi / width
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    spread_ = labels.select("r", "c", F.col("v").alias("va"), F.explode(steps).alias("s"))
    moved = spread_.select("r", "c", "va", "s", (F.col("r") + F.col("s.i")).alias("r2"), F.pmod(F.col("c") + F.col("s.j"), F.lit(width)).alias("c2"))
    along = dlon * F.cos(F.lit(math.pi / 2) - (F.col("r") + 0.5) * dlat)
    across = F.sqrt(dlat * dlat + F.pow(dlon * F.cos(F.lit(math.pi / 2) - (F.least("r", "r2") + 1) * dlat), F.lit(2)))
    length = F.when(F.col("s.i") == 0, along).when(F.col("s.j") == 0, F.lit(dlat)).otherwise(across)
    other = labels.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("v").alias("vb"))
    node = lambda r, c: (F.col(r) * width + F.col(c)).cast("long")
    return moved.join(other, ["r2", "c2"], "left").select(node("r", "c").alias("a"), node("r2", "c2").alias("b"), "va", "vb", length.alias("hours"))


def border_distances(labels: DataFrame, height: int, width: int, side: int = 128) -> DataFrame:
    """(node, distance): radians from each labelled cell to the nearest cell of its label that has another beside it.

    labels: (r, c, v). Steps go to the eight neighbours of the same label; columns wrap, and the first
    and last row are a border.
    """
    near = _neighbours(labels.filter("v <> 0"), height, width)
    node = (F.col("r") * width + F.col("c")).cast("long")
    rims = labels.filter("v <> 0").filter((F.col("r") == 0) | (F.col("r") == height - 1)).select(node.alias("node"))
    rims = rims.unionByName(near.filter(~F.col("va").eqNullSafe(F.col("vb"))).select(F.col("a").alias("node"))).distinct()
    zero = {"cost": F.lit(0.0), "rank": F.lit(0).cast("long"), "population": F.lit(0.0), "city_id": F.lit(0).cast("long")}
    found = spread(near.filter("va = vb").select("a", "b", "hours"), rims.withColumns(zero), width, True, side)
    return found.select("node", F.col("cost").alias("distance"))


def padding(cells: DataFrame, targets: DataFrame, least_cells: int = 64, trigger: float = 1.1) -> DataFrame:
    """(v, node, core): cells (node, v, area, distance) of the regions that are ``trigger`` times too large.

    targets: (v, actual, target, excluded). Cells are taken from the middle, then row by row, until the
    target is reached; the rest is padding. Regions of few cells, excluded ones and those near enough
    to their target have no rows. A region whose cells can't reach its target is an error.
    """
    due = targets.filter(~F.col("excluded") & (F.col("target") > 0) & (F.col("actual") > trigger * F.col("target")))
    met = cells.join(due.select("v", "target"), "v")
    whole = Window.partitionBy("v")
    met = met.withColumn("_n", F.count("*").over(whole)).withColumn("_all", F.sum("area").over(whole)).filter(F.col("_n") >= least_cells)
    before = F.sum("area").over(whole.orderBy(F.col("distance").desc(), "node").rowsBetween(Window.unboundedPreceding, -1))
    core = F.coalesce(before, F.lit(0.0)) < F.col("target")
    return met.select("v", "node", "area", "target", F.when(F.col("_all") >= F.col("target"), core).otherwise(F.raise_error(F.lit("a region's cells can't reach its target")).cast("boolean")).alias("core"))


def padding_summary(kept: DataFrame) -> DataFrame:
    """(v, cells, core_cells, core_area, padding_share) of each padded region."""
    inside = F.when(F.col("core"), F.col("area"))
    return kept.groupBy("v").agg(F.count("*").alias("cells"), F.count(inside).alias("core_cells"), F.sum(inside).alias("core_area"), (1 - F.sum(inside) / F.sum("area")).alias("padding_share"))
