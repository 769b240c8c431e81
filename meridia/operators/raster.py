"""Rasters as (r, c, v) rows: sampling, coarsening, census, runs and neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WATER_FRICTION, WATER_SLACK = 0.00316, 2e-6  # fixed values of the friction source


@dataclass(frozen=True)
class Grid:
    """height rows from the north, width columns from the west, square cells of ``step`` degrees."""

    height: int
    width: int
    step: float
    north: float = 90.0
    west: float = -180.0

    def __post_init__(self):
        if self.height <= 0 or self.width <= 0 or self.step <= 0 or self.north > 90 or self.north - self.height * self.step < -90 - 1e-9 or self.width * self.step > 360 + 1e-9:
            raise ValueError(f"{self} isn't a grid on the globe")

    @property
    def wraps(self) -> bool:
        return abs(self.width * self.step - 360) < 1e-9


def cell_of(lat: Column, lon: Column, grid: Grid) -> dict[str, Column]:
    """Row and column of a point, null outside the grid; longitudes wrap."""
    r = F.floor((grid.north - lat) / grid.step).cast("int")
    c = F.floor(F.pmod(lon - grid.west, F.lit(360.0)) / grid.step).cast("int")
    inside = r.between(0, grid.height - 1) & c.between(0, grid.width - 1)
    return {"r": F.when(inside, r), "c": F.when(inside, c)}


def point_select(points: DataFrame, raster: DataFrame, grid: Grid) -> DataFrame:
    """points with the raster's v at their cell and status: ok, none (no value or 0) or outside-coverage."""
    at = cell_of(F.col("lat"), F.col("lon"), grid)
    found = points.withColumn("r", at["r"]).withColumn("c", at["c"]).join(raster, ["r", "c"], "left")
    return found.withColumn("status", F.when(F.col("r").isNull(), "outside-coverage").when(F.coalesce("v", F.lit(0)) == 0, "none").otherwise("ok"))


def sample_snap(points: DataFrame, raster: DataFrame, grid: Grid, key: str, reach: int = 2) -> DataFrame:
    """points with the value of their cell, else of the nearest cell with one in the square window around it.

    Nearest by squared offset, then row by row. Columns wrap, rows don't; ``snapped`` tells which. All points
    of a cell share its answer, so the cells that hold any look around, not the points.
    """
    at = cell_of(F.col("lat"), F.col("lon"), grid)
    placed = points.withColumn("_r", at["r"]).withColumn("_c", at["c"])
    span = F.sequence(F.lit(-reach), F.lit(reach))
    around = placed.filter("_r is not null").select("_r", "_c").distinct().withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    around = around.withColumn("r", F.col("_r") + F.col("dy")).withColumn("c", F.pmod(F.col("_c") + F.col("dx"), F.lit(grid.width)) if grid.wraps else F.col("_c") + F.col("dx"))
    # exploded rows count as few, but may be too many to broadcast
    met = around.hint("merge").join(raster.filter("v > 0"), ["r", "c"])
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    best = met.groupBy("_r", "_c").agg(F.min_by(F.struct("v", d2.alias("d2")), F.struct(d2, "dy", "dx")).alias("b"))
    return placed.join(best, ["_r", "_c"], "left").select(*points.columns, F.col("b.v").alias("v"), (F.col("b.d2") > 0).alias("snapped"))


def snap_labels(raster: DataFrame, labels: DataFrame, grid: Grid, radius: int = 2) -> DataFrame:
    """Cells of raster with their label, or for label 0 the nearest within a disc; ties: the smaller label."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    cells = raster.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).filter(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius)
    cells = cells.select("r", "c", "v", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"), (F.col("r") + F.col("dy")).alias("lr"), F.pmod(F.col("c") + F.col("dx"), F.lit(grid.width)).alias("lc"))
    met = cells.join(labels.filter("lab > 0").select(F.col("r").alias("lr"), F.col("c").alias("lc"), "lab"), ["lr", "lc"], "left")
    return met.groupBy("r", "c", "v").agg(F.min_by("lab", F.when(F.col("lab").isNotNull(), F.struct("d2", "lab"))).alias("lab"))


def block_sum(raster: DataFrame, factor: int) -> DataFrame:
    return raster.groupBy(F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(F.sum("v").alias("v"))


def block_friction(raster: DataFrame, factor: int, v: str = "v") -> DataFrame:
    """For each block: the least positive friction on land, whether there is land, and its share."""
    x = F.col(v)
    land = (x > 0) & (F.abs(x - WATER_FRICTION) > WATER_SLACK)
    block = raster.groupBy(F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c"))
    return block.agg(F.min(F.when(land, x)).alias("friction"), F.max(land.cast("int")).alias("any_land"), F.avg(land.cast("double")).alias("land_share"))


def regrid_points(points: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Values summed into the cells that their places fall in: columns wrap, rows are held at the poles."""
    r = F.least(F.lit(grid.height - 1), F.greatest(F.lit(0), F.floor((90 - F.col("lat")) / 180 * grid.height)))
    c = F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360 * grid.width)
    return points.filter(F.col(value).isNotNull()).groupBy(r.cast("int").alias("r"), c.cast("int").alias("c")).agg(F.sum(value).alias("v"))


def quantize(raster: DataFrame, most: int = 1 << 24) -> DataFrame:
    """Counts in the least power of ten in which all stay below ``most``; halves go up."""
    top = raster.agg(F.max("v").alias("top")).withColumn("unit", F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(F.greatest(F.col("top").cast("double"), F.lit(1.0)) / most)) + 1)))
    return raster.crossJoin(F.broadcast(top)).select("r", "c", F.floor(F.col("v") / F.col("unit") + 0.5).cast("long").alias("q"), F.col("unit").cast("long").alias("unit"))


def row_weight(r: Column, height: int) -> Column:
    """The share of the globe in a row's latitudes, times two."""
    top, bottom = F.radians(90 - r * (180.0 / height)), F.radians(90 - (r + 1) * (180.0 / height))
    return F.sin(top) - F.sin(bottom)


def class_shares(raster: DataFrame, height: int) -> DataFrame:
    """Each class's share of the classified area, six decimals; class 0 is none."""
    by = raster.filter("v > 0").groupBy("v").agg(F.sum(row_weight(F.col("r"), height)).alias("w"), F.count("*").alias("cells"))
    return by.select("v", "cells", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("share"))


def row_runs(raster: DataFrame) -> DataFrame:
    """Runs of equal values along each row: (r, first, last, v)."""
    by_value = Window.partitionBy("r", "v").orderBy("c")
    return raster.withColumn("island", F.col("c") - F.row_number().over(by_value)).groupBy("r", "v", "island").agg(F.min("c").alias("first"), F.max("c").alias("last")).drop("island")


def neighbour_pairs(raster: DataFrame, grid: Grid) -> DataFrame:
    """Each cell with each of its up to eight neighbours, both with a value; columns wrap on full grids, once for each neighbour."""
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc))
    c = F.pmod(F.col("c") + F.col("s.dc"), F.lit(grid.width)) if grid.wraps else F.col("c") + F.col("s.dc")
    out = raster.withColumn("s", F.explode(steps)).select("r", "c", "v", (F.col("r") + F.col("s.dr")).alias("r2"), c.alias("c2"))
    out = out.filter((F.col("r") != F.col("r2")) | (F.col("c") != F.col("c2"))).distinct() if grid.width < 3 else out
    return out.join(raster.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("v").alias("v2")), ["r2", "c2"]).select("r", "c", "v", "r2", "c2", "v2")


def downsample(raster: DataFrame, stride: int, height: int, width: int) -> DataFrame:
    """The cell at the middle of each block, the last one held at the edge."""
    middle = stride // 2
    r, c = F.floor(F.col("r") / stride), F.floor(F.col("c") / stride)
    at = (F.col("r") == F.least(r * stride + middle, F.lit(height - 1))) & (F.col("c") == F.least(c * stride + middle, F.lit(width - 1)))
    return raster.filter(at).select(r.cast("int").alias("r"), c.cast("int").alias("c"), "v")


def monotonicity_violations(levels: DataFrame) -> DataFrame:
    """For each level after the first: cells (r, c, level, population) whose owner's population is below the level before."""
    by = Window.partitionBy("r", "c").orderBy("level")
    seen = levels.withColumn("before", F.lag("population").over(by))
    return seen.filter("before is not null").groupBy("level").agg(F.count_if(F.col("population") < F.col("before")).alias("violations"), F.count("*").alias("cells"))


def bilinear(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """points (key, x, y) with f interpolated from nodes (i, j, f) at whole coordinates."""
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    spread = points.withColumn("k", F.explode(corner)).withColumn("i", (F.floor("y") + F.col("k.a")).cast("int")).withColumn("j", (F.floor("x") + F.col("k.b")).cast("int"))
    part = lambda t, hi: F.when(hi == 1, t - F.floor(t)).otherwise(1 - (t - F.floor(t)))
    weighed = spread.withColumn("w", part(F.col("y"), F.col("k.a")) * part(F.col("x"), F.col("k.b"))).filter("w > 0")
    return weighed.join(nodes, ["i", "j"]).groupBy(key).agg(F.round(F.sum(F.col("w") * F.col("f")), 6).alias("f"))
