"""Labelled rasters: connected parts, thickest points, overlay of drawn and travelled countries, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.graph import components, cut
from meridia.operators.raster import row_runs, row_weight


def raster_components(labels: DataFrame, width: int, wraps: bool = True, corners: bool = False) -> DataFrame:
    """(r, first, last, v, component): runs of each row with the connected part that they belong to, label 0 left out.

    labels: (r, c, v). Runs of one label touch where they overlap in neighbouring rows, and across the
    edge of a row that wraps; with corners, also where only their corners meet. A part is named by its
    first cell, row by row.
    """
    runs = cut(row_runs(labels.filter("v <> 0")).withColumn("node", (F.col("r") * width + F.col("first")).cast("long")))
    below = runs.select((F.col("r") - 1).alias("r"), "v", F.col("first").alias("f2"), F.col("last").alias("l2"), F.col("node").alias("b"))
    slack = int(corners)
    touch = runs.join(below, ["r", "v"]).filter(f"first <= l2 + {slack} and f2 <= last + {slack}").select(F.col("node").alias("a"), "b")
    if wraps:
        ends = runs.filter(F.col("last") == width - 1).select("r", "v", F.col("node").alias("a"))
        begins = runs.filter("first = 0").select(F.explode(F.array(*(F.col("r") + k for k in ((-1, 0, 1) if corners else (0,))))).alias("r"), "v", F.col("node").alias("b"))
        touch = touch.unionByName(ends.join(begins, ["r", "v"]).select("a", "b"))
    return runs.join(components(runs.select("node"), touch), "node").select("r", "first", "last", "v", "component")


def component_sizes(runs: DataFrame, height: int) -> DataFrame:
    """(v, component, cells, area, largest): cells and weight of each part, and whether it is its label's largest, then first."""
    cells = F.col("last") - F.col("first") + 1
    sized = runs.groupBy("v", "component").agg(F.sum(cells).alias("cells"), F.sum(cells * row_weight(F.col("r"), height)).alias("area"))
    best = Window.partitionBy("v").orderBy(F.round("area", 9).desc(), "component")
    return sized.withColumn("largest", F.row_number().over(best) == 1)


def thickness(labels: DataFrame, width: int, wraps: bool = True) -> DataFrame:
    """(r, c, v, distance): steps from each labelled cell to the nearest cell of its label that has another beside it.

    labels: (r, c, v). Steps go along rows and columns; the first and last row end there. The nearest
    border is some steps along the row, in one run, then along a column, so windows over runs do it.
    """
    column = Window.partitionBy("c", "v").orderBy("r")
    upright = labels.filter("v <> 0").withColumn("_i", F.col("r") - F.row_number().over(column))
    tall = Window.partitionBy("c", "v", "_i")
    upright = upright.withColumn("_g", F.least(F.col("r") - F.min("r").over(tall), F.max("r").over(tall) - F.col("r"))).drop("_i")
    turns = F.array(*map(F.lit, (-width, 0, width) if wraps else (0,)))
    spread = upright.withColumn("_turn", F.explode(turns)).withColumn("_x", F.col("c") + F.col("_turn"))
    row = Window.partitionBy("r", "v").orderBy("_x")
    spread = spread.withColumn("_i", F.col("_x") - F.row_number().over(row))
    run = Window.partitionBy("r", "v", "_i")
    left = run.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    right = run.orderBy("_x").rowsBetween(0, Window.unboundedFollowing)
    along = F.least(F.col("_x") - F.min("_x").over(run), F.max("_x").over(run) - F.col("_x"))
    near = F.least(F.min(F.col("_g") - F.col("_x")).over(left) + F.col("_x"), F.min(F.col("_g") + F.col("_x")).over(right) - F.col("_x"))
    return spread.withColumn("distance", F.least(along, near).cast("int")).filter("_turn = 0").select("r", "c", "v", "distance")


def thickest_points(labels: DataFrame, height: int, width: int, wraps: bool = True) -> DataFrame:
    """(v, r, c, distance): of each label's largest part, the cell farthest from a border, then the first row by row."""
    runs = cut(raster_components(labels, width, wraps))
    largest = component_sizes(runs, height).filter("largest").select("v", "component")
    kept = runs.join(largest, ["v", "component"]).select("v", "r", F.explode(F.sequence("first", "last")).alias("c"))
    met = thickness(labels, width, wraps).join(kept, ["v", "r", "c"])
    best = met.groupBy("v").agg(F.max_by(F.struct("r", "c", "distance"), F.struct("distance", -F.col("r"), -F.col("c"))).alias("b"))
    return best.select("v", "b.*")


def disputed_cells(drawn: DataFrame, route: DataFrame, sovereign: DataFrame, always: list[int]) -> DataFrame:
    """(r, c, d, k, disputed): the drawn country d and the travelled one k of each cell of either.

    A cell is disputed where both are known, differ and have different sovereigns, and wherever the
    travelled country is one of ``always``. sovereign: (country, sovereign).
    """
    own = lambda name: sovereign.select(F.col("country").alias(name), F.col("sovereign").alias(f"{name}_of"))
    met = drawn.select("r", "c", F.col("v").alias("d")).join(route.select("r", "c", F.col("v").alias("k")), ["r", "c"], "full_outer").na.fill(0, ["d", "k"])
    met = met.join(own("d"), "d", "left").join(own("k"), "k", "left")
    apart = (F.col("d") > 0) & (F.col("k") > 0) & (F.col("d") != F.col("k")) & ~F.col("d_of").eqNullSafe(F.col("k_of"))
    return met.select("r", "c", "d", "k", (apart | F.col("k").isin(*always)).alias("disputed"))


def disputed_pairs(cells: DataFrame) -> DataFrame:
    return cells.filter("disputed").groupBy("d", "k").agg(F.count("*").alias("cells"))


def routing(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """(r, c, route, unknown): the travelled country by the rules (country, into), land without one as unknown."""
    return cells.join(merged, cells["k"] == merged["country"], "left").select("r", "c", F.coalesce("into", "k").alias("route"), (F.coalesce("into", "k") == 0).alias("unknown"))


def patches(countries: DataFrame, ratios: DataFrame, most_km2: float = 20_000.0, least_ratio: float = 10.0) -> DataFrame:
    """(id, raster_id, area_km2, ratio): small countries, none of those excluded, that some metric enlarges at least so much.

    countries: (id, raster_id, area_km2, excluded); ratios: (raster_id, metric, ratio).
    """
    largest = ratios.groupBy("raster_id").agg(F.greatest(F.lit(0.0), F.max("ratio")).alias("ratio"))
    small = countries.filter((F.col("area_km2") < most_km2) & ~F.col("excluded"))
    return small.join(largest, "raster_id").filter(F.col("ratio") >= least_ratio).select("id", "raster_id", "area_km2", "ratio")


def bridged_parts(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, cells, edges): pairs of fine parts that coarse cells bring together.

    parts: (cell, part), the fine parts in each coarse cell. A cell joins all its parts; an edge
    (cell, other) joins those of its cells with each other where they have none in common.
    """
    own = parts.select("cell", "part").distinct()
    within = own.join(own.withColumnRenamed("part", "other_part"), "cell").filter("part < other_part").select(F.col("part").alias("a"), F.col("other_part").alias("b"), F.lit(1).alias("cells"), F.lit(0).alias("edges"))
    once = edges.filter("cell < other").select("cell", "other").distinct()
    there = own.select(F.col("cell").alias("other"), F.col("part").alias("other_part"))
    met = once.join(own, "cell").join(there, "other")
    common = met.filter("part = other_part").select("cell", "other").distinct()
    across = met.join(common, ["cell", "other"], "left_anti").select(F.least("part", "other_part").alias("a"), F.greatest("part", "other_part").alias("b"), F.lit(0).alias("cells"), F.lit(1).alias("edges"))
    return within.unionByName(across).groupBy("a", "b").agg(F.sum("cells").alias("cells"), F.sum("edges").alias("edges"))


def shared_parts(a: DataFrame, b: DataFrame, key: str, part: str) -> DataFrame:
    """(key of a, key of b, shared): pairs of a smaller key of a with one of b that have parts in common, and which, in order. a, b: (key, part)."""
    left, right = a.select(F.col(key).alias("a"), part).distinct(), b.select(F.col(key).alias("b"), part).distinct()
    return left.join(right, part).filter("a < b").groupBy("a", "b").agg(F.sort_array(F.collect_list(part)).alias("shared"))


def part_key_order() -> list[Column]:
    """The order of keys such as ``fr/12``: country, then number."""
    return [F.substring_index("key", "/", 1), F.element_at(F.split("key", "/"), 2).cast("int")]
