"""Labels on mapped surfaces: distance to a label's border, sampled labels, patches, coverage of a mesh and areas under a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import turn_from
from meridia.operators.polygon import edges, rasterize

# ---- distance to borders

CAP_PIXELS, BLOCK_SIDE = 4.0, 32  # fixed values of the published field


def painted(vertices: DataFrame, height: int, width: int) -> DataFrame:
    """(r, c, lab): the label of the last polygon that holds a cell's centre; vertices have lab."""
    owner = vertices.select("poly", "lab").distinct()
    return rasterize(vertices.drop("lab"), height, width).join(owner, "poly").groupBy("r", "c").agg(F.max_by("lab", "poly").alias("lab"))


def _segment_pixels(lat: Column, lon: Column, dy: float, dx: float) -> Column:
    """Pixels from a point to the edge in the row's columns, the edge turned to the point's side of the globe."""
    shift = 360 * F.floor((lon - (F.col("lon") + F.col("lon2")) / 2) / 360 + 0.5)
    scale = F.cos(F.radians(lat))
    ax, bx = (F.col("lon") + shift - lon) * scale / dx, (F.col("lon2") + shift - lon) * scale / dx
    ay, by = (F.col("lat") - lat) / dy, (F.col("lat2") - lat) / dy
    vx, vy = bx - ax, by - ay
    along = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * vx + ay * vy) / F.nullif(vx * vx + vy * vy, F.lit(0.0)))), F.lit(0.0))
    x, y = ax + along * vx, ay + along * vy
    return F.sqrt(x * x + y * y)


def segment_blocks(vertices: DataFrame, height: int, width: int, side: int = BLOCK_SIDE, cap: float = CAP_PIXELS) -> DataFrame:
    """Edges with each block (br, bc) of side x side cells that holds a centre within ``cap`` pixels of the edge's box.

    A pixel of longitude shrinks with latitude, so the margin is that of the block's row nearest a pole.
    """
    dy, dx = 180 / height, 360 / width
    e = edges(vertices).filter("lat <> lat2 or lon <> lon2")
    first = F.greatest(F.lit(0), F.floor((90 - F.greatest("lat", "lat2")) / dy - cap))
    last = F.least(F.lit(height - 1), F.ceil((90 - F.least("lat", "lat2")) / dy + cap) - 1)
    rows = e.withColumn("first", first.cast("int")).withColumn("last", last.cast("int")).filter("first <= last")
    rows = rows.withColumn("br", F.explode(F.sequence(F.expr(f"first div {side}").cast("int"), F.expr(f"last div {side}").cast("int"))))
    north, south = 90 - (F.col("br") * side + 0.5) * dy, 90 - (F.least(F.lit(height), (F.col("br") + 1) * side) - 0.5) * dy
    margin = F.least(F.lit(360.0), cap * dx / F.cos(F.radians(F.greatest(F.abs(north), F.abs(south)))))
    turned = rows.withColumn("margin", margin).withColumn("turn", F.explode(F.array(*(F.lit(k) for k in (-2, -1, 0, 1, 2)))))
    west, east = (F.col(c) + 360 * F.col("turn") + 180 for c in ("west", "east"))
    turned = turned.withColumn("west", F.least("lon", "lon2") - F.col("margin")).withColumn("east", F.greatest("lon", "lon2") + F.col("margin"))
    c0 = F.greatest(F.lit(0), F.floor(west / dx)).cast("int")
    c1 = F.least(F.lit(width - 1), F.ceil(east / dx) - 1).cast("int")
    met = turned.withColumn("c0", c0).withColumn("c1", c1).filter("c0 <= c1")
    met = met.withColumn("bc", F.explode(F.sequence(F.expr(f"c0 div {side}").cast("int"), F.expr(f"c1 div {side}").cast("int"))))
    return met.select("br", "bc", "lab", "lat", "lon", "lat2", "lon2").distinct()


def distance_field(labels: DataFrame, vertices: DataFrame, height: int, width: int, side: int = BLOCK_SIDE, cap: float = CAP_PIXELS) -> DataFrame:
    """(r, c, lab, near): each cell's distance to its label's edges, 255 at ``cap`` pixels or more; cells of label 0 take any edge.

    A cell whose centre's label isn't that of the polygons has 0. Cells and edges meet by blocks, and
    labelled ones by label too, so no pair is made that is farther apart than a block and its margin.
    """
    dy, dx = 180 / height, 360 / width
    cells = labels.select("r", "c", "lab", F.expr(f"r div {side}").cast("int").alias("br"), F.expr(f"c div {side}").cast("int").alias("bc"))
    cells = cells.withColumn("y", 90 - (F.col("r") + 0.5) * dy).withColumn("x", -180 + (F.col("c") + 0.5) * dx)
    blocks = segment_blocks(vertices, height, width, side, cap)
    own = cells.filter("lab <> 0").join(blocks, ["br", "bc", "lab"])
    any_ = cells.filter("lab = 0").join(blocks.drop("lab"), ["br", "bc"]).select(own.columns)
    least = own.unionByName(any_).groupBy("r", "c").agg(F.min(_segment_pixels(F.col("y"), F.col("x"), dy, dx)).alias("d"))
    truth = painted(vertices, height, width).withColumnRenamed("lab", "truth")
    told = labels.join(least, ["r", "c"], "left").join(truth, ["r", "c"], "left")
    near = F.floor(F.least(F.lit(cap), F.coalesce("d", F.lit(cap))) * (255 / cap) + 0.5)
    return told.select("r", "c", "lab", F.when(F.col("lab") == F.coalesce("truth", F.lit(0)), near).otherwise(0).cast("int").alias("near"))


# ---- labels at points


def _vote(points: DataFrame, texels: DataFrame, key: str, row: str, column: str) -> DataFrame:
    """points (key, texels' places and weights) with the label that wins among their four texels.

    A texel speaks for a label by weight times distance, for its own label and against any other; the
    first of equals, to nine decimals, wins. The padding is that of the winner's heaviest texel, the first
    of equals.
    """
    four = points.join(texels, [row, column], "left")
    four = four.select(key, F.struct("k", F.coalesce("lab", F.lit(0)).alias("lab"), F.coalesce("pad", F.lit(0)).alias("pad"), F.coalesce("near", F.lit(0)).cast("double").alias("near"), "w").alias("t"))
    told = four.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def spoken(mine: Column) -> Column:
        own = lambda t: F.when(t["lab"] == mine["lab"], t["near"]).otherwise(-t["near"])
        score = F.aggregate("ts", F.lit(0.0), lambda s, t: s + t["w"] * own(t))
        heaviest = F.array_max(F.transform(F.filter("ts", lambda t: t["lab"] == mine["lab"]), lambda t: F.struct((t["w"] * 1000 - t["k"] / 1e9).alias("w"), t["pad"].alias("pad"))))
        return F.struct(F.round(score, 9).alias("told"), (-mine["k"]).alias("first"), score.alias("score"), mine["lab"].alias("lab"), heaviest["pad"].alias("pad"))

    best = told.withColumn("best", F.array_max(F.transform("ts", spoken)))
    return best.select(key, "best.lab", "best.pad", (F.col("best.score") * CAP_PIXELS / 255).alias("distance"))


def _texels(points: DataFrame, fy: Column, fx: Column) -> DataFrame:
    """points with the four texels around (fy, fx) by k from the upper left: j, i and weight w."""
    four = points.withColumn("fy", fy).withColumn("fx", fx).withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    ty, tx = F.col("fy") - F.floor("fy"), F.col("fx") - F.floor("fx")
    w = F.when(F.col("k") % 2 == 0, 1 - tx).otherwise(tx) * F.when(F.col("k") < 2, 1 - ty).otherwise(ty)
    return four.withColumn("w", w).withColumn("j", (F.floor("fy") + F.expr("k div 2")).cast("int")).withColumn("i", (F.floor("fx") + F.col("k") % 2).cast("int"))


def sample_labels(points: DataFrame, field: DataFrame, height: int, width: int, key: str) -> DataFrame:
    """(key, lab, pad, distance): the label that wins at each point by its four texels; columns wrap, rows end at the poles.

    field: (r, c, lab, pad, near). Cells that it lacks have label 0 at distance 0. ``key`` is unique.
    """
    spots = _texels(points.select(key, "lat", "lon"), (90 - F.col("lat")) / 180 * height - 0.5, turn_from(-180.0, "lon") / 360 * width - 0.5)
    spots = spots.withColumn("r", F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("j")))).withColumn("c", F.pmod("i", F.lit(width)))
    return _vote(spots, field, key, "r", "c")


# ---- patches

BASE_WIDTH, BASE_HEIGHT = 4096, 2048  # fixed values of the base map


def _f32(x: Column) -> Column:
    return x.cast("float").cast("double")


def patch_of(points: DataFrame, patches: DataFrame, key: str, bin_degrees: float = 5.0) -> DataFrame:
    """(key, patch, u, v, edge): the first patch that holds each point at least a base pixel inside, and the place there.

    patches: (patch, west, south, east, north), east beyond 180 where they cross the date line. Points
    and patches meet by bins of whole degrees. Seams are judged in single precision, as a renderer does.
    """
    lon, lat = F.col("lon"), F.col("lat")
    single = points.select(key, _f32(_f32(_f32((lon + 180) / 360) * 360) - 180).alias("x"), _f32(90 - _f32(_f32((90 - lat) / 180) * 180)).alias("y"))
    bins = round(360 / bin_degrees)
    spots = single.withColumn("bx", F.pmod(F.floor((F.col("x") + 180) / bin_degrees), F.lit(bins))).withColumn("by", F.floor((F.col("y") + 90) / bin_degrees))
    boxes = patches.select("patch", *(_f32(F.col(c)).alias(c) for c in ("west", "south", "east", "north")))
    across = F.explode(F.sequence(F.floor((F.col("west") + 180) / bin_degrees), F.least(F.floor((F.col("east") + 180) / bin_degrees), F.floor((F.col("west") + 180) / bin_degrees) + bins - 1)))
    boxes = boxes.withColumn("wide", across).withColumn("bx", F.pmod("wide", F.lit(bins))).withColumn("by", F.explode(F.sequence(F.floor((F.col("south") + 90) / bin_degrees), F.floor((F.col("north") + 90) / bin_degrees))))
    met = spots.join(boxes.drop("wide"), ["bx", "by"])
    off = F.col("x") - _f32(_f32(F.col("west") + F.col("east")) * 0.5)
    turns = F.when(off > 180, -F.ceil((off - 180) / 360)).when(off < -180, F.ceil((-180 - off) / 360)).otherwise(0)
    met = met.withColumn("x", F.col("x") + 360 * turns).filter("x between west and east and y between south and north")
    pixel = (360 / BASE_WIDTH, 180 / BASE_HEIGHT)
    sides = ((F.col("x") - F.col("west"), pixel[0]), (F.col("east") - F.col("x"), pixel[0]), (F.col("y") - F.col("south"), pixel[1]), (F.col("north") - F.col("y"), pixel[1]))
    met = met.withColumn("edge", F.least(*(_f32(_f32(d) / size) for d, size in sides))).filter("edge >= 1")
    u = _f32(_f32(F.col("x") - F.col("west")) / _f32(F.col("east") - F.col("west")))
    v = _f32(_f32(F.col("north") - F.col("y")) / _f32(F.col("north") - F.col("south")))
    first = met.groupBy(key).agg(F.min_by(F.struct("patch", u.alias("u"), v.alias("v"), "edge"), "patch").alias("p"))
    return first.select(key, "p.*")


def sample_patches(points: DataFrame, patches: DataFrame, atlas: DataFrame, key: str) -> DataFrame:
    """(key, patch, weight, lab, pad, distance) of the points that a patch holds; texels beyond a patch's rectangle are its rim's.

    patches also have atlas_x, atlas_y, inner_width and inner_height; atlas: (ay, ax, lab, pad, near).
    """
    at = patch_of(points, patches, key).join(patches.select("patch", "atlas_x", "atlas_y", "inner_width", "inner_height"), "patch")
    x0, y0 = F.col("atlas_x") + 1, F.col("atlas_y") + 1
    spots = _texels(at, y0 + F.col("v") * F.col("inner_height") - 0.5, x0 + F.col("u") * F.col("inner_width") - 0.5)
    spots = spots.withColumn("ax", F.greatest(x0, F.least(x0 + F.col("inner_width") - 1, F.col("i")))).withColumn("ay", F.greatest(y0, F.least(y0 + F.col("inner_height") - 1, F.col("j"))))
    t = F.least(F.lit(1.0), F.col("edge") / 2)
    won = _vote(spots.select(key, "k", "w", "ax", "ay"), atlas, key, "ay", "ax")
    return at.select(key, "patch", (t * t * (3 - 2 * t)).alias("weight")).join(won, key)


# ---- coverage of a mesh


def _below(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """The areas of a rectangle in a unit cell below and above the cell's diagonal from its lower left."""
    whole = F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)
    half = lambda x: (F.pow(F.greatest(x - y0, F.lit(0.0)), F.lit(2)) - F.pow(F.greatest(x - y1, F.lit(0.0)), F.lit(2))) / 2
    part = F.least(whole, F.greatest(F.lit(0.0), half(x1) - half(x0)))
    below = F.when(x0 >= y1, whole).when(x1 <= y0, F.lit(0.0)).otherwise(part)
    return below, whole - below


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def triangle_coverage(labels: DataFrame, height: int, width: int, mesh_height: int, mesh_width: int, bounds: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> DataFrame:
    """(triangle, lab, weight): each triangle's shares of the sphere by label, over an equal-area mesh.

    Cells of the mesh are equal in longitude and in sine of latitude, from the south, each cut from its
    lower left into triangle 2k below and 2k + 1 above. labels: (r, c, lab), rows from the north of
    ``bounds``, every cell there. Runs of one label meet the mesh cells that they touch; what rounding leaves
    goes to a triangle's largest label, what lies beyond the bounds to label 0. Gaps are an error.
    """
    west, south, east, north = bounds
    dy, dx, scale = (north - south) / height, (east - west) / width, 1 / (mesh_height * mesh_width)
    order = Window.partitionBy("r").orderBy("c")
    starts = labels.withColumn("new", (~F.col("lab").eqNullSafe(F.lag("lab").over(order)) | (F.col("c") != F.lag("c").over(order) + 1)).cast("int"))
    runs = starts.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(order)).groupBy("r", "run", "lab").agg(F.min("c").alias("c0"), (F.max("c") + 1).alias("c1"))
    row = lambda r: (F.sin(F.radians(F.lit(north) - r * dy)) + 1) * (mesh_height / 2)
    column = lambda c: (west + c * dx + 180) * (mesh_width / 360)
    spans = runs.select("lab", row(F.col("r") + 1).alias("low"), row(F.col("r")).alias("high"), column(F.col("c0")).alias("left"), column(F.col("c1")).alias("right"))
    last = lambda x, n: F.least(F.lit(n - 1), F.ceil(x) - 1).cast("int")
    first = lambda x: F.greatest(F.lit(0), F.floor(x)).cast("int")
    met = spans.withColumn("y", F.explode(F.sequence(first(F.col("low")), F.greatest(first(F.col("low")), last(F.col("high"), mesh_height)))))
    met = met.withColumn("x", F.explode(F.sequence(first(F.col("left")), F.greatest(first(F.col("left")), last(F.col("right"), mesh_width)))))
    below, above = _below(_unit(F.col("left") - F.col("x")), _unit(F.col("low") - F.col("y")), _unit(F.col("right") - F.col("x")), _unit(F.col("high") - F.col("y")))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), below.alias("area")), F.struct(F.lit(1).alias("half"), above.alias("area")))).alias("h")
    parts = met.select("lab", "y", "x", halves).filter("h.area > 0")
    triangle = (2 * (F.col("y").cast("long") * mesh_width + F.col("x")) + F.col("h.half")).alias("triangle")
    covered = parts.groupBy(triangle, "lab").agg((F.sum("h.area") * scale).alias("weight"))
    box = [_unit((F.lit(west) + 180) * (mesh_width / 360) - F.col("x")), _unit((F.sin(F.radians(F.lit(south))) + 1) * (mesh_height / 2) - F.col("y")), _unit((F.lit(east) + 180) * (mesh_width / 360) - F.col("x")), _unit((F.sin(F.radians(F.lit(north))) + 1) * (mesh_height / 2) - F.col("y"))]
    due = _below(*box)
    mesh = labels.sparkSession.range(2 * mesh_height * mesh_width).withColumnRenamed("id", "triangle")
    mesh = mesh.withColumn("x", F.expr(f"(triangle div 2) % {mesh_width}")).withColumn("y", F.expr(f"triangle div {2 * mesh_width}"))
    mesh = mesh.select("triangle", (F.when(F.col("triangle") % 2 == 0, due[0]).otherwise(due[1]) * scale).alias("due"))
    each = Window.partitionBy("triangle")
    joined = mesh.join(covered, "triangle", "left").withColumn("left_over", F.col("due") - F.coalesce(F.sum("weight").over(each), F.lit(0.0)))
    rank = F.row_number().over(each.orderBy(F.col("weight").desc_nulls_last(), "lab"))
    ranked = joined.withColumn("rank", rank)
    whole = F.lit(scale / 2)
    sound = F.when(F.abs("left_over") <= whole * 1e-9, F.col("left_over")).otherwise(F.raise_error(F.lit("labels leave gaps in the mesh, or overlap")).cast("double"))
    solid = ranked.select("triangle", "lab", (F.col("weight") + F.when(F.col("rank") == 1, sound).otherwise(0)).alias("weight")).filter("lab is not null")
    beyond = mesh.filter(F.col("due") < whole).select("triangle", F.lit(0).alias("lab"), (whole - F.col("due")).alias("weight"))
    return solid.unionByName(beyond).groupBy("triangle", "lab").agg(F.sum("weight").alias("weight"))


def triangle_jacobians(nodes: DataFrame, mesh_height: int, mesh_width: int) -> DataFrame:
    """(triangle, jacobian): how much a map stretches each triangle; nodes: (j, i, x, y) in shares of the map, j from the south.

    A triangle that the map folds or collapses is an error.
    """
    at = lambda dj, di, n: nodes.select((F.col("j") - dj).alias("j"), (F.col("i") - di).alias("i"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    cells = at(0, 0, "a").join(at(0, 1, "b"), ["j", "i"]).join(at(1, 1, "c"), ["j", "i"]).join(at(1, 0, "d"), ["j", "i"])
    cross = lambda p, q: (F.col(f"x{p}") - F.col("xa")) * (F.col(f"y{q}") - F.col("ya")) - (F.col(f"y{p}") - F.col("ya")) * (F.col(f"x{q}") - F.col("xa"))
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("half"), (cross(p, q) * (mesh_height * mesh_width)).alias("jacobian")) for k, p, q in ((0, "b", "c"), (1, "c", "d"))))).alias("t")
    out = cells.select((2 * (F.col("j").cast("long") * mesh_width + F.col("i"))).alias("base"), both)
    sound = F.when(F.col("t.jacobian") > 0, F.col("t.jacobian")).otherwise(F.raise_error(F.lit("a map folds a triangle")).cast("double"))
    return out.select((F.col("base") + F.col("t.half")).alias("triangle"), sound.alias("jacobian"))


def mapped_areas(coverage: DataFrame, nodes: DataFrame, mesh_height: int, mesh_width: int, parents: DataFrame | None = None) -> DataFrame:
    """(lab, area, mapped): each label's share of the sphere, and of the map; labels are those of ``parents`` (lab, parent) where given, 0 its own.

    A triangle of the coverage that the map lacks, and a label without a parent, are errors.
    """
    met = coverage.join(triangle_jacobians(nodes, mesh_height, mesh_width), "triangle", "left")
    must = lambda c, said: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(said)).cast("double"))
    sums = met.groupBy("lab").agg(F.sum("weight").alias("area"), F.sum(F.col("weight") * must(F.col("jacobian"), "the map lacks a triangle")).alias("mapped"))
    if parents is None:
        return sums
    up = sums.join(parents, "lab", "left")
    label = F.when(F.col("lab") == 0, 0).when(F.col("parent").isNotNull(), F.col("parent")).otherwise(F.raise_error(F.lit("a label without a parent")).cast("int"))
    return up.groupBy(label.cast("int").alias("lab")).agg(F.sum("area").alias("area"), F.sum("mapped").alias("mapped"))


def coverage_densities(areas: DataFrame, units: DataFrame, floor: float = 0.01) -> DataFrame:
    """(lab, area, value, excluded, density, share, target, ratio) for each label and for 0, what no unit has.

    areas: (lab, area); units: (lab, value, excluded). A unit without a value, an excluded one and label 0
    have the mean density, one whose value is 0 has ``floor`` of it. Densities are divided by their
    integral, so targets keep the whole area; shares are of the included units' values. Negative values,
    a value without area, areas without a unit, and no value at all are errors.
    """
    told = areas.filter("lab <> 0").select("lab", "area", F.lit(True).alias("seen")).join(units, "lab", "full")
    told = told.unionByName(areas.filter("lab = 0").select("lab", "area", F.lit(None).cast("boolean").alias("seen"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("excluded")))
    area, value = F.coalesce("area", F.lit(0.0)), F.col("value").cast("double")
    included = F.coalesce(~F.col("excluded"), F.lit(False)) & value.isNotNull()
    fault = F.when(F.col("excluded").isNull() & (F.col("lab") != 0), "an area without a unit").when(value < 0, "a negative value").when(included & (area == 0) & (value > 0), "a value without area")
    sound = F.when(fault.isNull(), area).otherwise(F.raise_error(fault).cast("double"))
    told = told.select("lab", sound.alias("area"), value.alias("value"), "excluded", included.alias("included"))
    sums = told.agg(F.sum(F.when(F.col("included"), F.col("value"))).alias("total"), F.sum(F.when(F.col("included"), F.col("area"))).alias("held"))
    mean = F.when((F.col("total") > 0) & (F.col("held") > 0), F.col("total") / F.col("held")).otherwise(F.raise_error(F.lit("densities need an included area and value")).cast("double"))
    dense = told.join(F.broadcast(sums.select("total", mean.alias("mean")))).withColumn("density", F.when(~F.col("included") | (F.col("area") == 0), F.col("mean")).when(F.col("value") == 0, floor * F.col("mean")).otherwise(F.col("value") / F.col("area")))
    whole = dense.agg(F.sum(F.col("area") * F.col("density")).alias("integral"))
    out = dense.join(F.broadcast(whole)).withColumn("ratio", F.col("density") / F.col("integral"))
    return out.select("lab", "area", "value", "excluded", "density", F.when(F.col("included"), F.col("value") / F.col("total")).alias("share"), (F.col("area") * F.col("ratio")).alias("target"), "ratio")


def cell_densities(coverage: DataFrame, densities: DataFrame, mesh_height: int, mesh_width: int, parents: DataFrame | None = None) -> DataFrame:
    """(y, x, density): the mean of the normalised densities over each mesh cell."""
    met = coverage
    if parents is not None:
        met = coverage.join(parents, "lab", "left").withColumn("lab", F.when(F.col("lab") == 0, 0).otherwise(F.col("parent")))
    met = met.join(densities.select("lab", "ratio"), "lab")
    cell = F.expr("triangle div 2")
    sums = met.groupBy(cell.alias("cell")).agg((F.sum(F.col("weight") * F.col("ratio")) * (mesh_height * mesh_width)).alias("density"))
    return sums.select(F.expr(f"cell div {mesh_width}").alias("y"), (F.col("cell") % mesh_width).alias("x"), "density")


def mesh_diagnostics(coverage: DataFrame, mesh_height: int, mesh_width: int) -> DataFrame:
    """One row: entries, labels, total area, and the largest relative error of a triangle's area."""
    whole = 1 / (2 * mesh_height * mesh_width)
    each = coverage.groupBy("triangle").agg(F.sum("weight").alias("area"), F.count("*").alias("entries"))
    labels = coverage.groupBy("lab").agg(F.count("*").alias("n")).agg(F.count("*").alias("labels"))
    one = each.agg(F.sum("entries").alias("entries"), F.sum("area").alias("total"), F.max(F.abs(F.col("area") / whole - 1)).alias("error"))
    return one.join(F.broadcast(labels)).select("entries", "labels", F.round("total", 9).alias("total"), (F.col("error") <= 1e-9).alias("sound"))
