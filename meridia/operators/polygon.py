"""Polygons as vertex rows (poly, ring, ix, lat, lon), rings closed by their first vertex again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import EARTH_KM, haversine_km, normalize_lon, turn_from, unit_vector, vector_to_lat, vector_to_lon
from meridia.operators.graph import cut
from meridia.operators.raster import Grid

MERCATOR_LIMIT = 85.05


def edges(vertices: DataFrame) -> DataFrame:
    """(poly, ring, ix, lat, lon, lat2, lon2, home) of each edge, its polygon laid out on one plane.

    Longitudes go on from vertex to vertex, beyond 180 where a ring crosses the date line, and a polygon's
    rings are on the turn of its first vertex; ``home`` is the longitude as given. A ring that closes a
    whole turn away, around a pole, keeps its longitudes.
    """
    ring, poly = Window.partitionBy("poly", "ring").orderBy("ix"), Window.partitionBy("poly").orderBy("ring", "ix")
    step = F.col("lon") - F.lag("lon").over(ring)
    turn = F.when(step > 180, -1).when(step < -180, 1).otherwise(0)
    laid = vertices.withColumn("home", F.col("lon")).withColumn("turn", turn).withColumn("start", F.first("lon").over(poly))
    laid = laid.withColumn("turn", F.sum("turn").over(ring) + F.floor((F.col("start") - F.first("lon").over(ring)) / 360 + 0.5))
    whole = Window.partitionBy("poly", "ring")
    around = F.max_by("turn", "ix").over(whole) != F.min_by("turn", "ix").over(whole)
    laid = laid.withColumn("lon", F.when(around, F.col("lon")).otherwise(F.col("lon") + 360 * F.col("turn"))).drop("turn", "start")
    return laid.withColumn("lat2", F.lead("lat").over(ring)).withColumn("lon2", F.lead("lon").over(ring)).filter("lat2 is not null")


def ring_areas(vertices: DataFrame) -> DataFrame:
    """(poly, ring, area_km2): the smaller side of each ring, by the trapezoid of each edge in longitude and sine of latitude's half angle."""
    e = edges(vertices)
    dl = F.radians(F.col("lon2") - F.col("lon"))
    t1, t2 = F.tan(F.radians("lat") / 2), F.tan(F.radians("lat2") / 2)
    excess = 2 * F.atan2(F.tan(dl / 2) * (t1 + t2), 1 + t1 * t2)
    total = F.abs(F.sum(excess))
    return e.groupBy("poly", "ring").agg(total.alias("x")).select("poly", "ring", (F.least(F.col("x"), F.lit(4 * math.pi) - F.col("x")) * EARTH_KM * EARTH_KM).alias("area_km2"))


def polygon_areas(vertices: DataFrame) -> DataFrame:
    """(poly, area_km2): ring 0 without its holes."""
    return ring_areas(vertices).groupBy("poly").agg(F.round(F.sum(F.when(F.col("ring") == 0, F.col("area_km2")).otherwise(-F.col("area_km2"))), 6).alias("area_km2"))


def mercator_inflation(vertices: DataFrame) -> DataFrame:
    """(poly, inflation): area on a Mercator map, cut at its limits, over true area; null for none."""
    y = lambda lat: F.log(F.tan(math.pi / 4 + F.radians(F.greatest(F.lit(-MERCATOR_LIMIT), F.least(F.lit(MERCATOR_LIMIT), lat))) / 2))
    e = edges(vertices)
    flat = e.groupBy("poly", "ring").agg((F.abs(F.sum(F.radians(F.col("lon2") - F.col("lon")) * (y(F.col("lat")) + y(F.col("lat2"))) / 2)) * EARTH_KM * EARTH_KM).alias("flat"))
    flat = flat.groupBy("poly").agg(F.sum(F.when(F.col("ring") == 0, F.col("flat")).otherwise(-F.col("flat"))).alias("flat"))
    return flat.join(polygon_areas(vertices), "poly").select("poly", F.round(F.col("flat") / F.nullif(F.col("area_km2"), F.lit(0.0)), 6).alias("inflation"))


def rotate(vertices: DataFrame, from_lat: float, from_lon: float, to_lat: float, to_lon: float) -> DataFrame:
    """Every vertex turned about the pole until the anchor is on its new meridian, then along that meridian; areas stay."""
    u = unit_vector(F.col("lat"), F.col("lon") - from_lon)
    tilt = math.radians(to_lat - from_lat)
    x = u["ux"] * math.cos(tilt) - u["uz"] * math.sin(tilt)
    z = u["ux"] * math.sin(tilt) + u["uz"] * math.cos(tilt)
    return vertices.select("poly", "ring", "ix", vector_to_lat(z).alias("lat"), normalize_lon(vector_to_lon(x, u["uy"]) + to_lon).alias("lon"))


def anchors(vertices: DataFrame) -> DataFrame:
    """(country, lat, lon): the mean direction of the vertices of each country's largest polygon; vertices have a country."""
    sized = polygon_areas(vertices).join(vertices.select("poly", "country").distinct(), "poly")
    largest = sized.groupBy("country").agg(F.max_by("poly", F.struct("area_km2", -F.col("poly"))).alias("poly"))
    u = unit_vector("lat", "lon")
    w = vertices.filter("ring = 0").drop("country").join(largest, "poly").join(edges(vertices.drop("country")).select("poly", "ring", "ix"), ["poly", "ring", "ix"])
    mean = w.groupBy("country").agg(*(F.avg(c).alias(k) for k, c in u.items()))
    return mean.select("country", F.round(F.degrees(F.atan2("uz", F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")))), 6).alias("lat"), F.round(vector_to_lon(F.col("ux"), F.col("uy")), 6).alias("lon"))


def densify(vertices: DataFrame, most_deg: float = 1.0) -> DataFrame:
    """Rings with great-circle points between, at most most_deg apart."""
    e = edges(vertices)
    omega = haversine_km("lat", "lon", "lat2", "lon2") / EARTH_KM
    n = F.greatest(F.lit(1), F.ceil(F.round(F.degrees(omega) / most_deg, 9))).cast("int")
    a, b = unit_vector("lat", "lon"), unit_vector("lat2", "lon2")
    cut = e.withColumn("omega", omega).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    s = F.sin("omega")
    wa = F.when(F.col("omega") < 1e-12, 1 - t).otherwise(F.sin((1 - t) * F.col("omega")) / s)
    wb = F.when(F.col("omega") < 1e-12, t).otherwise(F.sin(t * F.col("omega")) / s)
    x, y, z = (wa * a[c] + wb * b[c] for c in ("ux", "uy", "uz"))
    lat = F.when(F.col("k") == 0, F.col("lat")).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
    lon = F.when(F.col("k") == 0, F.col("home")).otherwise(vector_to_lon(x, y))
    return cut.select("poly", "ring", "ix", "k", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def _crossed(lat: Column, lon: Column) -> Column:
    """Whether the ray east from a point meets an edge, which may lie a turn away."""
    spans = (F.col("e.lat") <= lat) != (F.col("e.lat2") <= lat)
    at = F.col("e.lon") + (lat - F.col("e.lat")) / F.nullif(F.col("e.lat2") - F.col("e.lat"), F.lit(0.0)) * (F.col("e.lon2") - F.col("e.lon"))
    return spans & (at > lon)


def containing(points: DataFrame, vertices: DataFrame, key: str, cell_degrees: int = 10, as_given: bool = False) -> DataFrame:
    """(key, poly) of the polygons that hold each point: even-odd over all rings, in degrees.

    Points first meet the polygons whose box touches their degree of latitude and their cell of longitude,
    then, where their box holds the point, those polygons' edges in that degree; an edge counts in each degree
    that it touches. With ``as_given``, longitudes that need no turn are judged to their last bit.
    """
    e = edges(vertices)
    degree = lambda lat: F.floor(lat).cast("int")
    cells = 360 // cell_degrees
    cell = lambda lon: F.floor((lon + 180) / cell_degrees)
    box = e.groupBy("poly").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("o"))
    box = box.withColumn("band", F.explode(F.sequence(degree(F.col("s")), degree(F.col("n")))))
    box = box.withColumn("across", F.explode(F.sequence(cell(F.col("w")), F.least(cell(F.col("o")), cell(F.col("w")) + cells - 1))))
    box = box.select("poly", "band", "s", "n", F.col("w").alias("west"), F.col("o").alias("east"), F.pmod("across", F.lit(cells)).alias("cell"))
    p = points.select(key, F.col("lat").alias("y"), F.col("lon").alias("x"), degree(F.col("lat")).alias("band"), F.pmod(cell(F.col("lon")), F.lit(cells)).alias("cell"))
    # the point's longitude from the polygon's west on
    turned = F.col("x") + 360.0 * F.ceil((F.col("west") - F.col("x")) / 360.0) if as_given else F.col("west") + turn_from("west", "x")
    # room for rounding in the east, where an edge's longitude is a quotient
    near = p.join(box, ["band", "cell"]).withColumn("t", turned).filter("y between s and n and t <= east + 1e-9").drop("s", "n", "east")
    banded = e.select("poly", "lat", "lon", "lat2", "lon2", F.explode(F.sequence(degree(F.least("lat", "lat2")), degree(F.greatest("lat", "lat2")))).alias("band"))
    met = near.join(banded.alias("e"), ["poly", "band"])
    return met.groupBy(key, "poly").agg(F.sum(_crossed(F.col("y"), F.col("t")).cast("int")).alias("n")).filter("n % 2 = 1").select(key, "poly")


def point_in_polygon(points: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """points with the first polygon that holds them, null for none."""
    return points.join(containing(points, vertices, key).groupBy(key).agg(F.min("poly").alias("poly")), key, "left")


def label_clearance(points: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """(key, clearance_km): how far a point is from the border of the polygon holding it, the largest of several; 0 outside all."""
    outer = edges(vertices).alias("e")
    d = segment_distance_km(F.col("y"), F.col("x"), unit_vector(F.col("e.lat"), F.col("e.lon")), unit_vector(F.col("e.lat2"), F.col("e.lon2")))
    inside = containing(points, vertices, key).join(points.select(key, F.col("lat").alias("y"), F.col("lon").alias("x")), key)
    clear = inside.join(outer, "poly").groupBy(key, "poly").agg(F.min(d).alias("d")).groupBy(key).agg(F.max("d").alias("d"))
    return points.select(key).join(clear, key, "left").select(key, F.round(F.coalesce("d", F.lit(0.0)), 6).alias("clearance_km"))


def rasterize(vertices: DataFrame, height: int, width: int, north: float = 90.0, west: float = -180.0, dy: float | None = None, dx: float | None = None) -> DataFrame:
    """(poly, r, c): cells whose centre is inside by the even-odd rule. Each edge meets the rows it spans; sorted crossings pair up.

    Without a cell size the raster is the globe. Columns wrap where it is a whole turn wide.
    """
    dy, dx = dy or 180.0 / height, dx or 360.0 / width
    e = edges(vertices)
    top, bottom = F.greatest("lat", "lat2"), F.least("lat", "lat2")
    # divisions find the rows and columns, one more on either side; centres are judged as points are
    r0 = F.greatest(F.lit(0), F.floor((north - top) / dy - 0.5)).cast("int")
    r1 = F.least(F.lit(height - 1), F.floor((north - bottom) / dy - 0.5) + 1).cast("int")
    e = e.withColumn("first", F.min(F.least("lon", "lon2")).over(Window.partitionBy("poly")))
    rows = e.withColumn("r0", r0).withColumn("r1", r1).filter("r1 >= r0").withColumn("r", F.explode(F.sequence("r0", "r1")))
    # an edge holds its lower end and not its upper one
    rows = rows.withColumn("y", north - (F.col("r") + 0.5) * dy).filter("(lat <= y) <> (lat2 <= y)")
    x = F.col("lon") + (F.col("y") - F.col("lat")) / (F.col("lat2") - F.col("lat")) * (F.col("lon2") - F.col("lon"))
    order = Window.partitionBy("poly", "r").orderBy("x")
    pairs = rows.withColumn("x", x).withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("x").over(order)).filter("n % 2 = 1 and next is not null")
    c0, c1 = (F.ceil((F.col("x") - west) / dx - 0.5) - 1).cast("int"), F.ceil((F.col("next") - west) / dx - 0.5).cast("int")
    cells = pairs.withColumn("c0", c0).withColumn("c1", c1).withColumn("c", F.explode(F.sequence("c0", "c1")))
    placed = _columns(cells, width, dx).withColumn("at", F.col("first") + turn_from("first", (F.col("c") + 0.5) * dx + west))
    return placed.filter("at >= x and at < next").select("poly", "r", "c").distinct()


def _columns(cells: DataFrame, width: int, dx: float) -> DataFrame:
    """Columns counted from the raster's west on brought into it: by whole turns, and left out where it has no such column."""
    return cells.withColumn("c", F.pmod(F.col("c"), F.lit(round(360 / dx)))).filter(F.col("c") < width)


def touched(vertices: DataFrame, grid: Grid) -> DataFrame:
    """(poly, r, c): cells that an edge touches, their rims included. An edge is cut at the rows it spans; what is left in a row spans its columns."""
    e = edges(vertices)
    placed = e.select("poly", *(((F.col(c) - grid.west) / grid.step).alias(n) for c, n in (("lon", "x1"), ("lon2", "x2"))), *(((F.lit(grid.north) - F.col(c)) / grid.step).alias(n) for c, n in (("lat", "y1"), ("lat2", "y2"))))
    first = F.greatest(F.lit(0), F.ceil(F.least("y1", "y2")) - 1).cast("int")
    last = F.least(F.lit(grid.height - 1), F.floor(F.greatest("y1", "y2"))).cast("int")
    rows = placed.withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn("r", F.explode(F.sequence("first", "last")))
    dy = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    at = lambda y: F.coalesce((y - F.col("y1")) / dy, F.lit(None))
    enters, leaves = F.least(at(F.col("r")), at(F.col("r") + 1)), F.greatest(at(F.col("r")), at(F.col("r") + 1))
    part = rows.withColumn("t0", F.greatest(F.lit(0.0), F.coalesce(enters, F.lit(0.0)))).withColumn("t1", F.least(F.lit(1.0), F.coalesce(leaves, F.lit(1.0)))).filter("t0 <= t1")
    x = lambda t: F.col("x1") + F.col(t) * (F.col("x2") - F.col("x1"))
    c0, c1 = F.ceil(F.least(x("t0"), x("t1"))) - 1, F.floor(F.greatest(x("t0"), x("t1")))
    cells = part.withColumn("c", F.explode(F.sequence(c0.cast("int"), c1.cast("int"))))
    return _columns(cells, grid.width, grid.step).select("poly", "r", "c").distinct()


def footprints(vertices: DataFrame, grid: Grid) -> DataFrame:
    """(poly, r, c): cells that a polygon holds the centre of, or that its border touches."""
    return rasterize(vertices, grid.height, grid.width, grid.north, grid.west, grid.step, grid.step).unionByName(touched(vertices, grid)).distinct()


def ranked_parts(vertices: DataFrame) -> DataFrame:
    """(country, poly, part): a country's polygons by area, largest first, as parts from 0."""
    sized = polygon_areas(vertices.drop("country")).join(vertices.select("poly", "country").distinct(), "poly")
    return sized.select("country", "poly", (F.row_number().over(Window.partitionBy("country").orderBy(F.col("area_km2").desc(), "poly")) - 1).alias("part"), "area_km2")


def segment_distance_km(lat: Column, lon: Column, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """From a point to an arc of a great circle: to its plane where the foot lies between its ends, else to the nearer end."""
    p = unit_vector(lat, lon)
    dot = lambda u, v: sum((u[k] * v[k] for k in ("ux", "uy", "uz")), F.lit(0.0))
    n = {"ux": a["uy"] * b["uz"] - a["uz"] * b["uy"], "uy": a["uz"] * b["ux"] - a["ux"] * b["uz"], "uz": a["ux"] * b["uy"] - a["uy"] * b["ux"]}
    size = F.sqrt(dot(n, n))
    s = dot(p, n) / F.nullif(size, F.lit(0.0))
    foot = {k: p[k] - s * n[k] / F.nullif(size, F.lit(0.0)) for k in p}
    between = (dot(foot, a) >= dot(a, b)) & (dot(foot, b) >= dot(a, b)) & (dot(foot, a) + dot(foot, b) > 0)
    angle = lambda u, v: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(u, v))))
    ends = F.least(angle(p, a), angle(p, b))
    return EARTH_KM * F.when(between & (size > 1e-12), F.least(F.abs(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s)))), ends)).otherwise(ends)


def label_anchor(vertices: DataFrame, grid: int = 13) -> DataFrame:
    """(poly, lat, lon, clearance_km): of the inner points of a grid over its box and its vertices' mean, the one farthest from every edge."""
    outer = edges(vertices)
    box = outer.groupBy("poly").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    spread = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.col("s") + (i + 0.5) / grid * (F.col("n") - F.col("s"))).alias("lat"), (F.col("w") + (j + 0.5) / grid * (F.col("e") - F.col("w"))).alias("lon")))))
    cands = box.select("poly", F.posexplode(F.concat(F.array(F.struct(F.col("mlat").alias("lat"), F.col("mlon").alias("lon"))), spread)).alias("ix", "p")).select("poly", "ix", "p.lat", "p.lon")
    met = cands.select("poly", F.col("ix").alias("cand"), F.col("lat").alias("y"), F.col("lon").alias("x")).join(outer.alias("e"), "poly")
    d = segment_distance_km(F.col("y"), F.col("x"), unit_vector(F.col("e.lat"), F.col("e.lon")), unit_vector(F.col("e.lat2"), F.col("e.lon2")))
    judged = met.groupBy("poly", "cand", "y", "x").agg(F.sum(_crossed(F.col("y"), F.col("x")).cast("int")).alias("n"), F.min(d).alias("clear")).filter("n % 2 = 1")
    best = judged.groupBy("poly").agg(F.max_by(F.struct("y", "x", "clear"), F.struct(F.round("clear", 6), -F.col("cand"))).alias("b"))
    return best.select("poly", F.round("b.y", 6).alias("lat"), F.round(normalize_lon("b.x"), 6).alias("lon"), F.round("b.clear", 6).alias("clearance_km"))


def clearance_in(points: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """(key, clearance_km) of points (key, poly, lat, lon) that their own polygon holds: how far its border is."""
    e = edges(vertices)
    west = e.groupBy("poly").agg(F.min("lon").alias("west"))
    turned = F.col("west") + turn_from("west", "lon")
    placed = points.join(west, "poly").select(key, "poly", F.col("lat").alias("y"), F.col("lon").alias("x"), turned.alias("t"))
    met = placed.join(e.select("poly", "lat", "lon", "lat2", "lon2").alias("e"), "poly")
    d = segment_distance_km(F.col("y"), F.col("x"), unit_vector(F.col("e.lat"), F.col("e.lon")), unit_vector(F.col("e.lat2"), F.col("e.lon2")))
    judged = met.groupBy(key).agg(F.sum(_crossed(F.col("y"), F.col("t")).cast("int")).alias("n"), F.min(d).alias("clearance_km"))
    return judged.filter("n % 2 = 1").select(key, "clearance_km")


def two_level_anchors(fine: DataFrame, rough: DataFrame) -> DataFrame:
    """(poly, lat, lon, clearance_km): the label anchor that suits a polygon at both levels of detail best.

    Candidates are the anchors of either level. One must lie inside at each level that has the polygon; the
    one whose lesser clearance is larger wins, then the south, then the west. Polygons without such a one
    have no row, nor have those that only the rough level has.
    """
    candidates = None
    for name, shapes in (("fine", fine), ("rough", rough)):
        found = label_anchor(shapes).select(F.struct("poly", F.lit(name).alias("level")).alias("cand"), "poly", "lat", "lon")
        candidates = found if candidates is None else candidates.unionByName(found)
    candidates = cut(candidates.join(fine.select("poly").distinct(), "poly"))
    inside = clearance_in(candidates, fine, "cand").join(clearance_in(candidates, rough, "cand").withColumnRenamed("clearance_km", "rough_km"), "cand", "left")
    both = candidates.join(inside, "cand").join(rough.select("poly", F.lit(True).alias("drawn")).distinct(), "poly", "left")
    viable = both.filter(F.col("drawn").isNull() | F.col("rough_km").isNotNull()).withColumn("least", F.round(F.least("clearance_km", "rough_km"), 6)).filter("least > 0")
    best = viable.groupBy("poly").agg(F.max_by(F.struct("lat", "lon", "least"), F.struct("least", -F.col("lat"), -F.col("lon"))).alias("b"))
    return best.select("poly", "b.lat", "b.lon", F.col("b.least").alias("clearance_km"))


def self_intersections(vertices: DataFrame) -> DataFrame:
    """(poly, crossings): pairs of a ring's edges that properly cross. Edges meet by whole degrees of latitude."""
    e = edges(vertices)
    lo, hi = F.floor(F.least("lat", "lat2")).cast("int"), F.floor(F.greatest("lat", "lat2")).cast("int")
    banded = e.withColumn("band", F.explode(F.sequence(lo, hi)))
    a, b = banded.alias("a"), banded.alias("b")
    met = a.join(b, (F.col("a.poly") == F.col("b.poly")) & (F.col("a.ring") == F.col("b.ring")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.ix") < F.col("b.ix")))
    side = lambda p, q, lat, lon: (F.col(f"{q}.lon") - F.col(f"{p}.lon")) * 0 + (F.col(f"{p}.lon2") - F.col(f"{p}.lon")) * (lat - F.col(f"{p}.lat")) - (F.col(f"{p}.lat2") - F.col(f"{p}.lat")) * (lon - F.col(f"{p}.lon"))
    cross = (side("a", "b", F.col("b.lat"), F.col("b.lon")) * side("a", "b", F.col("b.lat2"), F.col("b.lon2")) < 0) & (side("b", "a", F.col("a.lat"), F.col("a.lon")) * side("b", "a", F.col("a.lat2"), F.col("a.lon2")) < 0)
    found = met.filter(cross).select(F.col("a.poly").alias("poly"), F.col("a.ring").alias("ring"), F.col("a.ix").alias("i"), F.col("b.ix").alias("j")).distinct()
    return vertices.select("poly").distinct().join(found.groupBy("poly").agg(F.count("*").alias("n")), "poly", "left").select("poly", F.coalesce("n", F.lit(0)).alias("crossings"))
