"""Queries over rasters: coarsening, census, zones, labels, reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import scalars
from meridia.operators import cartogram, polygon, raster, reach, stats, zonal
from meridia.plans.shape_queries import EDGES
from meridia.plans.views import HEIGHT, STEP, WIDTH, frame, inline

GRID = raster.Grid(HEIGHT, WIDTH, STEP)
EXCLUDED = 7


def block_sum(spark, d):
    return raster.block_sum(frame(spark, d, "cell"), 4)


def block_friction(spark, d):
    return raster.block_friction(frame(spark, d, "cell").withColumn("v", F.when(F.col("v") % 3 == 0, raster.WATER_FRICTION).otherwise(F.col("v") / F.lit(1000.0))), 4).withColumn("land_share", F.round("land_share", 9))


def class_shares(spark, d):
    return raster.class_shares(frame(spark, d, "class_raster"), HEIGHT)


def class_census(spark, d):
    return frame(spark, d, "class_raster").groupBy("v").agg(F.count("*").alias("cells"))


def row_runs(spark, d):
    return raster.row_runs(frame(spark, d, "class_raster"))


def quantized(spark, d):
    return raster.quantize(frame(spark, d, "cell"), 1 << 9)


def regrid_population(spark, d):
    return raster.regrid_points(frame(spark, d, "city"), raster.Grid(18, 36, 10.0), "population")


def density_bytes(spark, d):
    cells = raster.regrid_points(frame(spark, d, "city"), raster.Grid(18, 36, 10.0), "population")
    area = 412_000.0
    return cells.select("r", "c", scalars.density_byte(F.col("v"), F.lit(area)).alias("byte"), scalars.display_density(F.col("v"), F.lit(area)).alias("shown"), *(v.cast("int").alias({"r": "red", "g": "green", "b": "blue"}[k]) for k, v in scalars.rgb24(F.col("v") % (1 << 24)).items()))


def downsampled(spark, d):
    return raster.downsample(frame(spark, d, "class_raster"), 5, HEIGHT, WIDTH)


def coastal_labels(spark, d):
    return raster.snap_labels(frame(spark, d, "cell"), frame(spark, d, "label"), GRID)


def zonal_sum(spark, d):
    return zonal.zonal_sum(frame(spark, d, "cell"), frame(spark, d, "label"), [EXCLUDED])


def zonal_weighted(spark, d):
    coarse = raster.block_sum(frame(spark, d, "cell"), 4)
    return zonal.zonal_weighted(coarse, frame(spark, d, "label"), 4, HEIGHT).withColumn("total", F.round("total", 3))


def zonal_rollup(spark, d):
    return zonal.roll_up(zonal_sum(spark, d).filter("kind = 'unit'"), frame(spark, d, "parent"))


def zonal_conservation(spark, d):
    return zonal.conservation(frame(spark, d, "cell"), zonal_sum(spark, d))


def density_targets(spark, d):
    z = zonal_sum(spark, d).filter("label > 0").select("label", F.col("cells").cast("double").alias("area"), F.when(F.col("label") % 7 == 0, None).when(F.col("label") % 11 == 0, 0.0).otherwise(F.col("total").cast("double")).alias("value"))
    return zonal.density_targets(z)


def _overlay(spark, d):
    a = frame(spark, d, "label").filter("lab > 0")
    b = frame(spark, d, "class_raster").select("r", "c", F.col("v").cast("int").alias("lab"))
    return a, b


def pair_overlay(spark, d):
    return zonal.pair_overlay(*_overlay(spark, d), HEIGHT)


def border_lengths(spark, d):
    return zonal.border_lengths(frame(spark, d, "label"), WIDTH)


def region_transfer(spark, d):
    a, b = _overlay(spark, d)
    pairs = zonal.pair_overlay(a, b, HEIGHT)
    return zonal.transfer(pairs, zonal.overlay_borders(a, b, WIDTH)).select("lb", "la", "rule")


def compare_totals(spark, d):
    a = zonal_sum(spark, d).select(F.col("label").alias("id"), F.col("total").cast("double").alias("total"))
    b = a.filter("id <> 3").withColumn("total", F.when(F.col("id") % 5 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return zonal.compare_totals(a, b)


def majority_class(spark, d):
    met = frame(spark, d, "label").filter("lab > 0").join(frame(spark, d, "class_raster"), ["r", "c"])
    return stats.majority(met, "lab", "v")


def core_cells(spark, d):
    cells = frame(spark, d, "label").filter("lab > 0").join(frame(spark, d, "cell"), ["r", "c"]).withColumn("target", F.lit(3000))
    return stats.cumulative_core(cells, "lab", [F.col("v").desc(), "r", "c"], "v", "target").select("lab", "r", "c", "core")


def level_monotonicity(spark, d):
    cells = frame(spark, d, "cell").select("r", "c", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("v").alias("p")), F.struct(F.lit(1).alias("level"), (F.col("v") * 3 % 1000).alias("p")), F.struct(F.lit(2).alias("level"), (F.col("v") * 7 % 2000).alias("p")))).alias("x"))
    return raster.monotonicity_violations(cells.select("r", "c", "x.level", F.col("x.p").alias("population")))


def bilinear_samples(spark, d):
    nodes = frame(spark, d, "cell").select(F.col("r").alias("i"), F.col("c").alias("j"), F.col("v").cast("double").alias("f"))
    points = frame(spark, d, "site").select("point_id", ((F.lit(90.0) - F.col("lat")) / 5.0).alias("y"), ((F.col("lon") + 180.0) / 5.2).alias("x"))
    return raster.bilinear(points, nodes, "point_id").withColumn("f", F.round("f", 4))


def fill_nearest(spark, d):
    cells = frame(spark, d, "class_raster").withColumn("land", (F.col("r") + F.col("c")) % 4 != 0)
    return reach.fill_nearest(cells, GRID)


def grid_neighbours(spark, d):
    return raster.neighbour_pairs(frame(spark, d, "class_raster").filter("v > 0"), GRID).groupBy("v", "v2").agg(F.count("*").alias("pairs"))


def _friction(spark, d):
    return frame(spark, d, "cell").withColumn("v", F.when(F.col("v") % 4 == 0, 0.0).otherwise((F.col("v") % 50 + 1) / F.lit(1000.0)))


def _cities(spark, d):
    """All cities with their centres, and the cells that they start from: their own, and for those of five millions the four around it."""
    city = frame(spark, d, "city").select("city_id", "population", "lat", "lon")
    at = raster.cell_of(F.col("lat"), F.col("lon"), GRID)
    steps = F.when(F.col("population") >= 5_000_000, F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    spots = city.select("city_id", at["r"].alias("r"), at["c"].alias("c"), F.explode(steps).alias("s")).select("city_id", (F.col("r") + F.col("s.i")).alias("r"), F.pmod(F.col("c") + F.col("s.j"), F.lit(WIDTH)).alias("c")).filter(F.col("r").between(0, HEIGHT - 1))
    land = _friction(spark, d).filter("v > 0").select("r", "c").join(frame(spark, d, "label"), ["r", "c"])
    node = (F.col("r") * WIDTH + F.col("c")).cast("long").alias("node")
    return reach.city_sources(spots.select("city_id", node), city, land.select(node, F.col("lab").alias("route")), GRID)


def city_sources(spark, d):
    cities, sources = _cities(spark, d)
    counts = sources.groupBy("city_id").agg(F.count("*").alias("cells"))
    return cities.join(counts, "city_id", "left").select("city_id", "centre", "merged_into", F.coalesce("cells", F.lit(0)).alias("cells"))


def _footprints(spark, d):
    cells = polygon.footprints(frame(spark, d, "outline").drop("country"), GRID)
    return cells.select(F.col("poly").alias("city_id"), "r", "c")


def _clipped(spark, d):
    """Footprints, cities, land with its country, and people by cell where they are known."""
    node = (F.col("r") * WIDTH + F.col("c")).cast("long").alias("node")
    land = _friction(spark, d).filter("v > 0").select("r", "c").join(frame(spark, d, "label"), ["r", "c"])
    people = frame(spark, d, "cell").filter("v % 7 <> 0").select(node, F.col("v").alias("people"))
    return _footprints(spark, d).select("city_id", node), frame(spark, d, "city").select("city_id", "population", "lat", "lon"), land.select(node, F.col("lab").alias("route")), people


def footprint_cells(spark, d):
    """The cells of each city's ground: those it holds the centre of, and all that its border touches."""
    return _footprints(spark, d)


def footprint_sources(spark, d):
    """Centres and cells of cities that start from their ground."""
    ground, cities, land, _ = _clipped(spark, d)
    placed, sources = reach.city_sources(ground, cities, land, GRID)
    counts = sources.groupBy("city_id").agg(F.count("*").alias("cells"))
    return placed.join(counts, "city_id", "left").select("city_id", "centre", "merged_into", F.coalesce("cells", F.lit(0)).alias("cells"))


def source_clipping(spark, d):
    """What cities lose whose ground lies in several countries."""
    return reach.source_clipping(*_clipped(spark, d), GRID).withColumn("shift_km", F.round("shift_km", 6))


def grid_edges(spark, d):
    return reach.grid_edges(_friction(spark, d), GRID).select("a", "b", F.round("hours", 6).alias("hours"))


def _owned(spark, d):
    cities, sources = _cities(spark, d)
    edges, starts = reach.grid_edges(_friction(spark, d), GRID), reach.seeds(cities, sources, scalars.DEFAULT_REACH_LEVEL)
    return reach.ownership(edges, starts, WIDTH, side=16), edges, starts


def reach_ownership(spark, d):
    return _owned(spark, d)[0].select("node", "city_id", F.round("cost", 6).alias("cost"))


def reach_thresholds(spark, d):
    cities, sources = _cities(spark, d)
    return reach.thresholds(reach.grid_edges(_friction(spark, d), GRID), cities, sources, WIDTH, side=16).withColumn("threshold", F.round("threshold", 6)).withColumn("hours", F.round("hours", 6))


def reach_report(spark, d):
    cells = frame(spark, d, "cell").select((F.col("r") * WIDTH + F.col("c")).cast("long").alias("node"), F.col("v").alias("population"))
    return reach.level_report(reach_ownership(spark, d), cells)


def reach_status(spark, d):
    return reach_thresholds(spark, d).groupBy("status", scalars.status_key(F.col("status")).alias("message")).agg(F.count("*").alias("cities"))


def stray_territories(spark, d):
    """Parts of territories that hold no cell of their city once cells of one value in five are closed: edges to them are gone."""
    owned, edges, starts = _owned(spark, d)
    shut = frame(spark, d, "cell").filter("v % 5 = 0").select((F.col("r") * WIDTH + F.col("c")).cast("long").alias("a"))
    return reach.stray_territories(owned, edges.join(shut, "a", "left_anti").join(shut.withColumnRenamed("a", "b"), "b", "left_anti"), starts)


def _densities(spark, d):
    cells = frame(spark, d, "cell")
    both = cells.select("r", "c", F.explode(F.array(F.struct(F.lit("volume").alias("metric"), (F.col("v") + 200.0).alias("density")), F.struct(F.lit("flat").alias("metric"), F.lit(1.0).alias("density")))).alias("m"))
    return both.select("m.metric", "r", "c", "m.density")


def cartogram_field(spark, d):
    return cartogram.cartogram(_densities(spark, d), HEIGHT, WIDTH)


def cartogram_areas(spark, d):
    return cartogram.mapped_areas(cartogram_field(spark, d), frame(spark, d, "label"))


QUERIES = {f.__name__: f for f in (block_sum, block_friction, class_shares, class_census, row_runs, quantized, regrid_population, density_bytes, downsampled, coastal_labels, zonal_sum, zonal_weighted, zonal_rollup, zonal_conservation, density_targets, pair_overlay, border_lengths, region_transfer, compare_totals, majority_class, core_cells, level_monotonicity, bilinear_samples, fill_nearest, grid_neighbours, grid_edges, city_sources, footprint_cells, footprint_sources, source_clipping, reach_ownership, reach_thresholds, reach_report, reach_status, stray_territories, cartogram_field, cartogram_areas)}

_W = "(sin(radians(90e0-r*5e0))-sin(radians(90e0-(r+1)*5e0)))"
_ZONAL = f"""WITH zonal AS (SELECT label, CASE WHEN label=0 THEN 'unassigned' WHEN label={EXCLUDED} THEN 'excluded' ELSE 'unit' END AS kind, cast(sum(v) AS bigint) AS total, count(*) AS cells
  FROM (SELECT k.v, coalesce(l.lab, 0) AS label FROM {{cell}} k LEFT JOIN {{label}} l USING (r, c)) GROUP BY 1, 2)"""
_PAIRS = f"""WITH pairs AS (SELECT l.lab AS la, cast(b.v AS int) AS lb, sum({_W.replace('r*5e0', 'l.r*5e0').replace('(r+1)', '(l.r+1)')}) AS area, count(*) AS cells FROM {{label}} l JOIN {{class_raster}} b ON l.r=b.r AND l.c=b.c WHERE l.lab > 0 GROUP BY 1, 2)"""
_STEPS = "(SELECT dr, dc FROM (SELECT unnest(range(-1,2)) AS dr) a, (SELECT unnest(range(-1,2)) AS dc) b WHERE dr <> 0 OR dc <> 0) s"
_EDGES = f"""WITH frict AS (SELECT r, c, CASE WHEN v%4=0 THEN 0e0 ELSE (v%50+1)/1000e0 END AS v FROM {{cell}}),
pairs AS (SELECT a.r, a.c, a.v, b.r AS r2, b.c AS c2, b.v AS v2 FROM frict a, {_STEPS}, frict b WHERE b.r = a.r+s.dr AND b.c = (a.c+s.dc+72)%72 AND a.v > 0 AND b.v > 0),
lens AS (SELECT *, (cos(radians(90e0-(r+0.5e0)*5e0))+cos(radians(90e0-(r2+0.5e0)*5e0)))/2e0*5e0*111194.92664455873e0 AS dx, 5e0*111194.92664455873e0 AS dy FROM pairs),
edges AS (SELECT cast(r*72+c AS bigint) AS a, cast(r2*72+c2 AS bigint) AS b, (v+v2)/2e0*(CASE WHEN r=r2 THEN dx WHEN c=c2 THEN dy ELSE sqrt(dx*dx+dy*dy) END)/60e0 AS hours FROM lens)"""

_LAND = "frict AS (SELECT r, c, CASE WHEN v%4=0 THEN 0e0 ELSE (v%50+1)/1000e0 END AS v FROM {cell})"
_SOURCES = """homes AS (SELECT city_id, population, lat, lon, least(35, greatest(0, cast(floor((90e0-lat)/5e0) AS int))) AS r, cast(floor((lon+180e0)/5e0) AS int)%72 AS c FROM {city}),
spots AS (SELECT city_id, population, r+i AS r, (c+j+72)%72 AS c FROM homes, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(i, j) WHERE r+i BETWEEN 0 AND 35 AND (population >= 5000000 OR (i = 0 AND j = 0))),
drawn AS (SELECT r, c, city_id FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY population DESC, city_id) AS n FROM spots) WHERE n = 1),
raw AS (SELECT d.*, l.lab AS route FROM drawn d JOIN frict f ON f.r = d.r AND f.c = d.c AND f.v > 0 JOIN {label} l ON l.r = d.r AND l.c = d.c),
most AS (SELECT city_id, route FROM (SELECT city_id, route, row_number() OVER (PARTITION BY city_id ORDER BY count(*) DESC, route) AS n FROM raw GROUP BY 1, 2) WHERE n = 1),
kept AS (SELECT city_id, cast(r*72+c AS bigint) AS node, r, c FROM raw JOIN most USING (city_id, route)),
centres AS (SELECT city_id, node AS centre FROM (SELECT k.city_id, k.node, row_number() OVER (PARTITION BY k.city_id ORDER BY CASE WHEN k.node = h.r*72+h.c THEN 0 ELSE 1 END, pow(k.r-((90e0-lat)/5e0-0.5e0), 2)+pow(least(abs(k.c-((lon+180e0)/5e0-0.5e0)), 72-abs(k.c-((lon+180e0)/5e0-0.5e0))), 2), k.node) AS n FROM kept k JOIN homes h USING (city_id)) WHERE n = 1),
towns AS (SELECT h.city_id, h.population, centre, CASE WHEN centre IS NULL AND d.city_id <> h.city_id THEN d.city_id END AS merged_into, (SELECT count(*) FROM kept k WHERE k.city_id = h.city_id) AS cells FROM homes h LEFT JOIN centres USING (city_id) LEFT JOIN drawn d ON d.r = h.r AND d.c = h.c)"""

# each cell against each edge of a city's ground, cut to the cell's columns and rows
_GROUND = EDGES.replace("{ring}", "{outline}") + """,
grid AS (SELECT r, c FROM (SELECT unnest(range(36)) AS r) a, (SELECT unnest(range(72)) AS c) b),
turned AS (SELECT poly, (lon+180e0)/5e0+t*72 AS x1, (lon2+180e0)/5e0+t*72 AS x2, (90e0-lat)/5e0 AS y1, (90e0-lat2)/5e0 AS y2 FROM edges, (SELECT unnest([-1, 0, 1]) AS t) q),
cuts AS (
  SELECT poly, r, c, CASE WHEN x1 = x2 THEN 0 ELSE least((c-x1)/(x2-x1), (c+1-x1)/(x2-x1)) END AS a0, CASE WHEN x1 = x2 THEN 1 ELSE greatest((c-x1)/(x2-x1), (c+1-x1)/(x2-x1)) END AS a1,
         CASE WHEN y1 = y2 THEN 0 ELSE least((r-y1)/(y2-y1), (r+1-y1)/(y2-y1)) END AS b0, CASE WHEN y1 = y2 THEN 1 ELSE greatest((r-y1)/(y2-y1), (r+1-y1)/(y2-y1)) END AS b1
  FROM turned JOIN grid ON c <= greatest(x1, x2) AND c+1 >= least(x1, x2) AND r <= greatest(y1, y2) AND r+1 >= least(y1, y2)),
inner_ AS (
  SELECT poly, r, c FROM (
    SELECT poly, r, c, count(*) AS n FROM turned JOIN grid ON (y1 <= r+0.5e0) <> (y2 <= r+0.5e0) AND x1+(r+0.5e0-y1)/nullif(y2-y1, 0)*(x2-x1) > c+0.5e0 GROUP BY 1, 2, 3) i WHERE n%2 = 1),
ground AS (SELECT DISTINCT poly AS city_id, cast(r AS int) AS r, cast(c AS int) AS c FROM (SELECT poly, r, c FROM cuts WHERE greatest(0, a0, b0) <= least(1, a1, b1) UNION ALL SELECT poly, r, c FROM inner_) g),
homes AS (SELECT city_id, population, lat, lon, least(35, greatest(0, cast(floor((90e0-lat)/5e0) AS int))) AS r, cast(floor((lon+180e0)/5e0) AS int)%72 AS c FROM {city}),
spots AS (SELECT g.city_id, population, g.r, g.c FROM ground g JOIN homes h ON h.city_id = g.city_id)"""
_CLIPPED = f"WITH {_LAND}, {_GROUND}," + _SOURCES.split("(i = 0 AND j = 0))),")[1]

# least (cost, rank) of each node: rounds over what changed, until nothing does
_OWN = f"""WITH RECURSIVE {_EDGES.removeprefix('WITH ')}, {_SOURCES},
ranked AS (SELECT city_id, row_number() OVER (ORDER BY population DESC, city_id) AS rank, 4e0*((SELECT log10(max(population)) FROM towns)-log10(population)) AS late FROM towns),
starts AS (SELECT k.node, round(late, 9) AS cost, rank, k.city_id FROM kept k JOIN ranked USING (city_id)),
own(node, b) USING KEY (node) AS (
  SELECT node, {{{{'cost': cost, 'rank': rank, 'city_id': city_id}}}} AS b FROM starts
  UNION
  SELECT n.node, n.b FROM (SELECT e.b AS node, min({{{{'cost': round(w.b.cost+e.hours, 9), 'rank': w.b.rank, 'city_id': w.b.city_id}}}}) AS b FROM own w JOIN edges e ON e.a = w.node GROUP BY 1) n
  LEFT JOIN recurring.own h ON h.node = n.node WHERE h.node IS NULL OR n.b < h.b),
owned AS (SELECT node, b.city_id AS city_id, b.cost AS cost FROM own)""".replace("{{", "{").replace("}}", "}")
_STRAY = _OWN + """,
open AS (SELECT e.a, e.b FROM edges e JOIN owned x ON x.node = e.a JOIN owned y ON y.node = e.b AND x.city_id = y.city_id WHERE e.a NOT IN (SELECT r*72+c FROM {cell} WHERE v%5 = 0) AND e.b NOT IN (SELECT r*72+c FROM {cell} WHERE v%5 = 0)),
part(node, component) USING KEY (node) AS (
  SELECT node, node AS component FROM owned
  UNION
  SELECT n.node, n.component FROM (SELECT o.b AS node, min(w.component) AS component FROM part w JOIN open o ON o.a = w.node GROUP BY 1) n JOIN recurring.part h ON h.node = n.node WHERE n.component < h.component),
parts AS (SELECT p.node, component, city_id FROM part p JOIN owned o USING (node))
SELECT component, city_id, count(*) AS cells FROM parts WHERE component NOT IN (SELECT component FROM parts p JOIN kept k ON k.node = p.node AND k.city_id = p.city_id) GROUP BY 1, 2"""

_TIMES = f"""WITH RECURSIVE {_EDGES.removeprefix('WITH ')}, {_SOURCES},
way(start, node, hours) USING KEY (start, node) AS (
  SELECT centre AS start, centre AS node, 0e0 AS hours FROM towns WHERE centre IS NOT NULL
  UNION
  SELECT n.start, n.node, n.hours FROM (SELECT w.start, e.b AS node, min(round(w.hours+e.hours, 9)) AS hours FROM way w JOIN edges e ON e.a = w.node GROUP BY 1, 2) n
  LEFT JOIN recurring.way h ON h.start = n.start AND h.node = n.node WHERE h.node IS NULL OR n.hours < h.hours),
met AS (SELECT t.city_id, round(round(w.hours, 4)/(log10(o.population)-log10(t.population)), 9) AS threshold, o.population AS size, o.city_id AS parent, round(w.hours, 4) AS hours
  FROM towns t JOIN way w ON w.start = t.centre JOIN kept k ON k.node = w.node JOIN towns o ON o.city_id = k.city_id WHERE o.population > t.population),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY threshold, size DESC, parent, hours) AS n FROM met) WHERE n = 1),
judged AS (SELECT t.city_id, CASE WHEN centre IS NULL AND merged_into IS NOT NULL THEN 'merged_at_resolution' WHEN centre IS NULL THEN 'transport_missing' WHEN parent IS NOT NULL THEN 'ok' WHEN population = (SELECT max(population) FROM towns) THEN 'root' ELSE 'no_larger_reachable' END AS status, threshold, parent, hours
  FROM towns t LEFT JOIN least l USING (city_id))"""

ORACLES = {
    k: inline(v)
    for k, v in {
        "block_sum": "SELECT cast(floor(r/4e0) AS int) AS r, cast(floor(c/4e0) AS int) AS c, cast(sum(v) AS bigint) AS v FROM {cell} GROUP BY 1, 2",
        "block_friction": "SELECT cast(floor(r/4e0) AS int) AS r, cast(floor(c/4e0) AS int) AS c, min(CASE WHEN v%3<>0 AND v > 0 AND abs(v/1000e0-0.00316e0) > 2e-6 THEN v/1000e0 END) AS friction, max(CASE WHEN v%3<>0 AND v > 0 AND abs(v/1000e0-0.00316e0) > 2e-6 THEN 1 ELSE 0 END) AS any_land, round(avg(CASE WHEN v%3<>0 AND v > 0 AND abs(v/1000e0-0.00316e0) > 2e-6 THEN 1e0 ELSE 0e0 END), 9) AS land_share FROM {cell} GROUP BY 1, 2",
        "class_shares": f"SELECT v, cells, round(w/sum(w) OVER (), 6) AS share FROM (SELECT v, count(*) AS cells, sum({_W}) AS w FROM {{class_raster}} WHERE v > 0 GROUP BY v)",
        "class_census": "SELECT v, count(*) AS cells FROM {class_raster} GROUP BY v",
        "row_runs": "SELECT r, v, min(c) AS first, max(c) AS last FROM (SELECT *, c-row_number() OVER (PARTITION BY r, v ORDER BY c) AS island FROM {class_raster}) GROUP BY r, v, island",
        "quantized": "SELECT r, c, cast(floor(v/unit+0.5e0) AS bigint) AS q, cast(unit AS bigint) AS unit FROM {cell}, (SELECT pow(10e0, greatest(0e0, floor(log10(greatest(cast(max(v) AS double), 1e0)/512))+1)) AS unit FROM {cell})",
        "regrid_population": "SELECT cast(least(17, greatest(0, floor((90e0-lat)/180e0*18))) AS int) AS r, cast(floor((lon+180e0)/360e0*36) AS int) AS c, cast(sum(population) AS bigint) AS v FROM {city} GROUP BY 1, 2",
        "density_bytes": "SELECT r, c, cast(floor(least(1e0, log10(1+v/412000e0)/4e0)*254e0+0.5e0) AS int) AS byte, cast(CASE WHEN v <= 0 THEN 0 ELSE greatest(1, floor(least(1e0, log10(1+v/412000e0)/4e0)*255e0+0.5e0)) END AS int) AS shown, cast((v%16777216)//65536 AS int) AS red, cast(((v%16777216)//256)%256 AS int) AS green, cast(v%256 AS int) AS blue FROM (SELECT cast(least(17, greatest(0, floor((90e0-lat)/180e0*18))) AS int) AS r, cast(floor((lon+180e0)/360e0*36) AS int) AS c, cast(sum(population) AS bigint) AS v FROM {city} GROUP BY 1, 2)",
        "downsampled": "SELECT cast(floor(r/5e0) AS int) AS r, cast(floor(c/5e0) AS int) AS c, v FROM {class_raster} WHERE r = least(floor(r/5e0)*5+2, 35) AND c = least(floor(c/5e0)*5+2, 71)",
        "coastal_labels": "SELECT r, c, v, lab FROM (SELECT k.r, k.c, k.v, l.lab, row_number() OVER (PARTITION BY k.r, k.c ORDER BY CASE WHEN l.lab IS NULL THEN 1 ELSE 0 END, s.dy*s.dy+s.dx*s.dx, l.lab) AS n FROM {cell} k CROSS JOIN (SELECT dy, dx FROM (SELECT unnest(range(-2,3)) AS dy) a, (SELECT unnest(range(-2,3)) AS dx) b WHERE dy*dy+dx*dx <= 4) s LEFT JOIN {label} l ON l.r = k.r+s.dy AND l.c = (k.c+s.dx+72)%72 AND l.lab > 0) WHERE n = 1",
        "zonal_sum": _ZONAL + " SELECT * FROM zonal",
        "zonal_weighted": f"WITH coarse AS (SELECT cast(floor(r/4e0) AS int) AS r, cast(floor(c/4e0) AS int) AS c, cast(sum(v) AS bigint) AS v FROM {{cell}} GROUP BY 1, 2), parts AS (SELECT cr AS r, cc AS c, lab, w/sum(w) OVER (PARTITION BY cr, cc) AS part FROM (SELECT cast(floor(r/4e0) AS int) AS cr, cast(floor(c/4e0) AS int) AS cc, lab, sum({_W}) AS w FROM {{label}} WHERE lab > 0 GROUP BY 1, 2, 3)) SELECT coalesce(lab, 0) AS label, round(sum(v*coalesce(part, 1e0)), 3) AS total FROM coarse LEFT JOIN parts USING (r, c) GROUP BY 1",
        "zonal_rollup": _ZONAL + " SELECT parent, cast(sum(total) AS bigint) AS total, count(total) AS children FROM {parent} p LEFT JOIN (SELECT * FROM zonal WHERE kind='unit') z ON p.label = z.label GROUP BY parent",
        "zonal_conservation": _ZONAL + " SELECT cast((SELECT sum(v) FROM {cell}) AS double) AS source, cast(sum(total) AS double) AS assigned, abs((SELECT sum(v) FROM {cell})-sum(total)) <= 1e-9*greatest(abs((SELECT sum(v) FROM {cell})), 1) AS conserved FROM zonal",
        "density_targets": _ZONAL + ", units AS (SELECT label, cast(cells AS double) AS area, CASE WHEN label%7=0 THEN NULL WHEN label%11=0 THEN 0e0 ELSE cast(total AS double) END AS value FROM zonal WHERE label > 0), dense AS (SELECT *, CASE WHEN value IS NULL THEN mean WHEN value=0 THEN mean/100 ELSE value/area END AS density FROM units, (SELECT sum(value)/sum(CASE WHEN value IS NOT NULL THEN area END) AS mean FROM units)), shares AS (SELECT *, density*area/sum(density*area) OVER () AS s, sum(area) OVER () AS whole FROM dense) SELECT label, area, value, round(density, 9) AS density, round(s, 9) AS share, round(s*whole, 6) AS target_area, round(s*whole/area, 6) AS ratio FROM shares",
        "pair_overlay": _PAIRS + " SELECT la, lb, round(area, 9) AS area, cells FROM pairs",
        "border_lengths": "SELECT least(a.lab, b.lab) AS la, greatest(a.lab, b.lab) AS lb, count(*) AS edges FROM {label} a JOIN {label} b ON (b.r = a.r AND b.c = (a.c+1)%72 OR b.r = a.r+1 AND b.c = a.c) AND a.lab <> b.lab GROUP BY 1, 2",
        "region_transfer": _PAIRS + ", sides AS (SELECT l.lab AS la, cast(b.v AS int) AS lb, count(*) AS edges FROM {class_raster} b, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(i, j), {class_raster} o, {label} l WHERE o.r = b.r+i AND o.c = (b.c+j+72)%72 AND o.v <> b.v AND l.r = o.r AND l.c = o.c AND l.lab > 0 GROUP BY 1, 2) SELECT lb, la, CASE WHEN share >= 0.95e0 THEN 'dominant' ELSE 'remnant' END AS rule FROM (SELECT *, row_number() OVER (PARTITION BY lb ORDER BY CASE WHEN share >= 0.95e0 THEN 0 ELSE 1 END, coalesce(edges, 0) DESC, round(area, 9) DESC, la) AS n FROM (SELECT p.*, edges, area/sum(area) OVER (PARTITION BY p.lb) AS share FROM pairs p LEFT JOIN sides s ON s.la = p.la AND s.lb = p.lb)) WHERE n = 1",
        "compare_totals": _ZONAL + " SELECT label AS id, CASE WHEN label = 3 THEN false WHEN label%5 = 0 THEN 1 < 1e-9*abs(total+1) ELSE true END AS equal FROM zonal",
        "majority_class": "SELECT lab, v, n AS votes, cells FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY n DESC, v) AS k, cast(sum(n) OVER (PARTITION BY lab) AS bigint) AS cells FROM (SELECT lab, v, count(*) AS n FROM {label} JOIN {class_raster} USING (r, c) WHERE lab > 0 GROUP BY 1, 2)) WHERE k = 1",
        "core_cells": "SELECT lab, r, c, coalesce(sum(v) OVER (PARTITION BY lab ORDER BY v DESC, r, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3000 AS core FROM {label} JOIN {cell} USING (r, c) WHERE lab > 0",
        "level_monotonicity": "WITH x AS (SELECT r, c, 0 AS level, v AS p FROM {cell} UNION ALL SELECT r, c, 1, v*3%1000 FROM {cell} UNION ALL SELECT r, c, 2, v*7%2000 FROM {cell}) SELECT level, count(*) FILTER (WHERE p < b) AS violations, count(*) AS cells FROM (SELECT *, lag(p) OVER (PARTITION BY r, c ORDER BY level) AS b FROM x) WHERE b IS NOT NULL GROUP BY level",
        "bilinear_samples": "SELECT point_id, round(sum(w*v), 4) AS f FROM (SELECT point_id, cast(floor(y)+a AS int) AS i, cast(floor(x)+b AS int) AS j, (CASE WHEN a=1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE WHEN b=1 THEN x-floor(x) ELSE 1-(x-floor(x)) END) AS w FROM (SELECT point_id, (90e0-lat)/5e0 AS y, (lon+180e0)/5.2e0 AS x FROM {site}), (SELECT unnest([0,1]) AS a), (SELECT unnest([0,1]) AS b)) p JOIN {cell} k ON k.r = p.i AND k.c = p.j WHERE w > 0 GROUP BY 1",
        "fill_nearest": "WITH cells AS (SELECT r, c, v, (r+c)%4 <> 0 AS land FROM {class_raster}), near AS (SELECT r, c, kv FROM (SELECT a.r, a.c, k.v AS kv, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r-k.r)*(a.r-k.r)+(a.c-k.c)*(a.c-k.c), k.r, k.c) AS n FROM cells a, cells k WHERE a.land AND a.v = 0 AND k.v > 0) WHERE n = 1) SELECT r, c, land, coalesce(kv, v) AS v FROM cells LEFT JOIN near USING (r, c)",
        "grid_neighbours": f"SELECT a.v, b.v AS v2, count(*) AS pairs FROM {{class_raster}} a, {_STEPS}, {{class_raster}} b WHERE b.r = a.r+s.dr AND b.c = (a.c+s.dc+72)%72 AND a.v > 0 AND b.v > 0 GROUP BY 1, 2",
        "city_sources": f"WITH {_LAND}, {_SOURCES} SELECT city_id, centre, merged_into, cells FROM towns",
        "reach_ownership": _OWN + " SELECT node, city_id, round(cost, 6) AS cost FROM owned",
        "reach_report": _OWN + " SELECT count(DISTINCT city_id) AS territories, count(*) FILTER (WHERE city_id IS NULL) AS unreached_cells, cast(coalesce(sum(v) FILTER (WHERE city_id IS NULL), 0) AS bigint) AS unreached_people FROM {cell} k LEFT JOIN owned o ON o.node = k.r*72+k.c",
        "stray_territories": _STRAY,
        "reach_thresholds": _TIMES + " SELECT city_id, status, round(threshold, 6) AS threshold, parent, round(hours, 6) AS hours FROM judged",
        "reach_status": _TIMES + " SELECT status, 'reach.' || status AS message, count(*) AS cities FROM judged GROUP BY 1, 2",
        "footprint_cells": f"WITH {_GROUND} SELECT * FROM ground",
        "footprint_sources": _CLIPPED + " SELECT city_id, centre, merged_into, cells FROM towns",
        "source_clipping": _CLIPPED
        + """, lost AS (
  SELECT w.city_id, max(m.route) AS route, count(*) AS before, count(*) FILTER (WHERE w.route = m.route) AS retained, count(*) FILTER (WHERE w.route <> m.route) AS removed,
         cast(coalesce(sum(k.v) FILTER (WHERE w.route <> m.route), 0) AS bigint) AS removed_people, count(*) FILTER (WHERE w.route <> m.route AND k.v IS NULL) AS removed_missing
  FROM raw w JOIN most m ON m.city_id = w.city_id LEFT JOIN (SELECT * FROM {cell} WHERE v%7 <> 0) k ON k.r = w.r AND k.c = w.c GROUP BY 1)
SELECT l.*, round(2e0*6371.0088e0*asin(sqrt(least(1e0, pow(sin(radians(y-h.lat)/2e0), 2)+cos(radians(h.lat))*cos(radians(y))*pow(sin(radians(x-h.lon)/2e0), 2)))), 6) AS shift_km
FROM lost l JOIN homes h ON h.city_id = l.city_id JOIN (SELECT city_id, 90e0-(centre//72+0.5e0)*5e0 AS y, (centre%72+0.5e0)*5e0-180e0 AS x FROM towns) t ON t.city_id = l.city_id WHERE removed > 0""",
        "grid_edges": _EDGES + " SELECT a, b, round(hours, 6) AS hours FROM edges",
    }.items()
}
