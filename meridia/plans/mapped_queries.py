"""Queries over labels on mapped surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import colour
from meridia.operators import mapped, mapping, polygon, zonal
from meridia.plans.shape_queries import EDGES, LABELS
from meridia.plans.views import HEIGHT, WIDTH, frame, inline

FIELD_HEIGHT, FIELD_WIDTH = 60, 120
MESH_HEIGHT, MESH_WIDTH = 18, 24
BOUNDS = (-180.0, -85.0, 180.0, 84.0)


# ---- distance to borders


def _vertices(spark, d):
    return frame(spark, d, "ring").withColumn("lab", F.col("country") + 1).drop("country")


def _field(spark, d):
    """Cells labelled by the first polygon that holds them; where another label's polygon lies over it, the field is 0."""
    shapes = _vertices(spark, d)
    firsts = mapped.rasterize(shapes.drop("lab"), FIELD_HEIGHT, FIELD_WIDTH).join(shapes.select("poly", "lab").distinct(), "poly")
    firsts = firsts.groupBy("r", "c").agg(F.min_by("lab", "poly").alias("lab"))
    grid = spark.range(FIELD_HEIGHT * FIELD_WIDTH).select(F.expr(f"cast(id div {FIELD_WIDTH} as int)").alias("r"), (F.col("id") % FIELD_WIDTH).cast("int").alias("c"))
    cells = grid.join(firsts, ["r", "c"], "left").select("r", "c", F.coalesce("lab", F.lit(0)).alias("lab"))
    return mapped.distance_field(cells, shapes, FIELD_HEIGHT, FIELD_WIDTH)


def distance_field(spark, d):
    """How far each cell is from the border of its label, in 255ths of four pixels."""
    return _field(spark, d)


def label_samples(spark, d):
    """The label at each city by its four nearest cells."""
    field = _field(spark, d).withColumn("pad", ((F.col("r") * 3 + F.col("c")) % 5 == 0).cast("int"))
    cities = frame(spark, d, "city")
    out = mapped.sample_labels(cities, field, FIELD_HEIGHT, FIELD_WIDTH, "city_id")
    return out.select("city_id", "lab", "pad", F.round("distance", 6).alias("distance"))


def patch_labels(spark, d):
    """The label at each city that lies in a patch, from the patch's part of the atlas."""
    out = mapped.sample_patches(frame(spark, d, "city"), frame(spark, d, "patch"), frame(spark, d, "texel"), "city_id")
    return out.select("city_id", "patch", F.round("weight", 6).alias("weight"), "lab", "pad", F.round("distance", 4).alias("distance"))


# ---- coverage


def _coverage(spark, d):
    return mapped.triangle_coverage(frame(spark, d, "sheet"), HEIGHT, WIDTH, MESH_HEIGHT, MESH_WIDTH, BOUNDS)


def _parents(spark, d):
    return frame(spark, d, "sheet").filter("lab > 0").select("lab").distinct().withColumn("parent", (F.col("lab") - 1) % 5 + 1)


def mesh_coverage(spark, d):
    """The labels' shares of each triangle of an equal-area mesh."""
    return _coverage(spark, d).select("triangle", "lab", F.round("weight", 12).alias("weight"))


def mesh_diagnostics(spark, d):
    return mapped.mesh_diagnostics(_coverage(spark, d), MESH_HEIGHT, MESH_WIDTH)


def _areas(spark, d):
    return mapped.mapped_areas(_coverage(spark, d), frame(spark, d, "node"), MESH_HEIGHT, MESH_WIDTH, _parents(spark, d))


def mapped_areas(spark, d):
    """The share of the sphere and of a moved mesh that each parent label has."""
    return _areas(spark, d).select("lab", F.round("area", 9).alias("area"), F.round("mapped", 9).alias("mapped"))


def _units(spark, d):
    """What the cells of each parent label hold; one without a figure, one of 0, one excluded."""
    held = frame(spark, d, "sheet").filter("lab > 0").join(frame(spark, d, "cell"), ["r", "c"])
    sums = held.groupBy(((F.col("lab") - 1) % 5 + 1).alias("lab")).agg(F.sum("v").cast("double").alias("value"))
    value = F.when(F.col("lab") == 2, None).when(F.col("lab") == 3, 0.0).otherwise(F.col("value"))
    return sums.select("lab", value.alias("value"), (F.col("lab") == 4).alias("excluded"))


def coverage_densities(spark, d):
    out = mapped.coverage_densities(_areas(spark, d).select("lab", "area"), _units(spark, d))
    return out.select("lab", "value", "excluded", *(F.round(c, 6).alias(c) for c in ("area", "share", "target", "ratio")), F.round("density", 3).alias("density"))


def mesh_densities(spark, d):
    """The normalised density of each cell of the mesh; their mean is 1."""
    dense = mapped.coverage_densities(_areas(spark, d).select("lab", "area"), _units(spark, d))
    return mapped.cell_densities(_coverage(spark, d), dense, MESH_HEIGHT, MESH_WIDTH, _parents(spark, d)).select("y", "x", F.round("density", 6).alias("density"))


# ---- points through a map

SHIFT_HEIGHT, SHIFT_WIDTH = 12, 24


def _shifted(spark, d):
    return frame(spark, d, "shift"), SHIFT_HEIGHT, SHIFT_WIDTH


def displacements(spark, d):
    """The field at each city's place."""
    spots = frame(spark, d, "city").select("city_id", ((F.col("lon") + 180) / 360).alias("x"), ((F.sin(F.radians("lat")) + 1) / 2).alias("y"))
    return mapping.sample_displacement(spots, *_shifted(spark, d), "city_id").select("city_id", F.round("dlon", 6).alias("dlon"), F.round("ds", 9).alias("ds"))


def map_to_globe(spark, d):
    """Where on the globe a map has each city's place, when the map has moved by three tenths and wholly."""
    part, whole = (mapping.to_globe(frame(spark, d, "city"), *_shifted(spark, d), "city_id", t) for t in (0.3, 1.0))
    both = part.select("city_id", F.round("lat", 6).alias("part_lat"), F.round("lon", 6).alias("part_lon"))
    return both.join(whole.select("city_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")), "city_id")


def globe_to_map(spark, d):
    """Where on the map each city is, and whether the map leads back from there."""
    out = mapping.to_map(frame(spark, d, "city"), *_shifted(spark, d), "city_id")
    return out.select("city_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), (F.col("error") < 1e-5).alias("found"))


def there_and_back(spark, d):
    """Each city taken to the map and back to the globe."""
    there = mapping.to_map(frame(spark, d, "city"), *_shifted(spark, d), "city_id")
    back = mapping.to_globe(there, *_shifted(spark, d), "city_id")
    return back.select("city_id", F.round("lat", 4).alias("lat"), F.round(F.pmod(F.round("lon", 4) + 180, F.lit(360.0)) - 180, 4).alias("lon"))


def round_trip(spark, d):
    """How well places of the map are found again, over samples even in area."""
    return mapping.round_trip_summary(mapping.round_trip_errors(spark, *_shifted(spark, d)))


# ---- colours and anchors


def neighbour_colours(spark, d):
    """How far apart the colours of labels that share a border are, in contrast and to four kinds of sight."""
    paint = frame(spark, d, "paint").select("lab", colour.rgb(F.col("red"), F.col("green"), F.col("blue")).alias("rgb"))
    paint = paint.withColumn("light", colour.light(F.col("rgb")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), (colour.seen_light(F.col("light"), k) if k != "usual" else F.col("light")).alias("light")) for k in ("usual", *colour.SIMULATIONS)))
    seen = colour.with_lab(paint.select("lab", "rgb", F.explode(kinds).alias("seen")).select("lab", "rgb", "seen.kind", "seen.light"), "light", "at")
    side = lambda n: seen.select(F.col("lab").alias(f"l{n}"), "kind", F.col("rgb").alias(f"rgb_{n}"), F.col("at").alias(f"at_{n}"))
    pairs = zonal.border_lengths(frame(spark, d, "label"), WIDTH).select("la", "lb").join(side("a"), "la").join(side("b"), ["lb", "kind"])
    apart = colour.with_difference(pairs, "at_a", "at_b", "delta")
    return apart.select("la", "lb", "kind", F.round("delta", 6).alias("delta"), F.round(colour.contrast(F.col("rgb_a"), F.col("rgb_b")), 6).alias("contrast"))


def least_colours(spark, d):
    """For each kind of sight the bordering labels whose colours are nearest."""
    pairs = neighbour_colours(spark, d)
    best = pairs.groupBy("kind").agg(F.min_by(F.struct("la", "lb", "delta"), F.struct("delta", "la", "lb")).alias("p"))
    return best.select("kind", "p.*")


def two_level_anchors(spark, d):
    """Label anchors that suit both the polygons and their outlines of less detail."""
    return polygon.two_level_anchors(frame(spark, d, "ring").drop("country"), frame(spark, d, "rough").drop("country"))


QUERIES = {f.__name__: f for f in (distance_field, label_samples, patch_labels, mesh_coverage, mesh_diagnostics, mapped_areas, coverage_densities, mesh_densities, displacements, map_to_globe, globe_to_map, there_and_back, round_trip, neighbour_colours, least_colours, two_level_anchors)}

# All pairs of cells and edges, with no blocks.
_FIELD = f"""WITH {EDGES},
grid AS (SELECT r, c, 90e0-(r+0.5e0)*3e0 AS y, (c+0.5e0)*3e0-180e0 AS x FROM (SELECT unnest(range(60)) AS r) a, (SELECT unnest(range(120)) AS c) b),
west AS (SELECT poly, min(least(lon, lon2)) AS west FROM edges GROUP BY 1),
spots AS (SELECT r, c, y, w.poly, west+(((x-west)%360e0)+360e0)%360e0 AS x FROM grid, west w),
holders AS (
  SELECT poly, country, r, c FROM (
    SELECT p.poly, e.country, r, c, count(*) AS n FROM spots p
    JOIN edges e ON p.poly = e.poly AND (e.lat <= y) <> (e.lat2 <= y) AND e.lon+(y-e.lat)/nullif(e.lat2-e.lat, 0)*(e.lon2-e.lon) > x GROUP BY 1, 2, 3, 4) h WHERE n%2 = 1),
owners AS (SELECT r, c, min_by(country, poly)+1 AS lab, max_by(country, poly)+1 AS truth FROM holders GROUP BY 1, 2),
cells AS (SELECT g.*, coalesce(lab, 0) AS lab, coalesce(truth, 0) AS truth FROM grid g LEFT JOIN owners o ON o.r = g.r AND o.c = g.c),
pairs AS (
  SELECT r, c, (lon+shift-x)*cos(radians(y))/3e0 AS px, (lon2+shift-x)*cos(radians(y))/3e0 AS qx, (lat-y)/3e0 AS py, (lat2-y)/3e0 AS qy FROM (
    SELECT k.r, k.c, k.x, k.y, e.lat, e.lat2, e.lon, e.lon2, 360e0*floor((k.x-(e.lon+e.lon2)/2e0)/360e0+0.5e0) AS shift
    FROM cells k JOIN edges e ON (k.lab = 0 OR k.lab = e.country+1) AND (e.lat <> e.lat2 OR e.lon <> e.lon2)) s),
near AS (
  SELECT r, c, min(sqrt((px+t*(qx-px))*(px+t*(qx-px))+(py+t*(qy-py))*(py+t*(qy-py)))) AS d FROM (
    SELECT *, coalesce(greatest(0e0, least(1e0, -(px*(qx-px)+py*(qy-py))/nullif((qx-px)*(qx-px)+(qy-py)*(qy-py), 0e0))), 0e0) AS t FROM pairs) p GROUP BY 1, 2),
field AS (
  SELECT k.r, k.c, k.lab, CASE WHEN k.lab = k.truth THEN cast(floor(least(4e0, coalesce(d, 4e0))*63.75e0+0.5e0) AS int) ELSE 0 END AS near,
         CASE WHEN (k.r*3+k.c)%5 = 0 THEN 1 ELSE 0 END AS pad
  FROM cells k LEFT JOIN near n ON n.r = k.r AND n.c = k.c)"""
_TEXELS = "(SELECT unnest([0, 1, 2, 3]) AS k) q"
# id: the point, ts: its four texels
_VOTE = """spoken AS (
  SELECT a.id, a.k, a.lab, sum(b.w*(CASE WHEN b.lab = a.lab THEN b.near ELSE -b.near END) ORDER BY b.k) AS score, arg_max(b.pad, b.w*1000-b.k/1e9) FILTER (WHERE b.lab = a.lab) AS pad
  FROM texels a JOIN texels b ON a.id = b.id GROUP BY 1, 2, 3),
won AS (SELECT id, lab, pad, score*4e0/255e0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, k) AS n FROM spoken) s WHERE n = 1)"""
_W = "(CASE WHEN k%2 = 0 THEN 1-(fx-floor(fx)) ELSE fx-floor(fx) END)*(CASE WHEN k < 2 THEN 1-(fy-floor(fy)) ELSE fy-floor(fy) END)"
_BOX = "greatest(0e0, least(1e0, {0}))"
_HALF = "(pow(greatest({0}-y0, 0e0), 2)-pow(greatest({0}-y1, 0e0), 2))/2e0"
_BELOW = f"CASE WHEN x0 >= y1 THEN whole WHEN x1 <= y0 THEN 0e0 ELSE least(whole, greatest(0e0, {_HALF.format('x1')}-{_HALF.format('x0')})) END"
_DY = "(169e0/36e0)"


def _cut(source: str, left: str, low: str, right: str, high: str, keep: str) -> str:
    """Rows of source with the areas below and above the diagonal of the mesh cell (y, x)."""
    sides = f"SELECT {keep}, y, x, {_BOX.format(left + '-x')} AS x0, {_BOX.format(low + '-y')} AS y0, {_BOX.format(right + '-x')} AS x1, {_BOX.format(high + '-y')} AS y1 FROM {source}"
    whole = f"SELECT *, greatest(0e0, x1-x0)*greatest(0e0, y1-y0) AS whole FROM ({sides}) s"
    return f"SELECT *, {_BELOW} AS below FROM ({whole}) t"


_COVERAGE = f"""WITH mesh AS (SELECT y, x FROM (SELECT unnest(range(18)) AS y) a, (SELECT unnest(range(24)) AS x) b),
spans AS (SELECT lab, (sin(radians(84e0-(r+1)*{_DY}))+1)*9e0 AS low, (sin(radians(84e0-r*{_DY}))+1)*9e0 AS high, c*5e0*24/360e0 AS lft, (c+1)*5e0*24/360e0 AS rgt FROM {{sheet}}),
parts AS ({_cut("spans JOIN mesh ON high > y AND low < y+1 AND rgt > x AND lft < x+1", "lft", "low", "rgt", "high", "lab")}),
due AS ({_cut("mesh", "0e0", "(sin(radians(-85e0))+1)*9e0", "24e0", "(sin(radians(84e0))+1)*9e0", "0 AS lab")}),
pieces AS (
  SELECT 2*(y*24+x) AS triangle, lab, below AS a FROM parts UNION ALL SELECT 2*(y*24+x)+1, lab, whole-below FROM parts UNION ALL
  SELECT 2*(y*24+x), 0, 0.5e0-below FROM due UNION ALL SELECT 2*(y*24+x)+1, 0, 0.5e0-(whole-below) FROM due),
coverage AS (SELECT triangle, lab, sum(a)/432e0 AS weight FROM pieces WHERE a > 0 GROUP BY 1, 2 HAVING sum(a) > 1e-12),
cells AS (SELECT a.j, a.i, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, c.x AS xc, c.y AS yc, d.x AS xd, d.y AS yd
  FROM {{node}} a JOIN {{node}} b ON b.j = a.j AND b.i = a.i+1 JOIN {{node}} c ON c.j = a.j+1 AND c.i = a.i+1 JOIN {{node}} d ON d.j = a.j+1 AND d.i = a.i),
stretched AS (SELECT 2*(j*24+i) AS triangle, ((xb-xa)*(yc-ya)-(yb-ya)*(xc-xa))*432 AS s FROM cells UNION ALL SELECT 2*(j*24+i)+1, ((xc-xa)*(yd-ya)-(yc-ya)*(xd-xa))*432 FROM cells),
areas AS (SELECT CASE WHEN lab = 0 THEN 0 ELSE (lab-1)%5+1 END AS lab, sum(weight) AS area, sum(weight*s) AS mapped FROM coverage JOIN stretched USING (triangle) GROUP BY 1),
units AS (SELECT lab, CASE WHEN lab = 2 THEN NULL WHEN lab = 3 THEN 0e0 ELSE held END AS value, lab = 4 AS excluded
  FROM (SELECT (s.lab-1)%5+1 AS lab, cast(sum(v) AS double) AS held FROM {{sheet}} s JOIN {{cell}} k ON k.r = s.r AND k.c = s.c WHERE s.lab > 0 GROUP BY 1) h),
told AS (SELECT a.lab, area, value, excluded, coalesce(NOT excluded AND value IS NOT NULL, false) AS included FROM areas a LEFT JOIN units u ON u.lab = a.lab),
means AS (SELECT sum(value) FILTER (WHERE included) AS total, sum(value) FILTER (WHERE included)/sum(area) FILTER (WHERE included) AS mean FROM told),
dense AS (SELECT t.*, total, CASE WHEN NOT included THEN mean WHEN value = 0 THEN mean/100 ELSE value/area END AS density FROM told t, means),
ratios AS (SELECT *, density/sum(area*density) OVER () AS ratio FROM dense)"""

_SHIFTED = """WITH spots AS (SELECT city_id, lat, lon, (lon+180e0)/360e0 AS x, (sin(radians(lat))+1)/2e0 AS y FROM {city}),
bases AS (SELECT *, least(23, floor(x*24)) AS i0, least(11, floor(y*12)) AS j0 FROM spots),
four AS (SELECT b.*, k, CASE WHEN k%2 = 0 THEN 1-(x*24-i0) ELSE x*24-i0 END*CASE WHEN k < 2 THEN 1-(y*12-j0) ELSE y*12-j0 END AS w, s.dlon, s.ds, a.dlon AS base
  FROM bases b CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) q JOIN {shift} s ON s.j = j0+k//2 AND s.i = i0+k%2 JOIN {shift} a ON a.j = j0 AND a.i = i0),
moves AS (SELECT city_id, lat, lon, y, sum((base+((dlon-base+900e0)%360e0)-180e0)*w) AS dlon, sum(ds*w) AS ds FROM four GROUP BY 1, 2, 3, 4),
globe AS (SELECT *, degrees(asin(greatest(-1e0, least(1e0, 2*greatest(0e0, least(1e0, y+ds/2))-1)))) AS lat2 FROM moves),
arcs AS (SELECT *, CASE WHEN 0.7e0*sin(radians(lat))+0.3e0*sin(radians(lat2)) >= 0 THEN 1e0 ELSE -1e0 END AS side FROM globe),
away AS (SELECT *, 2*asin(least(1e0, sqrt(0.7e0*pow(sin((side*pi()/2-radians(lat))/2), 2)+0.3e0*pow(sin((side*pi()/2-radians(lat2))/2), 2)))) AS z FROM arcs)"""

_LIN = "CASE WHEN {0} <= 0.04045e0 THEN {0}/12.92e0 ELSE pow(({0}+0.055e0)/1.055e0, 2.4e0) END"
_CUBE = "CASE WHEN {0} > 0.008856e0 THEN cbrt({0}) ELSE 7.787e0*{0}+16/116e0 END"
_KINDS = " UNION ALL ".join(
    f"SELECT lab, lum, '{k}' AS kind, " + ", ".join("greatest(0e0, least(1e0, " + "+".join(f"({w}e0)*{c}" for w, c in zip(row, "rgb")) + f")) AS {n}" for n, row in zip("rgb", m)) + " FROM light" for k, m in colour.SIMULATIONS.items()
)
# simulated channels are encoded and made linear again
_ENC = "CASE WHEN {0} <= 0.0031308e0 THEN {0}*12.92e0 ELSE 1.055e0*pow({0}, 1/2.4e0)-0.055e0 END"
_COLOURS = f"""WITH raw AS (SELECT lab, red/255e0 AS r, green/255e0 AS g, blue/255e0 AS b FROM {{paint}}),
light AS (SELECT *, 0.2126e0*r+0.7152e0*g+0.0722e0*b AS lum FROM (SELECT lab, {', '.join(f'{_LIN.format(c)} AS {c}' for c in 'rgb')} FROM raw) l),
sim AS (SELECT lab, lum, kind, {', '.join(f'{_LIN.format(c)} AS {c}' for c in 'rgb')} FROM (SELECT lab, lum, kind, {', '.join(f'{_ENC.format(c)} AS {c}' for c in 'rgb')} FROM ({_KINDS}) s) e),
every_ AS (SELECT lab, lum, 'usual' AS kind, r, g, b FROM light UNION ALL SELECT * FROM sim),
xyz AS (SELECT *, (0.4124e0*r+0.3576e0*g+0.1805e0*b)/0.95047e0 AS x, 0.2126e0*r+0.7152e0*g+0.0722e0*b AS y, (0.0193e0*r+0.1192e0*g+0.9505e0*b)/1.08883e0 AS z FROM every_),
f AS (SELECT *, {_CUBE.format('x')} AS fx, {_CUBE.format('y')} AS fy, {_CUBE.format('z')} AS fz FROM xyz),
labs AS (SELECT lab, kind, lum, 116*fy-16 AS l, 500*(fx-fy) AS a, 200*(fy-fz) AS bb FROM f),
sides AS (SELECT DISTINCT least(a.lab, b.lab) AS la, greatest(a.lab, b.lab) AS lb FROM {{label}} a JOIN {{label}} b ON (b.r = a.r AND b.c = (a.c+1)%72 OR b.r = a.r+1 AND b.c = a.c) AND a.lab <> b.lab),
p0 AS (SELECT la, lb, x.kind, x.l AS l1, x.a AS a1, x.bb AS b1, y.l AS l2, y.a AS a2, y.bb AS b2, (greatest(x.lum, y.lum)+0.05e0)/(least(x.lum, y.lum)+0.05e0) AS contrast
  FROM sides JOIN labs x ON x.lab = la JOIN labs y ON y.lab = lb AND y.kind = x.kind),
p1 AS (SELECT *, pow((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2e0, 7) AS c7 FROM p0),
p2 AS (SELECT *, a1*(1+0.5e0*(1-sqrt(c7/(c7+pow(25e0, 7))))) AS u1, a2*(1+0.5e0*(1-sqrt(c7/(c7+pow(25e0, 7))))) AS u2 FROM p1),
p3 AS (SELECT *, sqrt(u1*u1+b1*b1) AS c1, sqrt(u2*u2+b2*b2) AS c2, (degrees(atan2(b1, u1))+360e0)%360e0 AS h1, (degrees(atan2(b2, u2))+360e0)%360e0 AS h2 FROM p2),
p4 AS (SELECT *, CASE WHEN c1*c2 = 0 THEN 0e0 WHEN h2-h1 > 180 THEN h2-h1-360 WHEN h2-h1 < -180 THEN h2-h1+360 ELSE h2-h1 END AS dh,
  CASE WHEN c1*c2 = 0 THEN h1+h2 WHEN abs(h1-h2) <= 180 THEN (h1+h2)/2 WHEN h1+h2 < 360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS h, (l1+l2)/2-50 AS lm, (c1+c2)/2 AS cm FROM p3),
p5 AS (SELECT *, 1-0.17e0*cos(radians(h-30))+0.24e0*cos(radians(2*h))+0.32e0*cos(radians(3*h+6))-0.2e0*cos(radians(4*h-63)) AS t FROM p4),
p6 AS (SELECT *, (l2-l1)/(1+0.015e0*lm*lm/sqrt(20+lm*lm)) AS el, (c2-c1)/(1+0.045e0*cm) AS ec, 2*sqrt(c1*c2)*sin(radians(dh/2))/(1+0.015e0*cm*t) AS eh,
  -2*sqrt(pow(cm, 7)/(pow(cm, 7)+pow(25e0, 7)))*sin(radians(60*exp(-pow((h-275)/25, 2)))) AS rt FROM p5),
apart AS (SELECT la, lb, kind, round(sqrt(greatest(0e0, el*el+ec*ec+eh*eh+rt*ec*eh)), 6) AS delta, round(contrast, 6) AS contrast FROM p6)"""


def _inside(name: str, edges: str) -> str:
    """Candidates that their polygon in ``edges`` holds, with their clearance there."""
    unit = lambda y, x, n: f"cos(radians({y}))*cos(radians({x})) AS {n}x, cos(radians({y}))*sin(radians({x})) AS {n}y, sin(radians({y})) AS {n}z"
    dot = lambda a, b: f"({a}x*{b}x+{a}y*{b}y+{a}z*{b}z)"
    acos = lambda v: f"acos(least(1e0, greatest(-1e0, {v})))"
    return f"""{name}_met AS (
  SELECT c.poly, level, CASE WHEN (e.lat <= c.lat) <> (e.lat2 <= c.lat) AND e.lon+(c.lat-e.lat)/nullif(e.lat2-e.lat, 0)*(e.lon2-e.lon) > w.west+(((c.lon-w.west)%360e0)+360e0)%360e0 THEN 1 ELSE 0 END AS hit,
         {unit('c.lat', 'c.lon', 'p')}, {unit('e.lat', 'e.lon', 'a')}, {unit('e.lat2', 'e.lon2', 'g')}
  FROM cands c JOIN {edges} e ON e.poly = c.poly JOIN (SELECT poly, min(lon) AS west FROM {edges} GROUP BY 1) w ON w.poly = c.poly),
{name}_n AS (SELECT *, ay*gz-az*gy AS nx, az*gx-ax*gz AS ny, ax*gy-ay*gx AS nz FROM {name}_met),
{name}_s AS (SELECT *, sqrt({dot('n', 'n')}) AS size, {dot('p', 'n')}/nullif(sqrt({dot('n', 'n')}), 0) AS s FROM {name}_n),
{name}_f AS (SELECT *, px-s*nx/size AS fx, py-s*ny/size AS fy, pz-s*nz/size AS fz, least({acos(dot('p', 'a'))}, {acos(dot('p', 'g'))}) AS ends FROM {name}_s),
{name} AS (SELECT poly, level, min(6371.0088e0*CASE WHEN {dot('f', 'a')} >= {dot('a', 'g')} AND {dot('f', 'g')} >= {dot('a', 'g')} AND {dot('f', 'a')}+{dot('f', 'g')} > 0 AND size > 1e-12
  THEN least(abs(asin(least(1e0, greatest(-1e0, s)))), ends) ELSE ends END) AS clear FROM {name}_f GROUP BY 1, 2 HAVING sum(hit)%2 = 1)"""


_ROUGH_EDGES = EDGES.replace("{ring}", "{rough}").replace("steps", "rough_steps").replace("laid", "rough_laid").replace("edges AS", "rough_edges AS")
_ANCHORS = f"""WITH {EDGES}, {_ROUGH_EDGES}, first AS ({LABELS}), second AS ({LABELS.replace('{ring}', '{rough}')}),
cands AS (SELECT poly, 0 AS level, lat, lon FROM first UNION ALL SELECT poly, 1, lat, lon FROM second WHERE poly IN (SELECT poly FROM {{ring}})),
{_inside('fine', 'edges')}, {_inside('coarse', 'rough_edges')},
viable AS (SELECT c.*, round(least(f.clear, coalesce(k.clear, f.clear)), 6) AS clearance_km FROM cands c JOIN fine f ON f.poly = c.poly AND f.level = c.level
  LEFT JOIN coarse k ON k.poly = c.poly AND k.level = c.level WHERE k.clear IS NOT NULL OR c.poly NOT IN (SELECT poly FROM {{rough}}))"""

ORACLES = {
    name: inline(sql)
    for name, sql in {
        "distance_field": _FIELD + " SELECT cast(r AS int) AS r, cast(c AS int) AS c, cast(lab AS int) AS lab, near FROM field",
        "label_samples": _FIELD
        + f""", places AS (SELECT city_id AS id, (90e0-lat)/180e0*60-0.5e0 AS fy, (((lon+180e0)%360e0)+360e0)%360e0/360e0*120-0.5e0 AS fx FROM {{city}}),
texels AS (SELECT s.id, s.k, w, lab, pad, near FROM (SELECT id, k, {_W} AS w, greatest(0, least(59, cast(floor(fy) AS int)+k//2)) AS r, (cast(floor(fx) AS int)+k%2+120)%120 AS c FROM places, {_TEXELS}) s
  JOIN field f ON f.r = s.r AND f.c = s.c), {_VOTE}
SELECT id AS city_id, cast(lab AS int) AS lab, pad, round(distance, 6) AS distance FROM won""",
        "patch_labels": f"""WITH single AS (SELECT city_id AS id, cast(cast(cast((lon+180e0)/360e0 AS float) AS double)*360e0 AS float)-cast(180 AS float) AS x, cast(90e0-cast(cast(cast((90e0-lat)/180e0 AS float) AS double)*180e0 AS float) AS float) AS y FROM {{city}}),
points AS (SELECT id, cast(x AS double) AS x, cast(y AS double) AS y FROM single),
boxes AS (SELECT *, cast(cast(west AS float) AS double) AS w, cast(cast(south AS float) AS double) AS s, cast(cast(east AS float) AS double) AS e, cast(cast(north AS float) AS double) AS n FROM {{patch}}),
turned AS (
  SELECT id, y, b.*, x+360e0*(CASE WHEN off > 180 THEN -ceil((off-180)/360e0) WHEN off < -180 THEN ceil((-180-off)/360e0) ELSE 0 END) AS x FROM (
    SELECT p.id, p.x, p.y, q.*, p.x-cast(cast(cast(cast(w+e AS float) AS double)*0.5e0 AS float) AS double) AS off FROM points p, boxes q) b),
edged AS (
  SELECT *, least(cast(cast(cast(x-w AS float) AS double)/(360e0/4096) AS float), cast(cast(cast(e-x AS float) AS double)/(360e0/4096) AS float),
                  cast(cast(cast(y-s AS float) AS double)/(180e0/2048) AS float), cast(cast(cast(n-y AS float) AS double)/(180e0/2048) AS float)) AS edge FROM turned WHERE x BETWEEN w AND e AND y BETWEEN s AND n),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY patch) AS o FROM edged WHERE edge >= 1) f WHERE o = 1),
spots AS (SELECT *, atlas_y+1+cast(cast(cast(cast(n-y AS float) AS double)/cast(cast(n-s AS float) AS double) AS float) AS double)*inner_height-0.5e0 AS fy,
  atlas_x+1+cast(cast(cast(cast(x-w AS float) AS double)/cast(cast(e-w AS float) AS double) AS float) AS double)*inner_width-0.5e0 AS fx FROM firsts),
texels AS (SELECT s.id, s.k, s.w, lab, pad, near FROM (
    SELECT id, k, {_W} AS w, greatest(atlas_y+1, least(atlas_y+inner_height, cast(floor(fy) AS int)+k//2)) AS ay, greatest(atlas_x+1, least(atlas_x+inner_width, cast(floor(fx) AS int)+k%2)) AS ax FROM spots, {_TEXELS}) s
  JOIN {{texel}} f ON f.ay = s.ay AND f.ax = s.ax), {_VOTE}
SELECT won.id AS city_id, patch, round(t*t*(3-2*t), 6) AS weight, lab, pad, round(distance, 4) AS distance FROM won JOIN (SELECT id, patch, least(1e0, cast(edge AS double)/2) AS t FROM firsts) g ON g.id = won.id""",
        "displacements": _SHIFTED + " SELECT city_id, round(dlon, 6) AS dlon, round(ds, 9) AS ds FROM moves",
        "map_to_globe": _SHIFTED
        + " SELECT city_id, round(degrees(side*pi()/2-side*z), 6) AS part_lat, round(((lon+dlon*0.3e0+900e0)%360e0)-180e0, 6) AS part_lon, round(lat2, 6) AS lat, round(((lon+dlon+900e0)%360e0)-180e0, 6) AS lon FROM away",
        "there_and_back": "SELECT city_id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM {city}",
        "neighbour_colours": _COLOURS + " SELECT la, lb, kind, delta, contrast FROM apart",
        "least_colours": _COLOURS + " SELECT kind, la, lb, delta FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY delta, la, lb) AS n FROM apart) a WHERE n = 1",
        "two_level_anchors": _ANCHORS + " SELECT poly, lat, lon, clearance_km FROM (SELECT *, row_number() OVER (PARTITION BY poly ORDER BY clearance_km DESC, lat, lon) AS n FROM viable) v WHERE n = 1 AND clearance_km > 0",
        "mesh_coverage": _COVERAGE + " SELECT triangle, cast(lab AS int) AS lab, round(weight, 12) AS weight FROM coverage",
        "mesh_diagnostics": _COVERAGE + " SELECT count(*) AS entries, count(DISTINCT lab) AS labels, round(sum(weight), 9) AS total, true AS sound FROM coverage",
        "mapped_areas": _COVERAGE + " SELECT cast(lab AS int) AS lab, round(area, 9) AS area, round(mapped, 9) AS mapped FROM areas",
        "coverage_densities": _COVERAGE
        + " SELECT cast(lab AS int) AS lab, value, excluded, round(area, 6) AS area, round(CASE WHEN included THEN value/total END, 6) AS share, round(area*ratio, 6) AS target, round(ratio, 6) AS ratio, round(density, 3) AS density FROM ratios",
        "mesh_densities": _COVERAGE
        + " SELECT cell//24 AS y, cell%24 AS x, round(density, 6) AS density FROM (SELECT triangle//2 AS cell, sum(weight*ratio)*432 AS density FROM coverage c JOIN ratios r ON r.lab = CASE WHEN c.lab = 0 THEN 0 ELSE (c.lab-1)%5+1 END GROUP BY 1) d",
    }.items()
}
