"""Queries over borders, polygons, names and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import geo, scalars, text
from meridia.operators import graph, names, polygon, search, stats
from meridia.plans.views import HEIGHT, WIDTH, frame, inline


# ---- borders


def _starts(spark, d):
    return frame(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("start"))


def border_reach(spark, d):
    """Least crossings between all pairs of countries; 3 and 7 are joined by a fixed link."""
    return graph.crossings(frame(spark, d, "linked"), _starts(spark, d)).drop("free")


def border_summary(spark, d):
    return graph.reach_summary(border_reach(spark, d))


def border_farthest(spark, d):
    return graph.farthest(border_reach(spark, d))


def border_top_degree(spark, d):
    return graph.most_connected(frame(spark, d, "border"), 5)


def border_route(spark, d):
    """A route from 0 to 13, its runs of one region merged."""
    path = graph.route(frame(spark, d, "linked"), 0, 13)
    regions = frame(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("country"))
    return graph.merge_runs(path.join(regions, "node").select("step", "country"))


def border_components(spark, d):
    nodes = frame(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return graph.components(nodes, frame(spark, d, "border"))


def border_asymmetry(spark, d):
    return graph.symmetric_violations(frame(spark, d, "border").unionByName(spark.createDataFrame([(1, 24, 1)], "a long, b long, cost int"))).select("a", "b")


def border_crossing_bands(spark, d):
    return border_reach(spark, d).groupBy(scalars.crossing_band(F.col("crossings")).alias("band")).agg(F.count("*").alias("pairs"))


def shared_arcs(spark, d):
    """Suppliers as parts, the parts they ship to as arcs."""
    lines = frame(spark, d, "lineitem").select(F.col("l_suppkey").alias("part"), F.col("l_partkey").alias("arc"))
    uses = lines.withColumn("country", F.col("part") % 25)
    pairs = lambda v: spark.createDataFrame(v, "a long, b long")
    return graph.arc_borders(uses, pairs([(1, 2)]), pairs([(2, 27), (27, 2)]))


def open_borders(spark, d):
    edges = frame(spark, d, "border").select("a", "b", (F.col("a") % 6).alias("country_a"), (F.col("b") % 6).alias("country_b"))
    return graph.open_pairs(edges, spark.createDataFrame([("x", [1, 2, 3]), ("y", [2, 4])], "rule string, countries array<long>"))


# ---- polygons


def _rings(spark, d):
    return frame(spark, d, "ring")


def ring_areas(spark, d):
    return polygon.ring_areas(_rings(spark, d).drop("country")).withColumn("area_km2", F.round("area_km2", 3))


def polygon_inflation(spark, d):
    return polygon.mercator_inflation(_rings(spark, d).drop("country"))


def polygon_rotated(spark, d):
    return polygon.rotate(_rings(spark, d), 65.0, 20.0, 5.0, -60.0).select("poly", "ring", "ix", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def polygon_rotated_areas(spark, d):
    return polygon.polygon_areas(polygon.rotate(_rings(spark, d), 65.0, 20.0, 5.0, -60.0)).withColumn("area_km2", F.round("area_km2", 2))


def polygon_anchors(spark, d):
    return polygon.anchors(_rings(spark, d))


def polygon_densified(spark, d):
    return polygon.densify(_rings(spark, d).drop("country"), 2.5)


def points_in_polygons(spark, d):
    return polygon.point_in_polygon(frame(spark, d, "site"), _rings(spark, d).drop("country"), "point_id").select("point_id", "poly")


def polygon_cells(spark, d):
    return polygon.rasterize(_rings(spark, d).drop("country"), HEIGHT, WIDTH)


def polygon_parts(spark, d):
    return polygon.ranked_parts(_rings(spark, d)).select("country", "poly", "part")


def polygon_label_anchors(spark, d):
    return polygon.label_anchor(_rings(spark, d).drop("country"))


def polygon_crossings(spark, d):
    return polygon.self_intersections(_rings(spark, d).drop("country"))


def circle_outline(spark, d):
    points = frame(spark, d, "site").select("point_id", F.explode(geo.circle_points("lat", "lon", 750.0, 6)).alias("p"))
    return points.select("point_id", "p.step", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def mollweide_points(spark, d):
    p = geo.mollweide_inverse(F.col("p_partkey") * 3571.0 % 9_000_000.0, F.col("p_size") * 100_000.0)
    return frame(spark, d, "part").select("p_partkey", F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon"))


# ---- names


def _searchable(spark, d):
    return frame(spark, d, "part").select(F.col("p_partkey").alias("city_id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"), F.col("p_type").alias("place"), (F.col("p_size") % 5).alias("feature_rank"), (F.col("p_partkey") * 7919 % 10_007).alias("population"))


def city_search_top6(spark, d):
    return search.search(_searchable(spark, d), " BRAND#1 ")


def name_groups(spark, d):
    return search.name_groups(frame(spark, d, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 7).alias("country_id")))


def localized_names(spark, d):
    lang = F.element_at(F.array(*map(F.lit, ("en", "en-GB", "fr", "en-US"))), (F.col("ord") % 4 + 1).cast("int"))
    return search.localized_names(frame(spark, d, "mark").select(F.col("country_id").alias("id"), F.col("ord").alias("name_id"), lang.alias("lang"), F.col("form").alias("name"), (F.col("size") % 9 == 0).alias("preferred")))


def alias_selection(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("canonical", "ascii", "en", "zh"))), (F.col("size") % 4 + 1).cast("int"))
    return search.select_aliases(frame(spark, d, "mark").select(F.concat_ws("|", F.col("country_id").cast("string"), "name_group").alias("id"), F.col("form").alias("name"), kind.alias("kind"), "ord"))


def name_matches(spark, d):
    cities = frame(spark, d, "city").select("city_id", F.concat(F.lit("place "), F.col("city_id") % 50).alias("name"), "lat", "lon")
    cands = frame(spark, d, "site").select(F.col("point_id").alias("cand_id"), F.concat(F.lit("Place-"), F.col("point_id") % 50).alias("cand_name"), (F.col("lat") * 0.9).alias("cand_lat"), F.col("lon").alias("cand_lon"), (F.col("point_id") * 77 % 1000).alias("cand_population"))
    return search.match_names(cities, cands, spark.createDataFrame([(7, 1), (8, 2)], "city_id long, override long"))


def _records(spark, d):
    return frame(spark, d, "mark").select("country_id", "name_group", F.when(F.col("size") < 40, F.col("size")).alias("rank"), F.when(F.col("size") % 3 == 0, F.col("form")).alias("local"), F.col("name_group").alias("latin"), F.when(F.col("size") % 2 == 0, F.col("size") * 10).alias("count"), F.lit(None).cast("double").alias("share"), "ord")


def surname_groups(spark, d):
    return names.group_records(_records(spark, d)).select("country_id", "name_group", "rank", F.array_join("locals", "|").alias("locals"), F.array_join("latins", "|").alias("latins"), "count")


def surname_rank_one(spark, d):
    return names.rank_one_or_unranked(_records(spark, d)).select("country_id", "name_group", "rank", "ord")


def _tagged(spark, d):
    r = _records(spark, d).select("country_id", "name_group", "rank")
    part = lambda k: r.filter(F.col("country_id") % 4 == k)
    return names.with_precedence({"base": part(1), "supplement": part(2), "list": r.filter("country_id % 3 = 0"), "manual": r.filter("country_id % 5 = 0")})


def source_precedence(spark, d):
    return _tagged(spark, d).groupBy("country_id", "source").agg(F.count("*").alias("records"))


def surname_coverage(spark, d):
    units = frame(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("country_id"))
    return names.coverage_status(units, _tagged(spark, d))


def surname_units(spark, d):
    units = frame(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("country_id"), F.col("n_regionkey").alias("iso"), F.col("n_nationkey").alias("ord"))
    return names.sovereign_units(units, _records(spark, d))


def display_forms(spark, d):
    r = _records(spark, d)
    form = names.display_form(F.col("local"), F.col("latin"), F.lit(""), "local")
    return r.select("ord", form["form"].alias("form"), form["fell_back"].alias("fell_back"), text.script_of(F.col("latin")).alias("script"))


# ---- measurements


def error_percentiles(spark, d):
    o = frame(spark, d, "orders")
    units = o.select((F.col("o_totalprice") + F.col("o_custkey")).alias("actual"), F.col("o_totalprice").alias("target"), F.lit(1.0).alias("share"))
    return stats.area_errors(units).select("n", *(F.round(c, 9).alias(c) for c in ("p50", "p90", "worst")))


def largest_errors(spark, d):
    o = frame(spark, d, "orders")
    return stats.largest_errors(o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + F.col("o_custkey")).alias("actual"), F.col("o_totalprice").alias("target")))


def frame_stats(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return stats.frame_stats(frame(spark, d, "events").select("user_id", at.alias("at")).distinct(), "user_id", "at", 20_000)


def metric_top10(spark, d):
    by = frame(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.floor("o_totalprice")).cast("long").alias("value"))
    return stats.top_with_selected(by, "id", "value", 1)


def area_ratio_bands(spark, d):
    ratio = F.col("l_extendedprice") / (F.col("l_quantity") * 1000)
    return frame(spark, d, "lineitem").groupBy(scalars.ratio_band(F.round(ratio, 4)).alias("band")).agg(F.count("*").alias("n"))


def parameters(spark, d):
    p = frame(spark, d, "part")
    return p.select("p_partkey", scalars.clamp_alpha(F.col("p_size") / 37.0).alias("alpha"), scalars.parse_radius(F.col("p_partkey").cast("string")).alias("radius"), scalars.round_radius(F.col("p_partkey") * 1.7).alias("rounded"), scalars.radius_to_slider(F.col("p_partkey") * 1.7).alias("slider"), scalars.slider_to_radius(F.col("p_partkey") / 2.0).alias("slid"), scalars.parse_reach_level((F.col("p_size") / 2).cast("string")).alias("level"), F.round(scalars.layer_alpha(F.array(F.col("p_size") / 100, F.lit(0.5))), 6).alias("alpha_sum"))


def stop_rounds(spark, d):
    """Each type's mean event value of a day as the errors of a round of its optimisation."""
    mean = F.sum(F.floor("value")).cast("double") / F.count("*")
    days = frame(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.dayofyear("ts").alias("round")).agg((mean / 1000).alias("p50"), (mean / 400).alias("p90"))
    return stats.stop_reasons(days)


def owner_violations(spark, d):
    cities = frame(spark, d, "city").select("city_id", "population")
    from pyspark.sql import Window

    rows = cities.withColumn("owner", F.row_number().over(Window.orderBy("city_id"))).select("owner", "city_id", "population", F.when(F.col("city_id") % 5 == 0, "root").otherwise("ok").alias("status"), F.when(F.col("city_id") % 7 != 0, F.lit(1.5)).alias("threshold"), F.when(F.col("city_id") % 5 != 0, F.col("city_id") + 1).alias("parent"))
    return stats.city_asset_violations(rows)


QUERIES = {f.__name__: f for f in (border_reach, border_summary, border_farthest, border_top_degree, border_route, border_components, border_asymmetry, border_crossing_bands, shared_arcs, open_borders, ring_areas, polygon_inflation, polygon_rotated, polygon_rotated_areas, polygon_anchors, polygon_densified, points_in_polygons, polygon_cells, polygon_parts, polygon_label_anchors, polygon_crossings, circle_outline, mollweide_points, city_search_top6, name_groups, localized_names, alias_selection, name_matches, surname_groups, surname_rank_one, source_precedence, surname_coverage, surname_units, display_forms, error_percentiles, largest_errors, frame_stats, metric_top10, area_ratio_bands, parameters, stop_rounds, owner_violations)}

# Walks of up to 9 crossings; the fixed link joins its two ends, so it is one node here.
_REACH = """WITH RECURSIVE ends AS (SELECT DISTINCT CASE WHEN a=7 THEN 3 ELSE a END AS a, CASE WHEN b=7 THEN 3 ELSE b END AS b FROM {border}),
walk AS (SELECT cast(n_nationkey AS bigint) AS start, cast(CASE WHEN n_nationkey=7 THEN 3 ELSE n_nationkey END AS bigint) AS node, 0 AS crossings FROM {nation}
  UNION SELECT start, b, crossings+1 FROM walk JOIN ends ON node = a WHERE crossings < 9 AND a <> b),
merged AS (SELECT start, node, min(crossings) AS crossings FROM walk GROUP BY 1, 2),
reach AS (SELECT * FROM merged UNION ALL SELECT start, 7, crossings FROM merged WHERE node = 3)"""
# longitudes go on from vertex to vertex; a polygon's rings are on the turn of its first vertex
EDGES = """steps AS (SELECT *, CASE WHEN lon-before > 180 THEN -1 WHEN lon-before < -180 THEN 1 ELSE 0 END AS turn FROM (
    SELECT *, lag(lon) OVER (PARTITION BY poly, ring ORDER BY ix) AS before, first_value(lon) OVER (PARTITION BY poly, ring ORDER BY ix) AS own,
           first_value(lon) OVER (PARTITION BY poly ORDER BY ring, ix) AS start FROM {ring}) v),
laid AS (SELECT country, poly, ring, ix, lat, lon AS home, lon+360e0*(sum(turn) OVER (PARTITION BY poly, ring ORDER BY ix ROWS UNBOUNDED PRECEDING)+floor((start-own)/360e0+0.5e0)) AS lon FROM steps),
edges AS (SELECT * FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM laid WINDOW w AS (PARTITION BY poly, ring ORDER BY ix)) e WHERE lat2 IS NOT NULL)"""
_AREAS = f"WITH {EDGES}, areas AS (SELECT poly, ring, least(abs(x), 4e0*pi()-abs(x))*6371.0088e0*6371.0088e0 AS area_km2 FROM (SELECT poly, ring, sum(2e0*atan2(tan(radians(lon2-lon)/2e0)*(tan(radians(lat)/2e0)+tan(radians(lat2)/2e0)), 1+tan(radians(lat)/2e0)*tan(radians(lat2)/2e0))) AS x FROM edges GROUP BY 1, 2)), polys AS (SELECT poly, round(sum(CASE WHEN ring=0 THEN area_km2 ELSE -area_km2 END), 6) AS area_km2 FROM areas GROUP BY 1)"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_REC = "recs AS (SELECT country_id, name_group, CASE WHEN size < 40 THEN size END AS rank, CASE WHEN size%3=0 THEN form END AS local, name_group AS latin, CASE WHEN size%2=0 THEN size*10 END AS cnt, ord FROM {mark})"
_TAG = f"WITH {_REC}, tagged AS (SELECT country_id, name_group, rank, 'base' AS source, 0 AS p FROM recs WHERE country_id%4=1 UNION ALL SELECT country_id, name_group, rank, 'supplement', 0 FROM recs WHERE country_id%4=2 UNION ALL SELECT country_id, name_group, rank, 'list', 2 FROM recs WHERE country_id%3=0 UNION ALL SELECT country_id, name_group, rank, 'manual', 3 FROM recs WHERE country_id%5=0), best AS (SELECT * FROM (SELECT *, min(p) OVER (PARTITION BY country_id) AS m FROM tagged) WHERE p = m)"

_TURNED = """turned AS (SELECT country, poly, ring, ix, degrees(asin(least(1e0, greatest(-1e0, x*sin(q)+z*cos(q))))) AS lat, ((degrees(atan2(y, x*cos(q)-z*sin(q)))-60e0+540e0)%360e0)-180e0 AS lon
  FROM (SELECT *, cos(radians(lat))*cos(radians(lon-20e0)) AS x, cos(radians(lat))*sin(radians(lon-20e0)) AS y, sin(radians(lat)) AS z, radians(-60e0) AS q FROM {ring}))"""
_LARGEST = "largest AS (SELECT country, poly FROM (SELECT country, poly, row_number() OVER (PARTITION BY country ORDER BY area_km2 DESC, poly) AS n FROM polys JOIN (SELECT DISTINCT poly, country FROM {ring}) USING (poly)) WHERE n = 1)"
_ANCHORS = f"""{_AREAS}, {_LARGEST}, means AS (SELECT l.country, avg(cos(radians(lat))*cos(radians(lon))) AS x, avg(cos(radians(lat))*sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z
  FROM edges e JOIN largest l ON e.poly = l.poly WHERE ring = 0 GROUP BY 1)
SELECT country, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM means"""
_DENSE = f"""WITH {EDGES}, arcs AS (SELECT *, 2e0*asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(lat2-lat)/2e0), 2)+cos(radians(lat))*cos(radians(lat2))*pow(sin(radians(lon2-lon)/2e0), 2))))) AS om FROM edges),
cuts AS (SELECT *, cast(greatest(1, ceil(round(degrees(om)/2.5e0, 9))) AS int) AS n FROM arcs), parts AS (SELECT *, unnest(range(n)) AS k FROM cuts),
w AS (SELECT *, sin((1-k/cast(n AS double))*om)/sin(om) AS wa, sin(k/cast(n AS double)*om)/sin(om) AS wb FROM parts),
v AS (SELECT *, wa*cos(radians(lat))*cos(radians(lon))+wb*cos(radians(lat2))*cos(radians(lon2)) AS x, wa*cos(radians(lat))*sin(radians(lon))+wb*cos(radians(lat2))*sin(radians(lon2)) AS y, wa*sin(radians(lat))+wb*sin(radians(lat2)) AS z FROM w)
SELECT poly, ring, ix, cast(k AS int) AS k, round(CASE WHEN k=0 THEN lat ELSE degrees(atan2(z, sqrt(x*x+y*y))) END, 6) AS lat, round(CASE WHEN k=0 THEN home ELSE degrees(atan2(y, x)) END, 6) AS lon FROM v"""
_DOT = "({0}x*{1}x+{0}y*{1}y+{0}z*{1}z)"
_ACOS = "acos(least(1e0, greatest(-1e0, {0})))"
LABELS = f"""WITH {EDGES}, box AS (SELECT poly, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, avg(lat) AS mlat, avg(lon) AS mlon FROM edges GROUP BY 1),
cands AS (SELECT poly, 0 AS cand, mlat AS y, mlon AS x FROM box UNION ALL SELECT poly, 1+i*13+j, s+(i+0.5e0)/13*(n-s), w+(j+0.5e0)/13*(e-w) FROM box, (SELECT unnest(range(13)) AS i) a, (SELECT unnest(range(13)) AS j) b),
met AS (SELECT c.poly, cand, y, x, CASE WHEN (lat <= y) <> (lat2 <= y) AND lon+(y-lat)/nullif(lat2-lat, 0)*(lon2-lon) > x THEN 1 ELSE 0 END AS hit,
  cos(radians(y))*cos(radians(x)) AS px, cos(radians(y))*sin(radians(x)) AS py, sin(radians(y)) AS pz, cos(radians(lat))*cos(radians(lon)) AS ax, cos(radians(lat))*sin(radians(lon)) AS ay, sin(radians(lat)) AS az,
  cos(radians(lat2))*cos(radians(lon2)) AS gx, cos(radians(lat2))*sin(radians(lon2)) AS gy, sin(radians(lat2)) AS gz FROM cands c JOIN edges e ON c.poly = e.poly),
nrm AS (SELECT *, ay*gz-az*gy AS nx, az*gx-ax*gz AS ny, ax*gy-ay*gx AS nz FROM met),
sized AS (SELECT *, sqrt({_DOT.format('n', 'n')}) AS size, {_DOT.format('p', 'n')}/nullif(sqrt({_DOT.format('n', 'n')}), 0) AS s FROM nrm),
feet AS (SELECT *, px-s*nx/size AS fx, py-s*ny/size AS fy, pz-s*nz/size AS fz, least({_ACOS.format(_DOT.format('p', 'a'))}, {_ACOS.format(_DOT.format('p', 'g'))}) AS ends FROM sized),
judged AS (SELECT poly, cand, y, x, sum(hit) AS n, min(6371.0088e0*CASE WHEN {_DOT.format('f', 'a')} >= {_DOT.format('a', 'g')} AND {_DOT.format('f', 'g')} >= {_DOT.format('a', 'g')} AND {_DOT.format('f', 'a')}+{_DOT.format('f', 'g')} > 0 AND size > 1e-12
  THEN least(abs(asin(least(1e0, greatest(-1e0, s)))), ends) ELSE ends END) AS clear FROM feet GROUP BY 1, 2, 3, 4 HAVING sum(hit)%2 = 1)
SELECT poly, round(y, 6) AS lat, round(((x+900e0)%360e0)-180e0, 6) AS lon, round(clear, 6) AS clearance_km FROM (SELECT *, row_number() OVER (PARTITION BY poly ORDER BY round(clear, 6) DESC, cand) AS k FROM judged) WHERE k = 1"""
_CLEARANCE = (
    LABELS.split("box AS")[0] + "west AS (SELECT poly, min(least(lon, lon2)) AS west FROM edges GROUP BY 1), turned AS (SELECT point_id, lat AS y, lon AS x, w.poly, west + (((lon-west)%360e0)+360e0)%360e0 AS t FROM {site}, west w), "
    + "met AS (SELECT c.poly, point_id AS cand, y, x, CASE WHEN (lat <= y) <> (lat2 <= y) AND lon+(y-lat)/nullif(lat2-lat, 0)*(lon2-lon) > t THEN 1 ELSE 0 END AS hit," + LABELS.split("THEN 1 ELSE 0 END AS hit,")[1].split("FROM cands c JOIN")[0]
    + "FROM turned c JOIN" + LABELS.split("FROM cands c JOIN")[1].split("SELECT poly, round(y, 6)")[0] + " SELECT point_id, round(coalesce(max(clear), 0e0), 6) AS clearance_km FROM {site} LEFT JOIN judged ON cand = point_id GROUP BY 1"
)
_SIDE = "(({0}.lon2-{0}.lon)*({1}-{0}.lat)-({0}.lat2-{0}.lat)*({2}-{0}.lon))"
_CROSS = f"""WITH {EDGES}, found AS (SELECT a.poly, count(*) AS n FROM edges a JOIN edges b ON a.poly = b.poly AND a.ring = b.ring AND a.ix < b.ix
  WHERE {_SIDE.format('a', 'b.lat', 'b.lon')}*{_SIDE.format('a', 'b.lat2', 'b.lon2')} < 0 AND {_SIDE.format('b', 'a.lat', 'a.lon')}*{_SIDE.format('b', 'a.lat2', 'a.lon2')} < 0 GROUP BY 1)
SELECT p.poly, coalesce(n, 0) AS crossings FROM (SELECT DISTINCT poly FROM {{ring}}) p LEFT JOIN found USING (poly)"""
_OUTLINE = """WITH pts AS (SELECT point_id, radians(lat) AS la, radians(lon) AS lo, 750e0/6371.0088e0 AS d, unnest(range(7)) AS step FROM {site}),
b AS (SELECT *, (step%6)*(2*pi()/6) AS w FROM pts), s AS (SELECT *, sin(la)*cos(d)+cos(la)*sin(d)*cos(w) AS sl FROM b)
SELECT point_id, cast(step AS int) AS step, round(degrees(asin(least(1e0, greatest(-1e0, sl)))), 6) AS lat, round(((degrees(lo+atan2(sin(w)*sin(d)*cos(la), cos(d)-sin(la)*sl))+180e0+720e0)%360e0)-180e0, 6) AS lon FROM s"""
_ROUTE = _REACH + """,
ours AS (SELECT node, crossings FROM reach WHERE start = 0),
prior AS (SELECT node, up FROM (SELECT e.b AS node, e.a AS up, row_number() OVER (PARTITION BY e.b ORDER BY x.crossings, e.a) AS n
  FROM {linked} e JOIN ours x ON e.a = x.node JOIN ours y ON e.b = y.node WHERE x.crossings + e.cost = y.crossings AND (e.cost = 1 OR NOT EXISTS (SELECT 1 FROM {border} f JOIN ours z ON f.a = z.node WHERE f.b = e.b AND z.crossings + 1 = y.crossings))) WHERE n = 1),
back AS (SELECT cast(13 AS bigint) AS node, 0 AS back FROM ours WHERE node = 13 UNION ALL SELECT up, back+1 FROM back JOIN prior USING (node) WHERE back < 60),
path AS (SELECT max(back) OVER () - back AS step, n_regionkey AS country FROM back JOIN {nation} ON n_nationkey = node)
SELECT country, cast(min(step) AS int) AS first, cast(max(step) AS int) AS last FROM (SELECT *, row_number() OVER (ORDER BY step) - row_number() OVER (PARTITION BY country ORDER BY step) AS island FROM path) GROUP BY country, island"""
_HAV = "round(2e0*6371.0088e0*asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(cl-lat)/2e0),2)+cos(radians(lat))*cos(radians(cl))*pow(sin(radians(co-lon)/2e0),2))))), 6)"
_MATCHES = f"""WITH c AS (SELECT city_id, 'place ' || city_id%50 AS form, lat, lon FROM {{city}}), k AS (SELECT point_id AS cand_id, 'place ' || point_id%50 AS cform, lat*0.9e0 AS cl, lon AS co, point_id*77%1000 AS pop FROM {{site}}),
met AS (SELECT city_id, cand_id, form = cform AS same, pop, {_HAV} AS d FROM c, k),
named AS (SELECT city_id, cand_id AS exact FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY d, pop DESC, cand_id) AS n FROM met WHERE same AND d <= 50) WHERE n = 1),
near AS (SELECT city_id, cand_id AS near FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY pop DESC, d, cand_id) AS n FROM met WHERE d <= 30) WHERE n = 1)
SELECT city_id, coalesce(o, exact, near) AS match, CASE WHEN o IS NOT NULL THEN 'override' WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'review' ELSE 'none' END AS kind
FROM c LEFT JOIN (VALUES (7, 1), (8, 2)) AS v(i, o) ON i = city_id LEFT JOIN named USING (city_id) LEFT JOIN near USING (city_id)"""
_STOPS = """WITH days AS (SELECT event_type AS metric, cast(dayofyear(ts) AS int) AS round, cast(sum(floor(value)) AS double)/count(*)/1000e0 AS p50, cast(sum(floor(value)) AS double)/count(*)/400e0 AS p90 FROM {events} GROUP BY 1, 2),
l AS (SELECT *, lag(p90) OVER w AS b1, lag(p90, 2) OVER w AS b2, lag(p90, 3) OVER w AS b3 FROM days WINDOW w AS (PARTITION BY metric ORDER BY round))
SELECT metric, round, CASE WHEN p50 < 0.05 AND p90 < 0.15 THEN 'raw-pass' WHEN b1-p90 < 0.005 AND b2-b1 < 0.005 AND b3-b2 < 0.005 THEN 'plateau' WHEN round >= 16 THEN 'max-rounds' END AS reason FROM l"""

ORACLES = {
    k: inline(v)
    for k, v in {
        "border_reach": _REACH + " SELECT * FROM reach",
        "border_summary": _REACH + " SELECT start, count(*) FILTER (WHERE node <> start) AS reached, count(*) FILTER (WHERE crossings = 1) AS neighbours, max(CASE WHEN crossings > 0 THEN crossings END) AS most FROM reach GROUP BY 1",
        "border_farthest": _REACH + " SELECT start, node, crossings FROM (SELECT *, max(crossings) OVER (PARTITION BY start) AS most FROM reach) WHERE crossings = most AND crossings > 0",
        "border_top_degree": "SELECT a AS node, count(DISTINCT b) AS degree FROM {border} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "border_components": "WITH RECURSIVE walk AS (SELECT cast(n_nationkey AS bigint) AS node, cast(n_nationkey AS bigint) AS other FROM {nation} UNION SELECT node, b FROM walk JOIN {border} ON other = a) SELECT node, min(other) AS component FROM walk GROUP BY 1",
        "border_asymmetry": "WITH e AS (SELECT a, b FROM {border} UNION ALL SELECT cast(1 AS bigint), cast(24 AS bigint)) SELECT a, b FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.a = x.b AND y.b = x.a)",
        "border_crossing_bands": _REACH + " SELECT CASE WHEN crossings < 1 THEN NULL WHEN crossings <= 2 THEN crossings WHEN crossings <= 4 THEN 3 WHEN crossings <= 6 THEN 4 WHEN crossings <= 9 THEN 5 ELSE 6 END AS band, count(*) AS pairs FROM reach GROUP BY 1",
        "shared_arcs": "WITH arcs AS (SELECT DISTINCT l_suppkey AS part, l_partkey AS arc, l_suppkey%25 AS country FROM {lineitem}) SELECT DISTINCT x.part AS a, y.part AS b FROM arcs x JOIN arcs y ON x.arc = y.arc AND x.country <> y.country WHERE NOT (x.part = 1 AND y.part = 2) UNION SELECT 2, 27 UNION SELECT 27, 2",
        "open_borders": "SELECT a, b, a%6 AS country_a, b%6 AS country_b FROM {border} WHERE a%6 = b%6 OR a%6 = 0 OR b%6 = 0 OR (a%6 IN (1,2,3) AND b%6 IN (1,2,3)) OR (a%6 IN (2,4) AND b%6 IN (2,4))",
        "ring_areas": _AREAS + " SELECT poly, ring, round(area_km2, 3) AS area_km2 FROM areas",
        "polygon_inflation": _AREAS + ", flat AS (SELECT poly, sum(CASE WHEN ring=0 THEN f ELSE -f END) AS flat FROM (SELECT poly, ring, abs(sum(radians(lon2-lon)*(ln(tan(pi()/4e0+radians(greatest(-85.05e0, least(85.05e0, lat)))/2e0))+ln(tan(pi()/4e0+radians(greatest(-85.05e0, least(85.05e0, lat2)))/2e0)))/2e0))*6371.0088e0*6371.0088e0 AS f FROM edges GROUP BY 1, 2) GROUP BY 1) SELECT poly, round(flat/area_km2, 6) AS inflation FROM flat JOIN polys USING (poly)",
        "polygon_rotated": "WITH t AS (SELECT *, cos(radians(lat))*cos(radians(lon-20e0)) AS x, cos(radians(lat))*sin(radians(lon-20e0)) AS y, sin(radians(lat)) AS z, radians(-60e0) AS q FROM {ring}) SELECT poly, ring, ix, round(degrees(asin(least(1e0, greatest(-1e0, x*sin(q)+z*cos(q))))), 6) AS lat, round(((degrees(atan2(y, x*cos(q)-z*sin(q)))-60e0+540e0)%360e0)-180e0, 6) AS lon FROM t",
        "polygon_rotated_areas": f"WITH {_TURNED}, " + _AREAS.replace("{ring}", "turned").removeprefix("WITH ") + " SELECT poly, round(area_km2, 2) AS area_km2 FROM polys",
        "polygon_anchors": _ANCHORS,
        "polygon_densified": _DENSE,
        "polygon_label_anchors": LABELS,
        "polygon_crossings": _CROSS,
        "circle_outline": _OUTLINE,
        "border_route": _ROUTE,
        "name_matches": _MATCHES,
        "stop_rounds": _STOPS,
        "polygon_parts": _AREAS + " SELECT country, poly, row_number() OVER (PARTITION BY country ORDER BY area_km2 DESC, poly)-1 AS part FROM polys JOIN (SELECT DISTINCT poly, country FROM {ring}) USING (poly)",
        "points_in_polygons": f"WITH {EDGES}, west AS (SELECT poly, min(least(lon, lon2)) AS west FROM edges GROUP BY 1), p AS (SELECT point_id, lat AS y, w.poly, west + (((lon-west)%360e0)+360e0)%360e0 AS x FROM {{site}}, west w), hit AS (SELECT point_id, p.poly, count(*) AS n FROM p JOIN edges e ON p.poly = e.poly AND (e.lat <= y) <> (e.lat2 <= y) AND e.lon + (y-e.lat)/nullif(e.lat2-e.lat, 0)*(e.lon2-e.lon) > x GROUP BY 1, 2) SELECT point_id, h.poly FROM {{site}} LEFT JOIN (SELECT point_id, min(poly) AS poly FROM hit WHERE n%2=1 GROUP BY 1) h USING (point_id)",
        "polygon_cells": f"WITH {EDGES}, cells AS (SELECT r, c, 90e0-(r+0.5e0)*5e0 AS y, (c+0.5e0)*5e0-180e0 AS x FROM (SELECT unnest(range(36)) AS r) a, (SELECT unnest(range(72)) AS c) b), west AS (SELECT poly, min(least(lon, lon2)) AS west FROM edges GROUP BY 1), p AS (SELECT r, c, y, w.poly, west + (((x-west)%360e0)+360e0)%360e0 AS x FROM cells, west w) SELECT poly, cast(r AS int) AS r, cast(c AS int) AS c FROM (SELECT p.poly, r, c, count(*) AS n FROM p JOIN edges e ON p.poly = e.poly AND (e.lat <= y) <> (e.lat2 <= y) AND e.lon + (y-e.lat)/nullif(e.lat2-e.lat, 0)*(e.lon2-e.lon) > x GROUP BY 1, 2, 3) WHERE n%2=1",
        "mollweide_points": "SELECT p_partkey, round(degrees(asin(least(1e0, greatest(-1e0, (2*t+sin(2*t))/pi())))), 6) AS lat, round(degrees(pi()*x/(2*6378137e0*sqrt(2e0)*cos(t))), 6) AS lon FROM (SELECT p_partkey, (p_partkey*3571e0)%9000000e0 AS x, asin(least(1e0, greatest(-1e0, p_size*100000e0/(6378137e0*sqrt(2e0))))) AS t FROM {part})",
        "city_search_top6": f"WITH n AS (SELECT p_partkey AS city_id, p_name AS name, {_NORM.format('p_name')} AS nn, {_NORM.format('p_brand')} AS a1, {_NORM.format('p_type')} AS a2, p_size%5 AS feature_rank, p_partkey*7919%10007 AS population FROM {{part}}), s AS (SELECT *, CASE WHEN nn='brand 1' THEN 0 WHEN a1='brand 1' OR a2='brand 1' THEN 1 WHEN starts_with(nn, 'brand 1') THEN 2 WHEN starts_with(a1, 'brand 1') OR starts_with(a2, 'brand 1') THEN 3 WHEN contains(nn, ' brand 1') OR contains(a1, ' brand 1') OR contains(a2, ' brand 1') THEN 4 WHEN contains(nn, 'brand 1') OR contains(a1, 'brand 1') OR contains(a2, 'brand 1') THEN 5 END AS score FROM n) SELECT city_id, name, score, population FROM s WHERE score IS NOT NULL ORDER BY score, feature_rank, population DESC, name, city_id LIMIT 6",
        "name_groups": f"SELECT {_NORM.format('p_brand')} AS form, count(*) AS cities, count(DISTINCT p_size%7) AS countries FROM {{part}} GROUP BY 1 HAVING count(*) > 1",
        "localized_names": "SELECT country_id AS id, min_by(form, (CASE WHEN size%9=0 THEN 0 ELSE 1 END, CASE ord%4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, ord, form)) FILTER (WHERE ord%4 <> 2) AS name_en, cast(NULL AS varchar) AS name_zh FROM {mark} GROUP BY 1",
        "alias_selection": f"WITH t AS (SELECT country_id || '|' || name_group AS id, form AS name, size%4 AS rank, ord, {_NORM.format('form')} AS f FROM {{mark}}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, f ORDER BY rank, ord, name) AS n FROM t) WHERE n = 1) SELECT id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY id, rank ORDER BY ord, name) AS k FROM o) WHERE rank <> 2 OR k <= 2",
        "surname_groups": f"WITH {_REC}, l AS (SELECT country_id, name_group, string_agg(local, '|' ORDER BY o) AS locals FROM (SELECT country_id, name_group, local, min(ord) AS o FROM recs WHERE local IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT r.country_id, r.name_group, min(rank) AS rank, coalesce(max(locals), '') AS locals, r.name_group AS latins, min_by(cnt, ord) FILTER (WHERE cnt IS NOT NULL) AS count FROM recs r LEFT JOIN l ON r.country_id = l.country_id AND r.name_group = l.name_group GROUP BY 1, 2",
        "surname_rank_one": f"WITH {_REC} SELECT country_id, name_group, rank, ord FROM recs WHERE rank = 1 UNION ALL SELECT country_id, name_group, rank, ord FROM recs WHERE rank IS NULL AND country_id NOT IN (SELECT country_id FROM recs WHERE rank = 1)",
        "source_precedence": _TAG + " SELECT country_id, source, count(*) AS records FROM best GROUP BY 1, 2",
        "surname_coverage": _TAG + " SELECT cast(n_nationkey AS bigint) AS country_id, CASE WHEN one IS NULL THEN 'no-source' WHEN one = 1 THEN 'rank-one' WHEN man THEN 'manual' ELSE 'source-listed' END AS status FROM {nation} LEFT JOIN (SELECT country_id, max(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS one, bool_and(source = 'manual') AS man FROM best GROUP BY 1) b ON b.country_id = n_nationkey",
        "surname_units": f"WITH {_REC} SELECT n_regionkey AS iso, coalesce(min(CASE WHEN h.country_id IS NOT NULL THEN cast(n_nationkey AS bigint) END), max(cast(n_nationkey AS bigint))) AS country_id FROM {{nation}} LEFT JOIN (SELECT DISTINCT country_id FROM recs) h ON h.country_id = n_nationkey GROUP BY 1",
        "display_forms": f"WITH {_REC} SELECT ord, coalesce(local, latin) AS form, local IS NULL AS fell_back, 'Latin' AS script FROM recs",
        "error_percentiles": "SELECT count(*) AS n, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY e), 9) AS p50, round(percentile_disc(0.9) WITHIN GROUP (ORDER BY e), 9) AS p90, round(max(e), 9) AS worst FROM (SELECT abs((o_totalprice+o_custkey)/o_totalprice-1) AS e FROM {orders})",
        "largest_errors": "SELECT id, error FROM (SELECT o_orderkey AS id, round((o_totalprice+o_custkey)/o_totalprice-1, 9) AS error FROM {orders}) ORDER BY abs(error) DESC, id LIMIT 10",
        "frame_stats": "SELECT user_id, count(*) AS frames, cast(sum(gap) AS double) AS duration_ms, round(1000e0*count(gap)/sum(gap), 6) AS fps, cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY gap) AS double) AS p50, cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY gap) AS double) AS p95, cast(max(gap) AS double) AS longest, round(avg(CASE WHEN gap > 20000 THEN 1e0 WHEN gap IS NOT NULL THEN 0e0 END)*100, 6) AS slow_percent FROM (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM (SELECT DISTINCT user_id, cast(floor(epoch(ts)) AS bigint) AS s FROM {events})) GROUP BY 1 HAVING sum(gap) > 0",
        "metric_top10": "SELECT * FROM (SELECT id, value, row_number() OVER (ORDER BY value DESC, id) AS rank FROM (SELECT o_custkey AS id, cast(sum(floor(o_totalprice)) AS bigint) AS value FROM {orders} GROUP BY 1)) WHERE rank <= 10 OR id = 1",
        "area_ratio_bands": "SELECT CASE WHEN q IS NULL THEN -1 WHEN q <= 0.1 THEN 0 WHEN q <= 0.25 THEN 1 WHEN q <= 0.5 THEN 2 WHEN q >= 10 THEN 6 WHEN q >= 4 THEN 5 WHEN q >= 2 THEN 4 ELSE 3 END AS band, count(*) AS n FROM (SELECT round(l_extendedprice/(l_quantity*1000), 4) AS q FROM {lineitem}) GROUP BY 1",
        "parameters": "SELECT p_partkey, floor(least(1e0, greatest(0.1e0, p_size/37e0))*100+0.5e0)/100e0 AS alpha, CASE WHEN p_partkey BETWEEN 50 AND 20000 THEN cast(p_partkey AS double) END AS radius, least(20000e0, greatest(50e0, floor(q/s+0.5e0)*s)) AS rounded, cast(floor((ln(q)-ln(50e0))/ln(400e0)*1000e0+0.5e0) AS bigint) AS slider, least(20000e0, greatest(50e0, floor(k/ks+0.5e0)*ks)) AS slid, CASE WHEN p_size/2e0 IN (0.25,0.5,1,2,4,8,16) THEN p_size/2e0 ELSE 4e0 END AS level, round(1-(1-p_size/100e0)*0.5e0, 6) AS alpha_sum FROM (SELECT *, CASE WHEN q < 200 THEN 1e0 WHEN q < 2000 THEN 5e0 ELSE 10e0 END AS s, CASE WHEN k < 200 THEN 1e0 WHEN k < 2000 THEN 5e0 ELSE 10e0 END AS ks FROM (SELECT *, least(20000e0, greatest(50e0, p_partkey*1.7e0)) AS q, least(20000e0, greatest(50e0, 50e0*exp(least(1000e0, greatest(0e0, p_partkey/2e0))/1000e0*ln(400e0)))) AS k FROM {part}))",
        "owner_violations": "WITH c AS (SELECT city_id, population, CASE WHEN city_id%5=0 THEN 'root' ELSE 'ok' END AS status, CASE WHEN city_id%7<>0 THEN 1.5 END AS threshold, CASE WHEN city_id%5<>0 THEN city_id+1 END AS parent FROM {city}), m AS (SELECT c.*, p.population AS pp FROM c LEFT JOIN c p ON c.parent = p.city_id) SELECT city_id, 'a reached city has a threshold' AS rule FROM m WHERE status='ok' AND threshold IS NULL UNION ALL SELECT city_id, 'only reached cities have a threshold' FROM m WHERE status<>'ok' AND threshold IS NOT NULL UNION ALL SELECT city_id, 'a parent exists' FROM m WHERE parent IS NOT NULL AND pp IS NULL UNION ALL SELECT city_id, 'a parent is larger' FROM m WHERE pp <= population",
    }.items()
}
