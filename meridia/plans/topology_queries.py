"""Queries over polygons that share borders: their arcs, how much each point matters, simpler polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions.geo import EARTH_KM
from meridia.operators import topology
from meridia.operators.graph import cut
from meridia.plans.views import frame, inline

SHARE, ISLET_KM2, PROTECT_KM2 = 0.4, 60.0, 90.0


def _topology(spark, d):
    return topology.topology(frame(spark, d, "parcel").drop("country"))


def _simpler(spark, d):
    """The parcels, written once as they are read several times, and simpler ones."""
    shapes = cut(frame(spark, d, "parcel"))
    return shapes, *topology.simplified(shapes, frame(spark, d, "city"), SHARE, ISLET_KM2, PROTECT_KM2)


def topology_arcs(spark, d):
    """Each arc with its number of points and of uses."""
    arcs, uses = _topology(spark, d)
    counts = uses.groupBy("arc").agg(F.count("*").alias("uses"))
    first = F.col("points")[0]
    return arcs.join(counts, "arc").select("arc", F.size("points").alias("points"), "uses", first["lat"].alias("lat"), first["lon"].alias("lon"))


def ring_arcs(spark, d):
    """Each ring's arcs in turn, and whether it runs them backward."""
    return _topology(spark, d).uses.select("poly", "ring", "step", "arc", "backward")


def coast_arcs(spark, d):
    """Arcs that only one polygon has."""
    return topology.coast(_topology(spark, d).uses)


def arc_weights(spark, d):
    """The effective area of each point between an arc's ends, in square kilometres."""
    found = topology.weighed(_topology(spark, d).arcs).filter(F.col("weight") < float("inf"))
    return found.select("arc", "k", F.round(F.col("weight") * EARTH_KM * EARTH_KM, 4).alias("weight_km2"))


def needed_polygons(spark, d):
    """Polygons that their country can't lose: its largest, and those that hold a city."""
    found = topology.standing(frame(spark, d, "parcel"), frame(spark, d, "city"))
    return found.select("poly", F.round("area_km2", 3).alias("area_km2"), "needed")


def simpler_parcels(spark, d):
    """Rings with fewer points, without islets that no country needs, common borders still common."""
    _, drawn, uses = _simpler(spark, d)
    rings = topology.assembled(uses, drawn)
    return rings.select("poly", "ring", "ix", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def lost_countries(spark, d):
    """Countries that the simpler polygons have lost; there should be none."""
    shapes, drawn, uses = _simpler(spark, d)
    lost = topology.lost_countries(shapes, topology.assembled(uses, drawn))
    return shapes.agg(F.count_distinct("country").alias("countries")).crossJoin(lost.agg(F.count("*").alias("lost")))


QUERIES = {f.__name__: f for f in (topology_arcs, ring_arcs, coast_arcs, arc_weights, needed_polygons, simpler_parcels, lost_countries)}

_ARCS = """WITH RECURSIVE opened AS (
  SELECT * FROM (SELECT poly, ring, ix, struct_pack(lat := lat, lon := lon) AS p, max(ix) OVER (PARTITION BY poly, ring) AS n FROM {parcel}) v WHERE ix < n),
ends AS (SELECT *, coalesce(lag(p) OVER w, max_by(p, ix) OVER g) AS before, coalesce(lead(p) OVER w, min_by(p, ix) OVER g) AS after
  FROM opened WINDOW w AS (PARTITION BY poly, ring ORDER BY ix), g AS (PARTITION BY poly, ring)),
meets AS (SELECT p FROM (SELECT p, CASE WHEN before < after THEN [before, after] ELSE [after, before] END AS s FROM ends) e GROUP BY p HAVING min(s) <> max(s)),
begun AS (SELECT *, meet OR (NOT bool_or(meet) OVER g AND ix = arg_min(ix, p) OVER g) AS begins
  FROM (SELECT e.*, m.p IS NOT NULL AS meet FROM ends e LEFT JOIN meets m ON m.p = e.p) b WINDOW g AS (PARTITION BY poly, ring)),
numbered AS (SELECT *, cast(sum(begins::int) OVER (PARTITION BY poly, ring ORDER BY ix) AS int) AS step, cast(sum(begins::int) OVER (PARTITION BY poly, ring) AS int) AS last FROM begun),
pieces AS (SELECT poly, ring, step, list(p ORDER BY place) AS points FROM (
    SELECT poly, ring, p, CASE WHEN step = 0 THEN last ELSE step END AS step, CASE WHEN step = 0 THEN ix+n ELSE ix END AS place FROM numbered UNION ALL
    SELECT poly, ring, p, CASE WHEN step = 1 THEN last ELSE step-1 END, CASE WHEN step = 1 THEN ix+n ELSE ix END FROM numbered WHERE begins) s GROUP BY ALL),
turned AS (SELECT poly, ring, step, list_reverse(points) < points AS backward, CASE WHEN list_reverse(points) < points THEN list_reverse(points) ELSE points END AS points FROM pieces),
uses AS (SELECT *, first_value(poly || '/' || ring || '/' || step) OVER (PARTITION BY points ORDER BY poly, ring, step) AS arc FROM turned),
arcs AS (SELECT arc, points, count(*) AS uses FROM uses GROUP BY ALL)"""
# round by round, the point of each arc with the least triangle goes
_WEIGHTS = """, spots AS (SELECT arc, k, points[k+1].lat AS lat, points[k+1].lon AS lon FROM (SELECT arc, points, unnest(range(len(points))) AS k FROM arcs) a),
vectors AS (SELECT arc, k, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM spots),
peel AS (SELECT arc, k, x, y, z, 0e0 AS least, false AS gone FROM vectors UNION ALL
  SELECT arc, k, x, y, z, greatest(least, min(area) OVER (PARTITION BY arc)), area IS NOT NULL AND row_number() OVER (PARTITION BY arc ORDER BY area NULLS LAST, k) = 1 FROM (
    SELECT *, 2*abs(atan2(x1*(y*z2-z*y2)-y1*(x*z2-z*x2)+z1*(x*y2-y*x2), 1+x1*x+y1*y+z1*z+x*x2+y*y2+z*z2+x1*x2+y1*y2+z1*z2)) AS area FROM (
      SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(z) OVER w AS z1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, count(*) OVER (PARTITION BY arc) AS n
      FROM peel WHERE NOT gone WINDOW w AS (PARTITION BY arc ORDER BY k)) p WHERE n > 2) q)"""
_NEEDED = """WITH edges AS (SELECT * FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {parcel} WINDOW w AS (PARTITION BY poly, ring ORDER BY ix)) e WHERE lat2 IS NOT NULL),
rings AS (SELECT country, poly, ring, abs(sum(2*atan2(tan(radians(lon2-lon)/2)*(tan(radians(lat)/2)+tan(radians(lat2)/2)), 1+tan(radians(lat)/2)*tan(radians(lat2)/2)))) AS x FROM edges GROUP BY ALL),
sizes AS (SELECT country, poly, round(sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END*least(x, 4*pi()-x)*6371.0088e0*6371.0088e0), 6) AS area_km2 FROM rings GROUP BY ALL),
held AS (SELECT DISTINCT poly FROM (SELECT city_id, poly FROM {city} c, edges e
  WHERE (e.lat <= c.lat) <> (e.lat2 <= c.lat) AND e.lon+(c.lat-e.lat)/(e.lat2-e.lat)*(e.lon2-e.lon) > c.lon GROUP BY ALL HAVING count(*)%2 = 1) h)"""

ORACLES = {
    name: inline(sql)
    for name, sql in {
        "topology_arcs": _ARCS + " SELECT arc, cast(len(points) AS int) AS points, uses, points[1].lat AS lat, points[1].lon AS lon FROM arcs",
        "ring_arcs": _ARCS + " SELECT poly, ring, step, arc, backward FROM uses",
        "coast_arcs": _ARCS + " SELECT arc FROM arcs WHERE uses = 1",
        "arc_weights": _ARCS + _WEIGHTS + " SELECT arc, cast(k AS int) AS k, round(least*6371.0088e0*6371.0088e0, 4) AS weight_km2 FROM peel WHERE gone",
        "needed_polygons": _NEEDED + " SELECT poly, round(area_km2, 3) AS area_km2, poly IN (SELECT poly FROM held) OR area_km2 = max(area_km2) OVER (PARTITION BY country) AS needed FROM sizes",
        "lost_countries": "SELECT count(DISTINCT country) AS countries, 0 AS lost FROM {parcel}",
    }.items()
}
