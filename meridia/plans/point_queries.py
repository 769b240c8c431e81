"""Queries over points: nearest cities, proximity, climate, circles, sun."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import geo, solar
from meridia.operators import circle, climate, graph, nearest, proximity, raster
from meridia.plans.views import HEIGHT, STEP, WIDTH, frame, inline

GRID = raster.Grid(HEIGHT, WIDTH, STEP)
BIG = 8_000_000
R = "6371.0088e0"


def hav(a: str, b: str, form: str = "asin") -> str:
    """SQL for the distance between a and b (lat, lon column pairs), six decimals."""
    (p, l), (q, m) = a.split(), b.split()
    h = f"least(1e0, greatest(0e0, pow(sin(radians({q}-{p})/2e0),2) + cos(radians({p}))*cos(radians({q}))*pow(sin(radians({m}-{l})/2e0),2)))"
    return f"round(2e0*{R}*asin(sqrt({h})), 6)" if form == "asin" else f"round(2e0*{R}*atan2(sqrt({h}), sqrt(1e0-{h})), 6)"


def nearest_city(spark, d):
    return nearest.nearest_city(frame(spark, d, "site"), frame(spark, d, "city"), "point_id").select("point_id", "city_id", "distance_km")


def nearest_focal(spark, d):
    big = frame(spark, d, "city").filter(F.col("population") >= BIG)
    return nearest.nearest_focal(frame(spark, d, "site"), big, "point_id").select("point_id", "city_id", "distance_km")


def antipode_relation(spark, d):
    out = nearest.antipode_relation(frame(spark, d, "site"), frame(spark, d, "city"), "point_id")
    return out.select("point_id", F.round("far_lat", 6).alias("far_lat"), F.round("far_lon", 6).alias("far_lon"), "here_city_id", "here_distance_km", "far_city_id", "far_distance_km")


def record_holders(spark, d):
    return proximity.record_holders(frame(spark, d, "city"), BIG)


def competitor_alpha_050(spark, d):
    return proximity.competitors(record_holders(spark, d), 0.5)


def proximity_ranking(spark, d):
    return proximity.ranking(competitor_alpha_050(spark, d)).select("rank", "focal_id", "city_id", "distance_km", "total")


def proximity_selected_rank(spark, d):
    """The rank of the big city nearest to (0, 0)."""
    big = frame(spark, d, "city").filter(F.col("population") >= BIG)
    here = spark.createDataFrame([(0, 0.0, 0.0)], "point_id int, lat double, lon double")
    selected = nearest.nearest_focal(here, big, "point_id").select(F.col("city_id").alias("focal_id"))
    return proximity_ranking(spark, d).join(F.broadcast(selected), "focal_id", "left_semi").select("focal_id", "rank", "total")


def proximity_referenced(spark, d):
    return proximity.referenced(frame(spark, d, "city"), graph.cut(record_holders(spark, d))).select("index", "city_id")


def point_cells(spark, d):
    return raster.point_select(frame(spark, d, "site"), frame(spark, d, "class_raster"), GRID).select("point_id", "r", "c", "v", "status")


def climate_sample(spark, d):
    return raster.sample_snap(frame(spark, d, "city"), frame(spark, d, "class_raster"), GRID, "city_id").select("city_id", F.coalesce("v", F.lit(0)).alias("class"), "snapped")


def _classed(spark, d):
    cities = frame(spark, d, "city").join(climate_sample(spark, d).select("city_id", "class"), "city_id")
    points = raster.sample_snap(frame(spark, d, "site"), frame(spark, d, "class_raster"), GRID, "point_id")
    return points.select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.coalesce("v", F.lit(0)).alias("p_class")), cities


def climate_same_latitude(spark, d):
    return climate.same_latitude(*_classed(spark, d))


def climate_far_twins(spark, d):
    return climate.far_twins(*_classed(spark, d))


def climate_twins(spark, d):
    return climate.twins(*_classed(spark, d))


def _circle(spark, d):
    return frame(spark, d, "site"), circle.prepare_cells(frame(spark, d, "cell"), HEIGHT, WIDTH)


def circle_profile(spark, d):
    return circle.profile(*_circle(spark, d))


def circle_within_500km(spark, d):
    return circle.measured(*_circle(spark, d), 500, ()).select("point_id", "pop")


def circle_half_radius(spark, d):
    return circle.radii_of_shares(*_circle(spark, d), (0.5,))


def circle_milestones(spark, d):
    return circle.radii_of_shares(*_circle(spark, d), circle.MILESTONES)


def circle_summary(spark, d):
    return circle.summed_up(*_circle(spark, d), 2500.5)


def smallest_half_circle(spark, d):
    return circle.smallest_half_circle(frame(spark, d, "cell"), HEIGHT, WIDTH, factor=1)


def solar_position(spark, d):
    sun = solar.subsolar(F.col("ts"))
    return frame(spark, d, "observation").select("event_id", F.round(sun["lat"], 6).alias("sun_lat"), F.round(sun["lon"], 6).alias("sun_lon"))


def solar_altitude(spark, d):
    alt = F.round(solar.altitude(F.col("ts"), F.col("lat"), F.col("lon")), 6)
    return frame(spark, d, "observation").select("event_id", alt.alias("altitude"), solar.daylight(alt).alias("state"), F.round(solar.overlay_alpha(alt), 8).alias("overlay"))


def solar_events(spark, d):
    e = solar.events(F.col("ts"), F.col("lat"), F.col("lon"))
    return frame(spark, d, "observation").select("event_id", e["kind"].alias("kind"), F.round(e["sunrise_min"], 5).alias("sunrise_min"), F.round(e["sunset_min"], 5).alias("sunset_min"))


def geodesics(spark, d):
    """Points of the great circle from each site to its nearest city."""
    near = nearest.nearest_city(frame(spark, d, "site"), frame(spark, d, "city"), "point_id")
    rows = near.select("point_id", F.explode(geo.geodesic_points("lat", "lon", "t_lat", "t_lon", 4)).alias("p")) if "t_lat" in near.columns else near
    return rows.select("point_id", "p.step", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


_G = "(2e0*pi()/366e0*(dayofyear(ts)-1+({h}-12)/24e0))"
_H = "((hour(ts)*60+minute(ts))/60e0)"


def _series(g: str) -> tuple[str, str]:
    eot = f"(229.18e0*(0.000075e0+0.001868e0*cos({g})-0.032077e0*sin({g})-0.014615e0*cos(2*{g})-0.040849e0*sin(2*{g})))"
    dec = f"(0.006918e0-0.399912e0*cos({g})+0.070257e0*sin({g})-0.006758e0*cos(2*{g})+0.000907e0*sin(2*{g})-0.002697e0*cos(3*{g})+0.00148e0*sin(3*{g}))"
    return eot, dec


_EOT, _DEC = _series(_G.format(h=_H))
_EOT_NOON, _DEC_NOON = _series(_G.format(h="12e0"))
_LON = f"(((-15e0*({_H}-12+{_EOT}/60e0)+180e0+720e0)%360e0)-180e0)"
_SAMPLE = """
  SELECT {k}, {p}, rv AS class, d2 > 0 AS snapped FROM (
    SELECT p.*, k.v AS rv, k.d2, row_number() OVER (PARTITION BY {k} ORDER BY k.d2, k.dy, k.dx) AS n FROM (
      SELECT *, cast(floor((90e0-lat)/5e0) AS int) AS r0, cast(floor((lon+180e0)/5e0) AS int) AS c0 FROM {src}) p
    LEFT JOIN (SELECT cr.r, cr.c, cr.v, dy, dx, dy*dy+dx*dx AS d2 FROM {{class_raster}} cr, (SELECT unnest(range(-2,3)) AS dy) a, (SELECT unnest(range(-2,3)) AS dx) b WHERE cr.v > 0) k
      ON k.r = p.r0+k.dy AND k.c = (p.c0+k.dx+72)%72 AND p.r0 BETWEEN 0 AND 35) WHERE n = 1"""
_CITY_CLASS = _SAMPLE.format(k="city_id", p="lat, lon, population, country_id", src="{city}")
_SITE_CLASS = _SAMPLE.format(k="point_id", p="lat AS p_lat, lon AS p_lon", src="{site}").replace(" rv AS class", " coalesce(rv,0) AS p_class")
_TWIN = """SELECT point_id, '{name}' AS list, position, city_id, class, country_id, distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY population DESC, city_id) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY point_id, {key} ORDER BY population DESC, city_id) AS n FROM (
      SELECT p.*, c.city_id, c.class, c.population, c.country_id, c.lat, """ + hav("p_lat p_lon", "lat lon") + """ AS distance_km FROM sites p, cities c) WHERE {cond}) WHERE n = 1) WHERE position <= 3"""
_SAME = _TWIN.format(name="same-latitude", key="class", cond="abs(lat-p_lat) <= 1 AND class <> p_class AND class > 0 AND distance_km >= 500")
_FAR = _TWIN.format(name="far-twin", key="country_id", cond="class = p_class AND p_class > 0 AND distance_km >= 3000")
_CLASSED = f"WITH cities AS ({_CITY_CLASS.replace('rv AS class', 'coalesce(rv,0) AS class')}), sites AS ({_SITE_CLASS})\n"
_HOLDERS = f"""WITH met AS (
  SELECT f.city_id AS focal_id, f.population AS focal_population, c.city_id, c.population, {hav('f.lat f.lon', 'c.lat c.lon')} AS distance_km
  FROM {{city}} f JOIN {{city}} c ON f.city_id <> c.city_id WHERE f.population >= {BIG}),
runs AS (SELECT *, max(population) OVER w AS largest FROM met WINDOW w AS (PARTITION BY focal_id ORDER BY distance_km, population DESC, city_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
recs AS (SELECT *, max(CASE WHEN population >= focal_population THEN 1 ELSE 0 END) OVER w AS done FROM runs WHERE largest IS NULL OR population > largest
  WINDOW w AS (PARTITION BY focal_id ORDER BY distance_km, population DESC, city_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
holders AS (SELECT focal_id, focal_population, row_number() OVER (PARTITION BY focal_id ORDER BY distance_km, population DESC, city_id) AS position, city_id, population, distance_km
  FROM recs WHERE coalesce(done, 0) = 0 AND population >= 0.1e0*focal_population)"""
_RIVALS = _HOLDERS + """,
rivals AS (SELECT focal_id, focal_population, city_id, population, distance_km FROM (
  SELECT f.focal_id, f.focal_population, h.city_id, h.population, h.distance_km, row_number() OVER (PARTITION BY f.focal_id ORDER BY h.position) AS n
  FROM (SELECT DISTINCT focal_id, focal_population FROM holders) f LEFT JOIN holders h ON f.focal_id = h.focal_id AND h.population >= 0.5e0*h.focal_population) WHERE n = 1)"""
_RANKS = _RIVALS + """,
ranks AS (SELECT row_number() OVER (ORDER BY distance_km DESC, focal_population DESC, focal_id) AS rank, focal_id, city_id, distance_km, count(*) OVER () AS total FROM rivals WHERE city_id IS NOT NULL)"""
_CELLS = """WITH cells AS (SELECT cos(radians(la))*cos(radians(lo)) AS ux, cos(radians(la))*sin(radians(lo)) AS uy, sin(radians(la)) AS uz, v AS pop FROM (
  SELECT 90e0-(r+0.5e0)*5e0 AS la, (c+0.5e0)*5e0-180e0 AS lo, v FROM {cell} WHERE v > 0)),
pts AS (SELECT point_id, cos(radians(lat))*cos(radians(lon)) AS px, cos(radians(lat))*sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM {site}),
prof AS (SELECT point_id, cast(least(20016, floor(round(2e0*6371.0088e0*asin(least(1e0, sqrt((px-ux)*(px-ux)+(py-uy)*(py-uy)+(pz-uz)*(pz-uz))/2e0)), 6))) AS int) AS bin, cast(sum(pop) AS bigint) AS pop FROM pts, cells GROUP BY 1, 2)"""


def _radius(shares: str) -> str:
    return _CELLS + f""",
runs AS (SELECT *, sum(pop) OVER (PARTITION BY point_id ORDER BY bin) AS upto, sum(pop) OVER (PARTITION BY point_id) AS total FROM prof),
radii AS (SELECT point_id, share, round(min_by(bin + (share*total-(upto-pop))/pop, bin), 6) AS radius_km FROM runs, (SELECT unnest([{shares}]) AS share) WHERE upto >= share*total AND pop > 0 GROUP BY 1, 2)"""


_NEAR = "SELECT {k}, city_id, distance_km FROM (SELECT {k}, c.city_id, {d} AS distance_km, row_number() OVER (PARTITION BY {k} ORDER BY {d}, {o}) AS n FROM {p} p, {c} c) WHERE n = 1"
_ENDS = """WITH ends AS (SELECT point_id, 0 AS far, lat, lon FROM {site} UNION ALL SELECT point_id, 1, -lat, ((lon+180e0+180e0)%360e0)-180e0 FROM {site}),
near AS (""" + _NEAR.format(k="point_id, far, p.lat, p.lon", d=hav("p.lat p.lon", "c.lat c.lon", "atan2"), o="population DESC, city_id", p="ends", c="{city}").replace("SELECT point_id, far, p.lat, p.lon, city_id, distance_km", "SELECT point_id, far, lat, lon, city_id, distance_km").replace("PARTITION BY point_id, far, p.lat, p.lon", "PARTITION BY point_id, far") + ")"

QUERIES = {f.__name__: f for f in (nearest_city, nearest_focal, antipode_relation, record_holders, competitor_alpha_050, proximity_ranking, proximity_selected_rank, proximity_referenced, point_cells, climate_sample, climate_same_latitude, climate_far_twins, climate_twins, circle_profile, circle_within_500km, circle_half_radius, circle_milestones, circle_summary, smallest_half_circle, solar_position, solar_altitude, solar_events, geodesics)}

_FOCAL_PLACE = "(SELECT * FROM {city} WHERE population >= 8000000)"
_LINES = f"""WITH near AS (SELECT point_id, la, lo, lb, mb FROM (SELECT point_id, p.lat AS la, p.lon AS lo, c.lat AS lb, c.lon AS mb, row_number() OVER (PARTITION BY point_id ORDER BY {hav('p.lat p.lon', 'c.lat c.lon', 'atan2')}, population DESC, city_id) AS n FROM {{site}} p, {{city}} c) WHERE n = 1),
arcs AS (SELECT *, 2e0*asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(lb-la)/2e0),2)+cos(radians(la))*cos(radians(lb))*pow(sin(radians(mb-lo)/2e0),2))))) AS om, unnest(range(5)) AS step FROM near),
w AS (SELECT *, CASE WHEN om < 1e-12 THEN 1-step/4e0 ELSE sin((1-step/4e0)*om)/sin(om) END AS wa, CASE WHEN om < 1e-12 THEN step/4e0 ELSE sin(step/4e0*om)/sin(om) END AS wb FROM arcs),
v AS (SELECT *, wa*cos(radians(la))*cos(radians(lo))+wb*cos(radians(lb))*cos(radians(mb)) AS x, wa*cos(radians(la))*sin(radians(lo))+wb*cos(radians(lb))*sin(radians(mb)) AS y, wa*sin(radians(la))+wb*sin(radians(lb)) AS z FROM w),
e AS (SELECT point_id, step, CASE step WHEN 0 THEN la WHEN 4 THEN lb ELSE degrees(atan2(z, sqrt(x*x+y*y))) END AS lat, CASE step WHEN 0 THEN lo WHEN 4 THEN mb ELSE degrees(atan2(y, x)) END AS lon FROM v)
SELECT point_id, cast(step AS int) AS step, round(lat, 6) AS lat, round(CASE WHEN lon = -180e0 THEN 180e0 ELSE lon END, 6) AS lon FROM e"""
def _halves(name: str, points: str) -> str:
    """The radius around each of points that holds half of all people."""
    return f"""{name}_bins AS (
  SELECT lat, lon, least(20016, cast(floor(round(2e0*6371.0088e0*asin(least(1e0, sqrt((x-ux)*(x-ux)+(y-uy)*(y-uy)+(z-uz)*(z-uz))/2e0)), 6)) AS int)) AS bin, sum(v) AS pop
  FROM (SELECT *, cos(radians(lat))*cos(radians(lon)) AS ux, cos(radians(lat))*sin(radians(lon)) AS uy, sin(radians(lat)) AS uz FROM {points}) p, cells GROUP BY 1, 2, 3),
{name} AS (SELECT lat, lon, round(min_by(bin+(total/2e0-(upto-pop))/pop, bin), 6) AS half FROM (
  SELECT *, sum(pop) OVER (PARTITION BY lat, lon ORDER BY bin) AS upto, sum(pop) OVER (PARTITION BY lat, lon) AS total FROM {name}_bins) b WHERE upto >= total/2e0 GROUP BY 1, 2)"""


def _around(best: str, step: str, reach: int) -> str:
    return f"""SELECT DISTINCT greatest(-89.9e0, least(89.9e0, round(lat+i*{step}, 6))) AS lat, round(((round(lon+j*{step}, 6)+540e0)%360e0)-180e0, 6) AS lon
  FROM {best}, (SELECT unnest(range(-{reach}, {reach + 1})) AS i) a, (SELECT unnest(range(-{reach}, {reach + 1})) AS j) b"""


_SMALLEST = f"""WITH cells AS (SELECT v, cos(radians(la))*cos(radians(lo)) AS x, cos(radians(la))*sin(radians(lo)) AS y, sin(radians(la)) AS z
  FROM (SELECT v, 90e0-(r+0.5e0)*5e0 AS la, (c+0.5e0)*5e0-180e0 AS lo FROM {{cell}} WHERE v > 0) k),
lattice AS (SELECT cast(i*2-59 AS double) AS lat, cast(j*2-179 AS double) AS lon FROM (SELECT unnest(range(70)) AS i) a, (SELECT unnest(range(180)) AS j) b),
{_halves("one", "lattice")}, best_one AS (SELECT * FROM one ORDER BY half, lat, lon LIMIT 24),
near_two AS ({_around("best_one", "0.25e0", 8)}), {_halves("two", "near_two")}, best_two AS (SELECT * FROM two ORDER BY half, lat, lon LIMIT 1),
near_three AS ({_around("best_two", "0.05e0", 5)}), {_halves("three", "near_three")}, best AS (SELECT * FROM three ORDER BY half, lat, lon LIMIT 1),
centre AS (SELECT round(lat, 2) AS lat, round(lon, 2) AS lon FROM best), {_halves("last", "centre")}
SELECT l.lat, l.lon, cast(round(half) AS bigint) AS radius_km, cast(round(sum(pop*greatest(0e0, least(1e0, half-bin)))) AS bigint) AS population FROM last l, last_bins GROUP BY 1, 2, half"""

ORACLES = {
    k: inline(v)
    for k, v in {
        "smallest_half_circle": _SMALLEST,
        "nearest_city": _NEAR.format(k="point_id", d=hav("p.lat p.lon", "c.lat c.lon", "atan2"), o="population DESC, city_id", p="{site}", c="{city}"),
        "nearest_focal": _NEAR.format(k="point_id", d=hav("p.lat p.lon", "c.lat c.lon"), o="cast(city_id AS varchar)", p="{site}", c=_FOCAL_PLACE),
        "antipode_relation": _ENDS + " SELECT point_id, round(max(CASE WHEN far=1 THEN lat END), 6) AS far_lat, round(max(CASE WHEN far=1 THEN lon END), 6) AS far_lon, max(CASE WHEN far=0 THEN city_id END) AS here_city_id, max(CASE WHEN far=0 THEN distance_km END) AS here_distance_km, max(CASE WHEN far=1 THEN city_id END) AS far_city_id, max(CASE WHEN far=1 THEN distance_km END) AS far_distance_km FROM near GROUP BY point_id",
        "record_holders": _HOLDERS + " SELECT * FROM holders",
        "competitor_alpha_050": _RIVALS + " SELECT * FROM rivals",
        "proximity_ranking": _RANKS + " SELECT * FROM ranks",
        "proximity_selected_rank": _RANKS + f" SELECT focal_id, rank, total FROM ranks WHERE focal_id = (SELECT city_id FROM {_FOCAL_PLACE} c ORDER BY {hav('0e0 0e0', 'lat lon')}, cast(city_id AS varchar) LIMIT 1)",
        "proximity_referenced": _HOLDERS + " SELECT row_number() OVER (ORDER BY city_id)-1 AS index, city_id FROM (SELECT focal_id AS city_id FROM holders UNION SELECT city_id FROM holders)",
        "point_cells": "SELECT point_id, p.r, p.c, k.v, CASE WHEN p.r IS NULL THEN 'outside-coverage' WHEN coalesce(k.v,0)=0 THEN 'none' ELSE 'ok' END AS status FROM (SELECT point_id, CASE WHEN floor((90e0-lat)/5e0) BETWEEN 0 AND 35 THEN cast(floor((90e0-lat)/5e0) AS int) END AS r, CASE WHEN floor((90e0-lat)/5e0) BETWEEN 0 AND 35 THEN cast(floor((lon+180e0)/5e0) AS int) END AS c FROM {site}) p LEFT JOIN {class_raster} k ON k.r = p.r AND k.c = p.c",
        "climate_sample": _CITY_CLASS.replace("rv AS class", "coalesce(rv,0) AS class").replace("SELECT city_id, lat, lon, population, country_id,", "SELECT city_id,", 1),
        "climate_same_latitude": _CLASSED + _SAME,
        "climate_far_twins": _CLASSED + _FAR,
        "climate_twins": _CLASSED + _SAME + " UNION ALL " + _FAR,
        "circle_profile": _CELLS + " SELECT * FROM prof",
        "circle_within_500km": _CELLS + " SELECT point_id, round(sum(pop*greatest(0e0, least(1e0, 500e0-bin))), 6) AS pop FROM prof GROUP BY 1",
        "circle_half_radius": _radius("0.5e0") + " SELECT * FROM radii",
        "circle_milestones": _radius("0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0") + " SELECT * FROM radii",
        "circle_summary": _radius("0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0") + ", near AS (SELECT point_id, round(sum(pop*greatest(0e0, least(1e0, 2500.5e0-bin))), 6) AS pop, cast(sum(pop) AS bigint) AS total FROM prof GROUP BY 1) SELECT point_id, pop, total, round(pop/total, 6) AS share, " + ", ".join(f"max(CASE WHEN radii.share={s}e0 THEN radius_km END) AS r{round(s * 100)}" for s in circle.MILESTONES) + " FROM near JOIN radii USING (point_id) GROUP BY point_id, pop, total",
        "geodesics": _LINES,
        "solar_position": f"SELECT event_id, round(degrees({_DEC}), 6) AS sun_lat, round({_LON}, 6) AS sun_lon FROM {{observation}}",
        "solar_altitude": f"SELECT event_id, altitude, CASE WHEN altitude >= 0 THEN 'day' WHEN altitude >= -6 THEN 'civil-twilight' ELSE 'night' END AS state, round(CASE WHEN altitude >= 0 THEN 0e0 WHEN altitude <= -6 THEN 0.5e0 ELSE altitude/-6e0*0.5e0 END, 8) AS overlay FROM (SELECT event_id, round(degrees(asin(least(1e0, greatest(-1e0, sin(radians(lat))*sin({_DEC})+cos(radians(lat))*cos({_DEC})*cos(radians(lon-{_LON})))))), 6) AS altitude FROM {{observation}})",
        "solar_events": f"SELECT event_id, kind, CASE WHEN kind='events' THEN round(noon-4e0*degrees(acos(CASE WHEN kind='events' THEN ch END)), 5) END AS sunrise_min, CASE WHEN kind='events' THEN round(noon+4e0*degrees(acos(CASE WHEN kind='events' THEN ch END)), 5) END AS sunset_min FROM (SELECT *, CASE WHEN ch < -1 THEN 'polar-day' WHEN ch > 1 THEN 'polar-night' ELSE 'events' END AS kind FROM (SELECT event_id, 720e0-4e0*lon-{_EOT_NOON} AS noon, (sin(radians(-0.833e0))-sin(radians(lat))*sin({_DEC_NOON}))/(cos(radians(lat))*cos({_DEC_NOON})) AS ch FROM {{observation}}))",
    }.items()
}
