"""Queries over countries and their first-level regions as rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import mapped, units
from meridia.plans.shape_queries import EDGES
from meridia.plans.views import HEIGHT, WIDTH, frame, inline

MERGED = ("XYZ",)
COUNTRY_ID = "CASE WHEN {0} = 7 THEN 'ne-156' WHEN {0} = 12 THEN 'ne-732' ELSE concat('ne-', {0}) END"


def _units(spark, d):
    """The last country has no regions of its own."""
    drawn = frame(spark, d, "label")
    countries = drawn.filter("lab > 0").select(F.col("lab").alias("country")).distinct().withColumn("country_id", F.expr(COUNTRY_ID.format("country")))
    admins = frame(spark, d, "admin").withColumn("country", F.when(F.col("country") < 30, F.col("country")))
    return units.classified(drawn, frame(spark, d, "district"), countries, admins, HEIGHT, WIDTH, merged=MERGED)


def unit_areas(spark, d):
    """Each unit with its country, region, cells and area."""
    told, cells, _ = _units(spark, d)
    area = F.sum(units.cell_km2(F.col("r"), HEIGHT, WIDTH))
    sums = cells.groupBy(F.col("lab").alias("label")).agg(F.count("*").alias("cells"), F.round(area, 3).alias("area_km2"))
    return told.join(sums, "label").select("label", "unit_id", "country", "admin", "cells", "area_km2")


def unit_adjustments(spark, d):
    """Regions that went over to another country, and remnants with the unit that took them."""
    found = _units(spark, d).adjustments
    return found.select("admin", "kind", "code", "adm0", "country_id", "unit_id", F.round("area_km2", 3).alias("area_km2"), F.round("share", 6).alias("share"), "edges", "category", "reason", "needs_review")


def unit_cells(spark, d):
    """The unit of each cell."""
    return _units(spark, d).cells


def unit_points(spark, d):
    """Each unit's size, that of its largest part, and the middle of it."""
    found = units.described(_units(spark, d).cells.select("r", "c", "lab"), HEIGHT, WIDTH)
    return found.select("lab", "cells", F.round("area_km2", 3).alias("area_km2"), F.round("largest_km2", 3).alias("largest_km2"), "r", "c", "distance")


def unit_names(spark, d):
    """How many units have a Chinese name or are whole countries."""
    return units.name_coverage(_units(spark, d).units, frame(spark, d, "admin"))


def country_overlap(spark, d):
    """How much of the drawn land lies in several countries."""
    shapes = frame(spark, d, "ring")
    held = mapped.rasterize(shapes.drop("country"), HEIGHT, WIDTH).join(shapes.select("poly", "country").distinct(), "poly")
    return units.overlap_share(held, HEIGHT, WIDTH).select(F.round("overlap_km2", 3).alias("overlap_km2"), F.round("land_km2", 3).alias("land_km2"), F.round("share", 9).alias("share"))


QUERIES = {f.__name__: f for f in (unit_areas, unit_adjustments, unit_cells, unit_points, unit_names, country_overlap)}

_AREA = "round(sum((sin(radians(90e0-r*5e0))-sin(radians(90e0-(r+1)*5e0)))*2*pi()/72*6371.0088e0*6371.0088e0), 6)"
_UNITS = f"""WITH said AS (SELECT admin, CASE WHEN country < 30 THEN country END AS given, code, adm0, name FROM {{admin}}),
cells AS (SELECT l.r, l.c, l.lab AS country, coalesce(d.lab, 0) AS admin FROM {{label}} l LEFT JOIN {{district}} d ON d.r = l.r AND d.c = l.c WHERE l.lab > 0),
pairs AS (SELECT country, admin, {_AREA} AS area FROM cells GROUP BY ALL),
whole AS (SELECT lab AS admin, {_AREA} AS area FROM {{district}} WHERE lab > 0 GROUP BY 1),
most AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY admin ORDER BY area DESC, country) AS n FROM pairs WHERE admin > 0) p WHERE n = 1),
judged AS (SELECT s.*, m.country AS most, m.area, m.area/w.area AS share, m.country IS DISTINCT FROM given AND round(m.area-0.95e0*w.area, 6) >= 0 AS goes
  FROM said s JOIN most m ON m.admin = s.admin JOIN whole w ON w.admin = s.admin),
eligible AS (SELECT p.*, j.code FROM pairs p JOIN judged j ON j.admin = p.admin AND p.country = CASE WHEN goes THEN most ELSE given END),
sides AS (SELECT country, admin, other, count(*) AS edges FROM (
  SELECT a.country, a.admin, b.admin AS other FROM cells a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(i, j), cells b
  WHERE b.r = a.r+i AND b.c = (a.c+j+72)%72 AND b.country = a.country AND b.admin <> a.admin) e GROUP BY ALL),
rest AS (SELECT * FROM (
  SELECT p.country, p.admin, p.area, e.admin AS dest, coalesce(edges, 0) AS edges, row_number() OVER (PARTITION BY p.country, p.admin ORDER BY coalesce(edges, 0) DESC, e.area DESC, e.code) AS n
  FROM pairs p LEFT JOIN eligible e ON e.country = p.country LEFT JOIN sides s ON s.country = p.country AND s.admin = p.admin AND s.other = e.admin
  WHERE (p.country, p.admin) NOT IN (SELECT (country, admin) FROM eligible)) r WHERE n = 1),
dealt AS (SELECT country, admin, admin AS dest FROM eligible UNION ALL SELECT country, admin, coalesce(dest, 0) FROM rest),
units AS (SELECT *, row_number() OVER (ORDER BY unit_id) AS label FROM (
  SELECT DISTINCT d.country, dest, {COUNTRY_ID.format('d.country')} || ':' || CASE WHEN dest = 0 THEN 'ADM0' ELSE code END AS unit_id FROM dealt d LEFT JOIN said s ON s.admin = d.dest) u),
placed AS (SELECT r, c, label, k.country FROM cells k JOIN dealt d ON d.country = k.country AND d.admin = k.admin JOIN units u ON u.country = d.country AND u.dest = d.dest),
moves AS (SELECT admin, 'transfer' AS kind, code, adm0, name, most AS country, NULL AS unit_id, area, share, NULL AS edges FROM judged WHERE goes UNION ALL
  SELECT r.admin, 'remnant', code, adm0, name, r.country, unit_id, area, NULL, edges FROM rest r JOIN units u ON u.country = r.country AND u.dest = r.dest LEFT JOIN said s ON s.admin = r.admin)"""

_OVERLAP = f"""WITH {EDGES}, spots AS (SELECT r, c, 90e0-(r+0.5e0)*5e0 AS y, (c+0.5e0)*5e0-180e0 AS x FROM (SELECT unnest(range(36)) AS r) a, (SELECT unnest(range(72)) AS c) b),
west AS (SELECT country, poly, min(least(lon, lon2)) AS west FROM edges GROUP BY ALL), turned AS (SELECT r, c, y, country, poly, west+(((x-west)%360e0)+360e0)%360e0 AS x FROM spots, west),
held AS (SELECT t.country, t.poly, r, c FROM turned t JOIN edges e ON e.poly = t.poly AND (e.lat <= y) <> (e.lat2 <= y) AND e.lon+(y-e.lat)/nullif(e.lat2-e.lat, 0)*(e.lon2-e.lon) > x GROUP BY ALL HAVING count(*)%2 = 1),
land AS (SELECT r, c, count(DISTINCT country) AS n FROM held GROUP BY ALL), sums AS (SELECT n > 1 AS twice, {_AREA} AS area FROM land GROUP BY ALL)
SELECT round(coalesce(sum(area) FILTER (WHERE twice), 0), 3) AS overlap_km2, round(sum(area), 3) AS land_km2, round(coalesce(sum(area) FILTER (WHERE twice), 0)/sum(area), 9) AS share FROM sums"""

ORACLES = {
    name: inline(sql)
    for name, sql in {
        "unit_areas": _UNITS + f" SELECT label, unit_id, u.country, u.dest AS admin, cells, area_km2 FROM units u JOIN (SELECT label, count(*) AS cells, round({_AREA}, 3) AS area_km2 FROM placed GROUP BY 1) p USING (label)",
        "unit_adjustments": _UNITS
        + f""" SELECT *, category IS NULL AS needs_review FROM (SELECT admin, kind, code, adm0, {COUNTRY_ID.format('country')} AS country_id, unit_id, round(area, 3) AS area_km2, round(share, 6) AS share, edges,
          CASE WHEN adm0 = 'KSV' THEN 'Kosovo' WHEN name = 'Sevastopol town' THEN 'Crimea' WHEN adm0 = 'IND' AND country = 7 AND name = 'West ladakh' THEN 'Aksai Chin'
            WHEN adm0 = 'SAH' OR country = 12 THEN 'Western Sahara' WHEN adm0 = 'XYZ' THEN 'merged territory' END AS category,
          CASE WHEN kind = 'remnant' THEN CASE WHEN edges > 0 THEN 'longest shared edge' ELSE 'no shared edge' END END AS reason FROM moves) m""",
        "unit_cells": _UNITS + " SELECT r, c, label AS lab, country FROM placed",
        "country_overlap": _OVERLAP,
        "unit_names": _UNITS + " SELECT count(*) AS units, count(*) FILTER (WHERE trim(coalesce(name_zh, '')) <> '') AS named, count(*) FILTER (WHERE dest = 0) AS whole_countries FROM units u LEFT JOIN {admin} a ON a.admin = u.dest",
    }.items()
}
