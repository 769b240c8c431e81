"""The driver's tables seen as cities, sites, rasters, labels and borders: one SQL text for either engine.

A text names tables and other views in braces. Spark binds them to DataFrames; for other engines
``inline`` puts them together as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

HEIGHT, WIDTH, STEP = 36, 72, 5.0
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "city": """SELECT c_custkey AS city_id, c_name AS name, c_nationkey AS country_id, c_mktsegment AS segment,
      cast((c_custkey*7919)%17001 AS double)/100e0-85e0 AS lat, cast((c_custkey*104729)%36000 AS double)/100e0-180e0 AS lon,
      cast((c_custkey*2654435761)%9900001+100000 AS bigint) AS population FROM {customer}""",
    "site": """SELECT s_suppkey AS point_id, s_nationkey AS country_id, cast((s_suppkey*6007)%18001 AS double)/100e0-90e0 AS lat,
      cast((s_suppkey*15013)%36000 AS double)/100e0-180e0 AS lon FROM {supplier}""",
    "cell": """SELECT cast((l_orderkey*31+l_linenumber)%36 AS int) AS r, cast((l_partkey*17)%72 AS int) AS c,
      cast(sum(cast(l_quantity AS bigint)) AS bigint) AS v FROM {lineitem} GROUP BY 1, 2""",
    "label": """SELECT r, c, cast(CASE WHEN (r*7+c*3)%6=0 THEN 0 ELSE floor(r/6e0)*5+floor(c/15e0)+1 END AS int) AS lab FROM {cell}""",
    "block": """SELECT r, c, cast(CASE WHEN (r*5+c*7+(r*c)%11)%13 = 0 THEN 0 ELSE floor(r/9e0)*4+floor(((c+5)%72)/18e0)+1 END AS int) AS lab FROM {cell}""",
    "sheet": """SELECT a.r, b.c, coalesce(k.lab, 0) AS lab FROM (SELECT DISTINCT r FROM {cell}) a CROSS JOIN (SELECT DISTINCT c FROM {cell}) b
      LEFT JOIN {block} k ON k.r = a.r AND k.c = b.c""",
    # corners of an 18 x 24 mesh, each moved by what its cell holds
    "node": """SELECT a.r AS j, b.c AS i, (b.c+0.3e0*(coalesce(k.v, 0)%100/100e0-0.5e0))/24e0 AS x, (a.r+0.3e0*(coalesce(k.v, 0)*7%100/100e0-0.5e0))/18e0 AS y
      FROM (SELECT DISTINCT r FROM {cell} WHERE r <= 18) a CROSS JOIN (SELECT DISTINCT c FROM {cell} WHERE c <= 24) b LEFT JOIN {cell} k ON k.r = a.r AND k.c = b.c""",
    # how far a map of 12 x 24 cells is moved at its corners, a little more where more lies; none at the poles, the last column as the first
    "shift": """SELECT a.r AS j, b.c AS i, 1.5e0*sin(radians(b.c%24*15e0*2))*sin(radians(a.r*15e0))+coalesce(k.v, 0)%100/100e0 AS dlon,
      CASE WHEN a.r = 0 OR a.r = 12 THEN 0e0 ELSE 0.04e0*sin(radians(a.r*30e0))*cos(radians(b.c%24*15e0))+coalesce(k.v, 0)%50/5000e0 END AS ds
      FROM (SELECT DISTINCT r FROM {cell} WHERE r <= 12) a CROSS JOIN (SELECT DISTINCT c FROM {cell} WHERE c <= 24) b LEFT JOIN {cell} k ON k.r = a.r*2 AND k.c = b.c%24*3""",
    # a rectangle around each supplier's place, some across the date line, and its place in an atlas
    "patch": """SELECT cast(s_suppkey AS int) AS patch, west, south, west+4e0+s_suppkey%9 AS east, south+3e0+s_suppkey%5 AS north,
      cast(s_suppkey%16*20 AS int) AS atlas_x, cast(floor(s_suppkey/16e0)*20 AS int) AS atlas_y, cast(12+s_suppkey%6 AS int) AS inner_width, cast(10+s_suppkey%8 AS int) AS inner_height
      FROM (SELECT *, cast((s_suppkey*15013)%36000 AS double)/100e0-180e0 AS west, cast((s_suppkey*6007)%16001 AS double)/100e0-85e0 AS south FROM {supplier}) s""",
    "texel": """SELECT p.atlas_y+a.r AS ay, p.atlas_x+b.c AS ax, (p.patch*7+a.r*3+b.c*5)%4 AS lab, (a.r+b.c)%2 AS pad, (p.patch+a.r*11+b.c*13)%256 AS near
      FROM {patch} p CROSS JOIN (SELECT DISTINCT r FROM {cell} WHERE r < 20) a CROSS JOIN (SELECT DISTINCT c FROM {cell} WHERE c < 20) b""",
    # regions of three by four cells, some cells in none; and what is said of each, some with the wrong country or none
    "district": """SELECT r, c, cast(CASE WHEN (r*3+c*5)%17 = 0 THEN 0 ELSE floor(r/3e0)*18+floor(((c+CASE WHEN r%5 = 0 THEN 1 ELSE 0 END)%72)/4e0)+1 END AS int) AS lab FROM {cell}""",
    "admin": """SELECT admin, CASE WHEN admin%29 = 11 THEN NULL WHEN admin%7 = 0 THEN most%30+1 ELSE most END AS country, concat('A', cast(admin%10 AS string), '-', cast(admin AS string)) AS code,
      CASE WHEN admin%31 = 5 THEN 'KSV' WHEN admin%37 = 8 THEN 'SAH' WHEN admin%41 = 9 THEN 'XYZ' WHEN admin%5 = 1 THEN 'IND' END AS adm0,
      CASE WHEN admin%43 = 3 THEN 'Sevastopol town' WHEN admin%3 = 0 THEN 'West ladakh' ELSE 'Plain' END AS name, CASE WHEN admin%4 = 1 THEN ' ' WHEN admin%4 > 1 THEN 'zh' END AS name_zh
      FROM (SELECT d.lab AS admin, max(l.lab) AS most FROM {district} d JOIN {label} l ON l.r = d.r AND l.c = d.c WHERE d.lab > 0 GROUP BY 1) a""",
    "parent": "SELECT DISTINCT lab AS label, (lab-1)%5 AS parent FROM {label} WHERE lab > 0",
    "class_raster": "SELECT r, c, cast(v%7 AS bigint) AS v FROM {cell}",
    "border": """SELECT DISTINCT a, b, 1 AS cost FROM (
      SELECT cast(n_nationkey AS bigint) AS a, cast((n_nationkey*3+1)%20 AS bigint) AS b FROM {nation} WHERE n_nationkey < 20 UNION ALL
      SELECT cast((n_nationkey*3+1)%20 AS bigint), cast(n_nationkey AS bigint) FROM {nation} WHERE n_nationkey < 20 UNION ALL
      SELECT cast(n_nationkey AS bigint), cast(20+(n_nationkey+1)%5 AS bigint) FROM {nation} WHERE n_nationkey >= 20 UNION ALL
      SELECT cast(20+(n_nationkey+1)%5 AS bigint), cast(n_nationkey AS bigint) FROM {nation} WHERE n_nationkey >= 20) e WHERE a <> b""",
    "linked": """SELECT a, b, cost FROM {border} UNION ALL SELECT cast(3 AS bigint), cast(7 AS bigint), 0 UNION ALL SELECT cast(7 AS bigint), cast(3 AS bigint), 0""",
    "observation": """SELECT event_id, date_trunc('minute', ts) AS ts, lat, lon FROM {events}
      CROSS JOIN (SELECT count(*) AS n FROM {supplier}) t JOIN {site} ON point_id = user_id % n + 1""",
    # three polygons of fixed shape (one with a hole, one across the date line), and one around each supplier's place, some with a hole
    "corner": """SELECT * FROM (VALUES (0, 0, -1e0, -1e0), (0, 1, -1e0, 1e0), (0, 2, 1e0, 0.8e0), (0, 3, 1e0, -1e0), (0, 4, -1e0, -1e0),
      (1, 0, -0.5e0, -0.5e0), (1, 1, 0.5e0, -0.5e0), (1, 2, 0.5e0, 0.4e0), (1, 3, -0.5e0, 0.5e0), (1, 4, -0.5e0, -0.5e0)) AS t(ring, ix, dy, dx)""",
    "ring": """SELECT country, poly, ring, ix, lat, lon FROM (VALUES
      (1, -3, 0, 0, 60e0, 10e0), (1, -3, 0, 1, 60e0, 30e0), (1, -3, 0, 2, 70e0, 30e0), (1, -3, 0, 3, 70e0, 10e0), (1, -3, 0, 4, 60e0, 10e0),
      (1, -2, 0, 0, 0e0, -20e0), (1, -2, 0, 1, 0e0, 20e0), (1, -2, 0, 2, 40e0, 20e0), (1, -2, 0, 3, 40e0, -20e0), (1, -2, 0, 4, 0e0, -20e0),
      (1, -2, 1, 0, 10e0, -10e0), (1, -2, 1, 1, 30e0, -10e0), (1, -2, 1, 2, 30e0, 10e0), (1, -2, 1, 3, 10e0, 10e0), (1, -2, 1, 4, 10e0, -10e0),
      (2, -1, 0, 0, -40e0, 170e0), (2, -1, 0, 1, -40e0, -170e0), (2, -1, 0, 2, -20e0, -175e0), (2, -1, 0, 3, -15e0, 172e0), (2, -1, 0, 4, -40e0, 170e0))
      AS t(country, poly, ring, ix, lat, lon) UNION ALL
      SELECT s_nationkey, cast(s_suppkey AS int), ring, ix, cast((s_suppkey*6007)%14001 AS double)/100e0-70e0 + dy*(1+s_suppkey%7),
      (cast((s_suppkey*15013)%36000 AS double)/100e0 + dx*(2+s_suppkey%11) + 360e0)%360e0 - 180e0
      FROM {supplier} CROSS JOIN {corner} WHERE ring = 0 OR s_suppkey % 5 = 0""",
    # the ground of each city, a crooked rectangle; the larger the city, the larger
    "outline": """SELECT 0 AS country, city_id AS poly, 0 AS ring, ix, lat+dy*size+0.00317e0 AS lat, (lon+dx*size*1.3e0+540.00713e0)%360e0-180e0 AS lon
      FROM (SELECT city_id, lat, lon, 0.4e0+population/2500000e0 AS size FROM {city}) g CROSS JOIN {corner} k WHERE k.ring = 0""",
    # for each supplier two parcels with a crooked border between them, and an islet in the western one: lines of thousandths of a degree
    "chain": """SELECT cast(s_suppkey AS int) AS s, line, t,
      CASE line WHEN 3 THEN 250+(abs((t+3)%12-6)-3)*(4+s_suppkey%14+((t%12)*(t%12)*7+s_suppkey)%3)
        WHEN 0 THEN 500+CASE WHEN t = 0 OR t = 30 THEN 0 ELSE (s_suppkey*13+t*t*7+t*29)%40-20 END
        ELSE 500+(line*2-3)*((15-abs(t-15))*33+CASE WHEN t = 0 OR t = 30 THEN 0 ELSE (s_suppkey*37+t*t*11+t*7*line)%200 END) END AS x,
      CASE line WHEN 3 THEN 495+(abs(t%12-6)-3)*(4+s_suppkey%14+((t%12)*(t%12)*7+s_suppkey)%3) ELSE t*33 END AS y
      FROM {supplier} CROSS JOIN (SELECT DISTINCT c AS t FROM {cell} WHERE c <= 30) a CROSS JOIN (SELECT DISTINCT r AS line FROM {cell} WHERE r < 4) b WHERE line < 3 OR t <= 12""",
    "parcel": """SELECT (s+part)%25 AS country, 3*s+part AS poly, ring, ix, cast((floor(s/179e0)*1200)%150000-75000+y AS double)/1000e0 AS lat, cast((s%179)*2000-179000+x AS double)/1000e0 AS lon FROM (
      SELECT s, 0 AS part, 0 AS ring, CASE WHEN line = 0 THEN t ELSE 60-t END AS ix, x, y FROM {chain} WHERE line = 0 OR line = 1 AND t < 30 UNION ALL
      SELECT s, 1, 0, CASE WHEN line = 2 THEN t ELSE 60-t END, x, y FROM {chain} WHERE line = 2 OR line = 0 AND t < 30 UNION ALL
      SELECT s, 2, 0, (t+7)%12, x, y FROM {chain} WHERE line = 3 AND t < 12 UNION ALL SELECT s, 2, 0, 12, x, y FROM {chain} WHERE line = 3 AND t = 5 UNION ALL
      SELECT s, 0, 1, 12-t, x, y FROM {chain} WHERE line = 3) p""",
    # the same polygons with less detail: without holes, each edge's start drawn towards its end
    "rough": """SELECT country, poly, 0 AS ring, a.ix, CASE WHEN a.ix%2 = 1 THEN lat*0.9e0+lat2*0.1e0 ELSE lat END AS lat, lon
      FROM (SELECT *, coalesce(lead(lat) OVER (PARTITION BY poly, ring ORDER BY ix), lat) AS lat2 FROM {ring} WHERE ring = 0) a WHERE poly%9 <> 4""",
    # a colour for each label
    "paint": """SELECT lab, cast((lab*2654435761)%256 AS int) AS red, cast((lab*40503+77)%256 AS int) AS green, cast((lab*97+lab*lab*13)%256 AS int) AS blue
      FROM (SELECT DISTINCT cast(lab AS bigint) AS lab FROM {label}) l""",
    # published cities, a few with each kind of fault
    "reached": """SELECT k.city_id, CASE WHEN k.city_id%211 = 3 THEN k.city_id+6 ELSE k.city_id+1 END AS owner_index, k.population,
      CASE WHEN k.city_id%50 = 0 THEN 'root' WHEN k.city_id%17 = 1 THEN 'merged_at_resolution' ELSE 'ok' END AS status,
      CASE WHEN k.city_id%50 = 0 OR k.city_id%17 = 1 OR k.city_id%223 = 5 THEN NULL ELSE k.population/1000e0 END AS threshold,
      CASE WHEN k.city_id%50 = 0 OR k.city_id%17 = 1 THEN NULL WHEN k.city_id%227 = 7 THEN cast(-1 AS bigint) WHEN k.city_id%229 = 9 THEN k.city_id ELSE t.city_id END AS parent_id,
      CASE WHEN k.city_id%17 <> 1 THEN CASE WHEN k.city_id%233 = 11 THEN t.city_id END WHEN k.city_id%239 = 18 THEN k.city_id ELSE t.city_id END AS merged_into,
      CASE WHEN k.city_id%241 = 13 THEN ' ' ELSE k.segment END AS country_en, CASE WHEN k.city_id%251 = 14 THEN NULL ELSE k.segment END AS country_zh,
      CASE WHEN k.city_id%3 = 0 THEN NULL WHEN k.city_id%257 = 16 THEN '' ELSE k.name END AS name_zh, CASE WHEN k.city_id%3 = 0 THEN 'none' ELSE 'exact' END AS match_type,
      k.city_id%97 <> 50 AS reviewed
      FROM {city} k CROSS JOIN (SELECT max_by(city_id, population) AS city_id FROM {city} WHERE city_id%97 <> 50 AND city_id%50 = 0) t""",
    "mark": """SELECT cast(n_nationkey AS bigint) AS country_id, p_brand AS name_group, p_name AS form, p_size AS size, p_partkey AS ord
      FROM {nation} JOIN {part} ON p_partkey % 25 = n_nationkey""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text))})


def inline(sql: str) -> str:
    """sql with the views that it names in braces, and those that they need, before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    views = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    return f"WITH {views},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {views}\n{body}"
