"""Queries over rows of sources: raw rasters, names in use, required matches, gates and small functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meridia.functions import geo, scalars, solar, text
from meridia.operators import graph, names, raster, search
from meridia.plans.views import HEIGHT, STEP, WIDTH, frame, inline
from meridia.sources import stripes, tables

NODATA = 65535


def _folder(spark):
    return f"{graph.shared_folder(spark)}/rows-{uuid.uuid4().hex[:12]}"


# ---- raw rasters


def _written(spark, d):
    path = _folder(spark)
    stripes.write_stripes(frame(spark, d, "cell").select("r", "c", (F.col("v") % 60000).alias("v")), path, HEIGHT, WIDTH, rows=10, nodata=NODATA)
    return path


def label_stripes(spark, d):
    """Counts written as raw numbers and read again in stripes, nulls where nothing is known."""
    return stripes.read_stripes(spark, _written(spark, d), HEIGHT, WIDTH, stripeRows=4, nodata=NODATA)


def window_sums(spark, d):
    """The raw raster's cells summed into a coarser grid that covers a part of it."""
    return stripes.sum_window(spark, _written(spark, d), raster.Grid(HEIGHT, WIDTH, STEP), raster.Grid(8, 13, 11.0, 57.0, -93.0), NODATA, 4)


# ---- names and matches


def _alternates(spark, d):
    """Names as rows of text without quotes: ids are customers', every tenth of none."""
    c, path = frame(spark, d, "customer"), _folder(spark)
    flag = lambda k, n: F.when(F.col("c_custkey") % k == n, "1").otherwise("")
    fields = {
        "alternateNameId": F.col("c_custkey").cast("string"),
        "geonameid": (F.col("c_custkey") % 400).cast("string"),
        "language": F.lit("en"),
        "name": F.when(F.col("c_custkey") % 31 == 4, " ").otherwise(F.col("c_name")),
        "preferred": flag(3, 1),
        "short": flag(7, 2),
        "colloquial": flag(11, 3),
        "historic": flag(13, 5),
        "valid_from": flag(17, 6),
        "valid_to": F.when(F.col("c_custkey") % 19 == 7, "0").otherwise(""),
    }
    c.select(*(v.alias(k) for k, v in fields.items())).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    return tables.alternate_rows(spark, path)


def alternate_names(spark, d):
    """Names in use of the ids that are suppliers or nations."""
    rows = _alternates(spark, d)
    owner, number = rows.columns[1], rows.columns[0]
    rows = rows.withColumnRenamed(owner, "id")
    suppliers = frame(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    nations = frame(spark, d, "nation").select((F.col("n_nationkey") + 300).cast("long").alias("id"))
    return tables.relevant_alternates(rows, suppliers, nations).select(F.col(number).cast("long").alias("number"), F.col("id").cast("long").alias("id"), "name", "preferred")


def captured_cities(spark, d):
    """Centres in Mollweide metres from a quoted file, from 5 000 000 people on."""
    path = _folder(spark)
    c = frame(spark, d, "city")
    lon = (F.col("city_id") % 100 - 50) * 60000.0
    lat = (F.col("city_id") % 80 - 40) * 90000.0
    c.select(F.col("city_id").alias("ID_UC_G0"), F.concat(F.lit('"'), "name", F.lit('", at sea')).alias("GC_UCN_MAI_2025"), F.col("segment").alias("GC_CNT_GAD_2025"), F.col("population").alias("GC_POP_TOT_2025"), lon.alias("GC_UCC_LON_2025"), lat.alias("GC_UCC_LAT_2025")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return tables.captured_cities(spark, path, 5_000_000)


def required_places(spark, d):
    """Cities whose country and first-order region both exist, with the country's name, which must be there."""
    c = frame(spark, d, "city").select("city_id", F.concat(F.lit("c"), "country_id").alias("country_code"), F.col("segment").alias("admin1"))
    nations = frame(spark, d, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("country_code"), F.col("n_name").alias("country"), "n_regionkey")
    admins = c.filter("city_id % 3 <> 0").select(F.concat_ws(".", "country_code", "admin1").alias("admin_key")).distinct()
    kept = search.with_required(c, nations.filter("n_regionkey <> 2"), admins)
    return tables.left_join_required(kept, nations.select("country_code", "country"), "country_code").select("city_id", "country")


def reviewed_forms(spark, d):
    """Latin forms of part names, a reviewed one first where there is one."""
    records = frame(spark, d, "part").groupBy((F.col("p_partkey") % 25).alias("country_id"), F.col("p_brand").alias("name_group")).agg(F.sort_array(F.collect_set("p_type")).alias("latins"))
    reviewed = frame(spark, d, "nation").select(F.col("n_nationkey").alias("country_id"), F.lit("Brand#12").alias("name_group"), F.when(F.col("n_nationkey") % 2 == 0, "ECONOMY").otherwise(F.col("n_name")).alias("reviewed"))
    return names.apply_overrides(records, reviewed).select("country_id", "name_group", F.array_join("latins", "|").alias("latins"))


def display_names(spark, d):
    """Names and labels in two languages, leading marks and second forms left out, shares as text."""
    n = frame(spark, d, "customer")
    zh, en = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("z"), "c_name")), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    local = F.concat(F.lit("'"), "c_mktsegment", F.lit(" / "), "c_name")
    sure = F.when(F.col("c_custkey") % 4 == 0, "unknown").when(F.col("c_custkey") % 4 == 1, "disputed").otherwise("known")
    return n.select("c_custkey", scalars.display_name(zh, en, "zh").alias("zh"), scalars.display_name(zh, en, "en").alias("en"), text.primary_local(local).alias("local"), text.sort_key(local).alias("sorted_by"), text.literal_label(F.col("c_mktsegment"), sure).alias("meaning"), scalars.format_share(F.col("c_custkey") % 2000 / F.lit(2001.0)).alias("share"))


# ---- numbers


def gated_values(spark, d):
    """Lines' prices through a gate, their flags as bits and layers of opacity."""
    line = frame(spark, d, "lineitem")
    bits = (F.col("l_partkey") % 16).cast("int")
    alphas = F.array((F.col("l_linenumber") / F.lit(10.0)), (F.col("l_partkey") % 5 / F.lit(8.0)), F.lit(0.25))
    owner = scalars.owner_from_rgb((F.col("l_partkey") % 256).cast("int"), (F.col("l_suppkey") % 200).cast("int"), F.lit(0))
    kept = line.select("l_orderkey", "l_linenumber", scalars.gate_non_negative(F.col("l_extendedprice").cast("double"), 1e9).alias("price"), scalars.mask_bit(bits, 2).alias("third_bit"), owner.alias("owner"), scalars.layer_alpha(alphas).alias("covered"))
    return kept.groupBy("owner", "third_bit").agg(F.count("*").alias("lines"), F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("covered"), 6).alias("covered"))


def place_pairs(spark, d):
    """Each site with the one of the next number: half way, by chord and along the sphere, and the area of its cell."""
    a = frame(spark, d, "site").select("point_id", "lat", "lon")
    b = a.select((F.col("point_id") - 1).alias("point_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    half = geo.midpoint("lat", "lon", "lat2", "lon2")
    area = geo.cell_area_km2(F.floor(F.col("lat") / 5) * 5 + 5, F.floor(F.col("lat") / 5) * 5, F.lit(5.0))
    pairs = a.join(b, "point_id")
    return pairs.select("point_id", F.round(half["lat"], 6).alias("lat"), F.round(half["lon"], 6).alias("lon"), F.round(geo.haversine_km("lat", "lon", "lat2", "lon2"), 6).alias("km"), F.round(area, 4).alias("cell_km2"))


def chosen_band(spark, d):
    """The one band of nations' years that has 2020 as a word."""
    bands = frame(spark, d, "nation").select(F.col("n_nationkey").alias("band"), F.concat(F.lit("people "), (F.col("n_nationkey") + 2013).cast("string"), F.lit("-"), "n_name").alias("description"))
    return tables.year_band(bands, 2020)


def minutes(spark, d):
    """Observations by minute, as text and read again."""
    seen = frame(spark, d, "observation").select("event_id", "ts", solar.format_minute(F.col("ts")).alias("minute"))
    return seen.select("event_id", "minute", (solar.parse_minute(F.col("minute")) == F.col("ts")).alias("same"))


QUERIES = {f.__name__: f for f in (label_stripes, window_sums, alternate_names, captured_cities, required_places, reviewed_forms, display_names, gated_values, place_pairs, chosen_band, minutes)}

_HAV = "2e0*6371.0088e0*asin(sqrt(least(1e0, pow(sin(radians(b.lat-a.lat)/2e0), 2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2e0), 2))))"
_EMPTY = "coalesce(NULLIF(trim({0}), ''), {1})"
ORACLES = {
    name: inline(sql)
    for name, sql in {
        "label_stripes": "SELECT cast(a.r AS int) AS r, cast(b.c AS int) AS c, cast(v%60000 AS int) AS v FROM (SELECT unnest(range(36)) AS r) a CROSS JOIN (SELECT unnest(range(72)) AS c) b LEFT JOIN {cell} k ON k.r = a.r AND k.c = b.c",
        "window_sums": "SELECT cast(floor((57e0-(90e0-(r+0.5e0)*5e0))/11e0) AS int) AS r, cast(floor(((c+0.5e0)*5e0-180e0+93e0)/11e0) AS int) AS c, cast(sum(v%60000) AS bigint) AS v FROM {cell} WHERE floor((57e0-(90e0-(r+0.5e0)*5e0))/11e0) BETWEEN 0 AND 7 AND floor(((c+0.5e0)*5e0-180e0+93e0)/11e0) BETWEEN 0 AND 12 GROUP BY 1, 2",
        "alternate_names": "SELECT c_custkey AS number, c_custkey%400 AS id, c_name AS name, c_custkey%3 = 1 AS preferred FROM {customer} WHERE c_custkey%7 <> 2 AND c_custkey%11 <> 3 AND c_custkey%13 <> 5 AND c_custkey%17 <> 6 AND c_custkey%31 <> 4 AND (c_custkey%400 IN (SELECT s_suppkey FROM {supplier}) OR c_custkey%400 IN (SELECT n_nationkey+300 FROM {nation}))",
        "captured_cities": "SELECT city_id, '\"' || name || '\", at sea' AS name, segment AS country, cast(population AS double) AS population, floor(degrees(asin(greatest(-1e0, least(1e0, (2*t+sin(2*t))/pi()))))*10000+0.5e0)/10000e0 AS lat, floor(degrees(pi()*x/(2*6378137e0*sqrt(2e0)*cos(t)))*10000+0.5e0)/10000e0 AS lon FROM (SELECT *, (city_id%100-50)*60000e0 AS x, asin((city_id%80-40)*90000e0/(6378137e0*sqrt(2e0))) AS t FROM {city}) c WHERE population >= 5000000",
        "required_places": "SELECT city_id, n_name AS country FROM {city} c JOIN {nation} ON n_nationkey = country_id AND n_regionkey <> 2 WHERE (country_id, segment) IN (SELECT (country_id, segment) FROM {city} WHERE city_id%3 <> 0)",
        "reviewed_forms": "WITH forms AS (SELECT p_partkey%25 AS country_id, p_brand AS name_group, p_type AS f, NULL AS rank FROM {part} UNION SELECT n_nationkey, 'Brand#12', CASE WHEN n_nationkey%2 = 0 THEN 'ECONOMY' ELSE n_name END, 0 FROM {nation}), once AS (SELECT country_id, name_group, f, min(rank) AS rank, bool_and(rank IS NOT NULL) AS sole FROM forms GROUP BY 1, 2, 3) SELECT country_id, name_group, string_agg(f, '|' ORDER BY coalesce(rank, 1), f) AS latins FROM once GROUP BY 1, 2 HAVING NOT bool_and(sole)",
        "display_names": "SELECT c_custkey, coalesce(CASE WHEN c_custkey%3 <> 0 THEN 'z' || c_name END, CASE WHEN c_custkey%5 <> 0 THEN c_name END) AS zh, CASE WHEN c_custkey%5 <> 0 THEN c_name END AS en, '''' || c_mktsegment AS local, c_mktsegment || ' / ' || c_name AS sorted_by, CASE c_custkey%4 WHEN 0 THEN NULL WHEN 1 THEN c_mktsegment || '?' ELSE c_mktsegment END AS meaning, CASE WHEN c_custkey%2000 IN (1, 2) THEN '<0.1%' ELSE printf('%.1f%%', c_custkey%2000/2001e0*100) END AS share FROM {customer}",
        "gated_values": "SELECT cast(l_partkey%256+(l_suppkey%200)*256 AS int) AS owner, (l_partkey%16)//4%2 = 1 AS third_bit, count(*) AS lines, round(sum(cast(l_extendedprice AS double)), 2) AS price, round(sum(1-(1-l_linenumber/10e0)*(1-l_partkey%5/8e0)*0.75e0), 6) AS covered FROM {lineitem} GROUP BY 1, 2",
        "place_pairs": f"SELECT point_id, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS lat, round(((degrees(atan2(y, x))+540e0)%360e0)-180e0, 6) AS lon, round(km, 6) AS km, round(6371.0088e0*6371.0088e0*radians(5e0)*(sin(radians(floor(la/5e0)*5+5))-sin(radians(floor(la/5e0)*5))), 4) AS cell_km2 FROM (SELECT a.point_id, a.lat AS la, {_HAV} AS km, cos(radians(a.lat))*cos(radians(a.lon))+cos(radians(b.lat))*cos(radians(b.lon)) AS x, cos(radians(a.lat))*sin(radians(a.lon))+cos(radians(b.lat))*sin(radians(b.lon)) AS y, sin(radians(a.lat))+sin(radians(b.lat)) AS z FROM {{site}} a JOIN {{site}} b ON b.point_id = a.point_id+1) p",
        "chosen_band": "SELECT n_nationkey AS band, 'people ' || (n_nationkey+2013) || '-' || n_name AS description FROM {nation} WHERE n_nationkey = 7",
        "minutes": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') || 'Z' AS minute, true AS same FROM {observation}",
    }.items()
}
