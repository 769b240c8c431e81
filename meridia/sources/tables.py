"""Readers of text, archive and index formats into DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CITY_FIELDS = "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, feature_code string, country_code string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation int, dem int, timezone string, modified string"
ALTERNATE_FIELDS = "alternate_id long, id long, lang string, name string, preferred string, short string, colloquial string, historic string, valid_from string, valid_to string"
COUNTRY_FIELDS = "country_code string, iso3 string, iso_numeric string, fips string, country string, capital string, area double, population long, continent string"
ADMIN_FIELDS = "admin_key string, name string, asciiname string, geonameid long"


def read_tsv(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Tab-separated lines without quoting; # starts a comment; rows that don't fit the fields are dropped."""
    return spark.read.schema(fields).option("sep", "\t").option("quote", "").option("comment", "#").option("mode", "DROPMALFORMED").csv(path)


def city_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path, CITY_FIELDS)
    return rows.filter(F.col("geonameid").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.trim("name") != ""))


def alternate_rows(spark: SparkSession, path: str) -> DataFrame:
    """Names in use: not short, colloquial, historic or dated, and not blank."""
    rows = read_tsv(spark, path, ALTERNATE_FIELDS)
    unset = lambda c: F.coalesce(F.trim(c), F.lit("")).isin("", "0")
    kept = unset("short") & unset("colloquial") & unset("historic") & unset("valid_from") & unset("valid_to")
    return rows.filter(kept & (F.trim("name") != "")).withColumn("preferred", F.coalesce("preferred", F.lit("")) == "1")


def relevant_alternates(alternates: DataFrame, *owners: DataFrame) -> DataFrame:
    """Names of the ids in any of the tables (id)."""
    ids = owners[0].select("id")
    for o in owners[1:]:
        ids = ids.unionByName(o.select("id"))
    return alternates.join(ids.distinct(), "id", "left_semi")


def read_csv(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Quoted fields with doubled quotes and line breaks; blank rows dropped."""
    df = spark.read.schema(fields).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.filter(F.concat_ws("", *(F.trim(F.col(c).cast("string")) for c in df.columns)) != "")


def captured_cities(spark: SparkSession, path: str, least: float = 100_000) -> DataFrame:
    """City centres in Mollweide metres to (city_id, name, country, population, lat, lon) from ``least`` people on, four decimals."""
    from meridia.functions.geo import mollweide_inverse
    from meridia.functions.scalars import round_half_up

    raw = read_csv(spark, path, "ID_UC_G0 long, GC_UCN_MAI_2025 string, GC_CNT_GAD_2025 string, GC_POP_TOT_2025 double, GC_UCC_LON_2025 double, GC_UCC_LAT_2025 double")
    p = mollweide_inverse(F.col("GC_UCC_LON_2025"), F.col("GC_UCC_LAT_2025"))
    four = lambda c: round_half_up(c * 10_000) / 10_000.0
    rows = raw.select(F.col("ID_UC_G0").alias("city_id"), F.col("GC_UCN_MAI_2025").alias("name"), F.col("GC_CNT_GAD_2025").alias("country"), F.col("GC_POP_TOT_2025").alias("population"), four(p["lat"]).alias("lat"), four(p["lon"]).alias("lon"))
    return rows.filter(F.col("population") >= least)


def left_join_required(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns; an unmatched row is an error when it is read."""
    met = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    return met.withColumn("_found", F.when(F.col("_found"), True).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean"))).filter("_found").drop("_found")


def compact_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of positions into one table of strings, in a JSON document {formatVersion, strings, rows}: city_id, name, aliases, country, place, lat, lon, population.

    A document in one piece is one record; one that ``sinks.write_index`` laid out in lines is read in parallel.
    Rows meet their strings in a join, so no row carries the table. A position out of range and a value out of
    range are errors when read; ``repeated_ids`` finds repeated ids.
    """
    version, strings, raw = _index_lines(spark, path) if lines else _index_record(spark, path)
    at = lambda k: F.get("x", F.lit(k))
    listed = F.from_json(at(7), "array<int>")
    rows = raw.select(F.monotonically_increasing_id().alias("_row"), at(0).cast("long").alias("city_id"), at(4).cast("double").alias("lat"), at(5).cast("double").alias("lon"), at(6).cast("long").alias("population"), listed.isNotNull().alias("_listed"), F.concat(F.array(*(at(k).cast("int") for k in (1, 2, 3))), F.coalesce(listed, F.array().cast("array<int>"))).alias("_refs"))
    refs = rows.select("*", F.posexplode("_refs").alias("_slot", "_ref")).drop("_refs")
    met = refs.join(strings, F.col("_ref") == F.col("position"), "left")
    word = F.when(F.col("_ref").isNull() | F.col("position").isNotNull(), F.col("string")).otherwise(F.raise_error(F.lit("position out of range")).cast("string"))
    met = met.withColumn("_word", word)
    slot = lambda k: F.max(F.when(F.col("_slot") == k, F.col("_word")))
    aliases = F.sort_array(F.collect_list(F.when(F.col("_slot") > 2, F.struct("_slot", "_word"))))
    kept = ["city_id", "lat", "lon", "population", "_listed"]
    out = met.groupBy("_row").agg(*(F.first(c).alias(c) for c in kept), slot(0).alias("name"), slot(1).alias("country"), slot(2).alias("place"), aliases.alias("a")).crossJoin(F.broadcast(version))
    good = (F.col("formatVersion") == 2) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("population") >= 0)
    checked = out.withColumn("city_id", F.when(good, F.col("city_id")).otherwise(F.raise_error(F.lit("city row out of range")).cast("long")))
    return checked.select("city_id", "name", F.when(F.col("_listed"), F.array_distinct("a._word")).alias("aliases"), "country", "place", "lat", "lon", "population")


def _index_record(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(formatVersion), (position, string) and rows (x) of an index in one piece."""
    raw = spark.read.schema("formatVersion int, strings array<string>, rows array<array<string>>").option("multiLine", True).json(path)
    return raw.select("formatVersion"), raw.select(F.posexplode("strings").alias("position", "string")), raw.select(F.explode("rows").alias("x"))


def _index_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of an index in lines. A string's position is its place in its stretch of a file, after what the stretches before hold."""
    from pyspark.sql import Window

    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    version = lines.filter(F.col("value").startswith("{")).agg(F.max(F.regexp_extract("value", r'^\{"formatVersion":(\d+),', 1).cast("int")).alias("formatVersion"))
    item = lambda kind: F.from_json(F.concat(F.lit("["), F.ltrim(F.col("value"), F.lit(",")), F.lit("]")), kind)[0]
    words = lines.filter(F.col("value").rlike('^,?"'))
    sizes = words.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.select("file", "start", "first", (F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")).alias("before"))  # a row for each stretch
    strings = words.join(F.broadcast(before), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first")).alias("position"), item("array<string>").alias("string"))
    return version, strings, lines.filter(F.col("value").rlike(r"^,?\[")).select(item("array<array<string>>").alias("x"))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def legend(spark: SparkSession, path: str) -> DataFrame:
    """(value, code, description, r, g, b) from lines such as ``1:  Af   Tropical, rainforest   [0 0 255]``."""
    line = r"^\s*(\d+):\s+(\S+)\s+(.*?)\s*\[(\d+) (\d+) (\d+)\]\s*$"
    part = lambda k: F.regexp_extract("value", line, k)
    rows = spark.read.text(path).filter(F.regexp_like("value", F.lit(line)))
    return rows.select(part(1).cast("int").alias("class"), part(2).alias("code"), part(3).alias("description"), *(part(k).cast("int").alias(c) for k, c in ((4, "r"), (5, "g"), (6, "b"))))


def topology_rings(topology: DataFrame) -> DataFrame:
    """(id, poly, ring, ix, lat, lon) from one row (arcs, objects): arcs as deltas with a scale and shift, rings as arc numbers, negative ones reversed."""
    arcs = topology.select("scale", "translate", F.posexplode("arcs").alias("arc", "steps")).select("arc", "scale", "translate", F.posexplode("steps").alias("k", "d"))
    from pyspark.sql import Window

    run = Window.partitionBy("arc").orderBy("k")
    at = lambda j: F.sum(F.get("d", F.lit(j))).over(run) * F.get("scale", F.lit(j)) + F.get("translate", F.lit(j))
    points = arcs.withColumn("lon", at(0)).withColumn("lat", at(1)).select("arc", "k", "lat", "lon")
    rings = topology.select(F.explode("objects").alias("o")).select("o.id", F.posexplode("o.polygons").alias("poly", "rings")).select("id", "poly", F.posexplode("rings").alias("ring", "refs")).select("id", "poly", "ring", F.posexplode("refs").alias("n", "ref"))
    number = F.when(F.col("ref") < 0, -F.col("ref") - 1).otherwise(F.col("ref"))
    met = rings.withColumn("arc", number).join(points, "arc")
    last = F.max("k").over(Window.partitionBy("id", "poly", "ring", "n"))
    order = F.when(F.col("ref") < 0, last - F.col("k")).otherwise(F.col("k"))
    # an arc begins where the one before it ends: that point counts once
    once = met.withColumn("at", order).filter((F.col("n") == 0) | (F.col("at") > 0))
    return once.select("id", "poly", "ring", (F.row_number().over(Window.partitionBy("id", "poly", "ring").orderBy("n", "at")) - 1).alias("ix"), "lat", "lon")


def monthly_mass(long_form: DataFrame, variables: list[str], height: int) -> DataFrame:
    """(r, c, v) in tonnes from (var, month, row, col, kg) whose rows run from the south."""
    kept = long_form.filter(F.col("var").isin(*variables))
    return kept.groupBy((F.lit(height - 1) - F.col("row")).alias("r"), F.col("col").alias("c")).agg((F.sum("kg") / 1000).alias("v"))


def tile_requests(spark: SparkSession, north: float, west: float, south: float, east: float, size: float = 10.0) -> DataFrame:
    """(tile, north, west, south, east): the tiles of a box, the last ones cut at its edges."""
    rows, cols = -int(-(north - south) // size), -int(-(east - west) // size)
    plan = spark.range(rows * cols)
    i, j = F.floor(F.col("id") / cols), F.col("id") % cols
    return plan.select(F.col("id").alias("tile"), (north - i * size).alias("north"), (west + j * size).alias("west"), F.greatest(F.lit(south), north - (i + 1) * size).alias("south"), F.least(F.lit(east), west + (j + 1) * size).alias("east"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(r, c, v) of tiles (row0, col0, r, c, v) put side by side."""
    return tiles.select((F.col("row0") + F.col("r")).alias("r"), (F.col("col0") + F.col("c")).alias("c"), "v")


def year_band(bands: DataFrame, year: int) -> DataFrame:
    """The one band (band, description) whose description has the year as a word; none or several are an error."""
    hits = bands.filter(F.regexp_like("description", F.lit(rf"(^|[^0-9]){year}([^0-9]|$)")))
    n = hits.count()
    if n != 1:
        raise ValueError(f"{n} bands for {year}")
    return hits


def matches_digest(files: DataFrame, digest: Column) -> DataFrame:
    """Binary files whose content has the SHA-256 digest; any other is an error when read."""
    same = F.sha2("content", 256) == digest
    return files.withColumn("path", F.when(same, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("wrong digest: "), F.col("path")))))


SCHEMAS = {"raster": T.StructType([T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("v", T.LongType())])}
