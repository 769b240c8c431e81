"""What goes into published tables and whether they are right: selections, projections, reports, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.text import normalize

#: Codes of populated places, and the ones that are kept whatever their size.
PLACE_CODES = ("PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLG")
SEAT_CODES = ("PPLC", "PPLA")


def includes(candidate: str) -> Column:
    """Whether a policy takes a city (feature_class, feature_code, population, real_zh): seats and cities of a size; D also those with a Chinese name."""
    seat = F.col("feature_code").isin(*SEAT_CODES)
    least = {"A": 100_000, "B": 250_000, "C": 500_000, "D": 250_000}[candidate]
    taken = seat | (F.col("population") >= least)
    return (F.col("feature_class") == "P") & F.col("feature_code").isin(*PLACE_CODES) & (taken | F.col("real_zh") if candidate == "D" else taken)


def policy_sizes(cities: DataFrame) -> DataFrame:
    """(policy, cities, population) of the four policies, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), includes(p).alias("taken")) for p in "ABCD")))
    return cities.select("population", each.alias("p")).filter("p.taken").groupBy("p.policy").agg(F.count("*").alias("cities"), F.sum("population").alias("population"))


def regional(cities: DataFrame, least: int, north: float, west: float, south: float, east: float) -> DataFrame:
    """Cities of a size inside a box, numbered from 1 by id."""
    inside = cities.filter((F.col("population") >= least) & F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return numbered(inside, "city_id", "owner", 1)


def numbered(rows: DataFrame, key: str | list[str | Column], name: str, first: int) -> DataFrame:
    """rows numbered in the order of key, one column or several: by position in range partitions, plus what the partitions before hold."""
    from meridia.operators.graph import cut

    key = key if isinstance(key, list) else [key]
    placed = cut(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*key))
    return placed.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within") + (first - 1)).select(*rows.columns, name)


def reviewed(cities: DataFrame) -> DataFrame:
    """Cities with an English name, an English country and a Chinese country, none of them blank."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return cities.filter(filled("name_en") & filled("country_en") & filled("country_zh"))


def exact_sum(value: Column) -> Column:
    """A sum in decimals, so that no order of adding changes it."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def decoded_bytes(rows: DataFrame, fields: list[str], aliases: str, serialized: int) -> DataFrame:
    """(rows, strings, bytes): an estimate of the memory of a decoded index: distinct normalised strings, rows and references to aliases.

    Fixed values: 24 bytes and two a character for a string; 136 for a row; 8 for a reference; four times the serialized size.
    """
    words = rows.select(F.explode(F.concat(F.array(*(F.coalesce(normalize(F.col(f)), F.lit("")) for f in fields)), F.transform(aliases, lambda a: F.trim(F.regexp_replace(F.lower(a), "[^\\p{L}\\p{N}]+", " "))))).alias("s"))
    strings = words.distinct().agg(F.count("*").alias("strings"), F.sum(24 + 2 * F.length("s")).alias("text"))
    sizes = rows.agg(F.count("*").alias("rows"), F.sum(F.size(aliases)).alias("refs"))
    return strings.crossJoin(sizes).select("rows", "strings", (4 * F.lit(serialized) + F.col("text") + 136 * F.col("rows") + 8 * F.col("refs")).cast("long").alias("bytes"))


def review_summary(matches: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, cities, missing): how many cities each way of matching took, and how many of those have no name."""
    named = names.select("city_id", "name_en")
    met = matches.join(named, "city_id", "left")
    return met.groupBy("kind").agg(F.count("*").alias("cities"), F.count_if(F.trim(F.coalesce("name_en", F.lit(""))) == "").alias("missing"))


def top_record(records: DataFrame, by: str) -> DataFrame:
    """The most frequent record (name, frequency) of each key, then first by name; without a name or a positive frequency it doesn't count."""
    usable = records.filter((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.col("frequency") > 0))
    return usable.groupBy(by).agg(F.min_by(F.struct("name", "frequency"), F.struct(-F.col("frequency"), "name")).alias("b")).select(by, "b.*")


def required_ids(*tables: DataFrame) -> DataFrame:
    """The distinct ids (city_id) of all the tables."""
    return reduce(lambda a, b: a.unionByName(b), (t.select("city_id").filter("city_id is not null") for t in tables)).distinct()


def build_input(cities: DataFrame, countries: DataFrame, admins: DataFrame) -> dict[str, DataFrame]:
    """Cities that policy A takes and whose country and region exist, and only the countries and regions that they name."""
    kept = cities.filter(includes("A")).join(countries.select("country_code"), "country_code", "left_semi").join(admins.select("admin_key"), "admin_key", "left_semi")
    return {"cities": kept, "countries": countries.join(kept.select("country_code"), "country_code", "left_semi"), "admins": admins.join(kept.select("admin_key"), "admin_key", "left_semi")}


def reviewed_places(places: DataFrame, reviewed_names: DataFrame) -> DataFrame:
    """places (key, country_code, country, admin) with the reviewed Chinese country; a region named like its country is none.

    reviewed_names: (country_code, zh). A country without a reviewed name is an error when it is read.
    """
    met = places.join(reviewed_names, "country_code", "left")
    zh = F.when(F.col("zh").isNotNull(), F.col("zh")).otherwise(F.raise_error(F.concat(F.lit("no reviewed name: "), F.col("country_code"))))
    return met.select("key", "country_code", zh.alias("country_zh"), F.when(F.col("admin") != F.col("country"), F.col("admin")).alias("admin"))


def missing_names(required: DataFrame, names: DataFrame) -> DataFrame:
    """Required cities (city_id) whose English name (city_id, name_en) is missing or blank; a gate lets none through."""
    good = names.filter(F.trim(F.coalesce("name_en", F.lit(""))) != "").select("city_id")
    return required.select("city_id").join(good, "city_id", "left_anti")


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, counted: ``side`` is a or b. Equal tables give no row."""
    key = F.sha2(F.to_json(F.struct(*sorted(a.columns))), 256).alias("digest")
    only = lambda x, y, name: x.select(key).exceptAll(y.select(key)).agg(F.count("*").alias("rows")).select(F.lit(name).alias("side"), "rows")
    return only(a, b, "a").unionByName(only(b, a, "b")).filter("rows > 0")


def manifest_violations(tiles: DataFrame, height: int, width: int, side: int = 64) -> DataFrame:
    """(rule, n) of tiles (level, r0, c0, rows, cols) that should cover a grid once at each level.

    Tiles of a level meet only those that touch the same block of side x side cells, and a pair counts in
    the block where what they share begins.
    """
    inside = (F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("rows") > 0) & (F.col("cols") > 0) & (F.col("r0") + F.col("rows") <= height) & (F.col("c0") + F.col("cols") <= width)
    outside = tiles.filter(~inside).agg(F.count("*").alias("n")).select(F.lit("tile outside").alias("rule"), "n")
    box = ["r0", "c0", "rows", "cols"]
    right = tiles.filter(inside).groupBy("level", *box).agg(F.count("*").alias("n")).withColumn("id", F.struct(*box))
    blocks = lambda at, size: F.explode(F.sequence(F.expr(f"{at} div {side}"), F.expr(f"({at} + {size} - 1) div {side}")))
    dealt = right.withColumn("br", blocks("r0", "rows")).withColumn("bc", blocks("c0", "cols"))
    other = dealt.select("level", "br", "bc", *(F.col(c).alias(f"o_{c}") for c in (*box, "n", "id")))
    clash = (F.col("id") < F.col("o_id")) & (F.col("r0") < F.col("o_r0") + F.col("o_rows")) & (F.col("o_r0") < F.col("r0") + F.col("rows")) & (F.col("c0") < F.col("o_c0") + F.col("o_cols")) & (F.col("o_c0") < F.col("c0") + F.col("cols"))
    begins = (F.floor(F.greatest("r0", "o_r0") / side) == F.col("br")) & (F.floor(F.greatest("c0", "o_c0") / side) == F.col("bc"))
    pairs = dealt.join(other, ["level", "br", "bc"]).filter(clash & begins).select((F.col("n") * F.col("o_n")).alias("n")).unionByName(right.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")))
    overlap = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("tiles overlap").alias("rule"), "n")
    area = right.groupBy("level").agg(F.sum(F.col("n") * F.col("rows") * F.col("cols")).alias("a")).filter(F.col("a") != height * width).agg(F.count("*").alias("n")).select(F.lit("level not covered").alias("rule"), "n")
    return outside.unionByName(overlap).unionByName(area).filter("n > 0")


def reach_violations(cities: DataFrame) -> DataFrame:
    """(rule, city_id) of published cities that break a rule of theirs, a row for each rule.

    cities: city_id, owner_index, population, status, threshold, parent_id, merged_into, country_en,
    country_zh, name_zh, match_type, reviewed. Owners are numbered from 1 without gaps. A city of status ok
    has a threshold and a larger, reviewed parent, any other neither; one merged at its resolution names
    another city, any other none; roots are reviewed; a match gives a Chinese name, and only a match does.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    size = cities.agg(F.count("*").alias("size"))
    known = cities.groupBy("city_id").agg(F.max("population").alias("their_population"), F.min(F.coalesce("reviewed", F.lit(False))).alias("their_review"), F.count("*").alias("same_id"))
    owners = cities.groupBy("owner_index").agg(F.count("*").alias("same_owner"))
    told = cities.join(known.select("city_id", "same_id"), "city_id").join(owners, "owner_index").join(F.broadcast(size))
    told = told.join(known.select(F.col("city_id").alias("parent_id"), "their_population", "their_review"), "parent_id", "left")
    told = told.join(known.select(F.col("city_id").alias("merged_into"), F.lit(True).alias("target")), "merged_into", "left")
    ok, merged = F.col("status") == "ok", F.col("status") == "merged_at_resolution"
    rules = {
        "identity": (F.col("same_id") > 1) | (F.col("same_owner") > 1) | ~F.col("owner_index").between(1, F.col("size")),
        "country name": blank("country_en") | blank("country_zh"),
        "name provenance": F.when(F.col("match_type") == "none", F.col("name_zh").isNotNull()).otherwise(blank("name_zh")),
        "threshold state": F.when(ok, F.col("threshold").isNull() | F.col("parent_id").isNull()).otherwise(F.col("threshold").isNotNull() | F.col("parent_id").isNotNull()),
        "merge state": merged != F.col("merged_into").isNotNull(),
        "parent": F.col("parent_id").isNotNull() & ~F.coalesce((F.col("their_population") > F.col("population")) & F.col("their_review"), F.lit(False)),
        "merge target": F.col("merged_into").isNotNull() & (F.col("target").isNull() | (F.col("merged_into") == F.col("city_id"))),
        "unreviewed root": F.col("status").isin("root", "no_larger_reachable") & ~F.coalesce("reviewed", F.lit(False)),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(broke, F.lit(True)), F.lit(rule)) for rule, broke in rules.items())), lambda rule: rule.isNotNull())
    return told.select(F.explode(broken).alias("rule"), "city_id")


def unreviewed_owners(cells: DataFrame, cities: DataFrame) -> DataFrame:
    """(level, owner, cells) of owners in published frames, cells (level, owner), that are no reviewed city (owner_index, reviewed); 0 and 65535 are nobody."""
    owned = cells.filter(~F.col("owner").isin(0, 65535)).groupBy("level", "owner").agg(F.count("*").alias("cells"))
    return owned.join(cities.filter("reviewed").select(F.col("owner_index").alias("owner")), "owner", "left_anti").select("level", "owner", "cells")


def share_violations(units: DataFrame, values: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(id, metric) of values (id, metric, value, share) whose unit is unknown, or whose share isn't value over the metric's total."""
    total = values.groupBy("metric").agg(F.sum("value").alias("total"))
    met = values.join(units.select("id", F.lit(True).alias("known")), "id", "left").join(total, "metric")
    wrong = F.col("known").isNull() | (F.abs(F.col("share") - F.col("value") / F.col("total")) > tolerance)
    return met.filter(wrong).select("id", "metric")


def top_of_rankings(rankings: DataFrame, k: int = 20) -> DataFrame:
    """(alpha, rank, focal_id, city_id, distance_km): the first k of each ranking."""
    return rankings.filter(F.col("rank") <= k).select("alpha", "rank", "focal_id", "city_id", "distance_km")
