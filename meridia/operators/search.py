"""Ranked name search, name choice and matching."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import EARTH_KM, haversine_km
from meridia.functions.text import normalize, normalize_all, token_starts_with
from meridia.operators.nearest import P, T, around, cube_at, with_vector

EXACT_KM, NEAR_KM = 50.0, 30.0


def search(cities: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """The best cities for a query: exact names, exact aliases, prefixes, word prefixes, substrings, then places.

    cities: city_id, name, aliases (array), place, feature_rank, population. Below two characters a
    query without Han characters finds nothing.
    """
    q = normalize(F.lit(query))
    name, place = normalize(F.col("name")), normalize(F.col("place"))
    scored = cities.withColumn("q", q).withColumn("_n", name).withColumn("_p", place).withColumn("_a", normalize_all(F.col("aliases")))
    q, n, a = F.col("q"), F.col("_n"), F.col("_a")
    score = (
        F.when(n == q, 0).when(F.array_contains(a, q), 1).when(F.startswith(n, q), 2).when(F.exists(a, lambda x: F.startswith(x, q)), 3)
        .when(token_starts_with(n, q) | F.exists(a, lambda x: token_starts_with(x, q)), 4)
        .when(F.contains(n, q) | F.exists(a, lambda x: F.contains(x, q)), 5).when(F.contains(F.col("_p"), q), 6)
    )
    enough = (F.length(q) >= 2) | F.regexp_like(q, F.lit("\\p{IsHan}"))
    hits = scored.withColumn("score", F.when(enough, score)).filter("score is not null")
    return hits.orderBy("score", "feature_rank", F.col("population").desc(), "name", "city_id").limit(limit).select("city_id", "name", "score", "population")


def localized_names(names: DataFrame) -> DataFrame:
    """(id, name_en, name_zh) from (id, name_id, lang, name, preferred): preferred ones first, then by language, id and name.

    An English name may be in any of en and its variants; a Chinese one must have Han characters.
    """
    rank = F.when(F.col("lang").isin("en", "zh-Hans", "zh-CN"), 0).when(F.col("lang").isin("en-GB", "zh"), 1).otherwise(2)
    key = F.struct((~F.col("preferred")).alias("p"), rank.alias("l"), "name_id", "name")
    best = lambda want: F.min_by(F.when(want, F.col("name")), F.when(want, key))
    return names.groupBy("id").agg(best(F.startswith("lang", F.lit("en"))).alias("name_en"), best(F.startswith("lang", F.lit("zh")) & F.regexp_like("name", F.lit("\\p{IsHan}"))).alias("name_zh"))


def select_aliases(names: DataFrame, most_en: int = 2) -> DataFrame:
    """(id, name) from (id, name, kind, ord): canonical, ascii, at most two further English and all Chinese names, one of each normalised form."""
    kind = F.when(F.col("kind") == "canonical", 0).when(F.col("kind") == "ascii", 1).when(F.col("kind") == "en", 2).otherwise(3)
    order = ["rank", "ord", "name"]
    rows = names.withColumn("rank", kind).withColumn("form", normalize(F.col("name")))
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "form").orderBy(*order))).filter("n = 1")
    within = F.row_number().over(Window.partitionBy("id", "rank").orderBy("ord", "name"))
    return once.withColumn("within", within).filter((F.col("rank") != 2) | (F.col("within") <= most_en)).select("id", "name", "rank")


def match_names(cities: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """(city_id, match, kind): an override, else an equal name within 50 km, else for review the largest within 30 km, else none.

    Equal names: by distance, larger population, id; near ones: larger population, distance, id. Either are
    found by cubes of space wider than the distance: a candidate is in the 27 around it, a city in its own.
    """
    c = with_vector(candidates.select(F.col("cand_id"), normalize(F.col("cand_name")).alias("form"), "cand_lat", "cand_lon", "cand_population"), "cand_lat", "cand_lon", T)
    base = with_vector(cities.select("city_id", "lat", "lon", normalize(F.col("name")).alias("form")), "lat", "lon", P)

    def within(limit: float, theirs: DataFrame, on: list[str]) -> DataFrame:
        level = F.lit(math.floor(-math.log2(2 * math.sin(limit / 2 / EARTH_KM) * (1 + 1e-6))))
        asked = base.select("city_id", "lat", "lon", *on, cube_at(P, level).alias("cube"))
        met = asked.join(around(theirs.withColumn("level", level), T).drop("level", *T), ["cube", *on])
        return met.withColumn("d", F.round(haversine_km("lat", "lon", "cand_lat", "cand_lon"), 6)).filter(F.col("d") <= limit)

    named = within(EXACT_KM, c, ["form"]).groupBy("city_id").agg(F.min_by("cand_id", F.struct("d", -F.col("cand_population"), "cand_id")).alias("exact"))
    near = within(NEAR_KM, c.drop("form"), []).groupBy("city_id").agg(F.min_by("cand_id", F.struct(-F.col("cand_population"), "d", "cand_id")).alias("near"))
    met = cities.select("city_id").join(overrides, "city_id", "left").join(named, "city_id", "left").join(near, "city_id", "left")
    kind = F.when(F.col("override").isNotNull(), "override").when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "review").otherwise("none")
    return met.select("city_id", F.coalesce("override", "exact", "near").alias("match"), kind.alias("kind"))


def eligible(cities: DataFrame) -> DataFrame:
    """Populated places that are capitals, first-order seats or have 100 000 people."""
    codes = ("PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLG")
    return cities.filter((F.col("feature_class") == "P") & F.col("feature_code").isin(*codes) & (F.col("feature_code").isin("PPLC", "PPLA") | (F.col("population") >= 100_000)))


def with_required(cities: DataFrame, countries: DataFrame, admins: DataFrame) -> DataFrame:
    """Cities whose country and admin1 (country.code) both exist."""
    keyed = cities.withColumn("admin_key", F.concat_ws(".", "country_code", "admin1"))
    return keyed.join(countries.select("country_code"), "country_code", "left_semi").join(admins.select("admin_key"), "admin_key", "left_semi")


def name_groups(cities: DataFrame) -> DataFrame:
    """Normalised names that several cities have, with how many and in how many countries."""
    return cities.groupBy(normalize(F.col("name")).alias("form")).agg(F.count("*").alias("cities"), F.count_distinct("country_id").alias("countries")).filter("cities > 1")
