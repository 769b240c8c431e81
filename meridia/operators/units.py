"""First-level units: where country and region rasters disagree, whose each cell is, and what the units are like."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.geo import EARTH_KM
from meridia.operators.assets import numbered
from meridia.operators.graph import cut
from meridia.operators.raster import row_weight
from meridia.operators.regions import component_sizes, raster_components, thickest_points


class Rule(NamedTuple):
    """A category for regions of one of the codes or countries, or named like the pattern; ``within`` (code, country) restricts it to that code in that country."""

    category: str
    codes: tuple[str, ...] = ()
    pattern: str | None = None
    countries: tuple[str, ...] = ()
    within: tuple[str, str] | None = None


#: Reviewed categories of disputed places, the first that fits counts.
CATEGORIES = (
    Rule("Kosovo", ("KOS", "KSV"), "Kosovo"),
    Rule("Northern Cyprus", ("CYN",), "Northern Cyprus"),
    Rule("Somaliland", ("SOL",), "Somaliland"),
    Rule("Crimea", (), "Crimea|Sevastopol"),
    Rule("Arunachal / 藏南", (), "Arunachal", within=("IND", "ne-156")),
    Rule("Aksai Chin", (), "Ladakh|Kashmir", within=("IND", "ne-156")),
    Rule("Bir Tawil", ("BRT",), None, ("ne-x-bir-tawil",)),
    Rule("Western Sahara", ("SAH", "WSH"), "Western Sahara", ("ne-732",)),
)


class Units(NamedTuple):
    """units: (label, unit_id, country, admin); cells: (r, c, lab, country); adjustments: what differs from the regions as given."""

    units: DataFrame
    cells: DataFrame
    adjustments: DataFrame


def category(code: Column, name: Column, country_id: Column, merged: tuple[str, ...] = ()) -> Column:
    """The category of a region by its code, name and the country it came to; regions of merged codes have one of their own, others none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in CATEGORIES:
        named = F.coalesce(name, F.lit("")).rlike(f"(?i){rule.pattern}") if rule.pattern else F.lit(False)
        fits = named | F.coalesce(code.isin(*rule.codes), F.lit(False)) | country_id.isin(*rule.countries)
        if rule.within:
            fits = fits & F.coalesce((code == rule.within[0]) & (country_id == rule.within[1]), F.lit(False))
        out = out.when(fits, F.lit(rule.category))
    return out.when(F.coalesce(code.isin(*merged), F.lit(False)), F.lit("merged territory"))


def cell_km2(r: Column, height: int, width: int) -> Column:
    return row_weight(r, height) * (2 * math.pi / width * EARTH_KM * EARTH_KM)


def overlap_share(held: DataFrame, height: int, width: int) -> DataFrame:
    """(overlap_km2, land_km2, share): one row, the area of cells that several countries (country, r, c) hold over that of all held; 0 without any."""
    area = cell_km2(F.col("r"), height, width)
    met = held.groupBy("r", "c").agg((F.min("country") != F.max("country")).alias("twice"))
    sums = met.agg(F.coalesce(F.sum(F.when(F.col("twice"), area)), F.lit(0.0)).alias("overlap_km2"), F.coalesce(F.sum(area), F.lit(0.0)).alias("land_km2"))
    return sums.select("overlap_km2", "land_km2", (F.col("overlap_km2") / F.greatest("land_km2", F.lit(1.0))).alias("share"))


def same_country_edges(cells: DataFrame, width: int, wraps: bool = True) -> DataFrame:
    """(country, admin, other, edges): cell edges between two regions of one country, told for either."""
    beside = (F.col("c") + 1) % width if wraps else F.col("c") + 1
    after = cells.select("country", F.col("admin").alias("other"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    sides = F.explode(F.array(F.struct(F.col("r").alias("r2"), beside.alias("c2")), F.struct((F.col("r") + 1).alias("r2"), F.col("c").alias("c2"))))
    met = cells.select("country", "admin", sides.alias("s")).select("country", "admin", "s.r2", "s.c2").join(after, ["country", "r2", "c2"]).filter("admin <> other")
    once = met.groupBy("country", "admin", "other").agg(F.count("*").alias("edges"))
    both = once.unionByName(once.select("country", F.col("other").alias("admin"), F.col("admin").alias("other"), "edges"))
    return both.groupBy("country", "admin", "other").agg(F.sum("edges").alias("edges"))


def classified(drawn: DataFrame, regions: DataFrame, countries: DataFrame, admins: DataFrame, height: int, width: int, least: float = 0.95, wraps: bool = True, merged: tuple[str, ...] = ()) -> Units:
    """Each country's cells dealt to its regions.

    drawn, regions: (r, c, lab), 0 for none; countries: (country, country_id); admins: (admin, country, code, adm0,
    name), country null where it is unknown. A region goes over to the country that holds most of it, the smaller
    label of equals, when that is not its own and holds ``least`` or more of its area. Cells of a country under a region
    that isn't its own, or under none, are remnants: they go to the region of the country that shares the most
    cell edges with them, then the largest, then the first by code; in a country without regions they are the
    whole country's own unit. Units are numbered from 1 by their ids (country:code). Areas are compared in whole
    square metres. Regions that are drawn but not listed count as unknown ones without a code: their cells are remnants.
    """
    if not 0.95 <= least <= 1:
        raise ValueError("a region goes over with 0.95 or more of its area")
    own = regions.filter("lab > 0").select("r", "c", F.col("lab").alias("admin"))
    cells = cut(drawn.filter("lab > 0").select("r", "c", F.col("lab").alias("country")).join(own, ["r", "c"], "left").withColumn("admin", F.coalesce("admin", F.lit(0))))
    area = F.round(F.sum(cell_km2(F.col("r"), height, width)), 6)
    pairs = cut(cells.groupBy("country", "admin").agg(area.alias("area_km2")))
    whole = own.groupBy("admin").agg(area.alias("whole_km2"))
    most = pairs.filter("admin > 0").groupBy("admin").agg(F.max_by(F.struct("country", "area_km2"), F.struct("area_km2", -F.col("country"))).alias("m")).select("admin", F.col("m.country").alias("most"), "m.area_km2")
    held = most.join(whole, "admin").join(admins.withColumnRenamed("country", "given"), "admin").withColumn("share", F.col("area_km2") / F.col("whole_km2"))
    goes = ~F.col("most").eqNullSafe(F.col("given")) & (F.round(F.col("area_km2") - least * F.col("whole_km2"), 6) >= 0)
    judged = cut(held.withColumn("goes", goes).withColumn("parent", F.when(F.col("goes"), F.col("most")).otherwise(F.col("given"))))
    eligible = cut(pairs.join(judged.select("admin", F.col("parent").alias("country"), "code"), ["country", "admin"]))
    # a remnant's neighbours among the regions that count, else the country's first
    order = lambda edges: F.struct(-edges, -F.col("area_km2"), F.col("code"))
    rest = pairs.join(eligible.select("country", "admin"), ["country", "admin"], "left_anti")
    sides = same_country_edges(cells, width, wraps).join(eligible.select("country", F.col("admin").alias("other"), "area_km2", "code"), ["country", "other"])
    near = sides.groupBy("country", "admin").agg(F.min_by(F.struct(F.col("other").alias("to"), "edges"), order(F.col("edges"))).alias("n")).select("country", "admin", F.col("n.to").alias("near"), "n.edges")
    firsts = eligible.groupBy("country").agg(F.min_by("admin", order(F.lit(0))).alias("first"))
    told = rest.join(near, ["country", "admin"], "left").join(firsts, "country", "left").withColumn("to", F.coalesce("near", "first", F.lit(0)))
    remnants = cut(told.select("country", "admin", "area_km2", "to", F.coalesce("edges", F.lit(0)).alias("edges")))
    into = eligible.select("country", "admin", F.col("admin").alias("to")).unionByName(remnants.select("country", "admin", "to"))
    named = into.select("country", "to").distinct().join(countries, "country").join(admins.select(F.col("admin").alias("to"), "code"), "to", "left")
    named = named.withColumn("unit_id", F.concat("country_id", F.lit(":"), F.when(F.col("to") == 0, F.lit("ADM0")).otherwise(F.col("code"))))
    units = cut(numbered(named.select("unit_id", "country", F.col("to").alias("admin")), "unit_id", "label", 1))
    labels = into.join(units.select("country", F.col("admin").alias("to"), F.col("label").alias("lab")), ["country", "to"]).select("country", "admin", "lab")
    dealt = cells.join(labels, ["country", "admin"]).select("r", "c", "lab", "country")

    transfers = judged.filter("goes").join(countries.select(F.col("country").alias("most"), "country_id"), "most")
    transfers = transfers.select("admin", F.lit("transfer").alias("kind"), "code", "adm0", "name", "country_id", F.lit(None).cast("string").alias("unit_id"), "area_km2", "share", F.lit(None).cast("long").alias("edges"))
    moved = remnants.filter("to > 0").join(units.select("country", F.col("admin").alias("to"), "unit_id"), ["country", "to"]).join(countries, "country").join(admins.drop("country"), "admin", "left")
    moved = moved.select("admin", F.lit("remnant").alias("kind"), "code", "adm0", "name", "country_id", "unit_id", "area_km2", F.lit(None).cast("double").alias("share"), "edges")
    every = transfers.unionByName(moved).withColumn("category", category(F.col("adm0"), F.col("name"), F.col("country_id"), merged))
    reason = F.when(F.col("kind") == "remnant", F.when(F.col("edges") > 0, "longest shared edge").otherwise("no shared edge"))
    return Units(units.select("label", "unit_id", "country", "admin"), dealt, every.withColumn("reason", reason).withColumn("needs_review", F.col("category").isNull()).drop("name"))


def described(cells: DataFrame, height: int, width: int, wraps: bool = True) -> DataFrame:
    """(lab, cells, area_km2, largest_km2, r, c, distance) of labelled cells (r, c, lab): sizes, the largest connected part's, and its cell farthest from a border."""
    labels = cut(cells.select("r", "c", F.col("lab").alias("v")))
    size = cell_km2(F.col("r"), height, width)
    sums = labels.groupBy("v").agg(F.count("*").alias("cells"), F.sum(size).alias("area_km2"))
    parts = component_sizes(raster_components(labels, width, wraps), height).filter("largest")
    points = thickest_points(labels, height, width, wraps)
    scale = 2 * math.pi / width * EARTH_KM * EARTH_KM
    return sums.join(parts.select("v", (F.col("area") * scale).alias("largest_km2")), "v").join(points, "v").withColumnRenamed("v", "lab")


def name_coverage(units: DataFrame, admins: DataFrame) -> DataFrame:
    """(units, named, whole_countries): one row, how many units have a Chinese name (admins: admin, name_zh) and how many are whole countries."""
    met = units.join(admins.select("admin", "name_zh"), "admin", "left")
    return met.agg(F.count("*").alias("units"), F.count_if(F.trim(F.coalesce("name_zh", F.lit(""))) != "").alias("named"), F.count_if(F.col("admin") == 0).alias("whole_countries"))
