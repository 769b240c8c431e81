"""Name records by country: grouping, precedence, coverage and display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed: the order in which sources are believed.
SOURCES = ("base", "supplement", "list", "manual")


def rank_one_or_unranked(records: DataFrame) -> DataFrame:
    """Rows of rank 1; where a country has none, its rows without a rank."""
    ranked = records.filter("rank = 1").select("country_id").distinct()
    return records.filter("rank = 1").unionByName(records.filter("rank is null").join(ranked, "country_id", "left_anti"))


def group_records(rows: DataFrame) -> DataFrame:
    """One record for each (country_id, name_group): first rank, forms in order without repeats, first count and share."""
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("f"))))), lambda x: x["f"]))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord")))
    return rows.groupBy("country_id", "name_group").agg(F.min("rank").alias("rank"), listed("local").alias("locals"), listed("latin").alias("latins"), first("count").alias("count"), first("share").alias("share"))


def with_precedence(sources: dict[str, DataFrame]) -> DataFrame:
    """The records of each country's most believed source that has any; base and supplement are both kept."""
    tagged = None
    for k, name in enumerate(SOURCES):
        if name in sources:
            part = sources[name].withColumn("source", F.lit(name)).withColumn("priority", F.lit(0 if name in SOURCES[:2] else k))
            tagged = part if tagged is None else tagged.unionByName(part)
    best = F.min("priority").over(Window.partitionBy("country_id"))
    return tagged.withColumn("best", best).filter("priority = best").drop("best", "priority")


def coverage_status(units: DataFrame, records: DataFrame) -> DataFrame:
    """(country_id, status): rank-one, no-source, manual or source-listed."""
    by = records.groupBy("country_id").agg(F.max((F.coalesce("rank", F.lit(0)) == 1).cast("int")).alias("one"), F.bool_and(F.col("source") == "manual").alias("manual"))
    status = F.when(F.col("one").isNull(), "no-source").when(F.col("one") == 1, "rank-one").when(F.col("manual"), "manual").otherwise("source-listed")
    return units.join(by, "country_id", "left").select("country_id", status.alias("status"))


def sovereign_units(units: DataFrame, records: DataFrame) -> DataFrame:
    """For each iso: its first unit, by ord, that has records, else its last."""
    has = units.join(records.select("country_id").distinct().withColumn("has", F.lit(True)), "country_id", "left")
    return has.groupBy("iso").agg(F.coalesce(F.min_by(F.when(F.col("has"), F.col("country_id")), F.when(F.col("has"), F.col("ord"))), F.max_by("country_id", "ord")).alias("country_id"))


def apply_overrides(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """A reviewed form comes first among a record's Latin forms, once. overrides: country_id, name_group, reviewed."""
    met = records.join(F.broadcast(overrides), ["country_id", "name_group"], "left")
    forms = F.when(F.col("reviewed").isNull(), F.col("latins")).otherwise(F.concat(F.array("reviewed"), F.filter("latins", lambda e: e != F.col("reviewed"))))
    return met.withColumn("latins", forms).drop("reviewed")


def display_record(records: Column) -> Column:
    """Of an array of records: the first of rank 1, else the first, else null."""
    return F.coalesce(F.get(F.filter(records, lambda r: r["rank"] == 1), F.lit(0)), F.get(records, F.lit(0)))


def display_form(local: Column, latin: Column, chinese: Column, mode: str) -> dict[str, Column]:
    """The form for a mode, the others in their order where it is blank, and whether that happened."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    forms = {"local": filled(local), "latin": filled(latin), "chinese": filled(chinese)}
    wanted = forms.pop(mode)
    return {"form": F.coalesce(wanted, *forms.values()), "fell_back": wanted.isNull() & F.coalesce(*forms.values()).isNotNull()}
