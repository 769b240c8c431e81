"""Writers: published sets, dictionary-encoded rows, cached computations."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.assets import numbered


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> None:
    """Write a set of tables so that readers see all of it or none: staged beside the target, then renamed.

    The set before is kept until the new one stands, and put back if that fails.
    """
    stage, old = f"{target}.stage-{uuid.uuid4().hex[:8]}", f"{target}.old-{uuid.uuid4().hex[:8]}"
    fs, at = _fs(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}.parquet")
        had = fs.exists(at)
        if had and not fs.rename(at, path(old)):
            raise OSError(f"{target} can't be moved")
        if not fs.rename(path(stage), at):
            if had:
                fs.rename(path(old), at)
            raise OSError(f"{target} can't be published")
        fs.delete(path(old), True)
    finally:
        fs.delete(path(stage), True)


def dictionary_encode(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(strings, coded): the distinct strings of the columns with their positions in order, and rows that refer to them."""
    words = None
    for c in columns:
        part = rows.select(F.col(c).alias("string"))
        words = part if words is None else words.unionByName(part)
    strings = numbered(words.filter("string is not null").distinct(), "string", "position", 0)
    coded = rows
    for c in columns:
        coded = coded.join(strings.select(F.col("string").alias(c), F.col("position").alias(f"{c}_ref")), c, "left").drop(c)
    return strings, coded


def write_index(strings: DataFrame, rows: DataFrame, path: str, key: str, row: Column) -> None:
    """One JSON document {formatVersion, strings, rows}, an item a line, whose pieces in the order of their names are the files of a folder.

    strings (position, string) as of ``dictionary_encode``; rows in the order of key, each the array of strings that row makes.
    """
    spark = rows.sparkSession
    frame = spark.createDataFrame([(0, 0, '{"formatVersion":2,"strings":['), (2, 0, '],"rows":['), (4, 0, "]}")], "section int, at long, value string")
    comma = lambda at: F.when(F.col(at) > 0, ",").otherwise("")
    words = F.to_json(F.array("string"))
    items = strings.select(F.lit(1).alias("section"), F.col("position").cast("long").alias("at"), F.concat(comma("position"), F.substr(words, F.lit(2), F.length(words) - 2)).alias("value"))
    numbers = numbered(rows.select(F.col(key).alias("_key"), F.to_json(row).alias("_value")), "_key", "_at", 0)
    entries = numbers.select(F.lit(3).alias("section"), F.col("_at").cast("long").alias("at"), F.concat(comma("_at"), "_value").alias("value"))
    whole = frame.unionByName(items).unionByName(entries)
    whole.repartitionByRange("section", "at").sortWithinPartitions("section", "at").select("value").write.option("lineSep", "\n").text(path)


def metric_maps(values: DataFrame) -> DataFrame:
    """(id, metrics): a map of each id's metric values."""
    return values.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def computation_id(**parts) -> str:
    """A name for a result, from what it depends on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached(spark: SparkSession, folder: str, identity: str, compute) -> DataFrame:
    """The result stored under its identity, else computed, stored and read; only a completed write counts."""
    path = f"{folder}/id={identity}"
    fs, _ = _fs(spark, path)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_levels(df: DataFrame, path: str) -> None:
    """Rasters by level, a folder each, so that readers of one level read no other."""
    df.write.partitionBy("level").parquet(path)


def resolve_status(cities: DataFrame, disputed: DataFrame) -> DataFrame:
    """status, or disputed for the cities listed."""
    listed = disputed.select("city_id").distinct().withColumn("_d", F.lit(True))
    return cities.join(listed, "city_id", "left").withColumn("status", F.when(F.col("_d"), "disputed").otherwise(F.col("status"))).drop("_d")
