"""Nearest-rank percentiles, frame statistics, rankings and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.graph import cut


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...], by: str | None = None) -> DataFrame:
    """The smallest value with at least the share of rows at or below it.

    Over all rows equal values are counted first; ranks are sums within ranges plus those of the ranges before,
    so no task holds all values. With ``by``, a key's values are one task's.
    """
    if by:
        return df.groupBy(by).agg(F.count(value).alias("n"), *(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("double").alias(f"p{round(p * 100)}") for p in shares))
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("m"))
    placed = cut(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum("m").alias("size"))
    before = sizes.select("_part", (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("before"))  # a row for each partition
    upto = F.col("before") + F.sum("m").over(Window.partitionBy("_part").orderBy(value))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"))
    ranked = placed.join(F.broadcast(before), "_part").withColumn("upto", upto).crossJoin(F.broadcast(total))
    least = (F.min(F.when(F.col("upto") >= p * F.col("n"), F.col(value))).cast("double").alias(f"p{round(p * 100)}") for p in shares)
    return total.crossJoin(ranked.agg(*least))


def area_errors(units: DataFrame, least_share: float = 0.0) -> DataFrame:
    """(n, p50, p90, worst) of |actual - target| over the target's size, for units (target, actual, share).

    A missing actual is infinitely wrong; a unit without a target doesn't count; a missing share is 1.
    """
    off = F.coalesce(F.abs(F.col("actual") - F.col("target")) / F.greatest(F.abs("target"), F.lit(1e-12)), F.lit(float("inf")))
    wrong = units.filter((F.coalesce("share", F.lit(1.0)) >= least_share) & F.col("target").isNotNull()).select(off.alias("error"))
    return nearest_rank(wrong, "error", (0.5, 0.9)).crossJoin(wrong.agg(F.max("error").alias("worst")))


def largest_errors(units: DataFrame, k: int = 10) -> DataFrame:
    return units.withColumn("error", F.round(F.col("actual") / F.col("target") - 1, 9)).orderBy(F.abs("error").desc_nulls_last(), "id").limit(k).select("id", "error")


def frame_stats(ticks: DataFrame, by: str, at_ms: str, slow_ms: float = 25.0) -> DataFrame:
    """Ticks of each key, their duration and rate; the intervals' median, 95th percentile and longest, and the percentage above slow_ms.

    Keys with one tick, or with all at one time, have no row.
    """
    gaps = ticks.withColumn("gap", F.col(at_ms) - F.lag(at_ms).over(Window.partitionBy(by).orderBy(at_ms)))
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY gap)").cast("double")
    whole = F.sum("gap")
    out = gaps.groupBy(by).agg(
        F.count("*").alias("frames"), whole.cast("double").alias("duration_ms"), F.round(1000.0 * F.count("gap") / F.nullif(whole, F.lit(0)), 6).alias("fps"), disc(0.5).alias("p50"), disc(0.95).alias("p95"),
        F.max("gap").cast("double").alias("longest"), F.round(F.avg((F.col("gap") > slow_ms).cast("double")) * 100, 6).alias("slow_percent"),
    )
    return out.filter("duration_ms > 0")


def top_with_selected(df: DataFrame, key: str, value: str, selected, k: int = 10) -> DataFrame:
    """The k largest, nulls left out, and the selected row if it isn't among them; ties by key."""
    ranked = df.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).desc(), key)))
    top = ranked.filter(F.col("rank") <= k)
    return top.unionByName(ranked.filter((F.col(key) == selected) & (F.col("rank") > k)))


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties: the smaller."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value), F.max("n").alias("votes"), F.sum("n").alias("cells"))


def cumulative_core(pixels: DataFrame, by: str, order: list, area: str, target: str) -> DataFrame:
    """Pixels taken in order until their area reaches the key's target are its core; the rest is padding."""
    run = F.sum(area).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return pixels.withColumn("core", F.coalesce(run, F.lit(0)) < F.col(target))


def stop_reasons(history: DataFrame, key: str = "metric", gain: float = 0.005, most_rounds: int = 16) -> DataFrame:
    """(key, round, reason) of (key, round, p50, p90): why an iteration would stop after each round, null where it goes on.

    raw-pass: the median error is below 5 % and the 90th percentile below 15 %. plateau: three rounds in
    a row gained less than ``gain`` in the 90th percentile. max-rounds: the last round allowed.
    """
    w = Window.partitionBy(key).orderBy("round")  # a key has at most most_rounds rows
    last = lambda k: F.lag("p90", k).over(w) if k else F.col("p90")
    flat = (last(1) - last(0) < gain) & (last(2) - last(1) < gain) & (last(3) - last(2) < gain)
    reason = F.when((F.col("p50") < 0.05) & (F.col("p90") < 0.15), "raw-pass").when(flat, "plateau").when(F.col("round") >= most_rounds, "max-rounds")
    return history.select(key, "round", reason.alias("reason"))


def assert_empty(df: DataFrame, what: str) -> None:
    """Raise with one example if df has rows."""
    row = df.first()
    if row is not None:
        raise ValueError(f"{what}: {row.asDict()}")


def city_asset_violations(cities: DataFrame) -> DataFrame:
    """(city_id, rule) of owners (owner, city_id, population, status, threshold, parent): numbering, statuses, and parents that aren't larger."""
    parents = cities.select(F.col("city_id").alias("parent"), F.col("population").alias("parent_population"))
    met = cities.withColumn("n", F.row_number().over(Window.orderBy("city_id"))).join(parents, "parent", "left")
    rules = F.array(
        F.when(F.col("n") != F.col("owner"), "owner numbers follow ids"),
        F.when((F.col("status") == "ok") & F.col("threshold").isNull(), "a reached city has a threshold"),
        F.when((F.col("status") != "ok") & F.col("threshold").isNotNull(), "only reached cities have a threshold"),
        F.when(F.col("parent").isNotNull() & F.col("parent_population").isNull(), "a parent exists"),
        F.when(F.col("parent_population") <= F.col("population"), "a parent is larger"),
    )
    return met.select("city_id", F.explode(F.array_compact(rules)).alias("rule"))
