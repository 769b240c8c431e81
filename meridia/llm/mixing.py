"""Mixing sources to target weights by the cube method.

A source's target over its size gives every document of it the expected number of copies; the whole
part is certain, the fractional part an inclusion probability. The flight phase moves probabilities
within the null space of two constraints, documents and tokens, so both totals stay as expected, and
leaves at most two open documents a block. Blocks hold a bounded number of documents of one source;
the open documents of all blocks form new blocks, until one is left for each source. Its few open
documents are the landing problem: their probabilities are taken apart into the best balanced outcomes,
of which one is drawn, so every document keeps its probability to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.textops import SPACED_WORD, Scratch, text_key, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
_ROW = pa.schema([("source", pa.string()), ("sk", pa.int64()), ("doc", pa.int64()), ("tk", pa.int64()), ("copy", pa.int64()), ("size", pa.int64()), ("p", pa.float64())])
_ROW_DDL = "source string, sk long, doc long, tk long, copy long, size long, p double"
_OPEN = 1e-9


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(SPACED_WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources by code point, null last.

    All targets make ``share`` of all sizes. One above ``most`` times its source's size stops there and the
    excess goes to the others by weight, until none is above: the least limit over weight fills first.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row for each source from here on
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("goal", F.sum("source_size").over(everything) * share)
    ranked = ranked.withColumn("left", F.col("goal") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.col("left") / F.col("open"))
    # in this order sources are full up to some place; from there on one level holds for all
    ranked = ranked.withColumn("level", F.first(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", target.alias("target"))


def fly(sizes: np.ndarray, p: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """The cube method's flight with rows (1, size): at most two probabilities stay open.

    Units should come by falling size, so that those that stay open are small. luck: a uniform
    number for each step, at most one a unit.
    """
    p = p.copy()
    open_: list[int] = []
    values, weights, lucky = p.tolist(), sizes.tolist(), iter(luck.tolist())
    for k in range(len(values)):
        if not _OPEN < values[k] < 1 - _OPEN:
            values[k] = float(round(values[k]))
            continue
        open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            x, y, z = weights[a], weights[b], weights[c]
            u = (z - y, x - z, y - x)
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = down = float("inf")  # the farthest both ways along u
            for j, d in zip(open_, u):
                if d:
                    v = values[j]
                    up, down = min(up, (1 - v) / d if d > 0 else v / -d), min(down, v / d if d > 0 else (1 - v) / -d)
            step = up if next(lucky) * (up + down) < down else -down
            for j, d in zip(open_, u):
                values[j] += step * d
            still = []
            for j in open_:
                if _OPEN < values[j] < 1 - _OPEN:
                    still.append(j)
                else:
                    values[j] = float(round(values[j]))
            open_ = still
    return np.array(values)


def land(sizes: np.ndarray, p: np.ndarray, luck: float, near: float = 2.0) -> np.ndarray:
    """An outcome of a few open units, drawn so that each is in with its own probability.

    The probabilities are taken apart into whole outcomes: again and again the one whose tokens come
    nearest to what is expected (of those within ``near`` tokens, the one that can have the largest
    share) gets all the share it can, until what remains is whole too. One of these few is drawn.
    """
    outcomes = (np.arange(1 << len(p))[:, None] >> np.arange(len(p)) & 1).astype(float)
    left, goal = p.astype(float), float(sizes @ p)
    tokens = outcomes @ sizes
    while True:
        open_ = (left > _OPEN) & (left < 1 - _OPEN)
        if not open_.any():
            return np.round(left)
        fits = (outcomes[:, ~open_] == np.round(left[~open_])).all(axis=1)
        some, off = outcomes[fits], np.abs(tokens[fits] - goal)
        most = np.where(some[:, open_] == 1, left[open_], 1 - left[open_]).min(axis=1)
        good = np.flatnonzero(off <= max(off.min(), near))
        k = good[np.lexsort((off[good], -most[good]))[0]]
        if luck < most[k] or most[k] >= 1 - _OPEN:
            return some[k]
        luck = (luck - most[k]) / (1 - most[k])
        left = np.clip((left - most[k] * some[k]) / (1 - most[k]), 0, 1)
        goal = float(sizes @ left)


def _by_source_block(rows: DataFrame, block: Column, last: bool, landing: int) -> DataFrame:
    """The flight in each (source, block); with last, the landing too."""

    def run(table: pa.Table) -> pa.Table:
        size, p = table["size"].to_numpy(), table["p"].to_numpy()
        order = np.lexsort((table["copy"].to_numpy(), table["tk"].to_numpy(), table["doc"].to_numpy(), -size))
        seed = int(np.bitwise_xor.reduce(table["doc"].to_numpy().view(np.uint64))) & 0x7FFFFFFF
        luck = np.random.default_rng(seed).random(len(order) + 1)
        flown = p.copy()
        if last and len(order) > landing:
            # units of all sizes stay for the landing, whose outcomes then lie densely
            tail = order[np.linspace(0, len(order) - 1, landing).astype(int)]
            head = order[~np.isin(order, tail)]
            flown[head] = fly(size[head], p[head], luck)
            rest = np.concatenate([head[(flown[head] > 0) & (flown[head] < 1)], tail])
        elif last:
            rest = order
        else:
            flown[order] = fly(size[order], p[order], luck)
        if last:
            rest = rest[(flown[rest] > _OPEN) & (flown[rest] < 1 - _OPEN)]
            if len(rest):
                flown[rest] = land(size[rest].astype(float), flown[rest], luck[-1])
            flown = np.round(flown)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(flown)).select(_ROW.names).cast(_ROW)

    return rows.withColumn("block", block).groupBy("sk", "block").applyInArrow(run, _ROW_DDL)


def cube_sample(units: DataFrame, scratch: Scratch, block_rows: int = 5_000, landing: int = 14) -> DataFrame:
    """units (source, sk, doc, tk, copy, size, p) with p moved to 0 or 1 for every row."""
    counts = units.groupBy("sk").agg(F.count("*").alias("n"))
    level, done = 0, None
    largest = counts.agg(F.max("n")).first()[0] or 0
    while True:
        last = largest <= block_rows
        blocks = 1 if last else -(-largest // block_rows)
        # more blocks than a small source needs are harmless: its open units meet in the next level
        block = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(level), "doc", "tk", "copy"), F.lit(blocks))
        flown = scratch.keep(_by_source_block(units, block, last, landing), f"flight-{level}")
        ready = flown.filter((F.col("p") <= 0) | (F.col("p") >= 1))
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        units = flown.filter((F.col("p") > 0) & (F.col("p") < 1))
        largest = units.groupBy("sk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        level += 1


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block_rows: int = 5_000) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies and taken (copies times size).

    A null or empty text has size 0 and is taken 0 times. A null source is a source of its own, the last;
    sources without words have target 0. Rows alike in doc_id and text are numbered and drawn one by one,
    in an order that doesn't matter as they are alike. Draws depend on doc_id and text only, so reruns
    agree. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    sizes = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), doc.alias("doc"), F.coalesce(text_key(), F.lit(0)).alias("tk"), word_count().alias("size"))
    sizes = scratch.keep(sizes, "sizes")
    targets = scratch.keep(source_targets(sizes.select("source", "size"), weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target", ratio.alias("r"), F.coalesce(F.xxhash64("source"), F.lit(0)).alias("sk"))
    twins = Window.partitionBy("doc", "tk", "source").orderBy("size")
    units = sizes.withColumn("copy", F.row_number().over(twins).cast("long")).join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    units = scratch.keep(units.withColumn("p", F.when(F.col("size") > 0, F.col("r") - F.floor("r")).otherwise(0.0)), "units")
    scratch.drop("sizes", "targets")
    drawn = cube_sample(units.filter("p > 0").select(*_ROW.names), scratch, block_rows)
    picked = drawn.filter("p > 0.5").select("source", "doc", "tk", "copy", F.lit(1).alias("more"))
    p = picked.select(F.col("source").alias("_s"), F.col("doc").alias("_d"), F.col("tk").alias("_t"), F.col("copy").alias("_c"), "more")
    same = units["source"].eqNullSafe(p["_s"]) & (units["doc"] == p["_d"]) & (units["tk"] == p["_t"]) & (units["copy"] == p["_c"])
    copies = F.when(F.col("size") > 0, F.floor("r") + F.coalesce("more", F.lit(0))).otherwise(0).cast("long")
    out = units.join(p, same, "left").withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "tk", "copy")


def repeat_mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs, with all their columns, each row as often as the mix takes it; rows without words are not taken.

    Nulls, repeats and empty tables count as in ``mix_sources``; columns of any names stay as they are.
    """
    mix = "_mix"
    while any(c.startswith(mix) for c in docs.columns):
        mix += "_"
    drawn = mix_sources(docs, weights, share, most).filter("copies > 0")
    picked = drawn.select(*(F.col(c).alias(f"{mix}_{c}") for c in ("doc_id", "tk", "source", "copy", "copies")))
    rows = docs
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{mix}_doc_id")) & (F.coalesce(text_key(), F.lit(0)) == F.col(f"{mix}_tk")) & docs["source"].cast("string").eqNullSafe(F.col(f"{mix}_source"))
    if drawn.filter("copy > 1").limit(1).count():  # rows alike are told apart by number, which takes another shuffle
        alike = Window.partitionBy(docs["doc_id"].cast("long"), text_key(), docs["source"].cast("string")).orderBy(docs["doc_id"])
        rows = docs.withColumn(f"{mix}_row", F.row_number().over(alike))
        same = same & (F.col(f"{mix}_row") == F.col(f"{mix}_copy"))
    met = rows.join(picked, same)
    return met.withColumn(f"{mix}_nth", F.explode(F.sequence(F.lit(1), F.col(f"{mix}_copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
