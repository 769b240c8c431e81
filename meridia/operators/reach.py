"""Travel over a friction grid: edges, ownership by offset costs, thresholds and territories."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.geo import haversine_km
from meridia.functions.scalars import travel_hours
from meridia.operators.graph import components, cut, forget, kept
from meridia.operators.raster import Grid, cell_of, neighbour_pairs

DEGREE_M = 111_194.92664455873
MOST_ROUNDS = 8  #: rounds whose tiles are read beside the others'; then all newest states become one table


def _length_m(grid: Grid) -> Column:
    """Between the centres of neighbouring cells: along a row at its latitude, along a column, or across at the mean of both."""
    lat = lambda r: grid.north - (F.col(r) + 0.5) * grid.step
    dx = (F.cos(F.radians(lat("r"))) + F.cos(F.radians(lat("r2")))) / 2 * grid.step * DEGREE_M
    dy = F.lit(grid.step * DEGREE_M)
    return F.when(F.col("r") == F.col("r2"), dx).when(F.col("c") == F.col("c2"), dy).otherwise(F.sqrt(dx * dx + dy * dy))


def grid_edges(friction: DataFrame, grid: Grid) -> DataFrame:
    """(a, b, hours) between neighbouring cells with friction; a cell's number is r * width + c."""
    pairs = neighbour_pairs(friction.filter("v > 0"), grid)
    number = lambda r, c: (F.col(r) * grid.width + F.col(c)).cast("long")
    return pairs.select(number("r", "c").alias("a"), number("r2", "c2").alias("b"), travel_hours(F.col("v"), F.col("v2"), _length_m(grid)).alias("hours"))


def city_ranks(cities: DataFrame) -> DataFrame:
    """Larger population first, then id: the position in range-sorted partitions, plus the rows of the partitions before."""
    placed = cut(cities.repartitionByRange(F.col("population").desc(), "city_id").sortWithinPartitions(F.col("population").desc(), "city_id").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).drop("n")  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("population").desc(), "city_id"))
    return placed.withColumn("_within", within).join(F.broadcast(before), "_part").select(*cities.columns, (F.col("before") + F.col("_within")).cast("int").alias("rank"))


def _source_cells(footprints: DataFrame, cities: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, city_id) of all footprints, the larger city first; (city_id, node, route) of those on land; and those kept, of a city's main country."""
    sized = footprints.join(cities.select("city_id", "population"), "city_id")
    drawn = cut(sized.groupBy("node").agg(F.max_by("city_id", F.struct("population", -F.col("city_id"))).alias("city_id")))
    raw = drawn.join(cells.select("node", "route"), "node")
    routes = raw.groupBy("city_id", "route").agg(F.count("*").alias("n")).groupBy("city_id").agg(F.max_by("route", F.struct("n", -F.col("route"))).alias("route"))
    return drawn, raw, cut(raw.join(routes, ["city_id", "route"], "left_semi").select("city_id", "node", "route"))


def city_sources(footprints: DataFrame, cities: DataFrame, cells: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """The cities with their centre cell, and (city_id, node) of the cells that each starts from.

    footprints: (city_id, node). Where footprints overlap the larger city has the cell, then the
    smaller id. cells: (node, route) of land; a city keeps the cells of the route country that most of
    its cells have, the smaller number at a tie. Its centre moves to the nearest cell kept where it has
    lost its own; a city without cells names the one that has its centre's (merged_into), if any.
    """
    drawn, raw, kept = _source_cells(footprints, cities, cells)
    at = cell_of(F.col("lat"), F.col("lon"), grid)
    placed = cities.withColumn("own", (at["r"] * grid.width + at["c"]).cast("long"))
    dr = F.floor(F.col("node") / grid.width) - ((grid.north - F.col("lat")) / grid.step - 0.5)
    dc = F.abs(F.col("node") % grid.width - ((F.col("lon") - grid.west) / grid.step - 0.5))
    dc = F.least(dc, grid.width - dc) if grid.wraps else dc
    centres = placed.join(kept, "city_id").groupBy("city_id").agg(F.min_by("node", F.struct((F.col("node") != F.col("own")).alias("moved"), (dr * dr + dc * dc).alias("d"), "node")).alias("centre"))
    owners = drawn.select(F.col("node").alias("own"), F.col("city_id").alias("owner"))
    out = placed.join(centres, "city_id", "left").join(owners, "own", "left")
    merged = F.when(F.col("centre").isNull() & (F.col("owner") != F.col("city_id")), F.col("owner"))
    return out.select(*cities.columns, "centre", merged.alias("merged_into")), kept.select("city_id", "node")


def source_clipping(footprints: DataFrame, cities: DataFrame, cells: DataFrame, people: DataFrame, grid: Grid) -> DataFrame:
    """What cities lose where their footprint lies in several countries; one row for each that loses cells.

    (city_id, route, before, retained, removed, removed_people, removed_missing, shift_km): the country kept,
    cells before, kept and lost, the people (node, people) of the lost ones, those without a figure, and how
    far the centre's cell is from the city's place.
    """
    placed, kept = city_sources(footprints, cities, cells, grid)
    _, raw, own = _source_cells(footprints, cities, cells)
    own = own.withColumn("kept", F.lit(True))
    marked = raw.join(own, ["city_id", "node", "route"], "left").join(people, "node", "left")
    lost = F.col("kept").isNull()
    sums = marked.groupBy("city_id").agg(
        F.max(F.when(~lost, F.col("route"))).alias("route"),
        F.count("*").alias("before"),
        F.count("kept").alias("retained"),
        F.count_if(lost).alias("removed"),
        F.coalesce(F.sum(F.when(lost, F.col("people"))), F.lit(0)).alias("removed_people"),
        F.count_if(lost & F.col("people").isNull()).alias("removed_missing"),
    )
    lat = grid.north - (F.expr(f"centre div {grid.width}") + 0.5) * grid.step
    lon = grid.west + (F.col("centre") % grid.width + 0.5) * grid.step
    shift = placed.select("city_id", haversine_km("lat", "lon", lat, lon).alias("shift_km"))
    return sums.filter("removed > 0").join(shift, "city_id")


def seeds(cities: DataFrame, sources: DataFrame, level: float) -> DataFrame:
    """(node, cost, rank, population, city_id): a city of population p starts level * (log of the largest - log p) hours late, in base ten."""
    top = cities.agg(F.max("population").alias("top"))
    late = level * (F.log10("top") - F.log10("population"))
    ranked = city_ranks(cities.select("city_id", "population")).crossJoin(F.broadcast(top)).select("city_id", late.alias("cost"), "rank", "population")
    return sources.select("city_id", "node").join(ranked, "city_id").select("node", "cost", "rank", F.col("population").cast("double").alias("population"), "city_id")


_LABEL = np.dtype([("node", "<i8"), ("cost", "<f8"), ("rank", "<i8"), ("population", "<f8"), ("city_id", "<i8")])
_EDGE = np.dtype([("a", "<i8"), ("b", "<i8"), ("hours", "<f8"), ("tile", "<i8")])


def _tile(node: Column, width: int, side: int) -> Column:
    across = -(-width // side)
    return (F.floor(F.floor(node / width) / side) * across + F.floor((node % width) / side)).cast("long")


def _packed(df: DataFrame, kind: np.dtype) -> DataFrame:
    """(tile, packed): the rows of each tile, of which a tile bounds the number, as one binary value."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.empty(len(pdf), kind)
        for name in kind.names:
            out[name] = pdf["to" if name == "tile" else name].to_numpy()
        return pd.DataFrame({"tile": pdf["tile"].iloc[:1], "packed": [out.tobytes()]})

    return df.groupBy("tile").applyInPandas(pack, "tile long, packed binary")


def spread_tile(edges: np.ndarray, had: np.ndarray, come: np.ndarray, single: bool) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Labels of a tile's nodes after new ones have come, and those that go on to other tiles.

    Labels are taken by cost, then rank, and stay unless one that the node has is as good. With
    single, a node keeps its first; else a label is as good only if its city is also as large.
    """
    order = np.argsort(edges["a"], kind="stable")
    a, b, hours, to = (edges[k][order] for k in ("a", "b", "hours", "tile"))
    firsts = {int(n): i for n, i in zip(*np.unique(a, return_index=True))}
    b, hours, to, ends = b.tolist(), hours.tolist(), to.tolist(), np.append(np.flatnonzero(np.diff(a)) + 1, len(a)).tolist()
    last = dict(zip(sorted(firsts), ends))
    held: dict[int, list[tuple]] = {}
    for n, *label in had.tolist():
        held.setdefault(n, []).append(tuple(label))
    heap = [(cost, rank, n, size, city) for n, cost, rank, size, city in come.tolist()]
    heapq.heapify(heap)
    away: dict[int, dict] = {}

    def as_good(x: tuple, y: tuple) -> bool:
        if single:
            return x[:2] <= y[:2]
        return x[0] <= y[0] and x[2] >= y[2] and not (x[0] == y[0] and x[2] == y[2] and x[1] > y[1])

    while heap:
        cost, rank, n, size, city = heapq.heappop(heap)
        label, mine = (cost, rank, size, city), held.setdefault(n, [])
        if any(as_good(x, label) for x in mine):
            continue
        held[n] = [x for x in mine if not as_good(label, x)] + [label]
        if n not in firsts:
            continue
        for k in range(firsts[n], last[n]):
            then = round(cost + hours[k], 9)
            if to[k] < 0:
                other = held.get(b[k])
                if not other or not any(as_good(x, (then, rank, size, city)) for x in other):
                    heapq.heappush(heap, (then, rank, b[k], size, city))
            else:
                there = away.setdefault(to[k], {})
                new = (then, rank, size, city)
                before = there.setdefault(b[k], [])
                if not any(as_good(x, new) for x in before):
                    there[b[k]] = [x for x in before if not as_good(new, x)] + [new]
    flat = lambda labels: np.array([(n, *x) for n, xs in labels.items() for x in xs], _LABEL)
    return flat(held), {t: flat(labels) for t, labels in away.items()}


def spread(edges: DataFrame, starts: DataFrame, width: int, single: bool, side: int = 128) -> DataFrame:
    """(node, cost, rank, population, city_id): the labels that stay at each node once nothing improves.

    The grid is cut into tiles of side by side cells. A round takes the tiles that labels have come to,
    searches each in one task as far as its border, and sends what crosses it on. Only those tiles are
    written again, so rounds grow with the tiles that a way crosses and not with its cells. A round reads one
    table of states and those of the last MOST_ROUNDS rounds, and what is no longer read is removed.
    """
    spark = edges.sparkSession
    placed = edges.select(_tile(F.col("a"), width, side).alias("tile"), "a", "b", "hours", F.when(_tile(F.col("b"), width, side) == _tile(F.col("a"), width, side), -1).otherwise(_tile(F.col("b"), width, side)).alias("to"))
    tiles = cut(_packed(placed, _EDGE).withColumnRenamed("packed", "edges"))
    best = F.min_by(F.struct("cost", "rank", "population", "city_id"), F.struct("cost", "rank"))
    first = starts.withColumn("cost", F.round("cost", 9)).groupBy("node").agg(best.alias("b")).select("node", "b.*") if single else starts.withColumn("cost", F.round("cost", 9))
    come = _packed(first.withColumn("tile", _tile(F.col("node"), width, side)), _LABEL).select("tile", F.array("packed").alias("come"))
    older, older_path = spark.createDataFrame([], "tile long, round int, had binary"), []
    rounds: list[tuple[DataFrame, str]] = []
    number = 0

    def newest() -> DataFrame:
        """(tile, had): the last state of each tile that labels have come to."""
        states = older
        for k, (made, _) in enumerate(rounds):
            states = states.unionByName(made.filter("not going").select("tile", F.lit(number - len(rounds) + k + 1).alias("round"), F.col("packed").alias("had")))
        return states.groupBy("tile").agg(F.max_by("had", "round").alias("had"))

    def run(batches):
        for pdf in batches:
            out = []
            for tile, packed, had, come in zip(pdf["tile"], pdf["edges"], pdf["had"], pdf["come"]):
                read = lambda x, kind: np.frombuffer(x, kind) if x is not None else np.zeros(0, kind)
                state, away = spread_tile(read(packed, _EDGE), read(had, _LABEL), np.concatenate([read(x, _LABEL) for x in come]), single)
                out.append((tile, False, state.tobytes()))
                out += [(t, True, labels.tobytes()) for t, labels in away.items()]
            yield pd.DataFrame(out, columns=["tile", "going", "packed"])

    while True:
        work = come.join(tiles, "tile", "left").join(newest(), "tile", "left").select("tile", "edges", "had", "come")
        rounds.append(kept(work.mapInPandas(run, "tile long, going boolean, packed binary")))
        number += 1
        if len(rounds) > MOST_ROUNDS:
            # what still goes on is in the last round's table, which stays
            whole, path = kept(newest().withColumn("round", F.lit(number)).select("tile", "round", "had"))
            forget(spark, *older_path, *(p for _, p in rounds[:-1]))
            older, older_path, rounds = whole, [path], rounds[-1:]
        going = rounds[-1][0].filter("going")
        if not going.limit(1).count():
            break
        come = going.groupBy("tile").agg(F.collect_list("packed").alias("come"))  # at most one from each neighbouring tile

    def unpack(batches):
        for pdf in batches:
            for raw in pdf["had"]:
                yield pd.DataFrame(np.frombuffer(raw, _LABEL))

    return newest().select("had").mapInPandas(unpack, "node long, cost double, rank long, population double, city_id long")


def ownership(edges: DataFrame, starts: DataFrame, width: int, side: int = 128) -> DataFrame:
    """(node, city_id, cost, rank): who gets to each cell first, equal costs going to the larger city.

    Costs count to nine decimals, so that ties are ties in any order of summing.
    """
    return spread(edges, starts, width, True, side).select("node", "city_id", "cost", "rank")


def thresholds(edges: DataFrame, cities: DataFrame, sources: DataFrame, width: int, side: int = 128) -> DataFrame:
    """(city_id, status, threshold, parent, hours): the level at which a larger city takes over each city's centre.

    That is the least travel time to a larger city over the difference of logarithms of population. A
    cell keeps a city only while no other is at least as near and as large: of the others none can
    have the least quotient for any city at that cell. cities: (city_id, population, centre,
    merged_into); a city without cells is merged, or has no transport. Times count to four decimals of
    an hour, so that a way is as long in either direction.
    """
    held = spread(edges, seeds(cities, sources, 0.0), width, False, side).select("node", F.col("cost").alias("hours"), "rank", F.col("population").alias("size"), F.col("city_id").alias("by"))
    top = cities.agg(F.max("population").alias("top"))
    met = cities.select("city_id", "population", F.col("centre").alias("node")).join(held, "node").filter(F.col("size") > F.col("population"))
    met = met.withColumn("hours", F.round("hours", 4))
    quotient = F.round(F.col("hours") / (F.log10("size") - F.log10("population")), 9)
    best = met.groupBy("city_id").agg(F.min(F.struct(quotient.alias("threshold"), "rank", F.col("by").alias("parent"), "hours")).alias("b")).select("city_id", "b.threshold", "b.parent", "b.hours")
    status = (
        F.when(F.col("centre").isNull(), F.when(F.col("merged_into").isNotNull(), "merged_at_resolution").otherwise("transport_missing"))
        .when(F.col("parent").isNotNull(), "ok").when(F.col("population") == F.col("top"), "root").otherwise("no_larger_reachable")
    )
    return cities.join(best, "city_id", "left").crossJoin(F.broadcast(top)).select("city_id", status.alias("status"), "threshold", "parent", "hours")


def level_report(owned: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: territories, cells without an owner and their people; cells: (node, population)."""
    met = cells.join(owned.select("node", "city_id"), "node", "left")
    return met.agg(F.count_distinct("city_id").alias("territories"), F.count_if(F.col("city_id").isNull()).alias("unreached_cells"), F.coalesce(F.sum(F.when(F.col("city_id").isNull(), F.col("population"))), F.lit(0)).cast("long").alias("unreached_people"))


def stray_territories(owned: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(component, city_id, cells): connected parts of a territory without one of its city's own cells."""
    own = owned.select(F.col("node").alias("a"), F.col("city_id").alias("ca"))
    other = owned.select(F.col("node").alias("b"), F.col("city_id").alias("cb"))
    same = edges.select("a", "b").join(own, "a").join(other, "b").filter("ca = cb").select("a", "b")
    parts = components(owned.select("node"), same).join(owned.select("node", "city_id"), "node")
    rooted = parts.join(starts.select("node", "city_id").distinct(), ["node", "city_id"], "left_semi").select("component").distinct()
    return parts.join(rooted, "component", "left_anti").groupBy("component", "city_id").agg(F.count("*").alias("cells"))


def fill_nearest(cells: DataFrame, grid: Grid) -> DataFrame:
    """Land cells (r, c, land, v) of unknown country, v 0, with that of the nearest known cell by squared offset, then row and column; no wrap.

    Along columns first, each cell keeping the nearest known row above and below; then along each row
    in one task, which the row's length bounds: offsets grow until no cell could still gain.
    """
    col = Window.partitionBy("c").orderBy("r")
    known = F.when(F.col("v") > 0, F.struct("r", "v"))
    near = cells.withColumn("up", F.last(known, ignorenulls=True).over(col.rowsBetween(Window.unboundedPreceding, 0))).withColumn("down", F.first(known, ignorenulls=True).over(col.rowsBetween(0, Window.unboundedFollowing)))
    rows = near.select("r", "c", (F.col("land") & (F.col("v") == 0)).alias("asked"), F.col("up.r").alias("ur"), F.col("up.v").alias("uv"), F.col("down.r").alias("dr"), F.col("down.v").alias("dv"))
    width = grid.width

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        row = int(pdf["r"].iloc[0])
        at = pdf["c"].to_numpy()
        none = 1 << 40
        marks = np.full((2, 2, width), none, np.int64)  # above and below: row and value for each column
        for k, (r, v) in enumerate((("ur", "uv"), ("dr", "dv"))):
            there = pdf[r].notna().to_numpy()
            marks[k, 0, at[there]] = pdf[r].to_numpy()[there].astype(np.int64)
            marks[k, 1, at[there]] = pdf[v].to_numpy()[there].astype(np.int64)
        asked = np.sort(at[pdf["asked"].to_numpy().astype(bool)])
        best = np.full((4, len(asked)), none, np.int64)  # squared offset, row, column, value
        step = 0
        while len(asked) and step < width and (best[0] >= step * step).any():
            for c in {step, -step}:
                place = asked + c
                inside = (place >= 0) & (place < width)
                for k in range(2):
                    found = np.full((4, len(asked)), none, np.int64)
                    r, v = marks[k, 0, place[inside]], marks[k, 1, place[inside]]
                    found[:, inside] = np.where(r < none, (r - row) ** 2 + step * step, none), r, place[inside], v
                    less, same = np.zeros(len(asked), bool), np.ones(len(asked), bool)
                    for x, y in zip(found[:3], best[:3]):
                        less |= same & (x < y)
                        same &= x == y
                    best[:, less] = found[:, less]
            step += 1
        there = best[0] < none
        return pd.DataFrame({"r": np.full(there.sum(), row), "c": asked[there], "filled": best[3, there]})

    filled = rows.groupBy("r").applyInPandas(fill, "r int, c int, filled long")
    return cells.join(filled, ["r", "c"], "left").select("r", "c", "land", F.coalesce("filled", "v").alias("v"))
