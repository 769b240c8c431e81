"""Polygons as arcs that neighbours share, and simpler ones of them: borders stay common, none crosses itself.

Vertices are rows (poly, ring, ix, lat, lon), rings closed by their first vertex again, common borders given by
the very same vertices. Work goes by point, ring or arc; nothing gathers more than the vertices of one arc.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.graph import cut
from meridia.operators.polygon import containing, polygon_areas, ring_areas

#: From this latitude on, vertices lie on the seam at a pole and stay.
POLAR = 89.999


class Topology(NamedTuple):
    """arcs: (arc, points), an array of (lat, lon); uses: (poly, ring, step, arc, backward), each ring's arcs in turn."""

    arcs: DataFrame
    uses: DataFrame


def topology(vertices: DataFrame) -> Topology:
    """The arcs of rings. Rings are cut where a vertex has other neighbours in one ring than in another.

    A ring without such a vertex is one closed arc from its smallest vertex on. An arc runs the way that makes
    its points smaller, and is named by the first of its uses (poly/ring/step). Rings of fewer than three
    different vertices count like any other; no rows give no arcs.
    """
    ring = Window.partitionBy("poly", "ring")
    along = ring.orderBy("ix")
    plain = vertices.select("poly", "ring", "ix", F.struct((F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon")).alias("p"))
    opened = plain.withColumn("n", F.max("ix").over(ring)).filter("ix < n")
    ends = opened.withColumn("before", F.coalesce(F.lag("p").over(along), F.max_by("p", "ix").over(ring)))
    ends = cut(ends.withColumn("after", F.coalesce(F.lead("p").over(along), F.min_by("p", "ix").over(ring))))
    sides = F.sort_array(F.array("before", "after"))
    meets = ends.groupBy("p").agg((F.min(sides) != F.max(sides)).alias("meets")).filter("meets")
    told = ends.join(meets, "p", "left").withColumn("meets", F.col("meets").isNotNull())
    smallest = F.min(F.struct("p", "ix")).over(ring)["ix"] == F.col("ix")
    begins = F.col("meets") | (~F.max("meets").over(ring) & smallest)
    told = told.withColumn("begins", begins).withColumn("step", F.sum(F.col("begins").cast("int")).over(along)).withColumn("last", F.max("step").over(ring))
    # what comes before the first cut ends the last arc; a vertex at a cut also ends the arc before
    own = F.struct(F.when(F.col("step") == 0, F.col("last")).otherwise(F.col("step")).alias("step"), F.when(F.col("step") == 0, F.col("ix") + F.col("n")).otherwise(F.col("ix")).alias("at"))
    prior = F.struct(F.when(F.col("step") == 1, F.col("last")).otherwise(F.col("step") - 1).alias("step"), F.when(F.col("step") == 1, F.col("ix") + F.col("n")).otherwise(F.col("ix")).alias("at"))
    rows = told.select("poly", "ring", "p", F.explode(F.when(F.col("begins"), F.array(own, prior)).otherwise(F.array(own))).alias("s")).select("poly", "ring", "p", "s.*")
    pieces = rows.groupBy("poly", "ring", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("points"))
    backward = F.reverse("points") < F.col("points")
    pieces = pieces.withColumn("backward", backward).withColumn("points", F.when(F.col("backward"), F.reverse("points")).otherwise(F.col("points")))
    pieces = cut(pieces.withColumn("digest", F.sha2(F.to_json("points"), 256)))
    first = F.min(F.struct("poly", "ring", "step"))
    heads = pieces.groupBy("digest").agg(first.alias("f")).select("digest", F.col("f.poly").alias("poly"), F.col("f.ring").alias("ring"), F.col("f.step").alias("step"), F.concat_ws("/", "f.poly", "f.ring", "f.step").alias("arc"))
    heads = cut(heads)
    arcs = pieces.drop("digest").join(heads.drop("digest"), ["poly", "ring", "step"]).select("arc", "points")
    uses = pieces.select("poly", "ring", "step", "digest", "backward").join(heads.select("digest", "arc"), "digest").drop("digest")
    return Topology(arcs, uses)


def effective_areas(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The weight of each point of a line: the spherical triangle with its neighbours when it is the least left, never below one taken before; ends are infinite."""
    n = len(lat)
    weight = [math.inf] * n
    u = []
    for y, x in zip(np.asarray(lat, dtype=float).tolist(), np.asarray(lon, dtype=float).tolist(), strict=True):
        y, x = math.radians(y), math.radians(x)
        u.append((math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)))

    def triangle(a: int, b: int, c: int) -> float:
        # plain numbers: arrays of three cost ten times as much
        (x1, y1, z1), (x, y, z), (x2, y2, z2) = u[a], u[b], u[c]
        volume = x1 * (y * z2 - z * y2) - y1 * (x * z2 - z * x2) + z1 * (x * y2 - y * x2)
        return 2 * abs(math.atan2(volume, 1 + x1 * x + y1 * y + z1 * z + x * x2 + y * y2 + z * z2 + x1 * x2 + y1 * y2 + z1 * z2))

    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    now: list[float | None] = [None] * n
    for k in range(1, n - 1):
        now[k] = triangle(k - 1, k, k + 1)
    heap = [(now[k], k) for k in range(1, n - 1)]
    heapq.heapify(heap)
    least = 0.0
    while heap:
        area, k = heapq.heappop(heap)
        if now[k] != area:  # taken, or changed since
            continue
        now[k] = None
        least = weight[k] = max(least, area)
        a, b = left[k], right[k]
        right[a], left[b] = b, a
        for m in (a, b):
            if now[m] is not None:
                now[m] = triangle(left[m], m, right[m])
                heapq.heappush(heap, (now[m], m))
    return np.array(weight)


BATCH_POINTS = 100_000  #: points in a batch of weights, but for one long arc


def weighed(arcs: DataFrame) -> DataFrame:
    """(arc, k, lat, lon, weight): the points of arcs with their effective areas; those at a pole are infinite."""
    schema = pa.schema([("arc", pa.string()), ("k", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("weight", pa.float64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column(1).offsets.to_numpy()
            lat, lon = (batch.column(1).values.field(c).to_numpy() for c in ("lat", "lon"))
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + BATCH_POINTS, "right")) - 1)
                low, high = bounds[row], bounds[end]
                weight = np.concatenate([effective_areas(lat[i:j], lon[i:j]) for i, j in zip(bounds[row:end], bounds[row + 1 : end + 1], strict=True)])
                sizes = np.diff(bounds[row : end + 1])
                k = np.arange(high - low) - np.repeat(bounds[row:end] - low, sizes)
                columns = [np.where(np.abs(lat[low:high]) >= POLAR, np.inf, weight), lat[low:high], lon[low:high]]
                arc = batch.column(0).take(pa.array(np.repeat(np.arange(row, end), sizes))).cast(pa.string())
                yield pa.RecordBatch.from_arrays([arc, pa.array(k.astype(np.int32)), *(pa.array(columns[i]) for i in (1, 2, 0))], schema=schema)
                row = end

    return arcs.select("arc", "points").mapInArrow(weigh, "arc string, k int, lat double, lon double, weight double")


def weight_at(points: DataFrame, share: float) -> DataFrame:
    """(least): one row, the weight that this share of the finite ones exceeds, between two of them by proportion; null without any.

    Equal weights are counted first; ranks are sums within ranges plus those of the ranges before.
    """
    counts = points.filter(F.col("weight") < float("inf")).groupBy("weight").agg(F.count("*").alias("n"))
    placed = cut(counts.repartitionByRange(F.col("weight").desc()).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum("n").alias("m"))
    before = sizes.select("_part", (F.sum("m").over(Window.orderBy("_part")) - F.col("m")).alias("before"))  # a row for each partition
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy(F.col("weight").desc()))
    ranked = placed.withColumn("upto", upto).join(F.broadcast(before), "_part").select("weight", (F.col("before") + F.col("upto") - F.col("n")).alias("first"), (F.col("before") + F.col("upto") - 1).alias("last"))
    at = placed.agg(((F.sum("n") - 1) * share).alias("at"))
    low, high = F.floor("at"), F.ceil("at")
    held = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("weight")))
    found = ranked.crossJoin(F.broadcast(at)).agg(held(low).alias("a"), held(high).alias("b"), F.max("at").alias("at"))
    return found.select((F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("least"))


def quantized(points: DataFrame, steps: int) -> DataFrame:
    """points on a grid of steps x steps over the box of all of them; of consecutive equal points of an arc the first stays."""
    box = points.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))

    def snap(value: Column, low: Column, high: Column) -> Column:
        size = F.when(high > low, (high - low) / (steps - 1)).otherwise(F.lit(1.0))
        return F.floor((value - low) / size + 0.5) * size + low

    on = points.crossJoin(F.broadcast(box)).withColumn("lat", snap(F.col("lat"), F.col("s"), F.col("n"))).withColumn("lon", snap(F.col("lon"), F.col("w"), F.col("e"))).drop("s", "n", "w", "e")
    along = Window.partitionBy("arc").orderBy("k")
    again = (F.lag("lat").over(along) == F.col("lat")) & (F.lag("lon").over(along) == F.col("lon"))
    return on.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again").drop("_again")


def assembled(uses: DataFrame, points: DataFrame) -> DataFrame:
    """(poly, ring, ix, lat, lon): rings put together from arcs (arc, k, lat, lon), closed by their first vertex."""
    met = uses.join(points.select("arc", "k", "lat", "lon"), "arc").withColumn("at", F.when(F.col("backward"), -F.col("k")).otherwise(F.col("k")))
    step = Window.partitionBy("poly", "ring", "step").orderBy(F.col("at").desc())
    whole = Window.partitionBy("poly", "ring")
    # an arc's last point is the next one's first, and the last arc's closes the ring
    met = met.withColumn("ends", F.row_number().over(step) == 1).withColumn("final", F.max("step").over(whole)).filter("not ends or step = final")
    return met.select("poly", "ring", (F.row_number().over(whole.orderBy("step", "at")) - 1).alias("ix"), "lat", "lon")


def crossings(uses: DataFrame, points: DataFrame, padding: float, cell_degrees: float = 0.5) -> DataFrame:
    """(arc, s, n, w, e): boxes around places where two segments of one polygon cross, for either's arc, wider by a share of their size.

    Segments of a polygon meet only those that touch the same cell of both axes; a pair counts in the cell where
    what their boxes share begins. Segments along the date line aren't compared.
    """
    along = Window.partitionBy("arc").orderBy("k")
    lines = points.select("arc", "k", "lat", "lon", F.lead("lat").over(along).alias("lat2"), F.lead("lon").over(along).alias("lon2")).filter("lat2 is not null and abs(lon2 - lon) <= 180")
    cell = lambda c: F.floor(c / cell_degrees)
    sized = lines.select("*", F.least("lat", "lat2").alias("s"), F.greatest("lat", "lat2").alias("n"), F.least("lon", "lon2").alias("w"), F.greatest("lon", "lon2").alias("e"))
    dealt = sized.join(uses.select("poly", "arc").distinct(), "arc")
    dealt = dealt.withColumn("r", F.explode(F.sequence(cell(F.col("s")), cell(F.col("n"))))).withColumn("c", F.explode(F.sequence(cell(F.col("w")), cell(F.col("e")))))
    a, b = dealt.alias("a"), dealt.alias("b")
    side = lambda o, p, q: (F.col(f"{p}.lon{q}") - F.col(f"{o}.lon")) * (F.col(f"{o}.lat2") - F.col(f"{o}.lat")) - (F.col(f"{p}.lat{q}") - F.col(f"{o}.lat")) * (F.col(f"{o}.lon2") - F.col(f"{o}.lon"))
    boxes = (F.col("a.s") <= F.col("b.n")) & (F.col("b.s") <= F.col("a.n")) & (F.col("a.w") <= F.col("b.e")) & (F.col("b.w") <= F.col("a.e"))
    first = (cell(F.greatest("a.s", "b.s")) == F.col("a.r")) & (cell(F.greatest("a.w", "b.w")) == F.col("a.c"))
    once = F.struct("a.arc", "a.k") < F.struct("b.arc", "b.k")
    apart = (side("a", "b", "") * side("a", "b", "2") < 0) & (side("b", "a", "") * side("b", "a", "2") < 0)
    same = (F.col("a.poly") == F.col("b.poly")) & (F.col("a.r") == F.col("b.r")) & (F.col("a.c") == F.col("b.c"))
    met = a.join(b, same & once & boxes & first & apart)
    joint = met.select(F.array("a.arc", "b.arc").alias("arcs"), F.least("a.s", "b.s").alias("s"), F.greatest("a.n", "b.n").alias("n"), F.least("a.w", "b.w").alias("w"), F.greatest("a.e", "b.e").alias("e"))
    tall, wide = (F.col("n") - F.col("s")) * padding, (F.col("e") - F.col("w")) * padding
    return joint.select(F.explode("arcs").alias("arc"), (F.col("s") - tall).alias("s"), (F.col("n") + tall).alias("n"), (F.col("w") - wide).alias("w"), (F.col("e") + wide).alias("e")).distinct()


def restored(points: DataFrame, boxes: DataFrame, whole: bool) -> DataFrame:
    """points whose weights are infinite inside a box of their arc; with ``whole``, all points of an arc whose boxes hold none that were finite."""
    finite = points.filter(F.col("weight") < float("inf"))
    inside = F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))
    back = finite.join(boxes, "arc").filter(inside).select("arc", "k").distinct()
    if whole:
        stuck = boxes.select("arc").distinct().join(back.select("arc").distinct(), "arc", "left_anti")
        back = back.unionByName(finite.join(stuck, "arc", "left_semi").select("arc", "k"))
    told = points.join(back.withColumn("back", F.lit(True)), ["arc", "k"], "left")
    return told.withColumn("weight", F.when(F.col("back"), F.lit(float("inf"))).otherwise(F.col("weight"))).drop("back")


def standing(vertices: DataFrame, cities: DataFrame) -> DataFrame:
    """(poly, area_km2, needed): polygons at full detail; a country needs its largest ones and those that hold a city.

    vertices have a country; cities: (city_id, lat, lon).
    """
    countries = vertices.select("poly", "country").distinct()
    bare = vertices.drop("country")
    held = containing(cities, bare, "city_id", as_given=True).select("poly").distinct().withColumn("held", F.lit(True))
    sized = polygon_areas(bare).join(countries, "poly").join(held, "poly", "left")
    largest = F.max("area_km2").over(Window.partitionBy("country"))
    return sized.select("poly", "area_km2", (F.col("held").isNotNull() | (F.col("area_km2") == largest)).alias("needed"))


def without_islets(uses: DataFrame, polygons: DataFrame, hole_areas: DataFrame, least_km2: float) -> DataFrame:
    """uses of polygons that are needed or of some size; a smaller hole goes unless an outer ring that stays has one of its arcs."""
    kept = uses.join(polygons.filter(F.col("needed") | (F.col("area_km2") >= least_km2)).select("poly"), "poly", "left_semi")
    outer = kept.filter("ring = 0").select("arc").distinct()
    holes = kept.filter("ring > 0").select("poly", "ring", "arc")
    filled = holes.join(outer, "arc", "left_semi").select("poly", "ring").unionByName(hole_areas.filter((F.col("ring") > 0) & (F.col("area_km2") >= least_km2)).select("poly", "ring")).distinct()
    return kept.filter("ring = 0").unionByName(kept.filter("ring > 0").join(filled, ["poly", "ring"], "left_semi"))


def simplified(vertices: DataFrame, cities: DataFrame, share: float, least_km2: float, protect_km2: float, steps: int = 1_000_000, passes: int = 8) -> Topology:
    """Polygons of less detail: arcs as points (arc, k, lat, lon) on a grid, and the uses that are left.

    vertices: (country, poly, ring, ix, lat, lon). About ``share`` of the points between ends stay, those of the
    largest effective areas. Polygons below least_km2 go unless their country needs them (``standing``); needed
    ones below protect_km2 keep every point. Arcs that cross within a polygon get the points near the crossing
    back, more widely each pass, from the fourth on all of an arc that had none there; crossings after the last
    pass are an error. Arcs are simplified once whoever uses them, so a common border stays common.
    """
    bare = vertices.select("poly", "ring", "ix", "lat", "lon")
    topo = topology(bare)
    uses = cut(topo.uses)
    polygons = cut(standing(vertices, cities))
    small = polygons.filter(F.col("needed") & (F.col("area_km2") < protect_km2)).select("poly")
    guarded = uses.join(small, "poly", "left_semi").select("arc").distinct().withColumn("guarded", F.lit(True))
    points = weighed(topo.arcs).join(guarded, "arc", "left")
    points = cut(points.withColumn("weight", F.when(F.col("guarded"), F.lit(float("inf"))).otherwise(F.col("weight"))).drop("guarded"))
    least = cut(weight_at(points, share))
    for turn in range(passes):
        stay = points.crossJoin(F.broadcast(least)).filter(F.col("least").isNull() | (F.col("weight") >= F.col("least"))).select("arc", "k", "lat", "lon")
        holes = uses.filter("ring > 0")
        left = cut(without_islets(uses, polygons, ring_areas(assembled(holes, stay)), least_km2))
        drawn = cut(quantized(stay.join(left.select("arc").distinct(), "arc", "left_semi"), steps))
        boxes = cut(crossings(left, drawn, 2.0**turn / 2))
        if not boxes.limit(1).count():
            return Topology(drawn, left)
        points = cut(restored(points, boxes, whole=turn >= 3))
    raise ValueError(f"rings still cross after {passes} passes")


def lost_countries(vertices: DataFrame, drawn: DataFrame) -> DataFrame:
    """(country) of those that have no polygon of positive area left in drawn (poly, ring, ix, lat, lon)."""
    countries = vertices.select("poly", "country").distinct()
    alive = polygon_areas(drawn).filter("area_km2 > 0").join(countries, "poly").select("country")
    return countries.select("country").distinct().join(alive, "country", "left_anti")


def coast(uses: DataFrame) -> DataFrame:
    """(arc) of those that bound one polygon only: the border of all land together."""
    return uses.groupBy("arc").agg(F.count("*").alias("n")).filter("n = 1").select("arc")
