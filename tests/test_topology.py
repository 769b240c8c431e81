"""Arcs, effective areas and simpler polygons against plain loops."""

import itertools
import math

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from meridia.operators import topology
from meridia.plans import topology_queries
from meridia.plans.views import frame

SCHEMA = "country int, poly int, ring int, ix int, lat double, lon double"


def rows(country, poly, ring, points):
    """A closed ring of (lon, lat)."""
    return [(country, poly, ring, i, float(y), float(x)) for i, (x, y) in enumerate([*points, points[0]])]


def triangle(a, b, c):
    """The area on the unit sphere of three (lat, lon): half-angle sum over their volume."""
    u, v, w = (np.array([math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))]) for y, x in (a, b, c))
    return abs(2 * math.atan2(np.linalg.det([u, v - u, w - u]), 1 + u @ v + v @ w + w @ u))


def plain_weights(points):
    left, out, least = list(range(len(points))), [math.inf] * len(points), 0.0
    while len(left) > 2:
        area, at = min((triangle(*(points[left[i + d]] for d in (-1, 0, 1))), i) for i in range(1, len(left) - 1))
        least = out[left.pop(at)] = max(least, area)
    return [math.inf if abs(p[0]) >= 89.999 else w for p, w in zip(points, out, strict=True)]


def cross(a, b, c, d):
    side = lambda p, q, r: (q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def ring_of(steps, drawn):
    """The points of a ring from its (step, arc, backward) and each arc's points."""
    out = []
    for _, arc, backward in sorted(steps):
        points = drawn[arc][::-1] if backward else drawn[arc]
        out += points[:-1]
        last = points[-1]
    return [*out, last]


def area(ring):
    """The smaller side of a ring in square kilometres."""
    total = 0.0
    for (y, x), (y2, x2) in itertools.pairwise(ring):
        t1, t2 = math.tan(math.radians(y) / 2), math.tan(math.radians(y2) / 2)
        total += 2 * math.atan2(math.tan(math.radians(x2 - x) / 2) * (t1 + t2), 1 + t1 * t2)
    return min(abs(total), 4 * math.pi - abs(total)) * 6371.0088**2


def plain_simplified(arcs, uses, needed, sizes, share, least_km2, protect_km2, steps, passes=8):
    """Rings by (poly, ring), and how many passes it took; arcs: points by name; uses: (poly, ring, step, arc, backward)."""
    weights = {a: plain_weights(p) for a, p in arcs.items()}
    for poly, _, _, arc, _ in uses:
        if needed[poly] and sizes[poly] < protect_km2:
            weights[arc] = [math.inf] * len(arcs[arc])
    finite = sorted((w for a in weights.values() for w in a if w < math.inf), reverse=True)
    low = math.floor((len(finite) - 1) * share)
    least = finite[low] + (finite[math.ceil((len(finite) - 1) * share)] - finite[low]) * ((len(finite) - 1) * share - low) if finite else 0.0
    for turn in range(passes):
        stay = {a: [p for p, w in zip(arcs[a], weights[a], strict=True) if w >= least] for a in arcs}
        rings = {}
        for poly, ring, step, arc, backward in uses:
            if needed[poly] or sizes[poly] >= least_km2:
                rings.setdefault((poly, ring), []).append((step, arc, backward))
        outer = {arc for (_, ring), s in rings.items() if ring == 0 for _, arc, _ in s}
        rings = {k: s for k, s in rings.items() if k[1] == 0 or any(a in outer for _, a, _ in s) or area(ring_of(s, stay)) >= least_km2}
        used = {a for s in rings.values() for _, a, _ in s}
        every = np.array([p for a in used for p in stay[a]])
        low, size = every.min(axis=0), (every.max(axis=0) - every.min(axis=0)) / (steps - 1)
        drawn = {a: [k for k, _ in itertools.groupby(tuple(np.floor((np.array(p) - low) / size + 0.5) * size + low) for p in stay[a])] for a in used}
        boxes = {}
        for poly in {p for p, _ in rings}:
            own = {a for (p, _), s in rings.items() if p == poly for _, a, _ in s}
            lines = [(a, *ends) for a in own for ends in itertools.pairwise(drawn[a]) if abs(ends[0][1] - ends[1][1]) <= 180]
            for (a, p, q), (b, r, s) in itertools.combinations(lines, 2):
                if cross(p, q, r, s):
                    corners = np.array([p, q, r, s])
                    pad = (corners.max(axis=0) - corners.min(axis=0)) * 2.0**turn / 2
                    for arc in (a, b):
                        boxes.setdefault(arc, []).append((corners.min(axis=0) - pad, corners.max(axis=0) + pad))
        if not boxes:
            return {k: ring_of(s, drawn) for k, s in rings.items()}, turn + 1
        for arc, around in boxes.items():
            back = [i for i, p in enumerate(arcs[arc]) if weights[arc][i] < math.inf and any((b <= p).all() and (p <= t).all() for b, t in around)]
            for i in back or (range(len(arcs[arc])) if turn >= 3 else []):
                weights[arc][i] = math.inf
    raise ValueError("still crossing")


def compare(vertices, cities, share, least_km2, protect_km2, steps=1_000_000):
    drawn, uses = topology.simplified(vertices, cities, share, least_km2, protect_km2, steps)
    got = {}
    for r in topology.assembled(uses, drawn).orderBy("poly", "ring", "ix").collect():
        got.setdefault((r.poly, r.ring), []).append((r.lat, r.lon))
    whole = topology.topology(vertices.drop("country"))
    arcs = {r.arc: [(p.lat, p.lon) for p in r.points] for r in whole.arcs.collect()}
    every = [(r.poly, r.ring, r.step, r.arc, r.backward) for r in whole.uses.collect()]
    told = topology.standing(vertices, cities).collect()
    want, turns = plain_simplified(arcs, every, {r.poly: r.needed for r in told}, {r.poly: r.area_km2 for r in told}, share, least_km2, protect_km2, steps)
    assert got.keys() == want.keys()
    for key, ring in want.items():
        assert len(got[key]) == len(ring), (key, got[key], ring)
        assert np.allclose(got[key], ring, atol=1e-9), key
    return got, turns


def no_cities(spark):
    return spark.createDataFrame([], "city_id long, lat double, lon double")


def bay(spark):
    """Two neighbours; the western one's coast runs far in and the common border bends around the end of it, an islet lies in the east."""
    border = [(10, 0), (10.02, 3), (9.0, 4.2), (8.4, 4.6), (8.0, 5.0), (8.3, 5.5), (9.1, 5.8), (10.05, 7), (10, 10)]
    west = [(0, 10), (0, 5.4), (5, 5.21), (9.3, 5.02), (5, 4.9), (0, 4.8), (0, 0)]
    coast = [(21, 0), (21.01, 5), (21.3, 10)]
    islet = [(15, 5), (15.01, 5), (15.01, 5.01), (15, 5.01)]
    # the border goes west around the end of the bay only in full detail
    border[2:7] = [(9.8, 4.0), (9.7, 4.4), (9.6, 5.0), (9.7, 5.6), (9.8, 6.0)]
    data = rows(1, 1, 0, border + west) + rows(2, 2, 0, coast + border[::-1]) + rows(2, 2, 1, islet[::-1]) + rows(3, 3, 0, islet) + rows(3, 4, 0, [(30, 0), (31, 0), (31, 1)])
    return spark.createDataFrame(data, SCHEMA)


def test_effective_areas_equal_plain_ones():
    rng = np.random.default_rng(5)
    for n in (2, 3, 4, 40):
        lat, lon = rng.uniform(-60, 60, n), rng.uniform(-180, 180, n)
        want = plain_weights(list(zip(lat, lon, strict=True)))
        assert np.allclose(topology.effective_areas(lat, lon), want, rtol=1e-6, atol=1e-12)


def test_parcels_equal_plain_loops(spark):
    shapes, cities = frame(spark, SF, "parcel"), frame(spark, SF, "city")
    got, _ = compare(shapes, cities, topology_queries.SHARE, topology_queries.ISLET_KM2, topology_queries.PROTECT_KM2)
    points = sum(len(r) for r in got.values())
    assert 0 < points < 0.8 * shapes.count()
    assert {p % 3 for p, _ in got} == {0, 1, 2} and len({p for p, _ in got if p % 3 == 2}) < 10


@pytest.mark.parametrize("share", [0.0, 0.15, 0.6])
def test_few_points_equal_plain_loops_and_common_borders_stay_common(spark, share):
    shapes = bay(spark)
    got, _ = compare(shapes, no_cities(spark), share, 2.0, 0.0)
    edges = lambda ring: {frozenset(e) for e in itertools.pairwise(ring)}
    assert len(edges(got[1, 0]) & edges(got[2, 0])) >= 1
    assert (3, 0) not in got and (2, 1) not in got and (4, 0) in got  # the islet and the hole for it go, the country stays


def spike(spark):
    """A spike of the southern border under a hill of the northern one: without one corner of its top, the hill cuts the spike."""
    north = [(10.0, 0.4), (6.1, 0.4), (5.33, 5.58), (4.8, 5.6), (3.9, 0.4), (0.0, 0.4)]
    south = [(0.0, -2.0), (4.1, 0.0), (5.0, 5.0), (5.9, 0.0), (10.0, -2.2)]
    return spark.createDataFrame(rows(1, 1, 0, south + north) + rows(2, 2, 0, [(5.0, 12.0), *north]), SCHEMA)


def test_crossings_get_their_points_back(spark):
    shapes, share = spike(spark), 8.5 / 9
    got, turns = compare(shapes, no_cities(spark), share, 0.0, 0.0)
    assert turns > 1
    for ring in got.values():
        assert not any(cross(*a, *b) for a, b in itertools.combinations(itertools.pairwise(ring), 2))
    with pytest.raises(ValueError, match="still cross"):
        topology.simplified(shapes, no_cities(spark), share, 0.0, 0.0, passes=1)


def test_crossings_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    lines = {f"a{i}": [tuple(p) for p in np.cumsum(rng.normal(0, 0.7, (12, 2)), axis=0) + [i % 3, 177 + i % 4]] for i in range(6)}
    uses = spark.createDataFrame([(i % 2, 0, i, f"a{i}", False) for i in range(6)], "poly int, ring int, step int, arc string, backward boolean")
    points = spark.createDataFrame([(a, k, float(y), float(x)) for a, ps in lines.items() for k, (y, x) in enumerate(ps)], "arc string, k int, lat double, lon double")
    want = set()
    for poly in (0, 1):
        own = [(a, *e) for i, (a, ps) in enumerate(lines.items()) if i % 2 == poly for e in itertools.pairwise(ps)]
        for (a, p, q), (b, r, s) in itertools.combinations(own, 2):
            if cross(p, q, r, s):
                c = np.array([p, q, r, s])
                pad = (c.max(axis=0) - c.min(axis=0)) * 0.5
                want |= {(arc, *np.round([c.min(axis=0)[0] - pad[0], c.max(axis=0)[0] + pad[0], c.min(axis=0)[1] - pad[1], c.max(axis=0)[1] + pad[1]], 9)) for arc in (a, b)}
    for cell in (0.3, 5.0):
        got = topology.crossings(uses, points, 0.5, cell)
        assert {(r.arc, *np.round([r.s, r.n, r.w, r.e], 9)) for r in got.collect()} == want
    assert want


def test_weight_of_a_share_equals_sorted_list(spark):
    rng = np.random.default_rng(3)
    values = [*map(float, rng.integers(0, 20, 300)), *[math.inf] * 9]
    points = spark.createDataFrame([(v,) for v in values], "weight double").repartition(7)
    finite = sorted((v for v in values if v < math.inf), reverse=True)
    for share in (0.0, 0.04, 0.17, 0.5, 1.0):
        at = (len(finite) - 1) * share
        low, high = finite[math.floor(at)], finite[math.ceil(at)]
        assert topology.weight_at(points, share).first().least == pytest.approx(low + (high - low) * (at - math.floor(at)))
    assert topology.weight_at(points.filter("weight > 1000"), 0.5).first().least is None


def test_arcs_do_not_depend_on_where_rings_start_or_which_way_they_run(spark):
    shapes = frame(spark, SF, "parcel").drop("country").filter("poly < 12")
    n = F.max("ix").over(topology.Window.partitionBy("poly", "ring"))
    opened = shapes.withColumn("n", n).filter("ix < n")
    turned = opened.withColumn("ix", F.pmod(-F.col("ix") + 5, F.col("n")))
    closed = turned.unionByName(turned.filter("ix = 0").withColumn("ix", F.col("n"))).drop("n")
    points = lambda v: sorted(str(r.points) for r in topology.topology(v).arcs.collect())
    assert points(shapes) == points(closed)


def test_poles_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    drawn, uses = topology.simplified(empty, no_cities(spark), 0.5, 1.0, 1.0)
    assert drawn.count() == uses.count() == 0
    polar = spark.createDataFrame(rows(1, 1, 0, [(0, -80), (60, -80.001), (120, -80), (120, -90), (60, -90), (0, -90)]), SCHEMA)
    weights = topology.weighed(topology.topology(polar.drop("country")).arcs).collect()
    assert all(math.isinf(r.weight) for r in weights if r.lat == -90) and any(r.weight < math.inf for r in weights)


def test_lost_countries(spark):
    shapes = bay(spark)
    left = shapes.filter("poly <> 4").drop("country")
    assert [r.country for r in topology.lost_countries(shapes, left.filter("poly <> 3")).collect()] == [3]
    assert topology.lost_countries(shapes, left).count() == 0


def test_cities_on_an_edge_are_judged_by_their_own_longitude(spark):
    """A place on an eastern edge is outside; brought to the polygon's side of the globe and back it could be a bit west of it."""
    table, cities, turned = [], [], 0
    for k in range(40):
        west, east, north = -170.003 + k * 7.011, -169.5 + k * 7.013, 1.0 + k / 100
        table += [(1, k, 0, i, y, x) for i, (y, x) in enumerate([(0.0, west), (0.0, east), (north, east), (north, west), (0.0, west)])]
        cities.append((k, 0.5, east))
        turned += west + ((east - west) % 360 + 360) % 360 < east
    table += [(1, 1000, 0, i, y, x) for i, (y, x) in enumerate([(50.0, 100.0), (50.0, 170.0), (70.0, 170.0), (70.0, 100.0), (50.0, 100.0)])]
    assert turned
    told = topology.standing(spark.createDataFrame(table, SCHEMA), spark.createDataFrame(cities, "city_id long, lat double, lon double"))
    assert [r.poly for r in told.filter("needed").collect()] == [1000]


def test_points_are_weighed_in_arrow_batches(spark, monkeypatch):
    """Arcs of several batches, long ones among them, and no rows as Python objects."""
    monkeypatch.setattr(topology, "BATCH_POINTS", 10)
    rng = np.random.default_rng(3)
    arcs = {f"a{n}": rng.uniform(-60, 60, (n, 2)).tolist() for n in (2, 3, 5, 30, 4, 7, 6)}
    table = spark.createDataFrame([(a, [tuple(p) for p in v]) for a, v in arcs.items()], "arc string, points array<struct<lat:double,lon:double>>").coalesce(1)
    out = topology.weighed(table)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.arc, {})[r.k] = (r.lat, r.lon, r.weight)
    for a, v in arcs.items():
        assert [list(got[a][k][:2]) for k in range(len(v))] == v
        assert np.allclose([got[a][k][2] for k in range(len(v))], plain_weights(v), rtol=1e-6, atol=1e-12)


def test_parcels_are_read_once(spark):
    """Further readings of the polygons read what was written, not the view again."""
    shapes, *_ = topology_queries._simpler(spark, "/root/testdata/sf0.001")
    plan = shapes._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
