"""Polygons across the date line, distance fields, sampled labels, patches and coverage against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meridia.operators import mapped, polygon

V = "poly int, ring int, ix int, lat double, lon double"


def ring(poly, points, ring=0):
    return [(poly, ring, k, float(y), float(x)) for k, (y, x) in enumerate([*points, points[0]])]


def test_polygon_across_the_date_line(spark):
    """Its inside is the narrow side, and its hole, given on the other turn, stays a hole."""
    shape = ring(1, [(-10, 170), (-10, -160), (10, -160), (10, 170)]) + ring(1, [(-2, -175), (-2, -170), (2, -170), (2, -175)], 1)
    vertices = spark.createDataFrame(shape, V)
    points = [(1, 0.0, 175.0), (2, 0.0, -172.0), (3, 0.0, 0.0), (4, 5.0, -172.0), (5, 0.0, -180.0), (6, 0.0, -159.0), (7, 0.0, 169.0)]
    held = polygon.containing(spark.createDataFrame(points, "id int, lat double, lon double"), vertices, "id")
    assert sorted(r.id for r in held.collect()) == [1, 4, 5]
    cells = {(r.r, r.c) for r in polygon.rasterize(vertices, 180, 360).collect()}
    want = {(r, c % 360) for r in range(80, 100) for c in range(350, 380) if not (88 <= r < 92 and 365 <= c < 370)}
    assert cells == want


def test_ring_around_a_pole_keeps_its_longitudes(spark):
    cap = ring(1, [(-60, -180), (-60, -90), (-60, 0), (-60, 90), (-60, 180), (-90, 180), (-90, -180)])
    points = spark.createDataFrame([(1, -80.0, 12.0), (2, -50.0, 12.0), (3, -80.0, -179.0)], "id int, lat double, lon double")
    assert sorted(r.id for r in polygon.containing(points, spark.createDataFrame(cap, V), "id").collect()) == [1, 3]


def pixels(lat, lon, a, b, dy, dx):
    shift = 360 * math.floor((lon - (a[1] + b[1]) / 2) / 360 + 0.5)
    k = math.cos(math.radians(lat))
    ax, bx, ay, by = (a[1] + shift - lon) * k / dx, (b[1] + shift - lon) * k / dx, (a[0] - lat) / dy, (b[0] - lat) / dy
    vx, vy = bx - ax, by - ay
    t = max(0, min(1, -(ax * vx + ay * vy) / (vx * vx + vy * vy)))
    return math.hypot(ax + t * vx, ay + t * vy)


@pytest.mark.parametrize("side", [3, 32])
def test_distance_field(spark, side):
    """All cells against all edges, with any block; near a pole and across the date line; no label there means any edge."""
    shapes = {1: [(60, 170), (60, -165), (85, -165), (84, 170)], 2: [(-20, -10), (-20, 30), (15, 25), (10, -5)], 3: [(12, 10), (12, 40), (30, 40), (30, 10)]}
    vertices = spark.createDataFrame([(*r, p) for p, pts in shapes.items() for r in ring(p, pts)], V + ", lab int")
    height, width = 36, 60
    truth = {(r.r, r.c): r.lab for r in mapped.painted(vertices, height, width).collect()}
    labels = {(r, c): truth.get((r, c), 0) for r in range(height) for c in range(width)}
    for cell in list(labels)[::97]:
        labels[cell] = 2  # not what the polygons say
    dy, dx = 180 / height, 360 / width
    lines = []
    for p, pts in shapes.items():
        laid = [(y, x + 360 if p == 1 and x < 0 else x) for y, x in [*pts, pts[0]]]
        lines += [(p, a, b) for a, b in zip(laid, laid[1:])]
    want = {}
    for (r, c), lab in labels.items():
        y, x = 90 - (r + 0.5) * dy, -180 + (c + 0.5) * dx
        d = min([4.0, *(pixels(y, x, a, b, dy, dx) for p, a, b in lines if lab in (0, p))])
        want[r, c] = math.floor(d * 63.75 + 0.5) if lab == truth.get((r, c), 0) else 0
    table = spark.createDataFrame([(r, c, v) for (r, c), v in labels.items()], "r int, c int, lab int")
    got = {(r.r, r.c): r.near for r in mapped.distance_field(table, vertices, height, width, side).collect()}
    assert got == want


def test_field_meets_no_edge_beyond_its_margin(spark):
    """Edges go only to blocks that a margin of four pixels reaches."""
    vertices = spark.createDataFrame([(*r, 1) for r in ring(1, [(0, 0), (0, 2), (2, 2), (2, 0)])], V + ", lab int")
    blocks = {(r.br, r.bc) for r in mapped.segment_blocks(vertices, 180, 360, 10).collect()}
    assert blocks == {(br, bc) for br in (8, 9) for bc in (17, 18)}


def vote(texels):
    """(label, padding, score) of four (label, padding, near, weight)."""
    best = None
    for lab, *_ in texels:
        score = sum(w * (n if x == lab else -n) for x, _, n, w in texels)
        pad = max((t for t in texels if t[0] == lab), key=lambda t: t[3])[1]
        if best is None or score > best[2]:
            best = (lab, pad, score)
    return best


def test_sampled_labels(spark):
    """Against a loop, at poles, across the date line and where cells are missing or tie."""
    rng = random.Random(5)
    height, width = 6, 12
    field = {(r, c): (rng.randrange(3), rng.randrange(2), rng.randrange(256)) for r in range(height) for c in range(width) if rng.random() < 0.95}
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(200)] + [(900, 90.0, -180.0), (901, -90.0, 179.999), (902, 0.0, 0.0), (903, 45.0, 165.0)]
    want = {}
    for i, lat, lon in points:
        fx, fy = ((lon + 180) % 360) / 360 * width - 0.5, (90 - lat) / 180 * height - 0.5
        bx, by = math.floor(fx), math.floor(fy)
        four = []
        for j in (0, 1):
            for k in (0, 1):
                at = (max(0, min(height - 1, by + j)), (bx + k) % width)
                four.append((*field.get(at, (0, 0, 0)), (fx - bx if k else 1 - (fx - bx)) * (fy - by if j else 1 - (fy - by))))
        lab, pad, score = vote(four)
        want[i] = (lab, pad, round(score * 4 / 255, 9))
    table = spark.createDataFrame([(r, c, *v) for (r, c), v in field.items()], "r int, c int, lab int, pad int, near int")
    out = mapped.sample_labels(spark.createDataFrame(points, "id int, lat double, lon double"), table, height, width, "id")
    assert {r.id: (r.lab, r.pad, round(r.distance, 9)) for r in out.collect()} == want


def test_equal_labels_by_nine_decimals_the_first_wins(spark):
    """Two texels whose weights times distances are equal but for their last bits."""
    texels, points = [], []
    for k in range(1, 100):
        texels += [(0, 4 * k, 2, 1, k), (0, 4 * k + 1, 1, 0, 100 - k)]
        points.append((k, 0.0, -180 + (4 * k + 0.5 + k / 100) * 0.9))
    out = mapped.sample_labels(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(texels, "r int, c int, lab int, pad int, near int"), 1, 400, "id")
    assert {(r.lab, r.pad, round(r.distance, 6) + 0.0) for r in out.collect()} == {(2, 1, 0.0)}


def test_first_patch_wins_and_rims_are_left_out(spark):
    patches = spark.createDataFrame([(2, -10.0, -10.0, 10.0, 10.0), (1, 0.0, 0.0, 20.0, 20.0), (3, 170.0, 0.0, 190.0, 10.0)], "patch int, west double, south double, east double, north double")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, -5.0, -5.0), (3, 5.0, -175.0), (4, 5.0, 175.0), (5, 19.99, 19.99), (6, 50.0, 50.0), (7, 0.05, 5.0)], "id int, lat double, lon double")
    got = {r.id: (r.patch, round(r.u, 6), round(r.v, 6)) for r in mapped.patch_of(points, patches, "id").collect()}
    assert got == {1: (1, 0.25, 0.75), 2: (2, 0.25, 0.75), 3: (3, 0.75, 0.5), 4: (3, 0.25, 0.5), 7: (2, 0.75, 0.4975)}
    plan = mapped.patch_of(points, patches, "id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("bounds", [(-180.0, -90.0, 180.0, 90.0), (-120.0, -60.0, 150.0, 72.0)])
def test_coverage_conserves_area(spark, bounds):
    """Triangles are whole, labels have their true areas, and beyond the bounds there is only label 0."""
    height, width, mesh_height, mesh_width = 9, 14, 7, 5
    labels = {(r, c): (r * 5 + c * 3) % 4 + 1 for r in range(height) for c in range(width)}
    table = spark.createDataFrame([(r, c, v) for (r, c), v in labels.items()], "r int, c int, lab int")
    cover = mapped.triangle_coverage(table, height, width, mesh_height, mesh_width, bounds).collect()
    each, area = Counter(), Counter()
    for r in cover:
        each[r.triangle] += r.weight
        area[r.lab] += r.weight
    assert len(each) == 2 * mesh_height * mesh_width
    assert all(abs(x * len(each) - 1) < 1e-9 for x in each.values())
    west, south, east, north = bounds
    want = Counter()
    for (r, c), lab in labels.items():
        top, bottom = (math.radians(north - k * (north - south) / height) for k in (r, r + 1))
        want[lab] += (east - west) / width / 360 * (math.sin(top) - math.sin(bottom)) / 2
    want[0] = 1 - sum(want.values())
    assert all(abs(area[k] - want[k]) < 1e-9 for k in want)


def test_coverage_with_a_gap_is_an_error(spark):
    table = spark.createDataFrame([(r, c, 1) for r in range(4) for c in range(8) if (r, c) != (2, 3)], "r int, c int, lab int")
    with pytest.raises(Exception, match="gaps in the mesh"):
        mapped.triangle_coverage(table, 4, 8, 3, 3).collect()


def mesh(spark, move=lambda x, y: (x, y)):
    return spark.createDataFrame([(j, i, *map(float, move(i / 6, j / 4))) for j in range(5) for i in range(7)], "j int, i int, x double, y double")


def test_mapped_areas(spark):
    """A map that keeps areas keeps all; one that squeezes halves has half; one that folds is an error."""
    table = spark.createDataFrame([(r, c, 1 if c < 9 else 2) for r in range(10) for c in range(18)], "r int, c int, lab int")
    cover = mapped.triangle_coverage(table, 10, 18, 4, 6)
    same = {r.lab: (r.area, r.mapped) for r in mapped.mapped_areas(cover, mesh(spark), 4, 6).collect()}
    assert all(abs(x - 0.5) < 1e-12 for v in same.values() for x in v)
    squeezed = mesh(spark, lambda x, y: (x / 2 if x <= 0.5 else 1.5 * x - 0.5, y))
    got = {r.lab: r.mapped for r in mapped.mapped_areas(cover, squeezed, 4, 6).collect()}
    assert abs(got[1] - 0.25) < 1e-12 and abs(got[2] - 0.75) < 1e-12
    with pytest.raises(Exception, match="folds"):
        mapped.mapped_areas(cover, mesh(spark, lambda x, y: (1 - x, y)), 4, 6).collect()
    with pytest.raises(Exception, match="without a parent"):
        mapped.mapped_areas(cover, mesh(spark), 4, 6, spark.createDataFrame([(1, 7)], "lab int, parent int")).collect()


def test_densities(spark):
    areas = spark.createDataFrame([(0, 0.4), (1, 0.2), (2, 0.1), (3, 0.2), (4, 0.1)], "lab int, area double")
    units = spark.createDataFrame([(1, 30.0, False), (2, None, False), (3, 0.0, False), (4, 50.0, True), (5, 0.0, False)], "lab int, value double, excluded boolean")
    got = {r.lab: r for r in mapped.coverage_densities(areas, units).collect()}
    mean = 30 / 0.4
    assert [round(got[k].density / mean, 9) for k in range(6)] == [1, 2, 1, 0.01, 1, 1]
    assert abs(sum(r.target for r in got.values()) - 1) < 1e-12
    assert got[1].share == 1 and got[3].share == 0 and got[0].share is None and got[2].share is None and got[4].share is None
    for fault, said in (((9, 5.0, False), "value without area"), ((3, -1.0, False), "negative")):
        bad = units.filter(F.col("lab") != fault[0]).unionByName(spark.createDataFrame([fault], units.schema))
        with pytest.raises(Exception, match=said):
            mapped.coverage_densities(areas, bad).collect()
    with pytest.raises(Exception, match="area without a unit"):
        mapped.coverage_densities(areas, units.filter("lab <> 3")).collect()
