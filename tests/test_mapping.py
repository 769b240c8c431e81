"""Points through a map and back, and the sample stream, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest

from meridia.operators import mapping
from meridia.operators.raster import Grid
from meridia.operators.polygon import footprints, touched

H, W = 6, 12


def corners(fold=0.0):
    rows = []
    for j in range(H + 1):
        for i in range(W + 1):
            a, b = math.radians(i % W * 30), math.radians(j * 30)
            rows.append((j, i, 6 * math.sin(a) * math.sin(b) + fold * (i % W == 5) * (j == 3), 0.0 if j in (0, H) else 0.06 * math.cos(a) + 0.02 * math.sin(b)))
    return rows


def field(spark, fold=0.0):
    return spark.createDataFrame(corners(fold), "j int, i int, dlon double, ds double")


def wrap(x):
    return (x + 180) % 360 - 180


def plain_globe(lat, lon):
    data = {(j, i): (d, s) for j, i, d, s in corners()}
    x, y = (wrap(lon) + 180) / 360, (math.sin(math.radians(lat)) + 1) / 2
    sx, sy = x % 1 * W, min(1, max(0, y)) * H
    i, j = min(W - 1, int(sx)), min(H - 1, int(sy))
    tx, ty = sx - i, sy - j
    base = data[j, i][0]
    dlon = ds = 0.0
    for dj, di, w in ((0, 0, (1 - tx) * (1 - ty)), (0, 1, tx * (1 - ty)), (1, 0, (1 - tx) * ty), (1, 1, tx * ty)):
        d, s = data[j + dj, i + di]
        dlon += (base + wrap(d - base)) * w
        ds += s * w
    return math.degrees(math.asin(max(-1, min(1, 2 * max(0, min(1, y + ds / 2)) - 1)))), wrap(lon + dlon)


PLACES = [(k, math.degrees(math.asin(math.sin(k * 1.7))), wrap(k * 37.3)) for k in range(150)] + [(900, 90.0, 10.0), (901, -90.0, -180.0), (902, 0.0, 180.0), (903, 89.9995, 3.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, lat double, lon double")


def test_to_globe(spark):
    got = {r.id: (r.lat, r.lon) for r in mapping.to_globe(frame(spark, PLACES), field(spark), H, W, "id").collect()}
    assert len(got) == len(PLACES)
    for i, lat, lon in PLACES:
        want = plain_globe(lat, lon)
        assert abs(got[i][0] - want[0]) < 1e-9 and abs(wrap(got[i][1] - want[1])) < 1e-9
    still = {r.id: (r.lat, r.lon) for r in mapping.to_globe(frame(spark, PLACES), field(spark), H, W, "id", 0.0).collect()}
    assert all(still[i] == (lat, wrap(lon)) for i, lat, lon in PLACES)


def test_poles_stay_exact_while_a_map_moves(spark):
    half = {r.id: r.lat for r in mapping.to_globe(frame(spark, PLACES), field(spark), H, W, "id", 0.5).collect()}
    assert half[900] == 90 and half[901] == -90


def test_to_map_leads_back(spark):
    there = mapping.to_map(frame(spark, PLACES).repartition(5), field(spark), H, W, "id")
    assert there.filter("error > 1e-5").count() == 0
    back = {r.id: (r.lat, r.lon) for r in mapping.to_globe(there, field(spark), H, W, "id").collect()}
    for i, lat, lon in PLACES:
        assert abs(back[i][0] - lat) < 1e-5 and abs(wrap(back[i][1] - lon)) * math.cos(math.radians(lat)) < 1e-5


def test_points_without_a_place_are_left_out(spark):
    assert mapping.to_map(frame(spark, [(1, None, 3.0), (2, 4.0, None)]), field(spark), H, W, "id").count() == 0


def test_sample_stream_is_that_of_single_steps():
    state, want = mapping.SEED, []
    for _ in range(500):
        state = (state * mapping.FACTOR + mapping.ADDEND) % 2**32
        want.append(state)
    assert mapping.stream_states(np.arange(1, 501)).tolist() == want
    assert mapping.stream_states(np.array([0, 499, 2])).tolist() == [mapping.SEED, want[498], want[1]]


def test_round_trip_is_the_same_for_any_partitions(spark):
    errors = mapping.round_trip_errors(spark, field(spark), H, W, 3000)
    once = mapping.round_trip_summary(errors).first()
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        assert mapping.round_trip_summary(mapping.round_trip_errors(spark, field(spark), H, W, 3000)).first() == once
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert once.samples == 3000 and once.worst < 1e-5
    ordered = sorted(r.degrees for r in errors.collect())
    assert (once.p50, once.p99, once.p999) == tuple(ordered[math.ceil(3000 * p) - 1] for p in (0.5, 0.99, 0.999))


def test_a_place_that_is_not_found_is_an_error(spark, monkeypatch):
    flat = spark.createDataFrame([(j, i, -i * 30.0, 0.0) for j in range(H + 1) for i in range(W + 1)], "j int, i int, dlon double, ds double")
    out = mapping.to_map(frame(spark, [(1, 10.0, 77.0)]), flat, H, W, "id").first()
    assert out.error > 1
    with pytest.raises(ValueError, match="each corner"):
        mapping.to_map(frame(spark, PLACES), field(spark).limit(5), H, W, "id")
    with pytest.raises(ValueError, match="corners"):
        mapping.load_field(field(spark), 10**4, 10**4)
    assert isinstance(mapping.load_field(field(spark), H, W).dlon, np.ndarray) and not pd.isna(mapping.load_field(field(spark), H, W).ds).any()


def closed_hit(x1, y1, x2, y2, c, r):
    lo, hi = 0.0, 1.0
    for a, b, low in ((x1, x2, c), (y1, y2, r)):
        if a == b:
            if not low <= a <= low + 1:
                return False
        else:
            p, q = sorted(((low - a) / (b - a), (low + 1 - a) / (b - a)))
            lo, hi = max(lo, p), min(hi, q)
    return lo <= hi


def test_touched_cells(spark):
    """Every cell that an edge touches, rims and corners included; across the date line; beyond a grid that doesn't wrap."""
    shapes = {1: [(10.3, 170.2), (10.3, -170.4), (31.7, -160.1), (24.0, 168.0)], 2: [(0, 0), (0, 10), (10, 10), (10, 0)], 3: [(-3.2, 41.1), (-3.2, 41.2), (-3.1, 41.15)], 4: [(60, -20), (80, 35), (75, -40)]}
    rows = [(p, 0, k, float(y), float(x)) for p, pts in shapes.items() for k, (y, x) in enumerate([*pts, pts[0]])]
    vertices = spark.createDataFrame(rows, "poly int, ring int, ix int, lat double, lon double")
    for grid in (Grid(36, 72, 5.0), Grid(10, 20, 5.0, 50.0, -30.0)):
        want = set()
        for p, pts in shapes.items():
            laid = [(y, x + 360 if p == 1 and x < 0 else x) for y, x in [*pts, pts[0]]]
            for (ya, xa), (yb, xb) in zip(laid, laid[1:]):
                for turn in (-360, 0, 360):
                    x1, x2, y1, y2 = (xa + turn - grid.west) / grid.step, (xb + turn - grid.west) / grid.step, (grid.north - ya) / grid.step, (grid.north - yb) / grid.step
                    cells = range(-1, grid.width + 1)  # a rim at the grid's edge touches the cell on the other side
                    want |= {(p, r, c % 72 if grid.wraps else c) for r in range(grid.height) for c in cells if closed_hit(x1, y1, x2, y2, c, r) and (grid.wraps or 0 <= c < grid.width)}
        assert {(r.poly, r.r, r.c) for r in touched(vertices, grid).collect()} == want
        whole = {(r.poly, r.r, r.c) for r in footprints(vertices, grid).collect()}
        assert want <= whole and (3, *((18, 44) if grid.wraps else (10, 14))) in whole or not grid.wraps


def test_nearest_join_looks_around_from_either_side(spark):
    """More points than targets, and fewer: each with its nearest by the distances of all pairs."""
    from pyspark.sql import functions as F

    from meridia.operators.nearest import nearest_city

    some = [(k, lat, lon) for k, lat, lon in PLACES]
    few = [(100 + k, lat + 0.37 if lat < 89 else lat, wrap(lon + 0.21), 10 * k) for k, (_, lat, lon) in enumerate(some[::17])]
    for points, targets in ((some, few), (some[:4], few + [(500 + k, -lat, wrap(-lon), 5) for k, lat, lon in some[:60]])):
        table = spark.createDataFrame(targets, "city_id int, lat double, lon double, population int")
        got = nearest_city(spark.createDataFrame(points, "id int, lat double, lon double"), table, "id").select("id", F.col("distance_km").alias("d")).collect()
        assert len(got) == len(points)

        def unit(lat, lon):
            a, b = math.radians(lat), math.radians(lon)
            return np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])

        for r in got:
            here = unit(*next(p[1:] for p in points if p[0] == r.id))
            want = min(2 * 6371.0088 * math.asin(min(1, np.linalg.norm(here - unit(t[1], t[2])) / 2)) for t in targets)
            assert abs(r.d - want) < 1e-4
