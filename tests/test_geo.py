import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types

from meridia.functions import geo, scalars, solar, text
from meridia.operators import cartogram, circle, climate, graph, nearest, proximity, raster, reach, search, stats, zonal
from meridia.plans import params
from meridia.plans.views import inline

R = 6371.0088


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return round(2 * R * math.asin(math.sqrt(min(1, max(0, h)))), 6)


@pytest.fixture(scope="module")
def cities(spark):
    rng = random.Random(5)
    rows = [(k, f"c{k}", k % 9, rng.uniform(-89, 89), rng.uniform(-180, 180), rng.choice([100_000, 250_000, 900_000, 1_200_000, 5_000_000])) for k in range(120)]
    return spark.createDataFrame(rows, "city_id long, name string, country_id int, lat double, lon double, population long")


def test_distances(spark):
    row = spark.range(1).select(geo.haversine_km(0.0, 0.0, 0.0, 90.0).alias("q"), geo.haversine_km(0.0, 0.0, 0.0, 180.0).alias("h"), geo.haversine_atan2_km(10.0, 20.0, -30.0, 170.0).alias("a"), geo.chord_km(0.0, 0.0, 0.0, 180.0).alias("c")).first()
    assert row["q"] == pytest.approx(10007.557, abs=0.01) and row["h"] == pytest.approx(20015.11, abs=0.02)
    assert row["a"] == pytest.approx(km(10, 20, -30, 170)) and row["c"] == pytest.approx(2 * R)


def test_lines_and_circles(spark):
    df = spark.createDataFrame([(0, 10.0, 20.0, 10.0, 20.0), (1, 0.0, 0.0, 0.0, 180.0), (2, 0.0, 170.0, 0.0, -180.0)], "id int, a double, b double, c double, d double")
    got = {r["id"]: r["p"] for r in df.select("id", geo.geodesic_points("a", "b", "c", "d", 4).alias("p")).collect()}
    assert [(p["lat"], p["lon"]) for p in got[0]] == [(10.0, 20.0)] * 5 and got[1] == []
    assert got[2][-1]["lon"] == 180.0 and got[2][2]["lon"] == pytest.approx(175)
    ring = spark.range(1).select(F.explode(geo.circle_points(48.0, 2.0, 500.0, 2)).alias("p")).select("p.*").collect()
    assert len(ring) == 4 and all(km(48, 2, p["lat"], p["lon"]) == pytest.approx(500) for p in ring)
    m = geo.mollweide_inverse(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(m["lat"], m["lon"]).first()[:] == (0.0, 0.0)


@pytest.mark.parametrize("levels", [1, 4, 13])
def test_nearest_equals_all_pairs(spark, cities, levels, monkeypatch):
    monkeypatch.setattr(nearest, "LEVELS", levels)
    rng = random.Random(9)
    pts = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(80)] + [(98, 90.0, 0.0), (99, -90.0, 180.0)]
    points = spark.createDataFrame(pts, "point_id long, lat double, lon double")
    all_ = cities.collect()
    got = {r["point_id"]: (r["city_id"], r["distance_km"]) for r in nearest.nearest_join(points, nearest.as_targets(cities), "point_id", [-F.col("population"), F.col("city_id")]).collect()}
    for k, lat, lon in pts:
        d, _, i = min((km(lat, lon, c["lat"], c["lon"]), -c["population"], c["city_id"]) for c in all_)
        assert got[k] == (i, pytest.approx(d, abs=1e-6))


def test_nearest_ties_and_no_targets(spark, cities):
    two = spark.createDataFrame([(2, 0.0, 1.0, 10), (1, 0.0, -1.0, 20)], "city_id long, lat double, lon double, population long")
    here = spark.createDataFrame([(0, 0.0, 0.0)], "point_id long, lat double, lon double")
    assert nearest.nearest_city(here, two, "point_id").first()["city_id"] == 1
    assert nearest.nearest_city(here, cities.limit(0), "point_id").first()["city_id"] is None


def test_record_holders(spark, cities):
    line = spark.createDataFrame([(k, 0.0, float(k), p) for k, p in enumerate([1_000_000, 50_000, 200_000, 150_000, 600_000, 1_200_000])], "city_id long, lat double, lon double, population long")
    got = proximity.record_holders(line, 1_000_000).filter("focal_id = 0").orderBy("position").collect()
    assert [r["city_id"] for r in got] == [2, 4, 5]
    all_ = cities.collect()
    found = proximity.record_holders(cities, 900_000)
    for alpha in (0.1, 0.5, 1.0):
        for r in proximity.competitors(found, alpha).collect():
            f = next(c for c in all_ if c["city_id"] == r["focal_id"])
            best = min(((km(f["lat"], f["lon"], c["lat"], c["lon"]), -c["population"], c["city_id"]) for c in all_ if c["city_id"] != f["city_id"] and c["population"] >= alpha * f["population"]), default=None)
            assert r["city_id"] == (best and best[2])
    ranks = proximity.ranking(proximity.competitors(found, 0.5)).orderBy("rank").collect()
    assert [r["distance_km"] for r in ranks] == sorted((r["distance_km"] for r in ranks), reverse=True)


def test_record_holders_explode_few_rows_from_many_tasks(spark, cities, monkeypatch):
    """A rival is bounded by every other level and one search; what is exploded doesn't come from the one task of a small file."""
    exploded, written = [], []
    around, cut = proximity.around, proximity.cut
    monkeypatch.setattr(proximity, "around", lambda df, vector: (exploded.append(df), around(df, vector))[1])
    monkeypatch.setattr(proximity, "cut", lambda df: (written.append(df), cut(df))[1])
    proximity.record_holders(cities.coalesce(1), 900_000).collect()
    focal = cities.filter("population >= 900000").count()
    assert exploded[0].count() == 7 * focal and len(exploded) == 3
    assert "REPARTITION_BY_COL" in written[0]._jdf.queryExecution().toString()


@pytest.fixture
def small_ranges(spark):
    """Ranges are not put together, however small."""
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    yield
    spark.conf.unset(coalesced)


def numbered_in_one_task(df):
    return re.search(r"windowspecdefinition\((distance_km|city_id)", df._jdf.queryExecution().toString())


def test_rankings_are_numbered_by_ranges(spark, small_ranges):
    rng = random.Random(3)
    rows = [(k, rng.choice([8, 9]), None if k % 7 == 0 else k + 1, rng.choice([1.5, 2.25, 3.0, 40.0])) for k in range(400)]
    found = spark.createDataFrame(rows, "focal_id long, focal_population long, city_id long, distance_km double")
    ranked = proximity.ranking(found)
    there = sorted((-d, -p, k) for k, p, c, d in rows if c is not None)
    assert [(r["rank"], r["focal_id"], r["total"]) for r in ranked.orderBy("rank").collect()] == [(n + 1, k, len(there)) for n, (_, _, k) in enumerate(there)]
    assert not numbered_in_one_task(ranked) and ranked.schema["rank"].dataType == types.IntegerType()
    assert proximity.ranking(found.filter("false")).count() == 0


def test_referenced_cities_are_numbered_by_ranges(spark, small_ranges):
    holders = spark.createDataFrame([(k, k * 5 % 401) for k in range(0, 400, 3)], "focal_id long, city_id long")
    numbered = proximity.referenced(spark.range(1000).select(F.col("id").alias("city_id")), holders)
    ids = sorted({i for k in range(0, 400, 3) for i in (k, k * 5 % 401)})
    assert [(r["index"], r["city_id"]) for r in numbered.orderBy("index").collect()] == list(enumerate(ids))
    assert not numbered_in_one_task(numbered) and numbered.schema["index"].dataType == types.IntegerType()


def test_snapping(spark):
    grid = raster.Grid(180, 360, 1.0)
    cells = spark.createDataFrame([(45, 0, 5), (45, 359, 9), (40, 2, 7)], "r int, c int, v int")
    points = spark.createDataFrame([(1, 44.5, 1.5 - 180), (2, 44.5, -179.5), (3, 0.0, 0.0), (4, 44.5, 178.5)], "id int, lat double, lon double")
    got = {r["id"]: (r["v"], r["snapped"]) for r in raster.sample_snap(points, cells, grid, "id").collect()}
    assert got == {1: (5, True), 2: (5, False), 3: (None, None), 4: (9, True)}
    with pytest.raises(ValueError):
        raster.Grid(10, 10, 50.0)


def test_profile_and_half_radius(spark):
    cells = circle.prepare_cells(spark.createDataFrame([(0, 0, 100), (0, 1, 0), (1, 1, 300)], "r int, c int, v long"), 2, 4)
    points = spark.createDataFrame([(1, 45.0, -135.0)], "point_id long, lat double, lon double")
    prof = circle.profile(points, cells)
    assert sorted((r["bin"], r["pop"]) for r in prof.collect()) == [(0, 100), (13343, 300)] or prof.count() == 2
    d = km(45, -135, -45, -45)
    half = circle.radius_for_share(prof, (0.5,)).first()["radius_km"]
    assert half == pytest.approx(math.floor(d) + 100 / 300, abs=1e-5)
    assert circle.within(prof, 0.5).first()["pop"] == 50.0


def test_sun(spark):
    df = spark.createDataFrame([("2024-03-20T12:00Z",), ("2024-06-20T20:51Z",), ("2024-12-21T09:21Z",), ("2024-02-30T00:00Z",), ("x",)], "t string").withColumn("ts", solar.parse_minute(F.col("t")))
    sun = solar.subsolar(F.col("ts"))
    lat = [r[0] for r in df.filter("ts is not null").select(sun["lat"]).collect()]
    assert abs(lat[0]) < 0.6 and lat[1] == pytest.approx(23.45, abs=0.05) and lat[2] == pytest.approx(-23.44, abs=0.05)
    assert df.filter("ts is null").count() == 2 and df.filter("ts is not null").select(solar.format_minute(F.col("ts"))).first()[0] == "2024-03-20T12:00Z"
    e = solar.events(F.col("ts"), F.lit(80.0), F.lit(0.0))
    assert [r[0] for r in df.filter("ts is not null").select(e["kind"]).collect()] == ["events", "polar-day", "polar-night"]


def test_crossings_route_components(spark):
    edges = spark.createDataFrame([(a, b, c) for x, y, c in [(1, 2, 1), (2, 3, 1), (3, 4, 0), (4, 5, 1), (6, 7, 1)] for a, b in ((x, y), (y, x))], "a long, b long, cost int")
    got = {r["node"]: r["crossings"] for r in graph.crossings(edges, spark.createDataFrame([(1,)], "start long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3}
    assert [r["node"] for r in graph.route(edges, 1, 5).orderBy("step").collect()] == [1, 2, 3, 4, 5]
    assert graph.route(edges, 1, 7).count() == 0 and graph.route(edges, 1, 1).count() == 1
    nodes = spark.range(1, 9).select(F.col("id").alias("node"))
    assert {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8}


def all_paths(n, links):
    d = [[0.0 if a == b else math.inf for b in range(n)] for a in range(n)]
    for a, b, h in links:
        d[a][b] = d[b][a] = min(d[a][b], h)
    for k in range(n):
        for a in range(n):
            for b in range(n):
                d[a][b] = min(d[a][b], d[a][k] + d[k][b])
    return d


@pytest.mark.parametrize("side", [1, 2, 5])
def test_ownership_and_thresholds_equal_all_paths(spark, side):
    """20 random graphs on one grid of five columns, each in rows of its own, cut into tiles; ties of cost and of population."""
    rng = random.Random(991)
    width, links, towns, sources, want_t, want_o = 5, [], [], [], {}, {0.0: {}, 1.0: {}, 4.0: {}}
    populations = [10**5, 10**6, 10**6, 2 * 10**6, 10**7, 10**7]
    for g in range(20):
        n, base = 10, g * 10
        mine = [(a, b, float(rng.randint(1, 8))) for a in range(n) for b in range(a) if rng.random() < 0.25]
        d = all_paths(n, mine)
        links += [(base + a, base + b, h) for a, b, h in mine]
        cells = rng.sample(range(n), 7)
        own = {base + k + 1: cells[k : k + 1] + (cells[6:] if k == 3 else []) for k in range(6)}
        size = dict(zip(own, populations))
        towns += [(c, size[c], base + own[c][0], None) for c in own]
        sources += [(c, base + cell) for c in own for cell in own[c]]
        for c in own:
            best = min(((round(d[own[c][0]][cell] / (math.log10(size[k]) - math.log10(size[c])), 9), -size[k], k) for k in own if size[k] > size[c] for cell in own[k]), default=(math.inf,))
            want_t[c] = ("ok", best[0], best[2]) if best[0] < math.inf else ("root" if size[c] == 10**7 else "no_larger_reachable", None, None)
        for level, want in want_o.items():
            for v in range(n):
                best = min((round(level * (7 - math.log10(size[k])) + d[cell][v], 9), -size[k], k) for k in own for cell in own[k])
                if best[0] < math.inf:
                    want[base + v] = (best[2], best[0])
    edges = spark.createDataFrame([x for a, b, h in links for x in ((a, b, h), (b, a, h))], "a long, b long, hours double")
    cities = spark.createDataFrame([*towns, (900, 5, None, 3), (901, 5, None, None)], "city_id long, population long, centre long, merged_into long")
    starts = spark.createDataFrame(sources, "city_id long, node long")
    got = {r["city_id"]: (r["status"], r["threshold"], r["parent"]) for r in reach.thresholds(edges, cities, starts, width, side).collect()}
    assert got == want_t | {900: ("merged_at_resolution", None, None), 901: ("transport_missing", None, None)}
    for level, want in want_o.items():
        owned = reach.ownership(edges, reach.seeds(cities, starts, level), width, side).collect()
        assert {r["node"]: r["city_id"] for r in owned} == {v: w[0] for v, w in want.items()}
        assert {r["node"]: r["cost"] for r in owned} == pytest.approx({v: w[1] for v, w in want.items()}, abs=1e-8)


def test_city_ranks_over_partitions(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(1, 20)) for k in range(200)]
    got = {r["city_id"]: r["rank"] for r in reach.city_ranks(spark.createDataFrame(rows, "city_id long, population long")).collect()}
    assert got == {c: n for n, (c, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}


def test_smallest_half_circle_is_the_least_of_its_lattice(spark):
    """Two towns in one cell each; the larger holds more than half, so the circle shrinks onto its cell."""
    rows = [(10, 20, 600), (30, 60, 300), (31, 61, 100)]
    raster = spark.createDataFrame(rows, "r int, c int, v long")
    got = circle.smallest_half_circle(raster, 36, 72, factor=1).first()
    assert (got["lat"], got["lon"]) == pytest.approx((90 - 10.5 * 5, 20.5 * 5 - 180), abs=0.6) and got["radius_km"] <= 1 and got["population"] == 500


def test_cartogram_of_two_blocks():
    import numpy as np

    rho = np.ones((16, 32))
    rho[:, 8:16] = 2
    x, y = cartogram.solve(rho, sigma=0.5)
    area = cartogram.cell_areas(x, y)
    assert (area > 0).all() and area.sum() == pytest.approx(16 * 32, rel=1e-6)
    assert area[:, 8:16].sum() / area.sum() == pytest.approx(2 * 8 / 40, rel=0.03)


def test_cartogram_flux_solves_poisson():
    import numpy as np

    h, w = 16, 32
    i = (np.arange(h) + 0.5) / h
    field = 1 + 0.1 * np.cos(np.pi * i)[:, None] * np.cos(2 * np.pi * np.arange(w) / w)[None, :]
    gx, gy = cartogram.flux(field)
    k2 = (np.pi / h) ** 2 + (2 * np.pi / w) ** 2
    assert np.abs(gx - 0.1 / k2 * 2 * np.pi / w * np.cos(np.pi * i)[:, None] * np.sin(2 * np.pi * np.arange(w) / w)[None, :]).max() < 1e-9


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.parse_alpha(F.lit("0.337")).alias("a"), scalars.parse_alpha(F.lit("x")).alias("b"), scalars.parse_radius(F.lit("49")).alias("c"), scalars.parse_radius(F.lit("1234")).alias("d"),
        scalars.slider_to_radius(scalars.radius_to_slider(F.lit(1500.0))).alias("e"), scalars.ratio_band(F.lit(0.5)).alias("f"), scalars.ratio_band(F.lit(2.0)).alias("g"), scalars.ratio_band(F.lit(None).cast("double")).alias("h"),
        scalars.round_half_up(F.lit(-2.5)).alias("i"), scalars.format_share(F.lit(0.0005)).alias("j"), scalars.status_key(F.lit("ok")).alias("k"),
    ).first()
    assert row[:] == (0.34, 0.5, None, 1234.0, 1505.0, 2, 4, -1, -2, "<0.1%", "reach.ok")


def test_radius_steps(spark):
    """One kilometre below 200, five below 2000, ten above; a slider of a thousand steps."""
    km = [10.0, 50.0, 199.4, 199.6, 303.0, 1997.0, 1999.0, 3333.0, 19_998.0, 30_000.0]
    df = spark.createDataFrame([(x,) for x in km], "km double")
    got = [r[:] for r in df.select(scalars.round_radius(F.col("km")), scalars.radius_to_slider(F.col("km"))).collect()]
    assert [r[0] for r in got] == [50, 50, 199, 200, 305, 1995, 2000, 3330, 20_000, 20_000]
    assert [r[1] for r in got] == [math.floor(math.log(min(max(x, 50), 20_000) / 50) / math.log(400) * 1000 + 0.5) for x in km]
    ends = df.limit(1).select(*(scalars.slider_to_radius(F.lit(x)) for x in (-5.0, 0.0, 1000.0, 2000.0))).first()
    assert ends[:] == (50, 50, 20_000, 20_000)


def test_aliases_are_found_without_accents(spark):
    df = spark.createDataFrame([(1, "Sampa", ["São Paulo"], "Brazil", 1, 9)], "city_id long, name string, aliases array<string>, place string, feature_rank int, population long")
    assert all(search.search(df, q).count() == 1 for q in ("sao paulo", "são paulo", "SÃO-PAU", "paulo"))


def test_errors_stops_and_frames(spark):
    units = spark.createDataFrame([(1.0, 2.0, 1.0), (None, 4.0, 1.0), (5.0, None, 1.0), (3.0, 3.0, None), (9.0, 1.0, 0.1)], "actual double, target double, share double")
    assert stats.area_errors(units, 0.5).first()[:] == (3, 0.5, math.inf, math.inf)
    p90 = [0.5, 0.4, 0.399, 0.398, 0.397, 0.3, 0.149]
    rounds = spark.createDataFrame([("m", k, 0.04 if k == 7 else 0.2, x) for k, x in enumerate(p90, 1)] + [("n", 16, 0.2, 0.5)], "metric string, round int, p50 double, p90 double")
    assert {(r["metric"], r["round"]): r["reason"] for r in stats.stop_reasons(rounds).collect() if r["reason"]} == {("m", 5): "plateau", ("m", 7): "raw-pass", ("n", 16): "max-rounds"}
    ticks = spark.createDataFrame([("a", t) for t in (0, 10, 20, 60)] + [("b", 5)], "who string, at long")
    assert stats.frame_stats(ticks, "who", "at").collect()[0][:] == ("a", 4, 60.0, 50.0, 10.0, 40.0, 40.0, round(100 / 3, 6))
    totals = lambda rows: spark.createDataFrame(rows, "id int, total double")
    met = zonal.compare_totals(totals([(1, 0.0), (2, 1e-10), (3, None), (4, 5.0), (5, 1.0)]), totals([(1, 0.0), (2, 2e-10), (3, None), (4, None), (5, 1.0 + 1e-10)]))
    assert {r["id"]: r["equal"] for r in met.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_loops_that_hit_their_caps_raise(spark):
    import numpy as np

    line = spark.createDataFrame([(k, k + 1, 1) for k in range(4)], "a long, b long, cost int")
    with pytest.raises(RuntimeError):
        graph.crossings(line, spark.createDataFrame([(0,)], "start long"), most=1)
    with pytest.raises(RuntimeError):
        cartogram.solve(np.random.default_rng(0).random((8, 16)) + 0.1, most_steps=2)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_and_records_equal_brute_force(spark, seed):
    """Points at the poles and the date line, places met twice, ties of distance and of population."""
    rng = random.Random(seed)
    spot = lambda: (rng.choice([90.0, -90.0, 0.0, round(rng.uniform(-90, 90), 2)]), rng.choice([-180.0, 179.99, 0.0, round(rng.uniform(-180, 180), 2)]))
    towns = [(k, *spot(), rng.randint(1, 30)) for k in range(60)]
    asked = [(k, *spot()) for k in range(40)]

    def hav(p, q, m=1.0):
        a, b, c, e = map(math.radians, (*p, *q))
        return round(2 * 6371.0088 * math.asin(math.sqrt(min(1.0, max(0.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((e - b) / 2) ** 2)))), 6)

    cities = spark.createDataFrame(towns, "city_id long, lat double, lon double, population long")
    points = spark.createDataFrame(asked, "point_id long, lat double, lon double")
    got = {r["point_id"]: r["distance_km"] for r in nearest.nearest_focal(points, cities, "point_id").collect()}
    assert got == pytest.approx({i: min(hav((y, x), t[1:3]) for t in towns) for i, y, x in asked}, abs=1e-3)
    assert nearest.nearest_city(points, cities.limit(0), "point_id").filter("city_id is null").count() == 40
    want = {}
    for f in towns:
        if f[3] >= 10:
            largest, list_ = 0, []
            for t in sorted((t for t in towns if t[0] != f[0]), key=lambda t: (hav(f[1:3], t[1:3]), -t[3], t[0])):
                if t[3] > largest:
                    largest = t[3]
                    if t[3] >= 0.1 * f[3]:
                        list_.append(t[0])
                    if t[3] >= f[3]:
                        break
            want[f[0]] = list_
    found = {}
    for r in proximity.record_holders(cities, 10).orderBy("focal_id", "position").collect():
        found.setdefault(r["focal_id"], []).append(r["city_id"])
    assert found == {k: v for k, v in want.items() if v}


def test_text(spark):
    df = spark.createDataFrame([(" São-Paulo! ",), ("ABC  d",), ("Ｎａïve",), (None,), ("北京",)], "t string")
    got = [r[:] for r in df.select(text.normalize(F.col("t")), text.script_of(F.col("t"))).collect()]
    assert got == [("sao paulo", "Latin"), ("abc d", "Latin"), ("naive", "Latin"), (None, None), ("北京", "Han")]


def test_search_tiers(spark):
    rows = [(1, "Tokyo", [], "Japan", 1, 9), (2, "Old", ["tokyo"], "Japan", 1, 9), (3, "Tokyo Bay", [], "Japan", 1, 9), (4, "New Tokyo", [], "Japan", 1, 9), (5, "Xtokyox", [], "Japan", 1, 9), (6, "Kyoto", [], "Tokyo area", 1, 9), (7, "Tokyo", [], "Japan", 0, 1)]
    df = spark.createDataFrame(rows, "city_id long, name string, aliases array<string>, place string, feature_rank int, population long")
    assert [r["city_id"] for r in search.search(df, " TOKYO ").collect()] == [7, 1, 2, 3, 4, 5]
    assert search.search(df, "t").collect() == []


def test_percentiles(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 1.0, 4.0, 2.0, 3.0]], "x double")
    assert stats.nearest_rank(df, "x", (0.5, 0.9)).first()[:] == (5, 3.0, 5.0)
    with pytest.raises(ValueError):
        stats.assert_empty(df, "rows")


def test_links_round_trip():
    state = params.parse("?v=2&mode=isolation&point=10.5,-190&alpha=0.3&view=field&reach=8&radius=77")
    assert state["lat"] is None and state["alpha"] == 0.3 and state["reach"] == 8.0 and state["radius"] is None
    state = params.parse("mode=circle&point=-45.123456,180&radius=500")
    again = params.parse(params.serialize(state))
    assert params.same_point(state, again) and again["radius"] == 500.0 and state["lon"] == -180.0
    assert params.parse("mode=nothing")["mode"] is None


def test_links_in_columns(spark):
    df = spark.createDataFrame([("?mode=circle&point=1.5,2",), ("point=91,0&mode=x",)], "q string")
    c = params.columns(F.col("q"))
    assert [r[:] for r in df.select(c["mode"], c["lat"], c["lon"]).collect()] == [("circle", 1.5, 2.0), (None, None, None)]


def test_inline_puts_views_in_order():
    sql = inline("SELECT * FROM {label}")
    assert sql.index("cell AS") < sql.index("label AS") and "{" not in sql


def test_exploded_rows_are_never_broadcast(spark, cities):
    placed = nearest.with_vector(cities, "lat", "lon", nearest.T)
    asked = nearest.around(nearest.in_cubes(nearest.with_vector(cities.select(F.col("city_id").alias("id"), "lat", "lon"), "lat", "lon", nearest.P), nearest.P), nearest.P)
    plan = asked.select("id", "level", "cube").join(nearest.in_cubes(placed, nearest.T), ["level", "cube"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_competitors_broadcast_no_exploded_rows(spark, cities, monkeypatch):
    """Whatever reads record holders: no plan on the way sends rows below an explode to all tasks."""
    written, cut = [], graph.cut
    monkeypatch.setattr(proximity, "cut", lambda df: (written.append(df), cut(df))[1], raising=False)
    found = proximity.competitors(proximity.record_holders(cut(cities), 900_000), 0.5)  # a file, whose size is known
    for df in (*written, found):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        depths = [re.search(r"[A-Za-z(*]", line).start() if line.strip() else 0 for line in lines]
        for k, line in enumerate(lines):
            if "BroadcastExchange" in line:
                end = next((j for j in range(k + 1, len(lines)) if depths[j] <= depths[k]), len(lines))
                grouped = next((j for j in range(k, end) if "Aggregate" in lines[j]), end)
                assert not any("Generate" in below for below in lines[k:grouped])


def test_snapping_looks_around_cells_not_points(spark):
    grid = raster.Grid(180, 360, 1.0)
    cells = spark.createDataFrame([(45, 1, 5)], "r int, c int, v int")
    found = raster.sample_snap(spark.range(5_000).select(F.col("id"), F.lit(44.5).alias("lat"), F.lit(-179.5).alias("lon")), cells, grid, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    explode = next(k for k, line in enumerate(lines) if "explode" in line)
    assert any("Aggregate" in line for line in lines[explode:]) and found.filter("v = 5 and snapped").count() == 5_000


def test_climate_lists_equal_all_pairs(spark):
    rng = random.Random(8)
    # clustered places, poles and repeated latitudes
    lats = [rng.choice([rng.uniform(-90, 90), 89.5, 12.25, -90.0, 12.25 + rng.choice([1, -1]), rng.gauss(40, 1)]) for _ in range(700)]
    rows = [(k, lat, rng.choice([rng.uniform(-180, 180), rng.gauss(10, 4)]), rng.randrange(1, 200), rng.randrange(4), rng.randrange(3)) for k, lat in enumerate(lats)]
    asked = [(k, rng.choice([12.25, 90.0, -90.0, 40.0, rng.uniform(-90, 90), 0.0]), rng.choice([10.0, rng.uniform(-180, 180)]), rng.randrange(4)) for k in range(40)]
    cities = spark.createDataFrame(rows, "city_id long, lat double, lon double, population long, class int, country_id int")
    points = spark.createDataFrame(asked, "point_id long, p_lat double, p_lon double, p_class int")

    def expected(key, fits):
        out = set()
        for p, y, x, own in asked:
            heads = {}
            for c in sorted(rows, key=lambda c: (-c[3], c[0])):
                if fits(y, x, own, c):
                    heads.setdefault(key(c), c)
            out |= {(p, n + 1, c[0]) for n, c in enumerate(sorted(heads.values(), key=lambda c: (-c[3], c[0]))[:3])}
        return out

    same = expected(lambda c: c[4], lambda y, x, own, c: abs(c[1] - y) <= 1 and c[4] not in (0, own) and km(y, x, c[1], c[2]) >= 500)
    far = expected(lambda c: c[5], lambda y, x, own, c: c[4] == own > 0 and km(y, x, c[1], c[2]) >= 3000)
    assert {(r["point_id"], r["position"], r["city_id"]) for r in climate.same_latitude(points, cities).collect()} == same
    assert {(r["point_id"], r["position"], r["city_id"]) for r in climate.far_twins(points, cities).collect()} == far
    # ten thousand places of one class: a point anywhere needs few
    many = spark.range(10_000).select(F.col("id").alias("city_id"), F.lit(1).alias("class"), (F.col("id") % 7 / 10).alias("lat"), (F.rand(3) * 360 - 180).alias("lon"), (F.hash("id") % 1000).alias("population"))
    assert climate._leading(many, ["class"], 500.0).count() < 50


def test_circles_point_by_point(spark):
    rng = random.Random(4)
    cells = circle.prepare_cells(spark.createDataFrame([(r, c, rng.randrange(4)) for r in range(18) for c in range(36)], "r int, c int, v long"), 18, 36)
    rows = [(k % 25, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(30)] + [(99, None, 5.0)]  # some keys twice, one nowhere
    points = spark.createDataFrame(rows, "point_id long, lat double, lon double")
    all_, people = cells.select("ux", "uy", "uz", "pop").collect(), {}
    for k, lat, lon in rows:
        u = (0, 0, 0) if lat is None else (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))
        for c in all_:
            at = circle.BINS if lat is None else min(circle.BINS, math.floor(round(2 * R * math.asin(min(1, math.dist(u, c[:3]) / 2)), 6)))
            people[k, at] = people.get((k, at), 0) + c["pop"]
    prof = circle.profile(points, cells)
    assert {(r["point_id"], r["bin"]): r["pop"] for r in prof.collect()} == people
    assert "CartesianProduct" not in (plan := prof._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    shares = sorted(map(tuple, circle.radius_for_share(prof, circle.MILESTONES).select("point_id", "share", "radius_km").collect()))
    assert sorted(map(tuple, circle.radii_of_shares(points, cells, circle.MILESTONES).collect())) == shares
    names = circle.summary(prof, 2500.5).columns
    assert sorted(map(tuple, circle.summed_up(points, cells, 2500.5).select(*names).collect())) == sorted(map(tuple, circle.summary(prof, 2500.5).collect()))
    assert circle.profile(points, cells.limit(0)).count() == 0 and circle.measured(points, cells.limit(0), 1.0, (0.5,)).count() == 0


def test_turns_take_the_remainder_twice(spark):
    rng = random.Random(2)
    rows = [(round(rng.uniform(-180, 180), 2), round(rng.uniform(-180, 180), 2)) for _ in range(500)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", geo.turn_from("a", "b").alias("t"), F.pmod(F.col("b") - F.col("a"), F.lit(360.0)).alias("pmod")).collect()
    assert all(r["t"] == math.fmod(math.fmod(r["b"] - r["a"], 360) + 360, 360) for r in got) and any(r["t"] != r["pmod"] for r in got)


def test_ranks_and_matches_keep_to_ranges_and_cubes(spark):
    rng = random.Random(6)
    values = [rng.choice([None, float("inf"), 1.5, rng.random()]) for _ in range(301)]
    known = sorted(v for v in values if v is not None)
    found = stats.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.5, 0.9, 1.0))
    assert tuple(found.first()) == (len(known), *(known[math.ceil(s * len(known)) - 1] for s in (0.5, 0.9, 1.0)))
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(stats.nearest_rank(spark.createDataFrame([], "v double"), "v", (0.5,)).first()) == (0, None)
    # places near a pole and the date line
    lon = [rng.uniform(179.7, 180.3) for _ in range(300)]
    places = [(k, f"p {k % 3}", rng.choice([rng.uniform(-0.4, 0.4), rng.uniform(89.6, 90)]), (x + 180) % 360 - 180) for k, x in enumerate(lon)]
    cities, cands = places[:150], [(k, n, y, x, k % 5) for k, n, y, x in places[150:]]
    got = search.match_names(spark.createDataFrame(cities, "city_id long, name string, lat double, lon double"), spark.createDataFrame(cands, "cand_id long, cand_name string, cand_lat double, cand_lon double, cand_population long"), spark.createDataFrame([], "city_id long, override long"))
    for r in got.collect():
        _, name, y, x = cities[r["city_id"]]
        away = [(km(y, x, c[2], c[3]), c) for c in cands]
        exact = min(((d, -c[4], c[0]) for d, c in away if c[1] == name and d <= 50), default=None)
        near = min(((-c[4], d, c[0]) for d, c in away if d <= 30), default=None)
        assert r["match"] == (exact or near or (None,))[-1] and r["kind"] == ("exact" if exact else "review" if near else "none")
    assert "band" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_shared_arcs_meet_by_ranges_of_arcs(spark):
    """Against a loop; no arcs are joined with each other, and pairs are counted once before they are shuffled."""
    rng = random.Random(9)
    parts = [(p, p % 4, [rng.randrange(40) for _ in range(6)] + [None]) for p in range(30)] + [(99, 1, [])]
    table = spark.createDataFrame(parts, "part long, country long, arcs array<long>")
    pairs = lambda v: spark.createDataFrame(v, "a long, b long")
    want = {(p, q) for p, c, a in parts for q, d, b in parts if c != d and {x for x in a if x is not None} & {x for x in b if x is not None}}
    gone = sorted(want)[0]
    out = graph.shared_arc_borders(table, pairs([gone, (77, 78)]), pairs([(1, 5), (77, 78)]))
    rows = [(r.a, r.b) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == (want | {(1, 5)}) - {gone}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join LeftAnti") and "RepartitionByExpression [arc" in plan


def test_shared_arcs_send_their_pairs_packed(spark):
    """Neighbours without any order among their arcs: some bytes a pair are shuffled, not a row each."""

    def sent(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return sent(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return sent(node.plan())
        own = node.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(sent(node.children().apply(i)) for i in range(node.children().size()))

    rng = random.Random(4)
    users = {arc: {rng.randrange(800) for _ in range(20)} for arc in range(4000)}
    table = spark.createDataFrame([(f"arc {arc}", sorted(us)) for arc, us in users.items()], "arc string, us array<long>")
    place = lambda p: (p - 400) * 2**52
    parts = table.select(F.explode("us").alias("p"), "arc").groupBy("p").agg(F.collect_list("arc").alias("arcs"))
    parts = parts.select(((F.col("p") - 400) * 2**52).alias("part"), F.concat(F.lit("c"), F.col("p") % 3).alias("country"), F.concat("arcs", "arcs").alias("arcs"))
    parts = parts.unionByName(spark.createDataFrame([(7, None, ["arc 1"]), (None, "c9", ["arc 1"]), (-5, "x", ["y"]), (-5, "z", ["y"]), (-9, "z", ["y"])], parts.schema))
    out = graph.shared_arc_borders(parts, spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(3, 4)], "a long, b long"))
    want = {(place(p), place(q)) for us in users.values() for p in us for q in us if p % 3 != q % 3} | {(-5, -5), (-5, -9), (-9, -5), (3, 4)}
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    few = parts.select(F.explode("arcs").alias("arc"), (F.col("part") / 2**52).cast("long").alias("part"), "country")
    near = graph.shared_arc_borders(few.groupBy("part", "country").agg(F.collect_list("arc").alias("arcs")), *[spark.createDataFrame([], "a long, b long")] * 2)
    assert len(near.collect()) > 380_000
    assert sent(near._jdf.queryExecution().executedPlan()) < 6 * len(rows)
