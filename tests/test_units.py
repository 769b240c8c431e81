"""Units of country and region rasters against plain loops."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meridia.operators import units

CELLS = "r int, c int, lab int"
ADMINS = "admin int, country int, code string, adm0 string, name string, name_zh string"


def km2(r, height, width):
    band = math.sin(math.radians(90 - r * 180 / height)) - math.sin(math.radians(90 - (r + 1) * 180 / height))
    return band * 2 * math.pi / width * 6371.0088**2


def plain(drawn, regions, admins, height, width, least, wraps):
    """(unit of each cell as (country, region), transfers {region: country}, remnants {(country, region): (to, edges)})."""
    cells = {k: (v, regions.get(k, 0)) for k, v in drawn.items() if v}
    area, whole = Counter(), Counter()
    for (r, _), pair in cells.items():
        area[pair] += km2(r, height, width)
    for (r, _), a in regions.items():
        whole[a] += km2(r, height, width)
    area = {k: round(v, 6) for k, v in area.items()}
    parent, moved = {}, {}
    for admin, given, *_ in admins:
        held = [(area[p], -p[0]) for p in area if p[1] == admin]
        parent[admin] = given
        if held:
            most, country = max(held)
            if -country != given and most / whole[admin] >= least:
                parent[admin] = moved[admin] = -country
    code = {a[0]: a[2] for a in admins}
    eligible = {p for p in area if p[1] and parent.get(p[1]) == p[0]}
    edges = Counter()
    for (r, c), pair in cells.items():
        for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            at = (r + i, (c + j) % width if wraps else c + j)
            if at in cells and cells[at][0] == pair[0] and cells[at] != pair:
                edges[pair, cells[at]] += 1
    into, remnants = {p: p for p in eligible}, {}
    for pair in area.keys() - eligible:
        own = [q for q in eligible if q[0] == pair[0]]
        best = min(own, key=lambda q: (-edges[pair, q], -area[q], code[q[1]]), default=None)
        into[pair] = best or (pair[0], 0)
        if best:
            remnants[pair] = (best[1], edges[pair, best])
    return {k: into[p] for k, p in cells.items()}, moved, remnants


def tables(spark, drawn, regions, admins):
    raster = lambda cells: spark.createDataFrame([(*k, v) for k, v in cells.items()], CELLS)
    countries = spark.createDataFrame([(v, f"ne-{v}") for v in sorted(set(drawn.values()) - {0})], "country int, country_id string")
    return raster(drawn), raster(regions), countries, spark.createDataFrame(admins, ADMINS)


@pytest.mark.parametrize(("seed", "wraps"), [(1, True), (2, False)])
def test_classification_equals_plain_loops(spark, seed, wraps):
    rng, height, width = random.Random(seed), 12, 16
    drawn = {(r, c): (r // 4) * 3 + c // 6 + 1 if rng.random() < 0.95 else 0 for r in range(height) for c in range(width)}
    regions = {(r, c): (r // 3) * 5 + (c + (r % 4 == 0)) // 4 + 1 for r in range(height) for c in range(width) if rng.random() < 0.9}
    listed = sorted(set(regions.values()))[1:]  # one region is drawn but not listed
    admins = [(a, rng.choice([None, *range(1, 9)]), f"c{-a % 7}-{a}", rng.choice(["KOS", "AAA", None]), rng.choice(["Crimea", "Plain", None]), rng.choice(["zh", " ", None])) for a in listed]
    want, moved, remnants = plain(drawn, regions, admins, height, width, 0.95, wraps)
    got = units.classified(*tables(spark, drawn, regions, admins), height, width, wraps=wraps)
    named = {r.label: (r.country, r.admin) for r in got.units.collect()}
    assert {(r.r, r.c): named[r.lab] for r in got.cells.collect()} == want
    ids = [r.unit_id for r in got.units.orderBy("label").collect()]
    assert ids == sorted(ids) and sorted(named) == list(range(1, len(ids) + 1))
    told = got.adjustments.collect()
    assert {r.admin: r.country_id for r in told if r.kind == "transfer"} == {a: f"ne-{c}" for a, c in moved.items()}
    code = {a[0]: a[2] for a in admins}
    assert {(r.country_id, r.admin): (r.unit_id, r.edges) for r in told if r.kind == "remnant"} == {(f"ne-{c}", a): (f"ne-{c}:{code[to]}", e) for (c, a), (to, e) in remnants.items()}
    assert moved or seed == 2
    assert {r.reason for r in told} >= {None, "longest shared edge"} or not moved
    for r in told:
        assert r.needs_review == (r.category is None)
    zh = {a[0]: a[5] for a in admins}
    cover = units.name_coverage(got.units, tables(spark, drawn, regions, admins)[3]).first()
    assert (cover.units, cover.named, cover.whole_countries) == (len(ids), sum(zh.get(a) == "zh" for _, a in named.values()), sum(a == 0 for _, a in named.values()))


def test_remnants_without_shared_edges_go_to_the_largest_region_then_code(spark):
    drawn = {(0, c): 1 for c in range(7)} | {(1, c): 2 for c in range(7)}
    regions = {(0, 0): 10, (0, 1): 10, (0, 3): 11, (0, 4): 11, (0, 6): 12}
    admins = [(10, 1, "b", None, None, None), (11, 1, "a", None, None, None), (12, 2, "z", None, None, None)]
    got = units.classified(*tables(spark, drawn, regions, admins), 2, 8, least=1.0, wraps=False)
    told = {(r.kind, r.admin): r for r in got.adjustments.collect()}
    assert told["transfer", 12].country_id == "ne-1" and told["transfer", 12].share == 1.0
    assert told["remnant", 0].unit_id == "ne-1:a" and told["remnant", 0].edges == 2  # two edges with each of two equal regions
    assert {r.unit_id for r in got.units.collect()} == {"ne-1:a", "ne-1:b", "ne-1:z", "ne-2:ADM0"}
    apart = {(0, 0): 1, (0, 1): 1, (0, 4): 1}
    got = units.classified(*tables(spark, apart, {(0, 0): 10, (0, 1): 11}, [(10, 1, "b", None, None, None), (11, 1, "a", None, None, None)]), 2, 8, wraps=False)
    only = got.adjustments.collect()
    assert [(r.unit_id, r.edges, r.reason) for r in only] == [("ne-1:a", 0, "no shared edge")]


def test_a_region_needs_the_share_and_shares_are_bounded(spark):
    drawn = {(0, c): 1 if c < 19 else 2 for c in range(20)}
    regions = dict.fromkeys(drawn, 5)
    args = tables(spark, drawn, regions, [(5, 2, "x", None, None, None)])
    assert units.classified(*args, 1, 20).adjustments.filter("kind = 'transfer'").count() == 1  # 19 of 20 cells
    assert units.classified(*args, 1, 20, least=0.96).adjustments.filter("kind = 'transfer'").count() == 0
    with pytest.raises(ValueError, match="0.95"):
        units.classified(*args, 1, 20, least=0.5)


def test_empty_rasters(spark):
    got = units.classified(*tables(spark, {}, {}, []), 4, 8)
    assert got.units.count() == got.cells.count() == got.adjustments.count() == 0
    assert units.overlap_share(spark.createDataFrame([], "country int, r int, c int"), 4, 8).first().share == 0


def test_categories_are_met_in_order(spark):
    rows = [
        ("KOS", "Crimea", "ne-1", "Kosovo"), ("AAA", "northern CYPRUS hills", "ne-1", "Northern Cyprus"), ("SOL", None, "ne-1", "Somaliland"), (None, "sevastopol", "ne-1", "Crimea"),
        ("IND", "Arunachal", "ne-156", "Arunachal / 藏南"), ("IND", "Arunachal", "ne-356", None), ("IND", "Ladakh", "ne-156", "Aksai Chin"), (None, "Ladakh", "ne-156", None),
        (None, None, "ne-x-bir-tawil", "Bir Tawil"), (None, None, "ne-732", "Western Sahara"), ("M", None, "ne-1", "merged territory"), (None, None, "ne-1", None),
    ]
    got = spark.createDataFrame(rows, "a string, n string, i string, want string").withColumn("got", units.category(F.col("a"), F.col("n"), F.col("i"), ("M",)))
    assert got.filter("not (got <=> want)").collect() == []


def test_overlap_is_the_area_of_cells_of_several_countries(spark):
    held = [(1, 0, 0), (1, 0, 1), (2, 0, 1), (2, 3, 1), (2, 3, 1), (3, 3, 2)]
    got = units.overlap_share(spark.createDataFrame(held, "country int, r int, c int"), 4, 8).first()
    assert got.overlap_km2 == pytest.approx(km2(0, 4, 8)) and got.share == pytest.approx(0.25)


def test_descriptions_equal_plain_loops(spark):
    rng, height, width = random.Random(4), 9, 12
    cells = {(r, c): 1 + (r // 3 + c // 5) % 3 for r in range(height) for c in range(width) if rng.random() < 0.85}
    parts, seen = defaultdict(list), set()
    around = lambda r, c: [(r + i, (c + j) % width) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)) if 0 <= r + i < height]
    for k, lab in cells.items():
        if k in seen:
            continue
        part, stack = [], [k]
        seen.add(k)
        while stack:
            at = stack.pop()
            part.append(at)
            new = [n for n in around(*at) if cells.get(n) == lab and n not in seen]
            seen.update(new)
            stack += new
        parts[lab].append(part)
    got = {r.lab: r for r in units.described(spark.createDataFrame([(*k, v) for k, v in cells.items()], CELLS), height, width).collect()}
    assert got.keys() == parts.keys()
    for lab, found in parts.items():
        size = lambda part: sum(km2(r, height, width) for r, _ in part)
        best = min(found, key=lambda p: (-round(size(p), 3), min(p)))
        # a border cell has a neighbour of another label beside it; rows end the grid
        border = {k for k, v in cells.items() if v == lab and any(cells.get(n) != lab for n in around(*k))}
        steps, layer, n = {}, border, 0
        while layer:
            steps |= dict.fromkeys(layer, n)
            layer, n = {m for k in layer for m in around(*k) if cells.get(m) == lab and m not in steps}, n + 1
        row = got[lab]
        assert row.cells == sum(map(len, found)) and row.area_km2 == pytest.approx(sum(map(size, found)))
        assert row.largest_km2 == pytest.approx(size(best))
        assert (row.r, row.c) in best
        top = max((steps[k] for k in best if k in steps), default=None)
        if 0 < min(r for r, _ in best) and max(r for r, _ in best) < height - 1:
            assert row.distance == top == steps[row.r, row.c]
