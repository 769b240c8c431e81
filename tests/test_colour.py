"""Colours against published values; rules of published cities; overlapping tiles."""

import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import colour
from meridia.operators import assets

# fixed values: published test pairs of CIEDE2000
PAIRS = [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615),
    ((50.0, 2.5, 0.0), (50.0, 0.0, -2.5), 4.3065),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((22.7233, 20.0904, -46.694), (23.0331, 14.973, -42.5619), 2.0373),
    ((90.8027, -2.0831, 1.441), (91.1528, -1.6435, 0.0447), 1.4441),
    ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
    ((50.0, 0.0, 0.0), (50.0, 0.0, 0.0), 0.0),
]


def test_differences(spark):
    kind = "n int, a struct<l: double, a: double, b: double>, z struct<l: double, a: double, b: double>"
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(PAIRS)], kind)
    for one, other in (("a", "z"), ("z", "a")):
        got = {r.n: r.delta for r in colour.with_difference(rows, one, other, "delta").collect()}
        assert all(abs(got[k] - want) < 1e-4 for k, (_, _, want) in enumerate(PAIRS))


def test_contrast_and_sight(spark):
    rows = spark.createDataFrame([("#000000", "#ffffff"), ("#777777", "#777777"), ("#FF0000", "#00ff00")], "a string, b string")
    a, b = colour.from_hex(F.col("a")), colour.from_hex(F.col("b"))
    got = [round(r[0], 4) for r in rows.select(colour.contrast(a, b)).collect()]
    assert got[:2] == [21.0, 1.0] and abs(got[2] - 2.9139) < 1e-3
    grey = rows.limit(2).select(*(colour.seen_by(b, k).alias(k) for k in colour.SIMULATIONS)).collect()
    assert all(abs(c - w) < 2e-3 for r, w in zip(grey, (1.0, 0x77 / 255)) for k in colour.SIMULATIONS for c in r[k])
    mixed = rows.limit(1).select(colour.over(a, b, 0.5).alias("m")).first().m
    assert abs(mixed.r - 0.7354) < 1e-4
    with pytest.raises(Exception, match="not a colour"):
        spark.createDataFrame([("#12",)], "a string").select(colour.from_hex(F.col("a"))).collect()


def test_lightness_of_white_and_hues(spark):
    rows = spark.createDataFrame([("#ffffff",), ("#ff0000",)], "a string").withColumn("light", colour.light(colour.from_hex(F.col("a"))))
    got = colour.with_lab(rows, "light", "at").select("at", colour.lch(F.col("at")).alias("lch")).collect()
    assert abs(got[0].at.l - 100) < 1e-2 and abs(got[1].lch.h - 40) < 1
    assert spark.range(1).select(colour.hue_apart(F.lit(350.0), F.lit(10.0))).first()[0] == 20


KIND = "city_id long, owner_index long, population long, status string, threshold double, parent_id long, merged_into long, country_en string, country_zh string, name_zh string, match_type string, reviewed boolean"


def test_each_rule_of_published_cities(spark):
    sound = [
        (1, 1, 900, "root", None, None, None, "A", "B", None, "none", True),
        (2, 2, 500, "ok", 3.0, 1, None, "A", "B", "x", "exact", True),
        (3, 3, 100, "merged_at_resolution", None, None, 2, "A", "B", None, "none", False),
    ]
    assert assets.reach_violations(spark.createDataFrame(sound, KIND)).collect() == []
    faults = {
        "identity": (4, 9, 100, "ok", 1.0, 1, None, "A", "B", None, "none", True),
        "country name": (4, 4, 100, "ok", 1.0, 1, None, "A", None, None, "none", True),
        "name provenance": (4, 4, 100, "ok", 1.0, 1, None, "A", "B", "x", "none", True),
        "threshold state": (4, 4, 100, "ok", None, 1, None, "A", "B", None, "none", True),
        "merge state": (4, 4, 100, "ok", 1.0, 1, 2, "A", "B", None, "none", True),
        "parent": (4, 4, 1000, "ok", 1.0, 1, None, "A", "B", None, "none", True),
        "merge target": (4, 4, 100, "merged_at_resolution", None, None, 77, "A", "B", None, "none", True),
        "unreviewed root": (4, 4, 100, "no_larger_reachable", None, None, None, "A", "B", None, "none", False),
    }
    for rule, row in faults.items():
        assert [tuple(r) for r in assets.reach_violations(spark.createDataFrame([*sound, row], KIND)).collect()] == [(rule, 4)]
    twice = assets.reach_violations(spark.createDataFrame([*sound, sound[0]], KIND)).filter("rule = 'identity'").count()
    assert twice == 2


@pytest.mark.parametrize("side", [3, 64])
def test_overlapping_tiles(spark, side):
    r = random.Random(side)
    tiles = [(k % 2, r.randrange(30), r.randrange(30), r.randrange(1, 9), r.randrange(1, 9)) for k in range(60)]
    want = sum(
        a[0] == b[0] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]
        for i, a in enumerate(tiles) for b in tiles[:i]
    )
    table = spark.createDataFrame(tiles, "level int, r0 int, c0 int, rows int, cols int")
    got = {x.rule: x.n for x in assets.manifest_violations(table, 40, 40, side).collect()}
    assert got["tiles overlap"] == want and "tile outside" not in got
