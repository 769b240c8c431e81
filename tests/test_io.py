import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.sources import binary, sinks, tables
from meridia.streaming import live


def test_png_round_trip(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (70, 9, 3)).astype(np.uint8)
    data = binary.encode_png(pixels)
    assert (binary.decode_png(data) == pixels).all()
    (tmp_path / "a.png").write_bytes(data)
    got = binary.read_png(spark, str(tmp_path)).orderBy("r", "c").collect()
    assert [r["green"] for r in got] == pixels[..., 1].ravel().tolist()
    with pytest.raises(ValueError):
        binary.decode_png(data[:-20] + b"\0" * 20)
    assert binary.counts(spark.createDataFrame([(0, 0, 1, 2, 3)], "r int, c int, red int, green int, blue int")).first()["v"] == 65536 + 512 + 3


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    pixels = rng.integers(0, 256, (5, 4, 3)).astype(int)
    raw, before = b"", np.zeros(12, int)
    for line in pixels.reshape(5, 12):
        out = []
        for j, v in enumerate(line):
            a, b, c = (line[j - 3] if j >= 3 else 0), before[j], (before[j - 3] if j >= 3 else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - {1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kind]) % 256)
        raw += bytes([kind, *out])
        before = line
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (binary.decode_png(data) == pixels).all()


def test_owner_pixels_are_checked(spark):
    df = spark.createDataFrame([(0, 0, 5, 1, 0)], "r int, c int, red int, green int, blue int")
    assert binary.owners(df, 300).first()["v"] == 261
    with pytest.raises(Exception, match="owner out of range"):
        binary.owners(df, 10).collect()


def test_wkb(spark):
    ring = struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    polygon = struct.pack("<BII", 1, 3, 1) + ring
    multi = struct.pack("<BII", 1, 6, 2) + polygon + polygon
    assert len(binary.decode_wkb(multi)) == 2
    header = b"GP" + bytes([0, 0b11]) + struct.pack("<i", 4326) + struct.pack("<4d", 0, 1, 0, 1)
    rows = binary.wkb_vertices(spark.createDataFrame([(7, bytearray(header + polygon))], "id long, g binary"), "id", "g").orderBy("ix").collect()
    assert [(r["id"], r["lat"], r["lon"]) for r in rows] == [(7, 0.0, 0.0), (7, 0.0, 1.0), (7, 1.0, 1.0), (7, 0.0, 0.0)]
    with pytest.raises(ValueError):
        binary.decode_wkb(polygon[:-3])
    assert binary.decode_wkb(struct.pack(">BI3d", 0, 1001, 3, 4, 5)) == [[[(3.0, 4.0)]]]


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1\tA\tA\t\t10.5\t20.5\tP\tPPLC\tFR\t\t11\t\t\t\t5000\t\t1\tx\t2020\nbad line\n2\tB\tB\t\t95\t0\tP\tPPL\tFR\t\t\t\t\t\t1\t\t1\tx\t2020\n")
    assert [r["geonameid"] for r in tables.city_rows(spark, str(tmp_path / "c.txt")).collect()] == [1]
    (tmp_path / "l.txt").write_text("header\n    1:  Af   Tropical, rainforest                  [0 0 255]\n    2:  Am   Tropical, monsoon   [0 120 255]\n")
    assert [(r["class"], r["code"], r["b"]) for r in tables.legend(spark, str(tmp_path / "l.txt")).collect()] == [(1, "Af", 255), (2, "Am", 255)]
    (tmp_path / "q.csv").write_text('a,b\n1,"x, ""y"""\n,\n2,"two\nlines"\n')
    assert [r["b"] for r in tables.read_csv(spark, str(tmp_path / "q.csv"), "a int, b string").collect()] == ['x, "y"', "two\nlines"]


def test_compact_index(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"formatVersion":2,"strings":["Paris","France","Lutetia"],"rows":[["9","0","1","1","48.8","2.3","2100000","[2,2,0]"]]}')
    row = tables.compact_index(spark, str(tmp_path / "i.json")).first()
    assert (row["city_id"], row["name"], row["country"], row["aliases"]) == (9, "Paris", "France", ["Lutetia", "Paris"])


def test_an_index_in_lines_is_one_document(spark, tmp_path):
    """Its pieces together are the JSON document; no line holds more than one string or row, however small its stretches are."""
    words = ['Sa"o, [x]', "a\nb\u2028c\r", ",leading", "{brace", "", "z"]
    rows = [(9 - k // 2, words[k % 6], f"n{k % 3}" if k % 5 else None, k / 8, k / 4, k) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, name string, land string, lat double, lon double, population long")
    strings, coded = sinks.dictionary_encode(df, ["name", "land"])
    ref = lambda c: F.col(f"{c}_ref").cast("string")
    row = F.array(F.col("id").cast("string"), ref("name"), ref("land"), ref("land"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("population").cast("string"), F.concat(F.lit("["), ref("land"), F.lit("]")))
    sinks.write_index(strings, coded, f"file://{tmp_path}/i", "id", row)
    text = "".join(p.read_text(newline="") for p in sorted((tmp_path / "i").glob("part-*")))
    whole = json.loads(text)
    assert whole["formatVersion"] == 2 and whole["strings"] == sorted(set(words) | {"n0", "n1", "n2"}) and len(whole["rows"]) == 40
    assert [int(r[0]) for r in whole["rows"]] == sorted(r[0] for r in rows)
    assert max(map(len, text.split("\n"))) < 80
    expected = sorted((r[0], r[1], r[2] or "", [r[2]] if r[2] else None, r[3], r[5]) for r in rows)
    (tmp_path / "one.json").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        for path, lines in ((f"file://{tmp_path}/i", True), (f"file://{tmp_path}/one.json", True), (f"file://{tmp_path}/one.json", False)):
            got = tables.compact_index(spark, path, lines=lines).collect()
            assert sorted((r["city_id"], r["name"], r["country"] or "", r["aliases"], r["lat"], r["population"]) for r in got) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_position_out_of_range_is_an_error(spark, tmp_path):
    for bad in ("3", "-2"):
        (tmp_path / "i.json").write_text('{"formatVersion":2,"strings":["Paris","France","Lutetia"],"rows":[["9","%s","1","1","48.8","2.3","2100000","[2]"]]}' % bad)
        with pytest.raises(Exception, match="position out of range"):
            tables.compact_index(spark, str(tmp_path / "i.json")).collect()


def test_joins_that_must_match(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "x")], "id int, v string")
    assert tables.left_join_required(a.filter("id = 1"), b, "id").first()["v"] == "x"
    with pytest.raises(Exception, match="no match"):
        tables.left_join_required(a, b, "id").collect()


def test_topology(spark):
    t = spark.createDataFrame([([1.0, 1.0], [0.0, 0.0], [[[0, 0], [2, 0]], [[0, 0], [0, 2], [2, 0], [0, -2]]], [(5, [[[0, -2]]])])], "scale array<double>, translate array<double>, arcs array<array<array<long>>>, objects array<struct<id:int,polygons:array<array<array<int>>>>>")
    got = [(r["lon"], r["lat"]) for r in tables.topology_rings(t).orderBy("ix").collect()]
    assert got == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]


def test_tiles_and_bands(spark):
    plan = tables.tile_requests(spark, 10, 0, -15, 25).collect()
    assert len(plan) == 9 and min(r["south"] for r in plan) == -15 and max(r["east"] for r in plan) == 25
    bands = spark.createDataFrame([(1, "pop 2020"), (2, "pop 12020")], "band int, description string")
    assert tables.year_band(bands, 2020).first()["band"] == 1
    with pytest.raises(ValueError):
        tables.year_band(bands, 1999)


def test_publish_replaces_whole_sets(spark, tmp_path):
    target = f"file://{tmp_path}/set"
    sinks.publish(spark, {"a": spark.range(3), "b": spark.range(1)}, target)
    sinks.publish(spark, {"a": spark.range(5)}, target)
    assert spark.read.parquet(f"{target}/a.parquet").count() == 5 and [p.name for p in tmp_path.iterdir()] == ["set"]
    with pytest.raises(Exception):
        sinks.publish(spark, {"a": spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x"))}, target)
    assert spark.read.parquet(f"{target}/a.parquet").count() == 5


def test_dictionary_and_cache(spark, tmp_path):
    strings, coded = sinks.dictionary_encode(spark.createDataFrame([("b", "a"), ("c", None)], "x string, y string"), ["x", "y"])
    assert [r["string"] for r in strings.orderBy("position").collect()] == ["a", "b", "c"]
    assert sorted((r["x_ref"], r["y_ref"]) for r in coded.collect() if r["y_ref"] is not None) == [(1, 0)]
    calls = []
    make = lambda: (calls.append(1), spark.range(4))[1]
    for _ in range(2):
        assert sinks.cached(spark, f"file://{tmp_path}", sinks.computation_id(grid=1), make).count() == 4
    assert len(calls) == 1


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0, 0.0, 0.4), ("2024-01-01 00:02:00", "a", 2.0, 50.0, 100.0), ("2024-01-01 00:31:00", "b", 3.0, 0.0, 179.9)], "ts string, event_type string, value double, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/in")
    cities = spark.createDataFrame([(1, 0.0, 0.0, 10), (2, 0.0, -179.9, 5)], "city_id long, lat double, lon double, population long")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = live.nearest_in_cells(stream, cities).writeStream.format("memory").queryName("near").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["lon"], r["city_id"]) for r in spark.table("near").collect()) == [(0.4, 1), (100.0, None), (179.9, 2)]
    q = live.window_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    assert live.sun_over(events.select("ts"), cities.select(F.col("city_id").alias("point_id"), "lat", "lon")).count() == 6
