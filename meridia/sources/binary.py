"""PNG rasters and WKB geometries, decoded in the tasks that read the files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGN = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray:
    """The pixels (height, width, 3) of an 8-bit RGB PNG without interlacing; anything else is an error."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not 8-bit RGB without interlacing")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + 3 * width)
    out = np.zeros((height, 3 * width), np.uint8)
    before = np.zeros(3 * width, np.int32)
    for r in range(height):
        kind, line = int(raw[r, 0]), raw[r, 1:].astype(np.int32)
        if kind == 1 or kind >= 3:
            line = _unfilter(kind, line, before)
        elif kind == 2:
            line = (line + before) & 255
        out[r] = before = line
    return out.reshape(height, width, 3)


def _unfilter(kind: int, line: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Filters that depend on the pixel to the left, three channels at a time."""
    if kind == 1:
        return (np.cumsum(line.reshape(-1, 3), axis=0) & 255).reshape(-1)
    now, up = line.copy(), before
    for k in range(0, len(line), 3):
        for j in range(k, k + 3):
            a, b, c = (int(now[j - 3]) if k else 0), int(up[j]), (int(up[j - 3]) if k else 0)
            if kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now[j] = (int(now[j]) + guess) & 255
    return now


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG; decode_png gives the pixels back."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, red, green, blue) of PNG files, a file to a task, its pixels in batches of rows."""
    return png_pixels(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path))


def png_pixels(files: DataFrame) -> DataFrame:
    """(path, r, c, red, green, blue) of images (path, content)."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            for name, data in zip(pdf["path"], pdf["content"]):
                pixels = decode_png(data)
                for at in range(0, len(pixels), 64):
                    some = pixels[at : at + 64]
                    r, c = np.mgrid[at : at + len(some), : some.shape[1]]
                    yield pd.DataFrame({"path": name, "r": r.ravel(), "c": c.ravel(), **{k: some[..., j].ravel().astype(int) for j, k in enumerate(("red", "green", "blue"))}})

    return files.select("path", "content").mapInPandas(run, "path string, r int, c int, red int, green int, blue int")


def owners(pixels: DataFrame, cities: int) -> DataFrame:
    """(r, c, v): owners in the two lower bytes, up to cities or 65535 for none; else an error when read."""
    v = F.col("red") + F.col("green") * 256
    good = (F.col("blue") == 0) & ((v <= cities) | (v == 65535))
    return pixels.select("r", "c", F.when(good, v).otherwise(F.raise_error(F.lit("owner out of range")).cast("int")).alias("v"))


def counts(pixels: DataFrame) -> DataFrame:
    """(r, c, v): 24-bit counts."""
    return pixels.select("r", "c", (F.col("red") * 65536 + F.col("green") * 256 + F.col("blue")).cast("long").alias("v"))


def decode_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Polygons of rings of (x, y) of a WKB or GeoPackage polygon or multipolygon, or a point as one ring of one; further dimensions are dropped."""
    at = 0
    if data[:2] == b"GP":
        at = 8 + (0, 32, 48, 48, 64)[data[3] >> 1 & 7]

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("geometry is cut off")
        at += size
        return struct.unpack(form, data[at - size : at])

    def one() -> list:
        nonlocal at
        order = "<" if take("B")[0] == 1 else ">"
        (code,) = take(order + "I")
        dims = 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3) + bool(code & 0x80000000) + bool(code & 0x40000000)
        kind = (code & 0xFFFF) % 1000
        point = lambda: take(f"{order}{dims}d")[:2]
        if kind == 1:
            return [[[point()]]]
        if kind == 3:
            return [[[point() for _ in range(take(order + "I")[0])] for _ in range(take(order + "I")[0])]]
        if kind == 6:
            return [p for _ in range(take(order + "I")[0]) for p in one()]
        raise ValueError(f"geometry of kind {kind}")

    return one()


def wkb_vertices(rows: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, poly, ring, ix, lat, lon) from a column of WKB."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            out = [(k, p, r, i, y, x) for k, data in zip(pdf[key], pdf[geometry]) for p, poly in enumerate(decode_wkb(data)) for r, ring in enumerate(poly) for i, (x, y) in enumerate(ring)]
            yield pd.DataFrame(out, columns=["key", "poly", "ring", "ix", "lat", "lon"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, geometry).mapInPandas(run, f"key {kind}, poly int, ring int, ix int, lat double, lon double").withColumnRenamed("key", key)
