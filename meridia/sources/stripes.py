"""Rasters as raw little-endian numbers of 16 bits, written and read in stripes of rows.

The reader is a data source that plans a partition for each stripe, so that a raster larger than a task's
memory is read by many; rows outside a window are not read at all. Files are reached by their address, in
any store that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meridia.operators.raster import Grid

BYTES = 2
CELL = pa.schema([("r", pa.int32()), ("c", pa.int32()), ("v", pa.int32())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Stripe(InputPartition):
    """Rows of a file: where they begin there, and in the raster."""

    def __init__(self, file: str, offset: int, row: int, rows: int):
        self.file, self.offset, self.row, self.rows = file, offset, row, rows


class StripeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.height, self.width = options["path"], int(options["height"]), int(options["width"])
        self.rows = int(options.get("striperows", 64))
        self.first, self.last = int(options.get("firstrow", 0)), int(options.get("lastrow", self.height - 1))
        self.left, self.right = int(options.get("firstcolumn", 0)), int(options.get("lastcolumn", self.width - 1))
        self.none = int(options["nodata"]) if "nodata" in options else None
        if min(self.height, self.width, self.rows) < 1:
            raise ValueError("a raster and its stripes have rows and columns")

    def partitions(self) -> list[InputPartition]:
        """The stripes that the window touches; files whose bytes together aren't those of the raster are an error."""
        store, path = _store(self.path)
        at = store.get_file_info(path)
        files = [at] if at.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
        line = self.width * BYTES
        if sum(f.size for f in files) != self.height * line or any(f.size % line for f in files):
            raise ValueError(f"{self.path} hasn't the bytes of {self.height} rows of {self.width}")
        out, row = [], 0
        for f in files:
            for start in range(0, f.size // line, self.rows):
                n = min(self.rows, f.size // line - start)
                if row + start <= self.last and row + start + n > self.first:
                    out.append(Stripe(f.path, start * line, row + start, n))
            row += f.size // line
        return out

    def read(self, partition: Stripe) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as source:
            raw = source.read_at(partition.rows * self.width * BYTES, partition.offset)
        if len(raw) != partition.rows * self.width * BYTES:
            raise ValueError(f"{partition.file} ends at byte {partition.offset + len(raw)}")
        cells = np.frombuffer(raw, "<u2").reshape(partition.rows, self.width)
        for k in range(max(0, self.first - partition.row), min(partition.rows, self.last - partition.row + 1)):
            v = cells[k, self.left : self.right + 1].astype(np.int32)
            r, c = np.full(len(v), partition.row + k, np.int32), np.arange(self.left, self.left + len(v), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), pa.array(v, mask=None if self.none is None else v == self.none)], schema=CELL)


class LabelStripes(DataSource):
    """Options: path, height, width; stripeRows; nodata, read as null; firstRow, lastRow, firstColumn, lastColumn."""

    @classmethod
    def name(cls) -> str:
        return "label_stripes"

    def schema(self) -> str:
        return "r int, c int, v int"

    def reader(self, schema) -> DataSourceReader:
        return StripeReader({k.lower(): v for k, v in self.options.items()})


def read_stripes(spark: SparkSession, path: str, height: int, width: int, **options) -> DataFrame:
    """(r, c, v) of a raw raster, a file or a folder of files in the order of their names."""
    spark.dataSource.register(LabelStripes)
    told = {"height": height, "width": width} | options
    return spark.read.format("label_stripes").options(**{k: str(v) for k, v in told.items()}).load(path)


def write_stripes(raster: DataFrame, path: str, height: int, width: int, rows: int = 64, nodata: int = 65535) -> int:
    """Write (r, c, v) as files of so many rows each, and say how many cells had a value.

    Cells that the raster lacks, and nulls, are ``nodata``. A value that doesn't fit, a cell outside and one
    met twice are errors. A task that is run again writes the same file again.
    """
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    spark = raster.sparkSession
    plan = spark.range(-(-height // rows)).select(F.col("id").alias("stripe"))
    sound = F.when(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1) & (F.coalesce("v", F.lit(0)).between(0, 65535)), F.floor(F.col("r") / rows))
    cells = raster.select(F.coalesce(sound, F.raise_error(F.lit("a cell or value out of range")).cast("long")).alias("stripe"), "r", "c", "v")

    def write(key: tuple, ours: pa.Table, held: pa.Table) -> pa.Table:
        stripe = key[0].as_py()
        top = stripe * rows
        out = np.full((min(rows, height - top), width), nodata, "<u2")
        r, c = held.column("r").to_numpy() - top, held.column("c").to_numpy()
        if len(np.unique(r * width + c)) != len(r):
            raise ValueError(f"a cell of stripe {stripe} is met twice")
        known = held.column("v").is_valid().to_numpy()
        out[r[known], c[known]] = held.column("v").to_numpy()[known]
        with _store(path)[0].open_output_stream(f"{folder}/stripe-{stripe:09d}.u16") as sink:
            sink.write(out.tobytes())
        return pa.table({"cells": pa.array([int(known.sum())], pa.int64())})

    written = plan.groupBy("stripe").cogroup(cells.groupBy("stripe")).applyInArrow(write, "cells long")
    return written.agg(F.sum("cells")).first()[0]


def sum_window(spark: SparkSession, path: str, source: Grid, target: Grid, nodata: int, stripe_rows: int = 64) -> DataFrame:
    """(r, c, v) of target: the sums of the source cells whose centre is in each cell; cells without any known one are left out."""
    south, east = target.north - target.height * target.step, target.west + target.width * target.step
    rows = (max(0, int(np.floor((source.north - target.north) / source.step))), min(source.height, int(np.ceil((source.north - south) / source.step))) - 1)
    columns = (max(0, int(np.floor((target.west - source.west) / source.step))), min(source.width, int(np.ceil((east - source.west) / source.step))) - 1)
    window = {"firstRow": rows[0], "lastRow": rows[1], "firstColumn": columns[0], "lastColumn": columns[1]}
    cells = read_stripes(spark, path, source.height, source.width, stripeRows=stripe_rows, nodata=nodata, **window).filter("v is not null")
    r = F.floor((target.north - (source.north - (F.col("r") + 0.5) * source.step)) / target.step).cast("int")
    c = F.floor((source.west + (F.col("c") + 0.5) * source.step - target.west) / target.step).cast("int")
    inside = cells.select(r.alias("r"), c.alias("c"), "v").filter(F.col("r").between(0, target.height - 1) & F.col("c").between(0, target.width - 1))
    return inside.groupBy("r", "c").agg(F.sum("v").alias("v"))
