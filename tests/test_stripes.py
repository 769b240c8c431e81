"""Raw rasters in stripes: what is written is read, windows read no more than they need, damage is an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.operators.raster import Grid
from meridia.sources import stripes

HEIGHT, WIDTH = 23, 7
CELLS = {(r, c): (r * 31 + c * 7) % 500 for r in range(HEIGHT) for c in range(WIDTH) if (r + c) % 4}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('stripes')}/raster"
    rows = [(r, c, v) for (r, c), v in CELLS.items()] + [(0, 0, None)]
    assert stripes.write_stripes(spark.createDataFrame(rows, "r int, c int, v int"), path, HEIGHT, WIDTH, rows=5) == len(CELLS)
    return path


@pytest.mark.parametrize("size", [1, 3, 100])
def test_read_what_was_written(spark, written, size):
    got = {(x.r, x.c): x.v for x in stripes.read_stripes(spark, written, HEIGHT, WIDTH, stripeRows=size, nodata=65535).collect()}
    assert got == {(r, c): CELLS.get((r, c)) for r in range(HEIGHT) for c in range(WIDTH)}
    raw = stripes.read_stripes(spark, written, HEIGHT, WIDTH, stripeRows=size).filter("v = 65535").count()
    assert raw == HEIGHT * WIDTH - len(CELLS)


def test_a_single_file_and_its_window(spark, tmp_path):
    whole = np.arange(HEIGHT * WIDTH, dtype="<u2").reshape(HEIGHT, WIDTH)
    (tmp_path / "one.u16").write_bytes(whole.tobytes())
    df = stripes.read_stripes(spark, str(tmp_path / "one.u16"), HEIGHT, WIDTH, stripeRows=4, firstRow=6, lastRow=11, firstColumn=2, lastColumn=3)
    assert {(x.r, x.c): x.v for x in df.collect()} == {(r, c): int(whole[r, c]) for r in range(6, 12) for c in (2, 3)}
    options = {"path": str(tmp_path / "one.u16"), "height": HEIGHT, "width": WIDTH, "striperows": 4, "firstrow": 6, "lastrow": 11}
    assert [(p.row, p.rows) for p in stripes.StripeReader(options).partitions()] == [(4, 4), (8, 4)]


def test_damage_is_an_error(spark, tmp_path, written):
    (tmp_path / "short.u16").write_bytes(b"\0" * (HEIGHT * WIDTH * 2 - 2))
    with pytest.raises(Exception, match="hasn't the bytes"):
        stripes.read_stripes(spark, str(tmp_path / "short.u16"), HEIGHT, WIDTH).collect()
    reader = stripes.StripeReader({"path": written, "height": HEIGHT, "width": WIDTH})
    part = reader.partitions()[-1]
    with pytest.raises(ValueError, match="ends at byte"):
        list(reader.read(stripes.Stripe(part.file, part.offset, part.row, part.rows + 1)))
    for bad, said in (((0, WIDTH, 1), "out of range"), ((0, 0, 70000), "out of range"), ((1, 1, 5), "met twice")):
        table = spark.createDataFrame([(1, 1, 5), bad], "r int, c int, v int")
        with pytest.raises(Exception, match=said):
            stripes.write_stripes(table, f"file://{tmp_path}/bad", HEIGHT, WIDTH)


def test_sums_of_a_window(spark, written):
    source, target = Grid(HEIGHT, WIDTH, 2.0, 40.0, 10.0), Grid(3, 2, 5.0, 33.0, 11.0)
    want = {}
    for (r, c), v in CELLS.items():
        y, x = 40.0 - (r + 0.5) * 2, 10.0 + (c + 0.5) * 2
        at = (int((33.0 - y) // 5), int((x - 11.0) // 5))
        if 0 <= at[0] < 3 and 0 <= at[1] < 2:
            want[at] = want.get(at, 0) + v
    got = stripes.sum_window(spark, written, source, target, 65535, 4)
    assert {(x.r, x.c): x.v for x in got.collect()} == want
    assert got.filter(F.col("v").isNull()).count() == 0
