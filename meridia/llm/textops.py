"""What the corpus operators share: words, row keys, scratch tables and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Runs of anything but ASCII white space.
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"
#: Runs of ASCII digits, lower-case ASCII letters and everything beyond ASCII.
PLAIN_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same runs over UTF-8 bytes: every byte of a character beyond ASCII is 0x80 or more.
PLAIN_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="meridia-"))
    return "file://" + _own_folder[0]


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.catalogued: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table whose rows lie by key in as many buckets as the session has shuffle partitions, so that joins by it don't move them."""
        known = f"meridia_{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("path", self.path(name)).option("compression", "uncompressed").bucketBy(buckets, key).sortBy(key).saveAsTable(known)
        self.catalogued[name] = known
        return self.spark.table(known)

    def retain(self, *names: str) -> None:
        """Remove all tables but these, once nothing still to be computed reads the others."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            self.drop(*({f.getPath().getName() for f in fs.listStatus(at)} - set(names)))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing still to be computed reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            if name in self.catalogued:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.catalogued.pop(name)}")
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


FEW_ROWS, SALTS = 10_000, 64


def join_few(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined by key with a table that has a key once: broadcast up to FEW_ROWS, counted; else rows of a common key are dealt to SALTS tasks."""
    if few.count() <= FEW_ROWS:
        return rows.join(F.broadcast(few), key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(SALTS)))
    return salted.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge"), [key, "_salt"], how).drop("_salt")


def join_hot(rows: DataFrame, sized: DataFrame, keys: list[str], n: str, total: int, most: int = 2_000) -> DataFrame:
    """rows joined by keys with ``sized``, which has each key once and in column n how many of rows have it.

    Keys with at least one ``most``-th of all rows, of which there can't be more than ``most``, are
    broadcast; the others are shuffled, so none of them deals more than that part to one task.
    """
    hot = F.col(n) * most >= total
    if not sized.filter(hot).limit(1).count():
        return rows.join(sized.hint("merge"), keys)
    marked = rows.join(F.broadcast(sized.filter(hot).withColumn("_hot", F.lit(True))), keys, "left")
    rest = marked.filter("_hot is null").select(rows.columns).join(sized.filter(~hot).hint("merge"), keys)
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_key(text: str = "text") -> Column:
    """Together with doc_id it tells rows apart; rows alike in both are one document met several times."""
    return F.xxhash64(F.col(text))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that long texts don't pile up as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
