"""Line dedup with levelled sorted runs of line hashes.

Documents arrive in batches of falling doc_id. A batch's long lines become rows (hash, documents,
largest doc_id), merge-anti-joined with the runs of hashes already settled, and what is left is
added as a sorted run of level 0. A level with ``fanout`` runs is compacted into one run of the next
level; hashes that reached ``min_docs`` documents move to the settled runs. Because ids only fall,
a settled hash needs nothing from later batches, and common lines stop travelling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.textops import Scratch, as_bytes, join_hot, pieces

_NO_ID = -(1 << 63)  # stands for a null doc_id, which counts as the smallest
HASHES = "h1 long, h2 long"
SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased; bytes methods touch ASCII only."""
    return line.strip().lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _long_keys(raw: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in raw.split(b"\n") if len(x) >= min_chars}
    return {k for k in keys if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars}


def line_hashes(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(batch, doc, h1, h2): each row's distinct long lines. Batch 0 has the largest ids."""
    cuts = docs.approxQuantile("doc_id", [1 - k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("doc") <= int(cut), 1).otherwise(0)
    schema = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(source):
            doc, h1, h2 = [], [], []
            for i, raw in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                for key in _long_keys(raw, min_chars):
                    a, b = key_hash(key)
                    doc.append(i)
                    h1.append(a)
                    h2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, h1, h2)], schema=schema)

    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("doc"), docs["text"].alias("text"))
    return keyed.mapInArrow(run, "doc long, " + HASHES).withColumn("batch", batch)


class LineRuns:
    """Levels of runs (h1, h2, n, top) whose batches have falling doc_ids; runs of settled hashes apart."""

    def __init__(self, scratch: Scratch, min_docs: int = 5, fanout: int = 3):
        self.scratch, self.min_docs, self.fanout = scratch, min_docs, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.settled: list[tuple[str, DataFrame]] = []
        self.made = 0

    def _run(self, rows: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run-{self.made}"
        return name, self.scratch.keep(rows.sortWithinPartitions("h1", "h2"), name)

    def _union(self, runs: list[tuple[str, DataFrame]]) -> DataFrame:
        out = runs[0][1]
        for _, r in runs[1:]:
            out = out.unionByName(r)
        return out

    def _merged(self, runs: list[tuple[str, DataFrame]]) -> DataFrame:
        return self._union(runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, lines: DataFrame) -> None:
        """lines: (doc, h1, h2), repeated rows allowed, all doc smaller than those of earlier batches."""
        rows = lines.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        if self.settled:
            # written as an outer join: an anti-join would be pushed below the counts, to all rows of a common line
            known = self._union(self.settled).select("h1", "h2", F.lit(True).alias("_settled"))
            rows = rows.join(known.hint("merge"), ["h1", "h2"], "left").filter("_settled is null").drop("_settled")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._run(rows))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        name, merged = self._run(self._merged(old))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._run(merged.filter(F.col("n") < self.min_docs)))
        self.settled.append(self._run(merged.filter(F.col("n") >= self.min_docs)))
        self.scratch.drop(name, *(n for n, _ in old))

    def repeated(self) -> DataFrame:
        """(h1, h2, n, top) of the hashes that min_docs documents hold, over all runs."""
        runs = [r for level in self.levels for r in level] + self.settled
        return self._merged(runs).filter(F.col("n") >= self.min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, texts: bool = False) -> DataFrame:
    """One row per row of docs: n_lines, n_dropped and the digest of what is kept (with texts, also ``kept``).

    A null or empty text is one empty line. Rows that share a doc_id are one document; a null doc_id
    is the smallest. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    line_hashes(docs, min_chars, batches).write.partitionBy("batch").parquet(scratch.path("lines"))
    log = spark.read.schema("doc long, " + HASHES + ", batch int").parquet(scratch.path("lines"))
    runs = LineRuns(scratch, min_docs, fanout)
    for k in range(batches):
        runs.add(log.filter(F.col("batch") == k))
    repeated = scratch.keep(runs.repeated(), "repeated")
    scratch.retain("lines", "repeated")
    doomed = join_hot(log, repeated, ["h1", "h2"], "n", log.count()).filter(F.col("doc") < F.col("top")).select("doc", "h1", "h2").distinct()
    doomed = scratch.keep(doomed, "doomed")
    scratch.retain("doomed")
    by_doc = doomed.groupBy("doc").agg(F.collect_list("h1").alias("h1"), F.collect_list("h2").alias("h2"))
    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if texts else [])])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(source):
            rows = []
            for i, raw, h1, h2 in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                lines = raw.split(b"\n")
                drop = set(zip(h1, h2)) if h1 else ()
                kept = [x for x in lines if len(x) < min_chars or key_hash(line_key(x)) not in drop] if drop else lines
                out = b"\n".join(kept)
                rows.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(out).hexdigest(), *([out.decode()] if texts else [])))
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    # never broadcast: dropped lines grow with the texts, so the plan is that of large tables at any size
    joined = keyed.join(by_doc.hint("merge"), "doc", "left").select("doc_id", "text", "h1", "h2")
    return joined.mapInArrow(run, SCHEMA + (", kept string" if texts else ""))
