"""Border graphs: crossings, routes and components, by frontiers that grow in joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="meridia-graph-"))
        folder = _own[0]
    return folder.rstrip("/")


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the session's shared folder and read again, and where it is."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/loop-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """df written and read again, so that loops keep short plans."""
    return kept(df)[0]


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing still to be computed reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crossings(edges: DataFrame, starts: DataFrame, most: int = 10_000) -> DataFrame:
    """(start, node, crossings, free): the least number of edges of cost 1 on the way, over edges (a, b, cost 0 or 1).

    Each round extends the frontier by free edges until nothing new is reached, then by one crossing;
    a node keeps its first, least, number. free: how many free edges came after the last crossing.
    """
    known = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("crossings"), F.lit(0).alias("free")))
    frontier, depth = known, 0
    while depth <= most:
        wave, hops = frontier, 0
        while True:
            hops += 1
            free = wave.join(edges.filter("cost = 0"), F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.lit(depth).alias("crossings"), F.lit(hops).alias("free")).distinct()
            wave = cut(free.join(known, ["start", "node"], "left_anti"))
            if not wave.limit(1).count():
                break
            known, frontier = cut(known.unionByName(wave)), cut(frontier.unionByName(wave))
        depth += 1
        step = frontier.join(edges.filter("cost = 1"), F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.lit(depth).alias("crossings"), F.lit(0).alias("free")).distinct()
        frontier = cut(step.join(known, ["start", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        known = cut(known.unionByName(frontier))
    else:
        raise RuntimeError(f"nodes are still reached after {most} crossings")
    return known


def reach_summary(found: DataFrame) -> DataFrame:
    """(start, reached, neighbours, most): how many others are reached, with one crossing, and the most crossings."""
    away = F.col("crossings") > 0
    return found.groupBy("start").agg(F.count_if(F.col("node") != F.col("start")).alias("reached"), F.count_if(F.col("crossings") == 1).alias("neighbours"), F.max(F.when(away, F.col("crossings"))).alias("most"))


def farthest(found: DataFrame) -> DataFrame:
    most = F.max("crossings").over(Window.partitionBy("start"))
    return found.withColumn("most", most).filter("crossings = most and crossings > 0").select("start", "node", "crossings")


def route(edges: DataFrame, start: int, goal: int) -> DataFrame:
    """(step, node) of a route with the fewest crossings; a single row when start is goal, none when it can't be reached.

    Each node's predecessor is the smallest node that is one edge nearer, fewer crossings first. The
    chain from the goal doubles each round: so many predecessors back, then twice as many.
    """
    spark = edges.sparkSession
    found = crossings(edges, spark.createDataFrame([(start,)], "start long")).drop("start")
    far = found.select(F.col("node").alias("b"), F.col("crossings").alias("depth"), F.col("free").alias("late"))
    nearer = (F.col("cost") == 1) & (F.col("crossings") == F.col("depth") - 1) | (F.col("cost") == 0) & (F.col("crossings") == F.col("depth")) & (F.col("free") == F.col("late") - 1)
    met = edges.join(found, F.col("a") == F.col("node")).join(far, "b").filter(nearer)
    up = cut(met.groupBy("b").agg(F.min(F.struct("crossings", "a")).alias("m")).select(F.col("b").alias("node"), F.col("m.a").alias("up")))
    path, span = cut(found.filter(F.col("node") == goal).select("node", F.lit(0).alias("back"))), 1
    while True:
        more = cut(path.join(up, "node").select(F.col("up").alias("node"), (F.col("back") + span).alias("back")))
        if not more.limit(1).count():
            break
        path, span = cut(path.unionByName(more)), 2 * span
        twice = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = cut(up.join(twice, "up").select("node", F.col("top").alias("up")))
    return path.crossJoin(F.broadcast(path.agg(F.max("back").alias("length")))).select((F.col("length") - F.col("back")).alias("step"), "node")


def merge_runs(path: DataFrame, key: str = "country") -> DataFrame:
    """Consecutive steps in one country as one: (first, last, country)."""
    all_, own = Window.orderBy("step"), Window.partitionBy(key).orderBy("step")  # a route has few steps
    island = F.row_number().over(all_) - F.row_number().over(own)
    return path.withColumn("island", island).groupBy(key, "island").agg(F.min("step").alias("first"), F.max("step").alias("last")).drop("island")


def most_connected(edges: DataFrame, k: int) -> DataFrame:
    return edges.filter("cost = 1").groupBy(F.col("a").alias("node")).agg(F.count_distinct("b").alias("degree")).orderBy(F.col("degree").desc(), "node").limit(k)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, edges taken both ways. Labels hop along edges, then along labels."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hopped = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = cut(hopped.join(own, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        labels = new.select("node", "component")
        if not new.filter("old <> component").limit(1).count():
            return labels


def symmetric_violations(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing."""
    return edges.select("a", "b").exceptAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


PAIRS = 8_000_000  #: pairs that a task holds at once, but for those of one part
USES = 1_000_000  #: uses that a task holds at once, but for those of one arc
RUN = 4096  #: most neighbours in a packed row


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes come to ``most`` at most, or of one item."""
    upto, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        yield i, j
        i = j


def _unlike(keys: list[np.ndarray]) -> np.ndarray:
    """The different ones of all keys, in order; the list is emptied, so that they are there once."""
    out = np.concatenate(keys)
    keys.clear()
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def packed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(a, bs): pairs in order as a row for each run of one a; bs are its b less the one before, the first less a, seven bits a byte."""
    first = np.concatenate([[True], a[1:] != a[:-1]]) | (np.arange(len(a)) % RUN == 0)
    rest = (b - np.where(first, a, np.concatenate([b[:1], b[:-1]]))).view(np.uint64)
    left, high = np.ones(len(b), np.int64), rest >> np.uint64(7)
    while high.any():
        left += high > 0
        high >>= np.uint64(7)
    ends = np.cumsum(left)
    data, at = np.empty(ends[-1], np.uint8), ends - left
    while len(at):
        more = left > 1
        data[at] = (rest & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, rest, left = at[more] + 1, rest[more] >> np.uint64(7), left[more] - 1
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], ends[starts[1:] - 1], ends[-1:]]).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(a[starts]), runs], ["a", "bs"])


def unpacked(rows: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b) of packed rows, some rows at a time."""
    part, runs = rows.column(0).to_numpy(), rows.column(1).cast(pa.binary())
    offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
    whole = np.frombuffer(runs.buffers()[2], np.uint8)
    for i, j in _spans(np.diff(offsets), most):
        data = whole[offsets[i] : offsets[j]]
        ends = np.flatnonzero(data < 128)
        starts = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
        steps = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).view(np.int64)
        upto = np.searchsorted(ends, offsets[i : j + 1] - offsets[i])
        sums, n = np.concatenate([[0], np.cumsum(steps)]), np.diff(upto)
        a = np.repeat(part[i:j], n)
        yield a, a + sums[1:] - np.repeat(sums[upto[:-1]], n)


def _arc_pairs(uses: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Packed pairs of the parts of different countries that have an arc in common; uses (arc, part, country) in order, arcs whole."""
    arc, part, country = uses.column(0), uses.column(1).to_numpy(), uses.column(2)
    country = pc.dictionary_encode(country).indices.to_numpy()
    fresh = np.concatenate([[True], pc.not_equal(arc.slice(1), arc.slice(0, len(arc) - 1)).to_numpy(zero_copy_only=False)])
    unlike = fresh.copy()
    unlike[1:] |= (part[1:] != part[:-1]) | (country[1:] != country[:-1])
    known, at = np.unique(part[unlike], return_inverse=True)
    country, begins = country[unlike], np.flatnonzero(fresh[unlike])
    sizes = np.diff(np.append(begins, len(at)))
    later = np.repeat(begins + sizes, sizes) - np.arange(len(at)) - 1
    held, n = [], 0
    for i, j in _spans(later, most // 8):
        x = np.repeat(np.arange(i, j), later[i:j])
        y = np.arange(len(x)) - np.repeat(np.cumsum(later[i:j]) - later[i:j], later[i:j]) + x + 1
        apart = country[x] != country[y]
        held.append(_unlike([at[x[apart]] * len(known) + at[y[apart]]]))
        n += len(held[-1])
        if n >= most or j == len(at):
            held = [_unlike(held)]
            n = len(held[0])
            if n > most // 2 or j == len(at):
                piece = max(1, most // 16)
                for low in range(0, n, piece):
                    keys = held[0][low : low + piece]
                    yield packed(known[keys // len(known)], known[keys % len(known)])
                held, n = [], 0


def arc_neighbours(uses: DataFrame) -> DataFrame:
    """(a, b), a <= b: each pair of parts of different countries that have an arc in common, once; uses: (part, country, arc).

    Parts are integers, countries and arcs numbers or strings. Arcs are dealt by ranges, as neighbours may have many
    parts in common; each range sends its different pairs, packed to some two bytes each, to their first part.
    The uses of one arc, and the neighbours of one part, must fit a task.
    """
    pairs, most = PAIRS, USES

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, most
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= due:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                arc = rows.column(0)
                last = np.flatnonzero(pc.not_equal(arc.slice(1), arc.slice(0, n - 1)).to_numpy(zero_copy_only=False))
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield from _arc_pairs(rows.slice(0, whole), pairs)
                held, n = [rows.slice(whole)], n - whole
                due = max(most, 2 * n)
        if n:
            yield from _arc_pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0], pairs)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        due = pairs // 4
        for x, y in chain((p for batch in batches for p in unpacked(batch, pairs // 16)), [(None, None)]):
            if x is not None:
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) and (x is None or len(a) >= due):
                first = np.concatenate([[True], a[1:] != a[:-1]])
                known, at = np.unique(b, return_inverse=True)
                keys = _unlike([(np.cumsum(first) - 1) * len(known) + at])
                a, b = a[first][keys // len(known)], known[keys % len(known)]
                whole = len(a) if x is None else int(np.searchsorted(a, a[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(a[:whole]), pa.array(b[:whole])], ["a", "b"])
                a, b = a[whole:], b[whole:]
                due = max(pairs // 4, 2 * len(a))

    known = uses.select("arc", F.col("part").cast("long").alias("part"), "country").dropna()
    dealt = known.repartitionByRange("arc").sortWithinPartitions("arc", "part", "country")
    sent = dealt.mapInArrow(pair, "a long, bs binary").repartition("a").sortWithinPartitions("a")
    return sent.mapInArrow(once, "a long, b long")


def shared_arc_borders(parts: DataFrame, water: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(a, b): parts (part, country, arcs) of different countries with a common arc, without water pairs, with reviewed ones."""
    return arc_borders(parts.select("part", "country", F.explode("arcs").alias("arc")), water, reviewed)


def arc_borders(uses: DataFrame, water: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(a, b): ``shared_arc_borders`` of parts that come as uses (part, country, arc). Pairs are made one way and turned around in the end."""
    met = arc_neighbours(uses)
    both = met.select(F.explode(F.when(F.col("a") < F.col("b"), F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).otherwise(F.array(F.struct("a", "b")))).alias("p")).select("p.*")
    kept = both.join(water.unionByName(reviewed).distinct(), ["a", "b"], "left_anti")
    return kept.unionByName(reviewed.distinct().join(water, ["a", "b"], "left_anti"))


def open_pairs(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """edges (a, b, country_a, country_b) that may be crossed: one country, an unknown one (0), or a pair in a rule (countries)."""
    one, two = (rules.select("rule", F.explode("countries").alias(c)) for c in ("x", "y"))
    pairs = one.join(two, "rule").filter("x <> y").select("x", "y").distinct()
    met = edges.join(pairs, (F.col("country_a") == F.col("x")) & (F.col("country_b") == F.col("y")), "left")
    return met.filter((F.col("country_a") == F.col("country_b")) | (F.col("country_a") == 0) | (F.col("country_b") == 0) | F.col("x").isNotNull()).drop("x", "y")
