"""Merkle dataset manifest: a hash tree over the rows of each group, and one over the groups' roots.

Rows become digests where they are read, so texts are never shuffled. Digests are dealt by ranges of
(group, order), numbered by row_number within a range plus the rows of the ranges before, and from then on
a level is one DataFrame: indices are divided by the fanout, the sorted children of a run are hashed into
its parent, until each group has one node left. Proofs come down the same levels: a join gives a node's
children what its own proof holds, after their siblings. A level has a fanout-th of the rows of the one
below, so all levels together move each digest about twice, and a proof moves once as long as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.textops import FEW_ROWS, Scratch, join_few

PATH = "array<struct<left: binary, right: binary>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_WHOLE = ""  # the group of a tree over the roots of groups


def encoded(value: Column) -> Column:
    """A value told apart from any other and from null: its UTF-8 byte count, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """SHA-256 of strings set after each other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def group_key(value: Column) -> Column:
    """A null group is a group of its own, beside every string."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value.cast("string")))


def number_rows(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows (g, o, hash, ...) with idx, the row's place in its group by (o, hash), and n, the rows of the group.

    Ranges hold about equally many rows however large a group is; rows alike in everything are dealt by
    where they were read.
    """
    keys = ["g", "o", "hash", "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("pid", F.spark_partition_id())
    ranged = scratch.keep(ranged, f"{name}-ranged")
    parts = ranged.groupBy("g", "pid").agg(F.count("*").alias("held"))
    before = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.keep(parts.select("g", "pid", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("g")).alias("n")), f"{name}-parts")
    numbered = ranged.withColumn("at", F.row_number().over(Window.partitionBy("pid", "g").orderBy("o", "hash", "tie")))
    few = parts.count() <= FEW_ROWS
    joined = numbered.join(F.broadcast(parts) if few else parts.hint("merge"), ["g", "pid"])
    return joined.withColumn("idx", F.col("before") + F.col("at") - 1).drop("tie", "pid", "at", "before", "o")


def parents(nodes: DataFrame, fanout: int, extra: list[str]) -> DataFrame:
    """One level up: (g, idx, n, hash, kids) of each run of nodes of the groups that have more than one left."""
    runs = nodes.filter("n > 1").groupBy("g", F.expr(f"idx div {fanout}").alias("up"))
    grouped = runs.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "hash", *extra))).alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: as_hex(k["hash"])), "")
    return grouped.select("g", F.col("up").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(joined).alias("hash"), "kids")


def _children(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(g, idx, hash, extra, path) of the kids of nodes (g, kids, path): their siblings, then what the parent has."""
    one = nodes.select("g", "kids", "path", F.posexplode("kids").alias("pos", "kid"))

    def side(kids: Column) -> Column:
        return F.unhex(F.array_join(F.transform(kids, lambda k: F.hex(k["hash"])), ""))

    step = F.struct(side(F.slice("kids", F.lit(1), F.col("pos"))).alias("left"), side(F.slice("kids", F.col("pos") + 2, F.size("kids"))).alias("right"))
    return one.select("g", "kid.idx", "kid.hash", *(f"kid.{c}" for c in extra), F.concat(F.array(step), "path").cast(PATH).alias("path"))


def hash_tree(rows: DataFrame, fanout: int, scratch: Scratch, name: str, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows: (g, o, hash, extra). Returns (g, hash) of each group's root, and (g, hash, extra, path) of each row.

    Everything but the last step is written level by level to scratch, so lost executors cost a level at most.
    """
    if fanout < 2:
        raise ValueError("a fanout of at least 2 is needed")
    leaves = scratch.keep(number_rows(rows, scratch, name), f"{name}-0")
    scratch.drop(f"{name}-ranged", f"{name}-parts")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        k = len(levels)
        levels.append(scratch.keep(parents(levels[-1], fanout, extra if k == 1 else []), f"{name}-{k}"))
        most = -(-most // fanout)
    none = F.array().cast(PATH)
    roots = leaves.filter("n = 1").select("g", "hash")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter("n = 1").select("g", "hash"))
    roots = scratch.keep(roots, f"{name}-roots")
    down = leaves.filter("n = 1").select("g", "idx", "hash", *extra, none.alias("path"))
    above = None
    for k in range(len(levels) - 1, 0, -1):
        nodes = levels[k].select("g", "idx", "kids")
        if above is None:
            nodes = nodes.withColumn("path", none)
        else:
            nodes = nodes.join(above.hint("merge"), ["g", "idx"], "left").withColumn("path", F.coalesce("path", none))
        below = _children(nodes, extra if k == 1 else [])
        if k == 1:
            down = down.unionByName(below)
        else:
            above = scratch.keep(below.select("g", "idx", "path"), f"{name}-path-{k}")
            scratch.drop(f"{name}-{k}", f"{name}-path-{k + 1}")
    return roots, down.drop("idx")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings, from below to the top, lead to."""
    return F.aggregate(path, leaf, lambda at, step: digest(as_hex(step["left"]), as_hex(at), as_hex(step["right"])))


def proof_digest(path: Column) -> Column:
    """Lowercase hex SHA-256 of all siblings' hex digests, from below to the top, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(as_hex(s["left"]), as_hex(s["right"]))), ""), 256)


def build_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", fanout: int = 2, claims: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: order, leaf, claimed, subroot and root as 32 bytes each, and path, the proof.

    ``claims`` replaces columns by what someone says they hold; ``claimed`` is the digest of that row, null
    where it equals the leaf. The path leads from the leaf by its group's root to the root of all groups,
    which are in the order of their names, null first. Rows of a group ascend by ``order``, null first, those
    alike in it by digest; rows alike in all columns are leaves of their own. Nulls in any column have a
    digest of their own; other columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    true = {c: docs[c] for c in columns}
    leaf = digest(*(encoded(v) for v in true.values()))
    rows = docs.select(group_key(docs[group]).alias("g"), docs[order].alias("o"), leaf.alias("hash"), docs[order].alias("own"), *([digest(*(encoded(v) for v in (true | claims).values())).alias("claimed")] if claims else []))
    rows = rows.withColumn("claimed", F.nullif(F.col("claimed"), F.col("hash")) if claims else F.lit(None).cast("binary"))
    roots, leaves = hash_tree(rows, fanout, scratch, "rows", ["own", "claimed"])
    # a key without its mark is the name; null, marked by a dash, is null again and comes first
    name = F.when(F.col("g") != "-", F.substring("g", 2, 2**31 - 1))
    tops = roots.select(F.lit(_WHOLE).alias("g"), name.alias("o"), "hash", F.col("g").alias("group"))
    whole, tops = hash_tree(tops, fanout, scratch, "groups", ["group"])
    tops = tops.join(F.broadcast(whole.withColumnRenamed("hash", "root")), "g")
    tops = scratch.keep(tops.select(F.col("group").alias("g"), F.col("hash").alias("subroot"), F.col("path").alias("upper"), "root"), "tops")
    out = join_few(leaves, tops, "g")
    return out.select(F.col("own").alias(order), F.col("hash").alias("leaf"), "claimed", "subroot", "root", F.concat("path", "upper").alias("path"))


def manifest_report(docs: DataFrame, fanout: int = 2, modulus: int = 7) -> DataFrame:
    """One row per row of docs: its digests, its proof's digest, and whether the row as claimed leads to the root.

    Rows whose doc_id's CRC-32 ``modulus`` divides claim one character more than they have; a null n_chars
    or doc_id claims nothing else than it has. For the other cases see :func:`build_manifest`.
    """
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % modulus == 0
    made = build_manifest(docs, fanout=fanout, claims={"n_chars": F.when(tampered, docs["n_chars"] + 1).otherwise(docs["n_chars"])})
    folded = made.withColumn("folded", fold(F.coalesce("claimed", "leaf"), F.col("path")))
    digests = (as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root"))
    return folded.select(F.col("doc_id").cast("long").alias("doc_id"), *digests, proof_digest(F.col("path")).alias("proof_sha256"), as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
