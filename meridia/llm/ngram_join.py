"""N-gram Jaccard self-join and its components.

A document is its set of word n-grams, as 64-bit hashes in one global order: by hash, but n-grams
known to be common last, so that a passage of many texts rarely stands among a set's first n-grams.
Equal sets count once. Two sets that are similar enough share one of their first few n-grams (prefix
filter, right in any order that is the same for all), so:

1. each prefix n-gram that several sets share proposes its least set as a hub for the others, and
   each set takes the hub with which it shares most;
2. proposals pass an exact bound on the difference of their bitmaps, then a trie verifies them: the
   sets proposed to one hub are walked in order, each resuming from the overlap already counted for
   the path it shares with the one before, and dropped, with all that share the path, as soon as
   what remains is too short;
3. links make components. Pairs whose sets already are in one component need no check. Sets that
   share a hub across components are paired by their bitmaps within classes of like size, in blocks
   of bounded size, and verified the same way: first only pairs that join components, at last all.

No pair across components is left out, so components are exact; pairs within one are not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.substring_dedup import gram_hashes, word_hashes
from meridia.llm.textops import Scratch, as_bytes, join_hot, pieces, text_key

SALTS = 64  # parts that a hub's sets are dealt into


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words together if they are fewer; empty without words."""
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(width, len(words))) ^ np.uint64(min(width, len(words))))


def prefix_length(n: int, num: int, den: int) -> int:
    """So many first n-grams of a set of n must meet those of any set that is similar enough."""
    return n - -(-num * n // den) + 1


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits, a power of two and at least twice the set's size; each n-gram flips one.

    Two bitmaps of one width differ in at most as many bits as the sets do in n-grams, and halves
    XORed are the bitmap of half the width.
    """
    width = max(512, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    while len(sig) > words:
        sig = sig[: len(sig) // 2] ^ sig[len(sig) // 2 :]
    return sig


def may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int, num: int, den: int) -> bool:
    """False only for sets that differ too much: with c in common they differ in na + nb - 2c n-grams, and c is at least num * (na + nb) / (num + den)."""
    words = min(len(a), len(b))
    bits = int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())
    return (num + den) * bits <= (den - num) * (na + nb)


def similar(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


def least_common(a: int, b: int, num: int, den: int) -> int:
    """The smallest intersection with which sets of a and b n-grams are similar enough."""
    return -(-num * (a + b) // (num + den))


def trie_links(hub: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[bool]:
    """Which sets are similar enough to the hub, by one walk over the trie that the ordered sets make."""
    out = [False] * len(sets)
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    before, overlap = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # the path and the overlap at each of its depths
    for k in order:
        s = sets[k]
        m = min(len(before), len(s))
        differ = np.flatnonzero(before[:m] != s[:m])
        shared = int(differ[0]) if len(differ) else m
        need = least_common(len(hub), len(s), num, den)
        shared = min(shared, len(overlap) - 1)
        have = int(overlap[shared])
        # what can still be common: what is left of the set, and of the hub beyond the path
        beyond = len(hub) - (int(np.searchsorted(hub, s[shared - 1], side="right")) if shared else 0)
        if have + min(len(s) - shared, beyond) < need:
            before, overlap = s[:shared], overlap[: shared + 1]
            continue
        rest = s[shared:]
        at = np.minimum(np.searchsorted(hub, rest), len(hub) - 1)
        overlap = np.concatenate([overlap[: shared + 1], have + np.cumsum(hub[at] == rest)])
        before = s
        out[k] = similar(int(overlap[-1]), len(hub), len(s), num, den)
    return out


def _sets_of(raws: list[bytes], width: int) -> list[np.ndarray]:
    return [shingle_set(word_hashes(b" ".join(raw.lower().split())), width) for raw in raws]


def ordered(s: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """A sorted set in the global order: n-grams that aren't among the common ones, then those by level; by hash within."""
    if common is None or not len(common[0]):
        return s
    keys, levels = common
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.argsort(np.where(keys[at] == s, levels[at], 0), kind="stable")]


def set_rows(docs: DataFrame, width: int, num: int, den: int, full: bool, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, tk, n, f1, f2 for each row of docs; with full, also the bitmap and the prefix, else twice a prefix by hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), *([("sig", pa.binary())] if full else []), ("prefix", pa.list_(pa.int64()))])
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(source):
            rows = []
            for s in _sets_of(as_bytes(part.column(2)), width):
                f = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                length = prefix_length(len(s), num, den)
                if full:
                    more = (bitmap(s).tobytes(), ordered(s, shared.value)[:length].view(np.int64)) if len(s) else (None, None)
                else:
                    more = (s[: 2 * length].view(np.int64) if len(s) else None,)
                rows.append((len(s), int(f[0]), int(f[1]), *more))
            columns = list(zip(*rows)) or [[]] * (4 + full)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, schema.types[2:]))], schema=schema)

    ddl = "doc_id long, tk long, n long, f1 long, f2 long" + (", sig binary" if full else "") + ", prefix array<long>"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("tk"), docs["text"].alias("text")).mapInArrow(run, ddl)


def common_grams(rows: DataFrame, scratch: Scratch, least: int, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams met in at least ``least`` rows' first n-grams, and levels that grow with how many.

    At most ``most`` n-grams come back, the most common ones: whole levels (powers of two) are left out
    beyond. They only decide the order of n-grams, so which of them are known changes no result.
    """
    counts = rows.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    counts = scratch.keep(counts.select("gram", (F.floor(F.log2("c")) + 1).cast("int").alias("level")), "common")
    lowest, total = 1 << 30, 0
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # 64 levels at most
        total += r["count"]
        if total > most:
            break
        lowest = r["level"]
    found = counts.filter(F.col("level") >= lowest).toArrow()
    keys = found["gram"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], found["level"].to_numpy().astype(np.int8)[by]


def connected(nodes_edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of all nodes in the edges (a, b); comp is the least node. Labels hop along edges, then along labels."""
    both = nodes_edges.select("a", "b").unionByName(nodes_edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hopped = labels.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        own = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = hopped.join(own, "comp", "left").select("node", "old", F.least("comp", "root").alias("comp"))
        new = scratch.keep(new, f"{name}-{step}")
        changed = new.filter(F.col("old") != F.col("comp")).limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "comp")
        if not changed:
            return labels


class SetJoin:
    """Finds the links between distinct sets that make up their components."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int, scratch: Scratch, broadcast_rows: int = 200_000, block: int = 2_000, common: tuple | None = None):
        self.docs, self.width, self.num, self.den, self.scratch = docs, width, num, den, scratch
        self.broadcast_rows, self.block, self.calls = broadcast_rows, block, 0
        full = set_rows(docs, width, num, den, True, common).filter(F.col("n") > 0).dropDuplicates(["f1", "f2"])
        self.sets = scratch.keep(full.withColumn("node", F.monotonically_increasing_id()), "sets")

    def postings(self) -> DataFrame:
        """(gram, node, n, hub) of prefix n-grams that several sets share."""
        rows = self.sets.select(F.explode("prefix").alias("gram"), "node", "n")
        # the least and the greatest node, not a list, are gathered for each n-gram, and summed before they travel
        ends = rows.groupBy("gram").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("m"))
        ends = self.scratch.keep(ends.filter("hub <> last").select("gram", "hub", "m"), "ends")
        total = ends.agg(F.sum("m")).first()[0] or 0
        postings = self.scratch.keep(join_hot(rows, ends, ["gram"], "m", total).drop("m"), "postings")
        self.scratch.drop("ends")
        return postings

    def proposals(self, postings: DataFrame) -> DataFrame:
        """(a, b): each set b with the hub a of most of its n-grams among those of fitting size."""
        hubs = self.sets.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
        met = postings.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"), F.first("n").alias("n")).join(hubs, "hub")
        fits = self.den * F.least("n", "hub_n") >= self.num * F.greatest("n", "hub_n")
        return met.filter(fits).groupBy(F.col("node").alias("b")).agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("a")).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a: hub, b) that are similar enough: first by bitmaps, then by the trie of each hub's sets."""
        self.calls += 1
        name, num, den, width = f"verify-{self.calls}", self.num, self.den, self.width
        a, b = (self.sets.select(*(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "sig"))) for x in "ab")
        both = pairs.join(a, pairs["a"] == a["a_node"]).join(b, pairs["b"] == b["b_node"]).select("a", "b", "a_n", "b_n", "a_sig", "b_sig")
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def bound(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(source):
                _, _, na, nb, x, y = (c.to_pylist() for c in part.columns)
                good = [may_link(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), m, n, num, den) for m, n, p, q in zip(na, nb, x, y)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        near = self.scratch.keep(both.mapInArrow(bound, "a long, b long"), f"{name}-near")
        # where each set must go: to its hubs, and a hub to every part that its sets are dealt into
        salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
        roles = near.select(F.col("b").alias("node"), F.struct("a", salt.alias("salt")).alias("to")).unionByName(near.select(F.col("a").alias("node"), F.struct("a", salt.alias("salt")).alias("to")))
        roles = roles.groupBy("node").agg(F.collect_set("to").alias("to"))
        where = self.scratch.keep(roles.join(self.sets.select("node", F.col("doc_id").alias("_d"), F.col("tk").alias("_t")), "node"), f"{name}-where")
        rows = self.full_sets(where).select(F.explode("to").alias("to"), "node", "set").select("to.a", "to.salt", F.col("node").alias("b"), "set")

        def walk(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by hub and salt, the hub's own set first; a hub's sets are taken in runs of bounded size."""
            now, hub, nodes, sets = None, None, [], []

            def out() -> pa.RecordBatch:
                kept = [n for n, ok in zip(nodes, trie_links(hub, sets, num, den)) if ok]
                return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(kept), pa.int64()), pa.array(kept, pa.int64())], schema=schema)

            for part in pieces(source, 500):
                for a, salt, b, raw in zip(*(c.to_pylist() for c in part.columns)):
                    s = np.frombuffer(raw, np.uint64)
                    if ((a, salt) != now or len(sets) >= 500) and sets:
                        yield out()
                        nodes, sets = [], []
                    if (a, salt) != now:
                        now, hub = (a, salt), s
                    elif b != a:  # rows alike in doc_id and text bring a hub's set again
                        nodes.append(b)
                        sets.append(s)
            if sets:
                yield out()

        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a"), "b").select("a", "salt", "b", "set")
        return self.scratch.keep(dealt.mapInArrow(walk, "a long, b long"), name)

    def full_sets(self, where: DataFrame) -> DataFrame:
        """(node, to, set) of the wanted nodes, from the text of a row that has it. Small lists of rows go to the scans."""
        if where.count() <= self.broadcast_rows:
            where = F.broadcast(where)
        docs = self.docs.select(self.docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("tk"), self.docs["text"].alias("text"))
        rows = docs.join(where, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tk") == F.col("_t"))).select("node", "to", "text")
        width = self.width

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(source):
                sets = [s.tobytes() for s in _sets_of(as_bytes(part.column(2)), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["node", "to", "set"])

        return rows.mapInArrow(run, "node long, to array<struct<a:long,salt:int>>, set binary")

    def across(self, met: DataFrame, comps: DataFrame, forest: bool) -> DataFrame:
        """(a, b) in different components that share a hub and whose sizes and bitmaps allow a link.

        met: (hub, node, n), each set with the hubs of its prefix n-grams: sets that share an n-gram share
        its hub. With forest, a block of sets yields only pairs that would join further components of it.
        """
        comp = F.coalesce("comp", "node").alias("comp")
        self.passes = getattr(self, "passes", 0) + 1
        rows = self.scratch.keep(met.join(comps, "node", "left").select("hub", "node", "n", comp), f"placed-{self.passes}")
        mixed = rows.groupBy("hub").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).filter("x <> y").select("hub", "m")
        mixed = self.scratch.keep(mixed, f"hubs-{self.passes}")
        # sets of similar size are in one class or in neighbouring ones: each goes to its own and the one below
        size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(self.den / self.num) * (1 + 1e-9)).cast("int")
        rows = join_hot(rows, mixed, ["hub"], "m", mixed.agg(F.sum("m")).first()[0] or 0).drop("m").withColumn("own", size_class).select("*", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("class"))
        rows = self.scratch.keep(rows.withColumn("upper", F.col("own") != F.col("class")), f"mixed-{self.passes}")
        counts = rows.groupBy("hub", "class").agg(F.count("*").alias("m"), F.count(F.when(~F.col("upper"), 1)).alias("lower"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("m > 1 and lower > 0 and x <> y")
        blocks = F.ceil(F.col("m") / self.block).cast("int")
        counts = self.scratch.keep(counts.select("hub", "class", "m", blocks.alias("blocks")), f"classes-{self.passes}")
        sized = join_hot(rows, counts, ["hub", "class"], "m", counts.agg(F.sum("m")).first()[0] or 0).drop("m")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        # every pair of blocks meets once: a row goes to each pair that has its block
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
        dealt = sized.withColumn("block", block).withColumn("pair", F.explode(pairs))
        dealt = dealt.join(self.sets.select("node", "sig"), "node").select("hub", "class", "pair.i", "pair.j", "node", "n", "comp", "upper", "block", "sig")
        num, den = self.num, self.den
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by hub, class and pair of blocks."""
            now, held, pairs = None, [], []

            def match() -> None:
                root = {x[2]: x[2] for x in held}
                if len(root) < 2:
                    return
                i, j = now[2:]
                words = min(len(x[5]) for x in held) // 8
                sig = np.array([folded(np.frombuffer(x[5], np.uint64), words) for x in held])
                node, n, comp = (np.array([x[k] for x in held]) for k in range(3))
                upper, block = np.array([x[3] for x in held]), np.array([x[4] for x in held])

                def find(c: int) -> int:
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    return c

                for k in np.flatnonzero(~upper).tolist():
                    fit = (comp != comp[k]) & (den * np.minimum(n, n[k]) >= num * np.maximum(n, n[k]))
                    fit &= upper | (node > node[k])  # of two rows of the lower class, once
                    fit &= (block == j) if block[k] == i else (block == i)
                    at = np.flatnonzero(fit)
                    if not len(at):
                        continue
                    bits = np.bitwise_count(sig[at] ^ sig[k]).sum(axis=1, dtype=np.int64)
                    good = (num + den) * bits <= (den - num) * (n[at] + n[k])
                    at = at[good][np.argsort(bits[good], kind="stable")] if forest else at[good]
                    for m in at.tolist():
                        if forest:
                            x, y = find(int(comp[k])), find(int(comp[m]))
                            if x == y:
                                continue
                            root[x] = y
                        pairs.append((int(node[k]), int(node[m])))

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], schema=schema)
                pairs.clear()
                return made

            for part in pieces(source):
                for hub, class_, i, j, *row in zip(*(c.to_pylist() for c in part.columns)):
                    if (hub, class_, i, j) != now:
                        match()
                        now = (hub, class_, i, j)
                        held.clear()
                    held.append(row)
                if len(pairs) > 10_000:
                    yield out()
            match()
            yield out()

        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = dealt.repartition(parts, "hub", "class", "i", "j").sortWithinPartitions("hub", "class", "i", "j")
        found = self.scratch.keep(sorted_.mapInArrow(meet, "a long, b long").distinct(), f"across-{self.passes}")
        self.scratch.drop(*(f"{x}-{self.passes}" for x in ("mixed", "placed", "hubs", "classes")))
        return found

    def components(self, passes: int = 2) -> DataFrame:
        """(node, comp) of the sets that have links; comp is the least node reachable.

        After the hubs, some passes take only pairs that join components; the last takes all that are
        left, so that none across components goes unchecked.
        """
        postings = self.postings()
        met = self.scratch.keep(postings.groupBy("hub", "node").agg(F.first("n").alias("n")), "met")
        links = self.verified(self.proposals(postings))
        self.scratch.drop("postings")
        comps = connected(links, self.scratch, "comps-0")
        for k in range(passes + 1):
            pairs = self.across(met, comps, forest=k < passes)
            if not pairs.limit(1).count():
                break
            links = links.unionByName(self.verified(pairs))
            comps = connected(links, self.scratch, f"comps-{k + 1}")
        return comps


def similarity_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, common_from: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, tk, n_shingles, component_id.

    Words are lower-cased (A-Z); a set is the distinct ``width``-word runs, or the whole sequence if it
    is shorter; sets link when den * intersection >= num * union. component_id is the smallest doc_id
    reachable. A null or empty text, or one without words, has an empty set, links with nothing and is
    its own component. A null doc_id takes part but names a component only if all its ids are null.
    Repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    early = scratch.keep(set_rows(docs, width, num, den, False), "early")
    common = common_grams(early, scratch, common_from)
    rows = scratch.keep(early.drop("prefix"), "rows")
    scratch.drop("early", "common")
    join = SetJoin(docs, width, num, den, scratch, common=common)
    comps = join.components()
    named = join.sets.select("f1", "f2", "node").join(comps, "node", "left").select("f1", "f2", F.coalesce("comp", "node").alias("comp"))
    sets = rows.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least")).join(named, ["f1", "f2"])
    least = sets.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = scratch.keep(sets.select("f1", "f2", "comp").join(least, "comp").select("f1", "f2", "component_id"), "known")
    scratch.retain("rows", "known")
    out = rows.join(known, ["f1", "f2"], "left")
    return out.select("doc_id", "tk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 300_000) -> DataFrame:
    """docs, with all their columns, without all but one row of each component: one with its smallest doc_id.

    Rows with an empty set all stay. Of rows alike in doc_id and text one stays; rows with a null doc_id
    stay only where their component has no other. The rows to leave out go to the scans if they are at
    most ``broadcast_rows``, else both sides are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.keep(similarity_components(docs, width, num, den), "found").filter("n_shingles > 0")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("tk").alias("_t")).select(F.col("component_id").alias("_c"), "_t")
    met = found.join(first, F.col("component_id").eqNullSafe(F.col("_c")))
    gone = met.filter(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tk") == F.col("_t"))))
    gone = scratch.keep(gone.select(F.col("doc_id").alias("_doc"), F.col("tk").alias("_tk")).distinct(), "gone")
    alike = found.groupBy("doc_id", "tk").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count()
    if gone.count() <= broadcast_rows:  # 16 bytes a row
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_doc"]) & (text_key() == gone["_tk"]), "left_anti")
    if not alike:
        return kept
    words = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", ""))
    return kept.filter(words > 0).dropDuplicates(["doc_id", "text"]).unionByName(kept.filter(words == 0))
