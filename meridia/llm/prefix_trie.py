"""Conversation prefix trie by an external mergesort whose runs carry the lengths of common prefixes.

A turn becomes a symbol of 20 bytes, a digest of its role and text and the text's length, so a conversation
is a string of symbols and texts are never shuffled. Tasks sort what they read into runs; an entry of a run
is a distinct conversation with the packed ids of its copies and the number of symbols (LCP) that it shares
with the entry before. Entries are dealt by ranges of symbols. A range's task merges its runs in a loser
tree, which compares LCPs and looks at symbols only beyond them, and keeps the open path on a stack: what
the next entry doesn't share is finished and goes out. Nodes on a range's first and last path may go on in
its neighbours. They leave as two records of sums, and groups of ranges are merged in the same way, level by
level, until one group is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.textops import Scratch, join_few

DIGEST, SYMBOL = 16, 20
SHARED_TURNS = 6  # a conversation takes fewer of its base's turns than this
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a merging task gives: nodes, and records of a path with its nodes' sums (nodes null).
OUT = f"{NODE}, own binary, above binary, range long, last boolean, path binary, sums binary, ends binary"
_SUMS = 8  # of a node in a record: depth; least id, conversations, children, leaves and saved tokens of finished children; code points; bytes of ids
_NO_ID = np.iinfo(np.int64).max


def turn_symbol(role: Column, text: Column) -> Column:
    """20 bytes: a digest of role and text, null as empty, then the text's code points."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(F.char_length(text)), 8, "0"))


def conversation_symbols(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's symbols in the order of turn, null first; turns alike in it by digest."""
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].alias("turn"), turn_symbol(turns["role"], turns["text"]).alias("symbol"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "symbol"))).alias("turns"))
    return grouped.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["symbol"]), "")).alias("seq"))


def share_heads(convs: DataFrame, every: int = 100) -> DataFrame:
    """Each conversation's first h symbols replaced by those of conversation c - c % every; h = CRC-32 of c modulo 6.

    A base is asked by at most ``every`` conversations, and gives at most five symbols.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    heads = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, (SHARED_TURNS - 1) * SYMBOL).alias("head"))
    asked = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    joined = asked.join(heads, "base", "left")
    head = F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), F.col("h") * SYMBOL)
    return joined.select("conv_id", F.concat(head, F.substring("seq", F.col("h") * SYMBOL + 1, F.lit(2**31 - 1))).alias("seq"))


def common_symbols(a: bytes, b: bytes, start: int = 0) -> int:
    """Symbols at the head of both, of which ``start`` are known to agree."""
    most, k = min(len(a), len(b)) // SYMBOL, start
    while k < most and a[k * SYMBOL : (k + 1) * SYMBOL] == b[k * SYMBOL : (k + 1) * SYMBOL]:
        k += 1
    return k


def sorted_runs(convs: DataFrame, run_bytes: int = 16 << 20) -> DataFrame:
    """(run, at, seq, lcp, ids): sorted runs of distinct conversations, the packed ids of each and its LCP with the one before."""
    schema = pa.schema([("run", pa.int64()), ("at", pa.int64()), ("seq", pa.binary()), ("ids", pa.binary()), ("lcp", pa.int32())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size, held = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            held.sort()
            seqs, ids, lcps = [], [], []
            for seq, i in held:
                if seqs and seqs[-1] == seq:
                    ids[-1].append(i)
                else:
                    lcps.append(common_symbols(seqs[-1], seq) if seqs else 0)
                    seqs.append(seq)
                    ids.append([i])
            columns = [pa.repeat((task << 24) + made, len(seqs)), pa.array(range(len(seqs)), pa.int64()), pa.array(seqs, pa.binary()), pa.array([np.array(x, np.int64).tobytes() for x in ids], pa.binary()), pa.array(lcps, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for part in source:
            held.extend(zip(part.column(1).to_pylist(), part.column(0).to_pylist()))
            size += part.nbytes + 100 * part.num_rows
            if size >= run_bytes:
                yield out()
                held.clear()
                made, size = made + 1, 0
        if held:
            yield out()

    return convs.select("conv_id", "seq").mapInArrow(run, "run long, at long, seq binary, ids binary, lcp int")


class LoserTree:
    """Merges sorted runs of (key, ids, lcp with the entry before in the run) into one such stream.

    A player's LCP is that with the last winner. The larger LCP is the smaller key, with no look at either;
    only equal LCPs make symbols compared, from there on, and the loser keeps what was found.
    """

    def __init__(self, runs: list[list[tuple[bytes, bytes, int]]]):
        self.runs, self.next = runs, [0] * len(runs)
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        self.losers: list[tuple | None] = [None] * self.size
        self.compared = 0

    def _player(self, run: int) -> tuple | None:
        """(key, lcp with the last winner, run, ids) of a run's next entry; None at its end."""
        if run >= len(self.runs) or self.next[run] >= len(self.runs[run]):
            return None
        key, ids, lcp = self.runs[run][self.next[run]]
        self.next[run] += 1
        return key, lcp, run, ids

    def _play(self, a: tuple | None, b: tuple | None) -> tuple[tuple | None, tuple | None]:
        """The winner (smaller key) and the loser."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        self.compared += 1
        k = common_symbols(a[0], b[0], a[1])
        if a[0][k * SYMBOL : (k + 1) * SYMBOL] <= b[0][k * SYMBOL : (k + 1) * SYMBOL]:
            return a, (b[0], k, b[2], b[3])
        return b, (a[0], k, a[2], a[3])

    def _build(self, node: int) -> tuple | None:
        if node >= self.size:
            return self._player(node - self.size)
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, bytes, int]]:
        winner = self._build(1)
        while winner is not None:
            key, lcp, run, ids = winner
            yield key, ids, lcp
            winner, node = self._player(run), (run + self.size) // 2
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2


@dataclass(slots=True)
class Node:
    """A node of the open path: sums over its finished children, and the ids that end at it."""

    length: int
    edge: bool
    least: int = _NO_ID
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[bytes] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)  # finished children's rows, which wait for its least id


def _ends_digest(ends: list[bytes]) -> str:
    out, ids = hashlib.sha256(), np.sort(np.frombuffer(b"".join(ends), np.int64)) if ends else []
    for start in range(0, len(ids), 100_000):
        out.update((("," if start else "") + ",".join(map(str, ids[start : start + 100_000].tolist()))).encode())
    return out.hexdigest()


class OpenPath:
    """The stack over a merged stream: finished nodes become rows; the first and last path of a range become records.

    With ``whole`` nothing goes on elsewhere, so every node is finished here. With ``named`` rows carry
    their path's digest, by which children that were finished elsewhere find them.
    """

    def __init__(self, whole: bool, named: bool):
        self.whole, self.named = whole, named
        self.stack: list[Node] = []
        self.path = self.first = b""
        self.first_nodes: dict[int, Node] = {}
        self.rows: list[list] = []

    def _finish(self, names: dict[int, bytes]) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node.edge:
            self.first_nodes[depth] = node
            return
        n = node.convs + sum(map(len, node.ends)) // 8
        least = min([node.least, *(int.from_bytes(x[:8], "little", signed=True) for x in node.ends)])
        leaves = node.leaves if node.children else 1
        saved = node.saved + (n - 1) * node.length
        for k in node.rows:
            self.rows[k][2] = least
        self.rows.append([least, depth, None, n, node.children, leaves, saved, _ends_digest(node.ends), names.get(depth), None])
        if self.stack:
            up = self.stack[-1]
            up.least, up.convs, up.children, up.leaves, up.saved = min(up.least, least), up.convs + n, up.children + 1, up.leaves + leaves, up.saved + saved
            up.rows.append(len(self.rows) - 1)

    def _shorten(self, left: int) -> None:
        names = _prefix_digests(self.path, left) if self.named and len(self.stack) > left else {}
        while len(self.stack) > left:
            self._finish(names)

    def open(self, path: bytes, lcp: int) -> None:
        """Make ``path`` the open one, of which the last one shares ``lcp`` symbols."""
        edge = not self.stack and not self.whole
        if not self.stack:
            self.first = path
            self.stack.append(Node(0, edge))
        self._shorten(lcp + 1)
        self.path = path
        for d in range(len(self.stack) - 1, len(path) // SYMBOL):
            self.stack.append(Node(int.from_bytes(path[d * SYMBOL + DIGEST : (d + 1) * SYMBOL], "big"), edge))

    def close(self) -> list[tuple[bool, bytes, dict[int, Node]]]:
        """The records (last, path, nodes by depth) of what goes on elsewhere."""
        last = {}
        if self.whole:
            self._shorten(0)
        while self.stack:
            node = self.stack.pop()
            (self.first_nodes if node.edge else last)[len(self.stack)] = node
        out = [(False, self.first, self.first_nodes)] if self.first_nodes else []
        return out + ([(True, self.path, last)] if last else [])


def _prefix_digests(path: bytes, least: int) -> dict[int, bytes]:
    """The digests of the path's prefixes from a depth on, in one walk."""
    h, out = hashlib.blake2b(path[: least * SYMBOL], digest_size=16), {}
    for d in range(least, len(path) // SYMBOL + 1):
        out[d] = h.copy().digest()
        h.update(path[d * SYMBOL : (d + 1) * SYMBOL])
    return out


def _output(open_path: OpenPath, number: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")), ("own", pa.binary()), ("above", pa.binary()), ("range", pa.int64()), ("last", pa.bool_()), ("path", pa.binary()), ("sums", pa.binary()), ("ends", pa.binary())])
    records = open_path.close()
    rows = open_path.rows
    for _, path, nodes in records:
        names = _prefix_digests(path, 0)
        for d, x in nodes.items():
            for k in x.rows:
                rows[k][9] = names[d]
    out = [[*r, None, None, None, None, None] for r in rows]
    for last, path, nodes in records:
        depths = sorted(nodes)
        sums = np.array([[d, x.least, x.convs, x.children, x.leaves, x.saved, x.length, sum(map(len, x.ends))] for d in depths for x in (nodes[d],)], np.int64)
        out.append([None] * 10 + [number, last, path, sums.tobytes(), b"".join(e for d in depths for e in nodes[d].ends)])
    for start in range(0, len(out), 20_000):
        columns = list(zip(*out[start : start + 20_000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def merge_ranges(runs: DataFrame) -> DataFrame:
    """runs dealt by ranges of seq and sorted by (run, at): a loser tree and a stack for each range."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[int, list] = {}
        for part in source:
            for r, seq, ids, lcp in zip(*(part.column(c).to_pylist() for c in ("run", "seq", "ids", "lcp"))):
                # the first of a run in this range follows nothing here
                entries.setdefault(r, []).append((seq, ids, lcp if r in entries else 0))
        stack = OpenPath(whole=False, named=False)
        for seq, ids, lcp in LoserTree(list(entries.values())):
            stack.open(seq, lcp)
            stack.stack[-1].ends.append(ids)
        if entries:
            yield from _output(stack, TaskContext.get().partitionId())

    return runs.mapInArrow(run, OUT)


def merge_records(records: DataFrame, fan: int, whole: bool) -> DataFrame:
    """Records of ``fan`` neighbouring ranges merged into one range's rows and records; with ``whole``, all are finished."""

    def run(group: pa.Table) -> pa.Table:
        stack, before = OpenPath(whole, named=True), b""
        for r in sorted(group.select(["range", "last", "path", "sums", "ends"]).to_pylist(), key=lambda r: (r["range"], r["last"])):
            stack.open(r["path"], common_symbols(before, r["path"]))
            before, at = r["path"], 0
            for d, least, convs, children, leaves, saved, _, ended in np.frombuffer(r["sums"], np.int64).reshape(-1, _SUMS).tolist():
                x = stack.stack[d]
                x.least, x.convs, x.children, x.leaves, x.saved = min(x.least, least), x.convs + convs, x.children + children, x.leaves + leaves, x.saved + saved
                if ended:
                    x.ends.append(r["ends"][at : at + ended])
                at += ended
        return pa.Table.from_batches(_output(stack, group.column("range")[0].as_py() // fan))

    return records.groupBy(F.expr(f"range div {fan}").alias("group")).applyInArrow(run, OUT)


def build_trie(convs: DataFrame, range_bytes: int = 8 << 20, fan: int = 64) -> DataFrame:
    """The nodes of all sequences of (conv_id, seq), as in :func:`prefix_trie`."""
    spark = convs.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    runs = scratch.keep(sorted_runs(convs), "runs")
    held = runs.agg(F.sum(F.octet_length("seq") + F.octet_length("ids"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // range_bytes))
    dealt = runs.repartitionByRange(ranges, "seq").sortWithinPartitions("run", "at")
    merged = [scratch.keep(merge_ranges(dealt), "merged-0")]
    scratch.drop("runs")
    while (top := merged[-1].agg(F.max("range")).first()[0]) is not None:
        records = merged[-1].filter("path is not null").select("range", "last", "path", "sums", "ends")
        merged.append(scratch.keep(merge_records(records, fan, top < fan), f"merged-{len(merged)}"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    nodes = merged[0].filter("depth is not null").select(*columns, "own", "above")
    for more in merged[1:]:
        nodes = nodes.unionByName(more.filter("depth is not null").select(*columns, "own", "above"))
    named = scratch.keep(nodes.filter("own is not null").select(F.col("own").alias("above"), F.col("conv_id").alias("parent")), "named")
    found = join_few(nodes.filter("above is not null"), named, "above").withColumn("parent_conv_id", F.col("parent"))
    return nodes.filter("above is null").select(columns).unionByName(found.select(columns))


def prefix_trie(turns: DataFrame, every: int = 100) -> DataFrame:
    """One row per distinct sequence of first turns of the conversations rebuilt by :func:`share_heads`.

    A node has its smallest member as conv_id, its depth, its parent's conv_id (null for the root), how many
    conversations start with it, its children, the leaves of its subtree, the code points that storing
    shared turns once saves there, and a digest of the ids of the conversations that end at it. A null role
    or text is an empty one. Turns with the same number are in the order of their digests, a null number
    comes first, repeated rows are turns of their own. Rows without a conv_id belong to no conversation.
    Other columns are ignored; an empty table has no nodes. A task holds the digests of one conversation's
    turns at a time (20 bytes a turn) and the packed ids of a group of copies (8 bytes each).
    """
    return build_trie(share_heads(conversation_symbols(turns), every))
