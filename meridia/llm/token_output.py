"""Token ids written as canonical, length-limited Huffman codes, and read back by table.

Global counts of the ids give one code for the whole output. A file holds independent blocks, a row
each, of documents in ascending doc_id order: their codes, byte-aligned at each document, with the
bit offset of every ``STRIDE``-th id, so that a reader can start at any of them. Decoding looks
codes up in one table of 2**max_bits entries, all checkpoints of a block side by side.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm.textops import Scratch, as_bytes, pieces

STRIDE = 256
END_ID = 1
MAX_BITS = 16
_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("marks", pa.binary()), ("codes", pa.binary())])
_BLOCK_DDL = "part int, seq int, n_tokens long, doc_ids array<long>, counts array<long>, bytes array<long>, marks binary, codes binary"


# ---- tokens


def join_runs(flat: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[edges[k] : edges[k + 1]] for each k of which, one after the other, and where each ends."""
    sizes = edges[which + 1] - edges[which]
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(edges[which] - (ends - sizes), sizes)
    return flat[at], ends


class WordEncoder:
    """The ids of texts; 16 bits an id where the vocabulary allows, else 32.

    A vocabulary that drops white space and never joins what it parts gives a text the ids of its
    words, and letters followed by punctuation are two units of their own: each distinct unit of a
    piece of the table is encoded once, and texts are put together from them by array operations. That
    holds for the normaliser and splitter named below; with any other, texts are encoded whole.
    Nothing is kept from one piece to the next but the vocabulary.
    """

    #: The normaliser and the splitter's pattern for which words are encoded one by one.
    _NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    _SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: A word of Latin letters, then punctuation.
    _PLAIN = "^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!\"#$%&()*+,./:;=?@\\[\\\\\\]^_`{}~-]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(max(vocabulary.values()), END_ID) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.closes = np.zeros(size, bool)  # ids that end a unit
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_word = self._parts_words(json.loads(self.tokenizer.to_str()))
        # units need neither normalising nor splitting beyond the spaces between them
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _parts_words(self, config: dict) -> bool:
        normalizer, splitter = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
        first = (splitter.get("pretokenizers") or [{}])[0]
        spaced = any(" " in t["content"] or not t.get("special") for t in config.get("added_tokens", []))
        return (
            normalizer.get("normalizers") == self._NORMALIZERS and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and first.get("pattern") == {"Regex": self._SPLIT} and config["model"].get("end_of_word_suffix") == "</w>" and not config["model"].get("dropout") and not spaced
        )

    def _encode_each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of units of letters or of punctuation and how many each has; many are one text, told apart by the ids that end them."""
        flat, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for at in range(0, len(units), 2_000):
            some = units[at : at + 2_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                each = self._encode_each(some)
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return flat, sizes

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and the edges between the words' ids; the empty word has none."""
        parts = pc.extract_regex(words, pattern=self._PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        a, b = (parts.filter(pa.array(plain)).field(k) for k in range(2))
        a, b = pc.utf8_lower(a).dictionary_encode(), b.dictionary_encode()
        flat, sizes = self._encode_units(a.dictionary.to_pylist())
        more, extra = self._encode_units([x or " " for x in b.dictionary.to_pylist()])
        odd = self._encode_each(words.filter(pa.array(~plain)).to_pylist())
        flat = np.concatenate([*flat, *more, *odd])
        sizes = np.concatenate([*sizes, *extra, np.array([len(x) for x in odd], np.int64)])
        edges = np.concatenate(([0], np.cumsum(sizes)))
        nothing = len(edges) - 1  # a run without ids
        edges = np.append(edges, edges[-1])
        both = np.full((len(words), 2), nothing, np.int64)
        both[plain, 0] = a.indices.to_numpy()
        both[plain, 1] = b.indices.to_numpy() + len(a.dictionary)
        both[~plain, 0] = np.arange(len(odd)) + len(a.dictionary) + len(b.dictionary)
        ids, ends = join_runs(flat, edges, both.ravel())
        return ids, np.concatenate(([0], ends[1::2]))

    def __call__(self, texts: pa.Array, end_id: int, rows: int = 2_000) -> Iterator[pa.Array]:
        """The ids of each text and the end id, as bytes, so many texts at a time; null as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            for at in range(0, len(texts), 100):
                yield pa.array([x.tobytes() + np.array([end_id], self.kind).tobytes() for x in self._encode_each(texts.slice(at, 100).to_pylist())], pa.binary())
            return
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, edges = self.words(coded.dictionary)
        ids, edges = np.append(ids, np.array([end_id], ids.dtype)), np.append(edges, edges[-1] + 1)
        codes, edge = coded.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        for at in range(0, len(texts), rows):
            some = edge[at : at + rows + 1]
            mine = np.insert(codes[some[0] : some[-1]].astype(np.int64), some[1:] - some[0], len(edges) - 2)
            flat, ends = join_runs(ids, edges, mine)
            last = np.cumsum(np.diff(some) + 1) - 1
            offsets = np.concatenate(([0], ends[last])) * flat.itemsize
            yield pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(last), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One for each worker process, shared by the tasks that it runs: a vocabulary, of fixed size."""
    return WordEncoder(path)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes in a column of strings, small ones put together, a long text alone."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        before = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(before, before[at] + most - size, side="right")) - 1)
            held.append(batch.slice(at, end - at))
            size += int(before[end] - before[at])
            at = end
            if size >= most or at < batch.num_rows:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def encode_rows(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, piece_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned bytes: 16 bits each, where the vocabulary allows, else 32."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for part in by_bytes(source, 1, piece_bytes):
            at = 0
            for ids in encoder(part.column(1), end_id):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(ids)), ids], schema=schema)
                at += len(ids)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, ids binary")


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    """Ids run from 0 to this, exclusive; the end id is among them."""
    from tokenizers import Tokenizer

    return max(max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()), END_ID) + 1


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; the driver gets one number for each id of the vocabulary."""
    kind = "<u2" if size <= 1 << 16 else "<u4"
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in pieces(source):
            total += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), kind), minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], schema=schema)

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


# ---- the code


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most max_bits bits, 0 for ids that don't occur (package-merge)."""
    there = np.flatnonzero(counts)
    n = len(there)
    out = np.zeros(len(counts), np.uint8)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit in codes of {max_bits} bits")
    if n <= 1:
        out[there] = 1
        return out
    order = there[np.argsort(counts[there], kind="stable")]
    leaves = counts[order].astype(np.int64)
    is_leaf, level = [np.ones(n, bool)], leaves
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id; lengths alone determine them."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    there = np.flatnonzero(lengths)
    for k in there[np.lexsort((there, lengths[there]))].tolist():
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k] = code
        code += 1
    return codes


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids, first bit highest, and the bit offset of every STRIDE-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = total // 32 + 2
    # a code of up to 32 bits covers two 32-bit words at most; codes don't overlap, so sums set the bits
    at = starts >> 5
    wide = codes[ids].astype(np.uint64) << (64 - size - (starts & 31)).astype(np.uint64)
    high, low = (wide >> np.uint64(32)).astype(np.float64), (wide & np.uint64(0xFFFFFFFF)).astype(np.float64)
    out = np.bincount(at, high, words) + np.bincount(at + 1, low, words)
    return out.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], starts[::STRIDE]


def decode_table(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each max_bits bits: the id whose code they begin with, and its length."""
    codes = canonical_codes(lengths)
    ids, sizes = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    there = np.flatnonzero(lengths)
    order = there[np.lexsort((there, lengths[there]))]
    spans = 1 << (max_bits - lengths[order].astype(np.int64))
    first = codes[order].astype(np.int64) << (max_bits - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    if len(order) and int(first[0]) == 0:
        ids[:filled] = np.repeat(order, spans)
        sizes[:filled] = np.repeat(lengths[order], spans)
    return ids, sizes


def decode_runs(codes: bytes, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray], max_bits: int) -> np.ndarray:
    """The ids of runs that begin at these bit offsets, counts[k] of run k, one after the other; all runs advance together."""
    ids, sizes = table
    padded = np.frombuffer(codes + b"\0" * 8, np.uint8)
    # the 32 bits from each byte on
    view = padded[:-3].astype(np.uint32) << 24 | padded[1:-2].astype(np.uint32) << 16 | padded[2:-1].astype(np.uint32) << 8 | padded[3:].astype(np.uint32)
    by = np.argsort(-counts, kind="stable")
    pos, left = starts[by].astype(np.int64), counts[by]
    to = (np.cumsum(counts) - counts)[by]
    out = np.zeros(int(counts.sum()), np.uint32)
    shift, mask = np.uint32(32 - max_bits), np.uint32((1 << max_bits) - 1)
    active = len(by)
    for step in range(int(counts.max()) if len(counts) else 0):
        while active and left[active - 1] <= step:
            active -= 1
        p = pos[:active]
        bits = view[p >> 3] >> (shift - (p & 7).astype(np.uint32)) & mask
        out[to[:active] + step] = ids[bits]
        p += sizes[bits]
    return out


# ---- files


def write_ids(docs: DataFrame, path: str, scratch: Scratch, tokenizer_path: str, block_tokens: int = 1 << 18, max_bits: int = MAX_BITS, part_bytes: int = 32 << 20) -> None:
    """Encode docs (doc_id, text) and write the files under path: ``blocks`` and ``code`` (id, bits).

    A part is a range of doc_ids of about ``part_bytes`` of codes, or less where the session has more shuffle partitions.
    """
    spark = docs.sparkSession
    size = vocabulary_size(tokenizer_path)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens = scratch.keep(encode_rows(docs, tokenizer_path), "tokens")
    counts = count_ids(tokens, size)
    lengths = code_lengths(counts, max_bits)
    there = np.flatnonzero(lengths)
    spark.createDataFrame([(int(k), int(lengths[k])) for k in there], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((canonical_codes(lengths), lengths))  # two numbers for each id of the vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marks", pa.binary()), ("codes", pa.binary()), ("part", pa.int32())])

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = shared.value
        for part in pieces(source, 1000):
            rows = []
            for raw in part.column(1).to_pylist():
                ids = np.frombuffer(raw, kind)
                packed, marks = encode_ids(ids, codes, bits)
                rows.append((len(ids), marks.astype("<i8" if len(packed) >= 1 << 28 else "<u4").tobytes(), packed))
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:])), part_of(part.column(0), cuts)], schema=schema)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(lengths.astype(np.int64) @ counts) // (8 * part_bytes)))
    cuts = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    cuts = np.array(sorted({int(c) for c in cuts}), np.int64)
    coded = tokens.mapInArrow(encode, "doc_id long, n long, marks binary, codes binary, part int")
    sorted_ = coded.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "n", "codes")

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, held, count = None, 0, [], 0

        def out() -> pa.RecordBatch:
            row = [now, seq, count, [d for d, *_ in held], [n for _, n, _, _ in held], [len(c) for *_, c in held], b"".join(m for _, _, m, _ in held), b"".join(c for *_, c in held)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK.types)], schema=_BLOCK)

        for batch in pieces(source, 500):
            for doc_id, n, marks, codes, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (part != now or count >= block_tokens):
                    yield out()
                    seq, held, count = seq + 1 if part == now else 0, [], 0
                elif part != now:
                    seq = 0
                now = part
                held.append((doc_id, n, marks, codes))
                count += n
        if held:
            yield out()

    sorted_.select("doc_id", "n", "marks", "codes", "part").mapInArrow(blocks, _BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    scratch.drop("tokens")


def part_of(doc_id: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The number of cuts below an id; null comes last."""
    below = np.searchsorted(cuts, doc_id.fill_null(0).to_numpy())
    return pa.array(np.where(doc_id.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, below), pa.int32())


def read_ids(spark: SparkSession, path: str, max_bits: int = MAX_BITS, ids: bool = False) -> DataFrame:
    """One row per document of the files, in no order: doc_id, start, n_tokens, ids_crc32 (and ids, 32 bits each)."""
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/code").collect()  # a row for each id of the vocabulary
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    shared = spark.sparkContext.broadcast(lengths)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if ids else [])])

    def decode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value, max_bits)
        for batch in pieces(source, 1):
            if not batch.num_rows:
                continue
            part, seq, _, doc_ids, counts, sizes, marks, codes = (c.to_pylist()[0] for c in batch.columns)
            counts, sizes = np.array(counts, np.int64), np.array(sizes, np.int64)
            runs = -(-counts // STRIDE)
            wide = bool((sizes >= 1 << 28).any())
            starts, at = [], 0
            for k, size in zip(runs.tolist(), sizes.tolist()):
                kind = "<i8" if wide and size >= 1 << 28 else "<u4"
                starts.append(np.frombuffer(marks, kind, k, at))
                at += k * np.dtype(kind).itemsize
            starts = np.concatenate(starts).astype(np.int64) + np.repeat((np.cumsum(sizes) - sizes) * 8, runs)
            run_of = np.repeat(np.arange(len(counts)), runs)
            within = np.arange(len(run_of)) - np.repeat(np.cumsum(runs) - runs, runs)
            lengths_ = np.minimum(STRIDE, counts[run_of] - within * STRIDE)
            found = decode_runs(codes, starts, lengths_, table, max_bits).astype("<u4")
            before = np.cumsum(counts) - counts
            raw = [found[a : a + n].tobytes() for a, n in zip(before.tolist(), counts.tolist())]
            columns = [[part] * len(raw), [seq] * len(raw), doc_ids, before, counts, [zlib.crc32(x) for x in raw], *([raw] if ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    # sizes of blocks, without their codes, give what stands before each: a number for each part, then one for each block
    sized = blocks.select("part", "seq", "n_tokens")
    parts = sized.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "first")
    offset = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = sized.withColumn("offset", offset).join(parts, "part").select("part", "seq", (F.col("first") + F.col("offset")).alias("first"))
    ddl = "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    rows = blocks.mapInArrow(decode, ddl).join(starts, ["part", "seq"])
    return rows.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs' ids to files, read them back, and return doc_id, start, n_tokens and ids_crc32.

    A null or empty text has the end id only. A null doc_id comes last; rows that share a doc_id stand
    side by side, shorter first, each with its own start. Other columns are ignored; an empty table
    makes files without blocks and an empty result.
    """
    scratch = Scratch(docs.sparkSession, "token-output")
    write_ids(docs, scratch.path("files"), scratch, tokenizer_path)
    return read_ids(docs.sparkSession, scratch.path("files"))
