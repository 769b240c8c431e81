"""Quality rules: counting rules, and perplexity under a modified Kneser-Ney model of characters.

A text is a stream of characters, white space as one mark, so 4-grams run across the edges of words
and the order of words counts. Texts are packed into blocks of bounded size, kept as a bucketed table.
Each block gives its 4-grams with their counts, once each; their sums over all blocks are the model's
counts. Continuation counts, discounts and interpolated probabilities are Spark aggregations and
joins over sorted keys, and every n-gram stays. Probabilities go back by a join to the blocks that
asked for them, which lie in their buckets already, so texts are never shuffled and no task holds more
of the model than its blocks' own n-grams. Documents outside their language's band of log perplexity
are rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.textops import Scratch, as_bytes, join_few, pieces

ORDER = 4
_START, _SPACE, _OTHER = 2, 3, 0xFFFF  # before a text; white space; what stands for characters beyond 16 bits and for the marks themselves
_MASK = {n: (1 << (16 * n)) - 1 for n in range(1, ORDER)}
UNKNOWN_LANG = "und"
SYMBOLS = b"#*$%&|<>"
_BLOCK = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.large_binary())])
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _codes(words: list[bytes]) -> np.ndarray:
    """16-bit codes of the words' characters, with a space before, between and after; digits count as one character."""
    texts = [w.decode("utf-8", "replace") for w in words]
    joined = "\3".join(texts)
    if joined.count("\3") != len(texts) - 1 or "\2" in joined:
        joined = "\3".join(t.replace("\2", "\uffff").replace("\3", "\uffff") for t in texts)
    code = np.frombuffer(f"\3{joined}\3".encode("utf-32-le"), np.uint32).copy()
    code[code > 0xFFFF] = _OTHER
    code[(code >= 48) & (code <= 57)] = 48
    return code.astype(np.uint64)


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d | c << np.uint64(16) | b << np.uint64(32) | a << np.uint64(48)


@dataclass
class Grams:
    """The 4-grams of some texts, by distinct words and by distinct pairs of neighbouring words' edges."""

    codes: np.ndarray  #: the word of each token of all texts
    ends: np.ndarray  #: tokens up to the end of each text
    chars: np.ndarray  #: characters of each word
    inner: np.ndarray  #: keys of 4-grams whose two middle characters are inside one word
    word: np.ndarray  #: the word of each of those
    edges: np.ndarray  #: for each pair, the two keys of a word's first two characters that begin in the word before
    pairs: np.ndarray  #: the pair of each token

    @staticmethod
    def of(texts: list[bytes]) -> Grams:
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array([x.decode("utf-8", "replace") for x in texts], pa.large_string())))
        coded = split.flatten().dictionary_encode()
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        codes, ends = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()[1:].astype(np.int64)
        if b"" in words:  # a text without words is one empty word
            there = np.array([len(w) > 0 for w in words])
            ends = np.cumsum(there[codes])[ends - 1] if len(codes) else ends
            codes = (np.cumsum(there) - 1)[codes[there[codes]]]
            words = [w for w in words if w]
        none = np.zeros(0, np.int64)
        if not words:
            return Grams(none, ends, none, none.astype(np.uint64), none, np.zeros((0, 2), np.uint64), none)
        code = _codes(words)
        spaces = np.flatnonzero(code == _SPACE)
        inside = code != _SPACE
        at = np.flatnonzero(inside[1:-2] & inside[2:-1])
        word = np.searchsorted(spaces, at + 1) - 1
        first, last = spaces[:-1], spaces[1:]
        heads, head = np.unique(code[first + 1] << np.uint64(16) | code[first + 2], return_inverse=True)
        tails, tail = np.unique(np.append(code[last - 2] << np.uint64(16) | code[last - 1], np.uint64(_START << 16 | _START)), return_inverse=True)
        before = np.empty(len(codes), np.int64)
        before[1:] = tail[codes[:-1]]
        before[np.concatenate(([0], ends[:-1]))[np.diff(ends, prepend=0) > 0]] = tail[-1]
        pair, pairs = np.unique(before * len(heads) + head[codes], return_inverse=True)
        t, h = tails[pair // len(heads)], heads[pair % len(heads)]
        low, space = np.uint64(0xFFFF), np.uint64(_SPACE)
        edges = np.stack([_keys(t >> np.uint64(16), t & low, space, h >> np.uint64(16)), _keys(t & low, space, h >> np.uint64(16), h & low)], axis=1)
        return Grams(codes, ends, last - first - 1, _keys(code[at], code[at + 1], code[at + 2], code[at + 3]), word, edges, pairs)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct 4-grams, in order, and how often each occurs."""
        keys, at = np.unique(np.concatenate([self.inner, self.edges.ravel()]), return_inverse=True)
        often = np.concatenate([np.bincount(self.codes, minlength=len(self.chars))[self.word], np.repeat(np.bincount(self.pairs, minlength=len(self.edges)), 2)])
        return keys, np.bincount(at, often, len(keys)).astype(np.int64)

    def sums(self, told) -> np.ndarray:
        """Each text's log probability, where told gives that of keys."""
        by_word = np.bincount(self.word, told(self.inner), len(self.chars))
        by_pair = told(self.edges.ravel()).reshape(-1, 2).sum(axis=1)
        upto = np.concatenate(([0.0], np.cumsum(by_word[self.codes] + by_pair[self.pairs]))) if len(self.codes) else np.zeros(1)
        return np.diff(upto[self.ends], prepend=0.0)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), docs["text"].alias("text"))


def _unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(packed)).read_all()


def pack_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, packed): the rows of docs, so many bytes of text together; a text is never divided."""
    schema = pa.schema([("block", pa.int64()), ("packed", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _BLOCK) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK.types)], schema=_BLOCK))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary())], schema=schema)

        for part in pieces(source):
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))):
                rows.append(row)
                held += len(row[2]) + 100
                if held >= block_bytes:
                    yield out()
                    rows.clear()
                    held = 0
        if rows:
            yield out()

    return _named(docs).mapInArrow(run, "block long, packed binary")


def block_grams(blocks: DataFrame) -> DataFrame:
    """(block, lang, key, c): the 4-grams of each block's texts."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("key", pa.int64()), ("c", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in source:
            for block, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for lang, rows in _by_lang(_unpack(packed)):
                    keys, total = Grams.of(rows.column(2).to_pylist()).counts()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.repeat(lang, len(keys)), pa.array(keys.view(np.int64)), pa.array(total)], schema=schema)

    return blocks.select("block", "packed").mapInArrow(run, "block long, lang string, key long, c long")


def _by_lang(rows: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    for lang in pc.unique(rows.column(1)).to_pylist():
        yield lang, rows.filter(pc.equal(rows.column(1), lang))


def count_grams(docs: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """(lang, key, c): the 4-grams of all texts."""
    if "doc_id" not in docs.columns:
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    return block_grams(pack_blocks(docs, block_bytes)).groupBy("lang", "key").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, key, p): the probability of each 4-gram; and the whole model.

    The model is (lang, n, key, lp, lg): log probability of each n-gram and log weight of backing off from it as a context.
    """
    level = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        level[n] = level[n + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(_MASK[n])).alias("key")).agg(F.count("*").alias("c"))
    lower, parts = None, []
    for n in range(1, ORDER + 1):
        c = F.col("c")
        grams = level[n].withColumn("ctx", F.shiftrightunsigned("key", 16))
        kinds = grams.groupBy("lang").agg(*(F.count(F.when(c == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(k: int, y=y):
            # where a count of counts is missing, the usual half of the count's own size keeps the model proper
            value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            return F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (value > 0) & (value < k), value).otherwise(F.lit(0.5 * k)).alias(f"d{k}")

        kinds = kinds.select("lang", discount(1), discount(2), discount(3))
        context = grams.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), *(F.count(F.when(c == k if k < 3 else c >= 3, 1)).alias(f"m{k}") for k in (1, 2, 3)))
        context = join_few(context, scratch.keep(kinds, f"kinds{n}"), "lang").withColumn("g", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        grams = grams.join(context.hint("merge"), ["lang", "ctx"])
        own = F.greatest(c - F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3")), F.lit(0.0)) / F.col("total")
        if lower is None:
            p = grams.select("lang", "key", (own + F.col("g") / 65536).alias("p"))
        else:
            below = lower.select("lang", F.col("key").alias("low"), F.col("p").alias("q"))
            p = grams.withColumn("low", F.col("key").bitwiseAND(F.lit(_MASK[n - 1]))).join(below.hint("merge"), ["lang", "low"]).select("lang", "key", (own + F.col("g") * F.col("q")).alias("p"))
        lower = scratch.keep(p, f"p{n}")
        parts.append(lower.select("lang", F.lit(n).alias("n"), "key", F.log("p").cast("float").alias("lp"), F.lit(None).cast("float").alias("lg")))
        parts.append(context.select("lang", F.lit(n - 1).alias("n"), F.col("ctx").alias("key"), F.lit(None).cast("float").alias("lp"), F.log("g").cast("float").alias("lg")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return lower, out


class Model:
    """Sorted key arrays by language and order, looked up by binary search."""

    def __init__(self, rows: pa.Table):
        self.lp: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.lg: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        frame = rows.to_pandas()
        for kind, into in (("lp", self.lp), ("lg", self.lg)):
            for (lang, n), part in frame[frame[kind].notna()].groupby(["lang", "n"]):
                keys = part["key"].to_numpy(np.int64).view(np.uint64)
                by = np.argsort(keys)
                into[lang, int(n)] = keys[by], part[kind].to_numpy(np.float32)[by]

    @staticmethod
    def _find(table: tuple | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None or not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def score(self, lang: str, text: bytes) -> float:
        """The log probability of a text."""
        grams = Grams.of([text])

        def told(keys: np.ndarray) -> np.ndarray:
            total, left = np.zeros(len(keys)), np.arange(len(keys))
            for n in range(ORDER, 0, -1):
                k = keys[left] & np.uint64(_MASK.get(n, (1 << 64) - 1))
                there, value = self._find(self.lp.get((lang, n)), k)
                total[left[there]] += value[there]
                left, k = left[~there], k[~there]
                known, weight = self._find(self.lg.get((lang, n - 1)), k >> np.uint64(16))
                total[left[known]] += weight[known]
            total[left] += np.log(1 / 65536)
            return total

        return float(grams.sums(told)[0])


def text_stats(raw: bytes, code: np.ndarray, chars: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; code: the number of each word, chars: characters of the words with these numbers."""
    n = len(code)
    symbols = sum(raw.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeat = 0
    if n >= 3:
        size = len(chars)
        pair = code[:-1] * size + code[1:]
        if size < 2_000_000:
            grams = pair[:-1] * size + code[2:]
        else:  # three numbers no longer fit in 63 bits: pairs are numbered first
            grams = np.unique(pair, return_inverse=True)[1][:-1].astype(np.int64) * size + code[2:]
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        if same.any():
            twice = np.zeros(len(grams), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            covered[:-2] |= twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeat = int(covered.sum())
    return n, int(chars[code].sum()) if n else 0, symbols, len(lines) - len(set(lines)), repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def fit_model(docs: DataFrame, scratch: Scratch, max_ngrams: int) -> Model:
    """The whole model of a small table at the driver, to score words that no text holds; more entries are an error."""
    model = scratch.keep(kneser_ney(scratch.keep(count_grams(docs), "counts"), scratch)[1], "model")
    if model.count() > max_ngrams:
        raise ValueError(f"the model has more than {max_ngrams} entries")
    return Model(model.toArrow())


def score_rows(docs: DataFrame, scratch: Scratch, block_bytes: int) -> DataFrame:
    """doc_id, lang, the counting rules' figures and log_ppl (null without words) for each row of docs, as a table of scratch.

    The model is counted over the same rows, so it holds each of their 4-grams and none backs off.
    """
    blocks = scratch.keep_bucketed(pack_blocks(docs, block_bytes), "blocks", "block")
    asked = scratch.keep(block_grams(blocks), "asked")
    counts = scratch.keep(asked.groupBy("lang", "key").agg(F.sum("c").alias("c")), "counts")
    told = asked.select("block", "lang", "key").join(kneser_ney(counts, scratch)[0].hint("merge"), ["lang", "key"]).select("block", "lang", "key", F.log("p").alias("lp"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((s, pa.int64()) for s in STATS), ("log_ppl", pa.float64())])

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for packed in mine.column("packed").to_pylist():
            for lang, texts in _by_lang(_unpack(packed)):
                some = told.filter(pc.equal(told.column("lang"), lang))
                keys, lps = some.column("key").to_numpy().view(np.uint64), some.column("lp").to_numpy()
                by = np.argsort(keys)
                keys, lps = keys[by], lps[by]

                def find(asked: np.ndarray, keys=keys, lps=lps) -> np.ndarray:
                    at = np.searchsorted(keys, asked)
                    if len(asked) and (at.max() >= len(keys) or (keys[at] != asked).any()):
                        raise ValueError("a block was not told of all its n-grams")
                    return lps[at]

                raws = texts.column(2).to_pylist()
                grams = Grams.of(raws)
                sums, starts = grams.sums(find), np.concatenate(([0], grams.ends[:-1]))
                stats = [text_stats(raw, grams.codes[a:b], grams.chars) for raw, a, b in zip(raws, starts.tolist(), grams.ends.tolist())]
                ppl = [-x / (s[0] + s[1]) if s[0] else None for x, s in zip(sums.tolist(), stats)]
                columns = [texts.column(0), texts.column(1), *zip(*stats), ppl]
                out.append(pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "doc_id long, lang string, " + ", ".join(f"{s} long" for s in STATS) + ", log_ppl double")
    return scratch.keep(scored, "scored")


def judge_quality(docs: DataFrame, block_bytes: int = 16 << 20, spread: float = 5.0, slack: float = 0.02) -> DataFrame:
    """One row per row of docs: the five figures, base_failed, log_ppl, the band and kept.

    A short text's log perplexity strays more than a long one's, as one over the root of its words. So
    a language's band is its median, among rows that pass the counting rules, minus and plus ``slack``
    and ``spread`` interquartile ranges of (deviation times root of words), over the root of words. A
    null lang is a language of its own; null and empty texts have no words and fail. Repeated rows give
    repeated results and count as often as they come; other columns are ignored; an empty table gives
    an empty result.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "quality-rules")
    scored = score_rows(docs, scratch, block_bytes)
    scratch.retain("scored")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    usual = scored.filter(~F.col("base_failed"))
    centre = scratch.keep(usual.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("mid")), "centre")
    strayed = (F.col("log_ppl") - F.col("mid")) * F.sqrt("n_words")
    width = join_few(usual, centre, "lang").groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile_approx(strayed, [0.25, 0.75], 10_000).alias("q"))
    width = scratch.keep(width.select("lang", "mid", (F.col("q")[1] - F.col("q")[0]).alias("iqr")), "bands")
    scratch.retain("scored", "bands")
    low, high = band(spread, slack)
    out = join_few(scored, width, "lang", "left").withColumn("ppl_low", low).withColumn("ppl_high", high)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("ppl_low"), F.col("ppl_high")), F.lit(False))
    return out.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "lang", "log_ppl", "ppl_low", "ppl_high")


def band(spread: float, slack: float) -> tuple[Column, Column]:
    """The lowest and highest log perplexity that stay, from mid, iqr and n_words."""
    reach = F.lit(slack) + spread * F.col("iqr") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    return F.col("mid") - reach, F.col("mid") + reach
