"""Language model scores by a hierarchical Pitman-Yor process over words.

Every word is a context with a restaurant of its own, whose tables serve the words that follow it; their
tables send customers to one parent restaurant, which all contexts share, and its tables draw from the
training vocabulary and one unknown word alike. Seating is sampled by Gibbs sweeps, and predictive
probabilities are averaged over the kept samples.

Texts are read once into blocks of word numbers. Blocks ask for the counts of their distinct words, then
send their distinct (context, word) pairs with counts, packed by part, to the tasks that seat them, and get
back what they need to score their own texts. A context's pairs share a part, so a restaurant is whole
there; the few contexts with at least a 2000th of all tokens are dealt over all parts by pair, where each
part takes its share of their customers as a picture of the others' tables. No task holds more of the
model than a part or what one block asked for, and nothing that grows with the corpus goes to the driver
but one row a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.textops import Scratch, pieces

END, START = b" ", b"  "  # no word has a space
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_BLOCKS = "block long, n_tokens long, n_words long, n_texts long, docs binary, codes binary, hashes binary, counts binary"
_REPLY = "block long, kind int, part long, one binary, two binary"
_WORDS, _PARENT, _PAIRS = 0, 1, 2


def pack(values: np.ndarray) -> bytes:
    """An array in few bytes: as narrow as it fits, its bytes by place, compressed."""
    if values.dtype.kind in "iu":
        most = int(values.max()) if len(values) else 0
        values = values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.copy()
    return values.dtype.char.encode() + zstandard.compress(planes.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    kind = np.dtype(packed[:1].decode())
    raw = np.frombuffer(zstandard.decompress(packed[1:]), np.uint8)
    return raw.reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


@dataclass(frozen=True)
class Priors:
    """Discounts and strengths of the contexts' restaurants and of their parent; sweeps of the sampler, and how many come first unused."""

    discount: float = 0.8
    strength: float = 1.0
    parent_discount: float = 0.7
    parent_strength: float = 10.0
    sweeps: int = 5
    burn: int = 2
    seed: int = 20


def text_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, ends, hashes): each text's words and its end as places in the sorted hashes of the distinct words."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes, upto = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    upto = upto - upto[0]
    there = np.array([len(w) > 0 for w in words], bool)[codes] if words else np.zeros(0, bool)
    ends = np.concatenate(([0], np.cumsum(there)))[upto[1:]]
    hashes, number = np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in [*words, END]], np.uint64), return_inverse=True)
    out = np.full(len(texts) + int(there.sum()), number[-1], np.int64)
    ends = ends + np.arange(1, len(texts) + 1)
    word = np.ones(len(out), bool)
    word[ends - 1] = False
    out[word] = number[codes[there]]
    used = np.zeros(len(hashes), bool)
    used[out] = True
    return (np.cumsum(used) - 1)[out], ends, hashes[used]


def pack_texts(docs: DataFrame, block_bytes: int, held: tuple[int, int]) -> DataFrame:
    """Blocks of about so many bytes of text: doc_ids, word numbers, the words' hashes and training counts."""
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _BLOCKS.split(", ")])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size, parts = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            ids = rows.column(0).combine_chunks()
            codes, ends, hashes = text_codes(rows.column(1).combine_chunks())
            kept = np.array([i is None or zlib.crc32(str(i).encode()) % held[0] != held[1] for i in ids.to_pylist()], bool)
            trains = np.repeat(kept, np.diff(ends, prepend=0))
            numbers = np.stack([pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False), kept, ends]).astype(np.int64)
            counts = np.bincount(codes[trains], minlength=len(hashes))
            row = [(task << 24) + made, len(codes), len(hashes), int(kept.sum()), zstandard.compress(numbers.tobytes(), 1), pack(codes), hashes.tobytes(), pack(counts)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        for batch in source:
            for part in pieces([batch], 500):
                parts.append(part)
                size += part.column(1).nbytes
                if size >= block_bytes:
                    yield out()
                    parts.clear()
                    made, size = made + 1, 0
        if parts and any(p.num_rows for p in parts):
            yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, _BLOCKS)


def _cuts(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def ask_words(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, one, two): hashes and training counts of each block's words, by ranges of hashes."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(parts)
        for batch in source:
            for block, hashes, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                hashes, counts = np.frombuffer(hashes, np.uint64), unpack(counts)
                at = [0, *np.searchsorted(hashes, cuts).tolist(), len(hashes)]
                rows = [(k, block, hashes[a:b].tobytes(), pack(counts[a:b])) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return blocks.select("block", "hashes", "counts").mapInArrow(run, "part long, block long, one binary, two binary")


def count_words(asked: DataFrame) -> DataFrame:
    """Replies (block, kind, part, one, two): the ranks and counts of what each block asked; and for each part a row (block null, held, known, total) of sums."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        part, blocks = group.column("part")[0].as_py(), group.column("block").to_pylist()
        keys = [np.frombuffer(x, np.uint64) for x in group.column("one").to_pylist()]
        words, rank = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        at, ranks = 0, []
        for k, packed in zip(keys, group.column("two").to_pylist()):
            ranks.append(rank[at : at + len(k)])
            counts[ranks[-1]] += unpack(packed).astype(np.int64)
            at += len(k)
        n = len(blocks)
        columns = [[*blocks, None], [_WORDS] * (n + 1), [part] * (n + 1), [*(pack(r) for r in ranks), None], [*(pack(counts[r]) for r in ranks), None], [None] * n + [len(words)], [None] * n + [int((counts > 0).sum())], [None] * n + [int(counts.sum())]]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["block", "kind", "part", "one", "two", "held", "known", "total"])

    return asked.groupBy("part").applyInArrow(run, _REPLY + ", held long, known long, total long")


@dataclass
class Corpus:
    """What all blocks are told: training tokens and texts, known words, the first number of each part's words, parts of pairs, the most contexts dealt by pair."""

    tokens: int
    texts: int
    known: int
    first: np.ndarray
    parts: int
    hot: int


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Block:
    """A block's texts, the counts and numbers of its words, and its distinct (context, word) pairs by part."""

    def __init__(self, row: dict, replies: list[dict], corpus: Corpus):
        self.ids, self.valid, self.kept, self.ends = np.frombuffer(zstandard.decompress(row["docs"]), np.int64).reshape(4, -1)
        self.codes = unpack(row["codes"]).astype(np.int64)
        told = sorted((r for r in replies if r["kind"] == _WORDS), key=lambda r: r["part"])
        self.word_counts = np.concatenate([unpack(r["two"]).astype(np.int64) for r in told])
        self.numbers = np.concatenate([unpack(r["one"]).astype(np.int64) + corpus.first[r["part"]] for r in told])
        n = len(self.numbers)
        context = np.empty_like(self.codes)
        context[1:] = self.codes[:-1]
        context[np.concatenate(([0], self.ends[:-1]))] = n  # the start of a text
        pairs, self.pair = np.unique(context * n + self.codes, return_inverse=True)
        context, self.word = pairs // n, pairs % n
        # numbers of words are from 0; that of the start comes after all of them
        number = np.append(self.numbers, corpus.first[-1]).astype(np.uint64)
        asked = np.append(self.word_counts, corpus.texts)
        hot = asked * corpus.hot >= corpus.tokens
        key = _mix(number[context] + np.uint64(1))
        key = np.where(hot[context], _mix(key ^ number[self.word]), key)
        part = (key % np.uint64(corpus.parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.cuts = np.searchsorted(part[self.order], np.arange(corpus.parts + 1))
        self.context, self.asked, self.hot, self.number = context, asked, hot, number

    def runs(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a part, their distinct contexts and the pairs of each context: neighbours, as pairs are sorted."""
        pairs = self.order[self.cuts[part] : self.cuts[part + 1]]
        starts = np.flatnonzero(np.diff(self.context[pairs], prepend=-1))
        return pairs, self.context[pairs[starts]], np.diff(np.append(starts, len(pairs)))


def _block(mine: pa.Table, replies: pa.Table, corpus: Corpus) -> Block:
    return Block(mine.to_pylist()[0], replies.to_pylist(), corpus)


def ask_pairs(blocks: DataFrame, words: DataFrame, corpus: Corpus) -> DataFrame:
    """(part, block, contexts, runs, totals, words, counts, base): each block's pairs by part, packed.

    totals are the training tokens of hot contexts and 0 for others; base is a word's share of all
    training tokens, in quarters of a power of 2, which seating takes for the parent's probability.
    """
    names = ["contexts", "runs", "totals", "words", "counts", "base"]
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in names)])

    def run(mine: pa.Table, replies: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return schema.empty_table()
        b = _block(mine, replies, corpus)
        number = mine.column("block")[0].as_py()
        counts = np.bincount(b.pair[np.repeat(b.kept > 0, np.diff(b.ends, prepend=0))], minlength=len(b.word))
        share = (b.word_counts + 1) / (corpus.tokens + corpus.known + 1)
        code = np.clip(np.rint(-4 * np.log2(share)), 0, 255).astype(np.uint8)
        rows = []
        for part in np.flatnonzero(np.diff(b.cuts)).tolist():
            pairs, contexts, runs = b.runs(part)
            totals = np.where(b.hot[contexts], b.asked[contexts], 0)
            rows.append((part, number, *map(pack, (b.number[contexts], runs, totals, b.number[b.word[pairs]], counts[pairs], code[b.word[pairs]]))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, "part long, block long, " + ", ".join(f"{c} binary" for c in names))


def _seat_dish(rng: np.random.Generator, counts: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables for dishes seated anew, customer by customer, and the log of what the draws' shares added up to.

    counts fall; others is strength + discount * tables of the other dishes. Past the 32nd, customers
    come in blocks of a sixteenth of those seated, by a binomial draw at the block's middle.
    """
    tables, weight = np.ones(len(counts)), np.zeros(len(counts))
    at = 1
    while (n := int(np.searchsorted(-counts, -at))) > 0:
        some = np.ones(n) if at < 32 else np.minimum(counts[:n] - at, at // 16)
        new = (others[:n] + discount * tables[:n]) * base[:n]
        total = new + at + (some - 1) / 2 - discount * tables[:n]
        tables[:n] += rng.random(n) < new / total if at < 32 else rng.binomial(some.astype(np.int64), new / total)
        weight[:n] += some * np.log(total)
        at += 1 if at < 32 else at // 16
    return tables, weight


def gibbs(rng: np.random.Generator, counts: np.ndarray, restaurant: np.ndarray, scale: np.ndarray, base: np.ndarray, discount: float, strength: float, sweeps: int, burn: int) -> list[np.ndarray]:
    """Samples of the tables of each dish. scale: a restaurant's customers everywhere over those seated here.

    A sweep takes each dish's customers out and seats them anew, given all other tables; a Metropolis step
    corrects for seating them one after the other. A dish with one customer has one table.
    """
    by = np.argsort(-counts, kind="stable")
    many = by[: int(np.searchsorted(-counts[by], -1))]
    tables, weight, out = np.ones(len(counts)), np.full(len(many), -np.inf), []
    for sweep in range(sweeps):
        all_tables = np.bincount(restaurant, tables, len(scale)) * scale
        others = strength + discount * (all_tables[restaurant[many]] - tables[many])
        drawn, drawn_weight = _seat_dish(rng, counts[many], others, base[many], discount)
        takes = np.log(rng.random(len(many))) < drawn_weight - weight
        tables[many] = np.where(takes, drawn, tables[many])
        weight = np.where(takes, drawn_weight, weight)
        if sweep >= burn:
            out.append(tables.copy())
    return out


def seat_pairs(asked: DataFrame, corpus: Corpus, word_cuts: np.ndarray, priors: Priors) -> DataFrame:
    """Replies to blocks (a pair's own probability; its context's weight of the parent, negative where hot), customers of the parent by part of words, and hot contexts' tables."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["block", "kind", "part", "one", "two", "word_part", "customers", "hot", "tables"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        part, blocks = group.column("part")[0].as_py(), group.column("block").to_pylist()
        got = {c: [unpack(x) for x in group.column(c).to_pylist()] for c in ("contexts", "runs", "totals", "words", "counts", "base")}
        sizes = [len(x) for x in got["words"]]
        contexts, which = np.unique(np.concatenate(got["contexts"]).astype(np.int64), return_inverse=True)
        totals = np.zeros(len(contexts), np.int64)
        np.maximum.at(totals, which, np.concatenate(got["totals"]).astype(np.int64))
        runs = np.concatenate(got["runs"]).astype(np.int64)
        words, word = np.unique(np.concatenate(got["words"]).astype(np.int64), return_inverse=True)
        pairs, first, pair = np.unique(np.repeat(which, runs) * len(words) + word, return_index=True, return_inverse=True)
        counts = np.bincount(pair, np.concatenate(got["counts"]), len(pairs))
        base = np.exp2(np.concatenate(got["base"])[first] / -4.0)
        seen = np.flatnonzero(counts > 0)
        restaurant = pairs[seen] // len(words)
        here = np.bincount(restaurant, counts[seen], len(contexts))
        customers = np.where(totals > 0, totals, here)
        rng = np.random.default_rng([priors.seed, part])
        samples = gibbs(rng, counts[seen], restaurant, customers / np.maximum(here, 1), base[seen], priors.discount, priors.strength, priors.sweeps, priors.burn)
        tables = sum(samples) / len(samples)
        own = np.zeros(len(pairs))
        own[seen] = (counts[seen] - priors.discount * tables) / (priors.strength + customers[restaurant])
        seated = np.bincount(restaurant, tables, len(contexts))
        weight = np.where(totals > 0, -1.0, (priors.strength + priors.discount * seated) / (priors.strength + customers))
        rows, at, run_at = [], 0, 0
        for block, n, mine in zip(blocks, sizes, got["contexts"]):
            rows.append((block, _PAIRS, part, pack(own[pair[at : at + n]].astype(np.float32)), pack(weight[which[run_at : run_at + len(mine)]].astype(np.float32)), None, None, None, None))
            at, run_at = at + n, run_at + len(mine)
        sent = np.bincount(pairs[seen] % len(words), samples[-1], len(words)).astype(np.int64)
        cuts = np.searchsorted(words, word_cuts)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            some = a + np.flatnonzero(sent[a:b])
            if len(some):
                rows.append((None, None, part, pack(words[some] - word_cuts[k]), pack(sent[some]), k, int(sent[some].sum()), None, None))
        hot = totals > 0
        rows.extend((None, None, part, None, None, None, n, c, t) for n, c, t in zip(totals[hot].tolist(), contexts[hot].tolist(), seated[hot].tolist()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return asked.groupBy("part").applyInArrow(run, _REPLY + ", word_part long, customers long, hot long, tables double")


def seat_parent(words: DataFrame, customers: DataFrame, corpus: Corpus, total: int, priors: Priors) -> DataFrame:
    """Replies to blocks: the parent restaurant's own probability of each word; and for each part its tables (block null)."""
    names, types = ["block", "kind", "part", "one", "two", "tables"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]

    def run(asked: pa.Table, sent: pa.Table) -> pa.Table:
        if not asked.num_rows:
            raise ValueError("customers of a part that no block asked for")
        part, size = asked.column("part")[0].as_py(), int(max(corpus.first[1:] - corpus.first[:-1]))
        counts = np.zeros(size, np.int64)
        for one, two in zip(sent.column("one").to_pylist(), sent.column("two").to_pylist()):
            counts[unpack(one).astype(np.int64)] += unpack(two).astype(np.int64)
        seen = np.flatnonzero(counts)
        rng = np.random.default_rng([priors.seed, 1, part])
        here = np.array([max(int(counts.sum()), 1)])
        samples = gibbs(rng, counts[seen].astype(float), np.zeros(len(seen), np.int64), total / here, np.full(len(seen), 1 / (corpus.known + 1)), priors.parent_discount, priors.parent_strength, priors.sweeps, priors.burn)
        tables = sum(samples) / len(samples)
        own = np.zeros(size)
        own[seen] = (counts[seen] - priors.parent_discount * tables) / (priors.parent_strength + total)
        asked = asked.filter(pc.is_valid(asked.column("block")))
        rows = [(b, _PARENT, part, pack(own[unpack(r).astype(np.int64)]), None, None) for b, r in zip(asked.column("block").to_pylist(), asked.column("one").to_pylist())]
        rows.append((None, _PARENT, part, None, None, float(tables.sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    left = words.groupBy("part").cogroup(customers.groupBy(F.col("word_part").alias("part")))
    return left.applyInArrow(run, _REPLY + ", tables double")


def score_blocks(blocks: DataFrame, replies: DataFrame, corpus: Corpus, weights: dict[int, float], unseen: float) -> DataFrame:
    """Each document's figures and scores, from its block and all replies to it."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return schema.empty_table()
        replies = told.to_pylist()
        b = Block(mine.to_pylist()[0], replies, corpus)
        parent = np.concatenate([unpack(r["one"]) for r in sorted((r for r in replies if r["kind"] == _PARENT), key=lambda r: r["part"])]) + unseen
        own, weight = np.zeros(len(b.word)), np.zeros(len(b.word))
        for r in (r for r in replies if r["kind"] == _PAIRS):
            pairs, contexts, runs = b.runs(r["part"])
            own[pairs] = unpack(r["one"])
            mass = unpack(r["two"]).astype(float)
            for k in np.flatnonzero(mass < 0).tolist():
                mass[k] = weights[int(b.number[contexts[k]])]
            weight[pairs] = np.repeat(mass, runs)
        starts = np.concatenate(([0], b.ends[:-1]))
        score = np.add.reduceat(np.log10(own + weight * parent[b.word])[b.pair], starts)
        base = np.add.reduceat(np.log10((b.word_counts + 1) / (corpus.tokens + corpus.known + 1))[b.codes], starts)
        known = np.add.reduceat((b.word_counts > 0).astype(np.int64)[b.codes], starts)
        ids = pa.array(b.ids, pa.int64(), mask=b.valid == 0)
        columns = [ids, pa.array(b.kept == 0), pa.array(np.diff(b.ends, prepend=0)), pa.array(known), pa.array(np.full(len(base), corpus.tokens)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, schema=schema)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, SCORES)


def score_texts(docs: DataFrame, held: tuple[int, int] = (7, 2), priors: Priors = Priors(), block_bytes: int = 16 << 20, part_bytes: int = 24 << 20, hot: int = 2000) -> DataFrame:
    """One row per row of docs: its tokens, those known, the add-one unigram score and the model's, both log10.

    Words are runs of anything but ASCII white space with A-Z lower-cased, an end follows each text and
    counts as a word. The model learns from documents whose doc_id's CRC-32 modulo ``held[0]`` isn't
    ``held[1]``; a null doc_id is learnt from. A null or empty text is an end alone. Repeated rows are
    scored alike and learnt from as often as they come; other columns are ignored; an empty table gives an
    empty result, and without training documents both scores are those of the unknown word. Words are told
    apart by 64-bit hashes. Reruns over the same files agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    blocks = scratch.keep_bucketed(pack_texts(docs, block_bytes, held), "blocks", "block")
    tokens, words, texts = blocks.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("n_texts")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, pair_parts = (max(least, -(-(n or 0) * size // part_bytes)) for n, size in ((words, 10), (tokens, 6)))
    counted = scratch.keep(count_words(ask_words(blocks, parts)), "words")
    sums = {r.part: r for r in counted.filter("block is null").select("part", "held", "known", "total").collect()}
    first = np.concatenate(([0], np.cumsum([sums[k].held if k in sums else 0 for k in range(parts)])))
    corpus = Corpus(sum(r.total for r in sums.values()), texts or 0, sum(r.known for r in sums.values()), first, pair_parts, hot)
    replies = counted.filter("block is not null").select("block", "kind", "part", "one", "two")
    asked = ask_pairs(blocks, replies, corpus)
    seated = scratch.keep(seat_pairs(asked, corpus, first, priors), "pairs")
    customers = seated.filter("word_part is not null").select("word_part", "one", "two")
    total = seated.filter("word_part is not null").agg(F.sum("customers")).first()[0] or 0
    # at most ``hot`` contexts are, and each has one sum
    tables = seated.filter("hot is not null").groupBy("hot").agg(F.max("customers").alias("customers"), F.sum("tables").alias("tables")).collect()
    weights = {r.hot: (priors.strength + priors.discount * r.tables) / (priors.strength + r.customers) for r in tables}
    parent = scratch.keep(seat_parent(replies, customers, corpus, total, priors), "parent")
    parent_tables = parent.agg(F.sum("tables")).first()[0] or 0.0
    unseen = (priors.parent_strength + priors.parent_discount * parent_tables) / (priors.parent_strength + total) / (corpus.known + 1)
    kept = ["block", "kind", "part", "one", "two"]
    everything = replies.unionByName(seated.filter("block is not null").select(kept)).unionByName(parent.filter("block is not null").select(kept))
    scored = scratch.keep(score_blocks(blocks, everything, corpus, weights, unseen), "scores")
    scratch.retain("scores")
    return scored
