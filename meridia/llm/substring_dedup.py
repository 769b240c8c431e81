"""Substring dedup: repeated 20-word windows, found by super-k-mer partitioning.

Each window of ``window`` words has a minimiser, the smallest hash of its ``gram``-word grams.
Consecutive windows of a document with the same minimiser travel as one packed string to the
minimiser's bucket, so equal windows always meet there, and a bucket's windows are sorted out
exactly on their words. A task drops packed strings that it has already sent (their windows are
known to be repeated), so a passage held by a third of all rows reaches its bucket once per task.

A bucket beyond ``most_bytes`` (a phrase that very many texts share in ever different surroundings
is the minimiser of them all) is not sorted out: its strings are dealt again by minimisers of longer
grams, under another hash, to buckets of the next level, and at last by whole windows. Equal windows
have equal minimisers at every level, so they go on meeting.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.textops import Scratch, as_bytes, pieces, text_key

_LAST = (1 << 63) - 1  # orders a null doc_id after all others
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SENT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_FOUND = pa.schema([("doc", pa.int64()), ("tk", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), *_SENT])
_FOUND_DDL = "doc long, tk long, starts array<int>, ends array<int>, bucket int, packed binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` word hashes."""
    h = words[: len(words) - gram + 1].copy()
    for j in range(1, gram):
        h = h * _MIX + words[j : len(words) - gram + 1 + j]
    return mixed(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse; a bounded number of them is kept."""

    base, most = 0x9E3779B97F4A7C15, 1 << 17
    kept = np.ones((2, 1), np.uint64)

    @classmethod
    def first(cls, n: int) -> np.ndarray:
        if cls.kept.shape[1] >= n:
            return cls.kept[:, :n]
        size = max(n, min(2 * n, cls.most))
        made = np.empty((2, size), np.uint64)
        for row, p in zip(made, (cls.base, pow(cls.base, -1, 1 << 64))):
            row[0], row[1:] = 1, p
            np.multiply.accumulate(row, out=row)
        if size <= cls.most:
            cls.kept = made
        return made[:, :n]


def word_edges(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a line with single spaces begins and ends."""
    if not line:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))


_OF_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_OF_BYTE[32] = 0  # the space behind a word adds nothing to it


def word_hashes(line: bytes, edges: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A hash of each word of a line with single spaces: its bytes' own numbers times powers by place in the word."""
    begin, end = word_edges(line) if edges is None else edges
    if not len(begin):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(line, np.uint8)
    if len(raw) < Powers.most:  # the same hashes from sums over the whole line
        up, down = Powers.first(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_OF_BYTE[raw] * up[:-1], out=sums[1:])
        return mixed((sums[end] - sums[begin]) * down[begin])
    size = np.diff(np.append(begin, len(raw)))
    place = np.arange(len(raw)) - np.repeat(begin, size)
    return mixed(np.add.reduceat(_OF_BYTE[raw] * Powers.first(int(size.max()))[0][place], begin))


def window_hashes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of each run of so many words that begins at these places, from sums over all words before."""
    up, down = Powers.first(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mixed((sums[at + window] - sums[at]) * down[at])


def super_kmers(hashes: np.ndarray, window: int, gram: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """(minimiser, first window, windows) of each run of windows with one minimiser."""
    if len(hashes) < window:
        return
    grams = gram_hashes(hashes, gram)
    least = window_minima(mixed(grams ^ np.uint64(0x5851F42D4C957F2D * level)) if level else grams, window - gram + 1)
    edges = np.flatnonzero(least[1:] != least[:-1]) + 1
    firsts = np.concatenate(([0], edges))
    counts = np.diff(np.concatenate((firsts, [len(least)])))
    yield from zip(least[firsts].tolist(), firsts.tolist(), counts.tolist())


def _pack(rows: list[tuple]) -> bytes:
    """rows: (doc, tk, start, string or None, its words); None stands for a repeated run."""
    head = np.array([(d, t, s, -n if x is None else n) for d, t, s, x, n in rows], dtype=np.int64)
    return zstandard.compress(struct.pack("<q", len(rows)) + np.ascontiguousarray(head.T).tobytes() + b" ".join(x for _, _, _, x, _ in rows if x is not None), 3)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    """Columns doc, tk, start and words (negative: a repeated run), and all strings with a space between."""
    raw = zstandard.decompress(packed)
    (n,) = struct.unpack_from("<q", raw)
    return np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n), raw[8 + 32 * n :]


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


class Sender:
    """Deals out windows as packed strings of super-k-mers; what it has already sent goes as a repeated run."""

    def __init__(self, window: int, gram: int, buckets: int, level: int = 0):
        self.window, self.gram, self.buckets, self.level = window, gram, buckets, level
        self.first: dict[bytes, tuple] = {}
        self.sent: dict[int, list] = {}
        self.held = 0

    def _repeat(self, doc: int, tk: int, start: int, words: int) -> None:
        """A run that needs no comparison may go to any bucket: by document, so that it is never a hot one."""
        self.sent.setdefault((doc * 31 + start // 1024) % self.buckets, []).append((doc, tk, start, None, words))

    def add(self, doc: int, tk: int, start: int, line: bytes) -> None:
        """The windows of a line, whose first word is at ``start`` of the document."""
        begin, end = word_edges(line)
        for least, at, count in super_kmers(word_hashes(line, (begin, end)), self.window, self.gram, self.level):
            words = count + self.window - 1
            string = line[begin[at] : end[at + words - 1]]
            bucket, me = least % self.buckets, (doc, start + at, tk)
            if (before := self.first.get(string)) is None:
                self.first[string] = (*me, bucket, words)
                self.held += len(string) + 300
                continue
            self.held += 100
            if before[:2] == me[:2]:  # one document met twice: neither row is earlier
                if before[2] != tk:
                    self.sent.setdefault(bucket, []).append((doc, tk, start + at, string, words))
                continue
            if me[:2] < before[:2]:
                self.first[string] = (*me, bucket, words)
                me = before[:3]
            self._repeat(me[0], me[2], me[1], words)

    def out(self) -> tuple[list[int], list[bytes]]:
        """What is held, by bucket."""
        for string, (doc, start, tk, bucket, n) in self.first.items():
            self.sent.setdefault(bucket, []).append((doc, tk, start, string, n))
        keys = sorted(self.sent)
        packed = [_pack(self.sent[k]) for k in keys]
        self.first, self.sent, self.held = {}, {}, 0
        return keys, packed


def _send(window: int, gram: int, buckets: int, flush: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(window, gram, buckets)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(sender.out(), _SENT.types)], schema=_SENT)

        for part in pieces(source):
            for doc, tk, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))):
                sender.add(doc, tk, 0, b" ".join(raw.split()))
                if sender.held > flush:
                    yield out()
        if sender.held:
            yield out()

    return run


def repeated_windows(line: bytes, at: np.ndarray, window: int, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows of a line, beginning at its words ``at``, equal one at an earlier (doc, start).

    Windows are sorted by hash; each is then compared with the first of its hash byte by byte. Where
    a hash stands for different windows, those are told apart by their words.
    """
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    begin, end = word_edges(line)
    keys = window_hashes(word_hashes(line, (begin, end)), at, window)
    first, last = begin[at], end[at + window - 1]
    by = np.lexsort((start, doc, keys))
    keys, doc, start, first, last = keys[by], doc[by], start[by], first[by], last[by]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    head = np.repeat(heads, np.diff(np.concatenate((heads, [len(keys)]))))
    later = np.flatnonzero(head != np.arange(len(keys)))
    of = head[later]
    moved = (doc[later] != doc[of]) | (start[later] != start[of])
    same = np.fromiter((line[a:b] == line[c:d] for a, b, c, d in zip(first[later].tolist(), last[later].tolist(), first[of].tolist(), last[of].tolist())), bool, len(later))
    out[by[later[same & moved]]] = True
    seen: dict[bytes, tuple] = {}
    for k in later[~same].tolist():
        out[by[k]] = seen.setdefault(line[first[k] : last[k]], (doc[k], start[k])) != (doc[k], start[k])
    return out


def _spans(doc: np.ndarray, tk: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Words a to b of documents as found rows, merged by document."""
    by = np.lexsort((a, tk, doc))
    doc, tk, a, b = doc[by], tk[by], a[by], b[by]
    spans: dict[tuple[int, int], list] = {}
    if len(by):
        # a window that begins where the one before it did, or a word later, goes on with its span
        fresh = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tk[1:] != tk[:-1]) | (a[1:] - a[:-1] > 1))))
        ends = np.maximum.reduceat(b, fresh)
        for d, t, x, y in zip(doc[fresh].tolist(), tk[fresh].tolist(), a[fresh].tolist(), ends.tolist()):
            spans.setdefault((d, t), []).append((x, y))
    rows = [(d, t, _merge(x)) for (d, t), x in spans.items()]
    columns = [[d for d, _, _ in rows], [t for _, t, _ in rows], [[a for a, _ in x] for _, _, x in rows], [[b for _, b in x] for _, _, x in rows], [None] * len(rows), [None] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types)], schema=_FOUND)


def _strings(head: np.ndarray, line: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc, tk, start, string) of each packed string."""
    begin, end = word_edges(line)
    last = np.cumsum(head[3])
    for d, t, start, a, b in zip(*head[:3].tolist(), begin[last - head[3]].tolist(), end[last - 1].tolist()):
        yield d, t, start, line[a:b]


def _meet(window: int, most_bytes: int, sender):
    """A bucket's windows, sorted: every one that is not the first of its words is repeated.

    Beyond ``most_bytes`` of strings a bucket is dealt out again by ``sender()``, if there is one.
    """

    def run(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, lines, held, dealer = [np.zeros((4, 0), np.int64)], [], 0, None

        def out() -> pa.RecordBatch:
            keys, packed = dealer.out()
            none = [None] * len(keys)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, keys, packed), _FOUND.types)], schema=_FOUND)

        for part in source:
            for packed in part.column("packed").to_pylist():
                head, line = _unpack(packed)
                runs = head[:, head[3] < 0]
                if runs.shape[1]:
                    yield _spans(runs[0], runs[1], runs[2], runs[2] - runs[3])
                if not line:
                    continue
                heads.append(head[:, head[3] > 0])
                lines.append(line)
                held += len(line)
                if sender and (dealer or held > most_bytes):
                    dealer = dealer or sender()
                    for head, line in zip(heads[1 if not heads[0].shape[1] else 0 :], lines):
                        for string in _strings(head, line):
                            dealer.add(*string)
                        if dealer.held > most_bytes:
                            yield out()
                    heads, lines = [], []
        if dealer:
            if dealer.held:
                yield out()
            return
        head, line = np.concatenate(heads, axis=1), b" ".join(lines)
        counts = head[3] - window + 1
        row = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(head[3]) - head[3], counts) + nth
        start = head[2][row] + nth
        gone = np.flatnonzero(repeated_windows(line, at, window, head[0][row], start))
        yield _spans(head[0][row[gone]], head[1][row[gone]], start[gone], start[gone] + window)

    return run


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 5, bucket_bytes: int = 8 << 20, most_bytes: int = 48 << 20, texts: bool = False) -> DataFrame:
    """One row per row of docs: n_words, n_removed and the digest of the words kept (with texts, also ``kept``).

    A window is repeated if an equal one starts at a smaller doc_id, or earlier in the same document;
    a null doc_id comes last. A null or empty text has no words. Rows alike in doc_id and text are one
    document and each gets its result; windows at the same place of rows that share a doc_id but not
    the text do not repeat each other. Texts shorter than the window stay whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"), text_key().alias("tk"), docs["text"].alias("text"), docs["doc_id"].cast("long").alias("doc_id"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, int(size * 3 // bucket_bytes))  # packed strings overlap: they have about three times the text
    sent = keyed.select("doc", "tk", "text").mapInArrow(_send(window, gram, buckets, 24 << 20), "bucket int, packed binary")
    grams = [gram, *sorted({min(2 * gram, window), window} - {gram})]  # of each level; at the last a window is its own minimiser
    spans = None
    for level in range(len(grams)):
        more = None if level + 1 == len(grams) else partial(Sender, window, grams[level + 1], buckets, level + 1)
        met = scratch.keep(sent.groupBy("bucket").applyInArrow(_meet(window, most_bytes, more), _FOUND_DDL), f"met-{level}")
        found = met.filter("packed is null").select("doc", "tk", "starts", "ends")
        spans = found if spans is None else spans.unionByName(found)
        sent = met.filter("packed is not null").select("bucket", "packed")
        if more is None or not sent.limit(1).count():
            break
    by_doc = spans.groupBy("doc", "tk").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if texts else [])])

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(source):
            rows = []
            for i, raw, starts, ends in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = raw.split()
                kept, at = [], 0
                for a, b in _merge(list(zip(starts or (), ends or ()))):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out = b" ".join(kept)
                rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest(), *([out.decode()] if texts else [])))
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    joined = keyed.join(by_doc, keyed["doc"].eqNullSafe(by_doc["doc"]) & keyed["tk"].eqNullSafe(by_doc["tk"]), "left")
    return joined.select(keyed["doc_id"], keyed["text"], by_doc["starts"], by_doc["ends"]).mapInArrow(cut, SCHEMA + (", kept string" if texts else ""))
