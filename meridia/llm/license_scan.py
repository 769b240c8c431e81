"""License scans: exact phrases, and short notices found with a bounded number of edits.

Each notice is cut into ``errors + 1`` pieces. A text that holds the notice with at most
``errors`` edits holds one piece unchanged (pigeonhole), so exact piece hits give every place
worth verifying; there the regex library matches the notice with bounded errors and its span
and edit count are reported. Everything happens within a row: no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from meridia.llm.textops import PLAIN_WORD_BYTES, as_bytes, pieces

#: Phrases whose every place counts, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices that are looked for with edits: label, words. About one edit in ten characters is allowed.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "mozilla public license version 2 0"),
    ("cc", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
)

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), *((n, pa.string()) for n in ("base_labels", "labels")), ("score", pa.float64()), ("spans", pa.string())])


def allowed_edits(notice: str) -> int:
    return max(1, len(notice) // 10)


def seeds_of(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _compiled(notices: tuple):
    """The automaton of all seeds; a fuzzy pattern and the edits allowed for each notice."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for k, (_, notice) in enumerate(notices):
        errors = allowed_edits(notice)
        patterns.append((regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={errors}}}"), errors, len(notice)))
        for at, seed in seeds_of(notice, errors):
            seeds.setdefault(seed, []).append((k, at))
    automaton = ahocorasick.Automaton()
    for seed, places in seeds.items():
        automaton.add_word(seed, (len(seed), places))
    automaton.make_automaton()
    return automaton, patterns


def fuzzy_spans(line: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the disjoint matches of each notice in a normalised text, by notice and place."""
    automaton, patterns = _compiled(notices)
    near: dict[int, list[tuple[int, int]]] = {}
    for end, (length, places) in automaton.iter(line):
        for k, at in places:
            _, errors, size = patterns[k]
            start = end - length + 1 - at
            near.setdefault(k, []).append((max(0, start - errors), min(len(line), start + size + errors)))
    found = []
    for k in sorted(near):
        pattern, errors, size = patterns[k]
        # A window where several seeds meet is likelier a match, yet one seed suffices: all are verified, overlapping windows as one.
        merged: list[list[int]] = []
        for a, b in sorted(near[k]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            # regex errors also count what lies before a match, so a match starts and ends at words
            for m in pattern.finditer(line, a, b):
                found.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
    return found


def scan_text(raw: bytes, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> tuple:
    """n_words, n_base, first and last place, base labels, all labels, score and spans of one text.

    The words of the lower-cased text, joined by one space, make the normalised line; a span's
    start and end are word numbers of that line (end exclusive).
    """
    words = PLAIN_WORD_BYTES.findall(raw.lower())
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    spaces: list[int] | None = None
    places, base = [], set()

    def word_at(offset: int) -> int:
        nonlocal spaces
        if spaces is None:
            spaces = [m.start() for m in re.finditer(" ", line)]
        return bisect.bisect_right(spaces, offset) - 1

    for phrase, label in phrases:
        at = line.find(f" {phrase} ")
        while at >= 0:
            places.append(word_at(at))
            base.add(label)
            at = line.find(f" {phrase} ", at + 1)
    labels, spans, score = set(base), [], 1.0 if base else 0.0
    for k, start, end, edits in fuzzy_spans(line, notices):
        label, notice = notices[k]
        labels.add(label)
        score = max(score, 1.0 - edits / len(notice))
        spans.append(f"{label}:{max(0, word_at(start))}:{word_at(max(start, end - 1)) + 1}:{edits}")
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(spans)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts of phrases, labels, score and the notices' spans.

    A null or empty text has no words, no places (null first and last), empty labels and score 0.
    Repeated rows give repeated results; other columns are ignored. The score is 1 for an exact
    phrase, else the best notice's share of characters that needed no edit, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [scan_text(raw) for raw in as_bytes(batch.column(1))]
            columns = list(zip(*found)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _ARROW.types[1:]))], schema=_ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, SCHEMA)
