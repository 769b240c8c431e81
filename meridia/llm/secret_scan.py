"""Secret scans: a keyword automaton, anchored expressions at its hits only, then checksums.

Nothing is shuffled: each row's whole text is scanned in its own task.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from meridia.llm.textops import LOWER, UPPER, as_text, pieces

_FOLD = str.maketrans(UPPER, LOWER)
_FLAGS = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", _FLAGS)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----")
_SLACK = re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The order of kinds that start at one place: the base kinds first.
KINDS = ("assign", "access", "hex", "github", "jwt", "pem", "slack", "card")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])


def github_checksum(body: str) -> str:
    """The six base-62 digits of the CRC-32 that end such a token."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _valid(kind: str, m: re.Match) -> bool:
    """What a match must pass besides its expression; for tokens with a checksum, that checksum."""
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind == "github":
        return github_checksum(m[1]) == m[2]
    if kind == "jwt":
        return all(map(_json_part, m[0].split(".")[:2]))
    return True


@lru_cache(maxsize=1)
def _automaton():
    automaton = ahocorasick.Automaton()
    words = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "jwt": ("eyj",), "pem": ("-----begin ",), "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")}
    for kind, keys in words.items():
        for key in keys:
            automaton.add_word(key, (kind, len(key)))
    automaton.make_automaton()
    return automaton


_ANCHORED = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "jwt": _JWT, "pem": _PEM, "slack": _SLACK}


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: leftmost, disjoint within a kind; offsets in code points."""
    folded = text.lower()
    if len(folded) != len(text):  # a character whose lower case is longer: only ASCII is folded then
        folded = text.translate(_FOLD)
    ends = dict.fromkeys(_ANCHORED, 0)
    found = []
    for last, (kind, length) in _automaton().iter(folded):
        start = last - length + 1
        if start >= ends[kind] and (m := _ANCHORED[kind].match(text, start)):
            ends[kind] = m.end()  # a match that is dropped still covers its place
            if _valid(kind, m):
                found.append((start, m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for m in _CARD.finditer(text):
        if luhn(digits := re.sub("[ -]", "", m[0])) and len(set(digits)) > 1:
            found.append((m.start(), m.end(), "card"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts and digest of the base kinds, and all spans.

    Null and empty texts have none: counts 0, empty spans, the digest of the empty string.
    Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in as_text(batch.column(1)):
                found = find_secrets(text)
                base = [x for x in found if x[2] in KINDS[:3]]
                rows.append((*(sum(x[2] == k for x in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _ARROW.types[1:]))], schema=_ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, SCHEMA)
