"""The trie against a plain one over lists of turns, for few and many ranges, and the merge against a sort."""

import hashlib
import math
import random
import zlib

import pytest
from llm_common import rows

from meridia.llm.prefix_trie import SYMBOL, LoserTree, build_trie, common_symbols, conversation_symbols, prefix_trie, share_heads

SCHEMA = "conv_id long, turn long, role string, text string, seq string, base int, h int, symbol string"


def digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def rebuilt(turns):
    own = {}
    for c, k, role, text in turns:
        if c is not None:
            sym = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32].upper()
            own.setdefault(c, []).append(((k is not None, k or 0), sym + f"{len(text or ''):08X}", (role or "", text or "")))
    own = {c: [x for _, _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + seq[h:]
    return out


def plain(turns):
    members = {}
    convs = rebuilt(turns)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = sum(saved[x] for x in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], digest(c for c in m if tuple(convs[c]) == p))
            for p, m in members.items()
        ),
        key=repr,
    )


def frame(spark, turns):
    return spark.createDataFrame([(*t, "x", 1, 2, "y") for t in turns], SCHEMA)


def many_turns(seed, n):
    """Conversations out of few turns, many alike from the start, some with copies, gaps and one long one."""
    r = random.Random(seed)
    out = []
    for c in range(n):
        size = r.choice([1, 2, 3, 6, 7, 8]) if c != 5 else 300
        same = r.random() < 0.4
        for k in range(size):
            out.append((c, k * 2, r.choice(["user", "bot"]) if not same else "user", f"t{0 if same else r.randrange(3)}" * (1 + k % 2)))
    return out


@pytest.mark.parametrize("parts", [1, 4, 150])
def test_equals_plain_trie(spark, parts):
    """Few and many ranges: with 150, records go through two levels."""
    turns = many_turns(parts, 260)
    convs = share_heads(conversation_symbols(frame(spark, turns).repartition(3)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert rows(build_trie(convs, fan=8 if parts > 4 else 64)) == plain(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_awkward_turns(spark):
    """Nulls in every column, ties, repeated rows, turnless conversations, negative ids and clashing columns."""
    turns = [
        (None, 1, "user", "nobody's"),
        (0, None, "user", "first"),
        (0, 3, None, None),
        (0, 3, "", ""),
        (0, 7, "user", "x" * 3000),
        (1, 1, "user", "ünïcode 😀"),
        (1, 1, "user", "ünïcode 😀"),
        (1, 1, "bot", "tie"),
        (107, 1, "user", "no base"),
        (207, 1, "user", "no base"),
        *((100 + k, 0, "user", "a") for k in range(20, 60)),
        *((100 + k, 1, "user", "b") for k in range(20, 60) if k % 3),
        *((k, 0, "user", "first") for k in range(2, 9)),
        (-7, 0, "user", "a"),
        (-100, 0, "user", "a"),
    ]

    assert rows(prefix_trie(frame(spark, turns))) == plain(turns)


def test_empty(spark):
    assert rows(prefix_trie(frame(spark, []))) == []


def test_loser_tree():
    """Any number of runs, with repeated and empty entries, merges into the sorted order with right LCPs."""
    r = random.Random(3)
    symbols = [bytes([k]) * SYMBOL for k in (0, 1, 127, 128, 255)]
    for k in (1, 2, 3, 5, 8):
        runs = []
        for _ in range(k):
            keys = sorted({b"".join(r.choices(symbols, k=r.randrange(5))) for _ in range(r.randrange(40))})
            runs.append([(x, b"", common_symbols(keys[i - 1], x) if i else 0) for i, x in enumerate(keys)])
        tree = LoserTree(runs)
        got = list(tree)
        assert [x for x, _, _ in got] == sorted(x for run in runs for x, _, _ in run)
        assert all(lcp == common_symbols(a, b) for (a, _, _), (b, _, lcp) in zip(got, got[1:]))
        assert tree.compared <= (len(got) + k) * max(k - 1, 1).bit_length()
