"""Language model scores: the base against plain counts, probabilities against plain sums, seating against its law."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_common import SCHEMA, rows

from meridia.llm.pitman_yor import Priors, gibbs, pack, score_texts, unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


HELD = [i for i in range(20_000) if held(i)]
LEARNT = [i for i in range(20_000) if not held(i)]


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), ""]


def base(table):
    counts = Counter(w for i, t in table if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in table]


def frame(spark, table):
    return spark.createDataFrame([(i, t, "en", "a", 1, "x", "y", 1, 2) for i, t in table], SCHEMA)


def figures(out):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr)


def test_awkward_rows(awkward):
    """Nulls, empty and long texts, repeated rows and clashing columns; small blocks; a rerun agrees."""
    table = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = score_texts(awkward, block_bytes=3000).collect()
    assert figures(got) == sorted(base(table), key=repr)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sorted(got, key=repr) == sorted(score_texts(awkward, block_bytes=3000).collect(), key=repr)


def test_empty(empty, spark):
    assert rows(score_texts(empty)) == []
    none = score_texts(frame(spark, [(HELD[0], "a b"), (HELD[1], None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_against_plain_sums(spark, hot):
    """Where no pair comes twice and the parent opens no second table, seating is certain and every probability is a plain sum."""
    learnt = ["a b c d", "b a d c a", "c b e f"]
    table = [*zip(LEARNT, learnt), *zip(HELD, ["a b", "a q c", "q", "", "F A C"])]
    d, s = 0.0, 2.0
    prior = Priors(discount=d, strength=s, parent_discount=0.0, parent_strength=1e-12)
    pairs = Counter(p for t in learnt for p in zip([None, *tokens(t)], tokens(t)))
    assert set(pairs.values()) == {1}
    total, parent, context = sum(pairs.values()), Counter(w for _, w in pairs), Counter(u for u, _ in pairs)

    def p(u, w):
        below = parent[w] / total if w in parent else 1e-12 / total / (len(parent) + 1)
        return (pairs[u, w] + s * below) / (context[u] + s)

    want = {i: sum(math.log10(p(u, w)) for u, w in zip([None, *tokens(t)], tokens(t))) for i, t in table}
    got = {r.doc_id: r.score for r in score_texts(frame(spark, table), priors=prior, hot=hot).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_probabilities_add_up(spark, hot):
    """The texts of up to five words over two known words and any unknown one have nearly all the mass, and never more."""
    learnt = ["a b", "a", "b a a", "", "b", "a b b a", "a", "", "b b", "a b"] * 3
    texts = [" ".join(x) for n in range(6) for x in itertools.product(["a", "b", "unknown"], repeat=n)]
    table = [*zip(LEARNT, learnt), *zip(HELD, texts)]
    mass = sum(10**r.score for r in score_texts(frame(spark, table), hot=hot).collect() if r.held_out)
    assert 0.9 < mass < 1 + 1e-6


def test_better_than_unigrams(sf_docs):
    """Held-out texts are likelier by far than under counts of words alone, those learnt from more so."""
    got = score_texts(sf_docs).collect()
    per = {k: sum(r.score - r.base_score for r in got if r.held_out == k) / sum(r.n_tokens for r in got if r.held_out == k) for k in (True, False)}
    assert per[True] > 0.2 and per[False] > per[True]


def law(n, others, base, discount):
    """The exact law of the tables of a dish with n customers, given the other tables."""
    ways = {1: others * base}
    for at in range(1, n):
        more = Counter()
        for t, w in ways.items():
            more[t] += w * (at - discount * t)
            more[t + 1] += w * (others + discount * t) * base
        ways = {t: w / at for t, w in more.items()}  # kept small; a common factor doesn't matter
    total = sum(ways.values())
    return {t: w / total for t, w in ways.items()}


@pytest.mark.parametrize("n, base", [(2, 0.3), (3, 0.5), (6, 0.2), (30, 0.05)])
def test_seating_follows_its_law(n, base):
    """Many restaurants with one dish of n customers each: the share of each number of tables."""
    rng, many, discount, strength = np.random.default_rng(1), 40_000, 0.6, 2.0
    got = gibbs(rng, np.full(many, float(n)), np.arange(many), np.ones(many), np.full(many, base), discount, strength, sweeps=12, burn=11)[0]
    want = law(n, strength, base, discount)
    assert all(abs((got == t).mean() - p) < 0.012 for t, p in want.items())


def test_hot_dish():
    """Many customers come in blocks: their tables are near what one by one gives."""
    rng = np.random.default_rng(2)
    blocks = gibbs(rng, np.full(300, 3000.0), np.arange(300), np.ones(300), np.full(300, 0.01), 0.5, 10.0, sweeps=10, burn=9)[0].mean()
    want = sum(t * p for t, p in law(3000, 10.0, 0.01, 0.5).items())
    assert abs(blocks - want) < 0.15 * want


@pytest.mark.parametrize("values", [np.zeros(0, np.int64), np.array([0, 255, 256, 1 << 40]), np.arange(300) * 300, np.array([0.5, -1, 3], np.float32)])
def test_pack(values):
    assert unpack(pack(values)).tolist() == values.tolist()
