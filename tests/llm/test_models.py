import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_common import SF, rows
from pyspark.sql import functions as F

from meridia.llm.kn_rules import Grams, count_grams, fit_model, judge_quality, text_stats
from meridia.llm.mixing import cube_sample, fly, land, mix_sources, repeat_mixed, source_targets
from meridia.llm.quality_gam import FEATURES, features_of, fit_gam, fit_quality, keep_good, score_quality, shallow_tree
from meridia.llm.textops import Scratch

WORD = "[^\x20\x09-\x0D]+"


def size_of(text):
    return len(re.findall(WORD, text or ""))


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]] if open_ else []
        if not over:
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}


@pytest.mark.parametrize("which", ["awkward", "sf_docs"])
def test_mix_meets_targets(which, request):
    docs = request.getfixturevalue(which)
    found = mix_sources(docs, block_rows=16).collect()
    sizes, seen = Counter(), Counter()
    for r in docs.collect():
        sizes[r["source"]] += size_of(r["text"])
        seen[r["doc_id"], size_of(r["text"])] += 1
    assert Counter((r["doc_id"], r["size"]) for r in found) == seen
    target, taken = brute_targets(dict(sizes)), Counter()
    largest = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]


def test_mix_reruns_agree_whatever_the_partitions(sf_docs):
    a = rows(mix_sources(sf_docs), "doc_id", "taken")
    assert a == rows(mix_sources(sf_docs.repartition(7, "source")), "doc_id", "taken")


def test_mix_of_empty_and_wordless_tables(empty, awkward):
    assert mix_sources(empty).collect() == []
    none = mix_sources(awkward.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(none) == awkward.count() and all(r["taken"] == 0 == r["target"] for r in none)


def test_repeated_rows_follow_the_mix(awkward):
    want = Counter()
    for r in mix_sources(awkward).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], size_of(r["text"])) for r in repeat_mixed(awkward).collect())
    assert got == +want and repeat_mixed(awkward).columns == awkward.columns


def test_flight_keeps_totals_and_expectations():
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 900, 200))[::-1]
    p = np.full(200, 0.37)
    ends = []
    for _ in range(300):
        q = fly(size, p, rng.random(201))
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
        ends.append(q)
    assert np.abs(np.mean(ends, axis=0) - 0.37).mean() < 0.04
    assert all(land(np.array([10.0, 20.0, 30.0]), np.array([0.5, 0.5, 0.5]), x).tolist() in ([0, 0, 1], [1, 1, 0]) for x in (0.1, 0.9))


def test_landing_keeps_each_probability():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 500, 12).astype(float), rng.random(12)
    p[3], p[7] = 0.0, 1.0
    ends = np.array([land(size, p, (k + 0.5) / 2000) for k in range(2000)])
    assert set(np.unique(ends)) <= {0.0, 1.0} and np.abs(ends.mean(axis=0) - p).max() < 2e-3
    off = np.abs(ends @ size - size @ p)
    assert np.median(off) <= 2 and off.max() <= size.max()


def test_levels_of_blocks_end_in_whole_copies(spark):
    units = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 40 AS string)) AS source", "if(id % 3 = 0, 1000, id % 40) AS sk", "id AS doc", "id * 7 AS tk", "1L AS copy", "id % 97 + 1 AS size", "0.4D AS p")
    done = cube_sample(units, Scratch(spark, "cube"), block_rows=50).collect()
    assert len(done) == 3000 and {r["p"] for r in done} <= {0.0, 1.0}
    hot = [r for r in done if r["source"] == "hot"]
    assert abs(sum(r["size"] * r["p"] for r in hot) - 0.4 * sum(r["size"] for r in hot)) <= 97  # the largest unit


def test_targets_of_tied_limits(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 4), ("c", 2), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert got == pytest.approx(brute_targets({"a": 10, "b": 4, "c": 2, None: 0}))


# ---- classifier


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    good = [r["score"] for r in scored if r["quality"] == 1]
    bad = [r["score"] for r in scored if r["quality"] == 0]
    assert good and bad and np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.9


def test_held_out_labels_are_not_learnt_from(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(score_quality(sf_docs, fit_quality(sf_docs, labels))) == rows(score_quality(sf_docs, fit_quality(sf_docs, flipped)))


def test_scores_of_awkward_rows(awkward, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (18, 0), (6, 1), (7, 1)], "doc_id long, quality int")
    model = fit_quality(awkward, labels)
    found = score_quality(awkward, model).collect()
    assert len(found) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert score_quality(empty, model).collect() == [] and len(features_of(b"")) == len(FEATURES)
    none = fit_quality(awkward, labels.limit(0))
    assert {r["score"] for r in score_quality(awkward, none).collect()} == {0.5}
    assert keep_good(awkward, none).columns == awkward.columns and keep_good(awkward, none).count() == awkward.count()


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_gam(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95
    assert shallow_tree(np.array([-1.0, -1, 1, 1]), np.ones(4), 0.0).tolist() == [1, 1, -1, -1]


# ---- quality rules


def brute_stats(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["awkward", "sf_docs"])
def test_figures_equal_brute_force(which, request):
    docs = request.getfixturevalue(which)
    found = judge_quality(docs)
    want = []
    for r in docs.collect():
        s = brute_stats(r["text"])
        want.append((r["doc_id"], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in found.collect())


def test_rules_on_empty_table(empty):
    assert judge_quality(empty).collect() == []


def stream(text):
    """White space as one mark after each word, digits as one character, after two marks for the beginning."""
    return "\2\2\3" + "".join(re.sub("[0-9]", "0", w) + "\3" for w in re.findall(WORD, text))


def brute_kneser_ney(texts):
    """Probability of each 4-gram's last character, by the recursion over counts."""
    grams = Counter()
    for text in texts:
        s = stream(text)
        for k in range(3, len(s)):
            grams[s[k - 3 : k + 1]] += 1
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cut = {}
    for n, c in levels.items():
        kinds = [sum(v == k for v in c.values()) for k in range(5)]
        y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0
        cut[n] = [0]
        for k in (1, 2, 3):
            v = k - (k + 1) * y * kinds[k + 1] / kinds[k] if kinds[k] and kinds[1] else 0
            cut[n].append(v if 0 < v < k else 0.5 * k)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 65536
        c, d = levels[n], cut[n]
        same = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        total, own = sum(same), c.get(gram, 0)
        return max(own - d[min(own, 3)], 0) / total + sum(d[min(v, 3)] for v in same) / total * p(gram[1:])

    return p


def log_p(p, text):
    s = stream(text)
    return sum(math.log(p(s[k - 3 : k + 1])) for k in range(3, len(s)))


def test_model_equals_recursion(spark):
    words = {"banana": 3, "bandana": 1, "ban": 2, "cab": 1, "a": 2, "x1y2": 1, "é": 4, "dab": 1}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    docs = spark.createDataFrame([(1, "xx", text)], "doc_id long, lang string, text string")
    model = fit_model(docs, Scratch(spark, "kn"), 1_000_000)
    p = brute_kneser_ney([text])
    for t in [text, *words, "bandit cab", "zebra\n a", "cabana a a", ""]:
        assert model.score("xx", t.encode()) == pytest.approx(log_p(p, t), rel=1e-4)
    assert model.score("xx", b"ban dab cab banana") != model.score("xx", b"banana cab dab ban")
    assert math.isfinite(model.score("unseen", b"abc"))


def test_counts_cover_all_rows(spark):
    docs = spark.createDataFrame([(k, None if k % 2 else "en", "aa b " * k) for k in range(20)], "doc_id long, lang string, text string")
    total = count_grams(docs.repartition(5)).agg(F.sum("c")).first()[0]
    assert total == sum(k * (3 + 2) for k in range(20))
    texts = ["ab  \3c\nab", "", " \t", "d", "x" * 70_000 + " \U0001f600 \2"]
    keys, often = Grams.of([t.encode() for t in texts]).counts()
    want = Counter()
    for t in texts:
        s = [2, 2] + [3]
        for w in re.findall(WORD, t):
            s += [0xFFFF if ord(c) > 0xFFFF or c in "\2\3" else ord(c) for c in w] + [3]
        want.update(tuple(s[k - 3 : k + 1]) for k in range(3, len(s)))
    unpack = lambda k: tuple(int(k) >> 16 * j & 0xFFFF for j in (3, 2, 1, 0))
    assert dict(zip(map(unpack, keys), often.tolist())) == dict(want)


def test_scores_hold_every_gram_whatever_the_blocks(spark):
    """A language of few rare words keeps its own probabilities beside one with over a million 4-grams."""
    rng = np.random.default_rng(3)
    wide = [(k, "zh", " ".join("".join(map(chr, w)) for w in rng.integers(0x4E00, 0x9F00, (7_500, 5)))) for k in range(24)]
    rare = [(100 + k, "cy", " ".join(["llan", "afon", "mynydd", "cwm"][(j + k) % 4] + chr(97 + k) for j in range(60))) for k in range(8)]
    schema = "doc_id long, lang string, text string"
    alone = {r["doc_id"]: r["log_ppl"] for r in judge_quality(spark.createDataFrame(rare, schema), block_bytes=500).collect()}
    both = {r["doc_id"]: r["log_ppl"] for r in judge_quality(spark.createDataFrame(wide + rare, schema)).collect()}
    assert {i: both[i] for i in alone} == pytest.approx(alone, rel=1e-9) and max(alone.values()) < 3
    p = brute_kneser_ney([t for _, _, t in rare])
    for i, _, text in rare:
        assert alone[i] == pytest.approx(-log_p(p, text) / (len(text) + 1), rel=1e-6)


@pytest.mark.parametrize("few", [0, 10_000])
def test_bands_equal_brute_force_and_reject_junk(spark, sf_docs, monkeypatch, few):
    """The band from all rows' log perplexities; random letters fall outside, prose stays. With few=0 nothing is broadcast."""
    from meridia.llm import textops

    monkeypatch.setattr(textops, "FEW_ROWS", few)
    rng = np.random.default_rng(8)
    junk = [(10**9 + k, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 12, 200)), "en", "x", 0) for k in range(5)]
    docs = sf_docs.unionByName(spark.createDataFrame(junk, sf_docs.schema))
    found = judge_quality(docs).collect()
    by_lang = defaultdict(list)
    for r in found:
        if not r["base_failed"]:
            by_lang[r["lang"]].append(r)
    for lang, some in by_lang.items():
        at = lambda values, q: sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]
        mid = at([r["log_ppl"] for r in some], 0.5)
        strayed = [(r["log_ppl"] - mid) * math.sqrt(r["n_words"]) for r in some]
        iqr = at(strayed, 0.75) - at(strayed, 0.25)
        for r in some:
            reach = 0.02 + 5 * iqr / math.sqrt(r["n_words"])
            assert (r["ppl_low"], r["ppl_high"]) == pytest.approx((mid - reach, mid + reach), rel=1e-9)
            assert r["kept"] == (mid - reach <= r["log_ppl"] <= mid + reach)
    assert not any(r["kept"] for r in found if r["doc_id"] >= 10**9)
    usual = [r for some in by_lang.values() for r in some if r["doc_id"] < 10**9]
    assert sum(r["kept"] for r in usual) > 0.9 * len(usual)


def test_text_stats_of_repeats():
    text = b"a b c a b c\nx\nx\n \n \n# $"
    grams = Grams.of([text])
    assert text_stats(text, grams.codes, grams.chars)[2:] == (2, 1, 6)
