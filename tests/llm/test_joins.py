import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_common import SF, rows
from pyspark.sql import functions as F

from meridia.llm.decontaminate import contamination_report, decontaminate, find_contamination
from meridia.llm.ngram_join import SetJoin, bitmap, common_grams, connected, keep_one, least_common, may_link, ordered, prefix_length, similar, similarity_components, trie_links
from meridia.llm.textops import Scratch


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_hits(docs, items, size=10):
    grams = defaultdict(set)
    for item, text in items:
        w = plain(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, named = plain(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    named |= grams[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"shared{k}" for k in range(20, 34)), "z"), (2, "Façade NAÏVE", "z"), (10, "own", "z"), (3, None, "z"), (4, "...", "z"), (None, "word word word", "z"), (1, " ".join(f"Shared{k}" for k in range(5, 15)), "z")], "item_id long, text string, words string")


@pytest.mark.parametrize("limit", [0, 100_000])
def test_report_equals_brute_force(awkward, items, limit):
    from meridia.llm import decontaminate as module

    want = brute_hits([(r["doc_id"], r["text"]) for r in awkward.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    found = module.find_contamination(awkward, items, broadcast_windows=limit)
    assert sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) for r in found.filter("doc_id is not null").collect()) == sorted(x[:4] for x in want if x[0] is not None)
    if limit:
        assert rows(contamination_report(awkward, items)) == want and sum(x[2] for x in want) > 0


def test_shuffled_windows_carry_no_words(spark, items):
    """Rows of the join by hash hold numbers only; a text of 20 000 words is hit where it should be."""
    long_text = " ".join(f"w{j * 7919 % 19997}" for j in range(20_000)) + " " + " ".join(f"shared{k}" for k in range(20, 32))
    docs = spark.createDataFrame([(k, long_text) for k in range(2)], "doc_id long, text string")
    found = find_contamination(docs, items, broadcast_windows=0)
    assert [(r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in found.collect()] == [(20_012, [(20_000, 20_012)], ["1"])] * 2
    nodes, sides = [found._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Join" and "hash" in node.left().output().toString():
            sides.append(node.left().output().toString())
    assert sides and not any("words" in x or "text" in x for x in sides)


def test_report_on_data(spark, sf_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_hits([(r["doc_id"], r["text"]) for r in sf_docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert rows(contamination_report(sf_docs, bench)) == want


def test_report_of_empty_tables(awkward, empty, items):
    assert contamination_report(empty, items).collect() == []
    none = contamination_report(awkward, items.limit(0)).collect()
    assert len(none) == awkward.count() and not any(r["contaminated"] for r in none)


def test_removal_of_documents_and_spans(awkward, items):
    hit = {r["doc_id"] for r in contamination_report(awkward, items).collect() if r["contaminated"]}
    kept = decontaminate(awkward, items)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(r["doc_id"] for r in awkward.collect() if r["doc_id"] is not None and r["doc_id"] not in hit)
    cut = decontaminate(awkward, items, remove="spans")
    assert cut.columns == awkward.columns and cut.count() == awkward.count()
    before = {(r["doc_id"], r["source"]): r["text"] for r in awkward.collect()}
    report = {r["doc_id"]: r for r in contamination_report(awkward, items).filter("doc_id is not null").collect()}
    for r in cut.filter("doc_id is not null").collect():
        old = before[r["doc_id"], r["source"]]
        if not report[r["doc_id"]]["contaminated"]:
            assert r["text"] == old
        else:
            assert len(plain(r["text"])) == report[r["doc_id"]]["n_words"] - report[r["doc_id"]]["n_hit"]
    with pytest.raises(ValueError):
        decontaminate(awkward, items, remove="lines")


# ---- joins


def shingles(text, width):
    w = re.findall("[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(docs, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("which,width,num", [("awkward", 4, 85), ("awkward", 5, 80), ("awkward", 2, 30), ("sf_docs", 4, 85), ("sf_docs", 2, 20)])
def test_components_equal_brute_force(which, width, num, request):
    docs = request.getfixturevalue(which)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], width, num, 100)
    assert rows(similarity_components(docs, width, num, 100), "doc_id", "n_shingles", "component_id") == want


def test_links_across_components_are_found(spark):
    """A chain whose ends differ, a passage that many dissimilar texts share, and near copies of both."""
    texts = []
    base = [f"c{k}" for k in range(60)]
    for step in range(8):
        texts.append(" ".join([*base[step * 2 :], *(f"d{k}" for k in range(step * 2))]))
    passage = " ".join(f"p{k}" for k in range(30))
    for k in range(12):
        own = " ".join(f"o{k}x{j}" for j in range(25))
        texts += [f"{own} {passage}", f"{own} {passage} tail{k}"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for num, common_from in ((60, 64), (80, 64), (60, 3), (80, 3)):
        assert rows(similarity_components(docs, 3, num, 100, common_from), "doc_id", "n_shingles", "component_id") == brute_components(list(enumerate(texts)), 3, num, 100)
    join = SetJoin(docs, 3, 60, 100, Scratch(spark, "blocks"), broadcast_rows=0, block=3)
    assert join.components().select("comp").distinct().count() == len({c for i, n, c in brute_components(list(enumerate(texts)), 3, 60, 100) if [x[2] for x in brute_components(list(enumerate(texts)), 3, 60, 100)].count(c) > 1})


def test_common_grams_come_last_and_are_bounded(spark):
    early = spark.createDataFrame([([5, -3, 8],), ([5, -3],), ([5, 8],), ([5],), (None,)], "prefix array<long>")
    keys, levels = common_grams(early, Scratch(spark, "common"), 2)
    assert keys.view(np.int64).tolist() == [5, 8, -3] and levels.tolist() == [3, 2, 2]
    s = np.unique(np.array([-3, 1, 5, 8, 9], np.int64).view(np.uint64))
    assert ordered(s, (keys, levels)).view(np.int64).tolist() == [1, 9, 8, -3, 5] and ordered(s, None) is s
    assert common_grams(early, Scratch(spark, "common"), 2, most=2)[0].tolist() == [5]
    assert len(common_grams(early, Scratch(spark, "common"), 9)[0]) == 0


def test_join_of_empty_table(empty):
    assert similarity_components(empty).collect() == [] and keep_one(empty).collect() == []


def test_one_of_each_component_stays(awkward):
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    want = brute_components([(r["doc_id"], r["text"]) for r in awkward.collect()], 5, 80, 100)
    ids = sorted({c for i, n, c in want if n and c is not None})
    assert sorted(r["doc_id"] for r in kept.filter("text is not null and length(trim(text)) > 5 and doc_id is not null").collect()) == ids
    assert kept.filter("doc_id in (3, 4, 5)").count() == 3


def test_trie_equals_sets():
    rng = np.random.default_rng(3)
    hub = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([hub[rng.random(len(hub)) < q], rng.integers(0, 400, 8).astype(np.uint64)])) for q in rng.random(80)]
    for num in (10, 50, 85):
        want = [similar(len(np.intersect1d(hub, s)), len(hub), len(s), num, 100) for s in sets]
        assert trie_links(hub, sets, num, 100) == want
    for s in sets:
        common = len(np.intersect1d(hub, s))
        for num in (10, 50, 85):
            assert may_link(bitmap(hub), bitmap(s), len(hub), len(s), num, 100) or not similar(common, len(hub), len(s), num, 100)
    big = np.unique(rng.integers(0, 1 << 60, 3000).astype(np.uint64))
    assert may_link(bitmap(big), bitmap(big[100:]), 3000, 2900, 85, 100) and len(bitmap(big)) > len(bitmap(big[2000:]))
    assert not may_link(bitmap(big), bitmap(np.unique(rng.integers(0, 1 << 60, 2900).astype(np.uint64))), 3000, 2900, 85, 100)
    assert least_common(100, 100, 85, 100) == 92 and prefix_length(100, 85, 100) == 16


def test_connected_labels_are_least(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 60)] + [(3, 5), (5, 9), (2, 2)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected(edges, Scratch(spark, "cc"), "t").collect()}
    assert all(got[k] == 10 for k in range(10, 61)) and got[9] == got[3] == 3 and got[2] == 2
