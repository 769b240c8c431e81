import hashlib
import re
from collections import defaultdict

import pytest
from llm_common import rows

from meridia.llm.line_dedup import LineRuns, dedup_lines
from meridia.llm.substring_dedup import dedup_substrings
from meridia.llm.textops import Scratch

SPACE = " \t\n\x0b\x0c\r"
LAST = 1 << 70


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_lines(docs):
    held = defaultdict(set)
    rank = lambda i: -1 if i is None else i
    for i, text in docs:
        for line in (text or "").split("\n"):
            held[lower(line.strip(SPACE))].add(rank(i))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := lower(x.strip(SPACE))) >= 40 and len(held[k]) >= 5 and rank(i) < max(held[k]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["awkward", "sf_docs"])
@pytest.mark.parametrize("batches", [1, 5])
def test_lines_equal_brute_force(which, batches, request):
    docs = request.getfixturevalue(which)
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(dedup_lines(docs, batches=batches)) == want
    if which == "awkward":
        assert sum(x[2] for x in want) > 0


def test_lines_empty_table(empty):
    assert dedup_lines(empty).collect() == []


def test_runs_settle_and_compact(spark):
    runs = LineRuns(Scratch(spark, "runs"), min_docs=3, fanout=2)
    for docs in ([9, 8], [7, 6], [5, 4], [3]):
        runs.add(spark.createDataFrame([(d, 1, 1) for d in docs] + [(docs[0], 2, docs[0])], "doc long, h1 long, h2 long"))
    assert len(runs.settled) >= 1
    assert rows(runs.repeated(), "h1", "h2", "top") == [(1, 1, 9)]


def brute_windows(docs, size):
    first = {}
    texts = [(LAST if i is None else i, re.findall("[^\x20\x09-\x0D]+", t or ""), i) for i, t in docs]
    for key, words, _ in texts:
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            first[w] = min(first.get(w, (LAST + 1, 0)), (key, k))
    out = []
    for key, words, i in texts:
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (key, k):
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["awkward", "sf_docs"])
@pytest.mark.parametrize("window", [20, 7])
def test_windows_equal_brute_force(which, window, request):
    docs = request.getfixturevalue(which)
    want = brute_windows([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    assert rows(dedup_substrings(docs, window=window, bucket_bytes=20_000)) == want
    assert sum(x[2] for x in want) > 0


@pytest.mark.parametrize("most", [2_000, 60_000, 48 << 20])
def test_a_phrase_in_ever_different_surroundings(spark, most):
    """One five-word phrase in 3000 texts, in a third of them the whole passage: hot buckets are dealt out again, results stay exact."""
    texts = []
    for k in range(3000):
        own = [f"q{(k * 7919 + j * 104729) % 1_000_003}" for j in range(24)]
        passage = ["aa", "bb", "cc", "dd", "ee"] if k % 3 else [f"p{j}" for j in range(10)] + ["aa", "bb", "cc", "dd", "ee"] + [f"s{j}" for j in range(10)]
        texts.append((k if k % 50 else None, " ".join(own[:12] + passage + own[12:])))
    docs = spark.createDataFrame(texts + texts[:3], "doc_id long, text string")
    want = brute_windows(texts + texts[:3], 20)
    got = rows(dedup_substrings(docs, bucket_bytes=60_000, most_bytes=most))
    assert [x for x in got if x[0] is not None] == [x for x in want if x[0] is not None] and len(got) == len(want)


def test_word_hashes_agree_whatever_the_length():
    from meridia.llm.substring_dedup import Powers, word_hashes

    words = [f"w{k % 977}é" for k in range(30_000)]
    whole = word_hashes(" ".join(words).encode())
    assert len(" ".join(words).encode()) > Powers.most
    assert whole[:977].tolist() == word_hashes(" ".join(words[:977]).encode()).tolist() and len(set(whole.tolist())) == 977


def test_windows_empty_table(empty):
    assert dedup_substrings(empty).collect() == []


def test_repeated_windows_survive_equal_hashes(monkeypatch):
    import numpy as np

    from meridia.llm import substring_dedup as module

    words = [bytes([97 + k]) * (1 + k) for k in np.random.default_rng(5).integers(0, 3, 400)]
    line = b" ".join(words)
    begin, end = module.word_edges(line)
    assert [line[a:b] for a, b in zip(begin, end)] == words
    hashes = module.word_hashes(line)
    assert len(set(hashes.tolist())) == 3 and len({(w, h) for w, h in zip(words, hashes.tolist())}) == 3
    at = np.concatenate([np.arange(0, 190), np.arange(200, 390)])
    doc, start = np.where(at < 200, 7, 3), at % 200
    first, want = {}, []
    for k in np.lexsort((start, doc)):
        w, place = tuple(words[at[k] : at[k] + 5]), (doc[k], start[k])
        want.append((k, first.setdefault(w, place) != place))
    want = [x for _, x in sorted(want)]
    assert module.repeated_windows(line, at, 5, doc, start).tolist() == want
    monkeypatch.setattr(module, "mixed", lambda h: h * np.uint64(0))
    assert module.repeated_windows(line, at, 5, doc, start).tolist() == want


def test_dropped_lines_are_not_broadcast(spark):
    """They grow with the texts: the last join has the same plan at any size."""
    line = "a line that is long enough to be counted as one of them"
    docs = spark.createDataFrame([(k, f"{line}\n{k}") for k in range(8)], "doc_id long, text string")
    out = dedup_lines(docs)
    assert sorted((r.doc_id, r.n_dropped) for r in out.collect()) == [(k, int(k < 7)) for k in range(8)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
