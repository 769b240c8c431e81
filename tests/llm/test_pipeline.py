import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm_common import SF, rows
from pyspark.sql import functions as F

from meridia.llm.mixing import mix_sources
from meridia.llm.quality_gam import feature_matrix, fit_quality
from meridia.llm.registry import tokenizer_path

SPACED, PLAIN = "[^\x20\x09-\x0D]+", "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_quality(spark, docs):
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = docs.collect()
    scores = model.score(feature_matrix([(r["text"] or "").encode() for r in kept]))
    return [r for r, s in zip(kept, scores) if s >= 0.3]


def brute_groups(kept):
    """One row of each group: the one with the smallest id; texts without words all stay."""
    shingles = []
    for r in kept:
        words = re.findall(SPACED, lower(r["text"]))
        shingles.append({tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    holders, root = defaultdict(list), list(range(len(kept)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(shingles):
        met = Counter(j for g in s for j in holders[g])
        for j, common in met.items():
            if 100 * common >= 80 * (len(s) + len(shingles[j]) - common):
                root[max(find(k), find(j))] = min(find(k), find(j))
        for g in s:
            holders[g].append(k)
    groups = defaultdict(list)
    for k, s in enumerate(shingles):
        groups[find(k) if s else -1 - k].append(k)
    return [min((kept[k] for k in g), key=lambda r: r["doc_id"]) for g in groups.values()]


def brute_clean(kept, bench):
    windows = set()
    for r in bench:
        words = re.findall(PLAIN, lower(r["text"]))
        windows |= {tuple(words[k : k + min(10, len(words))]) for k in range(len(words) - min(10, len(words)) + 1)} if words else set()
    sizes = {len(w) for w in windows}
    words = lambda r: re.findall(PLAIN, lower(r["text"]))
    return [r for r in kept if not any(tuple(w[k : k + n]) in windows for w in [words(r)] for n in sizes for k in range(len(w) - n + 1))]


def test_stages_equal_brute_force(spark):
    """Each stage on what brute force leaves of the one before; the mix by its own counts of copies."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [lambda _: brute_quality(spark, docs), brute_groups, lambda kept: brute_clean(kept, spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    kept, seen = None, docs
    for (name, stage), brute in zip(corpus_pipeline.STAGES, steps):
        kept = brute(kept)
        got = stage(spark, seen, SF)
        assert got.columns == docs.columns and rows(got) == sorted((tuple(r) for r in kept), key=repr), name
        assert 0 < len(kept) < seen.count(), name
        seen = spark.createDataFrame(kept, docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(seen).collect()}
    mixed = corpus_pipeline.mix(spark, seen, SF)
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(copies) and mixed.columns == docs.columns
    t, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(mixed.collect(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows(corpus_pipeline.tokens(spark, mixed, SF), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda x: x[1]) == want
    out = corpus_pipeline.run(spark, SF)
    assert sorted(rows(out, "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda x: x[1]) == want
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def clashing(docs):
    """docs with more columns whose names the stages use inside."""
    for name in ("_mix", "_mix_doc_id", "_mix_nth", "_doc", "_tk", "_c", "_t", "_spans", "_id", "_salt", "h", "words", "n", "size", "copies"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


@pytest.mark.parametrize("number", range(5))
def test_stages_take_awkward_rows_and_empty_tables(spark, awkward, empty, number):
    name, stage = corpus_pipeline.STAGES[number]
    for docs in (awkward, clashing(awkward)):
        out = stage(spark, docs, SF)
        had = Counter(tuple(r) for r in docs.collect())
        if number < 4:
            assert out.columns == docs.columns, name
            got = Counter(tuple(r) for r in out.collect())
            assert set(got) <= set(had) and (number == 3 or got <= had), name
        else:
            assert out.count() == docs.count()
    assert stage(spark, empty, SF).collect() == []
