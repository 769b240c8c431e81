"""The manifest against a plain tree over lists of rows."""

import hashlib
import zlib

import pytest
from llm_common import rows
from pyspark.sql import functions as F

from meridia.llm.merkle import build_manifest, manifest_report


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    def e(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    doc_id, text, lang, source, n = row
    return H(e(doc_id), e(source), e(lang), e(None if n is None else n + more), e(text))


def climb(hashes, fanout):
    """The root over hashes and, for each, the runs of siblings before and after on its way."""
    paths, nodes = [[] for _ in hashes], [(h, [k]) for k, h in enumerate(hashes)]
    while len(nodes) > 1:
        runs = [nodes[a : a + fanout] for a in range(0, len(nodes), fanout)]
        for run in runs:
            for at, (_, under) in enumerate(run):
                for k in under:
                    paths[k].append(([h for h, _ in run[:at]], [h for h, _ in run[at + 1 :]]))
        nodes = [(H(*(h for h, _ in run)), [k for _, under in run for k in under]) for run in runs]
    return nodes[0][0], paths


def expected(table, fanout):
    groups = {}
    for row in table:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {g: climb([leaf_of(r) for r in groups[g]], fanout) for g in names}
    if not names:
        return []
    root, upper = climb([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, upper):
        for row, path in zip(groups[g], trees[g][1]):
            at = leaf_of(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for before, after in path + up:
                at = H(*before, at, *after)
            proof = H(*(h for before, after in path + up for h in before + after))
            out.append((row[0], leaf_of(row), trees[g][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("fanout", [2, 3])
def test_awkward_rows(awkward, fanout):
    """Nulls in every column, a null language, single leaves, repeated rows and extra columns."""
    assert rows(manifest_report(awkward, fanout)) == expected(plain(awkward), fanout)


def test_many_rows_of_one_group(spark):
    """Most rows in one language, many alike in everything; clashing names are ignored."""
    docs = spark.range(700).select(
        F.when(F.col("id") < 650, F.col("id") % 300).alias("doc_id"),
        F.concat(F.lit("text ü "), (F.col("id") % 3).cast("string")).alias("text"),
        F.when(F.col("id") % 50 == 0, "fr").when(F.col("id") % 77 == 0, "").otherwise("en").alias("lang"),
        F.lit(None).cast("string").alias("source"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("n_chars"),
        *(F.lit(1).alias(c) for c in ("g", "o", "hash", "idx", "path", "kids")),
    )
    assert rows(manifest_report(docs.repartition(5))) == expected(plain(docs), 2)


def test_only_the_tampered_fail(sf_docs):
    out = manifest_report(sf_docs).collect()
    assert len({r.root for r in out}) == 1
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in out)


def test_any_changed_column_changes_the_root(spark, sf_docs):
    some = sf_docs.limit(9).cache()
    roots = {build_manifest(d).first().root for d in (some, some.withColumn("source", F.upper("source")), some.withColumn("text", F.concat("text", F.lit(" "))))}
    assert len(roots) == 3


def test_empty(empty):
    assert rows(manifest_report(empty)) == []
