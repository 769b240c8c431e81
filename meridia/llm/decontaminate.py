"""Benchmark decontamination with DataFrame functions only.

The benchmark's distinct windows, keyed by hash, are broadcast as a hash set when their number is
within ``broadcast_windows``. Every window of every document probes the set; a hit is verified on its
words. Hits and one marker row for each document are grouped by document, so the texts are read once
and only markers and hits are shuffled. A larger benchmark is shuffled by hash with the documents'
window hashes, without their words; what meets is grouped by document and verified on its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.textops import PLAIN_WORD, Scratch, lower_ascii, text_key, whole_text

ANY_CASE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def plain_words(text: str = "text") -> Column:
    """The words of a text, A-Z lower-cased. lower() does just that where every character is ASCII."""
    body = whole_text(text)
    folded = F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(lower_ascii(body))
    return F.regexp_extract_all(folded, F.lit(PLAIN_WORD), F.lit(0))


def _window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(length)))


def _windows(words: Column, length: int, body) -> Column:
    """body(start, hash) for each start of a window of so many words."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: body(i, _window_hash(words, i, length)))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(h, len, gram, items): the distinct windows of all items and the items that hold each.

    An item of fewer words than the window, but not none, is one window. A null item_id counts as the empty string.
    """
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), plain_words().alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice(F.col("words"), i, n))
    rows = items.select("item", F.explode(grams).alias("gram")).groupBy("gram").agg(F.collect_set("item").alias("items"))
    hashed = F.lit(None).cast("long")
    for length in range(1, window + 1):
        hashed = F.when(F.size("gram") == length, _window_hash(F.col("gram"), F.lit(0), length)).otherwise(hashed)
    return rows.select(hashed.alias("h"), F.size("gram").alias("len"), "gram", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_windows: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, tk, n_words, spans (start, end: merged, by start), items.

    A null or empty text has no words and no hits. Rows alike in doc_id and text are one document,
    returned as often as it came; an empty benchmark hits nothing. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    known = scratch.keep(benchmark_windows(benchmark, window), "windows")
    counts = {r["len"]: r["count"] for r in known.groupBy("len").count().collect()}  # a row for each length up to the window
    grouped = (_probed if sum(counts.values()) <= broadcast_windows else _shuffled)(docs, known, sorted(counts))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def grow(spans: Column, hit: Column) -> Column:
        last = F.element_at(spans, -1)
        joined = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], hit["end"]).alias("end"))))
        return F.when((F.size(spans) == 0), F.array(hit)).otherwise(F.when(hit["start"] > last["end"], F.concat(spans, F.array(hit))).otherwise(joined))

    # an element for the empty list keeps element_at from failing before any span is there
    merged = F.when(F.size("hits") == 0, empty).otherwise(F.aggregate(F.slice("hits", 2, F.greatest(F.size("hits") - 1, F.lit(0))), F.slice("hits", 1, 1), grow))
    out = grouped.withColumn("spans", merged).select("doc_id", "tk", F.col("n_words").cast("long").alias("n_words"), "spans", "items", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"))
    return out.drop("_copy")


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("tk"), plain_words().alias("words"))


def _probes(lengths: list[int]) -> list[Column]:
    return [_windows(F.col("words"), length, lambda i, h, length=length: F.struct(i.alias("at"), F.lit(length).alias("size"), h.alias("hash"))) for length in lengths]


def _hit() -> Column:
    return F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))


def _items(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(items)))


def _probed(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, tk, n_words, rows, hits, items of each document: the known windows go to every task."""
    marker = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("hash")))
    rows = _tokens(docs).select("doc_id", "tk", "words", F.explode(F.concat(marker, *_probes(lengths))).alias("w"))
    rows = rows.select("doc_id", "tk", "words", F.when(F.col("w.at") < 0, F.size("words")).alias("n"), "w.at", "w.size", "w.hash")
    met = rows.join(F.broadcast(known), (rows["hash"] == known["h"]) & (rows["size"] == known["len"]), "left")
    mine = F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest(F.col("size"), F.lit(1)))
    met = met.filter((F.col("at") < 0) | (F.col("gram").isNotNull() & (mine == F.col("gram"))))
    by_doc = met.select("doc_id", "tk", "n", F.when(F.col("at") >= 0, _hit()).alias("hit"), "items")
    return by_doc.groupBy("doc_id", "tk").agg(F.max("n").alias("n_words"), F.count("n").alias("rows"), F.array_sort(F.collect_set("hit")).alias("hits"), _items(F.collect_list("items")).alias("items"))


def _shuffled(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """The same with both sides shuffled by hash; a window's words are looked up only where its hash is known."""
    rows = _tokens(docs).select("doc_id", "tk", F.explode(F.concat(*_probes(lengths))).alias("w")).select("doc_id", "tk", "w.at", "w.size", "w.hash")
    met = rows.join(known.hint("merge"), (rows["hash"] == known["h"]) & (rows["size"] == known["len"]))
    found = met.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("at", "size", "gram", "items")).alias("found"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t"), "found")
    tokens = _tokens(docs)
    both = tokens.join(found.hint("merge"), tokens["doc_id"].eqNullSafe(F.col("_d")) & tokens["tk"].eqNullSafe(F.col("_t")), "left")
    real = F.coalesce(F.filter("found", lambda x: F.slice(F.col("words"), x["at"] + 1, x["size"]) == x["gram"]), F.array().cast(met.select(F.array(F.struct("at", "size", "gram", "items")).alias("f")).schema["f"].dataType))
    hits = F.array_sort(F.array_distinct(F.transform("real", lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["size"]).alias("end")))))
    both = both.withColumn("real", real)
    return both.select("doc_id", "tk", F.size("words").alias("n_words"), F.lit(1).alias("rows"), hits.alias("hits"), _items(F.transform("real", lambda x: x["items"])).alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    found = find_contamination(docs, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "documents") -> DataFrame:
    """docs, with all their columns, without contaminated documents or without the hit spans.

    remove="documents" drops rows with any hit. remove="spans" cuts hit words, with what stands
    between them and the next word, from the text and leaves other rows as they are. A null or empty
    text is never hit; rows alike in doc_id and text share their fate; an empty table or benchmark gives
    docs as they are; other columns stay, whatever their names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is {remove!r}, not documents or spans")
    bad = find_contamination(docs.select("doc_id", "text"), benchmark, window).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_doc"), F.col("tk").alias("_tk"), F.col("spans").alias("_spans")).dropDuplicates(["_doc", "_tk"])
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_doc"]) & (text_key() == bad["_tk"])
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    met = docs.join(bad, same, "left")
    # words and what is between them alternate, so that piece p is word p div 2 where it is a word
    parts = F.regexp_extract_all(docs["text"], F.lit(f"{ANY_CASE_WORD}|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    lead = F.when(F.regexp_like(F.get(parts, F.lit(0)), F.lit(f"^{ANY_CASE_WORD}")), 0).otherwise(1)
    kept = F.filter(parts, lambda x, p: (p < lead) | ~F.exists(bad["_spans"], lambda s: (F.floor((p - lead) / 2) >= s["start"]) & (F.floor((p - lead) / 2) < s["end"])))
    cut = F.when(bad["_spans"].isNull(), docs["text"]).otherwise(F.concat_ws("", kept))
    return met.select(*(cut.alias(c) if c == "text" else docs[c] for c in docs.columns))
