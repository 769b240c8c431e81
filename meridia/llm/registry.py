"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm.decontaminate import contamination_report
from meridia.llm.kn_rules import judge_quality
from meridia.llm.license_scan import scan_licenses
from meridia.llm.line_dedup import dedup_lines
from meridia.llm.merkle import manifest_report
from meridia.llm.mixing import mix_sources
from meridia.llm.ngram_join import similarity_components
from meridia.llm.pitman_yor import score_texts
from meridia.llm.prefix_trie import prefix_trie
from meridia.llm.quality_gam import fit_quality, score_quality
from meridia.llm.secret_scan import scan_secrets
from meridia.llm.substring_dedup import dedup_substrings
from meridia.llm.textops import table
from meridia.llm.token_output import token_report

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_output": op8_token_output,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_pitman_yor": op12_pitman_yor,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Unsigned CRC-32 of the decimal string s.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

ORACLES: dict[str, str] = {
    "op3_decontamination": r"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
hits AS (SELECT doc_id, i, g.size, item FROM windows v JOIN grams g ON v.size = g.size AND v.s = g.s),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.top, false) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op9_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 19)) AS k, list_slice(w, i, i + 19) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM repeated),
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
judged AS (
  SELECT s.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         string_agg(s.word, ' ' ORDER BY s.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM words s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN judged j USING (doc_id)
""",
    "op11_prefix_trie": rf"""
WITH turns AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || ':' || length(coalesce(text, '')) AS sym,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
  FROM conversations),
convs AS (SELECT conv_id, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, k, sym FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE k <= h
  UNION ALL
  SELECT c.conv_id, 1, k, sym FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE k > h),
seqs AS (
  SELECT c.conv_id, coalesce(list(sym ORDER BY part, k) FILTER (WHERE sym IS NOT NULL), CAST([] AS VARCHAR[])) AS p
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, len(p) AS n, d, list_slice(p, 1, d) AS p FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE CAST(split_part(p[d], ':', 2) AS BIGINT) END AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.p = n.p),
sums AS (
  SELECT list_slice(p, 1, a) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM told) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM told n JOIN sums s ON s.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = list_slice(n.p, 1, n.depth - 1)
""",
    "op13_merkle_manifest": rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce('=' || lang, '-') AS g,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
         coalesce({_CRC32} % 7 = 0, false) AS tampered
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
hashed AS (
  SELECT rid, doc_id, lang, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other, tampered
  FROM docs),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
nodes AS (
  SELECT g, 0 AS l, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT g, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, l, i // 2, n),
subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM nodes JOIN (SELECT DISTINCT g, lang FROM leaves) USING (g) WHERE nodes.n = 1),
tops AS (
  SELECT 0 AS l, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY l, i // 2, n),
steps AS (
  SELECT x.rid, o.l AS s, (x.i >> o.l) & 1 AS bit, coalesce(b.h, '') AS sibling
  FROM leaves x JOIN (SELECT DISTINCT g, l FROM nodes WHERE n > 1) o ON x.g = o.g
  LEFT JOIN nodes b ON b.g = x.g AND b.l = o.l AND b.i = xor(x.i >> o.l, 1)
  UNION ALL
  SELECT x.rid, o.l + 1000, (r.i >> o.l) & 1, coalesce(b.h, '')
  FROM leaves x JOIN subroots r ON x.g = r.g JOIN (SELECT DISTINCT l FROM tops WHERE n > 1) o ON true
  LEFT JOIN tops b ON b.l = o.l AND b.i = xor(r.i >> o.l, 1)),
numbered AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY s) AS s, bit, sibling FROM steps),
folds AS (
  SELECT rid, 1 AS s, CASE WHEN tampered THEN other ELSE leaf END AS h FROM leaves
  UNION ALL
  SELECT f.rid, f.s + 1, sha256(CASE WHEN bit = 1 THEN sibling || h ELSE h || sibling END) FROM folds f JOIN numbered USING (rid, s)),
folded AS (SELECT rid, arg_max(h, s) AS folded_root FROM folds GROUP BY rid),
proofs AS (SELECT rid, string_agg(sibling, '' ORDER BY s) AS proof FROM numbered GROUP BY rid)
SELECT x.doc_id, x.leaf, r.subroot, t.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM leaves x JOIN subroots r ON x.g = r.g JOIN tops t ON t.n = 1 JOIN folded f ON f.rid = x.rid LEFT JOIN proofs p ON p.rid = x.rid
""",
}
