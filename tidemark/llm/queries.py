"""Registered queries of the operators, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format, decontaminate, license_scan, merkle_manifest, near_dedup, quality_rules, repeats, sentence_pieces, site_classifier, token_counts, token_files, warc,
    whitening,
)
from tidemark.llm.common import shared_folder, table, written
from tidemark.llm.manifest_sql import manifest_sql

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), WORD_TOKENIZER)


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_dedup.link_components(table(spark, folder, "documents"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _stored_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return written(quality_rules.ledger(table(spark, folder, "documents")), "quality-ledger")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.decide(_stored_ledger(spark, folder))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE.mask)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed"
    )


def op3_rule_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """Both policies' ablations from one stored ledger."""
    rows = _stored_ledger(spark, folder)
    base, full = (quality_rules.ablation(rows, p).withColumn("policy", F.lit(p.version)) for p in (quality_rules.BASE, quality_rules.DEFAULT))
    return base.unionByName(full).select("policy", "rule", "n_failed", "n_only_this")


def op4_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.round_trip(table(spark, folder, "documents"), PIECE_MODEL))


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.render(table(spark, folder, "conversations"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), out, WORD_TOKENIZER, end_id=2)
    return token_files.checksums(spark, out)


def op7_site_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts are the documents' sources; a host's paths are its languages."""
    docs = table(spark, folder, "documents")
    return site_classifier.classify(docs, table(spark, folder, "labels"), docs["source"], docs["lang"])


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removals(table(spark, folder, "documents")).drop("content", "kept")


def op11_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), out)
    return warc.read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings")).drop("deviation_exact")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = merkle_manifest.manifest(table(spark, folder, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op3_rule_ablation": op3_rule_ablation,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_chat_format": op5_chat_format,
    "op6_token_files": op6_token_files,
    "op7_site_classifier": op7_site_classifier,
    "op8_decontaminate": op8_decontaminate,
    "op9_license_scan": op9_license_scan,
    "op10_repeats": op10_repeats,
    "op11_warc_segments": op11_warc_segments,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}
_ALL_WORDS = """
w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, least(5, len(ws)) AS k FROM d WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON c.a = d.doc_id""",
    "op3_quality_rules": f"""
WITH {_ALL_WORDS},
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
b AS (
  SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN len(ls) >= 5 AND 10 * (len(ls) - len(list_distinct(ls))) > 7 * len(ls) THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_upper > 6 * word_chars THEN 32 ELSE 0 END) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::INT AS failed FROM b""",
    "op5_chat_format": """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10)) OVER (PARTITION BY conv_id ORDER BY k) AS chat
  FROM t)
SELECT min(conv_id) AS conv_id, n AS n_turns, chat FROM p
WHERE k = n AND chat NOT IN (SELECT chat FROM p WHERE k < n) GROUP BY n, chat""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS l FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS i FROM b)),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM b))),
h AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id""",
}

ORACLES["op13_merkle_manifest"] = manifest_sql()

# Base32 five bits at a time: a digest has 160.
ORACLES["op11_warc_segments"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(20), lambda i: lpad(bin(('0x' || substr(sha1(t), 2 * i + 1, 2))::INT), 8, '0')), 'string_agg', '') AS bits FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda k: substr(bits, 5 * i + k + 1, 1)::INT * (16 >> k)))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""

ORACLES["op3_rule_ablation"] = f"""
WITH f AS (SELECT failed FROM ({ORACLES["op3_quality_rules"]})), p(policy, mask) AS (VALUES ('base-1', 3), ('full-1', 63)),
u(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('shouting', 32))
SELECT policy, rule, count(*) FILTER (WHERE (failed & bit) <> 0) AS n_failed, count(*) FILTER (WHERE (failed & mask) = bit) AS n_only_this
FROM f, p, u WHERE (mask & bit) <> 0 GROUP BY policy, rule"""
