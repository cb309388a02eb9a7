"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalforge.llm import bpe, chat, fingerprint, huffman, packing, periods, quality, ranked, setjoin, sharding, suffix, toxicity, warc
from signalforge.llm.common import documents
from signalforge.session import ship


#: The vocabulary of byte_bpe_50k.json as ranks; both give the same ids, but for the JSON file's added tokens.
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    added = packing.added_tokens(public_tokenizers.path(TOKENIZER))
    return packing.pack_documents(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, added)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text", "lang")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = warc.derivatives(warc.responses(pages))
    return rows.withColumn("record_sha256", F.sha2("record", 256)).drop("record", "block")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    return bpe.encode_documents(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.classify(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).drop("kept_text")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.link(documents(spark, sf_dir))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.prefix_examples(held.unionByName(probe)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.detect(documents(spark, sf_dir).select("doc_id", "text"), periods.planted))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.through_files(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(WORD_TOKENIZER))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked.search(documents(spark, sf_dir).select("doc_id", "text"), items)


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), f AS (
  SELECT rid, doc_id, lang, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    length(t) AS n,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS c0,
    length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS c1,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS c2,
    length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) AS c3,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS c4,
    length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) AS c5,
    length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters
  FROM d
), g AS (
  SELECT *, letters - c0 - c2 AS c6, n - letters - c1 - c3 - c4 - c5 AS c7, len(ws) AS nw FROM f
), win AS (
  SELECT rid, i, list_slice(ws, i, i + {quality.WINDOW - 1}) AS k
  FROM g, unnest(range(1, nw - {quality.WINDOW - 2})) AS u(i)
), dup AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS rep FROM dup, range({quality.WINDOW}) AS r(j) GROUP BY rid
), top AS (
  SELECT DISTINCT lang FROM g WHERE lang IS NOT NULL
), h AS (
  SELECT g.*, coalesce(top.lang, '') AS ref FROM g LEFT JOIN top ON g.lang = top.lang
), kinds AS (
  SELECT rid, ref, lang, k, c FROM h, unnest([c0, c1, c2, c3, c4, c5, c6, c7]) WITH ORDINALITY AS u(c, k)
), kind_ref AS (
  SELECT lang AS ref, k, sum(c) AS c FROM kinds WHERE lang IN (SELECT lang FROM top) GROUP BY lang, k
  UNION ALL SELECT '' AS ref, k, sum(c) FROM kinds GROUP BY k
), kind_q AS (
  SELECT ref, k, c / greatest(1, sum(c) OVER (PARTITION BY ref)) AS q FROM kind_ref
), kind_p AS (
  SELECT rid, ref, k, c / greatest(1, sum(c) OVER (PARTITION BY rid)) AS p FROM kinds
), kind_d AS (
  SELECT rid, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS char_distance
  FROM kind_p JOIN kind_q USING (ref, k) GROUP BY rid
), said AS (
  SELECT rid, ref, lang, w FROM h, unnest(ws) AS u(w)
), per_doc AS (
  SELECT rid, ref, w, count(*) AS c FROM said
  WHERE regexp_matches(w, '^\p{{L}}') GROUP BY rid, ref, w
), per_ref AS (
  SELECT g.lang AS ref, w, sum(c) AS c FROM per_doc JOIN g USING (rid)
    WHERE g.lang IN (SELECT lang FROM top) GROUP BY g.lang, w
  UNION ALL SELECT '' AS ref, w, sum(c) FROM per_doc GROUP BY w
), common AS (
  SELECT ref, w, c FROM per_ref
  QUALIFY row_number() OVER (PARTITION BY ref ORDER BY c DESC, w) <= {quality.COMMON}
), totals AS (
  SELECT lang AS ref, sum(nw) AS total FROM g WHERE lang IN (SELECT lang FROM top) GROUP BY lang
  UNION ALL SELECT '' AS ref, sum(nw) FROM g
), word_q AS (
  SELECT ref, w, c / total AS q FROM common JOIN totals USING (ref)
), word_t AS (
  SELECT h.rid, h.ref, h.nw, word_q.w, word_q.q, coalesce(per_doc.c, 0) / greatest(1, h.nw) AS p
  FROM h JOIN word_q ON h.ref = word_q.ref LEFT JOIN per_doc ON per_doc.rid = h.rid AND per_doc.w = word_q.w
), word_all AS (
  SELECT rid, p, q FROM word_t
  UNION ALL SELECT rid, 1 - sum(p), 1 - sum(q) FROM word_t GROUP BY rid
), word_d AS (
  SELECT rid, sqrt(greatest(0, sum(
    CASE WHEN p > 1e-12 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 1e-12 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS word_distance
  FROM word_all GROUP BY rid
), r AS (
  SELECT h.doc_id, CAST(nw AS BIGINT) AS n_words, CAST(n - c1 AS BIGINT) AS word_chars,
    CAST(c4 AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words,
    coalesce(char_distance, 0) AS cd, coalesce(word_distance, 0) AS wd
  FROM h LEFT JOIN cov USING (rid) LEFT JOIN kind_d USING (rid) LEFT JOIN word_d USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.REPEATED_PERCENT} * n_words)
  AND NOT (word_chars >= {quality.LEAST_CHARS} AND cd > {quality.CHAR_DISTANCE})
  AND NOT (n_words >= {quality.LEAST_WORDS} AND wd > {quality.WORD_DISTANCE}) AS kept
FROM r
"""

def _sql_text(html: str) -> str:
    for pattern, to in warc.TEXT_STEPS:
        quoted = pattern.replace("'", "''")
        to = {"\n": "chr(10)", "'": "chr(39)"}.get(to, f"'{to}'")
        html = f"regexp_replace({html}, '{quoted}', {to}, 'g')"
    return f"trim({html}, ' ' || chr(10))"


def _sql_id(*parts: str) -> str:
    h = f"md5(concat_ws(chr(31), {', '.join(parts)}))"
    cuts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"


_CRLF = "chr(13) || chr(10)"
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), r AS (
  SELECT *, 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF}
      || 'Content-Length: ' || strlen(payload) || {_CRLF} || {_CRLF} AS http_headers,
    {_sql_id("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "target_uri", "sha256(payload)")} AS refers_to,
    'sha256:' || sha256(payload) AS source_payload_digest,
    {_sql_text("payload")} AS text,
    trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g')) AS title,
    translate(regexp_extract(payload, '(?i)<html[^>]*\\blang="([^"]*)"', 1), {_CRLF}, '  ') AS lang,
    len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href=')) AS links
  FROM p
), s AS (
  SELECT *, 'sha256:' || sha256(http_headers || payload) AS source_block_digest,
    {_sql_id("'conversion'", "refers_to", "sha256(text)")} AS conversion_id,
    {_sql_id("'metadata'", "refers_to", "sha256(text)")} AS metadata_id
  FROM r
), m AS (
  SELECT *, 'metadata' AS warc_type, metadata_id AS record_id, conversion_id AS concurrent_to,
    'application/warc-fields' AS content_type,
    'source-headers: ' || replace(trim(http_headers, {_CRLF}), {_CRLF}, ' | ') || {_CRLF}
      || 'source-payload-digest: ' || source_payload_digest || {_CRLF}
      || 'source-block-digest: ' || source_block_digest || {_CRLF}
      || 'conversion: ' || conversion_id || {_CRLF} || 'title: ' || title || {_CRLF}
      || 'language: ' || lang || {_CRLF} || 'outlinks: ' || links || {_CRLF}
      || 'text-chars: ' || length(text) || {_CRLF} AS block
  FROM s
  UNION ALL
  SELECT *, 'conversion', conversion_id, metadata_id, 'text/plain; charset=utf-8', text FROM s
), b AS (
  SELECT *, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length,
    '{warc.DATE}' AS date
  FROM m
)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, date, content_type,
  source_payload_digest, source_block_digest, block_digest, content_length,
  sha256('WARC/1.1' || {_CRLF} || 'WARC-Type: ' || warc_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF}
    || 'WARC-Refers-To: ' || refers_to || {_CRLF} || 'WARC-Concurrent-To: ' || concurrent_to || {_CRLF}
    || 'WARC-Target-URI: ' || translate(target_uri, {_CRLF}, '  ') || {_CRLF} || 'WARC-Date: ' || date || {_CRLF}
    || 'WARC-Source-Payload-Digest: ' || source_payload_digest || {_CRLF}
    || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || 'Content-Type: ' || content_type || {_CRLF}
    || 'Content-Length: ' || content_length || {_CRLF} || {_CRLF} || block || {_CRLF} || {_CRLF}) AS record_sha256
FROM b
"""

OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, role || chr(10) || text || chr(10) AS said,
    row_number() OVER w AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    -- 13 code points are the template's own; each backslash and each control string adds one
    13 + length(role) + length(text)
      + length(role || chr(0) || text) - length(replace(role || chr(0) || text, chr(92), ''))
      + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '<|', ''))) // 2
      + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '|>', ''))) // 2
      + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '[INST]', ''))) // 6
      + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '[/INST]', ''))) // 7
      + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '<s>', ''))) // 3
      + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '</s>', ''))) // 4 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s
)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(said, '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
OP13_SQL = f"""
WITH w AS (
  SELECT rid, doc_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), t AS (
  SELECT rid, doc_id, term, count(*) AS tf FROM w GROUP BY rid, doc_id, term
), d AS (
  SELECT rid, sum(tf) AS n FROM t GROUP BY rid
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM benchmark
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s
), m AS (
  SELECT rid, CAST(100 - {ranked.SHARE} + ({ranked.SHARE} * n * docs) // terms AS BIGINT) AS length FROM d, s
), r AS (
  SELECT item_id, rid, doc_id, CAST(sum(weight * (({ranked.SCALE} * tf) // ({ranked.PER_TERM} * tf + {ranked.PER_LENGTH} * length))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {ranked.BEST}
"""


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_sharding": op2_sharding,
        "op3_quality_rules": op3_quality_rules,
        "op4_warc_derivatives": op4_warc_derivatives,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_order_minhash": op7_order_minhash,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_token_files": op12_token_files,
        "op13_ranked_search": op13_ranked_search,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op4_warc_derivatives": OP4_SQL, "op10_chat_formatting": OP10_SQL, "op13_ranked_search": OP13_SQL}
