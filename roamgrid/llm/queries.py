"""The training-data queries: thin, each through its operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, divergence, filter_audit, license_scan, line_dedup, pii_crf, quality_mil, quality_rules, suffix_lm
from .common import table
from .packing import pack_documents
from .simhash import near_duplicates
from .token_count import count_tokens, with_limit


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_limit(count_tokens(table(spark, sf_dir, "documents"), vocabulary()))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_examples(turns.unionByName(own)))


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents"))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_crf.find_personal_data(docs, pii_crf.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_secret", "n_spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kept_chars and kept_sha256 of what stays, n_cut lines that went and their places (from 0)."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.coalesce("__cut", F.array().cast("array<int>"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"), F.size(cut).cast("long").alias("n_cut"), F.array_join(F.array_sort(cut), ",").alias("cut_lines"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_count, op2_chat_format, op3_quality_mil, op4_best_fit_packing, op5_simhash, op6_suffix_lm, op7_pii_crf, op8_quality_rules, op9_decontamination, op10_line_dedup, op11_source_divergence, op12_filter_audit, op13_license_scan, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op11_source_divergence": OP11_SQL, "op12_filter_audit": OP12_SQL}


#: n_examples and formatted_chars follow from the template: marks of 7, 8 and 8 characters, one more for each escape.
OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(23 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '<(/?s>|\\||/?SYS>|unk>|pad>|bos>|eos>|mask>)|\\[/?INST\\]'))) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR pos = n) AS n_examples
FROM s GROUP BY conv_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), t AS (SELECT doc, lang, source, unnest(words) AS term FROM d
), k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(v.v, 0) AS v, v.n AS lang_n, coalesce((SELECT sum(n) FROM c WHERE c.lang = o.lang AND c.source = o.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN v USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.n + 5 * g.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)::HUGEINT) // (g.lang_n + 5 * g.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER w)::INTEGER AS rank FROM r
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, doc_id,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, list_sum(list_transform(fails, lambda x, i: CASE WHEN x THEN (1 << (i - 1)) ELSE 0 END))::INTEGER AS mask, list_sum(list_transform(fails, lambda x: x::INTEGER)) AS k,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY part, mask, k
), o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65))::INTEGER AS own, coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[1:step - 1], '') IF x <> '']), 0)::INTEGER AS before
  FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(filter_order) = 5
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(k, 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM m CROSS JOIN s GROUP BY part, filter_order, step, own, before
"""
