"""Registered queries of the subpackage and their SQL checks; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import (
    bpe, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, prefix_trie,
    private_data, quality_rules, repeats, secret_scan, sql_checks, vector_codes,
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf, "documents"), TOKENIZER)


def op2_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents")).drop("kept_text")


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf, "documents"))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf, "documents"))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf, "documents"))


def op10_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(table(spark, sf, "pages"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


def op13_private_data(spark: SparkSession, sf: str) -> DataFrame:
    return private_data.find_private(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_repeats": op2_repeats,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_extract": op10_html_extract,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_private_data": op13_private_data,
}


def _spans(kind: int, pattern: str, value: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, {kind} AS kind, part[i] AS match, {value} AS value,
         list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(part[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, source, part, gap, unnest(range(1, len(part) + 1)) AS i
        FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{pattern}') AS part,
                     regexp_split_to_array(coalesce(text, ''), '{pattern}') AS gap FROM documents))"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

ORACLE: dict[str, str] = {
    "op4_secret_scan": f"""
WITH found AS ({_spans(0, _ASSIGN, "regexp_extract(part[i], '" + _ASSIGN.replace("'", "''") + "', 2)")}
  UNION ALL {_spans(1, "AKIA[A-Z0-9]{16,}", "part[i]")}
  UNION ALL {_spans(2, "[0-9a-f]{24,}", "part[i]")}
  UNION ALL {_spans(3, "[A-Za-z0-9+/_-]{32,}", "part[i]")}),
spans AS (SELECT *, start + length(match) AS stop FROM found
  WHERE (kind <> 0 OR length(value) >= 6)
    AND (kind <> 3 OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]'))),
held AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM spans GROUP BY value),
judged AS (SELECT s.*, owners >= 5 AS shared,
    owners < 5 AND length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
      AND len(list_distinct(string_split(value, ''))) >= 8 AS live
  FROM spans s JOIN held USING (value)),
kept AS (SELECT *, ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || start || ':' || stop AS label
  FROM judged WHERE kind <> 3 OR live)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(label, ',' ORDER BY start, kind), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (shared) AS n_shared
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_vector_codes": sql_checks.vector_codes(),
    "op12_prefix_trie": sql_checks.PREFIX_TRIE,
}
