"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankmill.llm.records import articles, read
from rankmill.llm.repetition import quality_rules


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(articles(read(spark, sf_dir, "documents"))).drop("longest_repeat")  # SQL has no such figure
    return found.withColumnRenamed("id", "doc_id")


#: a repeat of n words covers what the repeated windows of n words cover; a repeat is over 100 words where a window of 101 repeats
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, sum(n - 1)::BIGINT AS n FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY r),
win AS (
  SELECT r, k, i, md5(array_to_string(words[i:i + k - 1], ' ')) AS h
  FROM w, (VALUES (3), (10), (101)) t(k), unnest(range(1, len(words) - k + 2)) u(i)),
again AS (SELECT r, k, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k, h) > 1),
spans AS (SELECT r, k, i, lead(i) OVER (PARTITION BY r, k ORDER BY i) AS following FROM again),
cover AS (SELECT r, k, sum(least(k, coalesce(following - i, k)))::BIGINT AS n FROM spans GROUP BY r, k),
f AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS covered_words, c.n IS NOT NULL AS long_repeat
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cover a ON a.r = w.r AND a.k = 3 LEFT JOIN cover b ON b.r = w.r AND b.k = 10
  LEFT JOIN cover c ON c.r = w.r AND c.k = 101)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered_words <= 40 * n_words AND NOT long_repeat AS kept
FROM f
"""
