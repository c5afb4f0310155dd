"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.decontamination import benchmark_hits, n_hit, over_limit
from rankmill.llm.records import articles, read


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(articles(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("spans"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        over_limit(F.col("n_words"), hit).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(words)) AS k, md5(array_to_string(words[i:i + least(13, len(words)) - 1], ' ')) AS h
  FROM b, unnest(range(1, greatest(len(words) - 12, 1) + 1)) u(i) WHERE len(words) > 0),
places AS (
  SELECT r, i, k, md5(array_to_string(words[i:i + k - 1], ' ')) AS h
  FROM d, (SELECT DISTINCT k FROM windows) ks, unnest(range(1, len(words) - k + 2)) u(i)),
hits AS (SELECT DISTINCT r, i, k, item FROM places JOIN windows USING (k, h)),
ends AS (SELECT r, i, max(i + k) AS e FROM hits GROUP BY r, i),
seen AS (SELECT r, i, e, max(e) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ends),
n AS (SELECT r, sum(greatest(0, e - greatest(i, coalesce(upto, i))))::BIGINT AS n_hit FROM seen GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN its USING (r)
"""
