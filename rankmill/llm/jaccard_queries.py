"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.jaccard_join import join_articles
from rankmill.llm.records import articles, read
from rankmill.session import settle_last

SHINGLE, PERCENT = 3, 90


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(read(spark, sf_dir, "documents"))
    found = settle_last(spark, lambda: join_articles(rows, shingle=SHINGLE, percent=PERCENT))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 2], ' ')) AS g
  FROM d, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) u(i)),
whole AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS k FROM s GROUP BY doc_id),
reps AS (SELECT k, min(doc_id) AS doc_id, min(n) AS n FROM whole GROUP BY k),
r AS (SELECT s.doc_id, s.g, reps.n FROM s JOIN reps USING (doc_id)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 90 * (na + nb - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM reps UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT d.doc_id, coalesce(whole.n, 0)::BIGINT AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id,
       coalesce(degree.n, 0)::BIGINT AS n_links
FROM d LEFT JOIN whole USING (doc_id) LEFT JOIN reps ON reps.k = whole.k
LEFT JOIN comp ON comp.a = reps.doc_id LEFT JOIN degree ON degree.a = reps.doc_id
"""
