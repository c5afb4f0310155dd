"""Query of the collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.phrases import collocations
from rankmill.llm.records import read


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = collocations(documents.select(F.col("lang").alias("list_key"), F.col("text").alias("content")))
    return found.withColumnRenamed("list_key", "lang")


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
f AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a,
         count(*) FILTER (i > 1) AS n_left, count(*) FILTER (i + k - 1 < len(words)) AS n_right
  FROM w, (VALUES (1), (2), (3), (4)) t(k), unnest(range(1, len(words) - k + 2)) u(i)
  GROUP BY ALL HAVING k = 1 OR count(*) >= 30),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, a, n_left, n_right FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, j, fl.a AS l, fr.a AS r, ((2000000::HUGEINT * c.a) // (fl.a::HUGEINT + fr.a))::BIGINT AS score
  FROM c, unnest(range(1, c.k)) u(j)
  JOIN f fl ON fl.lang = c.lang AND fl.phrase = array_to_string(c.words[1:j], ' ')
  JOIN f fr ON fr.lang = c.lang AND fr.phrase = array_to_string(c.words[j + 1:c.k], ' ')),
weakest AS (SELECT lang, phrase, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT c.lang, array_to_string(c.words[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (VALUES (2), (3)) t(s), unnest(range(1, c.k - s + 2)) u(i) WHERE c.k > s GROUP BY ALL),
kept AS (
  SELECT lang, c.phrase, a, l, r, score, n_left, n_right
  FROM c JOIN weakest USING (lang, phrase) LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, n_left, n_right
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
