"""Query of the spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankmill.llm.records import articles, read
from rankmill.llm.spelling import spelling_variants

SLIPS = 199


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(articles(read(spark, sf_dir, "documents")), slips=SLIPS)


#: crc32 bit by bit: the first number of the inner list is the state with the next byte, the others only count to eight
OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM d GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], b), lambda state, byte: xor(state >> 8,
    list_reduce([xor(state & 255, byte), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))) AS h
  FROM bytes),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5),
gaps AS (SELECT word, n, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM words, unnest(range(0, length(word))) u(i)),
shorter AS (SELECT DISTINCT gaps.word AS a, gaps.n AS na, words.word AS b, words.n AS nb FROM gaps JOIN words ON words.word = head || tail),
near AS (
  SELECT x.word AS a, y.word AS b, y.n AS nb FROM gaps x JOIN gaps y ON x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION ALL SELECT a, b, nb FROM shorter UNION ALL SELECT b, a, na FROM shorter),
best AS (SELECT a, b, nb, count(*) OVER (PARTITION BY a) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY nb DESC, b) = 1),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN nb >= 5 * n THEN b END AS form, CASE WHEN nb >= 5 * n THEN nb END AS form_n
  FROM words LEFT JOIN best ON a = word),
walk AS (
  SELECT word, word AS at FROM words
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
roots AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots ON roots.word = forms.word
"""
