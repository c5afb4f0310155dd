"""Queries of the operators in DataFrame functions: mixing and URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.mixing import mix_lists
from rankmill.llm.records import articles, read
from rankmill.llm.url_lists import filter_captures, url_host, url_path


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_lists(articles(read(spark, sf_dir, "documents")))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", F.col("list_words").alias("source_size"), "target", "taken"
    )


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '-')) AS k
  FROM documents),
lists AS (
  SELECT source, sum(size)::BIGINT AS s,
         [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2 * s) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS l
  FROM lists
  WINDOW b AS (ORDER BY 2 * s / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, s, least(2.0 * s, max(l) OVER () * w) AS target FROM levels),
rounds AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS e FROM targets),
keyed AS (
  SELECT source, k, sum(size) AS words, count(*) AS n,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY k) - sum(size) AS before
  FROM sizes GROUP BY source, k)
SELECT a.doc_id, a.size::BIGINT AS size, r.s AS source_size, r.target::DOUBLE AS target,
       (r.e * a.size + CASE WHEN floor(r.target)::BIGINT - r.e * r.s >= g.before + g.words THEN a.size
                            WHEN floor(r.target)::BIGINT - r.e * r.s <= g.before THEN 0
                            ELSE least(a.size, (floor(r.target)::BIGINT - r.e * r.s - g.before) // g.n) END)::BIGINT AS taken
FROM sizes a
JOIN rounds r ON a.source IS NOT DISTINCT FROM r.source
JOIN keyed g ON a.source IS NOT DISTINCT FROM g.source AND a.k = g.k
"""


def captures(pages: DataFrame) -> DataFrame:
    """Saved pages with a time of fetching, spread over a year by the page number."""
    day = F.make_dt_interval((F.coalesce("page_id", F.lit(0)) * 7 % 365).cast("int"))
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts, domains and first path steps that occur; days and actions follow from a hash."""
    url = F.col("url")
    step = F.element_at(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), 1)
    places = pages.select(url_host(url).alias("host"), step.alias("step")).where("host <> ''").distinct()
    hosts = places.select("host").distinct().withColumn("h", F.md5("host"))
    digit = [F.ascii(F.substring("h", i, 1)) for i in range(1, 7)]
    zero = F.lit("2024-01-01").cast("timestamp_ntz")

    def at(day) -> DataFrame:
        return (zero + F.make_dt_interval(day.cast("int"))).alias("listed_at")

    def rows(frame, name, kind, pattern, action, day):
        return frame.select(
            F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at(day)
        )

    first = digit[1] % 16 * 12
    some = hosts.where(digit[0] % 3 == 0)
    domains = hosts.select(F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".").alias("domain")).distinct()
    domains = domains.withColumn("h", F.md5("domain"))
    prefixes = places.where("step IS NOT NULL").select(F.concat_ws("/", "host", "step").alias("prefix")).distinct()
    prefixes = prefixes.withColumn("h", F.md5("prefix"))
    return (
        rows(some, "hosts", "host", F.col("host"), "block", first)
        .union(rows(some.where(digit[2] % 2 == 0), "hosts", "host", F.col("host"), "remove", first + 90))
        .union(rows(some.where(digit[3] % 4 == 0), "hosts", "host", F.col("host"), "block", first + 150))
        .union(rows(domains.where(digit[0] % 4 == 1), "domains", "domain", F.col("domain"), "block", digit[4] % 16 * 20))
        .union(rows(prefixes.where(digit[0] % 4 == 2), "sections", "prefix", F.col("prefix"), "allow", digit[5] % 16 * 15))
    )


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_captures(captures(pages), list_entries(pages))
    return found.select("page_id", "url", "n_active", "rule", "blocked")


OP8_SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((coalesce(page_id, 0) * 7 % 365)::INT) AS fetched_at,
         lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2), '/'), lambda s: s <> '') AS steps
  FROM pages),
places AS (SELECT DISTINCT host, steps[1] AS step FROM captures WHERE host <> ''),
hosts AS (SELECT DISTINCT host AS p, md5(host) AS h FROM places),
domains AS (SELECT DISTINCT array_to_string(string_split(p, '.')[-3:], '.') AS p, md5(array_to_string(string_split(p, '.')[-3:], '.')) AS h FROM hosts),
prefixes AS (SELECT DISTINCT host || '/' || step AS p, md5(host || '/' || step) AS h FROM places WHERE step IS NOT NULL),
entries AS (
  SELECT 'hosts' AS list_name, 'host' AS kind, p AS pattern, 'block' AS action, ascii(h[2]) % 16 * 12 AS d FROM hosts WHERE ascii(h[1]) % 3 = 0
  UNION ALL SELECT 'hosts', 'host', p, 'remove', ascii(h[2]) % 16 * 12 + 90 FROM hosts WHERE ascii(h[1]) % 3 = 0 AND ascii(h[3]) % 2 = 0
  UNION ALL SELECT 'hosts', 'host', p, 'block', ascii(h[2]) % 16 * 12 + 150 FROM hosts WHERE ascii(h[1]) % 3 = 0 AND ascii(h[4]) % 4 = 0
  UNION ALL SELECT 'domains', 'domain', p, 'block', ascii(h[5]) % 16 * 20 FROM domains WHERE ascii(h[1]) % 4 = 1
  UNION ALL SELECT 'sections', 'prefix', p, 'allow', ascii(h[6]) % 16 * 15 FROM prefixes WHERE ascii(h[1]) % 4 = 2),
spans AS (
  SELECT *, TIMESTAMP '2024-01-01' + to_days(d::INT) AS since,
         TIMESTAMP '2024-01-01' + to_days((lead(d) OVER (PARTITION BY list_name, kind, pattern ORDER BY d))::INT) AS until
  FROM entries),
wanted AS (
  SELECT DISTINCT url, fetched_at, 'host' AS kind, host AS pattern FROM captures WHERE host <> ''
  UNION SELECT url, fetched_at, 'domain', array_to_string(string_split(host, '.')[i:], '.')
        FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) t(i) WHERE host <> ''
  UNION SELECT url, fetched_at, 'prefix', host || '/' || array_to_string(steps[:i], '/')
        FROM captures, unnest(range(1, len(steps) + 1)) t(i) WHERE host <> ''),
hits AS (
  SELECT w.url, w.fetched_at, s.*, row_number() OVER (PARTITION BY w.url, w.fetched_at ORDER BY length(pattern) DESC, action, kind, list_name, pattern) AS r,
         count(*) OVER (PARTITION BY w.url, w.fetched_at) AS n
  FROM wanted w JOIN spans s USING (kind, pattern)
  WHERE s.action IN ('allow', 'block') AND w.fetched_at >= s.since AND (s.until IS NULL OR w.fetched_at < s.until))
SELECT c.page_id, c.url, coalesce(h.n, 0)::BIGINT AS n_active,
       h.list_name || ':' || h.kind || ':' || h.pattern || ':' || h.action AS rule, coalesce(h.action = 'block', false) AS blocked
FROM captures c LEFT JOIN hits h ON c.url = h.url AND c.fetched_at = h.fetched_at AND h.r = 1
"""
