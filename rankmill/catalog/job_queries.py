"""The composite jobs."""

from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill.catalog.aggregate_queries import ALERT, FRONTIER, LATE, SHARES
from rankmill.catalog.filter_queries import DAY
from rankmill.catalog.join_queries import changes_since, state_before
from rankmill.catalog.registry import query
from rankmill.catalog.source_queries import ARTICLE_SQL, ROWS, articles
from rankmill.plans import jobs


@query(
    "class_report",
    f"""SELECT row_number() OVER (ORDER BY population DESC, class_name) AS idx, class_name, population,
               format('{{:,}}', population) || '@PERSON_SUFFIX@' AS population_formatted, percentage, total_population FROM ({SHARES})""",
)
def _(i):
    return jobs.class_report(i.ranking)


@query(
    "server_populations",
    """SELECT b.server_name, b.character_name, least(b.rank_position, coalesce(f.rank_position, b.rank_position)) AS population
       FROM (SELECT r.* FROM before_2000 r JOIN (SELECT server_name, max(rank_position) AS m FROM before_2000 GROUP BY server_name) x
             ON r.server_name = x.server_name AND rank_position = m) b
       LEFT JOIN (SELECT server_name, character_name, min(rank_position) AS rank_position FROM since_2000 GROUP BY ALL) f
       ON b.server_name = f.server_name AND b.character_name = f.character_name""",
)
def _(i):
    return jobs.server_populations(state_before(i), changes_since(i))


@query(
    "refresh_plan",
    f"""SELECT server_name, character_name, latest_retrieved_at, rn AS row_no, CAST((rn - 1) // 200 AS BIGINT) AS batch_index,
               CAST((n + 199) // 200 AS BIGINT) AS batch_count
        FROM (SELECT *, row_number() OVER (PARTITION BY server_name ORDER BY latest_retrieved_at NULLS FIRST, character_name) AS rn,
                     count(*) OVER (PARTITION BY server_name) AS n FROM ({FRONTIER}) WHERE character_name <> '@PLACEHOLDER_NAME@')""",
)
def _(i):
    return jobs.refresh_plan(i.ranking, i.as_of)


BATCH = f"""
    batch AS (SELECT DISTINCT page_seq, pos, rank_position, CASE WHEN change_type = 'down' THEN -abs(n) ELSE n END AS change_amount,
                     change_type, server_name, character_name, class_name, power_value, div, page_time AS retrieved_at
              FROM (SELECT page_seq, pos, TRY_CAST(replace(replace(rank, ',', ''), '@RANK_SUFFIX@', '') AS INTEGER) AS rank_position,
                           CASE WHEN change IN ('-', 'new') THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(change, '([0-9]+)', 1) AS INTEGER), 0) END AS n,
                           change_type, trim(server) AS server_name, character AS character_name, trim(class, chr(9) || ' ') AS class_name,
                           TRY_CAST(replace(power, ',', '') AS BIGINT) AS power_value, p.div, page_time {ROWS})
              WHERE rank_position IS NOT NULL AND power_value IS NOT NULL),
    newest AS (SELECT * EXCLUDE (page_seq, pos) FROM batch QUALIFY row_number() OVER (
               PARTITION BY character_name, server_name, div ORDER BY retrieved_at DESC, page_seq DESC, pos DESC) = 1),
    merged AS (SELECT * FROM before_2000 ANTI JOIN newest USING (character_name, server_name, div) UNION ALL BY NAME SELECT * FROM newest),
    missing AS (SELECT search_server AS server_name, search_name AS character_name, max(page_seq) AS gone_at
                FROM page_heads WHERE kind = 'not_found' GROUP BY ALL),
    alive AS (SELECT b.* FROM batch b LEFT JOIN missing m USING (server_name, character_name) WHERE gone_at IS NULL OR b.page_seq > gone_at),
    late AS (SELECT * EXCLUDE (page_seq, pos) FROM alive QUALIFY row_number() OVER (
             PARTITION BY character_name, server_name, div ORDER BY retrieved_at DESC, page_seq DESC, pos DESC) = 1)"""


@query(
    "ingest_pages",
    f"""WITH {BATCH} SELECT * FROM before_2000 ANTI JOIN missing USING (server_name, character_name) ANTI JOIN late USING (character_name, server_name, div)
        UNION ALL BY NAME SELECT * FROM late""",
)
def _(i):
    return jobs.ingest_pages(i.rank_pages, state_before(i), i.as_of)[0]


@query(
    "ingest_pages_report",
    f"""WITH {BATCH} SELECT b.page_seq AS batch_id, count(*) AS given, count(*) FILTER (m.retrieved_at >= b.retrieved_at - INTERVAL 60 SECOND) AS saved,
               count(*) <> count(*) FILTER (m.retrieved_at >= b.retrieved_at - INTERVAL 60 SECOND) AS mismatch
        FROM batch b LEFT JOIN merged m USING (character_name, server_name, div) GROUP BY b.page_seq""",
)
def _(i):
    return jobs.ingest_pages(i.rank_pages, state_before(i), i.as_of)[1]


@query(
    "ingest_pages_audit",
    f"""WITH {BATCH} SELECT server_name AS object_id, CAST(count(*) AS INTEGER) AS count, [character_name] AS character_list
        FROM (SELECT character_name, server_name, div FROM before_2000 UNION SELECT character_name, server_name, div FROM batch b
              JOIN missing m USING (server_name, character_name) WHERE b.page_seq <= gone_at)
        SEMI JOIN missing USING (server_name, character_name) GROUP BY server_name, character_name""",
)
def _(i):
    audit = jobs.ingest_pages(i.rank_pages, state_before(i), i.as_of)[2]
    return audit.select("object_id", "count", "character_list")


@query(
    "ingest_pages_quarantine",
    f"""SELECT page_seq, count(*) AS rows FROM (SELECT page_seq, TRY_CAST(replace(replace(rank, ',', ''), '@RANK_SUFFIX@', '') AS INTEGER) AS r,
               TRY_CAST(replace(power, ',', '') AS BIGINT) AS p {ROWS}) WHERE r IS NULL OR p IS NULL GROUP BY page_seq""",
)
def _(i):
    quarantine = jobs.ingest_pages(i.rank_pages, state_before(i), i.as_of)[3]
    return quarantine.groupBy("page_seq").agg(F.count(F.lit(1)).alias("rows"))


def _cell(d: int) -> str:
    return (
        f"max(format('{{:,}}', rank_position) || '{fv.RANK_SUFFIX}') FILTER (div = {d}) AS rank_{d}, "
        f"max(format('{{:,}}', power_value)) FILTER (div = {d}) AS power_{d}, max(change_amount) FILTER (div = {d}) AS change_{d}, "
        f"max(change_type) FILTER (div = {d}) AS change_type_{d}, max(class_name) FILTER (div = {d}) AS class_{d}, "
        f"max(retrieved_at) FILTER (div = {d}) AS retrieved_at_{d}"
    )


NOT_FOUND = fv.NAME_NOT_FOUND_MESSAGE.replace("'", "''").replace("{name}", "' || character_name || '").replace("{server}", "' || server_name || '")


@query(
    "character_answer",
    f"""WITH fresh AS (SELECT b.* FROM before_2000 b WHERE retrieved_at > TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 700 DAY),
             complete AS (SELECT server_name, character_name FROM fresh GROUP BY ALL HAVING count(DISTINCT div) = 3),
             chosen AS (SELECT *, 'primary' AS source FROM fresh SEMI JOIN complete USING (server_name, character_name)
                        UNION ALL BY NAME SELECT *, 'secondary' AS source FROM ranking ANTI JOIN complete USING (server_name, character_name)),
             found AS (SELECT server_name, character_name, max(source) AS source, {_cell(1)}, {_cell(2)}, {_cell(3)}
                       FROM chosen GROUP BY server_name, character_name),
             asked AS (SELECT DISTINCT r_name AS server_name, c_name AS character_name
                       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT *, source IS NOT NULL AS success, coalesce(source = 'primary', false) AS from_cache,
               CASE WHEN source = 'primary' THEN '{fv.CACHE_MESSAGE}' WHEN source IS NOT NULL THEN '{fv.FOUND_MESSAGE}'
                    ELSE '{NOT_FOUND}' END AS message
        FROM asked LEFT JOIN found USING (server_name, character_name)""",
)
def _(i):
    asked = i.characters.select(F.col("r_name").alias("server_name"), F.col("c_name").alias("character_name"))
    return jobs.character_answer(state_before(i), i.ranking, "2000-01-01 00:00:00", 700 * DAY, asked)


SWEPT_FULL = """swept AS (SELECT * REPLACE (
        CASE WHEN status = 'processing' AND started_at < as_of - INTERVAL 600 SECOND THEN 'timeout' ELSE status END AS status,
        CASE WHEN status = 'processing' AND started_at < as_of - INTERVAL 600 SECOND THEN '@TIMEOUT_MESSAGE@' ELSE error_message END AS error_message,
        CASE WHEN status = 'processing' AND started_at < as_of - INTERVAL 600 SECOND THEN as_of ELSE completed_at END AS completed_at)
      FROM requests, event_now),
    kept AS (SELECT * EXCLUDE (as_of) FROM swept WHERE NOT coalesce(status IN ('completed', 'failed', 'timeout')
             AND completed_at < as_of - INTERVAL 7 DAY, false))"""


@query("request_maintenance", f"WITH {SWEPT_FULL} SELECT * FROM kept")
def _(i):
    return jobs.request_maintenance(i.requests, i.event_as_of)[0]


@query(
    "request_maintenance_stats",
    f"""WITH {SWEPT_FULL} SELECT s.status, count(r.status) AS requests
        FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed'), ('timeout')) s(status)
        LEFT JOIN (SELECT status FROM kept, event_now WHERE created_at > as_of - INTERVAL 24 HOUR) r ON r.status = s.status
        GROUP BY s.status""",
)
def _(i):
    return jobs.request_maintenance(i.requests, i.event_as_of)[1]


@query("request_maintenance_alert", f"WITH {LATE} {ALERT}")
def _(i):
    return jobs.request_maintenance(i.requests, i.event_as_of)[2]


@query(
    "incremental_articles",
    f"""SELECT id, title, post_date, CAST(to_json({{'id': id, 'title': title, 'post_date': post_date, 'url': url, 'content_html': content_html,
               'attachments': attachments, 'videos': videos, 'scraped_at': scraped_at}}) AS VARCHAR) AS contents_json, (SELECT as_of FROM now_at) AS scraped_at
        FROM ({ARTICLE_SQL}) WHERE title NOT IN (SELECT title FROM article_titles WHERE starts_with(url, 'https:'))
        AND id IN (SELECT page_id FROM versions QUALIFY coalesce(fingerprint <> lag(fingerprint) OVER (PARTITION BY list_key ORDER BY page_id), true))""",
)
def _(i):
    stored = articles(i).filter(F.startswith("url", F.lit("https:"))).select("title")
    return jobs.incremental_articles(i.list_pages, stored, i.as_of)


@query(
    "ops_dashboard",
    """SELECT server_name, status, CASE status WHEN 'running' THEN '@STATUS_SYMBOLS.running@' WHEN 'waiting' THEN '@STATUS_SYMBOLS.waiting@' WHEN 'error' THEN '@STATUS_SYMBOLS.error@' END AS symbol,
              CASE WHEN length(name) > 16 THEN substring(name, 1, 13) || '...' ELSE name END AS current_name,
              format('{:,}', p) AS processed, format('{:,}', r) AS remaining, errors,
              CASE WHEN age < 60 THEN CAST(age AS VARCHAR) || '@SECONDS_AGO@' WHEN age < 3600 THEN CAST(age // 60 AS VARCHAR) || '@MINUTES_AGO@'
                   ELSE CAST(age // 3600 AS VARCHAR) || '@HOURS_AGO@' END AS last_update_age, last_hour
       FROM (SELECT server_name, count(*) FILTER (outcome <> 'pending') AS p, count(*) FILTER (outcome = 'pending') AS r,
                    count(*) FILTER (outcome = 'failed') AS errors, arg_max(character_name, {'t': logged_at, 'k': task_id}) AS name,
                    CASE arg_max(outcome, {'t': logged_at, 'k': task_id}) WHEN 'failed' THEN 'error' WHEN 'pending' THEN 'waiting' ELSE 'running' END AS status,
                    CAST(epoch(max(as_of)) - epoch(max(logged_at)) AS BIGINT) AS age,
                    count(*) FILTER (logged_at >= as_of - INTERVAL 1 HOUR) AS last_hour
             FROM activity, now_at GROUP BY server_name)""",
)
def _(i):
    return jobs.ops_dashboard(i.activity, i.as_of)


@query("crawler_status", "SELECT * FROM crawler_status")
def _(i):
    return jobs.crawler_status(i.activity)
