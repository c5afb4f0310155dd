"""SQL twins of rankmill.views, and the composition of a query with the views it uses."""

from __future__ import annotations

import re

from rankmill import fixed_values as fv

SQL_VIEWS = {
    "obs": """
        SELECT o_orderkey AS obs_id,
               CAST(greatest(1, floor((600000 - floor(o_totalprice)) / 100)) AS INTEGER) AS rank_position,
               CAST(o_orderkey % 7 - 3 AS INTEGER) AS change_amount,
               CASE WHEN o_orderkey % 7 > 3 THEN 'up' WHEN o_orderkey % 7 < 3 THEN 'down' ELSE 'none' END AS change_type,
               r_name AS server_name, c_name AS character_name, c_mktsegment AS class_name,
               CAST(floor(o_totalprice) AS BIGINT) AS power_value,
               CAST(1 + o_orderkey % 3 AS INTEGER) AS div,
               o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS retrieved_at
        FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ranking": """
        SELECT rank_position, change_amount, change_type, server_name, character_name, class_name,
               power_value, div, retrieved_at
        FROM obs
        QUALIFY row_number() OVER (PARTITION BY character_name, server_name, div
                                   ORDER BY retrieved_at DESC, obs_id DESC) = 1""",
    "now_at": "SELECT max(retrieved_at) AS as_of FROM obs",
    "event_now": "SELECT max(ts) AS as_of FROM events",
    "before_2000": """
        SELECT rank_position, change_amount, change_type, server_name, character_name, class_name,
               power_value, div, retrieved_at
        FROM obs WHERE retrieved_at < TIMESTAMP '2000-01-01 00:00:00'
        QUALIFY row_number() OVER (PARTITION BY character_name, server_name, div
                                   ORDER BY retrieved_at DESC, obs_id DESC) = 1""",
    "since_2000": "SELECT * FROM obs WHERE retrieved_at >= TIMESTAMP '2000-01-01 00:00:00'",
    "scraped": f"""
        SELECT obs_id, CAST(obs_id // 60 * 3 + obs_id % 3 AS BIGINT) AS page_seq,
               CAST(obs_id % 60 // 3 AS INTEGER) AS pos,
               CASE WHEN obs_id % 53 = 0 THEN 'n/a' ELSE format('{{:,}}', rank_position) || '{fv.RANK_SUFFIX}' END AS rank,
               CASE WHEN obs_id % 11 = 0 THEN '-' WHEN obs_id % 11 = 1 THEN 'new' WHEN obs_id % 11 = 2 THEN '1,234'
                    WHEN obs_id % 101 = 3 THEN 'abc' ELSE CAST(abs(change_amount) AS VARCHAR) END AS change,
               CASE change_type WHEN 'up' THEN 'change up' WHEN 'down' THEN 'change down' ELSE 'change' END AS css,
               change_type,
               ' ' || server_name || '  ' AS server,
               CASE WHEN obs_id % 97 = 0 THEN '{fv.PLACEHOLDER_NAME}' ELSE character_name END AS character,
               chr(9) || class_name AS class,
               format('{{:,}}', power_value) AS power,
               div,
               strftime(retrieved_at, '%Y-%m-%d %H:%M:%S') AS retrieved_text
        FROM obs""",
    "page_heads": """
        SELECT page_seq, CAST(1 + page_seq % 3 AS INTEGER) AS div, arg_min(character, pos) AS search_name,
               trim(arg_min(server, pos)) AS search_server, CAST(max(retrieved_text) AS TIMESTAMP) AS page_time,
               CASE page_seq % 50 WHEN 7 THEN 'no_data' WHEN 13 THEN 'not_found' WHEN 21 THEN 'empty'
                                  WHEN 33 THEN 'empty' ELSE 'rows' END AS kind,
               count(*) AS n_rows
        FROM scraped GROUP BY page_seq""",
    "cube_rows": """
        SELECT CASE WHEN grouping(server_name) = 1 THEN 'all' ELSE server_name END AS server_name,
               CASE WHEN grouping(class_name) = 1 THEN 'all' ELSE class_name END AS class_name,
               count(*) AS population, CAST(1 AS INTEGER) AS div
        FROM ranking GROUP BY CUBE (server_name, class_name)""",
    "snapshots": """
        SELECT CAST(date_trunc('month', retrieved_at) AS DATE) AS date,
               CASE WHEN grouping(server_name) = 1 THEN 'all' ELSE server_name END AS server_name,
               CASE WHEN grouping(class_name) = 1 THEN 'all' ELSE class_name END AS class_name,
               count(*) AS population, CAST(1 AS INTEGER) AS div
        FROM obs
        GROUP BY GROUPING SETS ((date_trunc('month', retrieved_at)),
                                (date_trunc('month', retrieved_at), server_name),
                                (date_trunc('month', retrieved_at), class_name),
                                (date_trunc('month', retrieved_at), server_name, class_name))""",
    "requests": """
        SELECT 'req-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS request_id,
               ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][CAST(user_id % 5 + 1 AS INTEGER)] AS server,
               'user_' || CAST(user_id AS VARCHAR) AS character_name,
               status, CAST(event_id % 10 AS INTEGER) AS priority, ts AS created_at,
               CASE WHEN status IN ('processing', 'completed', 'timeout') THEN ts + to_seconds(took) END AS started_at,
               CASE WHEN status IN ('completed', 'timeout') OR (status = 'failed' AND event_id % 2 <> 0)
                    THEN ts + to_seconds(2 * took) END AS completed_at,
               CASE WHEN status = 'completed' THEN
                    CASE WHEN event_id % 4 = 0 THEN props ELSE
                         '{"success": true, "message": "found", "from_cache": '
                         || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || ', "data": '
                         || CASE WHEN event_id % 8 = 1 THEN 'null' ELSE props END || '}' END END AS result,
               CASE WHEN status = 'failed' THEN 'No result returned' END AS error_message,
               CAST(event_id % 5 AS INTEGER) AS retry_count, CAST(3 AS INTEGER) AS max_retries,
               CAST(600 AS INTEGER) AS timeout_seconds
        FROM (SELECT *, CAST(floor(value) AS INTEGER) AS took,
                     CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing'
                          WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                          WHEN 'signup' THEN 'timeout' END AS status
              FROM events)""",
    "list_pages": """
        SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS list_key, page_id, url, html FROM pages""",
    "versions": r"""
        SELECT list_key, page_id,
               md5(array_to_string(list_filter(list_transform(
                   regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2),
                   lambda t: trim(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'),
                       '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))), lambda t: t <> ''), '|')) AS fingerprint
        FROM list_pages""",
    "log_lines": """
        SELECT event_id AS line_no,
               strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - '
               || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END || ' - '
               || event_type || ' user ' || CAST(user_id AS VARCHAR)
               || CASE WHEN event_type = 'signup' AND event_id % 7 = 0 THEN ' after ERROR' ELSE '' END AS line
        FROM events""",
    "activity": """
        SELECT o_orderkey AS task_id, 'worker-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS worker_id,
               r_name AS server_name, c_name AS character_name, CAST(o_orderkey // 200 AS BIGINT) AS batch_id,
               CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'pending' ELSE 'saved' END AS outcome,
               o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS logged_at
        FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "articles": r"""
        SELECT page_id AS id, url,
               trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')) AS raw_title,
               trim(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)) AS content_html,
               regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base,
               regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS nav
        FROM pages""",
    "article_titles": """
        SELECT *, trim(replace(replace(replace(replace(replace(replace(raw_title, '&lt;', '<'), '&gt;', '>'),
                       '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title
        FROM articles""",
    "crawler_status": """
        SELECT server_name, arg_max(worker_id, o) AS worker_id,
               CASE arg_max(outcome, o) WHEN 'failed' THEN 'error' WHEN 'pending' THEN 'waiting' ELSE 'running' END AS status,
               arg_max(character_name, o) AS current_character,
               CAST(count(*) FILTER (outcome <> 'pending') AS INTEGER) AS characters_processed,
               CAST(count(*) FILTER (outcome = 'pending') AS INTEGER) AS characters_remaining,
               max(logged_at) AS last_update,
               CAST(count(*) FILTER (outcome = 'failed') AS INTEGER) AS errors_count,
               min(logged_at) AS start_time
        FROM (SELECT *, {'t': logged_at, 'k': task_id} AS o FROM activity) GROUP BY server_name""",
}


def with_views(sql: str) -> str:
    """The query with a WITH clause holding the views it names, and the views those name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name) if name not in needed else None

    visit(sql)
    ctes = [f"{name} AS ({SQL_VIEWS[name]})" for name in needed]
    text = sql.strip()
    if not ctes:
        return text
    if re.match(r"(?i)with recursive\b", text):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + text[len("with recursive") :].strip()
    if re.match(r"(?i)with\b", text):
        return "WITH " + ", ".join(ctes) + ", " + text[len("with") :].strip()
    return "WITH " + ", ".join(ctes) + " " + text
