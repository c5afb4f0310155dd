"""Filters, predicates and row shapes over whole views."""

from pyspark.sql import functions as F

from rankmill.catalog.registry import query
from rankmill.operators import filters

DAY = 86_400
ANSWERED = (
    "coalesce(list_contains(json_keys(result), 'data') AND list_contains(json_keys(result), 'success'), false)"
)


@query(
    "point_lookup",
    """SELECT r.* FROM ranking r JOIN (SELECT min({'c': character_name, 's': server_name, 'd': div}) AS k FROM ranking)
       ON character_name = k.c AND server_name = k.s AND div = k.d""",
)
def _(i):
    key = i.ranking.agg(F.min(F.struct("character_name", "server_name", "div"))).first()[0]
    return filters.point_lookup(i.ranking, key["server_name"], key["character_name"], key["div"])


@query("fresh_rows", "SELECT r.* FROM ranking r, now_at WHERE retrieved_at > as_of - INTERVAL 30 DAY")
def _(i):
    return filters.fresh_rows(i.ranking, i.as_of, 30 * DAY)


@query(
    "fresh_server_rows_min_count",
    """SELECT * EXCLUDE (n) FROM (
         SELECT r.*, count(*) OVER (PARTITION BY server_name, div) AS n FROM ranking r, now_at
         WHERE retrieved_at > as_of - INTERVAL 60 DAY) WHERE n >= 20""",
)
def _(i):
    return filters.fresh_server_rows_min_count(i.ranking, i.as_of, 60 * DAY)


@query(
    "outdated_rows",
    """SELECT r.* FROM ranking r, now_at WHERE retrieved_at < as_of - INTERVAL 10 MINUTE
       ORDER BY retrieved_at, server_name, character_name, div LIMIT 100""",
)
def _(i):
    return filters.outdated_rows(i.ranking, i.as_of)


@query("drop_placeholder_names", "SELECT * FROM scraped WHERE character <> '@PLACEHOLDER_NAME@'")
def _(i):
    return filters.drop_placeholder_names(i.scraped)


@query("status_in", "SELECT * FROM requests WHERE status IN ('pending', 'processing')")
def _(i):
    return filters.status_in(i.requests)


@query("name_like", "SELECT * FROM requests WHERE character_name LIKE 'user_1%'")
def _(i):
    return filters.name_like(i.requests, "user_1%")


@query(
    "trim_equal_match",
    """SELECT obs_id, trim(server) AS server, trim(character) AS character, div, rank, power FROM scraped
       WHERE (trim(server), trim(character)) IN (SELECT (r_name, c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
                                                 JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'MACHINERY')
       QUALIFY row_number() OVER (PARTITION BY trim(server), trim(character), div ORDER BY page_seq, pos) = 1""",
)
def _(i):
    wanted = i.characters.filter("c_mktsegment = 'MACHINERY'").select(
        F.concat(F.lit("  "), "r_name").alias("server"), F.concat("c_name", F.lit(" ")).alias("character")
    )
    hits = filters.trim_equal_match(i.scraped, wanted, [F.asc("page_seq"), F.asc("pos")])
    return hits.select("obs_id", "server", "character", "div", "rank", "power")


@query("class_rows_only", "SELECT * FROM snapshots WHERE server_name = 'all' AND class_name <> 'all'")
def _(i):
    return filters.class_rows_only(i.snapshots)


@query(
    "to_api_shape",
    """SELECT format('{:,}', coalesce(rank_position, 0)) || '@RANK_SUFFIX@' AS rank, coalesce(class_name, '') AS class,
              format('{:,}', coalesce(power_value, 0)) AS power, coalesce(change_amount, 0) AS change,
              coalesce(server_name, '') AS server, coalesce(character_name, '') AS character,
              coalesce(change_type, 'none') AS change_type, div FROM ranking""",
)
def _(i):
    return filters.to_api_shape(i.ranking)


@query(
    "request_status_view",
    f"""SELECT request_id, status, CASE WHEN NOT done THEN server END AS server,
          CASE WHEN NOT done THEN character_name END AS character_name,
          CASE WHEN answered THEN coalesce(json_extract_string(result, '$.success') = 'true', false) WHEN done THEN true
               ELSE status IN ('processing', 'pending') END AS success,
          CASE WHEN answered THEN coalesce(json_extract_string(result, '$.message'), '') WHEN NOT done THEN
               CASE status WHEN 'failed' THEN '@STATUS_MESSAGES.failed@' WHEN 'processing' THEN '@STATUS_MESSAGES.processing@'
                    WHEN 'pending' THEN '@STATUS_MESSAGES.pending@' ELSE '@OTHER_STATUS_MESSAGE_PREFIX@' || status END END AS message,
          CASE WHEN answered AND json_type(result, '$.data') <> 'NULL' THEN CAST(json_extract(result, '$.data') AS VARCHAR) END AS character_json,
          CASE WHEN answered THEN coalesce(json_extract_string(result, '$.from_cache') = 'true', false) END AS from_cache,
          CASE WHEN done AND NOT answered THEN result END AS raw_result,
          CASE WHEN NOT done AND status NOT IN ('processing', 'pending') THEN error_message END AS error,
          CASE WHEN status = 'failed' THEN retry_count END AS retry_count,
          CASE WHEN status = 'processing' THEN started_at END AS started_at,
          CASE WHEN status = 'pending' THEN created_at END AS created_at,
          CASE WHEN done THEN completed_at END AS completed_at
        FROM (SELECT *, status = 'completed' AND result IS NOT NULL AS done,
                     status = 'completed' AND result IS NOT NULL AND {ANSWERED} AS answered FROM requests)""",
)
def _(i):
    return filters.request_status_view(i.requests)


@query(
    "flatten_result",
    f"""SELECT request_id, CASE WHEN a THEN json_extract_string(result, '$.success') = 'true' END AS success,
               CASE WHEN a THEN coalesce(json_extract_string(result, '$.message'), '') END AS message,
               CASE WHEN a THEN coalesce(json_extract_string(result, '$.from_cache') = 'true', false) END AS from_cache,
               CASE WHEN a AND json_type(result, '$.data') <> 'NULL' THEN CAST(json_extract(result, '$.data') AS VARCHAR) END AS character_json,
               CASE WHEN NOT a THEN result END AS raw_result
        FROM (SELECT *, {ANSWERED} AS a FROM requests WHERE result IS NOT NULL)""",
)
def _(i):
    return filters.flatten_result(i.requests)


VALID = """
    (SELECT obs_id, TRY_CAST(replace(replace(rank, ',', ''), '@RANK_SUFFIX@', '') AS INTEGER) AS rank_position,
            CASE WHEN change_type = 'down' THEN -abs(n) ELSE n END AS change_amount, change_type,
            trim(server) AS server_name, character AS character_name, trim(class, chr(9) || ' ') AS class_name,
            TRY_CAST(replace(power, ',', '') AS BIGINT) AS power_value
     FROM (SELECT *, CASE WHEN change = '-' THEN 0 ELSE TRY_CAST(replace(change, ',', '') AS INTEGER) END AS n FROM scraped))"""


@query(
    "split_valid_rows",
    f"""SELECT *, rank_position IS NOT NULL AND power_value IS NOT NULL AND change_amount IS NOT NULL AS valid FROM {VALID}""",
)
def _(i):
    columns = [
        "obs_id", "rank_position", "change_amount", "change_type", "server_name", "character_name", "class_name",
        "power_value",
    ]
    return filters.flag_valid_rows(i.scraped).select(*columns, "valid")


@query(
    "needs_refresh",
    """SELECT server_name, character_name, coalesce(epoch(as_of) - epoch(t) >= 3600, true) AS hourly,
              coalesce(epoch(as_of) - epoch(t) >= 864000, true) AS ten_days
       FROM (SELECT server_name, character_name, CASE WHEN change_type <> 'none' THEN retrieved_at END AS t FROM ranking), now_at""",
)
def _(i):
    then = F.when(F.col("change_type") != "none", F.col("retrieved_at"))
    return i.ranking.select(
        "server_name",
        "character_name",
        filters.needs_refresh(then, i.as_of).alias("hourly"),
        filters.needs_refresh(then, i.as_of, 10 * DAY).alias("ten_days"),
    )


@query("not_found_pages", "SELECT page_seq, search_server, search_name, kind FROM page_heads")
def _(i):
    return i.rank_pages.select(
        "page_seq", "search_server", "search_name", filters.page_kind(F.col("html")).alias("kind")
    )


@query(
    "challenge_pages",
    """SELECT page_seq, page_seq % 50 = 13 OR page_seq % 50 = 33 AS challenge FROM page_heads""",
)
def _(i):
    return i.rank_pages.select("page_seq", filters.challenge_page(F.col("html")).alias("challenge"))
