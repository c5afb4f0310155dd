"""First rows per key, numbering, look-back, orders and limits over whole views."""

from pyspark.sql import functions as F

from rankmill.catalog.aggregate_queries import CLASSES, FRONTIER, SHARES, class_counts, server_bottoms, shares
from rankmill.catalog.join_queries import BOTTOM
from rankmill.catalog.registry import query
from rankmill.operators import aggregates, ordering, windows
from rankmill.sources import pages as page_source

LATEST = """
    (SELECT * FROM obs WHERE character_name <> '@PLACEHOLDER_NAME@'
     QUALIFY row_number() OVER (PARTITION BY server_name, div, character_name ORDER BY retrieved_at DESC, rank_position) = 1)"""


@query("latest_per_character", f"SELECT server_name, div, character_name, rank_position, retrieved_at FROM {LATEST}")
def _(i):
    rows = windows.latest_per_character(i.obs).select(
        "server_name", "div", "character_name", "rank_position", "retrieved_at"
    )
    return rows.orderBy("rank_position")


@query("distinct_on_key", "SELECT DISTINCT ON (character_name, server_name, div) * FROM obs ORDER BY character_name, server_name, div, retrieved_at DESC, obs_id DESC")
def _(i):
    order = [F.desc("retrieved_at"), F.desc("obs_id")]
    return windows.distinct_on_key(i.obs, ["character_name", "server_name", "div"], order)


@query("bottom_rank_ties", f"SELECT r.* {BOTTOM}")
def _(i):
    return windows.bottom_rank_ties(i.ranking)


@query(
    "first_seen",
    """SELECT character, page_seq, pos, rank FROM scraped WHERE character <> ''
       QUALIFY row_number() OVER (PARTITION BY character ORDER BY page_seq, pos) = 1""",
)
def _(i):
    return windows.first_seen(i.scraped).select("character", "page_seq", "pos", "rank")


@query(
    "first_match_per_type",
    """SELECT obs_id, trim(server) AS server, character, div, rank FROM scraped
       QUALIFY row_number() OVER (PARTITION BY trim(server), character, div ORDER BY page_seq, pos) = 1""",
)
def _(i):
    rows = i.scraped.withColumn("server", F.trim("server"))
    hits = windows.first_match_per_type(rows, ["server", "character"], [F.asc("page_seq"), F.asc("pos")])
    return hits.select("obs_id", "server", "character", "div", "rank")


@query(
    "assign_batches",
    f"""SELECT server_name, character_name, rn AS row_no, CAST((rn - 1) // 200 AS BIGINT) AS batch_index,
               CAST((n + 199) // 200 AS BIGINT) AS batch_count
        FROM (SELECT server_name, character_name, row_number() OVER (PARTITION BY server_name ORDER BY latest_retrieved_at NULLS FIRST, character_name) AS rn,
                     count(*) OVER (PARTITION BY server_name) AS n FROM ({FRONTIER}))""",
)
def _(i):
    due = aggregates.stale_frontier(i.ranking, i.as_of)
    batches = windows.assign_batches(due, ordering.frontier_order(), 200, ["server_name"])
    return batches.select("server_name", "character_name", "row_no", "batch_index", "batch_count")


@query(
    "assign_batches_overall",
    """SELECT obs_id, rn AS row_no, CAST((rn - 1) // 1000 AS BIGINT) AS batch_index, CAST((n + 999) // 1000 AS BIGINT) AS batch_count
       FROM (SELECT obs_id, row_number() OVER (ORDER BY retrieved_at, obs_id) AS rn, count(*) OVER () AS n FROM obs)""",
)
def _(i):
    rows = i.obs.select("obs_id", "retrieved_at")
    batches = windows.assign_batches(rows, [F.asc("retrieved_at"), F.asc("obs_id")], 1000)
    return batches.drop("retrieved_at")


@query(
    "fingerprint_changed",
    """SELECT *, coalesce(fingerprint <> previous, true) AS changed FROM (
         SELECT *, lag(fingerprint) OVER (PARTITION BY list_key ORDER BY page_id) AS previous FROM versions)""",
)
def _(i):
    versions = page_source.list_fingerprints(i.list_pages)
    return windows.fingerprint_changed(versions, ["list_key"], "page_id")


@query("report_index", f"SELECT class_name, population, row_number() OVER (ORDER BY population DESC, class_name) AS idx FROM {CLASSES}")
def _(i):
    return windows.report_index(class_counts(i))


@query("share_of_total", f"SELECT class_name, population, population / sum(population) OVER () AS share FROM {CLASSES}")
def _(i):
    return windows.share_of_total(class_counts(i))


@query("frontier_order", FRONTIER)
def _(i):
    return ordering.order_frontier(aggregates.stale_frontier(i.ranking, i.as_of))


@query("next_request", "SELECT * FROM requests WHERE status = 'pending' ORDER BY priority, created_at, request_id LIMIT 1")
def _(i):
    return ordering.next_request(i.requests)


@query(
    "next_request_per_server",
    """SELECT * FROM requests WHERE status = 'pending'
       QUALIFY row_number() OVER (PARTITION BY server ORDER BY priority, created_at, request_id) = 1""",
)
def _(i):
    return ordering.next_per_server(i.requests)


@query("classes_by_population", f"SELECT * FROM {CLASSES} ORDER BY population DESC, class_name")
def _(i):
    return ordering.classes_by_population(class_counts(i))


@query(
    "by_server_name",
    f"SELECT r.server_name, character_name, rank_position AS population {BOTTOM} ORDER BY 1",
)
def _(i):
    return ordering.by_server_name(server_bottoms(i))


@query("last_errors", "SELECT * FROM log_lines WHERE contains(line, 'ERROR') ORDER BY line_no DESC LIMIT 5")
def _(i):
    return ordering.last_errors(i.log_lines)


@query(
    "names_or_default",
    f"""WITH latest AS {LATEST.replace('obs', 'ranking')}, named AS (SELECT server_name, character_name, rank_position FROM latest WHERE div = 1 AND server_name <> 'ASIA')
        SELECT * FROM named UNION ALL
        SELECT DISTINCT server_name, '@DEFAULT_FRONTIER_NAME@', CAST(NULL AS INTEGER) FROM ranking WHERE server_name NOT IN (SELECT server_name FROM named)""",
)
def _(i):
    latest = windows.latest_per_character(i.ranking.filter("div = 1 AND server_name <> 'ASIA'"))
    return ordering.names_or_default(latest, i.ranking)


@query(
    "latest_artifact",
    """SELECT max(name) AS name FROM (SELECT CASE event_type WHEN 'view' THEN 'class_distribution_' ELSE 'population_graph_' END
                                       || strftime(ts, '%Y%m%d%H%M%S') AS name FROM events)
       WHERE starts_with(name, 'class_distribution_')""",
)
def _(i):
    prefix = F.when(F.col("event_type") == "view", "class_distribution_").otherwise("population_graph_")
    files = i.table("events").select(F.concat(prefix, F.date_format("ts", "yyyyMMddHHmmss")).alias("name"))
    return ordering.latest_artifact(files, "class_distribution_")


@query("top_n_classes", f"SELECT * FROM ({SHARES}) ORDER BY population DESC, class_name LIMIT 5")
def _(i):
    return ordering.top_n_classes(shares(i))
