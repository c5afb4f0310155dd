"""Aggregates over whole views."""

from pyspark.sql import functions as F

from rankmill.catalog.function_queries import half_even
from rankmill.catalog.registry import query
from rankmill.operators import aggregates, joins, mutations, windows
from rankmill.session import settle
from rankmill.sources import pages as page_source

CLASSES = "(SELECT class_name, population FROM cube_rows WHERE server_name = 'all' AND class_name <> 'all')"


def class_counts(i):
    return i.ranking.groupBy("class_name").agg(F.count(F.lit(1)).alias("population"))


def server_bottoms(i):
    return joins.bottom_per_server(i.ranking).select(
        "server_name", "character_name", F.col("rank_position").alias("population")
    )


@query("population_cube", "SELECT * FROM cube_rows")
def _(i):
    return aggregates.population_cube(i.ranking)


@query(
    "queue_stats",
    """SELECT s.status, count(r.status) AS requests
       FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed'), ('timeout')) s(status)
       LEFT JOIN (SELECT status FROM requests, event_now WHERE created_at > as_of - INTERVAL 24 HOUR) r ON r.status = s.status
       GROUP BY s.status""",
)
def _(i):
    return aggregates.queue_stats(i.requests, i.event_as_of)


FRONTIER = """
    SELECT server_name, character_name, max(retrieved_at) AS latest_retrieved_at FROM ranking, now_at WHERE div = 1
    GROUP BY server_name, character_name, as_of
    HAVING max(retrieved_at) < date_trunc('day', as_of) OR max(retrieved_at) IS NULL"""


@query("stale_frontier", FRONTIER)
def _(i):
    return aggregates.stale_frontier(i.ranking, i.as_of)


@query("recent_count", "SELECT count(*) AS rows FROM events, event_now WHERE ts >= as_of - INTERVAL 1 HOUR")
def _(i):
    events = i.table("events").select(F.col("ts").alias("retrieved_at"))
    return aggregates.recent_count(events, i.event_as_of)


@query(
    "total_population",
    f"SELECT CAST(coalesce(sum(population), 0) AS BIGINT) AS population FROM (SELECT max(rank_position) AS population FROM ranking GROUP BY server_name)",
)
def _(i):
    return aggregates.total_population(i.ranking.groupBy("server_name").agg(F.max("rank_position").alias("population")))


@query(
    "choose_total",
    """SELECT date, coalesce(CASE WHEN from_servers > 0 THEN from_servers END, CASE WHEN stored > 0 THEN stored END, from_classes) AS total
       FROM (SELECT date,
               CAST(sum(population) FILTER (server_name <> 'all' AND class_name = 'all' AND month(date) > 4) AS BIGINT) AS from_servers,
               CAST(sum(population) FILTER (server_name = 'all' AND class_name = 'all' AND month(date) > 2) AS BIGINT) AS stored,
               CAST(sum(population) FILTER (server_name = 'all' AND class_name <> 'all') AS BIGINT) AS from_classes
             FROM snapshots GROUP BY date)""",
)
def _(i):
    server_all, class_all = F.col("server_name") == "all", F.col("class_name") == "all"

    def total(condition):
        return F.sum(F.when(condition, F.col("population")))

    per_date = i.snapshots.groupBy("date").agg(
        total(~server_all & class_all & (F.month("date") > 4)).alias("from_servers"),
        total(server_all & class_all & (F.month("date") > 2)).alias("stored"),
        total(server_all & ~class_all).alias("from_classes"),
    )
    chosen = aggregates.choose_total(F.col("from_servers"), F.col("stored"), F.col("from_classes"))
    return per_date.select("date", chosen.alias("total"))


TOTAL = "(SELECT CAST(sum(m) AS BIGINT) AS total FROM (SELECT max(rank_position) AS m FROM ranking GROUP BY server_name))"
SHARES = f"""
    SELECT class_name, {half_even('population * total', 's')} AS population,
           {half_even('population * 10000', 's')} / 100.0 AS percentage, total AS total_population
    FROM (SELECT class_name, CAST(population AS HUGEINT) AS population, sum(population) OVER () AS s FROM {CLASSES}), {TOTAL}"""


def shares(i):
    classes = settle(class_counts(i))
    total = i.ranking.groupBy("server_name").agg(F.max("rank_position").alias("population"))
    return aggregates.class_share(classes, aggregates.total_population(total).scalar())


@query("class_share", SHARES)
def _(i):
    return shares(i)


@query(
    "crawl_totals",
    """SELECT CASE WHEN grouping(server_name) = 1 THEN 'all' ELSE server_name END AS server_name, count(*) AS collected,
              count(*) FILTER (outcome <> 'pending') AS flushed, count(*) - count(*) FILTER (outcome <> 'pending') AS pending
       FROM activity GROUP BY ROLLUP (server_name)""",
)
def _(i):
    return aggregates.crawl_totals(i.activity)


@query(
    "throughput",
    """SELECT items, remaining, batches, elapsed_seconds,
              CASE WHEN elapsed_seconds > 0 THEN items / elapsed_seconds ELSE 0.0 END AS items_per_second,
              batch_seconds / batches AS mean_batch_seconds,
              CASE WHEN elapsed_seconds > 0 THEN remaining / (items / elapsed_seconds) ELSE 0.0 END AS remaining_seconds
       FROM (SELECT CAST(sum(n) AS BIGINT) AS items, CAST(sum(o) AS BIGINT) AS remaining, count(*) AS batches,
                    CAST(epoch(max(t1)) - epoch(min(t0)) AS BIGINT) AS elapsed_seconds,
                    CAST(sum(epoch(t1) - epoch(t0)) AS BIGINT) AS batch_seconds
             FROM (SELECT batch_id, count(*) AS n, count(*) FILTER (outcome = 'pending') AS o,
                          min(logged_at) AS t0, max(logged_at) AS t1 FROM activity GROUP BY batch_id))""",
)
def _(i):
    return aggregates.throughput(i.activity)


@query("list_fingerprint", "SELECT * FROM versions")
def _(i):
    return page_source.list_fingerprints(i.list_pages)


@query(
    "complete_types",
    """SELECT server_name, character_name, count(DISTINCT div) = 3 AS all_present, count(DISTINCT div) = 0 AS none_present
       FROM ranking GROUP BY ALL""",
)
def _(i):
    return aggregates.complete_types(i.ranking)


@query(
    "pivot_rank_types",
    "SELECT server_name, character_name, "
    + ", ".join(
        f"max({v}) FILTER (div = {d}) AS {v}_{d}" for d in (1, 2, 3) for v in ("rank_position", "power_value")
    )
    + " FROM ranking GROUP BY ALL",
)
def _(i):
    return aggregates.pivot_rank_types(i.ranking)


@query(
    "worker_totals",
    """SELECT CASE WHEN grouping(worker_id) = 1 THEN 'all' ELSE worker_id END AS worker_id,
              count(*) FILTER (outcome = 'saved') AS processed, count(*) FILTER (outcome = 'failed') AS failed
       FROM activity GROUP BY ROLLUP (worker_id)""",
)
def _(i):
    return aggregates.worker_totals(i.activity)


@query(
    "log_level_counts",
    "SELECT count(*) FILTER (contains(line, 'ERROR')) AS errors, count(*) FILTER (contains(line, 'WARNING')) AS warnings FROM log_lines",
)
def _(i):
    return aggregates.log_level_counts(i.log_lines)


@query(
    "page_yield",
    """SELECT page_seq, count(*) AS rows_found, count(*) FILTER (rn = 1 AND character <> '') AS new_rows
       FROM (SELECT page_seq, character, row_number() OVER (PARTITION BY character ORDER BY page_seq, pos) AS rn FROM scraped)
       GROUP BY page_seq""",
)
def _(i):
    return aggregates.page_yield(i.scraped, windows.first_seen(i.scraped))


@query(
    "batch_success_rate",
    f"""SELECT batch_id, attempted, succeeded, CASE WHEN attempted > 0 THEN {half_even('succeeded * 10000', 'attempted')} / 100.0 ELSE 0.0 END AS success_rate
        FROM (SELECT batch_id, count(*) FILTER (outcome <> 'pending') AS attempted, count(*) FILTER (outcome = 'saved') AS succeeded
              FROM activity GROUP BY batch_id)""",
)
def _(i):
    return aggregates.batch_success_rate(i.activity)


ALERT = """
    SELECT count(*) AS timed_out,
           (SELECT coalesce(string_agg(request_id, ', ' ORDER BY request_id), '') FROM (SELECT request_id FROM late ORDER BY request_id LIMIT 5))
           || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS ids,
           CASE WHEN count(*) > 3 THEN 'error' WHEN count(*) > 0 THEN 'warning' ELSE 'none' END AS severity FROM late"""
LATE = "late AS (SELECT request_id FROM requests, event_now WHERE status = 'processing' AND started_at < as_of - INTERVAL 600 SECOND)"


@query("timeout_alert", f"WITH {LATE} {ALERT}")
def _(i):
    return aggregates.timeout_alert(i.requests.filter(mutations.timed_out(i.event_as_of)))


@query("axis_limit", f"SELECT max(m) * 1.2::DOUBLE AS axis_limit FROM (SELECT max(rank_position) AS m FROM ranking GROUP BY server_name)")
def _(i):
    bottoms = i.ranking.groupBy("server_name").agg(F.max("rank_position").alias("population"))
    return aggregates.axis_limit(bottoms)


@query(
    "rank_type_document",
    """SELECT k.server_name, k.character_name, t.rank_type, count(r.div) AS rows, max(rank_position) AS rank_position,
              max(power_value) AS power_value, max(change_amount) AS change_amount, max(change_type) AS change_type,
              max(class_name) AS class_name, max(retrieved_at) AS retrieved_at
       FROM (SELECT DISTINCT server_name, character_name FROM ranking) k
       CROSS JOIN (VALUES (1, '@RANK_TYPE_NAMES.1@'), (2, '@RANK_TYPE_NAMES.2@'), (3, '@RANK_TYPE_NAMES.3@')) t(div, rank_type)
       LEFT JOIN ranking r ON r.server_name = k.server_name AND r.character_name = k.character_name AND r.div = t.div
       GROUP BY ALL""",
)
def _(i):
    """The entries of the nested document, one row per rank type, empty lists included."""
    entries = aggregates.rank_type_document(i.ranking).select("server_name", "character_name", F.explode("rankings").alias("rank_type", "data"))
    row = F.get("data", F.lit(0))
    fields = ["rank_position", "power_value", "change_amount", "change_type", "class_name", "retrieved_at"]
    return entries.select(
        "server_name", "character_name", "rank_type", F.size("data").cast("bigint").alias("rows"), *[row[c].alias(c) for c in fields]
    )
