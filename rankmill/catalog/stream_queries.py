"""Streams over all available input, compared with the batch form of the same question."""

from pyspark.sql import functions as F

from rankmill import views
from rankmill.catalog.mutation_queries import DEDUP
from rankmill.catalog.registry import query
from rankmill.schemas import RANKING_KEY
from rankmill.session import work_path
from rankmill.sources import pages as page_source
from rankmill.streaming import aggregates, runner, stateful


SLICES = 3
SLICED_BY = {"orders": "o_orderdate", "events": "ts", "pages": "page_id"}


def stream_of(i, name: str):
    """The table as a stream of SLICES micro-batches in the order of its time; rows without a time come first.

    All slices are written as equally many files, as many as the poorest slice has partitions with rows, so a trigger
    takes one slice. What a slice lacks of that is filled up with empty files.
    """
    column, rows = SLICED_BY[name], i.table(name)
    low, high = rows.agg(F.min(column), F.max(column)).first()
    root = work_path(i.spark, f"slices-{name}")
    cuts = [low + (high - low) / SLICES * k for k in range(1, SLICES)] if low is not None else []
    number = F.lit(0)
    for cut in cuts:
        number = number + F.coalesce((F.col(column) > F.lit(cut)).cast("int"), F.lit(0))
    placed = rows.select(number.alias("slice"), F.spark_partition_id().alias("part"))
    filled = placed.groupBy("slice").agg(F.count_distinct("part")).collect()
    files = min((n for _, n in filled), default=1)
    for k in range(len(cuts) + 1):
        part = rows.where(number == k)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.parquet(f"{root}/{k}")
        for _ in range(files - len(i.spark.read.schema(rows.schema).parquet(f"{root}/{k}").inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(f"{root}/{k}")
    reader = i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{root}/*")


def observed(i):
    return views.observe(stream_of(i, "orders"), i.characters)


def requested(i):
    return views.as_requests(stream_of(i, "events"))


@query("stream_upsert", "SELECT * FROM ranking")
def _(i):
    stream = observed(i)
    root = work_path(i.spark, "stream_upsert")
    runner.finish(aggregates.stream_upsert(stream, root, runner.AVAILABLE_NOW))
    return aggregates.upserted_state(i.spark, root, stream.schema).drop("obs_id")


@query("stream_latest", "SELECT * FROM ranking")
def _(i):
    return runner.collect_latest(aggregates.stream_latest(observed(i)), "stream_latest", RANKING_KEY).drop("obs_id")


@query("stream_dedup_requests", (DEDUP % "5 minutes").replace("q.*", "q.request_id"))
def _(i):
    return stateful.collect_rows(
        stateful.stream_dedup_requests, requested(i), "stream_dedup_requests", "request_id string"
    )


@query(
    "stream_timeouts",
    """SELECT request_id, started_at FROM requests,
              (SELECT greatest(max(started_at), max(completed_at) FILTER (started_at IS NOT NULL)) AS m FROM requests)
       WHERE started_at IS NOT NULL AND epoch_ms(started_at) + 600000 < epoch_ms(m)
         AND (completed_at IS NULL OR epoch_ms(completed_at) > epoch_ms(started_at) + 600000)""",
)
def _(i):
    transitions = stateful.start_and_end_events(requested(i))
    return stateful.collect_rows(stateful.stream_timeouts, transitions, "stream_timeouts", stateful.TIMED_OUT)


@query(
    "stream_request_lifecycle",
    """SELECT request_id,
              CASE WHEN attempt AND retry_count < max_retries THEN 'pending' ELSE status END AS status,
              CAST(CASE WHEN attempt THEN retry_count + 1 ELSE retry_count END AS INTEGER) AS retry_count,
              CAST(1 + CASE WHEN started_at IS NOT NULL THEN 1 ELSE 0 END
                     + CASE WHEN status IN ('completed', 'failed', 'timeout') THEN 1 ELSE 0 END AS INTEGER) AS steps
       FROM (SELECT *, status = 'failed' AND completed_at IS NULL AS attempt FROM requests)""",
)
def _(i):
    lifecycle = views.with_event_time(stateful.lifecycle_events(requested(i)), "at")
    states = stateful.stream_request_lifecycle(lifecycle)
    return runner.collect_latest(states, "stream_request_lifecycle", ["request_id"])


@query(
    "stream_hourly_volume",
    """SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS rows
       FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS s
             FROM events), event_now
       GROUP BY s, as_of HAVING s + INTERVAL 1 HOUR <= as_of - INTERVAL 10 MINUTE""",
)
def _(i):
    events = views.with_event_time(stream_of(i, "events"), "ts")
    return runner.collect_append(aggregates.stream_hourly_volume(events), "stream_hourly_volume")


@query(
    "stream_daily_snapshot",
    """SELECT date, server_name, class_name, count(*) AS population
       FROM (SELECT CAST(retrieved_at AS DATE) AS date, server_name, class_name FROM obs), now_at
       WHERE date + INTERVAL 1 DAY <= as_of - INTERVAL 1 HOUR GROUP BY date, server_name, class_name""",
)
def _(i):
    rows = views.with_event_time(observed(i), "retrieved_at")
    return runner.collect_append(aggregates.stream_daily_snapshot(rows), "stream_daily_snapshot")


@query(
    "stream_status_counts",
    """SELECT date, status, count(*) AS requests FROM (SELECT CAST(created_at AS DATE) AS date, status FROM requests), event_now
       WHERE date + INTERVAL 1 DAY <= as_of - INTERVAL 1 HOUR GROUP BY date, status""",
)
def _(i):
    requests = views.with_event_time(requested(i), "created_at")
    return runner.collect_append(aggregates.stream_status_counts(requests), "stream_status_counts")


@query(
    "stream_fingerprint_change",
    """SELECT list_key, page_id, fingerprint FROM versions
       QUALIFY coalesce(fingerprint <> lag(fingerprint) OVER (PARTITION BY list_key ORDER BY page_id), true)""",
)
def _(i):
    pages = stream_of(i, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("list_key"), "page_id", "html"
    )
    versions = page_source.list_fingerprints(pages)
    columns = "list_key string, page_id bigint, fingerprint string"
    return stateful.collect_rows(
        stateful.stream_fingerprint_change, versions, "stream_fingerprint_change", columns
    )


@query(
    "stream_crawl_totals",
    """SELECT server_name, count(*) AS collected, count(*) FILTER (outcome <> 'pending') AS flushed,
              count(*) FILTER (outcome = 'pending') AS pending FROM activity GROUP BY server_name""",
)
def _(i):
    totals = aggregates.stream_crawl_totals(views.observe_activity(stream_of(i, "orders"), i.characters))
    return runner.collect_latest(totals, "stream_crawl_totals", ["server_name"])
