"""Streams with built-in aggregation. Event times are instants; local days start at 15:00 UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn
from rankmill.operators.windows import distinct_on_key
from rankmill.schemas import RANKING_KEY
from rankmill.streaming import runner

NEWEST = ("retrieved_at", "obs_id")


def newest_first():
    return [F.desc(c) for c in NEWEST]


def _upsert_order(arrival_wins: bool):
    return [F.desc("batch"), *newest_first()] if arrival_wins else newest_first()


def stream_upsert(observations: DataFrame, root: str, trigger: dict, *, arrival_wins: bool = False, fold_every: int = runner.FOLD_EVERY):
    """Upserts micro-batches: the newest row of a key per batch is kept.

    Event time decides across batches, so a late older row does not overwrite; with `arrival_wins` the later
    batch wins whatever its times are.
    """

    def newest(batch: DataFrame) -> DataFrame:
        return distinct_on_key(batch, RANKING_KEY, newest_first())

    order = _upsert_order(arrival_wins)
    return runner.start_batches(
        observations, root, trigger, "append", newest, keys=RANKING_KEY, order_by=order, fold_every=fold_every
    )


def upserted_state(spark, root: str, schema, arrival_wins: bool = False) -> DataFrame:
    """State after the stream, by the rule it was started with."""
    return runner.latest_rows(spark, root, schema, RANKING_KEY, _upsert_order(arrival_wins))


def stream_latest(observations: DataFrame) -> DataFrame:
    """Current value per key, continuously (update mode)."""
    others = [c for c in observations.columns if c not in RANKING_KEY]
    newest = F.max_by(F.struct(*others), F.struct(*NEWEST)).alias("row")
    return observations.groupBy(*RANKING_KEY).agg(newest).select(*RANKING_KEY, "row.*")


def stream_hourly_volume(rows: DataFrame, watermark: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Rows of the last hour, refreshed every `slide` (append mode; rows need event_time)."""
    windows = rows.withWatermark("event_time", watermark).groupBy(F.window("event_time", "1 hour", slide))
    return _local_window(windows.agg(F.count(F.lit(1)).alias("rows")))


def stream_daily_snapshot(rows: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Counts per local day, server and class (append mode)."""
    day = F.window("event_time", "1 day", "1 day", "15 hours")
    counted = rows.withWatermark("event_time", watermark).groupBy(day, "server_name", "class_name")
    snapshot = counted.agg(F.count(F.lit(1)).alias("population"))
    return snapshot.select(
        F.to_date(fn.wall_clock_of(F.col("window.start"))).alias("date"), "server_name", "class_name", "population"
    )


def stream_status_counts(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Requests by status per local day (append mode)."""
    day = F.window("event_time", "1 day", "1 day", "15 hours")
    counted = requests.withWatermark("event_time", watermark).groupBy(day, "status")
    return counted.agg(F.count(F.lit(1)).alias("requests")).select(
        F.to_date(fn.wall_clock_of(F.col("window.start"))).alias("date"), "status", "requests"
    )


def stream_crawl_totals(activity: DataFrame) -> DataFrame:
    """Running totals per server (update mode)."""
    done = F.col("outcome") != "pending"
    return activity.groupBy("server_name").agg(
        F.count(F.lit(1)).alias("collected"),
        F.count_if(done).alias("flushed"),
        F.count_if(~done).alias("pending"),
    )


def _local_window(frame: DataFrame) -> DataFrame:
    return frame.select(
        fn.wall_clock_of(F.col("window.start")).alias("window_start"),
        fn.wall_clock_of(F.col("window.end")).alias("window_end"),
        *[c for c in frame.columns if c != "window"],
    )
