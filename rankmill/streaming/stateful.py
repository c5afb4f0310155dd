"""Streams over keyed histories.

A request's life cycle is an aggregate that Spark keeps in its own state. De-duplication, time-outs and change detection
depend on rows that came before; they run batch operators on every micro-batch, so a hot key is split exactly as in
the batch form, and no group is handed to one Python worker.

What later batches need is in the tables that the batches append to: `<kind>/batch=N/day=D`. A batch writes its own
folders only (a repeated one overwrites them) and reads of the others' the days that its time span touches, so what it
reads and writes follows the batch and the span, not the length of the stream. `clock/batch=N` holds the newest time seen;
the two last ones stay. Tables settled inside a batch are removed at its end.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankmill import fixed_values as fv
from rankmill.operators.joins import open_request_within
from rankmill.operators.mutations import enqueue_dedup
from rankmill.operators.windows import fingerprint_changed
from rankmill.schemas import LAST_FINGERPRINT, REQUEST_KEY
from rankmill.session import remove, settle, settled_scope, work_path
from rankmill.sources.keyed_state import merge_state, path_exists, read_state
from rankmill.streaming import runner

LATENESS_SECONDS = 24 * 3600


def append_batch(rows: DataFrame, root: str, kind: str, batch_id: int, time: str | None = None) -> None:
    """Writes a batch's rows; with `time` by the day of that column, so later batches read only the days they need."""
    if time is None:
        rows.write.mode("overwrite").parquet(f"{root}/{kind}/batch={batch_id}")
        return
    rows = rows.withColumn("day", F.to_date(time))
    rows.write.partitionBy("day").mode("overwrite").parquet(f"{root}/{kind}/batch={batch_id}")


def read_batches(
    spark: SparkSession, root: str, kind: str, columns: str, time: str, first: datetime, last: datetime, upto: int
) -> DataFrame:
    """Rows of the batches up to `upto` whose time is from `first` to `last` (both included); other days are not opened."""
    if not path_exists(spark, f"{root}/{kind}"):
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(f"{columns}, batch bigint, day date").parquet(f"{root}/{kind}")
    names = [field.name for field in rows.schema.fields[:-2]]
    days = F.col("day").between(F.lit(first.date()), F.lit(last.date()))
    inside = F.col(time).between(F.lit(first), F.lit(last))
    return rows.where(days & inside & (F.col("batch") <= upto)).select(*names)


def read_clock(spark: SparkSession, root: str, batch_id: int) -> datetime | None:
    """The newest time that the batches before this one have seen."""
    if not path_exists(spark, f"{root}/clock"):
        return None
    rows = spark.read.schema("newest timestamp_ntz, batch bigint").parquet(f"{root}/clock")
    return rows.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]


def set_clock(spark: SparkSession, root: str, batch_id: int, newest: datetime | None) -> None:
    clock = spark.createDataFrame([(newest,)], "newest timestamp_ntz").coalesce(1)
    append_batch(clock, root, "clock", batch_id)
    remove(spark, f"{root}/clock/batch={batch_id - 2}")


def stream_dedup_requests(
    requests: DataFrame,
    root: str,
    trigger: dict,
    window: int = fv.DEDUP_SECONDS,
    lateness: int = LATENESS_SECONDS,
) -> StreamingQuery:
    """Writes the kept requests to `rows`; the kept open ones of the last `lateness` seconds judge later batches.

    A request with a kept open one of its key less than `window` before it is
    dropped, however late it comes; the others are decided among themselves. A
    request older than that span before the newest kept open one cannot be judged: it goes to `late`.
    """
    columns = "server string, character_name string, request_id string, status string, created_at timestamp_ntz"

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with settled_scope(spark):
            rows = settle(batch.select(*REQUEST_KEY, "request_id", "status", "created_at"))
            newest = read_clock(spark, root, batch_id)
            undecided, too_late = rows, rows.limit(0)
            if newest is not None:
                first = newest - timedelta(seconds=lateness)
                is_late = F.coalesce(F.col("created_at") < F.lit(first), F.lit(False))
                judged, too_late = rows.where(~is_late), rows.where(is_late)
                # no kept open request is newer than `newest`, so later rows than this have none before them
                near = judged.where(F.col("created_at") < F.lit(newest + timedelta(seconds=window)))
                oldest = near.agg(F.min("created_at")).first()[0]
                if oldest is None:
                    undecided = judged
                else:
                    reach = oldest - timedelta(seconds=window)
                    before = read_batches(spark, root, "rows", columns, "created_at", reach, newest, batch_id - 1)
                    before = before.where(F.col("status").isin(*fv.OPEN_STATUSES))
                    blocked = open_request_within(near, before, window).filter("open_request_id is not null")
                    # read many times below
                    undecided = settle(judged.join(blocked.select("request_id"), "request_id", "left_anti").select(rows.columns))
            kept = settle(enqueue_dedup(undecided, window))
            opened = kept.where(F.col("status").isin(*fv.OPEN_STATUSES)).agg(F.max("created_at")).first()[0]
            append_batch(too_late, root, "late", batch_id)
            append_batch(kept, root, "rows", batch_id, "created_at")
            set_clock(spark, root, batch_id, max((x for x in (newest, opened) if x is not None), default=None))

    return runner.start_steps(requests, root, trigger, decide)


TIMED_OUT = "request_id string, started_at timestamp_ntz"


def stream_timeouts(
    transitions: DataFrame,
    root: str,
    trigger: dict,
    limit: int = fv.PROCESSING_SECONDS,
    lateness: int = LATENESS_SECONDS,
) -> StreamingQuery:
    """Writes requests that didn't end within the limit after their start to `rows`, as soon as the newest time seen is past it.

    transitions: request_id, kind ('start' or 'end'), at. A start is judged once: in the batch whose newest time passes
    its limit, or in its own batch if it comes after that. To `late` go what no verdict can follow any more: starts that come
    more than `lateness` seconds after newer rows, and ends in time of requests that have been judged without them.
    """
    columns = "request_id string, at timestamp_ntz"
    span = timedelta(seconds=limit)

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with settled_scope(spark):
            rows = settle(batch.select("request_id", "kind", "at").where("at IS NOT NULL"))
            before = read_clock(spark, root, batch_id)
            own = rows.agg(F.max("at")).first()[0]
            now = max((x for x in (before, own) if x is not None), default=None)
            starts = rows.where("kind = 'start'").select("request_id", "at")
            ends = rows.where("kind = 'end'").select("request_id", "at")
            append_batch(starts, root, "starts", batch_id, "at")
            append_batch(ends, root, "ends", batch_id, "at")
            late = starts.limit(0).withColumn("kind", F.lit("start"))
            due = starts
            if before is not None:
                oldest = before - timedelta(seconds=lateness)
                passed = read_batches(spark, root, "starts", columns, "at", before - span, now - span, batch_id)
                overdue = starts.where((F.col("at") >= F.lit(oldest)) & (F.col("at") < F.lit(before - span)))
                due = passed.unionByName(overdue)
                late = starts.where((F.col("at") < F.lit(oldest)) & (F.col("at") < F.lit(before - span)))
                late = late.withColumn("kind", F.lit("start"))
            if now is not None:
                due = settle(due.where(F.col("at") < F.lit(now - span)))
                first, last = due.agg(F.min("at"), F.max("at")).first()
                if first is not None:
                    known = read_batches(spark, root, "ends", columns, "at", first, last + span, batch_id)
                    reach = F.expr(f"INTERVAL {int(limit)} SECONDS")
                    in_time = (
                        (F.col("s.request_id") == F.col("e.request_id"))
                        & (F.col("e.at") >= F.col("s.at"))
                        & (F.col("e.at") <= F.col("s.at") + reach)
                    )
                    due = due.alias("s").join(known.alias("e"), in_time, "left_anti")
            if before is not None:
                first = ends.agg(F.min("at")).first()[0]
                if first is not None and first <= before:  # some of these may have been waited for
                    judged = read_batches(spark, root, "rows", TIMED_OUT, "started_at", first - span, before, batch_id - 1)
                    waited = (
                        (F.col("e.request_id") == F.col("j.request_id"))
                        & (F.col("e.at") >= F.col("j.started_at"))
                        & (F.col("e.at") <= F.col("j.started_at") + F.expr(f"INTERVAL {int(limit)} SECONDS"))
                    )
                    missed = ends.alias("e").join(judged.alias("j"), waited, "left_semi")
                    late = late.unionByName(missed.withColumn("kind", F.lit("end")))
            append_batch(late, root, "late", batch_id)
            append_batch(due.select("request_id", F.col("at").alias("started_at")), root, "rows", batch_id, "started_at")
            set_clock(spark, root, batch_id, now)

    return runner.start_steps(transitions, root, trigger, decide)


def start_and_end_events(requests: DataFrame) -> DataFrame:
    """(request_id, kind, at): when processing started, and when a started request ended."""
    kinds = F.array(
        F.struct(F.lit("start").alias("kind"), F.col("started_at").alias("at")),
        F.struct(F.lit("end").alias("kind"), F.col("completed_at").alias("at")),
    )
    rows = requests.where("started_at IS NOT NULL").select("request_id", F.explode(kinds).alias("s"))
    return rows.select("request_id", "s.*").where("at IS NOT NULL")


def stream_fingerprint_change(versions: DataFrame, root: str, trigger: dict) -> StreamingQuery:
    """Writes list versions whose fingerprint differs from the one before; the last one of each list is kept in buckets.

    A batch rewrites the buckets of its own lists. A kept row knows the fingerprint before its batch too, so
    a repeated batch judges by that.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with settled_scope(spark):
            rows = settle(fingerprint_changed(batch, ["list_key"], "page_id"))
            kept = read_state(spark, f"{root}/last", LAST_FINGERPRINT)
            seen = F.when(F.col("batch") < batch_id, F.col("last_seen")).otherwise(F.col("seen_before"))
            kept = kept.select("list_key", seen.alias("seen"))
            ends = rows.groupBy("list_key").agg(F.max_by("fingerprint", "page_id").alias("last_seen"))
            ends = settle(
                ends.join(kept, "list_key", "left").select(
                    "list_key", "last_seen", F.col("seen").alias("seen_before"), F.lit(batch_id).cast("long").alias("batch")
                )
            )
            known = ends.select("list_key", F.col("seen_before"))
            before = F.coalesce("previous", "seen_before")
            changed = rows.join(known, "list_key", "left").filter(~F.col("fingerprint").eqNullSafe(before))
            append_batch(changed.select("list_key", "page_id", "fingerprint"), root, "rows", batch_id)
            merge_state(
                ends, f"{root}/last", schema=LAST_FINGERPRINT, keys=["list_key"], order_by=[F.lit(0)], buckets=16
            )

    return runner.start_steps(versions, root, trigger, decide)


def collect_rows(start: Callable[..., StreamingQuery], frame: DataFrame, label: str, columns: str) -> DataFrame:
    """Runs one of the streams above over all available input and reads what it wrote."""
    spark = frame.sparkSession
    root = work_path(spark, label)
    runner.finish(start(frame, root, runner.AVAILABLE_NOW))
    if not path_exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(f"{columns}, batch bigint").parquet(f"{root}/rows")
    return rows.select(*spark.createDataFrame([], columns).columns)


def stream_request_lifecycle(lifecycle: DataFrame) -> DataFrame:
    """Current state of every request, continuously (update mode).

    Spark keeps one row per request, open or closed: a closed one must know all later transitions as late ones, however late, so it
    never expires. A transition that comes out of order counts at its own time.
    """
    return request_states(lifecycle)


def request_states(lifecycle: DataFrame) -> DataFrame:
    """State per request after its transitions.

    The first closing transition decides; before it the latest one does. A
    failed attempt goes back to pending while retries are left, else it fails.
    """
    at = F.struct("event_time", "step")
    closing = F.col("state").isin(*fv.CLOSED_STATUSES)
    attempt = F.col("state") == "attempt_failed"
    history = (
        lifecycle.groupBy("request_id")
        .agg(
            F.min_by(F.when(closing, F.col("state")), F.when(closing, at)).alias("closed"),
            F.max_by("state", at).alias("latest"),
            F.min_by("retry_count", at).alias("tried"),
            F.max("max_retries").alias("most"),
            F.count_if(attempt).cast("int").alias("attempts"),
            F.count(F.lit(1)).cast("int").alias("steps"),
        )
    )
    again = F.when(F.col("tried") + F.col("attempts") - 1 < F.col("most"), "pending").otherwise("failed")
    latest = F.when(F.col("latest") == "attempt_failed", again).otherwise(F.col("latest"))
    return history.select(
        "request_id",
        F.coalesce("closed", latest).alias("status"),
        (F.col("tried") + F.col("attempts")).alias("retry_count"),
        "steps",
    )


def lifecycle_events(requests: DataFrame) -> DataFrame:
    """Request records as the transitions they went through: (request_id, step, state, at, retry counts)."""
    status = F.col("status")
    retried_out = (status == "failed") & F.col("completed_at").isNull()
    second = F.col("created_at") + F.expr("INTERVAL 1 SECOND")
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("pending").alias("state"), F.col("created_at").alias("at")),
        F.struct(F.lit(2).alias("step"), F.lit("processing").alias("state"), F.col("started_at").alias("at")),
        F.struct(
            F.lit(3).alias("step"),
            F.when(retried_out, "attempt_failed").otherwise(status).alias("state"),
            F.when(retried_out, second).when(status.isin(*fv.CLOSED_STATUSES), F.col("completed_at")).alias("at"),
        ),
    )
    rows = requests.select("request_id", "retry_count", "max_retries", F.explode(steps).alias("s"))
    return rows.select("request_id", "retry_count", "max_retries", "s.*").filter("at is not null")
