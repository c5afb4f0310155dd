"""Table mutations as pure functions: state and changes in, new state out.

Plain parquet has no MERGE, so a mutation never edits in place. Changes are
reduced to one row per key and settled first: they are computed once, and their
size is known when the join is planned, so a small set of changes is broadcast
and the state passes through without a shuffle, a sort or a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn
from rankmill.operators.joins import nearest_request, open_request_within
from rankmill.operators.windows import first_per_key
from rankmill.schemas import CHARACTER_KEY, RANKING_KEY, REQUEST_KEY
from rankmill.session import settle


def upsert_latest(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str] = RANKING_KEY,
    *,
    order_by: Sequence[Column],
    event_time: str | None = None,
) -> DataFrame:
    """Insert or overwrite by key.

    Arrival wins by default: a changed key takes the change that is first in
    `order_by`, whatever the state holds. With `event_time` the newer row wins
    and the change wins ties, so a late older row does not overwrite.
    """
    newest = settle(first_per_key(changes, keys, order_by).select(state.columns))
    return with_changes(state, newest, keys, event_time)


def with_changes(state: DataFrame, newest: DataFrame, keys: Sequence[str], event_time: str | None = None) -> DataFrame:
    """State after settled changes, one for each key."""
    if event_time is None:
        return absent(state, newest, keys).unionByName(newest)
    # changes older than the state are few and told by its keys and times alone; all others win as they arrive
    old, new = state.alias("old"), newest.alias("new")
    older = F.col(f"new.{event_time}").isNull() | (F.col(f"new.{event_time}") < F.col(f"old.{event_time}"))
    older = older & F.col(f"old.{event_time}").isNotNull()
    losers = old.join(new, same_key(keys, "old", "new")).filter(older).select(*[F.col(f"new.{key}") for key in keys])
    winners = settle(absent(newest, losers, keys))
    return absent(state, winners, keys).unionByName(winners)


def same_key(keys: Sequence[str], left: str, right: str) -> Column:
    """Equal keys; a null is a value of its own, as it is in grouping."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def absent(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key `other` does not have."""
    return rows.alias("l").join(other.alias("r"), same_key(keys, "l", "r"), "left_anti")


def present(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key `other` has."""
    return rows.alias("l").join(other.alias("r"), same_key(keys, "l", "r"), "left_semi")


def by_all_columns(frame: DataFrame, keys: Sequence[str]) -> list[Column]:
    """An order that depends on the rows alone: the other columns one after another, nulls last."""
    return [F.col(f"`{c}`").asc_nulls_last() for c in frame.columns if c not in keys] or [F.lit(0)]


def insert_if_absent(
    state: DataFrame, rows: DataFrame, keys: Sequence[str], order_by: Sequence[Column] | None = None
) -> DataFrame:
    """Only rows whose key is not there yet are added: the first run wins.

    Of several rows of one key the first in `order_by` is added, by default the
    first by all its columns.
    """
    new = absent(first_per_key(rows, keys, order_by or by_all_columns(rows, keys)), state.select(*keys), keys)
    return state.unionByName(new.select(state.columns))


def delete_key(state: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(state without the keys, number of rows deleted)."""
    unique = settle(doomed.select(*keys).distinct())
    left = state.join(unique, list(keys), "left_anti").select(state.columns)
    gone = state.join(unique, list(keys), "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return left, gone


def deleted_names(state: DataFrame, doomed: DataFrame) -> DataFrame:
    """Audit view of a delete: per name how many rows (rank types) go."""
    unique = doomed.select(*CHARACTER_KEY).distinct()
    return state.join(unique, CHARACTER_KEY, "left_semi").groupBy(*CHARACTER_KEY).agg(
        F.count(F.lit(1)).alias("count")
    )


def _update(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    order_by: Sequence[Column] | None = None,
) -> DataFrame:
    """Left join with one change per key; `columns` are evaluated where a change exists.

    Of several changes of one key the first in `order_by` counts, by default the
    first by all its columns, so a state row never doubles.
    """
    changes = first_per_key(changes, keys, order_by or by_all_columns(changes, keys))
    marked = changes.withColumn("_hit", F.lit(True))
    renamed = marked.select(*keys, *[F.col(c).alias(f"new_{c}") for c in marked.columns if c not in keys])
    joined = state.join(settle(renamed), list(keys), "left")
    hit = F.col("new__hit")
    return joined.select(
        *[
            F.when(hit, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in state.columns
        ]
    )


def update_by_key(
    state: DataFrame, changes: DataFrame, *, as_of: datetime | Column, order_by: Sequence[Column]
) -> DataFrame:
    """Existing rows of (server, character) take the new values, all rank types alike; nothing is inserted."""
    newest = first_per_key(changes, CHARACTER_KEY, order_by)
    values = ["rank_position", "change_amount", "change_type", "class_name", "power_value"]
    columns = {c: F.col(f"new_{c}") for c in values}
    columns["retrieved_at"] = fn.moment(as_of)
    return _update(state, newest.select(*CHARACTER_KEY, *values), CHARACTER_KEY, columns)


def claim_request(requests: DataFrame, chosen: DataFrame, *, as_of: datetime | Column) -> DataFrame:
    """The chosen requests become processing, if they are still pending."""
    pending = F.col("status") == "pending"
    return _update(
        requests,
        chosen.select("request_id").distinct(),
        ["request_id"],
        {
            "status": F.when(pending, "processing").otherwise(F.col("status")),
            "started_at": F.when(pending, fn.moment(as_of)).otherwise(F.col("started_at")),
        },
    )


def complete_request(
    requests: DataFrame, results: DataFrame, *, as_of: datetime | Column, order_by: Sequence[Column] | None = None
) -> DataFrame:
    """Finished requests with their result (text or a struct, stored as JSON); of several the first in `order_by`."""
    is_text = dict(results.dtypes)["result"] == "string"
    stored = results if is_text else results.withColumn("result", F.to_json("result"))
    stored = first_per_key(stored, ["request_id"], order_by or [F.col("result").asc_nulls_last()])
    return _update(
        requests,
        stored.select("request_id", "result"),
        ["request_id"],
        {"status": F.lit("completed"), "completed_at": fn.moment(as_of), "result": F.col("new_result")},
    )


def fail_or_retry(
    requests: DataFrame, failures: DataFrame, *, as_of: datetime | Column, order_by: Sequence[Column] | None = None
) -> DataFrame:
    """Failures carry request_id, error_message, retry and not_found.

    Retry: pending while the old retry count is below the maximum, else failed,
    without an end time. No retry: failed with an end time. Not found is an
    answer: completed. Of several failures of one request the first in `order_by` counts.
    """
    tried = F.col("retry_count")
    retry, not_found = F.col("new_retry"), F.col("new_not_found")
    answer = F.to_json(
        F.struct(
            F.lit(False).alias("success"),
            F.col("new_error_message").alias("message"),
            F.lit("CHARACTER_NOT_FOUND").alias("error_code"),
            F.lit(False).alias("from_cache"),
        )
    )
    again = F.when(tried < F.col("max_retries"), "pending").otherwise("failed")
    ended = fn.moment(as_of)
    columns = ["request_id", "error_message", "retry", "not_found"]
    if order_by:
        failures = first_per_key(failures, ["request_id"], order_by)
    return _update(
        requests,
        failures.select(*columns),
        ["request_id"],
        {
            "status": F.when(not_found, "completed").when(retry, again).otherwise("failed"),
            "retry_count": F.when(retry & ~not_found, tried + 1).otherwise(tried),
            "error_message": F.when(not_found, F.col("error_message")).otherwise(F.col("new_error_message")),
            "started_at": F.when(retry & ~not_found, F.lit(None)).otherwise(F.col("started_at")),
            "completed_at": F.when(retry & ~not_found, F.col("completed_at")).otherwise(ended),
            "result": F.when(not_found, answer).otherwise(F.col("result")),
        },
    )


def timed_out(as_of: datetime | Column, limit: int = fv.PROCESSING_SECONDS) -> Column:
    over = F.col("started_at") < fn.moment(as_of) - fn.seconds(limit)
    return F.coalesce((F.col("status") == "processing") & over, F.lit(False))


def sweep_timeouts(
    requests: DataFrame, *, as_of: datetime | Column, limit: int = fv.PROCESSING_SECONDS
) -> DataFrame:
    """Processing for longer than the limit -> timeout; runs whether or not anything is pending."""
    late = timed_out(as_of, limit)
    return requests.withColumns(
        {
            "status": F.when(late, "timeout").otherwise(F.col("status")),
            "error_message": F.when(late, fv.TIMEOUT_MESSAGE).otherwise(F.col("error_message")),
            "completed_at": F.when(late, fn.moment(as_of)).otherwise(F.col("completed_at")),
        }
    )


def retention_delete(requests: DataFrame, *, as_of: datetime | Column, days: int = 7) -> DataFrame:
    """Drops closed requests that ended long ago; without an end time they stay."""
    old = F.col("status").isin(*fv.CLOSED_STATUSES) & (F.col("completed_at") < fn.moment(as_of) - fn.days(days))
    return requests.filter(~F.coalesce(old, F.lit(False)))


def tag_insert_update(
    state: DataFrame, changes: DataFrame, keys: Sequence[str] = RANKING_KEY
) -> tuple[DataFrame, DataFrame]:
    """(changes tagged INSERT or UPDATE, counts of successes and failures). A key with a null cannot be saved."""
    known = state.select(*keys).distinct().withColumn("_known", F.lit(True))
    bad = F.lit(False)
    for key in keys:
        bad = bad | F.col(key).isNull()
    tagged = changes.join(known, list(keys), "left").select(
        *[F.col(c) for c in changes.columns],
        F.when(bad, "FAILED").when(F.col("_known"), "UPDATE").otherwise("INSERT").alias("action"),
    )
    counts = tagged.agg(
        F.count_if(F.col("action") != "FAILED").alias("succeeded"),
        F.count_if(F.col("action") == "FAILED").alias("failed"),
    )
    return tagged, counts


def key_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with the rule they break."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter(missing | (F.col("rows") > 1)).withColumn(
        "rule", F.when(missing, "not_null").otherwise("unique")
    )


def patch_non_null(
    state: DataFrame,
    patch: DataFrame,
    keys: Sequence[str],
    *,
    as_of: datetime | Column,
    order_by: Sequence[Column] | None = None,
) -> DataFrame:
    """Only given (non-null) fields overwrite; the update time is stamped; no row is created.

    A patch without any given field changes nothing. Several patches of one key
    are taken together: of each field the first given value in `order_by`, by
    default in the order of all columns.
    """
    fields = [c for c in patch.columns if c in state.columns and c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order_by or by_all_columns(patch, keys))))
    numbered = patch.withColumn("_place", place)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_place"))).alias(c) for c in fields]
    patch = numbered.groupBy(*keys).agg(*first)
    given = F.lit(False)
    for c in fields:
        given = given | F.col(c).isNotNull()
    columns = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in fields}
    columns["last_update"] = fn.moment(as_of)
    return _update(state, patch.filter(given), keys, columns)


def seed_missing(state: DataFrame, known: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """One row per known key; existing rows stay as they are."""
    missing = known.select(key).distinct().join(state.select(key), key, "left_anti")
    filled = missing.select(
        *[
            F.col(c) if c == key else defaults.get(c, F.lit(None)).cast(state.schema[c].dataType).alias(c)
            for c in state.columns
        ]
    )
    return state.unionByName(filled)


def skip_if_fresh(
    changes: DataFrame, state: DataFrame, *, as_of: datetime | Column, ttl: int = fv.FRESH_SECONDS, force: bool = False
) -> DataFrame:
    """Changes with `from_cache`: true where fresh stored rows exist and the change is not applied."""
    if force:
        return changes.withColumn("from_cache", F.lit(False))
    fresh = state.filter(F.col("retrieved_at") > fn.moment(as_of) - fn.seconds(ttl))
    fresh = fresh.select(*RANKING_KEY).distinct().withColumn("_fresh", F.lit(True))
    joined = changes.join(fresh, RANKING_KEY, "left")
    return joined.select(*[F.col(c) for c in changes.columns], F.coalesce("_fresh", F.lit(False)).alias("from_cache"))


def enqueue_dedup(requests: DataFrame, window: int = fv.DEDUP_SECONDS) -> DataFrame:
    """Keeps a request unless a kept open request of its key lies less than `window` before it.

    A dropped request does not extend the window, so the rule is a walk along
    each key: from a kept open request to the first one at least `window` later.
    The walk is done for all keys at once and without putting a key's requests
    together:

    1. every open request finds its successor (first one >= window later), and
       those with no open request in the window before them are heads, kept in
       any case. Both look-ups work on (key, time slot) groups.
    2. whatever heads reach is kept. Pointers are doubled, so a walk of n steps
       takes log2(n) rounds of joins on the unique request id, however long one
       key's walk is.
    3. closed requests never block; they are kept unless a kept open one precedes.
    """
    narrow = requests.select(*REQUEST_KEY, "created_at", "request_id", "status")
    is_open = F.col("status").isin(*fv.OPEN_STATUSES)
    opened = narrow.filter(is_open)

    nodes = open_request_within(opened, opened, window).join(_successors(opened, window), "request_id")
    nodes = settle(nodes.select("request_id", "open_request_id", "next_id"))
    heads = nodes.filter("open_request_id is null").select("request_id")
    inner = nodes.filter("open_request_id is not null").select(F.col("request_id").alias("next_id"))
    steps = settle(nodes.filter("next_id is not null").join(inner, "next_id").select("request_id", "next_id"))
    # a head begins a stretch no pointer leaves or enters, so no request is reached twice
    kept = heads
    while not steps.isEmpty():
        hop = steps.join(kept, "request_id").select(F.col("next_id").alias("request_id"))
        kept = kept.union(settle(hop))
        after = steps.select(F.col("request_id").alias("next_id"), F.col("next_id").alias("_after"))
        steps = settle(steps.join(after, "next_id").select("request_id", F.col("_after").alias("next_id")))

    kept_open = settle(opened.join(kept, "request_id", "left_semi").select(narrow.columns))
    closed = narrow.filter(~is_open)
    kept_closed = open_request_within(closed, kept_open, window).filter("open_request_id is null")
    ids = kept.union(kept_closed.select("request_id"))
    return requests.join(ids, "request_id", "left_semi").select(requests.columns)


def _successors(opened: DataFrame, window: int) -> DataFrame:
    """For every request the first one of its key between window and 2 x window later.

    Beyond 2 x window the next request has nothing in the window before it and
    is a head, so it needs no pointer.
    """
    columns = [*REQUEST_KEY, "created_at", "request_id"]
    reach = fn.seconds(window)
    probes = opened.select(*REQUEST_KEY, (F.col("created_at") + reach).alias("created_at"), "request_id")
    found = nearest_request(probes, opened.select(*columns), window, later=True)
    near = F.col("near.created_at") < F.col("created_at") + reach
    return found.select("request_id", F.when(near, F.col("near.request_id")).alias("next_id"))
