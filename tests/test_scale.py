"""Plans and hot keys: what must hold when the data is large."""

import random

import pytest
from pyspark.sql import functions as F

from rankmill.operators import joins, windows


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


STREAMING = ("stream_", "sink_", "scan_")


def batch_names():
    from rankmill.catalog import QUERIES

    return [n for n in QUERIES if not n.startswith(STREAMING)]


@pytest.mark.parametrize("name", batch_names())
def test_no_pairs_and_no_python(spark, small, name):
    from rankmill.catalog import QUERIES

    text = plan(QUERIES[name](spark, small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert bad not in text


def test_first_row_per_key_is_cut_before_the_shuffle(spark, small):
    from rankmill.catalog import QUERIES

    text = plan(QUERIES["distinct_on_key"](spark, small))
    assert "row_number(), 1, Partial" in text


def test_cube_counts_before_it_expands(spark, small):
    from rankmill import views
    from rankmill.operators.aggregates import population_cube

    text = plan(population_cube(views.obs(spark, small)))
    assert text.index("Expand") < text.index("partial_count")  # plans read from the result down to the scan


def test_time_filter_reaches_the_scan(spark, small):
    from rankmill import views
    from rankmill.operators.filters import fresh_since

    events = views.table(spark, small, "events").withColumnRenamed("ts", "retrieved_at")
    text = plan(events.filter(fresh_since("2024-01-05 00:00:00")).select("event_id"))
    assert "GreaterThan(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


ONE_COMPUTATION = (
    "bottom_per_server stale_not_in fresh_server_rows_min_count by_server_name refresh_plan".split()
)


@pytest.mark.parametrize("name", ONE_COMPUTATION)
def test_the_ranking_is_computed_once(spark, small, name):
    """What is left after the settled tables reads none of the input tables again; there is no other way for small data."""
    from rankmill.catalog import QUERIES

    text = plan(QUERIES[name](spark, small))
    assert "settled-" in text and "LocalTableScan" not in text
    assert small not in text


def test_upserts_leave_the_state_where_it_is(spark):
    """Few changes are broadcast: neither mode shuffles, sorts or windows the state."""
    from rankmill.operators.mutations import upsert_latest

    state = spark.range(200_000).select(F.col("id").alias("k"), F.lit(0).alias("v"), F.col("id").alias("t"))
    changes = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.col("id").alias("t"))
    for event_time in (None, "t"):
        text = plan(upsert_latest(state, changes, ["k"], order_by=[F.desc("t")], event_time=event_time))
        assert "BroadcastHashJoin" in text
        for bad in ("Exchange hashpartitioning", "SortMergeJoin", "Window"):
            assert bad not in text


def hot_rows(n=6000):
    random.seed(3)
    return [(i, "hot" if i % 3 == 0 else f"g{random.randrange(40)}", random.randrange(500)) for i in range(n)]


def test_numbering_with_a_hot_group(spark):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "id long, g string, v int").repartition(7)
    out = windows.assign_batches(frame, [F.desc("v"), F.asc("id")], 200, ["g"]).collect()
    expected = {}
    for g in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        for n, r in enumerate(members):
            expected[r[0]] = (n + 1, n // 200, -(-len(members) // 200))
    assert {r["id"]: (r["row_no"], r["batch_index"], r["batch_count"]) for r in out} == expected


def test_numbering_over_all_rows_and_null_groups(spark):
    frame = spark.createDataFrame([(i, None if i % 4 else "a") for i in range(100)], "id long, g string")
    out = {r["id"]: r["row_no"] for r in windows.numbered(frame, [F.asc("id")]).collect()}
    assert out == {i: i + 1 for i in range(100)}
    grouped = windows.numbered(frame, [F.asc("id")], ["g"]).collect()
    assert sorted(r["row_no"] for r in grouped if r["g"] is None) == list(range(1, 76))


def test_look_back_join_with_a_hot_key(spark):
    from datetime import datetime, timedelta

    random.seed(11)
    start = datetime(2024, 1, 1)
    rows = []
    for n in range(2500):
        name = "hot" if n % 3 == 0 else f"k{random.randrange(60)}"
        at = start + timedelta(seconds=random.randrange(9000))
        rows.append((f"r{n:05d}", "S", name, random.choice(["pending", "processing", "failed"]), at))
    schema = "request_id string, server string, character_name string, status string, created_at timestamp_ntz"
    frame = spark.createDataFrame(rows, schema)
    got = {r["request_id"]: r["open_request_id"] for r in joins.open_request_within(frame, frame).collect()}
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        by_key.setdefault(r[2], []).append(r)
    expected = {}
    for members in by_key.values():
        for i, r in enumerate(members):
            near = [m for m in members[:i] if m[3] != "failed" and r[4] - m[4] < timedelta(seconds=300)]
            expected[r[0]] = near[-1][0] if near else None
    assert got == expected


def test_one_window_of_one_key_is_spread(spark):
    """A key with all its rows in one 12-hour slot: no group holds more than a small part of them."""
    from datetime import datetime, timedelta

    from rankmill.operators import mutations

    random.seed(5)
    start = datetime(2024, 1, 1)
    rows = [(f"r{n:05d}", "S", "hot", "pending", start + timedelta(seconds=random.randrange(43_200))) for n in range(3000)]
    schema = "request_id string, server string, character_name string, status string, created_at timestamp_ntz"
    frame = spark.createDataFrame(rows, schema)
    width = 43_200 // joins.SUB_SLOTS
    groups = frame.groupBy((F.unix_timestamp("created_at") / width).cast("int")).count().agg(F.max("count")).first()[0]
    assert groups < 3000 / 40
    text = plan(joins.open_request_within(frame, frame, 43_200))
    assert "hashpartitioning(server" in text and "_sub" in text
    for window in (43_200, 600, 7):
        got = sorted(r["request_id"] for r in mutations.enqueue_dedup(frame, window).collect())
        kept, last = [], None
        for r in sorted(rows, key=lambda r: (r[4], r[0])):
            if last is None or r[4] - last >= timedelta(seconds=window):
                kept.append(r[0])
                last = r[4]
        assert got == sorted(kept)
