"""Streams over several micro-batches, with late rows and restarts."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rankmill import views
from rankmill.catalog import stream_queries
from rankmill.operators import mutations
from rankmill.schemas import RANKING_KEY
from rankmill.session import work_path
from rankmill.streaming import aggregates, runner, stateful

NOW = datetime(2024, 5, 2, 12, 0, 0)
OBS = "obs_id bigint, character_name string, server_name string, div int, power_value bigint, retrieved_at timestamp_ntz"
REQ = "request_id string, server string, character_name string, status string, created_at timestamp_ntz"


def batches(spark, label, schema, parts):
    """One file per micro-batch, in order."""
    import time

    root = work_path(spark, label)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)  # files are taken by modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def obs(n, name, power, hours):
    return (n, name, "S", 1, power, NOW + timedelta(hours=hours))


PARTS = [
    [obs(1, "a", 1, 0), obs(2, "a", 2, 0), obs(3, "b", 3, 5)],
    [obs(4, "a", 4, 1), obs(5, "b", 5, 1)],  # b is late
]


@pytest.mark.parametrize("arrival_wins, want", [(False, {"a": 4, "b": 3}), (True, {"a": 4, "b": 5})])
def test_upsert_event_time_and_arrival(spark, arrival_wins, want):
    stream = batches(spark, "obs", OBS, PARTS)
    root = work_path(spark, "upsert")
    start = lambda: runner.finish(aggregates.stream_upsert(stream, root, runner.AVAILABLE_NOW, arrival_wins=arrival_wins))

    def state():
        rows = aggregates.upserted_state(spark, root, stream.schema, arrival_wins).collect()
        return {r["character_name"]: r["power_value"] for r in rows}

    start()
    assert state() == want
    start()  # again without new input nothing changes
    assert state() == want
    order = aggregates._upsert_order(arrival_wins)
    runner.fold(spark, root, stream.schema, RANKING_KEY, order, 1)
    assert runner.batch_folders(spark, root) == [] and state() == want
    # batches after the fold count on top of it
    spark.createDataFrame([obs(6, "b", 6, 7), obs(7, "c", 7, 0)], OBS).write.parquet(f"{root}/rows/batch=2")
    assert state() == {"a": 4, "b": 6, "c": 7}


def test_folds_in_the_stream_bound_the_folders(spark):
    """Fifty batches; a stop in the middle of a fold, then the batch comes again."""
    parts = [[obs(n, "abc"[n % 3], n, n % 7)] for n in range(50)]
    schema = spark.createDataFrame([], OBS).schema
    root, order = work_path(spark, "folds"), aggregates._upsert_order(True)

    def put(n):
        spark.createDataFrame(parts[n], OBS).write.mode("overwrite").parquet(f"{root}/rows/batch={n}")

    most = 0
    for n in range(50):
        put(n)
        if (n + 1) % 5 == 0:
            runner.fold(spark, root, schema, RANKING_KEY, order, n, 5)
        most = max(most, len(runner.batch_folders(spark, root)))
        if n == 29:  # stopped after the merge, before the folders went; batch and fold come again
            put(28), put(29)
            runner.fold(spark, root, schema, RANKING_KEY, order, n, 5)
    assert most <= 10
    got = aggregates.upserted_state(spark, root, schema, arrival_wins=True).collect()
    assert {r["character_name"]: r["power_value"] for r in got} == {"a": 48, "b": 49, "c": 47}


def test_a_stream_folds_by_itself(spark):
    stream = batches(spark, "obs", OBS, PARTS)
    root = work_path(spark, "upsert-folding")
    runner.finish(aggregates.stream_upsert(stream, root, runner.AVAILABLE_NOW, fold_every=1))
    assert runner.batch_folders(spark, root) == [1]
    got = aggregates.upserted_state(spark, root, stream.schema).collect()
    assert {r["character_name"]: r["power_value"] for r in got} == {"a": 4, "b": 3}


def test_latest_value_ignores_late_rows(spark):
    stream = batches(spark, "obs", OBS, PARTS)
    out = runner.collect_latest(aggregates.stream_latest(stream), "latest", ["character_name", "server_name", "div"])
    assert {r["character_name"]: r["power_value"] for r in out.collect()} == {"a": 4, "b": 3}


def test_dedup_over_batches_equals_batch(spark):
    def req(n, seconds, status="pending", name="n"):
        return (f"r{n}", "S", name, status, NOW + timedelta(seconds=seconds))

    parts = [
        [req(1, 180), req(0, 0), req(2, 360)],
        [req(3, 600), req(4, 660), req(5, 961), req(6, 10, "completed", "m")],
        [req(7, 1200), req(8, 1261), req(9, 20, "pending", "m")],
    ]
    stream = batches(spark, "req", REQ, parts)
    out = stateful.collect_rows(stateful.stream_dedup_requests, stream, "dedup", "request_id string")
    everything = spark.createDataFrame([r for part in parts for r in part], REQ)
    assert sorted(r[0] for r in out.collect()) == sorted(r["request_id"] for r in mutations.enqueue_dedup(everything).collect())


def timeouts(spark, label, parts):
    """What the stream of time-outs writes: (timed out, late)."""
    schema = "request_id string, kind string, at timestamp_ntz"
    rows = [[(rid, kind, NOW + timedelta(seconds=at)) for rid, kind, at in part] for part in parts]
    root = work_path(spark, label)
    runner.finish(stateful.stream_timeouts(batches(spark, label, schema, rows), root, runner.AVAILABLE_NOW))
    out = spark.read.parquet(f"{root}/rows").select("request_id", "started_at").collect()
    late = spark.read.parquet(f"{root}/late").select("request_id", "kind").collect()
    return sorted(r["request_id"] for r in out), sorted((r["request_id"], r["kind"]) for r in late)


def test_timeouts_wait_until_the_limit_has_passed(spark):
    parts = [
        [("slow", "start", 0), ("fine", "start", 5), ("tick", "end", 6)],
        [("fine", "end", 300), ("open", "start", 400)],
        [("slow", "end", 900), ("tick", "start", 901)],
        [("edge", "start", 902), ("edge", "end", 1502)],
        [("just", "end", 1503)],
    ]
    assert timeouts(spark, "limits", parts) == (["open", "slow", "tick"], [])


def test_nothing_that_comes_late_is_lost(spark):
    """A start that comes late is judged at once; what can't be judged any more is named."""
    parts = [
        [("a", "start", 300), ("a", "end", 310)],
        [("b", "start", 4000), ("b", "end", 4010)],
        [("slow", "start", 90), ("early end", "end", 500)],
        [("early end", "start", 400), ("missed", "start", 3300)],
        [("c", "start", 200_000)],
        [("missed", "end", 3400), ("ancient", "start", 100)],
    ]
    assert timeouts(spark, "late-timeouts", parts) == (["missed", "slow"], [("ancient", "start"), ("missed", "end")])


def test_timeouts_match_the_rule_on_whole_tables(spark):
    rng = random.Random(11)
    events = []
    for n in range(60):
        at = rng.randrange(0, 20_000)
        events.append((f"r{n}", "start", at))
        if rng.random() < 0.7:
            events.append((f"r{n}", "end", at + rng.choice([1, 599, 600, 601, 5000])))
    events.sort(key=lambda e: e[2] + rng.randrange(400) * (e[1] == "start"))
    parts = [events[k : k + 25] for k in range(0, len(events), 25)]
    now = max(at for _, _, at in events)
    ends = {(rid, at) for rid, kind, at in events if kind == "end"}
    want = sorted(rid for rid, kind, at in events if kind == "start" and at + 600 < now and not any(r == rid and at <= e <= at + 600 for r, e in ends))
    got, late = timeouts(spark, "random-timeouts", parts)
    assert sorted(set(got) - {rid for rid, _ in late}) == want


def request(n, seconds, status="pending", name="n"):
    return (f"r{n}", "S", name, status, NOW + timedelta(seconds=seconds))


def test_late_requests_are_judged_by_what_lies_before_them(spark):
    parts = [[request(1, 7200)], [request(2, 0)], [request(3, 9000), request(4, 7300), request(5, 200)], [request(6, -90_000)]]
    stream = batches(spark, "late", REQ, parts)
    root = work_path(spark, "late_dedup")
    runner.finish(stateful.stream_dedup_requests(stream, root, runner.AVAILABLE_NOW))
    kept = spark.read.parquet(f"{root}/rows").collect()
    assert sorted(r["request_id"] for r in kept) == ["r1", "r2", "r3"]  # 4 and 5 come less than 5 minutes after 1 and 2
    assert [r["request_id"] for r in spark.read.parquet(f"{root}/late").collect()] == ["r6"]


def test_a_batch_looks_back_only_as_far_as_its_rows_need(spark, monkeypatch):
    """Rows that come in order are judged by the last window of kept requests, not by a day; the edges of the window hold."""
    reads, plain = [], stateful.read_batches

    def noted(*args):
        reads.append(args[5:7])
        return plain(*args)

    monkeypatch.setattr(stateful, "read_batches", noted)
    parts = [
        [request("a", 0), request("b", 100_000)],
        [request("c", 100_299), request("d", 100_300), request("e", 100_599)],
        [request("f", 200_000), request("g", 200_100)],
    ]
    out = stateful.collect_rows(stateful.stream_dedup_requests, batches(spark, "back", REQ, parts), "back-out", "request_id string")
    assert sorted(r["request_id"] for r in out.collect()) == ["ra", "rb", "rd", "rf"]
    assert reads == [(NOW + timedelta(seconds=99_999), NOW + timedelta(seconds=100_000))]


def test_storage_and_reads_stay_constant_over_many_batches(spark):
    """Twenty micro-batches: each adds as many bytes as the one before, two clocks stay, and no settled tables."""
    from rankmill.session import hadoop_path, shared_folder

    def settled():
        system, place = hadoop_path(spark, shared_folder(spark))
        return sum(s.getPath().getName().startswith("settled-") for s in system.listStatus(place))

    def size(path):
        system, place = hadoop_path(spark, path)
        return system.getContentSummary(place).getLength() if system.exists(place) else 0

    root = work_path(spark, "many")
    source = work_path(spark, "many-source")
    before, sizes, read = settled(), [], []
    columns = "request_id string, created_at timestamp_ntz"
    for n in range(20):
        rows = [request(f"{n:02}-{k}", n * 40_000 + k * 400) for k in range(3)]
        spark.createDataFrame(rows, REQ).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQ).parquet(source)
        runner.finish(stateful.stream_dedup_requests(stream, root, runner.AVAILABLE_NOW, lateness=7200))
        sizes.append(size(f"{root}/rows/batch={n}"))
        clock = stateful.read_clock(spark, root, n + 1)
        days = stateful.read_batches(spark, root, "rows", columns, "created_at", clock - timedelta(seconds=7500), clock, n)
        read.append(len(days.select(F.input_file_name()).distinct().collect()))
        assert not runner.path_exists(spark, f"{root}/clock/batch={n - 2}")
    assert settled() == before
    assert max(sizes[2:]) - min(sizes[2:]) < 200
    assert max(read) <= 4
    assert spark.read.parquet(f"{root}/rows").count() == 60


def test_lifecycle_transitions(spark):
    schema = "request_id string, retry_count int, max_retries int, step int, state string, at timestamp_ntz"

    def step(rid, n, state, seconds, tried=0):
        return (rid, tried, 3, n, state, NOW + timedelta(seconds=seconds))

    parts = [
        [step("a", 1, "pending", 0), step("a", 2, "processing", 1), step("b", 1, "pending", 0, 3)],
        [step("a", 3, "attempt_failed", 2), step("b", 3, "attempt_failed", 2, 3), step("c", 1, "pending", 0)],
        [step("a", 2, "processing", 3), step("a", 3, "completed", 4), step("c", 3, "timeout", 1), step("c", 2, "processing", 9)],
    ]
    stream = views.with_event_time(batches(spark, "steps", schema, parts), "at")
    states = stateful.stream_request_lifecycle(stream)
    got = {r["request_id"]: (r["status"], r["retry_count"]) for r in runner.collect_latest(states, "lifecycle", ["request_id"]).collect()}
    assert got == {"a": ("completed", 1), "b": ("failed", 4), "c": ("timeout", 0)}


def test_a_late_transition_does_not_reopen_a_closed_request(spark):
    schema = "request_id string, retry_count int, max_retries int, step int, state string, at timestamp_ntz"

    def step(rid, n, state, seconds):
        return (rid, 0, 3, n, state, NOW + timedelta(seconds=seconds))

    parts = [[step("r1", 1, "pending", 0), step("r1", 3, "completed", 5)], [step("r2", 1, "pending", 300_000)], [step("r1", 2, "processing", 2)]]
    stream = views.with_event_time(batches(spark, "reopen", schema, parts), "at")
    out = runner.collect_latest(stateful.stream_request_lifecycle(stream), "reopen-out", ["request_id"])
    got = {r["request_id"]: (r["status"], r["steps"]) for r in out.collect()}
    assert got == {"r1": ("completed", 3), "r2": ("pending", 1)}


def test_fingerprint_state_carries_over(spark):
    schema = "list_key string, page_id bigint, fingerprint string"
    parts = [[("k", 1, "x"), ("k", 2, "x"), ("k", 3, "y")], [("k", 4, "y"), ("j", 5, "x")], [("k", 6, "x")]]
    stream = batches(spark, "prints", schema, parts)
    out = stateful.collect_rows(stateful.stream_fingerprint_change, stream, "changes", schema)
    assert sorted(r["page_id"] for r in out.collect()) == [1, 3, 5, 6]


def test_a_repeated_batch_of_list_versions_is_judged_as_before(spark):
    """The driver ends after the last fingerprints were stored; the batch comes again."""
    schema = "list_key string, page_id bigint, fingerprint string"
    parts = [[("k", 1, "x")], [("k", 2, "y"), ("j", 3, "x")]]
    root = work_path(spark, "repeated")
    stream = batches(spark, "prints-again", schema, parts)
    runner.finish(stateful.stream_fingerprint_change(stream, root, runner.AVAILABLE_NOW))
    system, place = runner.hadoop_path(spark, f"{root}/progress/commits/1")
    system.delete(place, False)
    runner.remove(spark, f"{root}/rows/batch=1")
    runner.finish(stateful.stream_fingerprint_change(stream, root, runner.AVAILABLE_NOW))
    got = spark.read.schema(schema).parquet(f"{root}/rows").collect()
    assert sorted(r["page_id"] for r in got) == [1, 2, 3]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_local_days(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(datetime(2024, 5, 1, 0, 0), "S", "c"), (datetime(2024, 5, 1, 23, 59), "S", "c"), (datetime(2024, 5, 2, 0, 0), "S", "c"), (datetime(2024, 5, 4), "S", "c")]
        schema = "retrieved_at timestamp_ntz, server_name string, class_name string"
        stream = views.with_event_time(batches(spark, "days", schema, [rows]), "retrieved_at")
        out = runner.collect_append(aggregates.stream_daily_snapshot(stream), "days")
        assert {str(r["date"]): r["population"] for r in out.collect()} == {"2024-05-01": 2, "2024-05-02": 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_stream_settings_are_put_back(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with runner.stream_conf(spark):
        assert spark.conf.get(key) == before  # the session's value, whatever the cluster's size is now
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get(key) == before


def test_rows_without_a_time_reach_the_streams(spark):
    rows = [(None, "none"), *((k, f"page {k}") for k in range(1, 10)), (None, "none either")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    stream = stream_queries.stream_of(SimpleNamespace(spark=spark, table=lambda name: pages), "pages")
    got = runner.collect_append(stream, "without_a_time").collect()
    assert sorted((r["page_id"] or 0, r["html"]) for r in got) == sorted((k or 0, html) for k, html in rows)


def test_slices_of_many_files_come_one_at_a_time(spark):
    rows = spark.range(1, 601).selectExpr("id AS page_id", "'x' AS html").repartition(4)
    stream = stream_queries.stream_of(SimpleNamespace(spark=spark, table=lambda name: rows), "pages")
    seen = []

    def step(batch, batch_id):
        seen.append((batch.agg(F.min("page_id"), F.max("page_id"), F.count("page_id")).first(), len(batch.inputFiles())))

    runner.finish(runner.start_steps(stream, work_path(spark, "sliced"), runner.AVAILABLE_NOW, step))
    spans = [tuple(span) for span, _ in seen]
    assert len(spans) == 3 and sum(n for _, _, n in spans) == 600
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:]))
