"""Edge rows for mutations and sinks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankmill.operators import mutations
from rankmill.schemas import RANKING, RANKING_KEY, SNAPSHOT_KEY
from rankmill.session import remove, settle, work_path
from rankmill.sources import keyed_state, readers, sinks

NOW = datetime(2024, 5, 2, 12, 0, 0)
OBS = RANKING.simpleString()[7:-1].replace(":", " ") + ", obs_id bigint"


def order():
    return [F.desc("retrieved_at"), F.desc("obs_id")]


def row(name, power, at, obs_id=None, klass="c"):
    base = (1, 0, "none", "S", name, klass, power, 1, at)
    return base if obs_id is None else (*base, obs_id)


def powers(frame):
    return {r["character_name"]: r["power_value"] for r in frame.collect()}


@pytest.fixture()
def state(spark):
    return spark.createDataFrame([row("old", 1, NOW), row("same", 2, NOW)], RANKING)


@pytest.fixture()
def changes(spark):
    rows = [
        row("old", 10, NOW - timedelta(days=1), 1),   # older row arriving later
        row("new", 20, NOW, 2), row("new", 21, NOW, 3),   # equal times inside the batch
        row("null", 30, NOW, 4, None),
    ]
    return spark.createDataFrame(rows, OBS)


def test_upsert_rules(state, changes):
    arrival = mutations.upsert_latest(state, changes, order_by=order())
    assert powers(arrival) == {"old": 10, "same": 2, "new": 21, "null": 30}
    event = mutations.upsert_latest(state, changes, order_by=order(), event_time="retrieved_at")
    assert powers(event) == {"old": 1, "same": 2, "new": 21, "null": 30}


def test_upsert_twice_is_once_and_keys_stay_unique(state, changes):
    once = mutations.upsert_latest(state, changes, order_by=order())
    twice = mutations.upsert_latest(once, changes, order_by=order())
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert mutations.key_violations(twice, ["character_name", "server_name", "div"]).count() == 0


def test_tags_and_counts(spark, state):
    changes = spark.createDataFrame([row("old", 1, NOW), row("x", 1, NOW), row(None, 1, NOW)], RANKING)
    tagged, counts = mutations.tag_insert_update(state, changes)
    assert {r["character_name"]: r["action"] for r in tagged.collect()} == {"old": "UPDATE", "x": "INSERT", None: "FAILED"}
    assert tuple(counts.first()) == (2, 1)


REQUESTS = (
    "request_id string, server string, character_name string, status string, created_at timestamp_ntz, started_at timestamp_ntz, "
    "completed_at timestamp_ntz, result string, error_message string, retry_count int, max_retries int"
)


def request(rid, status, started=None, completed=None, retries=0, created=NOW, name="n"):
    return (rid, "S", name, status, created, started, completed, None, None, retries, 3)


def test_fail_or_retry_counts(spark):
    rows = [request(f"r{n}", "processing", NOW, None, n) for n in (2, 3, 4)]
    frame = spark.createDataFrame(rows, REQUESTS)
    failures = frame.select("request_id", F.lit("e").alias("error_message"), F.lit(True).alias("retry"), F.lit(False).alias("not_found"))
    out = {r["request_id"]: r for r in mutations.fail_or_retry(frame, failures, as_of=NOW).collect()}
    assert [out[f"r{n}"]["status"] for n in (2, 3, 4)] == ["pending", "failed", "failed"]
    assert [out[f"r{n}"]["retry_count"] for n in (2, 3, 4)] == [3, 4, 5]
    assert all(r["completed_at"] is None and r["started_at"] is None for r in out.values())
    gone = failures.withColumn("not_found", F.lit(True))
    assert {r["status"] for r in mutations.fail_or_retry(frame, gone, as_of=NOW).collect()} == {"completed"}


def test_sweep_and_retention_borders(spark):
    rows = [
        request("at", "processing", NOW - timedelta(seconds=600)),
        request("over", "processing", NOW - timedelta(seconds=601)),
        request("none", "processing"),
        request("kept", "failed", None, None),
        request("edge", "completed", None, NOW - timedelta(days=7)),
        request("old", "completed", None, NOW - timedelta(days=7, seconds=1)),
    ]
    frame = spark.createDataFrame(rows, REQUESTS)
    swept = mutations.sweep_timeouts(frame, as_of=NOW)
    assert [r["request_id"] for r in swept.filter("status = 'timeout'").collect()] == ["over"]
    left = {r["request_id"] for r in mutations.retention_delete(frame, as_of=NOW).collect()}
    assert left == {"at", "over", "none", "kept", "edge"}


def test_claim_only_pending(spark):
    frame = spark.createDataFrame([request("a", "pending"), request("b", "completed")], REQUESTS)
    out = {r["request_id"]: r["status"] for r in mutations.claim_request(frame, frame, as_of=NOW).collect()}
    assert out == {"a": "processing", "b": "completed"}


def kept(frame, **kw):
    return sorted(r["request_id"] for r in mutations.enqueue_dedup(frame, **kw).collect())


def test_dedup_gaps_and_chain(spark):
    def at(seconds):
        return NOW + timedelta(seconds=seconds)

    rows = [
        request("a0", "pending", created=at(0), name="a"), request("a1", "pending", created=at(299), name="a"),
        request("b0", "pending", created=at(0), name="b"), request("b1", "pending", created=at(300), name="b"),
        request("c0", "pending", created=at(0), name="c"), request("c1", "pending", created=at(301), name="c"),
        # 0, 3, 6 minutes: keep, drop, keep
        request("d0", "pending", created=at(0), name="d"), request("d1", "processing", created=at(180), name="d"),
        request("d2", "pending", created=at(360), name="d"),
        # a closed request does not block, and is blocked like any other
        request("e0", "completed", created=at(0), name="e"), request("e1", "pending", created=at(10), name="e"),
        request("e2", "failed", created=at(20), name="e"),
        # same time: the smaller id wins
        request("f1", "pending", created=at(0), name="f"), request("f0", "pending", created=at(0), name="f"),
    ]
    assert kept(spark.createDataFrame(rows, REQUESTS)) == ["a0", "b0", "b1", "c0", "c1", "d0", "d2", "e0", "e1", "f0"]


def walk(rows, window):
    """Brute force: one pass per key in time order."""
    keep, last = [], {}
    for rid, name, status, at in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        if name not in last or (at - last[name]).total_seconds() >= window:
            keep.append(rid)
            if status in ("pending", "processing"):
                last[name] = at
    return sorted(keep)


def test_dedup_hot_key_against_brute_force(spark):
    import random

    random.seed(5)
    rows = []
    for n in range(3000):
        # a third of all rows on one key, in one unbroken chain of dense requests
        name = "hot" if n % 3 == 0 else f"k{random.randrange(200)}"
        span = 20_000 if name == "hot" else 200_000
        status = random.choice(["pending", "processing", "completed", "failed"])
        rows.append((f"r{n:05d}", name, status, NOW + timedelta(seconds=random.randrange(span))))
    frame = spark.createDataFrame(
        [request(rid, status, created=at, name=name) for rid, name, status, at in rows], REQUESTS
    )
    assert kept(frame, window=300) == walk(rows, 300)


def test_patch_and_seed(spark):
    schema = "server_name string, status string, errors_count int, last_update timestamp_ntz"
    state = spark.createDataFrame([("A", "running", 1, None), ("B", "running", 2, None)], schema)
    patch = spark.createDataFrame([("A", None, 5), ("B", None, None), ("C", "x", 1)], "server_name string, status string, errors_count int")
    out = {r["server_name"]: tuple(r)[1:] for r in mutations.patch_non_null(state, patch, ["server_name"], as_of=NOW).collect()}
    assert out == {"A": ("running", 5, NOW), "B": ("running", 2, None)}
    known = spark.createDataFrame([("A",), ("Z",)], "server_name string")
    seeded = mutations.seed_missing(state, known, "server_name", {"status": F.lit("stopped")})
    assert {r["server_name"]: r["status"] for r in seeded.collect()} == {"A": "running", "B": "running", "Z": "stopped"}


def test_skip_if_fresh(spark, state):
    changes = state.unionByName(spark.createDataFrame([row("x", 1, NOW)], RANKING))
    tagged = mutations.skip_if_fresh(changes, state, as_of=NOW + timedelta(minutes=9))
    assert {r["character_name"]: r["from_cache"] for r in tagged.collect()} == {"old": True, "same": True, "x": False}
    assert mutations.skip_if_fresh(changes, state, as_of=NOW, force=True).filter("from_cache").count() == 0


def test_snapshot_first_run_of_the_day_wins(spark):
    path = work_path(spark, "test-snapshots")
    schema = "date date, server_name string, class_name string, population long, div int"
    day = NOW.date()
    first = spark.createDataFrame([(day, "all", "all", 5, 1)], schema)
    second = spark.createDataFrame([(day, "all", "all", 9, 1), (day + timedelta(days=1), "all", "all", 9, 1)], schema)
    sinks.sink_snapshot(first, path)
    sinks.sink_snapshot(second, path)
    stored = spark.read.schema(schema).parquet(path)
    assert sorted(r["population"] for r in stored.collect()) == [5, 9]
    assert mutations.key_violations(stored, SNAPSHOT_KEY).count() == 0


def test_state_sink_gives_what_the_upsert_gives(spark, state, changes):
    root = work_path(spark, "test-state")
    assert keyed_state.read_state(spark, root, RANKING).count() == 0
    sinks.sink_upsert_ranking(state, root, schema=RANKING, order_by=[F.lit(0)], buckets=8)
    merged = sinks.sink_upsert_ranking(changes, root, schema=RANKING, order_by=order())
    assert powers(merged) == {"old": 10, "same": 2, "new": 21, "null": 30}
    again = sinks.sink_upsert_ranking(changes, root, schema=RANKING, order_by=order(), event_time="retrieved_at")
    assert powers(again) == {"old": 10, "same": 2, "new": 21, "null": 30}


def many(spark, names, power, at):
    return spark.createDataFrame([row(name, power, at) for name in names], RANKING)


def bucket_files(spark, root):
    """File names below each bucket."""
    files = spark.read.schema(RANKING).parquet(f"{root}/state").inputFiles()
    out = {}
    for name in files:
        out.setdefault(int(name.split("bucket=")[1].split("/")[0]), set()).add(name)
    return out


def test_a_merge_reads_and_writes_only_the_buckets_of_its_changes(spark):
    root = work_path(spark, "test-buckets")
    names = [f"n{k}" for k in range(400)]
    options = {"schema": RANKING, "keys": RANKING_KEY, "order_by": [F.lit(0)], "buckets": 16}
    assert keyed_state.merge_state(many(spark, names, 1, NOW), root, **options) == list(range(16))
    before = bucket_files(spark, root)
    touched = keyed_state.merge_state(many(spark, ["n7", "n8", "brand new"], 2, NOW), root, **options)
    assert 1 <= len(touched) <= 3
    after = bucket_files(spark, root)
    assert {k for k in before if before[k] != after[k]} == set(touched)
    plan = keyed_state.read_state(spark, root, RANKING, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    read = keyed_state.read_state(spark, root, RANKING, touched).select(F.input_file_name()).distinct().collect()
    assert {int(r[0].split("bucket=")[1].split("/")[0]) for r in read} <= set(touched)
    got = powers(keyed_state.read_state(spark, root, RANKING))
    assert got == {name: 1 for name in names} | {"n7": 2, "n8": 2, "brand new": 2}
    assert keyed_state.merge_state(many(spark, [], 2, NOW), root, **options) == []
    # another number of buckets is not taken over: the state keeps its own
    assert max(keyed_state.merge_state(many(spark, names, 3, NOW), root, **(options | {"buckets": 64}))) == 15
    assert set(powers(keyed_state.read_state(spark, root, RANKING)).values()) == {3, 2}


@pytest.mark.parametrize("complete", [True, False])
def test_a_merge_finishes_or_drops_what_an_ended_driver_left(spark, complete):
    root = work_path(spark, "test-pending")
    options = {"schema": RANKING, "keys": RANKING_KEY, "order_by": [F.lit(0)], "buckets": 4}
    names = [f"n{k}" for k in range(40)]
    keyed_state.merge_state(many(spark, names, 1, NOW), root, **options)
    # the driver ended after writing the new buckets, when one old bucket was gone already
    new = many(spark, names, 2, NOW).withColumn("bucket", keyed_state.bucket_of(RANKING_KEY, 4))
    new.write.partitionBy("bucket").parquet(f"{root}/pending")
    if complete:
        remove(spark, f"{root}/state/bucket=2")
    else:
        remove(spark, f"{root}/pending/_SUCCESS")
    keyed_state.merge_state(many(spark, ["n0"], 9, NOW), root, **options)
    want = {name: 2 if complete else 1 for name in names} | {"n0": 9}
    assert powers(keyed_state.read_state(spark, root, RANKING)) == want
    assert not keyed_state.path_exists(spark, f"{root}/pending")


def test_buckets_by_event_time_match_the_upsert(spark):
    """Random merges, with null keys and times, against the function on whole frames."""
    rng = random.Random(7)
    root, whole = work_path(spark, "test-random"), spark.createDataFrame([], RANKING)
    for n in range(6):
        rows = [
            row(rng.choice(["a", "b", "c", "d", None]), 100 * n + k, rng.choice([None, *(NOW + timedelta(days=d) for d in range(4))]), k)
            for k in range(6)
        ]
        changes = spark.createDataFrame(rows, OBS)
        sinks.sink_upsert_ranking(changes, root, schema=RANKING, order_by=order(), event_time="retrieved_at", buckets=3)
        whole = settle(mutations.upsert_latest(whole, changes, order_by=order(), event_time="retrieved_at"))
        assert powers(keyed_state.read_state(spark, root, RANKING)) == powers(whole)


def test_event_time_mode_reads_the_whole_state_once(spark, state, changes):
    path = work_path(spark, "test-plan")
    state.write.parquet(path)
    stored = spark.read.schema(RANKING).parquet(path)
    merged = mutations.upsert_latest(stored, changes, order_by=order(), event_time="retrieved_at")
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("power_value") and plan.count("LeftAnti") == 1 and "LeftOuter" not in plan


def test_a_repeated_run_appends_its_rows_once(spark):
    path = work_path(spark, "test-runs")
    schema = "server_name string, character_name string, count long"
    first = spark.createDataFrame([("S", "a", 1), ("S", "b", 2)], schema)
    sinks.sink_audit(first, path, NOW, run="monday 1/2")
    sinks.sink_audit(first.where("character_name = 'b'"), path, NOW, run="tuesday")
    sinks.sink_audit(first, path, NOW, run="monday 1/2")
    stored = sinks.read_runs(spark, path, "object_id string, character_list array<string>")
    got = sorted((r["character_list"][0], r["run"]) for r in stored.collect())
    assert got == [("a", "monday 1/2"), ("b", "monday 1/2"), ("b", "tuesday")]
    sinks.sink_audit(first.limit(0), path, NOW, run="tuesday")
    assert sinks.read_runs(spark, path, "object_id string").count() == 2


def test_staging_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "part.tsv").write_text(
        "1\t0\tnone\tS\tn\tc\t10\t1\t2024-05-02 12:00:00\nx\t0\tnone\tS\tn\tc\t10\t1\t2024-05-02 12:00:00\n"
    )
    rows = readers.scan_staging_tsv(spark, str(tmp_path)).collect()
    assert [r["rank_position"] for r in rows] == [1, None]
    assert rows[0]["retrieved_at"] == NOW and rows[0]["corrupt_record"] is None and rows[1]["corrupt_record"].startswith("x\t")


def test_log_files_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b.log").write_text("three\n" * 5)
    rows = readers.scan_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(1, "one"), (2, "two")] + [(n, "three") for n in range(3, 8)]


def layouts(frame):
    return [frame.coalesce(1), frame.repartition(5), frame.repartition(3, frame.columns[-1])]


def test_doubled_changes_never_double_a_row_or_choose_at_random(spark):
    requests = spark.createDataFrame(
        [("r1", "processing", 0, 3, None, None, None, None), ("r2", "processing", 3, 3, None, None, None, None)],
        "request_id string, status string, retry_count int, max_retries int, error_message string, "
        "started_at timestamp_ntz, completed_at timestamp_ntz, result string",
    )
    failures = spark.createDataFrame(
        [("r1", "b", True, False), ("r1", "a", True, False), ("r1", "c", False, True), ("r2", "x", False, False)],
        "request_id string, error_message string, retry boolean, not_found boolean",
    )
    results = spark.createDataFrame([("r1", "B"), ("r1", "A"), ("r2", "C")], "request_id string, result string")
    state = spark.createDataFrame([("k", 1, None, None)], "key string, a int, b string, last_update timestamp_ntz")
    patch = spark.createDataFrame([("k", None, "y", 2), ("k", 7, "x", 1), ("k", 9, None, 3)], "key string, a int, b string, seq int")
    rows = spark.createDataFrame([("n", 5), ("n", 3), ("n", 4), ("k", 0), (None, 1), (None, 2)], "key string, a int")
    stored = spark.createDataFrame([("k", 1)], "key string, a int")
    for fail, result, change, row in zip(layouts(failures), layouts(results), layouts(patch), layouts(rows)):
        after = mutations.fail_or_retry(requests, fail, as_of=NOW).collect()
        assert sorted((r["request_id"], r["status"], r["error_message"]) for r in after) == [("r1", "pending", "a"), ("r2", "failed", "x")]
        chosen = mutations.fail_or_retry(requests, fail, as_of=NOW, order_by=[F.desc("error_message")]).collect()
        assert sorted((r["request_id"], r["status"]) for r in chosen) == [("r1", "completed"), ("r2", "failed")]
        done = mutations.complete_request(requests, result, as_of=NOW).collect()
        assert sorted((r["request_id"], r["result"]) for r in done) == [("r1", "A"), ("r2", "C")]
        patched = mutations.patch_non_null(state, change, ["key"], as_of=NOW, order_by=[F.asc("seq")]).collect()
        assert [(r["key"], r["a"], r["b"]) for r in patched] == [("k", 7, "x")]
        added = mutations.insert_if_absent(stored, row, ["key"]).collect()
        assert sorted((r["key"] or "", r["a"]) for r in added) == [("", 1), ("k", 1), ("n", 3)]


def test_null_keys_are_a_value_of_their_own_in_both_modes(spark):
    schema = "k string, v int, t int"
    state = spark.createDataFrame([(None, 1, 1), ("a", 1, 5)], schema)
    changes = spark.createDataFrame([(None, 2, 2), ("a", 2, 4), (None, 3, 1)], schema)
    arrival = mutations.upsert_latest(state, changes, ["k"], order_by=[F.desc("t")]).collect()
    newer = mutations.upsert_latest(state, changes, ["k"], order_by=[F.desc("t")], event_time="t").collect()
    assert sorted((r["k"] or "", r["v"]) for r in arrival) == [("", 2), ("a", 2)]
    assert sorted((r["k"] or "", r["v"]) for r in newer) == [("", 2), ("a", 1)]
