"""Hand-written edge rows for filters, joins, aggregates, windows and orders."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rankmill.operators import aggregates, filters, joins, ordering, sets, windows
from rankmill.schemas import RANKING

NOW = datetime(2024, 5, 2, 12, 0, 0)


def ranking(spark, rows):
    """rows: (server, character, class, div, rank, retrieved_at)"""
    full = [(r[4], 0, "none", r[0], r[1], r[2], 100, r[3], r[5]) for r in rows]
    return spark.createDataFrame(full, RANKING)


def names(frame, column="character_name"):
    return sorted(r[column] for r in frame.collect())


def test_freshness_is_strict(spark):
    rows = [("S", "edge", "c", 1, 1, NOW - timedelta(minutes=10)), ("S", "in", "c", 1, 2, NOW - timedelta(seconds=599))]
    state = ranking(spark, rows)
    assert names(filters.fresh_rows(state, NOW)) == ["in"]
    assert names(filters.outdated_rows(state, NOW)) == []


def test_minimum_of_fresh_rows(spark):
    rows = [("A", f"a{n}", "c", 1, n, NOW) for n in range(19)] + [("B", f"b{n}", "c", 1, n, NOW) for n in range(20)]
    out = filters.fresh_server_rows_min_count(ranking(spark, rows), NOW)
    assert {r["server_name"] for r in out.collect()} == {"B"} and out.count() == 20


def test_bottom_keeps_ties_and_ignores_missing_ranks(spark):
    rows = [
        ("A", "x", "c", 1, 9, NOW), ("A", "y", "c", 2, 9, NOW), ("A", "z", "c", 1, 3, NOW), ("B", "n", "c", 1, None, NOW),
    ]
    state = ranking(spark, rows)
    assert names(joins.bottom_per_server(state)) == ["x", "y"]
    assert names(windows.bottom_rank_ties(state)) == ["x", "y"]


def test_not_in_with_nulls(spark):
    old = NOW - timedelta(days=2)
    rows = [
        ("A", "stale", "c", 1, 1, old), ("A", None, "c", 1, 2, NOW),       # a null today: undecided
        ("B", "stale", "c", 1, 1, old), ("B", "today", "c", 1, 2, NOW), ("B", None, "c", 1, 3, old),
        ("C", "stale", "c", 1, 1, old), ("C", None, "c", 1, 3, old),        # empty subquery: all names
    ]
    state = ranking(spark, rows)
    out = {(r["server_name"], r["character_name"]) for r in joins.stale_not_in(state, NOW).collect()}
    state.createOrReplaceTempView("state_rows")
    expected = set()
    for server in "ABC":
        sql = f"""SELECT DISTINCT character_name FROM state_rows WHERE server_name = '{server}' AND character_name NOT IN (
            SELECT character_name FROM state_rows WHERE server_name = '{server}' AND retrieved_at >= TIMESTAMP_NTZ '2024-05-02')"""
        expected |= {(server, r[0]) for r in spark.sql(sql).collect()}
    assert out == expected == {("B", "stale"), ("C", "stale"), ("C", None)}


def test_local_midnight(spark):
    midnight = datetime(2024, 5, 2)
    rows = [("A", "last", "c", 1, 1, midnight - timedelta(seconds=1)), ("A", "first", "c", 1, 2, midnight)]
    state = ranking(spark, rows)
    keys = state.select("server_name", "character_name")
    assert names(joins.updated_today_semi(keys, state, NOW)) == ["first"]
    assert names(aggregates.stale_frontier(state, NOW)) == ["last"]


def test_frontier_without_time_comes_first(spark):
    rows = [("A", "b", "c", 1, 1, datetime(2024, 1, 1)), ("A", "a", "c", 1, 1, datetime(2024, 1, 1)), ("A", "n", "c", 1, 1, None)]
    out = ordering.order_frontier(aggregates.stale_frontier(ranking(spark, rows), NOW))
    assert [r["character_name"] for r in out.collect()] == ["n", "a", "b"]


def test_cube_labels_and_union_agree(spark):
    rows = [("S", "1", "all", 1, 1, NOW), ("S", "2", None, 2, 1, NOW), ("S", "3", "k", 1, 1, NOW), ("S", "4", "k", 3, 1, NOW)]
    state = ranking(spark, rows)
    cube = aggregates.population_cube(state).select("server_name", "class_name", "population", "div")
    union = sets.union_rollups(state).select("server_name", "class_name", "population", "div")
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(map(tuple, cube.collect()), key=key) == sorted(map(tuple, union.collect()), key=key)
    counts = [tuple(r) for r in cube.collect()]
    assert ("all", None, 1, 1) in counts and ("all", "all", 4, 1) in counts and ("all", "all", 1, 1) in counts


def test_cube_without_rows_has_a_zero_total(spark):
    out = aggregates.population_cube(ranking(spark, []))
    assert [tuple(r) for r in out.collect()] == [("all", "all", 0, 1)]
    assert [tuple(r) for r in sets.union_rollups(ranking(spark, [])).collect()] == [("all", "all", 0, 1)]


def test_rank_type_document(spark):
    rows = [("A", "x", "c", 1, 9, NOW), ("A", "x", "c", 3, 4, NOW)]
    document = aggregates.rank_type_document(ranking(spark, rows)).first()["rankings"]
    assert {k: [r["rank_position"] for r in v] for k, v in document.items()} == {"전투력": [9], "매력": [], "생활력": [4]}


def test_choose_total_and_shares(spark):
    frame = spark.createDataFrame([(0, 0, 5), (0, 4, 5), (3, 4, 5), (None, None, 5)], "a long, b long, c long")
    out = frame.select(aggregates.choose_total(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()
    assert [r["t"] for r in out] == [5, 4, 3, 5]
    classes = spark.createDataFrame([("a", 1), ("b", 3)], "class_name string, population long")
    shares = {r["class_name"]: r for r in aggregates.class_share(classes, F.lit(10)).collect()}
    assert (shares["a"]["population"], shares["b"]["population"]) == (2, 8)  # 2.5 and 7.5, half-even
    assert sum(r["percentage"] for r in shares.values()) == 100.0


def test_queue_stats_fills_zero(spark):
    rows = [("pending", NOW), ("pending", NOW - timedelta(hours=24)), ("failed", NOW - timedelta(hours=23))]
    out = aggregates.queue_stats(spark.createDataFrame(rows, "status string, created_at timestamp_ntz"), NOW)
    assert {r["status"]: r["requests"] for r in out.collect()} == {
        "pending": 1, "processing": 0, "completed": 0, "failed": 1, "timeout": 0,
    }


def test_timeout_alert(spark):
    def alert(n):
        return aggregates.timeout_alert(spark.createDataFrame([(f"r{i}",) for i in range(n)], "request_id string")).first()

    assert tuple(alert(0)) == (0, "", "none")
    assert tuple(alert(3)) == (3, "r0, r1, r2", "warning")
    assert tuple(alert(6)) == (6, "r0, r1, r2, r3, r4...", "error")


def test_log_levels(spark):
    lines = spark.createDataFrame([(1, "ERROR and WARNING"), (2, "ok"), (3, "WARNING")], "line_no long, line string")
    assert tuple(aggregates.log_level_counts(lines).first()) == (1, 2)
    assert [r["line_no"] for r in ordering.last_errors(lines).collect()] == [1]


def test_first_seen_over_pages(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, ""), (2, 2, "c"), (3, 0, "a")]
    frame = spark.createDataFrame(rows, "page_seq long, pos int, character string")
    first = windows.first_seen(frame)
    assert {(r["character"], r["page_seq"]) for r in first.collect()} == {("a", 1), ("b", 1), ("c", 2)}
    out = {r["page_seq"]: (r["rows_found"], r["new_rows"]) for r in aggregates.page_yield(frame, first).collect()}
    assert out == {1: (2, 2), 2: (3, 1), 3: (1, 0)}


def test_fingerprint_versions_across_spans(spark):
    prints = ["x", "x", "y", "y", "x", "x"]
    rows = [("k", n * 7, p) for n, p in enumerate(prints)] + [("one", 3, "z")]
    frame = spark.createDataFrame(rows, "list_key string, page_id long, fingerprint string")
    for span in (1, 7, 10, 1000):
        out = windows.fingerprint_changed(frame, ["list_key"], "page_id", span=span)
        changed = {(r["list_key"], r["page_id"]) for r in out.filter("changed").collect()}
        assert changed == {("k", 0), ("k", 14), ("k", 28), ("one", 3)}


def test_prefer_source_falls_back_unless_not_found(spark):
    primary = ranking(spark, [("S", "full", "p", d, 1, NOW) for d in (1, 2, 3)] + [("S", "part", "p", 1, 1, NOW), ("S", "gone", "p", 1, 1, NOW)])
    secondary = ranking(spark, [("S", n, "s", d, 2, NOW) for n in ("full", "part", "gone") for d in (1, 2)])
    unknown = spark.createDataFrame([("S", "gone")], "server_name string, character_name string")
    out = joins.prefer_source(primary, secondary, unknown)
    assert sorted((r["character_name"], r["source"], r["div"]) for r in out.collect()) == [
        ("full", "primary", 1), ("full", "primary", 2), ("full", "primary", 3), ("part", "secondary", 1), ("part", "secondary", 2),
    ]


def test_default_name_where_a_server_has_none(spark):
    names_ = spark.createDataFrame([("A", "x", 1)], "server_name string, character_name string, rank_position int")
    servers = spark.createDataFrame([("A",), ("B",)], "server_name string")
    out = ordering.names_or_default(names_, servers)
    assert sorted((r[0], r[1]) for r in out.collect()) == [("A", "x"), ("B", "힝트")]


def test_split_strict_fails_the_job(spark):
    import pytest

    rows = [("1위", "-", "none", "s", "c", "k", "10"), ("x", "-", "none", "s", "c", "k", "10")]
    frame = spark.createDataFrame(rows, "rank string, change string, change_type string, server string, character string, class string, power string")
    valid, bad = filters.split_valid_rows(frame)
    assert (valid.count(), bad.count()) == (1, 1)
    with pytest.raises(Exception, match="row does not parse"):
        filters.split_valid_rows(frame, strict=True)[0].collect()
