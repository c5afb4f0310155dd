from datetime import datetime

from rankmill.llm.url_lists import filter_captures, patterns_of
from pyspark.sql import functions as F

CAPTURES = "page_id long, url string, fetched_at timestamp_ntz, rule string"
ENTRIES = "list_name string, kind string, pattern string, action string, listed_at timestamp_ntz"


def day(n, hour=0):
    return datetime(2024, 1, 1 + n % 28, hour) if n < 28 else datetime(2024 + n // 360, 1 + n // 30 % 12, 1, hour)


def test_patterns(spark):
    frame = spark.createDataFrame([("http://u:p@WWW.A.org:80/x//y?q=/z#f",), ("/relative",), (None,), ("//b/",)], "url string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in frame.select(patterns_of(F.col("url"))).collect()]
    assert got == [
        [("host", "www.a.org"), ("domain", "www.a.org"), ("domain", "a.org"), ("domain", "org"), ("prefix", "www.a.org/x"), ("prefix", "www.a.org/x/y")],
        None, None, [("host", "b"), ("domain", "b")],
    ]


def test_entries_hold_from_their_date_until_the_next(spark):
    entries = [
        ("l", "host", "a.org", "block", day(5)), ("l", "host", "a.org", "remove", day(9)), ("l", "host", "a.org", "block", day(200)),
        ("l", "host", "a.org", "block", day(5)), ("m", "prefix", "a.org/ok", "allow", day(0)), ("m", "domain", "org", "block", day(7)),
        ("m", "domain", None, "block", day(7)), ("m", "domain", "com", "block", None), ("n", "host", "b.org", "block", day(3)),
        ("n", "host", "b.org", "remove", day(3)),
    ]
    captures = [
        (1, "http://a.org/", day(4), "x"), (2, "http://a.org/", day(5), "x"), (3, "http://a.org/", day(8, 23), "x"),
        (4, "http://a.org/", day(9), "x"), (5, "http://a.org/ok/1", day(8), "x"), (6, "http://a.org/no", day(300), None),
        (7, "http://c.com", day(8), "x"), (8, None, day(8), "x"), (9, "http://a.org/", None, "x"), (10, "http://b.org", day(4), "x"),
        (2, "http://a.org/", day(5), "x"),
    ]
    found = filter_captures(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert found.columns == ["page_id", "url", "fetched_at", "n_active", "rule", "blocked"]
    got = sorted((r["page_id"], r["n_active"], r["rule"], r["blocked"]) for r in found.collect())
    assert got == [
        (1, 0, None, False), (2, 1, "l:host:a.org:block", True), (2, 1, "l:host:a.org:block", True),
        (3, 2, "l:host:a.org:block", True), (4, 1, "m:domain:org:block", True), (5, 3, "m:prefix:a.org/ok:allow", False),
        (6, 2, "l:host:a.org:block", True), (7, 0, None, False), (8, 0, None, False), (9, 0, None, False), (10, 0, None, False),
    ]


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES)
    some = spark.createDataFrame([(1, "http://a.org", day(1), None)], CAPTURES)
    assert filter_captures(captures, entries).count() == 0
    assert [r["blocked"] for r in filter_captures(some, entries).collect()] == [False]


def test_a_very_long_address_makes_no_more_patterns_than_the_lists_have(spark):
    long = "http://" + "a." * 2000 + "b.org/" + "/".join(f"s{k}" for k in range(50_000))
    captures = spark.createDataFrame([(1, long, day(5), "x"), (2, "http://b.org/s0/s1/s2", day(5), "x")], CAPTURES)
    entries = [("l", "prefix", "b.org/s0/s1", "block", day(1)), ("l", "domain", "b.org", "block", day(1))]
    found = filter_captures(captures, spark.createDataFrame(entries, ENTRIES)).collect()
    assert sorted((r["page_id"], r["n_active"]) for r in found) == [(1, 1), (2, 2)]


def test_bounded_patterns_are_those_the_lists_can_match(spark):
    frame = spark.createDataFrame([("http://x.y.a.org/1/2/3",)], "url string")
    got = frame.select(patterns_of(F.col("url"), 2, 3, 1)).first()[0]
    assert [tuple(x) for x in got] == [("host", "x.y.a.org"), ("domain", "y.a.org"), ("domain", "a.org"), ("prefix", "x.y.a.org/1")]


def test_columns_of_any_names_stay(spark):
    rows = [(1, "http://a.org/", day(5), 7, 8, 9, "s", 1)]
    names = "page_id long, url string, fetched_at timestamp_ntz, _url int, _at int, at int, given string, `a.b` int"
    entries = spark.createDataFrame([("l", "host", "a.org", "block", day(1))], ENTRIES)
    got = filter_captures(spark.createDataFrame(rows, names), entries).collect()
    assert [tuple(r) for r in got] == [(*rows[0], 1, "l:host:a.org:block", True)]
