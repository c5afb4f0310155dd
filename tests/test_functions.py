from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankmill import functions as fn


def values(spark, column_of, inputs, kind="string"):
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(inputs)], f"n int, v {kind}")
    rows = frame.select("n", column_of(F.col("v")).alias("out")).orderBy("n").collect()
    return [r["out"] for r in rows]


SCRAPED = ["-", "new", "1,234", "abc", "", " 12 ", "12", "-3"]


def test_rank_and_power(spark):
    out = values(spark, fn.parse_rank_power, ["1위", "1,234위", "98,765", "77", "n/a", "", None])
    assert out == [1, 1234, 98765, 77, None, None, None]


def test_change_rules_differ(spark):
    assert values(spark, fn.parse_change_digits, SCRAPED) == [0, 0, 1, 0, 0, 12, 12, 3]
    assert values(spark, fn.parse_change_plain, SCRAPED) == [0, None, 1234, None, None, 12, 12, -3]
    up = lambda c: fn.parse_change_isdigit(c, F.lit("up"))
    down = lambda c: fn.parse_change_isdigit(c, F.lit("down"))
    none = lambda c: fn.parse_change_isdigit(c, F.lit("none"))
    assert values(spark, up, SCRAPED) == [0, 0, 0, 0, 0, 0, 12, 0]
    assert values(spark, down, ["12", "x"]) == [-12, 0]
    assert values(spark, none, ["12"]) == [0]


def test_signed_change(spark):
    service = lambda c: fn.signed_change(c, F.lit("down"))
    batch_up = lambda c: fn.signed_change(c, F.lit("up"), "batch")
    assert values(spark, service, [5, -5, 0], "int") == [-5, -5, 0]
    assert values(spark, batch_up, [5, -5], "int") == [5, 5]
    assert values(spark, lambda c: fn.signed_change(c, F.lit("up")), [-5], "int") == [-5]


def test_change_type(spark):
    css = ["change up", "down", "upper", "", None]
    assert values(spark, fn.change_type_of, css) == ["up", "down", "none", "none", "none"]
    assert values(spark, lambda c: fn.change_type_of(c, "batch"), css) == ["up", "down", "down", "down", "down"]


def test_half_even(spark):
    halves = lambda c: fn.divide_half_even(c, F.lit(2))
    assert values(spark, halves, [5, 7, 4, 1], "bigint") == [2, 4, 2, 0]
    assert values(spark, lambda c: fn.divide_half_even(c, F.lit(0)), [5], "bigint") == [None]
    # too large for a product of two bigints
    big = lambda c: fn.rescale_half_even(c, F.lit(10**15), F.lit(10**15))
    assert values(spark, big, [123456789012345], "bigint") == [123456789012345]
    assert values(spark, lambda c: fn.percent_half_even(c, F.lit(3)), [1, 2, 3], "bigint") == [33.33, 66.67, 100.0]


def test_number_labels(spark):
    assert values(spark, fn.abbrev_km, [999, 1000, 2500, 3500, 1_250_000, 25_000_000], "bigint") == [
        "999", "1K", "2K", "4K", "1.2M", "25.0M",
    ]
    assert values(spark, lambda c: fn.thousands(c, "위"), [0, 1234567], "bigint") == ["0위", "1,234,567위"]
    assert values(spark, fn.total_pages, [0, 1, 20, 21], "bigint") == [0, 1, 1, 2]
    assert values(spark, fn.hms, [0, 59, 3661, 360000], "bigint") == ["00:00:00", "00:00:59", "01:01:01", "100:00:00"]


def test_relative_age_borders(spark):
    now = datetime(2024, 5, 1, 12, 0, 0)
    times = [None, datetime(2024, 5, 1, 11, 59, 1), datetime(2024, 5, 1, 11, 59), datetime(2024, 5, 1, 11, 0, 1), datetime(2024, 5, 1, 9, 59)]
    out = values(spark, lambda c: fn.relative_age(c, now), times, "timestamp_ntz")
    assert out == ["없음", "59초 전", "1분 전", "59분 전", "2시간 전"]


def test_texts(spark):
    assert values(spark, fn.ellipsize, ["x" * 18, "x" * 19]) == ["x" * 18, "x" * 15 + "..."]
    assert values(spark, fn.clean_text, ["\t a b \n"]) == ["a b"]
    assert values(spark, fn.id_from_call, ["detail(2954, 3)", "detail()", "x"]) == ["2954", None, None]
    ranges = values(spark, fn.rank_range, ["1,001위 ~ 1,020위", "none"])
    assert (ranges[0]["lo"], ranges[0]["hi"]) == (1001, 1020)
    assert (ranges[1]["lo"], ranges[1]["hi"]) == (None, None)
    assert values(spark, lambda c: fn.absolute_url(c, "https://b.example"), ["/a", "http://x/y"]) == [
        "https://b.example/a", "http://x/y",
    ]
    assert values(spark, fn.json_roundtrip, ['{"a": "가", "b": [1, 2]}', "not json"]) == ['{"a":"가","b":[1,2]}', "not json"]


def test_dates(spark):
    now = datetime(2024, 5, 1)
    out = values(spark, lambda c: fn.parse_datetime_or(c, now), ["2025.05.15 09:40", "2025-05-15 09:40:01", "bad", None])
    assert out == [datetime(2025, 5, 15, 9, 40), datetime(2025, 5, 15, 9, 40, 1), now, now]
    texts = ["2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00-02:30"]
    local = [datetime(2024, 1, 1), datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 11, 30)]
    assert values(spark, fn.parse_to_local, texts) == local
    assert values(spark, lambda c: fn.parse_to_local(c, strict=True), texts) == [None, *local[1:]]
    last = [datetime(2024, 1, 1, 23, 59, 59), datetime(2024, 1, 1)]
    assert values(spark, fn.midnight_minutes, last, "timestamp_ntz") == [0, 1440]
    wednesday = [datetime(2024, 1, 3, 18, 30, 59), datetime(2024, 1, 3, 18, 31), datetime(2024, 1, 4, 18, 30)]
    assert values(spark, fn.weekly_slot, wednesday, "timestamp_ntz") == [True, False, False]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/New_York"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        when = [datetime(2024, 3, 10, 2, 30, 0, 123456)]
        micros = values(spark, lambda c: F.unix_micros(fn.instant_of(c)), when, "timestamp_ntz")
        assert micros == [1710005400123456]
        assert values(spark, lambda c: fn.wall_clock_of(fn.instant_of(c)), when, "timestamp_ntz") == when
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
