import random

import pytest

from rankmill.llm.mixing import list_targets, mix_lists

from test_pipeline import plain_mix


def articles(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "id long, content string, list_key string, size int")


def test_taken_words_follow_the_targets(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["a", "b", "b", "b", "b", "é", "z", None])) for i in range(400)]
    rows += [rows[0], rows[0], (None, None, "a"), (500, "", "b"), (501, None, None)]
    got = [r.asDict() for r in mix_lists(articles(spark, rows)).collect()]
    assert len(got) == len(rows)
    by_list = {}
    for r in got:
        by_list.setdefault(r["list_key"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    assert sum(x[0]["target"] for x in by_list.values()) == pytest.approx(1.5 * total)
    for rs in by_list.values():
        assert rs[0]["list_words"] == sum(r["size"] for r in rs)
        assert rs[0]["target"] <= 2 * rs[0]["list_words"]
        assert 0 <= rs[0]["target"] - sum(r["taken"] for r in rs) < 4  # equal rows share what is left in whole words
    again = mix_lists(articles(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mix_lists(articles(spark, rows)).collect())
    whole = mix_lists(articles(spark, rows), whole=True).collect()
    plain = plain_mix([(i, t, "", k, 0) for i, t, k in rows])
    assert sum(r["taken"] for r in whole) == sum(len((r[1] or "").split()) for r in plain)


def test_targets_reshare_until_none_is_above(spark):
    lists = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 0), ("d", 50), (None, 1000)], "list_key string, list_words long")
    got = {r["list_key"]: r["target"] for r in list_targets(lists).collect()}
    assert got["a"] == 200 and got["c"] == 0 and got["d"] == 100
    assert got["b"] + got[None] == pytest.approx(1.5 * 2150 - 300) and got["b"] == pytest.approx(got[None])
    assert sum(got.values()) == pytest.approx(1.5 * 2150)


def test_empty_and_wordless(spark):
    assert mix_lists(articles(spark, []).limit(0)).count() == 0
    got = mix_lists(articles(spark, [(1, None, "a"), (2, " ", "b")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_columns_of_any_names_stay(spark):
    from rankmill.llm.mixing import mixed_rows

    rows = [(k, "w " * (k + 1), "s", -k, str(k), k) for k in range(6)]
    frame = spark.createDataFrame(rows, "id long, body string, source string, _mix_round int, given string, size int")
    got = mixed_rows(frame, "id", "body", "source")
    assert got.columns == frame.columns
    assert set(map(tuple, got.collect())) == set(rows) and got.count() > 6


def test_one_very_long_text(spark):
    rows = [(1, "word " * 500_000, "a"), (2, "few words", "b")]
    got = {r["id"]: (r["size"], r["taken"]) for r in mix_lists(articles(spark, rows)).collect()}
    assert got[1][0] == 500_000 and got[2][0] == 2
    assert abs(sum(t for _, t in got.values()) - 1.5 * 500_002) < 4
