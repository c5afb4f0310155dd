import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from rankmill.llm.decontamination import Automaton, benchmark_hits, clean_articles, cut_out, item_words, n_hit, over_limit, united
from rankmill.llm.words import pieces


def brute(text, items, window):
    words, hit, names = item_words(text), set(), set()
    for name, item in items:
        k = min(window, len(item))
        for i in range(len(item) - k + 1 if item else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == item[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(name)
    return len(words), hit, names


@pytest.mark.parametrize("seed", range(60))
def test_scan_matches_brute_force(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc", "abcdefgh"])

    def text(most):
        return rng.choice([" ", ", ", "-"]).join(rng.choice(letters) for _ in range(rng.randrange(most)))

    items = [(str(i), item_words(text(9))) for i in range(rng.randrange(1, 8))]
    texts = [text(40).upper() for _ in range(12)] + ["", None]
    automaton = Automaton(items, 4)
    column = pa.array([None if t is None else t.encode() for t in texts], type=pa.binary())
    for size in (1, 1 << 20):
        for first, data, offsets in pieces(column, size):
            n_words, spans, found = automaton.scan(data, offsets)
            for i in range(len(offsets) - 1):
                want = brute(texts[first + i], items, 4)
                assert (n_words[i], {k for a, b in spans[i] for k in range(a, b)}, found[i]) == want


@pytest.mark.parametrize("block_words", [20, 10_000])
def test_articles(spark, block_words):
    item = " ".join(f"q{i}" for i in range(20))
    articles = spark.createDataFrame(
        [
            (1, f"Before, {item.upper()}! after", 5),
            (1, f"Before, {item.upper()}! after", 5),
            (2, "nothing here", 5),
            (None, None, 5),
            (3, " ".join(f"q{i}" for i in range(5, 17)), 5),
            (4, "say Short One now " + "x " * 90, None),
        ],
        "id int, content string, n_words int",
    )
    items = spark.createDataFrame(
        [(7, item), (7, item), (12, "short one"), (9, None), (8, "..."), (None, "x x x y")], "item_id long, text string"
    )
    found = benchmark_hits(articles, items, block_words=block_words)
    found = found.withColumn("hit", n_hit(found["spans"]))
    rows = found.withColumn("over", over_limit(found["n_words"], found["hit"])).collect()
    assert sorted((r["id"] or 0, r["n_words"], r["hit"], r["items"], r["over"]) for r in rows) == [
        (0, 0, 0, [], False), (1, 22, 20, ["7"], True), (1, 22, 20, ["7"], True), (2, 2, 0, [], False),
        (3, 12, 0, [], False), (4, 94, 2, ["12"], False),
    ]
    assert benchmark_hits(articles.limit(0), items).count() == 0
    none = benchmark_hits(articles, items.limit(0)).collect()
    assert len(none) == 6 and not any(r["spans"] for r in none)


def plain_cut(text, spans):
    """Words one by one: those of a span go, and what follows them up to the next word."""
    import re

    found = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    gone = bytearray(len(text))
    for a, b in spans:
        for k in range(a, b):
            last = found[k + 1][0] if k + 1 < len(found) else found[k][1]
            gone[found[k][0] : last] = b"x" * (last - found[k][0])
    return bytes(c for c, g in zip(text, gone) if not g)


@pytest.mark.parametrize("seed", range(20))
def test_spans_are_cut_out_of_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "É", "日b", "1", " ", ", ", "\n", "-"]) for _ in range(60)).encode()
    n = len(item_words(text.decode()))
    picks = united(sorted((a, min(n, a + rng.randrange(1, 5))) for a in (rng.randrange(n) for _ in range(rng.randrange(4)))) if n else [])
    assert cut_out(text, picks) == plain_cut(text, picks)


@pytest.mark.parametrize("block_words", [9, 40, 100_000])
def test_clean_articles_match_brute_force(spark, block_words):
    rng = random.Random(block_words)
    words = [f"v{i}" for i in range(12)]
    items = [(str(i), [rng.choice(words) for _ in range(rng.randrange(1, 12))]) for i in range(8)]
    rows = []
    for id in range(40):
        filler = [f"f{rng.randrange(99)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(filler))
            filler[at:at] = rng.choice(items)[1]
        rows.append((id, rng.choice([" ", ", "]).join(filler).title(), "x", None, -1))
    rows += [rows[0], (50, None, None, "y", -1), (None, "", "z", None, -1)]
    schema = "key int, text string, given string, content string, n int"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    got = clean_articles(frame, "text", benchmark, window=4, percent=30, span_words=5, n_chars="n", block_words=block_words)
    assert got.columns == frame.columns
    want = []
    for row in rows:
        n, hit, _ = brute(row[1], [(i, [w.encode() for w in x]) for i, x in items], 4)
        if hit and 100 * len(hit) >= 30 * n:
            continue
        spans = united([(k, k + 1) for k in sorted(hit)])  # touching ones are one
        long = [(a, b) for a, b in spans if b - a > 5]
        text = plain_cut(row[1].encode(), long).decode() if long else row[1]
        want.append((row[0], text, *row[2:4], len(text) if long else -1))
    assert any(r[4] >= 0 for r in want)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_fifty_blocks_make_one_python_stage_per_pass(spark):
    items = spark.createDataFrame([(str(i), " ".join(f"i{i}w{k}" for k in range(14))) for i in range(120)], "item_id string, text string")
    rows = [(i, " ".join(f"i{i}w{k}" for k in range(i % 3, 14))) for i in range(0, 120, 5)]
    found = benchmark_hits(spark.createDataFrame(rows, "id long, content string"), items, block_words=33)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["id"]: r["items"] for r in found.collect()} == {i: [str(i)] if i % 3 < 2 else [] for i, _ in rows}


def test_one_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(60))
    text = " ".join(f"w{i % 50_021}" for i in range(400_000)) + " " + item + " end"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, text)], "id long, content string")
    assert benchmark_hits(rows, items).select(n_hit(F.col("spans"))).first()[0] == 60
    assert clean_articles(rows, "content", items).first()["content"] == text.replace(item + " ", "")
