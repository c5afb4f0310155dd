import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankmill.llm.spelling import blocks, in_order, last_forms, near_words, spelling_variants, word_counts
from rankmill.llm.spelling_queries import op13_spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, slips):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def changed(word, letters):
    """All texts at one inserted, deleted or replaced letter."""
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out |= {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def plain(rows, slips=0, least_letters=6, least_count=5, times=5):
    words = {w: n for w, n in plain_counts(rows, slips).items() if len(w) >= least_letters and n >= least_count}
    letters = {c for w in words for c in w}
    out, form = {}, {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in changed(w, letters) if x in words)
        if near and -near[0][0] >= times * n:
            form[w] = near[0][1]
        out[w] = [n, len(near)]
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, out[w][0], out[w][1], words.get(form.get(w)))
    return out


def collected(frame):
    rows = frame.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_variants_match_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abé", "aÀÿ×"])
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 14))) for _ in range(12)]
    rows = []
    for id in range(40):
        words = []
        for _ in range(60):
            word = rng.choice(stems[: rng.randrange(1, 13)])
            if rng.random() < 0.3:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", rng.choice(letters), word[at] * 2]) + word[at + 1 :]
            words.append(rng.choice([word, word.upper().replace("É", "é"), word]))
        rows.append((id, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    frame = spark.createDataFrame(rows, "id long, content string")
    for options in ({}, {"slips": 5}, {"least_letters": 3, "least_count": 1, "times": 2}):
        assert collected(spelling_variants(frame, **options)) == plain(rows, **options), options


def test_counts_match_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "Abcdef abcdéf ÀBCDEF"), (1, "Abcdef abcdéf ÀBCDEF"), (2, None), (None, "abcdef xĀabcdefg"), (3, ""), (4, "\xd7\xf7abcd")]
    frame = spark.createDataFrame(rows, "id long, content string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = {r["word"]: r["n"] for r in word_counts(frame, slips=3).collect()}
    assert got == {w: n for w, n in plain_counts(rows, 3).items() if len(w) >= 6}
    assert spelling_variants(spark.createDataFrame([], "id long, content string")).count() == 0


def test_blocks_part_no_run():
    rng = random.Random(9)
    text = "".join(rng.choice("abé ,\n日") for _ in range(3000)).encode()
    for most in (1, 7, 100, 10_000):
        parts = list(blocks(text, most))
        assert b"".join(parts) == text
        runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
        assert [r for p in parts for r in runs.findall(p)] == runs.findall(text)


def test_one_very_long_text(spark):
    text = " ".join(["variant", "varient", "variants"] * 2 + ["variant"] * 300_000 + ["varient"] * 9)
    got = collected(spelling_variants(spark.createDataFrame([(1, text)], "id long, content string")))
    assert got["varient"] == ("variant", "variant", 11, 1, 300_002)
    word = "ab" * 4000
    few = spark.createDataFrame([(1, f"{word} {word[:-1]} {word[:3000]}c{word[3001:]} " * 6)], "id long, content string")
    assert sorted(v[3] for v in collected(spelling_variants(few)).values()) == [1, 1, 2]


def test_a_hot_pair_holds_no_more_words_than_letters(spark):
    """All words but for one letter, each near every other one: counted without pairs of all with all."""
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    words = spark.createDataFrame([(f"abc{c}defgh", 7) for c in letters] + [("abcdefgh", 40)], "word string, n long")
    words = in_order(words)
    names = {r["place"]: r["word"] for r in words.collect()}
    got = {names[r["place"]]: (r["n_near"], names[r["best"]["place"]]) for r in near_words(words).collect()}
    assert got["abcdefgh"] == (len(letters), "abcadefgh")
    assert got["abczdefgh"] == (len(letters), "abcdefgh")


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)], "word string, form string")
    assert {r["root"] for r in last_forms(links).collect()} == {"w100"}


def test_query_matches_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert collected(op13_spelling_variants(spark, small)) == plain(docs, slips=199)
