import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.llm.key_filter import key_filter, passes
from rankmill.llm.phrases import Index, Shard, collocations, shard_indexes, transform
from rankmill.llm.words import pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def piece_words(text):
    parts = (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)))
    return [p for p in parts if p]


def counted(texts):
    """phrase (tuple) -> occurrences, with a word before, with a word after."""
    out = Counter(), Counter(), Counter()
    for text in texts:
        for words in piece_words(text):
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    phrase = tuple(words[i : i + k])
                    out[0][phrase] += 1
                    out[1][phrase] += i > 0
                    out[2][phrase] += i + k < len(words)
    return out


def plain(rows, least=30, percent=80, top=2000):
    lists = {}
    for name, text in rows:
        lists.setdefault("und" if name is None else name, []).append(text)
    out = {}
    for name, texts in lists.items():
        f, left, right = counted(texts)
        total = sum(n for p, n in f.items() if len(p) == 1)
        often = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        scored = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * n >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], left[p], right[p]))
        for rank, (score, a, phrase, l, r, x, y) in enumerate(sorted(scored)[:top], 1):
            out[name, rank] = (phrase.decode(), -a, l, r, total, -score, x, y)
    return out


def collected(frame):
    rows = frame.collect()
    got = {(r["list_key"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"], r["n_left"], r["n_right"]) for r in rows}
    assert len(got) == len(rows)
    return got


def a_text(rng, words, marks):
    return "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("seed", range(8))
def test_intervals_of_the_index_match_brute_force(seed):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "d d", "\xa0"][: rng.randrange(1, 6)]
    texts = [a_text(rng, words, [" ", "\t ", ".", "\n", " - "]) for _ in range(12)]
    shard = Shard()
    import pyarrow as pa

    for _, data, offsets in pieces(pa.array([t.encode() for t in texts], pa.binary()), 64):
        shard.add(data, offsets)
    sequence = shard.sequence()
    index = Index((transform(sequence, 4), transform(sequence[::-1].copy(), 4)), len(shard.words))
    f, left, right = counted(texts)

    def named(found):
        columns = zip(found.words.tolist(), found.count.tolist(), index.neighbours(found, 0).tolist(), index.neighbours(found, 1).tolist())
        return {tuple(shard.words[w - 1].decode() for w in p): x for p, *x in columns}

    def want(k):
        return {p: [f[p], left[p], right[p]] for p in f if len(p) == k}

    single = index.single(np.arange(1, len(shard.words) + 1))
    assert named(single) == want(1)
    for sides in ((0, 0, 0), (1, 1, 1), (0, 1, 0), (1, 0, 1), (0, 0, 1), (1, 1, 0)):
        found = single
        for k, side in enumerate(sides, 2):
            found = index.extend(found, side)
            assert named(found) == want(k), sides


@pytest.mark.parametrize("seed", range(3))
def test_collocations_match_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "x-y", "日本", "n"]
    rows = [(rng.choice(["a", "b", None, "und"]), a_text(rng, words[: rng.randrange(1, 9)], [" ", " ", " ", ", ", "\n"])) for _ in range(80)]
    frame = spark.createDataFrame(rows, "list_key string, content string").repartition(5)
    for options in ({"least": 6}, {"least": 1, "inside_percent": 50, "top": 7}):
        want = plain(rows, options["least"], options.get("inside_percent", 80), options.get("top", 2000))
        assert collected(collocations(frame, **options, shard_words=100)) == want


def test_nulls_repeated_rows_empty_tables_and_clashing_columns(spark):
    rows = [(None, "A b a b"), (None, "A b a b"), ("x", None), ("x", ""), ("x", ". ,\n"), ("und", "a b")]
    frame = spark.createDataFrame(rows, "list_key string, content string").withColumn("phrase", F.lit("z")).withColumn("rank", F.lit(1))
    assert collected(collocations(frame, least=2)) == plain(rows, 2)
    assert collocations(spark.createDataFrame([], "list_key string, content string")).count() == 0
    assert collocations(spark.createDataFrame([("a", None)], "list_key string, content string")).count() == 0


def test_one_very_long_text_makes_several_shards(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["left", "right", "up", "down"]) + rng.choice(["", "", ",", "."]) for _ in range(400_000))
    rows = [("a", text)]
    frame = spark.createDataFrame(rows, "list_key string, content string")
    indexes = shard_indexes(frame, shard_words=100_000)
    assert indexes.count() > 1 and indexes.agg(F.sum("n_words")).first()[0] == 400_000
    assert collected(collocations(frame, shard_words=100_000)) == plain(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    from rankmill.llm.phrases import _score

    rows = [(9 * 10**13, 10**14, 9 * 10**13 + 1), (30, 30, 30), (7, 11, 13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(_score("a", "l", "r").alias("s")).collect()
    assert [r["s"] for r in got] == [2_000_000 * a // (l + r) for a, l, r in rows]


def test_filter_holds_all_its_keys(spark):
    keys = [random.Random(1).randrange(-(2**63), 2**63) for _ in range(5000)]
    bits = key_filter(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert passes(bits, np.array(keys).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000).view(np.uint64)
    assert passes(bits, others).mean() < 0.1
    assert not passes(key_filter(spark.createDataFrame([], "key long")), others).any()


def test_packed_counts_come_back():
    from rankmill.llm.phrases import _packed, _unpacked

    rng = np.random.default_rng(3)
    for n in (1, 5, 4000):
        low = np.unique(rng.integers(0, 2**32, n).astype(np.uint32))
        counts = rng.integers(1, 31, len(low))
        got, got_counts = _unpacked(_packed(low, counts))
        assert (got == low).all() and (got_counts == counts).all()
    assert len(_packed(low, np.ones(len(low), dtype=np.int64))) < 4 * len(low)


def test_packed_phrases_come_back():
    import pyarrow as pa

    from rankmill.llm.phrases import _packed_phrases, _unpacked_phrases

    phrases = [f"w{i * 7919 % 1000} é{i}" for i in range(1000)]
    counts = np.random.default_rng(1).integers(0, 2**32, (1000, 3))
    got = _unpacked_phrases(_packed_phrases(pa.array(phrases, pa.large_string()), counts)).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == sorted((p, *c) for p, c in zip(phrases, counts.tolist()))


def test_phrases_of_a_shard_are_sent_in_packed_rows(spark):
    """Only frequent phrases become rows; what shards send is as many rows as shards and buckets."""
    from rankmill.llm.phrases import frequent_phrases

    texts = [" ".join(f"w{(i * k) % 13}" for k in range(60)) for i in range(400)]
    indexes = shard_indexes(spark.createDataFrame([("x", t) for t in texts], "list_key string, content string"), shard_words=800)
    phrases = frequent_phrases(indexes, 30)[1]
    plan = phrases._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(list_key" not in plan
    f, left, right = counted(texts)
    often = {" ".join(p): (n, left[p], right[p], len(p)) for p, n in f.items() if len(p) > 1 and n >= 30}
    assert {r["phrase"]: (r["n"], r["n_left"], r["n_right"], r["n_words"]) for r in phrases.collect()} == often
